"""jobloom: a PySpark-native engine for job-posting data."""
