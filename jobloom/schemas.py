"""Table schemas, closed vocabularies, and the loader that conforms a frame to a schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

_TYPES: dict[str, DataType] = {"string": StringType(), "int": IntegerType(), "long": LongType(), "double": DoubleType(), "boolean": BooleanType()}


def struct(columns: str) -> StructType:
    """A schema from 'name type, ...'; unlike Spark's own parser it needs no session."""
    return StructType([StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(","))])


EMPLOYMENT = ("permanent", "contract", "unknown")
IR35 = ("inside", "outside", "unknown")
RATE_VERDICT = ("pass", "review", "fail", "unknown")
CLEARANCE = ("blocked", "possible", "none")
MY_STATUS = ("applied", "saved", "skipped", "interview", "rejected")
SCAN_VERDICT = ("pass", "borderline", "fail", "unknown")

POSTING = struct("url string, company string, title string, location string, posted_at string, description string, employment_type string, day_rate_min double, day_rate_max double, day_rate_source string, source string")
CONTRACT_FIELDS = ("employment_type", "ir35_status", "ir35_evidence", "day_rate_min", "day_rate_max", "day_rate_source", "rate_verdict", "rate_required", "perm_equivalent", "rate_reason")
SCREEN_FIELDS = ("language_tier", "language_rank", "language_hits", "clearance_status", "clearance_evidence")
JOB_DETAILS = struct(
    "url string, company string, title string, location string, posted_at string, description string, source string, passed_filters boolean, fetched_at string, "
    "employment_type string, ir35_status string, ir35_evidence string, day_rate_min double, day_rate_max double, day_rate_source string, rate_verdict string, rate_required double, perm_equivalent double, rate_reason string, "
    "language_tier string, language_rank int, language_hits string, clearance_status string, clearance_evidence string, last_listed_at string, duplicate_of string"
)
SEEN_JOBS = struct("url string, company_title_key string, company string, title string, first_seen_at string")
USER_STATUS = struct("url string, my_status string, notes string, updated_at string, inherited_from string")
AI_EVALUATIONS = struct("url string, match_score int, recommendation string, strengths string, gaps string, summary string, model string, evaluated_at string")
LESSONS = struct("mode string, hits int, first_seen string, last_seen string, active_since string, last_evidence string")


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The frame in the schema's columns: absent ones as typed nulls, unknown ones an error."""
    unknown = [c for c in df.columns if c not in schema.names]
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
