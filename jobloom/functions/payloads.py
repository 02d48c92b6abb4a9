"""JSON payloads in columns: objects out of stored or generated text, as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The fences that some writers put around JSON.
FENCE = r"(?i)^\s*```(?:json)?\s*|\s*```\s*$"


def _of_kind(v: Column, *kinds: str) -> Column:
    kind = F.schema_of_variant(v)
    ok = F.lit(False)
    for k in kinds:
        ok |= kind.startswith(k)
    return F.when(ok, v)


def stored_payload(c: Column) -> Column:
    """The object or array of a stored payload; null of one that is absent, broken, or a plain value."""
    return _of_kind(F.try_parse_json(c), "OBJECT", "ARRAY")


def loads_object(c: Column) -> Column:
    """The object of a generated text, with or without fences around it; null of everything else."""
    whole = F.try_parse_json(c)
    return _of_kind(F.when(whole.isNotNull(), whole).otherwise(F.try_parse_json(F.regexp_replace(c, FENCE, ""))), "OBJECT")


def field(payload: Column, path: str, kind: str = "string") -> Column:
    """A value of a payload; null where it is absent or of another kind."""
    return F.try_variant_get(payload, path, kind)
