"""Reading semi-structured values without trusting their shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_object(line: Column) -> Column:
    """The parsed line when it is a JSON object, else null."""
    return F.when(line.rlike(r"\A\s*\{"), F.try_parse_json(line))


def at(v: Column, path: str) -> Column:
    """The value under `path`: null when missing, a variant null when explicit."""
    return F.try_variant_get(v, path, "variant")


def kind(v: Column) -> Column:
    """STRING, BIGINT, BOOLEAN, VOID, ARRAY<...>, OBJECT<...>, ..."""
    return F.schema_of_variant(v)


def string_at(v: Column, path: str) -> Column:
    """The value under `path` only if it is a string."""
    value = at(v, path)
    return F.when(kind(value) == "STRING", F.try_variant_get(v, path, "string"))


def integer_at(v: Column, path: str) -> Column:
    """The value under `path` only if it is an integer; a boolean is not one."""
    value = at(v, path)
    return F.when(kind(value) == "BIGINT", F.try_variant_get(v, path, "bigint"))


def is_true_at(v: Column, path: str) -> Column:
    """Exactly the boolean true; "true" and 1 are not."""
    value = at(v, path)
    return F.coalesce(
        F.when(kind(value) == "BOOLEAN", F.try_variant_get(v, path, "boolean")), F.lit(False)
    )


def is_present(v: Column, path: str) -> Column:
    """The key exists, whatever its value."""
    return at(v, path).isNotNull()


def is_json_null(v: Column, path: str) -> Column:
    return F.coalesce(F.is_variant_null(at(v, path)), F.lit(False))


def json_string(c: Column) -> Column:
    """The JSON text of a string column."""
    return F.to_json(c.cast("variant"))
