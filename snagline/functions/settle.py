"""Compute costly expressions exactly once."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, exprs: Mapping[str, Column]) -> DataFrame:
    """Add or replace columns so that later steps read them and never recompute them.

    Filters and selects are normally merged into the select below them, and a
    parse or a chain of replacements would then run once per mention.  A one-row
    generator keeps them apart.
    """
    others = [c for c in df.columns if c not in exprs]
    made = F.struct(*[e.alias(n) for n, e in exprs.items()])
    return df.select(*others, F.explode_outer(F.array(made)).alias("_made")).select(
        *others, *[F.col("_made")[n].alias(n) for n in exprs]
    )
