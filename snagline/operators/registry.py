"""The registry of targets: who owns what, and where it is filed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snagline import fixed


def _of(registry: DataFrame, kind: str) -> DataFrame:
    return registry.filter(F.col("kind") == kind)


def registry_checks(registry: DataFrame) -> DataFrame:
    """Broken rules, one row per target and rule; an empty result is a valid registry."""
    name, kind = F.col("name"), F.col("kind")
    named = kind.isin("owner", "external")
    no_text = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    rules: list[tuple[Column, str]] = [
        (named & (name == fixed.UNOWNED), "reserved name"),
        (named & (name != fixed.UNOWNED) & ~name.rlike(rf"\A{fixed.TARGET_NAME_PATTERN}\z"), "invalid name"),
        ((kind == "owner") & ~F.col("tracker").eqNullSafe(F.lit(fixed.TRACKER)), "unsupported tracker"),
        (named & no_text("scope"), "scope missing"),
        (
            (named | F.col("repo").isNotNull())
            & ~F.coalesce(F.col("repo").rlike(rf"\A{fixed.REPO_PATTERN}\z"), F.lit(False)),
            "invalid repo",
        ),
        ((kind == "external") & F.col("tracker").isNotNull(), "tracker not allowed"),
        ((kind == "external") & F.col("labels").isNotNull(), "labels not allowed"),
    ]
    errors = F.filter(
        F.array(*[F.when(test, F.lit(text)) for test, text in rules]), lambda e: e.isNotNull()
    )
    own = registry.select("name", F.explode(errors).alias("error"))
    overlap = registry_overlap(registry).withColumn("error", F.lit("name in both sections"))
    no_home = (
        registry.agg(F.count_if((kind == fixed.UNOWNED) & ~no_text("repo")).alias("n"))
        .filter("n = 0")
        .select(F.lit(fixed.UNOWNED).alias("name"), F.lit("unowned repo missing").alias("error"))
    )
    return own.unionByName(overlap).unionByName(no_home)


def registry_overlap(registry: DataFrame) -> DataFrame:
    """Names that are both an owner and an external target."""
    return _of(registry, "owner").select("name").intersect(_of(registry, "external").select("name"))


def target_vocabulary(registry: DataFrame) -> DataFrame:
    """Owner names, external names and the reserved one."""
    reserved = registry.agg(F.lit(fixed.UNOWNED).alias("name"))
    named = registry.filter(F.col("kind").isin("owner", "external")).select("name")
    return named.union(reserved).distinct()


def registered_repos(registry: DataFrame) -> DataFrame:
    """Distinct owner repositories and the unowned one."""
    return (
        registry.filter(F.col("kind").isin("owner", fixed.UNOWNED) & F.col("repo").isNotNull())
        .select("repo").distinct()
    )


def target_repos(registry: DataFrame) -> DataFrame:
    """(target, repo, kind, owner_labels) for every name a cluster may carry.

    External names and the reserved one file into the unowned repository, which
    is one value of the whole registry: it is read as a scalar, so no row is
    paired with every other.
    """
    unowned_repo = (
        _of(registry, fixed.UNOWNED).agg(F.max("repo").alias("repo")).scalar()
    )
    none = F.array().cast("array<string>")
    named = registry.filter(F.col("kind").isin("owner", "external")).select(
        F.col("name").alias("target"),
        "kind",
        F.when(F.col("kind") == "owner", F.col("repo")).otherwise(unowned_repo).alias("repo"),
        F.when(F.col("kind") == "owner", F.coalesce("labels", none)).otherwise(none).alias("owner_labels"),
    )
    reserved = registry.agg(F.max(F.when(F.col("kind") == fixed.UNOWNED, F.col("repo"))).alias("repo")).select(
        F.lit(fixed.UNOWNED).alias("target"), F.lit(fixed.UNOWNED).alias("kind"), "repo",
        none.alias("owner_labels"),
    )
    return named.unionByName(reserved)


def required_labels(registry: DataFrame) -> DataFrame:
    """Ordered labels each target's repository must have."""
    base = F.array(
        *[F.lit(x) for x in [fixed.BASE_LABEL, *fixed.PRIORITY_LABELS, fixed.FIX_NOW_LABEL]]
    )
    return target_repos(registry).filter(
        F.col("kind").isin("owner", fixed.UNOWNED) & F.col("repo").isNotNull()
    ).select("target", "repo", F.array_distinct(F.concat(base, "owner_labels")).alias("labels"))
