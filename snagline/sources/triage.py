"""Inputs of the triage step: issue pages, registry, clusters, manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snagline import fixed
from snagline.functions import rules as Q
from snagline.functions import variants as V

_ISSUE = (
    "struct<number: bigint, state: string, stateReason: string, url: string, title: string, "
    "body: string, labels: struct<nodes: array<struct<name: string>>>, "
    "comments: struct<totalCount: bigint, nodes: array<struct<body: string>>>>"
)
PAGE_SCHEMA = (
    "repo string, data struct<repository: struct<issues: struct<totalCount: bigint, "
    f"nodes: array<{_ISSUE}>>>>"
)
REGISTRY_SCHEMA = (
    "name string, kind string, tracker string, repo string, scope string, labels array<string>"
)


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """One stored listing page per line; an unreadable page is an error."""
    return spark.read.schema(PAGE_SCHEMA).option("mode", "FAILFAST").json(path)


def scan_issues(pages: DataFrame) -> DataFrame:
    """One row per issue: labels, comment bodies and the declared comment count."""
    issues = pages.select(
        "repo",
        F.col("data.repository.issues.totalCount").alias("declared"),
        F.explode("data.repository.issues.nodes").alias("i"),
    )
    none = F.array().cast("array<string>")
    return issues.select(
        "repo",
        F.col("i.number").alias("number"),
        F.col("i.state").alias("state"),
        F.col("i.stateReason").alias("state_reason"),
        F.col("i.url").alias("url"),
        F.col("i.title").alias("title"),
        F.col("i.body").alias("body"),
        F.coalesce(F.transform("i.labels.nodes", lambda n: n["name"]), none).alias("labels"),
        F.coalesce(F.transform("i.comments.nodes", lambda n: n["body"]), none).alias("comments"),
        F.coalesce("i.comments.totalCount", F.lit(0).cast("bigint")).alias("comments_total"),
        "declared",
    )


def incomplete_repos(issues: DataFrame) -> DataFrame:
    """Repositories whose collected rows differ from what the source declared."""
    return (
        issues.groupBy("repo")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.max("declared").alias("declared"))
        .filter(F.col("n_rows") != F.col("declared"))
    )


class IncompleteListing(ValueError):
    """A partial index is worse than none."""


def completeness_check(issues: DataFrame) -> DataFrame:
    """`issues` unchanged, or an error naming the first incomplete repository."""
    short = incomplete_repos(issues).orderBy("repo").first()
    if short is not None:
        raise IncompleteListing(
            f"{short.repo}: collected {short.n_rows} issue(s) but {short.declared} were declared"
        )
    return issues


def issue_texts(issues: DataFrame, full_comments: DataFrame | None = None) -> DataFrame:
    """(repo, number, source, text): bodies, and comments one row each.

    Where a listing holds fewer comments than it declares, `full_comments`
    (repo, number, text) stands in for it.  Comments stay rows throughout, so an
    issue with any number of them is spread like everything else.
    """
    bodies = issues.select("repo", "number", F.lit("body").alias("source"), F.col("body").alias("text"))
    complete = F.col("comments_total") <= F.size("comments")
    listed = issues.filter(complete).select(
        "repo", "number", F.lit("comment").alias("source"), F.explode("comments").alias("text")
    )
    out = bodies.unionByName(listed)
    if full_comments is not None:
        cut = issues.filter(~complete).select("repo", "number")
        fetched = full_comments.join(cut, ["repo", "number"], "left_semi").select(
            "repo", "number", F.lit("comment").alias("source"), "text"
        )
        out = out.unionByName(fetched)
    return out.filter(F.col("text").isNotNull())


def scan_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REGISTRY_SCHEMA).option("mode", "FAILFAST").json(path)


def elements(docs: DataFrame, keep: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Elements of array documents with their 0-based place: the place is the key."""
    array = F.try_variant_get(F.parse_json(F.col(value)), "$", "array<variant>")
    return docs.select(*keep, F.posexplode(array).alias("place", "e"))


def scan_clusters(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Clusters of each document; `keep` names columns that tell documents apart."""
    e = F.col("e")
    members = F.try_variant_get(e, f"$.{fixed.MEMBERS_KEY}", "array<string>")
    return elements(docs, keep).select(
        *keep,
        F.col("place").cast("bigint").alias("cluster"),
        V.string_at(e, "$.improvement").alias("improvement"),
        members.alias("members"),
        V.string_at(e, "$.target").alias("target"),
        V.string_at(e, "$.effort").alias("effort"),
        V.string_at(e, "$.confidence").alias("confidence"),
        element_errors(e, F.col("place"), Q.CLUSTER_RULES).alias("errors"),
    )


def scan_consolidations(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    e = F.col("e")
    return elements(docs, keep).select(
        *keep,
        F.col("place").cast("bigint").alias("entry"),
        V.integer_at(e, "$.cluster").alias("cluster"),
        V.string_at(e, "$.issue").alias("issue"),
        element_errors(e, F.col("place"), Q.CONSOLIDATION_RULES).alias("errors"),
    )


def element_errors(e: Column, place: Column, rules) -> Column:
    path = F.concat(F.lit("["), place, F.lit("]"))
    return Q.validate_nested(e, path, rules)


def scan_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Every <date>.json of a folder, parsed; other names are ignored.

    An unreadable manifest fails the scan, because a guard must not go blind.
    """
    docs = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file"), "value"
    )
    dated = docs.filter(F.col("file").rlike(rf"\A{fixed.RUN_DATE_PATTERN}\.json\z"))
    return dated.select(
        F.substring("file", 1, 10).alias("file_date"), F.parse_json("value").alias("m")
    )


def prior_writes_of(manifests: DataFrame) -> DataFrame:
    """(run_date, section, entry, place, id, url): one row per id ever written out."""
    parts = []
    for rank, (section, link) in enumerate((("filed", "url"), ("consolidated", "issue"))):
        entries = manifests.select(
            F.col("file_date").alias("run_date"),
            F.posexplode(F.variant_get("m", f"$.{section}", "array<variant>")).alias("entry", "e"),
        )
        ids = F.variant_get("e", f"$.{fixed.MEMBERS_KEY}", "array<string>")
        parts.append(
            entries.select(
                "run_date", F.lit(rank).alias("section"), "entry",
                F.variant_get("e", f"$.{link}", "string").alias("url"),
                F.posexplode(ids).alias("place", "id"),
            )
        )
    return parts[0].unionByName(parts[1])
