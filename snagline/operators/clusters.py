"""Clusters of open reports: checks, classes and consolidation.

`members` is the array a cluster came with.  Checks explode it; nothing but that
array's own length is ever put back together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snagline import fixed
from snagline.functions import text as T


def cluster_members(clusters: DataFrame) -> DataFrame:
    """(cluster, place, id)"""
    return clusters.select("cluster", F.posexplode("members").alias("place", "id"))


def cluster_unknown_ids(clusters: DataFrame, open_set: DataFrame) -> DataFrame:
    return cluster_members(clusters).join(open_set.select("id"), "id", "left_anti")


def cluster_unassigned(clusters: DataFrame, open_set: DataFrame) -> DataFrame:
    return open_set.select("id").join(cluster_members(clusters).select("id"), "id", "left_anti")


def target_unknown(clusters: DataFrame, vocabulary: DataFrame) -> DataFrame:
    names = vocabulary.select(F.col("name").alias("target"))
    return clusters.select("cluster", "target").join(names, "target", "left_anti")


def duplicate_assignment(clusters: DataFrame) -> DataFrame:
    """Ids assigned more than once: how often, and their first and second place.

    A reader that goes through the clusters in order stops at the second place.
    """
    members = cluster_members(clusters)
    spot = F.struct("cluster", "place")
    first = members.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min(spot).alias("_first")).filter("n > 1")
    return (
        members.join(first, "id").filter(spot > F.col("_first"))
        .groupBy("id", "n", "_first").agg(F.min(spot).alias("_second"))
        .select(
            "id", "n", F.col("_first.cluster").alias("first_cluster"),
            F.col("_second.cluster").alias("second_cluster"), F.col("_second.place").alias("second_place"),
        )
    )


def cluster_violations(clusters: DataFrame, open_set: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(rule, cluster, place, subject): every broken rule.

    Ordered by the first three columns, the first is where a strict reader stops;
    `open_set` carries `pos`, the order its ids were read in.
    """
    length = F.length("improvement")
    bad_rating = lambda c: ~F.coalesce(F.col(c).isin(fixed.RATINGS), F.lit(False))

    def rows(df: DataFrame, rule: int, subject: str, cluster: str = "cluster", place: Column = F.lit(0)) -> DataFrame:
        return df.select(
            F.lit(rule).cast("bigint").alias("rule"), F.col(cluster).cast("bigint").alias("cluster"),
            place.cast("bigint").alias("place"), F.col(subject).alias("subject"),
        )

    unassigned = open_set.join(cluster_unassigned(clusters, open_set), "id", "left_semi").withColumn(
        "cluster", F.lit(None).cast("bigint")
    )
    parts = [
        rows(clusters.filter((length < 1) | (length > 120)), 1, "improvement"),
        rows(clusters.filter(bad_rating("effort")), 2, "effort"),
        rows(clusters.filter(bad_rating("confidence")), 2, "confidence", place=F.lit(1)),
        rows(target_unknown(clusters, vocabulary), 3, "target"),
        rows(cluster_unknown_ids(clusters, open_set), 4, "id", place=F.col("place")),
        rows(duplicate_assignment(clusters), 5, "id", "second_cluster", F.col("second_place")),
        rows(unassigned, 6, "id", place=F.col("pos")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def first_violation(violations: DataFrame) -> DataFrame:
    """The one row a strict reader reports, or none."""
    return violations.orderBy("rule", "cluster", "place").limit(1)


class InvalidClusters(ValueError):
    """Clusters that break a rule are not planned."""


def checked_clusters(clusters: DataFrame, open_set: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """`clusters` unchanged, or an error naming the first violation."""
    bad = first_violation(cluster_violations(clusters, open_set, vocabulary)).first()
    if bad is not None:
        raise InvalidClusters(f"rule {bad.rule}, cluster {bad.cluster}: {bad.subject!r}")
    return clusters


def cluster_severity(clusters: DataFrame, open_set: DataFrame) -> DataFrame:
    """Gravest known severity of the members; low when none is known."""
    rank = T.severity_rank(F.col("severity"))
    return (
        cluster_members(clusters).join(open_set.select("id", "severity"), "id", "left")
        .groupBy("cluster").agg(F.min(rank).alias("_rank"))
        .select("cluster", F.coalesce(T.severity_of_rank(F.col("_rank")), F.lit("low")).alias("severity"))
    )


def open_links(index: DataFrame) -> DataFrame:
    """Per id: the first and last URL among OPEN issues that carry it.

    Two bounds are enough to tell none, one and several apart, so no list of
    URLs is gathered however often an id is mentioned.
    """
    return (
        index.filter(F.col("state") == "OPEN").groupBy("prefix")
        .agg(F.min("url").alias("first_url"), F.max("url").alias("last_url"))
    )


def classify_cluster(clusters: DataFrame, index: DataFrame) -> DataFrame:
    """file / noop / consolidate / error, from how many members are tracked."""
    members = cluster_members(clusters).withColumn("prefix", F.substring("id", 1, 11))
    tracked = F.col("first_url").isNotNull()
    per = (
        members.join(open_links(index), "prefix", "left").groupBy("cluster")
        .agg(
            F.count_if(tracked).alias("n_tracked"), F.count(F.lit(1)).alias("n_members"),
            F.min("first_url").alias("_first"), F.max("last_url").alias("_last"),
        )
    )
    one = F.col("_first") == F.col("_last")
    mixed = (F.col("n_tracked") > 0) & (F.col("n_tracked") < F.col("n_members"))
    return per.select(
        "cluster", "n_tracked", "n_members",
        F.when(F.col("n_tracked") == 0, "file")
        .when(F.col("n_tracked") == F.col("n_members"), "noop")
        .when(one, "consolidate").otherwise("error").alias("class"),
        F.when(mixed & one, F.col("_first")).alias("issue"),
    )


def conflicting_links(clusters: DataFrame, index: DataFrame) -> DataFrame:
    """(cluster, url): the open issues an `error` cluster is spread over."""
    wrong = classify_cluster(clusters, index).filter(F.col("class") == "error").select("cluster")
    members = cluster_members(clusters).join(wrong, "cluster", "left_semi").select(
        "cluster", F.substring("id", 1, 11).alias("prefix")
    )
    links = index.filter(F.col("state") == "OPEN").select("prefix", "url").distinct()
    return members.join(links, "prefix").select("cluster", "url").distinct()


def enrich_clusters(clusters: DataFrame, open_set: DataFrame, index: DataFrame) -> DataFrame:
    """Clusters with severity, class and, when consolidating, the issue."""
    return (
        clusters.join(cluster_severity(clusters, open_set), "cluster")
        .join(classify_cluster(clusters, index).drop("n_tracked", "n_members"), "cluster")
    )


def resolve_repo(clusters: DataFrame, repos: DataFrame) -> DataFrame:
    """Each cluster with the repository its target files into.

    `repos`: target, repo, kind, owner_labels (`registry.target_repos`).
    """
    return clusters.join(repos, "target", "left").withColumn(
        "repo_known", F.col("repo").isNotNull()
    )


def issue_candidates(enriched: DataFrame, repos: DataFrame, issues: DataFrame) -> DataFrame:
    """Open issues of every repository that holds a cluster to file."""
    wanted = resolve_repo(enriched.filter(F.col("class") == "file"), repos).select("repo").distinct()
    return issues.filter(F.col("state") == "OPEN").join(wanted, "repo", "left_semi")


def consolidation_errors(
    consolidations: DataFrame, enriched: DataFrame, repos: DataFrame, candidates: DataFrame
) -> DataFrame:
    """(rule, cluster): entries out of range, repeated, not `file`, or off the candidates."""
    known = resolve_repo(enriched.select("cluster", "class", "target"), repos).select(
        "cluster", "class", "repo"
    )
    seen = consolidations.join(known, "cluster", "left")

    def rows(df: DataFrame, rule: str) -> DataFrame:
        return df.select(F.lit(rule).alias("rule"), "cluster")

    missing = rows(seen.filter(F.col("class").isNull()), "out of range")
    repeated = rows(
        consolidations.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeated"
    )
    wrong_class = rows(seen.filter(F.col("class") != "file"), "not file")
    listed = candidates.select("repo", F.col("url").alias("issue"))
    off_list = rows(
        seen.filter(F.col("class") == "file").join(listed, ["repo", "issue"], "left_anti"),
        "not a candidate",
    )
    return missing.unionByName(repeated).unionByName(wrong_class).unionByName(off_list)


def apply_consolidations(enriched: DataFrame, consolidations: DataFrame) -> DataFrame:
    """Rewrite the class and issue of the named clusters."""
    named = consolidations.select("cluster", F.col("issue").alias("_issue"))
    return (
        enriched.join(named, "cluster", "left")
        .withColumn("class", F.when(F.col("_issue").isNotNull(), "consolidate").otherwise(F.col("class")))
        .withColumn("issue", F.coalesce("_issue", "issue"))
        .drop("_issue")
    )
