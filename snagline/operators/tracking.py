"""Which issues carry which open reports, and what closed them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snagline import fixed
from snagline.operators import ordered
from snagline.session import cut_lineage


def prefix_owner(open_set: DataFrame, order: str) -> DataFrame:
    """(prefix, full_id): the last open id read owns a shared prefix."""
    prefix = F.regexp_extract("id", rf"\A{fixed.PREFIX_PATTERN}", 1)
    return (
        open_set.withColumn("prefix", prefix)
        .filter(F.col("prefix") != "")
        .groupBy("prefix")
        .agg(F.max_by("id", order).alias("full_id"))
        .select(F.concat(F.lit(fixed.ID_PREFIX), "prefix").alias("prefix"), "full_id")
    )


def text_prefixes(texts: DataFrame) -> DataFrame:
    """(repo, number, source, prefix): distinct id prefixes found in each text."""
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(fixed.PREFIX_PATTERN), F.lit(1)))
    hits = texts.select("repo", "number", "source", F.explode(found).alias("_hex"))
    return hits.withColumn("prefix", F.concat(F.lit(fixed.ID_PREFIX), "_hex")).drop("_hex")


def prefix_sources(mentions: DataFrame) -> DataFrame:
    """One row per issue and prefix; a body mention hides those in comments.

    "body" sorts before "comment", so the combining minimum is the rule.
    """
    keys = [c for c in mentions.columns if c != "source"]
    return mentions.groupBy(*keys).agg(F.min("source").alias("source"))


def comment_minus_body(texts: DataFrame) -> DataFrame:
    """Prefixes an issue carries in comments only."""
    return prefix_sources(text_prefixes(texts)).filter(F.col("source") == "comment").drop("source")


def prefix_intersect(texts: DataFrame, owners: DataFrame) -> DataFrame:
    """Distinct prefixes in text that belong to an open report."""
    return text_prefixes(texts).select("prefix").distinct().join(owners, "prefix", "left_semi")


def tracked_index(issues: DataFrame, texts: DataFrame, owners: DataFrame) -> DataFrame:
    """One row per (prefix, issue).

    Prefixes are extracted once per text and met with the open set on equality;
    no id is ever searched for in every text.  Mentions of nothing open go first,
    before the rest is brought together by issue.
    """
    hits = prefix_sources(text_prefixes(texts).join(owners, "prefix"))
    return hits.join(issues, ["repo", "number"]).select(
        "prefix", "repo", "number", "url", "state", "state_reason", "labels", "full_id", "source"
    )


def issue_ids(index: DataFrame) -> DataFrame:
    """(url, repo, number, state, state_reason, id): distinct ids of each issue."""
    return index.select(
        "url", "repo", "number", "state", "state_reason", F.col("full_id").alias("id")
    ).distinct()


def ids_per_issue(index: DataFrame) -> DataFrame:
    """The ids of each issue with their place, 0 for the smallest; an issue may hold any number of them."""
    chunk = F.substring("id", 1, len(fixed.ID_PREFIX) + 3)
    ranked = ordered.rank_in_group(issue_ids(index), ["url"], ["id"], chunk, "_n")
    return ranked.withColumn("place", F.col("_n") - 1).drop("_n")


def closed_coverage(index: DataFrame) -> DataFrame:
    """Closed issues with `rerouted`: every id is also on an open issue."""
    ids = cut_lineage(issue_ids(index))
    open_ids = ids.filter(F.col("state") == "OPEN").select("id").distinct().withColumn("_hit", F.lit(True))
    return (
        ids.filter(F.col("state") == "CLOSED")
        .join(open_ids, "id", "left")
        .groupBy("url", "repo", "number", "state_reason")
        .agg(F.bool_and(F.coalesce("_hit", F.lit(False))).alias("rerouted"))
    )


def rerouted(index: DataFrame) -> DataFrame:
    return closed_coverage(index).filter("rerouted").drop("rerouted")


def last_close_event(events: DataFrame) -> DataFrame:
    """The closer of each issue's last close event; null when nothing closed it."""
    return events.groupBy("repo", "number").agg(
        F.max_by(F.struct("closer"), "pos").alias("_e")
    ).select("repo", "number", F.col("_e.closer").alias("closer"))


def closer_evidence(index: DataFrame, events: DataFrame) -> DataFrame:
    """Closed, not rerouted issues: a merged pull request, or why there is no evidence.

    Close events are read only for issues still in question.
    """
    open_cases = closed_coverage(index).filter(~F.col("rerouted")).drop("rerouted")
    last = last_close_event(events.join(open_cases, ["repo", "number"], "left_semi"))
    merged = F.coalesce(
        (F.col("closer.type") == "PullRequest") & F.col("closer.merged"), F.lit(False)
    )
    return open_cases.join(last, ["repo", "number"], "left").select(
        "repo", "number", "url", "state_reason",
        F.when(merged, "resolve").otherwise("no-evidence").alias("outcome"),
        F.when(merged, F.col("closer.url")).alias("fix_url"),
        F.col("closer.type").alias("closer_type"),
    )


def resolutions_planned(index: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, issue, fix_url): ids of issues that a merged pull request closed."""
    fixed_issues = evidence.filter(F.col("outcome") == "resolve").select("url", "fix_url")
    return issue_ids(index).join(fixed_issues, "url").select(
        "id", F.col("url").alias("issue"), "fix_url"
    )
