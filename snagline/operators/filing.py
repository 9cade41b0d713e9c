"""From classified clusters to a plan: re-run guard, labels, text, manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snagline import fixed
from snagline.operators.clusters import cluster_members
from snagline.session import cut_lineage


def first_write_per_id(writes: DataFrame) -> DataFrame:
    """(id, url): the first manifest by date wins, filed before consolidated."""
    return writes.groupBy("id").agg(
        F.min_by("url", F.struct("run_date", "section", "entry", "place")).alias("url")
    )


def _written(enriched: DataFrame, writes: DataFrame) -> DataFrame:
    """(cluster, class, issue, id, url): members of clusters to write, with where they went before."""
    todo = enriched.filter(F.col("class").isin("file", "consolidate"))
    return todo.select("cluster", "class", "issue", F.explode("members").alias("id")).join(
        first_write_per_id(writes), "id", "left"
    )


def rerun_guard(enriched: DataFrame, writes: DataFrame) -> DataFrame:
    """`skip`: why an earlier run makes a cluster's write unnecessary, or null.

    `guard_urls` holds every place that the reason speaks of.
    """
    hit = F.col("url").isNotNull()
    elsewhere = F.when(F.col("url") != F.col("issue"), F.col("url"))
    per = (
        _written(enriched, writes).groupBy("cluster", "class", "issue")
        .agg(F.count(F.lit(1)).alias("n_members"), F.count_if(hit).alias("n_hits"), F.count(elsewhere).alias("n_elsewhere"))
    )
    whole = F.col("n_hits") == F.col("n_members")
    consolidate = F.col("class") == "consolidate"
    skip = (
        F.when(consolidate & (F.col("n_elsewhere") > 0), "filed elsewhere")
        .when(consolidate & whole, "already consolidated")
        .when(consolidate, None)
        .when(F.col("n_hits") == 0, None)
        .when(whole, "already filed")
        .otherwise("partly filed")
    )
    return per.select("cluster", "class", "n_hits", "n_members", skip.alias("skip"))


def guard_urls(enriched: DataFrame, writes: DataFrame) -> DataFrame:
    """(cluster, skip, url): every place an earlier run put a skipped cluster's ids.

    A cluster filed elsewhere leaves out the issue it belongs to.
    """
    skipped = rerun_guard(enriched, writes).filter(F.col("skip").isNotNull()).select("cluster", "skip")
    own = (F.col("skip") == "filed elsewhere") & (F.col("url") == F.col("issue"))
    hits = _written(enriched, writes).filter(F.col("url").isNotNull())
    return hits.join(skipped, "cluster").filter(~F.coalesce(own, F.lit(False))).select("cluster", "skip", "url").distinct()


def fix_now() -> Column:
    """Little work, and sure to help."""
    return (F.col("effort") == "low") & (F.col("confidence") == "high")


def _label_array() -> Column:
    base = F.array(F.lit(fixed.BASE_LABEL), F.concat(F.lit("priority:"), F.col("severity")))
    now = F.when(fix_now(), F.array(F.lit(fixed.FIX_NOW_LABEL))).otherwise(
        F.array().cast("array<string>")
    )
    return F.concat(base, now)


def cluster_labels(filed: DataFrame) -> DataFrame:
    """The labels of one cluster's own issue; `filed` carries `owner_labels`."""
    return filed.withColumn("labels", F.array_distinct(F.concat(_label_array(), "owner_labels")))


def label_union(filed: DataFrame) -> DataFrame:
    """(repo, label, rank): every label this run will write in a repository.

    One row per distinct label; ranks order them as one list would.
    """
    owner = F.transform(
        "owner_labels",
        lambda x, i: F.struct(x.alias("label"), (F.col("cluster") * (1 << 20) + 10 + i).cast("bigint").alias("rank")),
    )
    fixed_rank = {fixed.BASE_LABEL: 0, **{p: n + 1 for n, p in enumerate(fixed.PRIORITY_LABELS)}, fixed.FIX_NOW_LABEL: 4}
    rank_map = F.create_map(*[F.lit(x) for kv in fixed_rank.items() for x in kv])
    own = F.transform(
        _label_array(),
        lambda x: F.struct(x.alias("label"), rank_map[x].cast("bigint").alias("rank")),
    )
    return (
        filed.select("repo", F.explode(F.concat(own, owner)).alias("l"))
        .groupBy("repo", F.col("l.label").alias("label"))
        .agg(F.min("l.rank").alias("rank"))
    )


def label_preflight(needed: DataFrame, existing: DataFrame) -> DataFrame:
    """(repo, label, rank, problem, have): labels a repository lacks.

    A label it has in another case is a mismatch, never missing.
    """
    have = existing.select("repo", F.col("name").alias("label")).distinct()
    absent = needed.join(have, ["repo", "label"], "left_anti").withColumn("_fold", F.lower("label"))
    folded = existing.groupBy("repo", F.lower("name").alias("_fold")).agg(F.max("name").alias("have"))
    return absent.join(folded, ["repo", "_fold"], "left").select(
        "repo", "label", "rank",
        F.when(F.col("have").isNull(), "missing").otherwise("case mismatch").alias("problem"), "have",
    )


def held_repos(problems: DataFrame) -> DataFrame:
    """(repo, held_labels): what each repository lacks, missing labels first; as many as the run's labels."""
    spot = F.struct((F.col("problem") != "missing").alias("late"), "rank", "label")
    return problems.groupBy("repo").agg(
        F.transform(F.array_sort(F.collect_list(spot)), lambda x: x["label"]).alias("held_labels")
    )


def file_plan(
    enriched: DataFrame, repos: DataFrame, writes: DataFrame, existing: DataFrame
) -> DataFrame:
    """Every cluster with what this run does about it: as many rows as clusters given.

    action: file, held, consolidate, skip, noop, or error with the reason in
    `problem`; see `checked_plan`.  A held cluster carries its repository's missing
    labels in `held_labels`.  The clusters are read three times, so they are written
    out once.
    """
    enriched = cut_lineage(enriched)
    guard = rerun_guard(enriched, writes).select("cluster", "skip")
    placed = (
        enriched.join(repos.select("target", "repo", "owner_labels", "kind"), "target", "left")
        .join(guard, "cluster", "left")
        .withColumn(
            "problem",
            F.when(F.col("repo").isNull(), "unknown target").when(F.col("class") == "error", "more than one open issue"),
        )
        .withColumn("owner_labels", F.coalesce("owner_labels", F.array().cast("array<string>")))
    )
    sound = F.col("problem").isNull()
    to_file = placed.filter(sound & (F.col("class") == "file") & F.col("skip").isNull())
    held = held_repos(label_preflight(label_union(to_file), existing))
    action = (
        F.when(~sound, "error")
        .when(F.col("class") == "noop", "noop")
        .when(F.col("skip").isNotNull(), "skip")
        .when(F.col("class") == "consolidate", "consolidate")
        .when(F.col("held_labels").isNotNull(), "held")
        .otherwise("file")
    )
    plan = placed.join(held, "repo", "left").withColumn("action", action)
    return cluster_labels(plan.withColumn("held_labels", F.when(F.col("action") == "held", F.col("held_labels"))))


class InvalidPlan(ValueError):
    """A plan with a cluster that cannot be placed is not carried out."""


def checked_plan(plan: DataFrame) -> DataFrame:
    """`plan` unchanged, or an error naming the first cluster that cannot be placed."""
    bad = plan.filter(F.col("action") == "error").orderBy("cluster").first()
    if bad is not None:
        raise InvalidPlan(f"cluster {bad.cluster}: {bad.problem} ({bad.target!r})")
    return plan


def plan_counts(plan: DataFrame) -> DataFrame:
    """Clusters per action, and per repository where they are held."""
    repo = F.when(F.col("action") == "held", F.col("repo")).otherwise("")
    return plan.groupBy("action", repo.alias("repo")).agg(F.count(F.lit(1)).alias("n_clusters"))


def member_rows(clusters: DataFrame, open_set: DataFrame) -> DataFrame:
    """(cluster, place, id, title, suggested_fix) in member order."""
    return cluster_members(clusters).join(
        open_set.select("id", "title", "suggested_fix"), "id", "left"
    )


def _bullet() -> Column:
    title = F.coalesce(F.col("title"), F.lit(""))
    return F.when(title == "", F.concat(F.lit("- "), F.col("id"))).otherwise(
        F.concat(F.lit("- "), F.col("id"), F.lit(" — "), title)
    )


def _member_text(clusters: DataFrame, open_set: DataFrame) -> DataFrame:
    """Bullets and fixes per cluster; as long as the member array it came with."""
    fix = F.when(F.coalesce("suggested_fix", F.lit("")) != "", F.col("suggested_fix"))
    return (
        member_rows(clusters, open_set)
        .groupBy("cluster")
        .agg(F.array_sort(F.collect_list(F.struct("place", _bullet().alias("bullet"), fix.alias("fix")))).alias("m"))
        .select(
            "cluster",
            F.array_join(F.transform("m", lambda r: r["bullet"]), "\n").alias("bullets"),
            F.array_join(F.transform("m", lambda r: r["fix"]), " ").alias("fixes"),
        )
    )


def render_body(placed: DataFrame, open_set: DataFrame) -> DataFrame:
    """(cluster, title, body): the text of the issue to file.

    `placed` carries cluster, improvement, members, target, kind, repo, severity,
    effort and confidence.
    """
    shown = F.when(F.col("kind") == "external", F.concat("target", F.lit(" (external)"))).otherwise(
        F.col("target")
    )
    body = F.concat(
        F.concat_ws(
            "\n",
            F.col("improvement"), F.lit(""),
            F.concat(F.lit("Target: "), shown),
            F.concat(F.lit("Repo: "), F.col("repo")),
            F.concat(
                F.lit("Severity: "), "severity", F.lit(" · Effort: "), "effort",
                F.lit(" · Confidence: "), "confidence",
            ),
            F.lit(""), F.lit(fixed.MEMBERS_HEADING), F.col("bullets"),
            F.when(F.col("fixes") != "", F.concat(F.lit("\nSuggested fix: "), "fixes")),
        ),
        F.lit("\n"),
    )
    return placed.join(_member_text(placed, open_set), "cluster").select(
        "cluster", F.col("improvement").alias("title"), body.alias("body")
    )


def render_comment(clusters: DataFrame, open_set: DataFrame) -> DataFrame:
    """(cluster, body): the comment that adds a cluster to an open issue."""
    return _member_text(clusters, open_set).select(
        "cluster",
        F.concat(F.lit(fixed.COMMENT_HEADING + "\n\n"), "bullets", F.lit("\n")).alias("body"),
    )


MANIFEST = (
    "run_date string, section string, cluster bigint, members array<string>, target string, repo string, "
    "title string, labels array<string>, url string, issue string, id string, fix_url string, reason string, "
    "state_reason string, closer string, note string"
)


def _entries(rows: DataFrame, run_date: str, section: Column, **columns: Column) -> DataFrame:
    """Manifest rows: the named columns, null for the others."""
    have = {"run_date": F.lit(run_date), "section": section, **columns}
    kinds = dict(c.split(" ", 1) for c in MANIFEST.split(", "))
    return rows.select(*[have.get(n, F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])


#: What each job owns in a manifest, and whether a run of the same date adds to it.
FILING_SECTIONS = {"filed": True, "consolidated": True, "held": False, "noop": False}
CLOSING_SECTIONS = {"resolved": True, "skipped": False, "closed_without_evidence": False, "flush": False}


def manifest_of(plan: DataFrame, run_date: str, urls: DataFrame | None = None) -> DataFrame:
    """The filing job's entries, one row each.

    A manifest is stored as rows, partitioned by run date; a run of any size is
    then written by many tasks.  `urls`: cluster, url of the issues created.  Skipped
    clusters leave no entry; held ones name the labels their repository lacks.
    """
    sections = {"file": "filed", "consolidate": "consolidated", "held": "held", "noop": "noop"}
    rows = checked_plan(plan).filter(F.col("action").isin(*sections))
    rows = rows.join(urls, "cluster", "left") if urls is not None else rows.withColumn("url", F.lit(None).cast("string"))
    section = F.create_map(*[F.lit(x) for kv in sections.items() for x in kv])[F.col("action")]
    filed, held, noop = (F.col("action") == a for a in ("file", "held", "noop"))
    return _entries(
        rows, run_date, section, cluster=F.col("cluster"), members=F.when(~noop, F.col("members")),
        target=F.when(~noop, F.col("target")), repo=F.when(~noop, F.col("repo")),
        title=F.when(filed | held, F.col("improvement")),
        labels=F.when(filed, F.col("labels")).when(held, F.col("held_labels")),
        url=F.when(filed, F.coalesce("url", F.lit(""))), issue=F.when(F.col("action") == "consolidate", F.col("issue")),
    )


def closing_manifest(
    planned: DataFrame, resolved_ids: DataFrame, evidence: DataFrame, run_date: str, flush: DataFrame
) -> DataFrame:
    """The closing job's entries, one row each.

    `planned`: id, issue, fix_url (`tracking.resolutions_planned`); an id in
    `resolved_ids` was resolved before and is skipped.  `evidence`
    (`tracking.closer_evidence`) names the issues closed without a merged pull
    request.  `flush`: note, the last line of the flush.
    """
    known = resolved_ids.select("id").distinct()
    link = {"id": F.col("id"), "issue": F.col("issue")}
    parts = [
        _entries(planned.join(known, "id", "left_anti"), run_date, F.lit("resolved"), **link, fix_url=F.col("fix_url")),
        _entries(planned.join(known, "id", "left_semi"), run_date, F.lit("skipped"), **link, reason=F.lit("already resolved")),
        _entries(
            evidence.filter(F.col("outcome") == "no-evidence"), run_date, F.lit("closed_without_evidence"),
            url=F.col("url"), state_reason=F.col("state_reason"), closer=F.col("closer_type"),
        ),
        _entries(flush, run_date, F.lit("flush"), note=F.col("note")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


class InvalidManifest(ValueError):
    """A manifest that readers could not use is not written."""


def manifest_errors(rows: DataFrame) -> DataFrame:
    """(run_date, section, cluster, error): entries that miss what their section needs."""
    section = F.col("section")
    links = F.coalesce(F.col("issue").rlike(r"\Ahttps?://\S+\z"), F.lit(False))
    tests = [
        (~section.isin(*FILING_SECTIONS, *CLOSING_SECTIONS), "section"),
        (~F.col("run_date").rlike(rf"\A{fixed.RUN_DATE_PATTERN}\z"), "run_date"),
        (section.isin("filed", "consolidated", "held") & (F.size("members") < 1), "members"),
        (section.isin("filed", "consolidated", "held") & (F.col("target").isNull() | F.col("repo").isNull()), "target"),
        (section.isin("filed", "held") & F.col("title").isNull(), "title"),
        ((section == "held") & F.col("labels").isNull(), "labels"),
        (section.isin("resolved", "skipped") & (F.col("id").isNull() | F.col("issue").isNull()), "id"),
        ((section == "closed_without_evidence") & F.col("url").isNull(), "url"),
        ((section == "filed") & (F.col("labels").isNull() | F.col("url").isNull()), "labels"),
        ((section == "consolidated") & ~links, "issue"),
    ]
    found = F.split(F.concat_ws(",", *[F.when(t, F.lit(name)) for t, name in tests]), ",")
    return rows.select("run_date", "section", "cluster", F.explode(found).alias("error")).filter("error <> ''")


def checked_manifest(rows: DataFrame) -> DataFrame:
    """`rows` unchanged, or an error naming the first bad entry."""
    bad = manifest_errors(rows).orderBy("run_date", "section", "cluster").first()
    if bad is not None:
        raise InvalidManifest(f"{bad.run_date} {bad.section} cluster {bad.cluster}: {bad.error}")
    return rows


def merge_manifest(old: DataFrame, new: DataFrame, run_date: str, sections: dict[str, bool]) -> DataFrame:
    """A re-run of one job on one date: what it adds to grows, what it replaces is cleared, the rest stays.

    `sections` are those of the job (`FILING_SECTIONS`, `CLOSING_SECTIONS`).  A run
    without entries clears them all the same; other dates and jobs are not touched.
    """
    replaced = [name for name, grows in sections.items() if not grows]
    stale = (F.col("run_date") == run_date) & F.col("section").isin(replaced)
    return old.filter(~stale).unionByName(new)


def write_manifest(merged: DataFrame, path: str) -> None:
    """Replace the run dates the frame holds; `merged` must not read `path` lazily."""
    (
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_date").parquet(path)
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(path)


def run_summary(manifest: DataFrame) -> DataFrame:
    """Counts per run date and the one-line summary."""
    def n(section: str) -> Column:
        return F.count_if(F.col("section") == section)

    counted = manifest.groupBy("run_date").agg(
        n("filed").alias("filed"), n("consolidated").alias("consolidated"), n("held").alias("held"),
        n("resolved").alias("resolved"), n("noop").alias("noop"),
        F.count_if((F.col("section") == "filed") & (F.col("target") == fixed.UNOWNED)).alias("unowned"),
        F.count_distinct(F.when(F.col("section") == "filed", F.col("repo"))).alias("repos"),
    )
    line = F.format_string(
        "%s: %d filed (%d owners), %d consolidated, %d held (labels), %d resolved, %d unowned.",
        "run_date", "filed", "repos", "consolidated", "held", "resolved", "unowned",
    )
    return counted.withColumn("summary", line)
