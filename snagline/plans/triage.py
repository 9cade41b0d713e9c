"""Queries from issue listings to the filing plan."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from snagline import fixed
from snagline.functions import rules as Q
from snagline.functions import text as T
from snagline.operators import clusters as C
from snagline.operators import filing as L
from snagline.operators import ordered
from snagline.operators import registry as G
from snagline.operators import tracking as K
from snagline.plans import views as vw
from snagline.plans.catalog import query
from snagline.session import cut_lineage, scratch_path
from snagline.sources import triage as src


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


_TRACKED = (vw.OPEN_PARTS, vw.ISSUES, vw.ISSUE_TEXTS, vw.INDEX)
_CLUSTERED = (*_TRACKED, vw.CLUSTERS, vw.ENRICHED)


# --- sources --------------------------------------------------------------------
#: Comments that a listing page holds of each issue; few, so that the full list has work to do.
COMMENTS_PER_ISSUE = 2


def _stored_pages(spark, d, short=False):
    """Listing pages of at most a hundred issues, written out and read back.

    An issue has its whole body and its first comments; what a page can hold bounds both.
    """
    spot = F.struct("line", "text")
    listed = lambda source: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("source") == source, spot))), lambda x: x["text"]
    )
    texts = vw.issue_texts(spark, d).groupBy("repo", "number").agg(
        F.count_if(F.col("source") == "comment").alias("n_comments"),
        F.array_join(listed("body"), "\n").alias("body"),
        F.slice(listed("comment"), 1, COMMENTS_PER_ISSUE).alias("comments"),
    )
    issues = vw.issues(spark, d).join(texts, ["repo", "number"], "left")
    node = F.struct(
        "number", "state", F.col("state_reason").alias("stateReason"), "url",
        F.concat(F.lit("issue "), vw.string(F.col("number"))).alias("title"), "body",
        F.struct(F.transform("labels", lambda x: F.struct(x.alias("name"))).alias("nodes")).alias("labels"),
        F.struct(
            F.coalesce("n_comments", F.lit(0)).alias("totalCount"),
            F.coalesce(
                F.transform("comments", lambda x: F.struct(x.alias("body"))), F.array().cast("array<struct<body:string>>")
            ).alias("nodes"),
        ).alias("comments"),
    )
    declared = issues.groupBy("repo").agg(F.count(F.lit(1)).alias("declared"))
    if short:
        declared = declared.withColumn(
            "declared", F.col("declared") + F.when(F.col("repo").endswith("7"), 1).otherwise(0)
        )
    pages = (
        ordered.rank_in_group(issues, ["repo"], ["number"], ordered.chunk_of(F.col("number")), "_n")
        .withColumn("page", F.floor((F.col("_n") - 1) / 100))
        .groupBy("repo", "page").agg(F.array_sort(F.collect_list(node)).alias("nodes"))
        .join(declared, "repo")
    )
    listing = F.struct(F.col("declared").alias("totalCount"), "nodes")
    doc = F.to_json(F.struct("repo", F.struct(F.struct(listing.alias("issues")).alias("repository")).alias("data")))
    path = scratch_path(spark, "pages")
    pages.select(doc.alias("value")).write.text(path)
    return src.scan_issues(src.scan_pages(spark, path))


_LISTED = f"""listed AS (
  SELECT i.*, body, coalesce(n_comments, 0) AS comments_total, coalesce(array_to_string(texts[:{COMMENTS_PER_ISSUE}], chr(10)), '') AS comments
  FROM issues i LEFT JOIN (
    SELECT repo, number, count(*) FILTER (WHERE source = 'comment') AS n_comments,
      string_agg(text, chr(10) ORDER BY line, text) FILTER (WHERE source = 'body') AS body,
      list(text ORDER BY line, text) FILTER (WHERE source = 'comment') AS texts FROM issue_texts GROUP BY 1, 2) c
  ON c.repo = i.repo AND c.number = i.number)"""


@query(
    "scan_issues",
    _with(vw.ISSUES, vw.ISSUE_TEXTS, _LISTED)
    + "SELECT repo, number, state, state_reason, url, array_to_string(labels, ',') AS labels, CAST(comments_total AS BIGINT) AS comments_total, "
    "coalesce(body, '') AS body, comments FROM listed",
)
def scan_issues(spark, d):
    return _stored_pages(spark, d).select(
        "repo", "number", "state", "state_reason", "url", F.array_join("labels", ",").alias("labels"),
        "comments_total", F.coalesce("body", F.lit("")).alias("body"), F.array_join("comments", "\n").alias("comments"),
    )


@query(
    "scan_full_comments",
    _with(vw.ISSUES, vw.ISSUE_TEXTS)
    + "SELECT repo, number, 'comment' AS source, text FROM issue_texts WHERE source = 'comment' UNION ALL "
    "SELECT repo, number, 'body', string_agg(text, chr(10) ORDER BY line, text) FROM issue_texts WHERE source = 'body' GROUP BY 1, 2",
)
def scan_full_comments(spark, d):
    """The full list stands in for the comments of issues that have more than a page holds."""
    full = vw.issue_texts(spark, d).filter(F.col("source") == "comment").select("repo", "number", "text")
    return src.issue_texts(_stored_pages(spark, d), full).filter((F.col("source") == "comment") | (F.col("text") != ""))


@query(
    "completeness_check",
    _with(vw.ISSUES)
    + "SELECT repo, count(*) AS n_rows, count(*) + 1 AS declared FROM issues WHERE repo LIKE '%7' GROUP BY 1",
)
def completeness_check(spark, d):
    return src.incomplete_repos(_stored_pages(spark, d, short=True))


_REG_FLAT = "name, kind, tracker, repo, scope, array_to_string(labels, ',') AS labels"


@query("scan_registry", _with(vw.REGISTRY) + f"SELECT {_REG_FLAT} FROM registry")
def scan_registry(spark, d):
    path = scratch_path(spark, "registry")
    vw.registry(spark, d).write.json(path)
    return src.scan_registry(spark, path).withColumn("labels", F.array_join("labels", ","))


def _cluster_docs(spark, d):
    """Clusters as array documents of at most 32 elements, some of them faulty."""
    c = F.col("cluster")
    element = F.when(c % 9 == 4, F.lit("5")).otherwise(
        F.concat(
            F.lit('{"improvement":'), F.when(c % 9 == 1, F.lit("7")).otherwise(F.to_json(F.col("improvement").cast("variant"))),
            F.when(c % 9 == 2, F.lit("")).otherwise(F.concat(F.lit(',"target":'), F.to_json(F.col("target").cast("variant")))),
            F.lit(f',"effort":"low","confidence":"high","{fixed.MEMBERS_KEY}":'),
            F.when(c % 9 == 3, F.lit("[]")).when(c % 9 == 5, F.lit('["a",1]')).otherwise(F.to_json("members")),
            F.when(c % 9 == 6, F.lit(',"zeal":1}')).otherwise(F.lit("}")),
        )
    )
    return (
        vw.clusters(spark, d).select((F.floor(c / 32)).alias("doc"), c.alias("n"), element.alias("e"))
        .groupBy("doc")
        .agg(F.array_sort(F.collect_list(F.struct("n", "e"))).alias("m"))
        .select("doc", F.concat(F.lit("["), F.array_join(F.transform("m", lambda r: r["e"]), ","), F.lit("]")).alias("value"))
    )


_DOC = """elements AS (
  SELECT cluster // 32 AS doc, cluster AS n, row_number() OVER (PARTITION BY cluster // 32 ORDER BY cluster) - 1 AS cluster,
    improvement, target, members FROM clusters)"""


@query(
    "scan_clusters",
    _with(vw.OPEN_PARTS, vw.CLUSTERS, _DOC)
    + "SELECT doc, cluster, CASE WHEN n % 9 IN (1, 4) THEN NULL ELSE improvement END AS improvement, "
    "CASE WHEN n % 9 IN (2, 4) THEN NULL ELSE target END AS target, "
    "CASE WHEN n % 9 = 4 THEN NULL WHEN n % 9 = 3 THEN '' WHEN n % 9 = 5 THEN 'a,1' ELSE array_to_string(members, ',') END AS members FROM elements",
)
def scan_clusters(spark, d):
    found = src.scan_clusters(_cluster_docs(spark, d), keep=["doc"])
    return found.select("doc", "cluster", "improvement", "target", F.array_join("members", ",").alias("members"))


@query(
    "validate_nested",
    _with(vw.OPEN_PARTS, vw.CLUSTERS, _DOC)
    + f"""SELECT doc, '[' || cluster || ']' || CASE n % 9 WHEN 1 THEN '.improvement: expected string'
      WHEN 2 THEN ': missing required property: target' WHEN 3 THEN '.{fixed.MEMBERS_KEY}: fewer than minItems 1'
      WHEN 4 THEN ': expected object' WHEN 5 THEN '.{fixed.MEMBERS_KEY}[1]: expected string'
      WHEN 6 THEN ': unexpected property: zeal' END AS error FROM elements WHERE n % 9 BETWEEN 1 AND 6""",
)
def validate_nested(spark, d):
    """Errors name the failing place."""
    return src.scan_clusters(_cluster_docs(spark, d), keep=["doc"]).select("doc", F.explode("errors").alias("error"))


def _consolidation_rows(spark, d):
    """Every third `file` cluster restated by an open issue of its repository."""
    en = cut_lineage(vw.enriched(spark, d).select("cluster", "members", "target", "class", "issue", "severity", "effort", "confidence", "improvement"))
    repos = G.target_repos(vw.registry(spark, d))
    candidates = C.issue_candidates(en, repos, vw.issues(spark, d))
    first = candidates.groupBy("repo").agg(F.min("url").alias("first_issue"))
    return en, repos, candidates, first


@query(
    "scan_consolidations",
    "SELECT o_orderkey // 64 AS doc, row_number() OVER (PARTITION BY o_orderkey // 64 ORDER BY o_orderkey) - 1 AS entry, "
    "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderkey END AS cluster, 'https://t.example/' || o_orderkey AS issue, "
    "CASE WHEN o_orderstatus = 'P' THEN '[' || (row_number() OVER (PARTITION BY o_orderkey // 64 ORDER BY o_orderkey) - 1) || '].cluster: expected integer' ELSE '' END AS errors FROM orders",
)
def scan_consolidations(spark, d):
    o = vw.table(spark, d, "orders")
    n = vw.string(F.col("o_orderkey"))
    element = F.concat(
        F.lit('{"cluster":'), F.when(F.col("o_orderstatus") == "P", "true").otherwise(n),
        F.lit(',"issue":"https://t.example/'), n, F.lit('"}'),
    )
    docs = (
        o.select(F.floor(F.col("o_orderkey") / 64).alias("doc"), F.col("o_orderkey").alias("n"), element.alias("e"))
        .groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("n", "e"))).alias("m"))
        .select("doc", F.concat(F.lit("["), F.array_join(F.transform("m", lambda r: r["e"]), ","), F.lit("]")).alias("value"))
    )
    return src.scan_consolidations(docs, keep=["doc"]).withColumn("errors", F.array_join("errors", ","))


@query(
    "scan_manifests",
    _with(vw.OPEN_PARTS, vw.CLUSTERS)
    + """SELECT run_date, CAST(section AS INTEGER) AS section, CAST(entry AS INTEGER) AS entry, CAST(place AS INTEGER) AS place, id, url FROM (
      SELECT strftime(DATE '2024-01-01' + CAST(cluster // 16 AS INTEGER), '%Y-%m-%d') AS run_date, cluster % 3 = 0 AS section,
        row_number() OVER (PARTITION BY cluster // 16, cluster % 3 = 0 ORDER BY cluster) - 1 AS entry,
        'https://t.example/' || cluster AS url, unnest(members) AS id, unnest(range(len(members))) AS place FROM clusters)""",
)
def scan_manifests(spark, d):
    """One file per date, beside files of other names; every id that was ever written out."""
    c = F.col("cluster")
    date = vw.string(F.date_add(F.lit("2024-01-01").cast("date"), F.floor(c / 16).cast("int")))
    link = F.concat(F.lit("https://t.example/"), vw.string(c))
    entry = lambda name: F.struct(c, F.col("members").alias(fixed.MEMBERS_KEY), link.alias(name))
    kept = lambda name, when: F.array_sort(F.collect_list(F.when(when, entry(name)))).alias("filed" if name == "url" else "consolidated")
    docs = vw.clusters(spark, d).groupBy(date.alias("run_date")).agg(kept("url", c % 3 != 0), kept("issue", c % 3 == 0))
    value = F.to_json(F.struct("run_date", "filed", "consolidated")).alias("value")
    path, place = scratch_path(spark, "manifests"), F.lit(0).alias("place")
    rows = docs.select(F.concat("run_date", F.lit(".json")).alias("file"), place, value).unionByName(
        docs.select(F.concat("run_date", F.lit(".json.bak")).alias("file"), place, value)
    )
    vw.named_files(rows.unionByName(spark.range(1).select(F.lit("notes.json").alias("file"), place, F.lit("[1").alias("value"))), path)
    return src.prior_writes_of(src.scan_manifests(spark, path))


# --- registry ---------------------------------------------------------------------
@query(
    "registry_checks",
    _with(vw.REGISTRY)
    + """, bad AS (
      SELECT name, kind, tracker, repo, scope FROM registry
      UNION ALL SELECT CASE WHEN name LIKE '%1' THEN upper(name) ELSE name END, 'owner', 'mail', repo, scope FROM registry WHERE kind = 'external'
      UNION ALL SELECT name || '-b', 'external', tracker, 'no slash', '' FROM registry WHERE name LIKE '%7'),
    bad_labels AS (SELECT name || '-b' AS name FROM registry WHERE name LIKE '%7' AND labels IS NOT NULL)
    SELECT name, 'invalid name' AS error FROM bad WHERE kind <> 'unowned' AND NOT regexp_full_match(name, '[a-z0-9][a-z0-9._-]*')
    UNION ALL SELECT name, 'unsupported tracker' FROM bad WHERE kind = 'owner' AND tracker = 'mail'
    UNION ALL SELECT name, 'scope missing' FROM bad WHERE scope = ''
    UNION ALL SELECT name, 'invalid repo' FROM bad WHERE repo = 'no slash'
    UNION ALL SELECT name, 'tracker not allowed' FROM bad WHERE kind = 'external' AND tracker IS NOT NULL
    UNION ALL SELECT name, 'labels not allowed' FROM bad_labels
    UNION ALL SELECT DISTINCT a.name, 'name in both sections' FROM bad a JOIN bad b ON a.name = b.name AND a.kind = 'owner' AND b.kind = 'external'""",
)
def registry_checks(spark, d):
    return G.registry_checks(vw.bad_registry(spark, d))


@query(
    "registry_overlap",
    _with(vw.REGISTRY) + "SELECT name FROM registry WHERE kind = 'external' AND name NOT LIKE '%1'",
)
def registry_overlap(spark, d):
    return G.registry_overlap(vw.bad_registry(spark, d))


@query("target_vocabulary", _with(vw.REGISTRY) + "SELECT DISTINCT name FROM registry")
def target_vocabulary(spark, d):
    return G.target_vocabulary(vw.registry(spark, d))


@query(
    "registered_repos", _with(vw.REGISTRY) + "SELECT DISTINCT repo FROM registry WHERE kind IN ('owner', 'unowned')"
)
def registered_repos(spark, d):
    return G.registered_repos(vw.registry(spark, d))


_BASE = repr([fixed.BASE_LABEL, *fixed.PRIORITY_LABELS, fixed.FIX_NOW_LABEL])


@query(
    "required_labels",
    _with(vw.REGISTRY, vw.TARGETS)
    + f"SELECT target, repo, array_to_string(list_concat({_BASE}, list_filter(owner_labels, lambda x: NOT list_contains({_BASE}, x))), ',') AS labels "
    "FROM targets WHERE kind IN ('owner', 'unowned')",
)
def required_labels(spark, d):
    return G.required_labels(vw.registry(spark, d)).withColumn("labels", F.array_join("labels", ","))


# --- tracking -----------------------------------------------------------------------
@query("prefix_owner", _with(vw.OPEN_PARTS) + "SELECT substr(id, 1, 11) AS prefix, arg_max(id, pos) AS full_id FROM open_set GROUP BY 1")
def prefix_owner(spark, d):
    return K.prefix_owner(vw.open_parts(spark, d), "pos")


_INDEX_COLS = "prefix, repo, number, url, state, state_reason, labels[1] AS label, full_id, source"


@query("tracked_index", _with(*_TRACKED) + f"SELECT {_INDEX_COLS} FROM tracked")
def tracked_index(spark, d):
    return vw.index(spark, d).withColumn("label", F.col("labels")[0]).drop("labels")


@query(
    "index_order",
    _with(*_TRACKED)
    + "SELECT prefix, repo, number, row_number() OVER (ORDER BY prefix, repo, number) AS position FROM tracked",
)
def index_order(spark, d):
    rows = vw.index(spark, d).select("prefix", "repo", "number")
    return ordered.with_position(rows, ["prefix", "repo", "number"])


@query(
    "prefix_intersect",
    _with(*_TRACKED) + "SELECT DISTINCT prefix FROM mentions JOIN owners USING (prefix)",
)
def prefix_intersect(spark, d):
    owners = K.prefix_owner(vw.open_parts(spark, d), "pos")
    return K.prefix_intersect(vw.issue_texts(spark, d), owners)


@query(
    "comment_minus_body",
    _with(*_TRACKED)
    + "SELECT DISTINCT repo, number, prefix FROM mentions m WHERE source = 'comment' AND NOT EXISTS ("
    "SELECT 1 FROM mentions b WHERE b.repo = m.repo AND b.number = m.number AND b.prefix = m.prefix AND b.source = 'body')",
)
def comment_minus_body(spark, d):
    return K.comment_minus_body(vw.issue_texts(spark, d))


@query(
    "issue_ids",
    _with(*_TRACKED)
    + "SELECT *, row_number() OVER (PARTITION BY url ORDER BY id) - 1 AS place FROM "
    "(SELECT DISTINCT url, repo, number, state, state_reason, full_id AS id FROM tracked)",
)
def issue_ids(spark, d):
    return K.ids_per_issue(vw.index(spark, d))


_COVER = """open_ids AS (SELECT DISTINCT full_id FROM tracked WHERE state = 'OPEN'),
coverage AS (
  SELECT t.url, t.repo, t.number, t.state_reason, bool_and(o.full_id IS NOT NULL) AS rerouted
  FROM tracked t LEFT JOIN open_ids o USING (full_id) WHERE t.state = 'CLOSED' GROUP BY 1, 2, 3, 4)"""


@query("rerouted", _with(*_TRACKED, _COVER) + "SELECT url, repo, number, state_reason FROM coverage WHERE rerouted")
def rerouted(spark, d):
    return K.rerouted(vw.index(spark, d))


@query(
    "closed_order",
    _with(*_TRACKED, _COVER) + "SELECT repo, number, row_number() OVER (ORDER BY repo, number) AS position FROM coverage",
)
def closed_order(spark, d):
    return ordered.with_position(K.closed_coverage(vw.index(spark, d)).select("repo", "number"), ["repo", "number"])


@query("last_close_event", _with(vw.CLOSE_EVENTS) + "SELECT repo, number, type FROM closers")
def last_close_event(spark, d):
    return K.last_close_event(vw.close_events(spark, d)).select("repo", "number", F.col("closer.type").alias("type"))


@query(
    "closer_evidence",
    _with(*_TRACKED, _COVER, vw.CLOSE_EVENTS)
    + "SELECT v.repo, v.number, v.url, v.state_reason, CASE WHEN c.merged THEN 'resolve' ELSE 'no-evidence' END AS outcome, "
    "CASE WHEN c.merged THEN c.url END AS fix_url, c.type AS closer_type FROM coverage v JOIN closers c USING (repo, number) WHERE NOT v.rerouted",
)
def closer_evidence(spark, d):
    return K.closer_evidence(vw.index(spark, d), vw.close_events(spark, d))


@query(
    "resolutions_planned",
    _with(*_TRACKED, _COVER, vw.CLOSE_EVENTS)
    + "SELECT DISTINCT t.full_id AS id, v.url AS issue, c.url AS fix_url FROM coverage v JOIN closers c USING (repo, number) "
    "JOIN tracked t ON t.url = v.url WHERE NOT v.rerouted AND c.merged",
)
def resolutions_planned(spark, d):
    ix = vw.index(spark, d)
    return K.resolutions_planned(ix, K.closer_evidence(ix, vw.close_events(spark, d)))


# --- clusters -------------------------------------------------------------------------
_BAD = (vw.OPEN_PARTS, vw.CLUSTERS, vw.BAD_CLUSTERS, "bad_members AS (SELECT cluster, unnest(members) AS id, unnest(range(len(members))) AS place FROM bad_clusters)")


# Some ids come back in a third cluster as well, so that the second place is not the last.
_SPOTS = """again AS (
  SELECT cluster, id, place FROM bad_members UNION ALL
  SELECT cluster + 2, id, 1000 FROM bad_members WHERE cluster % 7 = 4 AND place = 0 AND cluster + 2 IN (SELECT cluster FROM bad_clusters)),
numbered AS (SELECT cluster, id, row_number() OVER (PARTITION BY cluster ORDER BY place) - 1 AS place FROM again),
spots AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY cluster, place) AS nth, count(*) OVER (PARTITION BY id) AS n FROM numbered)"""


def _bad_clusters(spark, d):
    """The faulty clusters, the first id of some repeated in the cluster after next."""
    bad = vw.bad_clusters(spark, d)
    more = bad.filter(F.col("cluster") % 7 == 4).select((F.col("cluster") + 2).alias("cluster"), F.col("members")[0].alias("_more"))
    rows = bad.join(more, "cluster", "left")
    return rows.withColumn("members", F.when(F.col("_more").isNotNull(), F.array_append("members", F.col("_more"))).otherwise(F.col("members"))).drop("_more")


@query("cluster_unknown_ids", _with(*_BAD) + "SELECT cluster, place, id FROM bad_members WHERE id NOT IN (SELECT id FROM open_set)")
def cluster_unknown_ids(spark, d):
    rows = C.cluster_unknown_ids(vw.bad_clusters(spark, d), vw.open_parts(spark, d))
    return rows.withColumn("place", F.col("place").cast("bigint"))


@query("cluster_unassigned", _with(*_BAD) + "SELECT id FROM open_set WHERE id NOT IN (SELECT id FROM bad_members)")
def cluster_unassigned(spark, d):
    return C.cluster_unassigned(vw.bad_clusters(spark, d), vw.open_parts(spark, d))


@query(
    "target_unknown",
    _with(*_BAD, vw.REGISTRY) + "SELECT cluster, target FROM bad_clusters WHERE target NOT IN (SELECT name FROM registry)",
)
def target_unknown(spark, d):
    return C.target_unknown(vw.bad_clusters(spark, d), G.target_vocabulary(vw.registry(spark, d)))


@query(
    "duplicate_assignment",
    _with(*_BAD, _SPOTS)
    + "SELECT a.id, a.n, a.cluster AS first_cluster, b.cluster AS second_cluster, b.place AS second_place "
    "FROM spots a JOIN spots b ON b.id = a.id AND b.nth = 2 WHERE a.nth = 1",
)
def duplicate_assignment(spark, d):
    rows = C.duplicate_assignment(_bad_clusters(spark, d))
    return rows.withColumn("second_place", F.col("second_place").cast("bigint"))


_VIOLATIONS = """violations AS (
  SELECT CAST(1 AS BIGINT) AS rule, cluster, 0 AS place, improvement AS subject FROM bad_clusters WHERE length(improvement) NOT BETWEEN 1 AND 120
  UNION ALL SELECT 2, cluster, 0, effort FROM bad_clusters WHERE effort NOT IN ('low', 'medium', 'high')
  UNION ALL SELECT 2, cluster, 1, confidence FROM bad_clusters WHERE confidence NOT IN ('low', 'medium', 'high')
  UNION ALL SELECT 3, cluster, 0, target FROM bad_clusters WHERE target NOT IN (SELECT name FROM registry)
  UNION ALL SELECT 4, cluster, place, id FROM bad_members WHERE id NOT IN (SELECT id FROM open_set)
  UNION ALL SELECT 5, cluster, place, id FROM spots WHERE nth = 2
  UNION ALL SELECT 6, NULL, pos, id FROM open_set WHERE id NOT IN (SELECT id FROM bad_members))"""


def _violations(spark, d):
    return C.cluster_violations(
        _bad_clusters(spark, d), vw.open_parts(spark, d), G.target_vocabulary(vw.registry(spark, d))
    )


@query("cluster_violations", _with(*_BAD, _SPOTS, vw.REGISTRY, _VIOLATIONS) + "SELECT rule, cluster, CAST(place AS BIGINT) AS place, subject FROM violations")
def cluster_violations(spark, d):
    return _violations(spark, d)


@query(
    "first_violation",
    _with(*_BAD, _SPOTS, vw.REGISTRY, _VIOLATIONS)
    + "SELECT rule, cluster, CAST(place AS BIGINT) AS place, subject FROM violations ORDER BY rule, cluster, place LIMIT 1",
)
def first_violation(spark, d):
    return C.first_violation(_violations(spark, d))


@query("cluster_severity", _with(*_CLUSTERED) + "SELECT cluster, severity FROM graves")
def cluster_severity(spark, d):
    return C.cluster_severity(vw.clusters(spark, d), vw.open_parts(spark, d))


@query(
    "max_severity_rank",
    "SELECT l_orderkey, CASE min(CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 END) WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity "
    "FROM lineitem GROUP BY 1",
)
def max_severity_rank(spark, d):
    """Each line as a one-member array, then the gravest per order."""
    flag = F.col("l_returnflag")
    word = F.when(flag == "R", "high").when(flag == "A", "medium").otherwise("urgent")
    per_line = vw.table(spark, d, "lineitem").select(
        "l_orderkey", T.max_severity(F.array(word, F.lit(None).cast("string"))).alias("s")
    )
    return per_line.groupBy("l_orderkey").agg(
        T.severity_of_rank(F.min(T.severity_rank(F.col("s")))).alias("severity")
    )


@query(
    "classify_cluster", _with(*_CLUSTERED) + "SELECT cluster, n_tracked, n_members, class, issue FROM classed"
)
def classify_cluster(spark, d):
    return C.classify_cluster(vw.clusters(spark, d), vw.index(spark, d))


@query(
    "conflicting_links",
    _with(*_CLUSTERED)
    + "SELECT DISTINCT m.cluster, t.url FROM members m JOIN classed k ON k.cluster = m.cluster AND k.class = 'error' "
    "JOIN tracked t ON t.prefix = substr(m.id, 1, 11) AND t.state = 'OPEN'",
)
def conflicting_links(spark, d):
    return C.conflicting_links(vw.clusters(spark, d), vw.index(spark, d))


@query(
    "enrich_clusters",
    _with(*_CLUSTERED) + "SELECT cluster, improvement, array_to_string(members, ',') AS members, target, effort, confidence, severity, class, issue FROM enriched",
)
def enrich_clusters(spark, d):
    return vw.enriched(spark, d).withColumn("members", F.array_join("members", ","))


@query(
    "resolve_repo",
    _with(*_BAD, vw.REGISTRY, vw.TARGETS) + "SELECT cluster, b.target, t.repo FROM bad_clusters b LEFT JOIN targets t ON t.target = b.target",
)
def resolve_repo(spark, d):
    placed = C.resolve_repo(vw.bad_clusters(spark, d), G.target_repos(vw.registry(spark, d)))
    return placed.select("cluster", "target", "repo")


_CANDIDATES = """wanted AS (SELECT DISTINCT t.repo FROM enriched e JOIN targets t USING (target) WHERE e.class = 'file'),
candidates AS (SELECT i.* FROM issues i JOIN wanted w USING (repo) WHERE i.state = 'OPEN')"""


@query(
    "issue_candidates",
    _with(*_CLUSTERED, vw.REGISTRY, vw.TARGETS, _CANDIDATES)
    + "SELECT repo, number, url, row_number() OVER (ORDER BY repo, number) AS position FROM candidates",
)
def issue_candidates(spark, d):
    rows = C.issue_candidates(vw.enriched(spark, d), G.target_repos(vw.registry(spark, d)), vw.issues(spark, d))
    return ordered.with_position(rows.select("repo", "number", "url"), ["repo", "number"])


_FIRST_ISSUE = "firsts AS (SELECT repo, min(url) AS first_issue FROM candidates GROUP BY 1)"


@query(
    "apply_consolidations",
    _with(*_CLUSTERED, vw.REGISTRY, vw.TARGETS, _CANDIDATES, _FIRST_ISSUE)
    + "SELECT e.cluster, CASE WHEN e.class = 'file' AND e.cluster % 3 = 0 AND f.first_issue IS NOT NULL THEN 'consolidate' ELSE e.class END AS class, "
    "CASE WHEN e.class = 'file' AND e.cluster % 3 = 0 THEN f.first_issue ELSE e.issue END AS issue "
    "FROM enriched e LEFT JOIN targets t USING (target) LEFT JOIN firsts f USING (repo)",
)
def apply_consolidations(spark, d):
    en, repos, _, first = _consolidation_rows(spark, d)
    todo = C.resolve_repo(en.filter((F.col("class") == "file") & (F.col("cluster") % 3 == 0)), repos)
    consolidations = todo.join(first, "repo").select("cluster", F.col("first_issue").alias("issue"))
    return C.apply_consolidations(en, consolidations).select("cluster", "class", "issue")


@query(
    "consolidation_errors",
    _with(*_CLUSTERED, vw.REGISTRY, vw.TARGETS, _CANDIDATES, _FIRST_ISSUE)
    + """, entries AS (
      SELECT e.cluster, CASE WHEN e.cluster % 4 = 0 THEN f.first_issue ELSE 'https://elsewhere.example/1' END AS issue
      FROM enriched e LEFT JOIN targets t USING (target) LEFT JOIN firsts f USING (repo)
      UNION ALL SELECT cluster + 1000000, 'https://elsewhere.example/1' FROM enriched WHERE cluster % 5 = 0
      UNION ALL SELECT cluster, 'https://elsewhere.example/1' FROM enriched WHERE cluster % 6 = 0),
    seen AS (
      SELECT n.cluster, n.issue, e.class, t.repo FROM entries n LEFT JOIN enriched e ON e.cluster = n.cluster LEFT JOIN targets t ON t.target = e.target)
    SELECT 'out of range' AS rule, cluster FROM seen WHERE class IS NULL
    UNION ALL SELECT 'repeated', cluster FROM entries GROUP BY cluster HAVING count(*) > 1
    UNION ALL SELECT 'not file', cluster FROM seen WHERE class <> 'file'
    UNION ALL SELECT 'not a candidate', cluster FROM seen s WHERE class = 'file'
      AND NOT EXISTS (SELECT 1 FROM candidates c WHERE c.repo = s.repo AND c.url = s.issue)""",
)
def consolidation_errors(spark, d):
    en, repos, candidates, first = _consolidation_rows(spark, d)
    c = F.col("cluster")
    wrong = F.lit("https://elsewhere.example/1")
    placed = C.resolve_repo(en.select("cluster", "target"), repos).join(first, "repo", "left")
    entries = (
        placed.select(c, F.when(c % 4 == 0, F.col("first_issue")).otherwise(wrong).alias("issue"))
        .unionByName(en.filter(c % 5 == 0).select((c + 1000000).alias("cluster"), wrong.alias("issue")))
        .unionByName(en.filter(c % 6 == 0).select(c, wrong.alias("issue")))
    )
    return C.consolidation_errors(entries, en, repos, candidates)


# --- filing ------------------------------------------------------------------------------
_WRITES = """first_writes AS (
  SELECT id, url FROM writes QUALIFY row_number() OVER (PARTITION BY id ORDER BY run_date, section, entry, place) = 1)"""


@query("first_write_per_id", _with(vw.OPEN_PARTS, vw.CLUSTERS, vw.PRIOR_WRITES, _WRITES) + "SELECT id, url FROM first_writes")
def first_write_per_id(spark, d):
    return L.first_write_per_id(vw.prior_writes(spark, d))


_GUARD = """guard AS (
  SELECT e.cluster, e.class, e.issue, count(w.url) AS n_hits, count(*) AS n_members,
    count(CASE WHEN w.url <> e.issue THEN 1 END) AS n_else
  FROM enriched e JOIN placed_members m ON m.cluster = e.cluster LEFT JOIN first_writes w ON w.id = m.id
  WHERE e.class IN ('file', 'consolidate') GROUP BY 1, 2, 3),
guarded AS (
  SELECT cluster, class, n_hits, n_members, CASE WHEN class = 'consolidate' AND n_else > 0 THEN 'filed elsewhere'
    WHEN class = 'consolidate' AND n_hits = n_members THEN 'already consolidated' WHEN class = 'consolidate' OR n_hits = 0 THEN NULL
    WHEN n_hits = n_members THEN 'already filed' ELSE 'partly filed' END AS skip FROM guard)"""
_GUARDED = (*_CLUSTERED, vw.PRIOR_WRITES, _WRITES, _GUARD)


@query("rerun_guard", _with(*_GUARDED) + "SELECT * FROM guarded")
def rerun_guard(spark, d):
    return L.rerun_guard(vw.enriched(spark, d), vw.prior_writes(spark, d))


@query(
    "guard_urls",
    _with(*_GUARDED)
    + "SELECT DISTINCT e.cluster, g.skip, w.url FROM guarded g JOIN enriched e USING (cluster) JOIN placed_members m USING (cluster) "
    "JOIN first_writes w ON w.id = m.id WHERE g.skip IS NOT NULL AND NOT (g.skip = 'filed elsewhere' AND w.url = e.issue)",
)
def guard_urls(spark, d):
    return L.guard_urls(vw.enriched(spark, d), vw.prior_writes(spark, d))


@query(
    "fix_now",
    _with(vw.OPEN_PARTS, vw.CLUSTERS) + "SELECT cluster, CAST(effort = 'low' AND confidence = 'high' AS BIGINT) AS fix_now FROM clusters",
)
def fix_now(spark, d):
    return vw.clusters(spark, d).select("cluster", L.fix_now().cast("bigint").alias("fix_now"))


_LABELS = f"""own_labels AS (
  SELECT e.cluster, t.repo, e.class, list_concat(['{fixed.BASE_LABEL}', 'priority:' || e.severity],
    CASE WHEN e.effort = 'low' AND e.confidence = 'high' THEN ['{fixed.FIX_NOW_LABEL}'] ELSE [] END) AS base, t.owner_labels
  FROM enriched e LEFT JOIN targets t USING (target)),
needed AS (
  SELECT DISTINCT repo, unnest(list_concat(base, owner_labels)) AS label FROM own_labels o
  JOIN guarded g ON g.cluster = o.cluster WHERE o.class = 'file' AND g.skip IS NULL),
problems AS (
  SELECT n.repo, n.label, CASE WHEN f.have IS NULL THEN 'missing' ELSE 'case mismatch' END AS problem, f.have
  FROM needed n LEFT JOIN (SELECT repo, lower(name) AS fold, max(name) AS have FROM existing GROUP BY 1, 2) f
    ON f.repo = n.repo AND f.fold = lower(n.label)
  WHERE NOT EXISTS (SELECT 1 FROM existing x WHERE x.repo = n.repo AND x.name = n.label))"""
_FILED = (*_GUARDED, vw.REGISTRY, vw.TARGETS, vw.EXISTING_LABELS, _LABELS)


@query(
    "cluster_labels",
    _with(*_FILED)
    + "SELECT cluster, array_to_string(list_concat(base, list_filter(owner_labels, lambda x: NOT list_contains(base, x))), ',') AS labels FROM own_labels",
)
def cluster_labels(spark, d):
    placed = C.resolve_repo(vw.enriched(spark, d), G.target_repos(vw.registry(spark, d)))
    return L.cluster_labels(placed).select("cluster", F.array_join("labels", ",").alias("labels"))


def _to_file(spark, d):
    en = cut_lineage(vw.enriched(spark, d))
    skip = L.rerun_guard(en, vw.prior_writes(spark, d)).filter(F.col("skip").isNull()).select("cluster")
    chosen = en.filter(F.col("class") == "file").join(skip, "cluster", "left_semi")
    return C.resolve_repo(chosen, G.target_repos(vw.registry(spark, d)))


_RANKED = f"""listed AS (
  SELECT o.repo, o.cluster, unnest(list_concat(base, owner_labels)) AS label,
    unnest(list_concat(list_transform(base, lambda x: 0), list_transform(owner_labels, lambda x: 1))) AS own,
    unnest(list_concat(range(len(base)), range(len(owner_labels)))) AS place
  FROM own_labels o JOIN guarded g ON g.cluster = o.cluster WHERE o.class = 'file' AND g.skip IS NULL),
ranked AS (
  SELECT repo, label, min(CASE WHEN own = 1 THEN (9, cluster, place)
    ELSE (list_position({_BASE}, label), CAST(0 AS BIGINT), CAST(0 AS BIGINT)) END) AS spot FROM listed GROUP BY 1, 2)"""


@query(
    "label_union",
    _with(*_FILED, _RANKED) + "SELECT repo, label, row_number() OVER (PARTITION BY repo ORDER BY spot) AS position FROM ranked",
)
def label_union(spark, d):
    """A run's labels per repository are few, whatever the number of clusters."""
    w = Window.partitionBy("repo").orderBy("rank")
    return L.label_union(_to_file(spark, d)).select("repo", "label", F.row_number().over(w).cast("bigint").alias("position"))


@query("label_preflight", _with(*_FILED) + "SELECT repo, label, problem, have FROM problems")
def label_preflight(spark, d):
    needed = L.label_union(_to_file(spark, d))
    return L.label_preflight(needed, vw.existing_labels(spark, d)).select("repo", "label", "problem", "have")


# Every eleventh cluster names a target that the registry does not know.
_PLAN = """needed_here AS (
  SELECT DISTINCT repo, unnest(list_concat(base, owner_labels)) AS label FROM own_labels o
  JOIN guarded g ON g.cluster = o.cluster WHERE o.class = 'file' AND g.skip IS NULL AND o.cluster % 11 <> 5),
problems_here AS (SELECT p.* FROM needed_here JOIN problems p USING (repo, label)),
plan AS (
  SELECT e.cluster, CASE WHEN e.cluster % 11 <> 5 THEN t.repo END AS repo, CASE WHEN e.cluster % 11 = 5 THEN 'nowhere' ELSE e.target END AS target,
    e.class, e.members, e.improvement, e.issue, CASE WHEN e.cluster % 11 = 5 OR e.class = 'error' THEN 'error' WHEN e.class = 'noop' THEN 'noop'
    WHEN g.skip IS NOT NULL THEN 'skip' WHEN e.class = 'consolidate' THEN 'consolidate'
    WHEN t.repo IN (SELECT repo FROM problems_here) THEN 'held' ELSE 'file' END AS action
  FROM enriched e LEFT JOIN targets t USING (target) LEFT JOIN guarded g USING (cluster))"""


def _plan(spark, d):
    target = F.when(F.col("cluster") % 11 == 5, "nowhere").otherwise(F.col("target"))
    return L.file_plan(
        vw.enriched(spark, d).withColumn("target", target), G.target_repos(vw.registry(spark, d)), vw.prior_writes(spark, d),
        vw.existing_labels(spark, d),
    )


@query(
    "file_plan",
    _with(*_FILED, _PLAN)
    + "SELECT cluster, target, repo, action, CASE WHEN target = 'nowhere' THEN 'unknown target' WHEN class = 'error' THEN 'more than one open issue' END AS problem FROM plan",
)
def file_plan(spark, d):
    return _plan(spark, d).select("cluster", "target", "repo", "action", "problem")


@query(
    "plan_counts",
    _with(*_FILED, _PLAN) + "SELECT action, CASE WHEN action = 'held' THEN repo ELSE '' END AS repo, count(*) AS n_clusters FROM plan GROUP BY 1, 2",
)
def plan_counts(spark, d):
    return L.plan_counts(_plan(spark, d))


@query(
    "cluster_body_rows",
    _with(vw.OPEN_PARTS, vw.CLUSTERS)
    + "SELECT cluster, place, id, title, suggested_fix FROM (SELECT cluster, unnest(members) AS id, unnest(range(len(members))) AS place FROM clusters) JOIN open_set USING (id)",
)
def cluster_body_rows(spark, d):
    rows = L.member_rows(vw.clusters(spark, d), vw.open_parts(spark, d))
    return rows.withColumn("place", F.col("place").cast("bigint"))


_BODY = f"""bullets AS (
  SELECT cluster, string_agg('- ' || id || ' — ' || title, chr(10) ORDER BY pos) AS bullets, string_agg(suggested_fix, ' ' ORDER BY pos) AS fixes
  FROM members JOIN open_set USING (id) GROUP BY 1)"""


@query(
    "render_body",
    _with(*_CLUSTERED, vw.REGISTRY, vw.TARGETS, _BODY)
    + f"""SELECT e.cluster, improvement AS title, improvement || chr(10) || chr(10) || 'Target: ' || e.target
      || CASE WHEN t.kind = 'external' THEN ' (external)' ELSE '' END || chr(10) || 'Repo: ' || t.repo || chr(10)
      || 'Severity: ' || severity || ' · Effort: ' || effort || ' · Confidence: ' || confidence || chr(10) || chr(10)
      || '{fixed.MEMBERS_HEADING}' || chr(10) || bullets
      || CASE WHEN fixes IS NULL THEN '' ELSE chr(10) || chr(10) || 'Suggested fix: ' || fixes END || chr(10) AS body
    FROM enriched e JOIN targets t USING (target) JOIN bullets b ON b.cluster = e.cluster""",
)
def render_body(spark, d):
    placed = C.resolve_repo(vw.enriched(spark, d), G.target_repos(vw.registry(spark, d)))
    return L.render_body(placed, vw.open_parts(spark, d))


@query(
    "member_order",
    _with(*_CLUSTERED, _BODY) + f"SELECT cluster, '{fixed.COMMENT_HEADING}' || chr(10) || chr(10) || bullets || chr(10) AS body FROM bullets",
)
def member_order(spark, d):
    return L.render_comment(vw.clusters(spark, d), vw.open_parts(spark, d))


# Two filing runs and two closing runs of one date, beside an earlier date; the second
# filing run plans the even clusters, the second closing run finds nothing.
_MANIFEST = """marked AS (
  SELECT repo, list(label ORDER BY problem <> 'missing', spot) AS lacks FROM problems_here JOIN ranked USING (repo, label) GROUP BY 1),
run AS (
  SELECT CASE action WHEN 'file' THEN 'filed' WHEN 'consolidate' THEN 'consolidated' ELSE action END AS section, cluster,
    CASE WHEN action <> 'noop' THEN array_to_string(members, ',') END AS members, CASE WHEN action <> 'noop' THEN target END AS target,
    CASE WHEN action <> 'noop' THEN repo END AS repo, CASE WHEN action IN ('file', 'held') THEN improvement END AS title,
    CASE action WHEN 'held' THEN array_to_string(lacks, ',') WHEN 'file' THEN (
      SELECT array_to_string(list_concat(base, list_filter(owner_labels, lambda x: NOT list_contains(base, x))), ',') FROM own_labels o WHERE o.cluster = plan.cluster) END AS labels,
    CASE WHEN action = 'file' THEN 'https://t.example/new/' || cluster END AS url, CASE WHEN action = 'consolidate' THEN issue END AS issue,
    CAST(NULL AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS fix_url, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS VARCHAR) AS state_reason,
    CAST(NULL AS VARCHAR) AS closer, CAST(NULL AS VARCHAR) AS note
  FROM plan LEFT JOIN marked USING (repo) WHERE action IN ('file', 'consolidate', 'held', 'noop')),
planned AS (
  SELECT DISTINCT t.full_id AS id, v.url AS issue, c.url AS fix_url FROM coverage v JOIN closers c USING (repo, number)
  JOIN tracked t ON t.url = v.url WHERE NOT v.rerouted AND c.merged),
before AS (SELECT id FROM open_set WHERE pos % 3 = 0),
closing AS (
  SELECT CASE WHEN id IN (SELECT id FROM before) THEN 'skipped' ELSE 'resolved' END AS section, NULL AS cluster, NULL AS members, NULL AS target,
    NULL AS repo, NULL AS title, NULL AS labels, NULL AS url, issue, id, CASE WHEN id NOT IN (SELECT id FROM before) THEN fix_url END AS fix_url,
    CASE WHEN id IN (SELECT id FROM before) THEN 'already resolved' END AS reason, NULL AS state_reason, NULL AS closer, NULL AS note FROM planned
  UNION ALL SELECT 'closed_without_evidence', NULL, NULL, NULL, NULL, NULL, NULL, v.url, NULL, NULL, NULL, NULL, v.state_reason, c.type, NULL
  FROM coverage v JOIN closers c USING (repo, number) WHERE NOT v.rerouted AND NOT coalesce(c.merged, false)),
merged AS (
  SELECT '2023-12-31' AS run_date, * FROM run
  UNION ALL SELECT '2024-01-01', * FROM run WHERE section IN ('filed', 'consolidated')
  UNION ALL SELECT '2024-01-01', * FROM run WHERE cluster % 2 = 0
  UNION ALL SELECT '2024-01-01', * FROM closing WHERE section = 'resolved'
  UNION ALL SELECT '2024-01-02', * FROM closing
  UNION ALL SELECT CASE WHEN n = 1 THEN '2024-01-01' ELSE '2024-01-02' END, 'flush', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
    CASE WHEN n = 1 THEN 'no output' ELSE 'flushed' END FROM (SELECT unnest([1, 2]) AS n))"""
_MERGED = (*_FILED, _RANKED, _PLAN, _COVER, vw.CLOSE_EVENTS, _MANIFEST)


def _merged(spark, d):
    """Runs merged one after another, each from the manifest as stored by the one before."""
    path = scratch_path(spark, "manifest")
    plan = cut_lineage(_plan(spark, d).filter("action <> 'error'"))
    urls = plan.select("cluster", F.concat(F.lit("https://t.example/new/"), vw.string(F.col("cluster"))).alias("url"))
    even = plan.filter(F.col("cluster") % 2 == 0)
    # Labels are held against what this run needs, so the second run keeps the first one's list.
    index = cut_lineage(vw.index(spark, d))
    evidence = cut_lineage(K.closer_evidence(index, vw.close_events(spark, d)))
    planned = K.resolutions_planned(index, evidence)
    done = vw.open_parts(spark, d).filter(F.col("pos") % 3 == 0).select("id")
    line = lambda text: spark.range(1).select(F.lit(text).alias("note"))
    filing = lambda p, day: (day, L.FILING_SECTIONS, L.manifest_of(p, day, urls))
    closing = lambda p, e, day, text: (day, L.CLOSING_SECTIONS, L.closing_manifest(p, done, e, day, line(text)))
    runs = [
        filing(plan, "2023-12-31"), filing(plan, "2024-01-01"),
        closing(planned, evidence, "2024-01-01", "flushed"), closing(planned, evidence, "2024-01-02", "flushed"),
        filing(even, "2024-01-01"), closing(planned.limit(0), evidence.limit(0), "2024-01-01", "no output"),
    ]
    for n, (day, sections, rows) in enumerate(runs):
        if n:
            rows = L.merge_manifest(L.read_manifest(spark, path).filter(F.col("run_date") == day), rows, day, sections)
        L.write_manifest(cut_lineage(L.checked_manifest(rows)), path)
    return L.read_manifest(spark, path)


@query(
    "write_manifest",
    _with(*_MERGED)
    + "SELECT run_date, section, cluster, members, target, repo, title, labels, url, issue, id, fix_url, reason, state_reason, closer, note FROM merged",
)
def write_manifest(spark, d):
    rows = _merged(spark, d)
    return rows.withColumns({c: F.array_join(c, ",") for c in ("members", "labels")})


@query(
    "run_summary",
    _with(*_MERGED)
    + """, counted AS (
      SELECT run_date, count_if(section = 'filed')::BIGINT AS filed, count_if(section = 'consolidated')::BIGINT AS consolidated, count_if(section = 'held')::BIGINT AS held,
        count_if(section = 'resolved')::BIGINT AS resolved, count_if(section = 'noop')::BIGINT AS noop,
        count_if(section = 'filed' AND target = 'unowned')::BIGINT AS unowned, count(DISTINCT CASE WHEN section = 'filed' THEN repo END) AS repos
      FROM merged GROUP BY 1)
    SELECT *, run_date || ': ' || filed || ' filed (' || repos || ' owners), ' || consolidated || ' consolidated, ' || held || ' held (labels), '
      || resolved || ' resolved, ' || unowned || ' unowned.' AS summary FROM counted""",
)
def run_summary(spark, d):
    return L.run_summary(_merged(spark, d))


@query(
    "manifest_rules",
    _with(vw.OPEN_PARTS, vw.CLUSTERS)
    + f"SELECT cluster, '[' || cluster || '].url: expected string' AS error FROM clusters WHERE cluster % 4 = 1 "
    f"UNION ALL SELECT cluster, '[' || cluster || ']: missing required property: labels' FROM clusters WHERE cluster % 4 = 2",
)
def manifest_rules(spark, d):
    """Manifest entries are checked before they are written."""
    c = F.col("cluster")
    entry = F.to_json(
        F.struct(
            F.col("members").alias(fixed.MEMBERS_KEY), "target", F.lit("a/b").alias("repo"),
            F.col("improvement").alias("title"),
            F.when(c % 4 != 2, F.array(F.lit("x"))).alias("labels"), F.lit("u").alias("url"),
        )
    )
    entry = F.when(c % 4 == 1, F.replace(entry, F.lit('"url":"u"'), F.lit('"url":3'))).otherwise(entry)
    path = F.concat(F.lit("["), c, F.lit("]"))
    errors = Q.validate_nested(F.col("v"), path, Q.FILED_RULES, [fixed.MEMBERS_KEY, "labels"])
    return (
        vw.clusters(spark, d).select("cluster", F.parse_json(entry).alias("v"))
        .select("cluster", F.explode(errors).alias("error"))
    )
