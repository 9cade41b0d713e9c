"""One query per operator, with production parameters over whole tables, and its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snagline.llm.centroids import cluster
from snagline.llm.decontaminate import decontaminate
from snagline.llm.divergence import audit_sources
from snagline.llm.line_dedup import line_dedup
from snagline.llm.lm import score_texts
from snagline.llm.minhash import near_copies
from snagline.llm.packing import pack
from snagline.llm.pii import find_personal
from snagline.llm.quality import score_quality
from snagline.llm.secrets import scan_secrets
from snagline.llm.substring import cut_repeats
from snagline.llm.toxicity import score_toxicity
from snagline.llm.vectors import near_vectors
from snagline.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_line_dedup", r"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_no
  FROM documents
), k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS bare FROM l),
spread AS (
  SELECT bare, min((doc_id, line_no)) AS first FROM k WHERE bare <> ''
  GROUP BY bare HAVING count(DISTINCT source) >= 10
), m AS (
  SELECT k.*, spread.bare IS NOT NULL AND (k.doc_id, k.line_no) <> spread.first AS gone
  FROM k LEFT JOIN spread ON k.bare = spread.bare
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on ten sources or more stay in their first place only."""
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@_query("op2_decontaminate", r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n,
         list_slice(w, p + 1, p + least(13, len(w))) AS g
  FROM (SELECT *, unnest(range(greatest(len(w) - 12, 1))) AS p FROM i WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, n, p, list_slice(w, p + 1, p + n) AS g
  FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS p FROM d, lens WHERE len(w) >= n)
), m AS (SELECT dw.doc_id, dw.p, dw.n, iw.item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
""")
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 13 words in documents."""
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


@_query("op4_secrets")
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every blob against every rule version, from an empty ledger."""
    out = scan_secrets(table(spark, sf_dir, "documents"), scratch_path(spark, "ledger"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


@_query("op7_pii")
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data by pattern and by context."""
    out = find_personal(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans"
    )


@_query("op3_minhash", r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, list_slice(w, p + 1, p + 5) AS g
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS p FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS node, doc_id AS other FROM d UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT node, min(other) AS component_id FROM reach GROUP BY node) c ON c.node = d.doc_id
""")
def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies at a similarity of 0.85 on five-word shingles."""
    return near_copies(table(spark, sf_dir, "documents"), percent=85)


@_query("op6_substring", r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, p, list_slice(w, p + 1, p + 20) AS x
  FROM (SELECT doc_id, w, unnest(range(len(w) - 19)) AS p FROM d WHERE len(w) >= 20)
), r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY x ORDER BY doc_id, p) AS k FROM g) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS q FROM r),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS q FROM d),
kept AS (
  SELECT words.doc_id, count(*) FILTER (WHERE gone.q IS NOT NULL) AS n_removed,
         string_agg(x, ' ' ORDER BY words.q) FILTER (WHERE gone.q IS NULL) AS k
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.q = words.q GROUP BY words.doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
""")
def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words inside twenty-word windows that stand somewhere before."""
    return cut_repeats(table(spark, sf_dir, "documents"), texts=False).drop("kept_text")


@_query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores, learnt from the labelled documents that are not held out."""
    out = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


@_query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents in sequences of 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"))


@_query("op5_lm_scoring")
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every text, learnt from the documents that are not held out."""
    return score_texts(table(spark, sf_dir, "documents"))


@_query("op9_embedding_dedup", r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93
), reach AS (SELECT vec_id AS node, vec_id AS other FROM embeddings UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
c AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.node = e.vec_id LEFT JOIN n ON n.a = e.vec_id
""")
def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label at a cosine of 0.93 or more."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


def _lloyd_sql(rounds: int = 3) -> str:
    """The rounds written out one after another."""
    steps = [r"""WITH v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS k, x FROM v
  ORDER BY 1 LIMIT 16
)"""]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (
  SELECT r, min(struct_pack(d := d, k := k)) AS m FROM (
    SELECT v.r, c.k, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT AS d FROM v, c{n} c
  ) GROUP BY r
)""")
        if n < rounds:
            steps.append(f"""c{n + 1} AS MATERIALIZED (
  SELECT c.k, coalesce(t.x, c.x) AS x FROM c{n} c LEFT JOIN (
    SELECT k, list((s - ((s % n + n) % n)) // n ORDER BY i) AS x FROM (
      SELECT m.k AS k, i, sum(x[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM v JOIN a{n} USING (r), range(1, 65) t(i) GROUP BY 1, 2
    ) GROUP BY k
  ) t ON t.k = c.k
)""")
    return ",\n".join(steps) + f"""
SELECT v.vec_id, m.k::INTEGER AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.k))::BIGINT AS cluster_inertia,
       (sum(m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM v JOIN a{rounds} a USING (r) JOIN c{rounds} c ON c.k = a.m.k"""


@_query("op13_centroids", _lloyd_sql())
def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen centroids after three exact rounds."""
    return cluster(table(spark, sf_dir, "embeddings"))


@_query("op12_divergence", r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
m AS MATERIALIZED (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(s.n, 0) + v.v)::HUGEINT AS p
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), whole AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (sum(sum(n)) OVER (PARTITION BY lang) + v)::HUGEINT AS q
  FROM c JOIN v USING (lang) GROUP BY lang, term, v
), pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM m a JOIN m b ON a.lang = b.lang AND a.term = b.term GROUP BY ALL
  ) x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), every_ AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pair
  UNION ALL
  SELECT m.lang, m.source, 'term', m.term, (p - q) * (p - q) // q FROM m JOIN whole USING (lang, term) WHERE n > 0 AND p > q
)
SELECT * FROM (
  SELECT lang, source, part, item, value::BIGINT AS value,
         (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM every_
) WHERE part = 'pair' OR rank <= 200
""")
def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources against each other and against their language."""
    return audit_sources(table(spark, sf_dir, "documents"))


@_query("op11_quality")
def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores, learnt from the labelled documents that are not held out."""
    out = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")
