"""Queries over text: every redaction step alone, and the whole scrub."""

from __future__ import annotations

from pyspark.sql import functions as F

from snagline import fixed
from snagline.functions import redaction as R
from snagline.functions import text as T
from snagline.functions.settle import settle
from snagline.operators import denylist as DL
from snagline.plans import views as vw
from snagline.plans.catalog import query

# RE2 has no look-around: an edge is a consumed neighbour that is put back, and
# neighbours that share one are caught by a second pass.
_B = r"(^|[^\pL\pN_])"
_E = r"($|[^\pL\pN_])"
_S = r"\s\x0b\x1c-\x1f\x{85}\pZ"
_OCT = r"(?:25[0-5]|2[0-4]\p{Nd}|1?\p{Nd}?\p{Nd})"
_TOK = "A-Za-z0-9+=_-"


def _all(c: str, pattern: str, to: str, passes: int = 1) -> str:
    for _ in range(passes):
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    return c


def _pem(c, m="[pem-block]"):
    return _all(c, "(?s)-----BEGIN [^-]+-----.*?-----END [^-]+-----", m)


def _jwt(c, m="[jwt]"):
    body = r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*[A-Za-z0-9_]"
    return _all(c, f"{_B}{body}{_E}", rf"\1{m}\2", 2)


def _creds(c, m=r"\1[redacted]@"):
    return _all(c, rf"([a-zA-Z][a-zA-Z0-9+.-]*://)([^/@{_S}:]+):([^/@{_S}]+)@", m)


def _keys(c, m="[key]"):
    body = (
        r"(?:sk-[A-Za-z0-9]{10,}|ghp_[A-Za-z0-9]{10,}|github_pat_[A-Za-z0-9_]{10,}"
        r"|xox[a-zA-Z0-9-]{9,}[a-zA-Z0-9]|AKIA[A-Z0-9]{12,20})"
    )
    return _all(c, f"{_B}{body}{_E}", rf"\1{m}\2", 2)


def _email(c, m="[email]"):
    # An address starts at the first word edge of its run, on either side of it.
    start = rf"(?:{_B}[A-Za-z0-9_]|([\pL\pN_])[.%+-])"
    rest = r"[A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
    return _all(c, f"{start}{rest}{_E}", rf"\1\2{m}\3", 2)


def _ipv4(c, m="[ip]"):
    return _all(c, rf"{_B}(?:{_OCT}\.){{3}}{_OCT}{_E}", rf"\1{m}\2", 2)


def _ipv6(c):
    cand = r"[0-9A-Fa-f:]{2,}(?:\.[0-9]{1,3}){0,3}"
    core = "regexp_replace(regexp_replace(z[2], '^:([^:])', '\\1'), '([^:]):$', '\\1')"
    lead = "CASE WHEN regexp_matches(z[2], '^:[^:]') THEN ':' ELSE '' END"
    trail = "CASE WHEN regexp_matches(z[2], '[^:]:$') THEN ':' ELSE '' END"
    one = (
        f"CASE WHEN regexp_full_match({core}, '{R.IPV6}') THEN {lead} || '[ip]' || {trail} "
        "ELSE coalesce(z[2], '') END"
    )
    zipped = f"list_zip(regexp_split_to_array({c}, '{cand}'), regexp_extract_all({c}, '{cand}'))"
    return f"array_to_string(list_transform({zipped}, lambda z: z[1] || {one}), '')"


def _token(c, m="[token]"):
    for i, word in enumerate(fixed.TOKEN_ALLOWLIST):
        c = _all(c, f"(^|[^{_TOK}]){word}($|[^{_TOK}])", rf"\1⟦{i}⟧\2", 2)
    c = _all(c, f"(^|[^{_TOK}])[A-Za-z0-9+_-]{{20,}}={{0,2}}($|[^{_TOK}])", rf"\1{m}\2", 2)
    for i, word in enumerate(fixed.TOKEN_ALLOWLIST):
        c = f"replace({c}, '⟦{i}⟧', '{word}')"
    return c


def _home(c, m="~"):
    return _all(c, rf"/(?:Users|home)/[^/{_S}]+", m)


def _denylist(c):
    for literal in vw.DENYLIST:
        c = _all(c, f"(?i){literal}", "[redacted]")
    return c


def stages(source: str, c: str, last: str, keep: str = "doc_id") -> str:
    """WITH members that run the whole scrub over column `c` of `source`."""
    steps = [_pem, _jwt, _creds, _keys, _email, _ipv6, _ipv4, _token, _home]
    out, prev = [], source
    for i, step in enumerate(steps):
        name = last if i == len(steps) - 1 else f"{last}_{i}"
        expr = step("t")
        base = f"SELECT {keep}, {c} AS t FROM {source}" if i == 0 else f"SELECT * FROM {prev}"
        out.append(f"{name} AS (SELECT {keep}, {expr} AS t FROM ({base}))")
        prev = name
    return ",\n".join(out)


def _step(name, fn, sql):
    @query(name, f"WITH {vw.SECRET_TEXTS}\nSELECT doc_id, {sql('text')} AS text FROM secret_texts")
    def run(spark, d):
        return vw.secret_texts(spark, d).select("doc_id", fn(F.col("text")).alias("text"))

    return run


_step("redact_pem", R.redact_pem, _pem)
_step("redact_jwt", R.redact_jwt, _jwt)
_step("redact_url_creds", R.redact_url_creds, _creds)
_step("redact_keys", R.redact_keys, _keys)
_step("redact_email", R.redact_email, _email)
_step("redact_ipv6", R.redact_ipv6, _ipv6)
_step("redact_ipv4", R.redact_ipv4, _ipv4)
_step("redact_token", R.redact_token, _token)
_step("redact_home", R.redact_home, _home)
_step("redact_denylist", lambda c: R.redact_denylist(c, vw.DENYLIST), _denylist)


@query(
    "redact_url_safe",
    f"WITH {vw.SECRET_TEXTS}\nSELECT doc_id, {_ipv4('t')} AS text FROM (SELECT doc_id, {_ipv6('t')} AS t FROM ("
    f"SELECT doc_id, {_email(_keys(_creds(_jwt(_pem('text')))))} AS t FROM secret_texts))",
)
def redact_url_safe(spark, d):
    return R.redact_url_safe(vw.secret_texts(spark, d).select("doc_id", "text"), ["text"])


@query(
    "scrub_corpus",
    f"WITH {vw.SECRET_TEXTS},\n{stages('secret_texts', 'text', 'scrubbed')}\n"
    f"SELECT doc_id, {_denylist('t')} AS text FROM scrubbed",
)
def scrub_corpus(spark, d):
    docs = vw.secret_texts(spark, d).select("doc_id", "text")
    return R.scrub_corpus(docs, ["text"], literals=vw.DENYLIST)


@query(
    "scrub_documents",
    f"WITH {stages('documents', 'text', 'scrubbed')}\nSELECT doc_id, t AS text FROM scrubbed",
)
def scrub_documents(spark, d):
    return R.scrub_corpus(vw.table(spark, d, "documents", heavy=True).select("doc_id", "text"), ["text"])


@query(
    "denylist_hits",
    f"WITH {vw.SECRET_TEXTS}\nSELECT doc_id FROM secret_texts WHERE "
    + " OR ".join(f"contains(lower(text), '{x}')" for x in vw.DENYLIST),
)
def denylist_hits(spark, d):
    docs = vw.secret_texts(spark, d)
    return docs.filter(R.denylist_hit(F.col("text"), vw.DENYLIST)).select("doc_id")


def _long_denylist(spark, d):
    """The short list, then an address per customer, in this order."""
    few = spark.createDataFrame([(i - len(vw.DENYLIST), x) for i, x in enumerate(vw.DENYLIST)], "pos long, literal string")
    key = F.col("c_custkey")
    many = vw.table(spark, d, "customer").select(
        key.cast("long").alias("pos"), F.concat(F.lit("user"), key.cast("string"), F.lit("@mail.example")).alias("literal"))
    return few.unionByName(many)


_LONG_DENYLIST = "literals AS (\n  SELECT c_custkey AS pos, 'user' || c_custkey || '@mail.example' AS literal FROM customer" + "".join(
    f"\n  UNION ALL SELECT {i - len(vw.DENYLIST)}, '{x}'" for i, x in enumerate(vw.DENYLIST)) + ")"
_LONG_HITS = f"WITH {vw.SECRET_TEXTS},\n{_LONG_DENYLIST},\nhits AS (SELECT doc_id, text FROM secret_texts t WHERE EXISTS (SELECT 1 FROM literals WHERE contains(lower(t.text), literal)))\n"


@query("denylist_hits_indexed", f"{_LONG_HITS}SELECT doc_id FROM hits")
def denylist_hits_indexed(spark, d):
    docs = vw.secret_texts(spark, d).select("doc_id", "text")
    return DL.indexed_hits(docs, "doc_id", "text", DL.denylist_index(_long_denylist(spark, d))).select("doc_id")


@query(
    "redact_denylist_indexed",
    f"{_LONG_HITS}SELECT doc_id, text FROM secret_texts WHERE doc_id NOT IN (SELECT doc_id FROM hits)\nUNION ALL\n"
    "SELECT doc_id, list_reduce(list_prepend(text, (SELECT list(literal ORDER BY pos) FROM literals)),"
    " lambda a, x: regexp_replace(a, regexp_escape(x), '[redacted]', 'gi')) AS text FROM hits",
)
def redact_denylist_indexed(spark, d):
    docs = vw.secret_texts(spark, d).select("doc_id", "text")
    return DL.indexed_redact(docs, "doc_id", "text", DL.denylist_index(_long_denylist(spark, d)))


# The shapes that tell words from secrets.
_SHAPES = (
    "(regexp_full_match(run, '(?:--?|_)?[A-Z]?[a-z]+(?:[-_][a-z]{2,})+') "
    "OR regexp_full_match(run, '_?[A-Z]{2,}(?:_[A-Z]{2,})+') "
    "OR regexp_full_match(run, '[a-z]+(?:[A-Z][a-z]+)+|(?:[A-Z][a-z]+){2,}'))"
)
# Whole runs: maximal stretches of token characters with at most two closing "=".
_RUNS_SQL = f"""runs AS (
  SELECT doc_id, run FROM (
    SELECT doc_id, unnest(regexp_extract_all({_ipv4('t')}, '[A-Za-z0-9+=_-]+')) AS run FROM (
      SELECT doc_id, {_ipv6('t')} AS t FROM (
        SELECT doc_id, {_email(_keys(_creds(_jwt(_pem('text')))))} AS t FROM secret_texts)))
  WHERE regexp_full_match(run, '[A-Za-z0-9+_-]{{20,}}={{0,2}}') AND {_SHAPES}
    AND run NOT IN ({', '.join(repr(w) for w in fixed.TOKEN_ALLOWLIST)}))"""


def _runs(spark, d):
    docs = vw.secret_texts(spark, d).select("doc_id", "text")
    return R.scrub_corpus(docs, ["text"], runs_col="runs")


@query(
    "vocab_runs",
    f"WITH {vw.SECRET_TEXTS},\n{_RUNS_SQL}\nSELECT doc_id, run, count(*) AS n FROM runs GROUP BY 1, 2",
)
def vocab_runs(spark, d):
    runs = _runs(spark, d).select("doc_id", F.explode("runs").alias("run"))
    return runs.groupBy("doc_id", "run").agg(F.count(F.lit(1)).alias("n"))


@query(
    "scrub_review_counts",
    f"WITH {vw.SECRET_TEXTS},\n{_RUNS_SQL}\nSELECT 'd' || doc_id AS record_id, count(*) AS n_runs FROM runs GROUP BY doc_id",
)
def scrub_review_counts(spark, d):
    from snagline.operators import gate

    docs = _runs(spark, d).select(
        F.concat(F.lit("d"), vw.string(F.col("doc_id"))).alias("id"), F.lit("").alias("ts"), "runs"
    )
    return gate.scrub_review_counts(gate.review_rows(docs))


@query(
    "distinct_runs",
    f"WITH {vw.SECRET_TEXTS},\n{_RUNS_SQL}\nSELECT run, count(*) AS n FROM runs GROUP BY 1",
)
def distinct_runs(spark, d):
    from snagline.operators import gate

    return gate.distinct_runs(_runs(spark, d))


def _count(c: str) -> str:
    return f"CAST(length({c}) - length(replace({c}, chr(1), '')) AS BIGINT)"


_ONE = "' || chr(1) || '"
_PII = {
    "n_pem": _pem("text", _ONE),
    "n_jwt": _jwt("text", _ONE),
    "n_credentials": _creds("text", rf"\1{_ONE}"),
    "n_key": _keys("text", _ONE),
    "n_email": _email("text", _ONE),
    "n_ipv4": _ipv4("text", _ONE),
    "n_token": _all("text", f"(^|[^{_TOK}])[A-Za-z0-9+_-]{{20,}}={{0,2}}($|[^{_TOK}])", rf"\1{_ONE}\2", 2),
    "n_home": _home("text", _ONE),
}


@query(
    "pii_report",
    f"WITH {vw.SECRET_TEXTS},\ncounted AS (SELECT lang, source, "
    + ", ".join(f"{_count(e)} AS {n}" for n, e in _PII.items())
    + " FROM secret_texts)\nSELECT lang, source, count(*) AS n_docs, "
    + ", ".join(f"CAST(sum({n}) AS BIGINT) AS {n}" for n in _PII)
    + " FROM counted GROUP BY 1, 2",
)
def pii_report(spark, d):
    docs = vw.secret_texts(spark, d)
    counted = settle(docs, R.pii_counts(F.col("text")))
    return counted.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n_docs"), *[F.sum(n).alias(n) for n in _PII]
    )


@query(
    "truncate_to_schema",
    "SELECT doc_id, text[1:100] AS title, text[1:1000] AS description FROM documents",
)
def truncate_to_schema(spark, d):
    from snagline.operators import gate

    docs = vw.table(spark, d, "documents").select(
        "doc_id", F.col("text").alias("title"), F.col("text").alias("description")
    )
    return gate.truncate_to_schema(docs)


def _excerpt_sql(c: str, cap: str) -> str:
    w, m = len(fixed.TRUNCATION_MARKER), fixed.TRUNCATION_MARKER
    head = f"(({cap} - {w} + 1) // 2)"
    tail = f"({cap} - {w} - {head})"
    return (
        f"CASE WHEN {cap} <= 0 THEN '' WHEN length({c}) <= {cap} THEN {c} WHEN {cap} <= {w} THEN '{m}'[1:{cap}] "
        f"ELSE {c}[1:{head}] || '{m}' || CASE WHEN {tail} > 0 THEN right({c}, {tail}) ELSE '' END END"
    )


@query(
    "head_tail_excerpt",
    f"SELECT doc_id, {_excerpt_sql('text', '(doc_id % 400)')} AS text FROM documents",
)
def head_tail_excerpt(spark, d):
    docs = vw.table(spark, d, "documents")
    return docs.select("doc_id", T.head_tail_excerpt(F.col("text"), F.col("doc_id") % 400).alias("text"))


@query(
    "elide_payload",
    "SELECT doc_id, text[1:200] || '[content: ' || strlen(text) || ' bytes elided]' AS payload, "
    "'[tool_result: ' || strlen(text) || ' bytes elided] ' || text[1:200] AS stub FROM documents",
)
def elide_payload(spark, d):
    text = F.col("text")
    return vw.table(spark, d, "documents").select(
        "doc_id", T.elide_payload(text, 200, "content").alias("payload"), T.stub_payload(text).alias("stub")
    )


@query(
    "safe_label",
    "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g')[1:64] AS label, "
    "regexp_replace(regexp_replace(url, '[^A-Za-z0-9 :._/-]', '_', 'g')[1:200], '_+', '_', 'g') AS message FROM pages",
)
def safe_label(spark, d):
    return vw.table(spark, d, "pages").select(
        "page_id", T.safe_label(F.col("url")).alias("label"), T.squeezed_label(F.col("url")).alias("message")
    )


@query("session_key", "SELECT page_id, sha256(url) AS session_key FROM pages")
def session_key(spark, d):
    return vw.table(spark, d, "pages").select("page_id", T.session_key(F.col("url")).alias("session_key"))
