"""Personal data: fixed patterns, and more identifiers from the contexts that those stand in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snagline.llm.common import keyed, settled, span_list, span_rows, with_keys

# What counts as personal data. The patterns match what these plain forms
# match, in time proportional to the text and without recursion:
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   ip    [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+
#   phone \+[0-9][\x20().0-9-]+[0-9]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9-]++\.[A-Za-z0-9-])"
    r"[A-Za-z0-9.-]*?(?=\.(?![A-Za-z0-9-])|(?![A-Za-z0-9.-]))",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+",
    "card": r"[0-9](?=[ \-]?[0-9])[0-9 \-]*?(?<=[0-9])(?![ \-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BASE = list(PATTERNS)
#: The kind of spans that contexts reveal.
FOUND = "context"
KINDS = [*BASE, FOUND]
#: A word that holds a digit.
_WORD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def _luhn(digits: Column) -> Column:
    back = F.split(F.reverse(digits), "")
    worth = F.transform(
        F.filter(back, lambda d: d != ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: Column, hit: Column) -> Column:
    """The tests a match must pass; failing matches are dropped and not tried again."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(kind == "ip", hit.rlike("^" + r"\.".join([_OCTET] * 4) + "$"))
        .when(kind == "card", F.when(n.between(12, 19), _luhn(digits)).otherwise(F.lit(False)))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(F.lit(True))
    )


def _contexts(words: DataFrame) -> DataFrame:
    """Adds `contexts`: the shape of a word with the word, and with the two words, before it."""
    shape = F.col("hit")
    for run, sign in ((r"[0-9]+", "9"), (r"[A-Z]+", "A"), (r"[a-z]+", "a")):
        shape = F.regexp_replace(shape, run, sign)
    left = F.when((F.col("pos") > 0) & (F.length(F.trim("before")) == 0), F.lit("#")).otherwise(F.lower(F.trim("before")))
    last = F.split(left, r"\s+")
    one = F.element_at(last, -1)
    two = F.array_join(F.slice(last, -F.least(F.size(last), F.lit(2)), F.least(F.size(last), F.lit(2))), " ")
    return words.withColumn("contexts", F.array_distinct(F.array(F.concat_ws("\n", one, shape), F.concat_ws("\n", two, shape))))


def bootstrap(words: DataFrame, rounds: int = 3, accept: float = 0.8, support: int = 3) -> DataFrame:
    """Instances (hit, score) that high-confidence contexts reveal.

    `words`: hit, contexts, known (whether a base span covers the place). The graph
    of contexts and instances is settled once, as distinct edges. In each round a
    context scores the share of its instances that are known, with one instance more
    to divide by, if `support` of them are; an unknown instance scores one minus the
    product of its contexts' doubts, and from `accept` on counts as known.
    """
    edges = settled(
        words.select("hit", "known", F.explode("contexts").alias("context")).groupBy("context", "hit").agg(F.max("known").alias("known")),
        "contexts",
    )
    seeds = edges.where("known").select("hit").distinct().withColumn("score", F.lit(1.0))
    scores = seeds
    for _ in range(rounds):
        held = edges.join(scores, "hit", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        trusted = (
            held.groupBy("context")
            .agg(F.sum("score").alias("sum"), F.count("*").alias("n"), F.count_if(F.col("score") > 0).alias("held"))
            .where(F.col("held") >= support)
            .select("context", (F.col("sum") / (F.col("n") + 1)).alias("trust"))
            .where(F.col("trust") > 0.5)
        )
        new = (
            edges.join(trusted, "context").groupBy("hit")
            .agg((1 - F.exp(F.sum(F.log(1 - F.col("trust"))))).alias("score"))
            .where(F.col("score") >= accept)
            .join(seeds, "hit", "left_anti")
        )
        scores = settled(seeds.unionByName(new), "instances")
    return scores.where(F.col("score") < 1).join(seeds, "hit", "left_anti")


def find_personal(docs: DataFrame, rounds: int = 3, accept: float = 0.8, support: int = 3) -> DataFrame:
    """Personal data of every document; all columns of `docs` pass through.

    Adds n_email, n_ip, n_card, n_phone, base (their spans) and spans (theirs and
    those of kind `context`) as kind:start:end by start, then kind as listed,
    comma-joined; places are code points, ends exclusive.

    Matches of the four patterns that pass their tests are the seeds. Words with a
    digit are the instances, and the words before them, with their shape, are the
    contexts; see `bootstrap`. Base spans always stay, and a word that touches one
    is not reported again. A null text counts as empty. Rows that repeat id and text
    get one result each. Empty tables give empty results.
    """
    keys = ["k1", "k2"]
    rows = keyed(docs)
    spans = span_rows(rows.select(*keys, "text"), keys, {**PATTERNS, "word": _WORD})
    spans = spans.where(_holds(F.col("kind"), F.col("hit"))).select(
        *keys, "kind", "pos", "hit", "before", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")
    ).dropDuplicates([*keys, "kind", "start"])
    spans = settled(spans, "personal")
    in_text = Window.partitionBy(*keys).orderBy("start", "end")
    base = F.col("kind") != "word"
    spans = spans.withColumns({
        "upto": F.max(F.when(base, F.col("end"))).over(in_text.rowsBetween(Window.unboundedPreceding, 0)),
        "next": F.min(F.when(base, F.col("start"))).over(in_text.rowsBetween(0, Window.unboundedFollowing)),
    })
    known = F.coalesce(F.col("upto") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next") < F.col("end"), F.lit(False))
    words = _contexts(spans.where(~base).withColumn("known", known))
    words = settled(words.select(*keys, "hit", "contexts", "known", "start", "end"), "words")
    revealed = bootstrap(words, rounds, accept, support)
    more = words.where(~F.col("known")).join(revealed, "hit").select(*keys, F.lit(FOUND).alias("kind"), "start", "end")
    per = (
        spans.where(base).select(*keys, "kind", "start", "end").unionByName(more)
        .groupBy(*keys)
        .agg(*[F.count_if(F.col("kind") == k).alias(f"__llm_n_{k}") for k in BASE], span_list(KINDS, BASE).alias("__llm_base"), span_list(KINDS).alias("__llm_spans"))
    )
    per = settled(per.withColumnsRenamed({"k1": "__llm_k1", "k2": "__llm_k2"}), "personal-lists")
    own = [c for c in docs.columns if c not in (*[f"n_{k}" for k in BASE], "base", "spans")]
    return with_keys(docs, own).join(per, ["__llm_k1", "__llm_k2"], "left").select(
        *own, *[F.coalesce(f"__llm_n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE],
        F.coalesce("__llm_base", F.lit("")).alias("base"), F.coalesce("__llm_spans", F.lit("")).alias("spans"),
    )
