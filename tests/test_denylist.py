"""A long denylist through its index, against the form that tries every literal."""

import random

import pytest
from pyspark.sql import functions as F

from snagline.functions import redaction as R
from snagline.operators import denylist as D


def listed(spark, literals):
    return spark.createDataFrame(list(enumerate(literals)), "pos long, literal string")


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)


def both(spark, literals, texts, counted=False):
    df = table(spark, texts)
    index = D.denylist_index(listed(spark, literals), texts=df if counted else None)
    used = [x for x in literals if x]
    assert sorted(r.id for r in D.indexed_hits(df, "id", "text", index).collect()) == sorted(
        r.id for r in df.filter(R.denylist_hit(F.col("text"), used)).collect())
    got = {r.id: r.text for r in D.indexed_redact(df, "id", "text", index).collect()}
    want = {r.id: r.text for r in df.select("id", R.redact_denylist(F.col("text"), used).alias("text")).collect()}
    assert got == want
    return [got[i] for i in range(len(texts))]


def test_order_case_and_markers(spark):
    got = both(
        spark, ["project nightingale", "redact", "éclair", "]x", "d] t", "k", ""],
        ["Project Nightingale ships", "nothing here", "ÉCLAIR and éclair", None, "", "éclairx", "éclair tea",
         "the K sign", "a\\Eb"])
    assert got[1:3] == ["nothing here", "[redacted] and [redacted]"]
    assert got[5] == "[redacted[redacted]" and got[3] is None and got[4] == ""


def test_random_lists(spark):
    rng = random.Random(7)
    letters = "abAB[]red.\\EQéÉßſKıİ😀 "
    for _ in range(3):
        word = lambda n: "".join(rng.choice(letters) for _ in range(n))
        both(spark, [word(rng.choice([1, 2, 3, 4, 7, 9])) for _ in range(25)], [word(rng.randint(0, 60)) for _ in range(150)])


def test_rarest_gram_follows_the_texts(spark):
    texts = ["common words and zebra"] * 3 + ["common words"] * 40
    words = listed(spark, ["common zebra"])
    by_texts = D.denylist_index(words, texts=table(spark, texts)).first()
    common = [r.h for r in spark.sql(
        "SELECT xxhash64(g) AS h FROM (SELECT explode(array('common', 'ommon ')) AS g)").collect()]
    assert by_texts.n == 6 and by_texts.gram not in common
    both(spark, ["common zebra", "and zebra", "words"], texts, counted=True)


def test_every_letter_that_matches_ascii_is_folded(spark):
    """All characters of Unicode that match a letter of ASCII without regard to case fold to it."""
    signs = spark.range(128, 0x110000).filter("id < 55296 OR id > 57343").select(
        F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    kin = signs.filter(F.col("c").rlike("(?iu)[a-z]") | F.col("c").rlike("(?iu)k|s|i"))
    assert {r.c: r.f for r in kin.select("c", D.folded(F.col("c")).alias("f")).collect()} == {
        "İ": "i", "ı": "i", "ſ": "s", "K": "k"}


def test_empty_list_repeated_and_null_keys(spark):
    df = spark.createDataFrame(
        [(1, "acme one", "a"), (1, "else", "b"), (None, "ACME two", "c"), (None, None, "d")], "id long, text string, pos string")
    none = D.denylist_index(listed(spark, []))
    assert D.indexed_hits(df, "id", "text", none).count() == 0
    assert D.indexed_redact(df, "id", "text", none).count() == 4
    index = D.denylist_index(listed(spark, ["acme"]))
    assert sorted(r.pos for r in D.indexed_hits(df, "id", "text", index).collect()) == ["a", "c"]
    out = D.indexed_redact(df, "id", "text", index)
    assert out.columns == df.columns
    assert sorted((r.pos, r.text) for r in out.collect()) == [
        ("a", "[redacted] one"), ("b", "else"), ("c", "[redacted] two"), ("d", None)]


@pytest.mark.parametrize("literals", [10, 10_000])
def test_only_candidates_are_tried(spark, literals):
    df = table(spark, [f"line {i} with user{i}@mail.example in it" for i in range(400)])
    index = D.denylist_index(listed(spark, [f"user{i}@mail.example" for i in range(literals)]))
    may = D.candidates(df, "id", "text", index).count()
    hits = D.indexed_hits(df, "id", "text", index).count()
    assert hits == min(literals, 400)
    assert may <= 60 * hits


def test_index_that_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_LITERALS", 2)
    both(spark, ["acme", "project x", "corp", "secret name"], ["ACME corp", "Project X", "none", "a secret name"])
