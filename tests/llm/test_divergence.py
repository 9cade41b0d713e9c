"""Source divergence against plain Python, and the transducer against sorted lists."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from snagline.llm import divergence
from snagline.llm.transducer import Transducer, cut

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, least=3, top=200):
    docs = [(lang or "", source or "", terms_of(text)) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        seen = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = sorted((t for t in seen if seen[t] >= least), key=lambda t: t.encode())
        sources = {s: Counter() for la, s, _ in docs if la == lang}
        for la, s, ts in docs:
            if la == lang:
                sources[s].update(t for t in ts if seen[t] >= least)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p = {s: share(c) for s, c in sources.items()}
        q = share(sum(sources.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pair = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            term = [(t, f(p[s][t], q[t])) for t in kept if sources[s][t] and p[s][t] > q[t]]
            for part, items, limit in (("pair", pair, None), ("term", term, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, i, v, r + 1) for r, (i, v) in enumerate(items[:limit])}
    return sorted(out)


def frame(spark, rows):
    full = [(la, s, t, 1, "x", "y", "z", 5) for la, s, t in rows]
    return spark.createDataFrame(full, "lang string, source string, text string, doc_id long, term string, part string, item string, n int").repartition(5)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = ["Äpfel", "äpfel", "été", "été!", "a", "B", "b", "ab1cd", "naïve", "the", "THE", "x" * 500, "日本語", "𝔘ni", " "] + [
        "".join(rng.choice("abcé") for _ in range(rng.randint(1, 6))) for _ in range(150)
    ]
    out = [(rng.choice(["en", "fr", "de"]), f"s{min(rng.randint(0, 12), 6)}", " ".join(rng.choices(words, k=rng.randint(0, 40)))) for _ in range(300)]
    out += [(None, "s1", "a b a b"), ("", None, "a b"), (None, None, None), ("", "s1", "b, a"), ("zz", "only", "a a a"), ("yy", "p", "1 2 3"), ("yy", None, None)]
    out += [("en", "long", " ".join(rng.choices(words, k=60_000)))] + [out[0]] * 50
    return out


@pytest.mark.parametrize("pack, hold", [(1 << 22, 1 << 28), (300, 1 << 28), (1500, 1)])
def test_against_plain_counts(spark, rows, pack, hold):
    """However many transducers and passes the vocabulary takes."""
    assert got(divergence.audit_sources(frame(spark, rows), pack_bytes=pack, pass_bytes=hold)) == brute(rows)


def test_many_sources_and_ties(spark):
    rng = random.Random(9)
    words = [f"w{chr(97 + i)}" for i in range(20)]
    rows = [("en", f"h{i % 90}", " ".join(rng.choices(words, k=5))) for i in range(400)]
    assert got(divergence.audit_sources(frame(spark, rows), top=4)) == brute(rows, top=4)


def test_no_rows_no_terms(spark, rows):
    assert got(divergence.audit_sources(frame(spark, rows).where("false"))) == []
    bare = [("en", "a", "1 2"), ("en", "b", None), ("en", "c", "once")]
    assert got(divergence.audit_sources(frame(spark, bare))) == brute(bare)
    assert {r[4] for r in brute(bare)} == {0}


def test_shares_are_exact_beyond_a_long():
    counts = [0, 1, 10**9, 8 * 10**15]
    total = 9 * 10**15
    assert divergence.shares(np.array(counts), total).tolist() == [1 + 10**9 * (c + 1) // total for c in counts]
    assert divergence.shares(np.array([5]), 6).tolist() == [1 + 10**9]


def test_transducer_places_and_is_minimal():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc\xe9") for _ in range(rng.randint(1, 7))).encode() for _ in range(900)} | {b"q" * 3000})
    made = Transducer(words)
    place = {w: i for i, w in enumerate(words)}
    asked = words + [w[:-1] for w in words] + [w + b"a" for w in words] + [b"zz", b"qq", b"\xc3"]
    data, start, length, doc = cut(asked)
    spelt = [data[s : s + n].tobytes() for s, n in zip(start, length)]
    assert made.size == len(words) and made.places(data, start, length).tolist() == [place.get(w, -1) for w in spelt]
    futures = {frozenset(w[i:] for w in words if w.startswith(p)) for p, i in {(w[:k], k) for w in words for k in range(len(w) + 1)}}
    assert len(made.final) == len(futures) < sum(map(len, words))
    assert Transducer([]).places(data, start, length).max() == -1


def test_words_are_cut_as_the_pattern_says():
    rng = random.Random(5)
    texts = ["".join(rng.choice("aZ é\t1[`{~\x7f\x80日\x00@") for _ in range(rng.randint(0, 30))) for _ in range(400)]
    data, start, length, doc = cut([t.encode() for t in texts])
    spelt = [[] for _ in texts]
    for s, n, d in zip(start, length, doc):
        spelt[d].append(data[s : s + n].tobytes().decode())
    assert spelt == [terms_of(t) for t in texts]
