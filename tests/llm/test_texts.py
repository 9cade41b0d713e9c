"""Line dedup, decontamination, MinHash and substring dedup beside plain Python."""

import hashlib
import random
import re
import string
from collections import defaultdict

import pytest

from snagline.llm import decontaminate as dc
from snagline.llm import minhash, substring
from snagline.llm.line_dedup import line_dedup
from tests.llm.conftest import plain

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SORT = lambda t: tuple((x is not None, str(x)) for x in t)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def blanks(text):
    return [w.decode() for w in (text or "").encode().split()]


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages and lines, over many sources; nulls, empty, long and repeated rows."""
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(400)] + ["The", "the", "😀"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, base, line = say(30), say(120), say(6)
    out = [(i, say(rng.randint(1, 80)), f"s{i % 14}") for i in range(40)]
    out += [(100 + i, f"{say(20)} {passage}\n{say(9)}", f"s{i % 14}") for i in range(25)]
    out += [(200 + i, base if i % 3 else base.upper(), f"s{i % 14}") for i in range(20)]
    for i in range(90):
        words = base.split()
        for _ in range(i % 5):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        out.append((300 + i, " ".join(words) + "\n" + line + "  \n\n" + line, f"s{i % 14}"))
    out += [(500, None, "s1"), (501, "", "s2"), (502, " \n\t ", None), (None, base, "s1"), (503, "one two", None), (504, "one two", "s3")]
    out += [(505, "be " * 500, "s1"), (506, "x" * 100_000, "s1"), (507, " ".join(vocab * 40), "s2"), (100, out[40][1], out[40][2]), (505, "other text", "s1")]
    return out


def brute_lines(rows, least):
    sites, first, docs = defaultdict(set), {}, []
    for d, t, s in rows:
        parts = (t or "").split("\n")
        docs.append((d, parts))
        for i, x in enumerate(parts):
            bare = x.strip(" \t\r")
            if bare:
                if s is not None:
                    sites[bare].add(s)
                at = (d is None, d or 0, i)
                first[bare] = min(first.get(bare, at), at)
    out = []
    for d, parts in docs:
        kept = [x for i, x in enumerate(parts) if not ((b := x.strip(" \t\r")) and len(sites[b]) >= least and first[b] != (d is None, d or 0, i))]
        out.append((d, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return sorted(out, key=SORT)


@pytest.mark.parametrize("least", [3, 10])
def test_lines(docs_of, rows, least):
    got = line_dedup(docs_of(rows), min_sites=least)
    assert plain(got, "doc_id", "n_lines", "n_removed", "text") == brute_lines(rows, least)
    assert {"kept", "k1", "lang", "n_chars"} <= set(got.columns)


def test_lines_without_the_first(docs_of):
    rows = [(i, "same\nown %d" % i, f"s{i}") for i in range(12)]
    got = plain(line_dedup(docs_of(rows), keep_first=False), "doc_id", "text")
    assert got == sorted(((i, f"own {i}") for i in range(12)), key=SORT)


def contract_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute_hits(text, items):
    w = contract_words(text)
    hit, which = set(), set()
    for item, t in items:
        x = contract_words(t)
        n = min(13, len(x))
        windows = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
        for p in range(len(w) - n + 1) if n else ():
            if tuple(w[p : p + n]) in windows:
                hit |= set(range(p, p + n))
                which.add(str(item))
    return len(w), len(hit), ",".join(sorted(which)), bool(hit) and 20 * len(hit) >= len(w)


def test_contamination(spark, docs_of, rows):
    rng = random.Random(5)
    texts = [t for _, t, _ in rows if t and 30 < len(t) < 5000]
    items = [(i, " ".join(t.split()[5:40]).title() + "!") for i, t in enumerate(rng.sample(texts, 8))]
    items += [(27, "be " * 100_000), (28, "as is " * 40_000 + "end")]
    items += [(20, "one, TWO"), (21, "be be be"), (22, "be " * 30), (23, None), (24, ""), (25, "?!"), (None, texts[0]), (3, texts[3]), (26, "é😀")]
    more = rows + [(600, "One two. " + "word " * 60), (601, "be be"), (602, "b" * 13), (604, "be " * 100_000), (605, "is as " * 50_000 + "be " * 20), (603, " ".join(t for _, t in items if t))]
    got = dc.decontaminate(docs_of(more), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS kept", "2 AS doc_id"))
    known = [(i, t) for i, t in items if i is not None]
    want = [(r[0], *brute_hits(r[1], known)) for r in more]
    got = sorted(((r[0], r[1], r[2], ",".join(r[3]), r[4]) for r in plain(got, "doc_id", "n_words", "n_hit", "items", "contaminated")), key=SORT)
    assert got == sorted(want, key=SORT)
    none = spark.createDataFrame([], "item_id long, text string")
    assert not dc.decontaminate(docs_of(more), none).where("contaminated OR n_hit > 0").count()


def brute_components(rows, percent=85):
    sets, parent = defaultdict(list), {}
    for d, t, *_ in rows:
        w = blanks((t or "").translate(LOW))
        n = min(5, len(w))
        sets[d].append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
        parent[d] = d
    find = lambda x: x if parent[x] == x else find(parent[x])
    ids = [d for d in sets if d is not None]
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = sorted((find(a), find(b)))
                parent[rb] = ra
    out = []
    for d, t, *_ in rows:
        w = blanks((t or "").translate(LOW))
        n = min(5, len(w))
        size = len({tuple(w[i : i + n]) for i in range(len(w) - n + 1)}) if w else 0
        out.append((d, size, None if d is None else find(d), d is None or find(d) == d))
    return sorted(out, key=SORT)


@pytest.mark.parametrize("bucket, block", [(48, 256), (4, 16)])
def test_near_copies(monkeypatch, docs_of, rows, bucket, block):
    monkeypatch.setattr(minhash, "BUCKET", bucket)
    monkeypatch.setattr(minhash, "BLOCK", block)
    assert plain(minhash.near_copies(docs_of(rows)), "doc_id", "n_shingles", "component_id", "kept") == brute_components(rows)


def brute_cut(rows):
    order = sorted({(d is None, d or 0, t or "") for d, t, *_ in rows})
    seen, gone = {}, {}
    # Texts that share an id: either may come first, so none of their windows repeats in the fixture.
    for key in order:
        w = key[2].encode().split()
        for p in range(len(w) - 19):
            x = tuple(w[p : p + 20])
            if x in seen:
                gone.setdefault(key, set()).update(range(p, p + 20))
            seen.setdefault(x, (key, p))
    out = []
    for d, t, *_ in rows:
        key = (d is None, d or 0, t or "")
        w = [x.decode() for x in key[2].encode().split()]
        g = gone.get(key, set())
        out.append((d, len(w), len(g), sha(" ".join(x for i, x in enumerate(w) if i not in g))))
    return sorted(out, key=SORT)


def test_substrings(docs_of, rows):
    got = substring.cut_repeats(docs_of(rows))
    assert plain(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_cut(rows)


def test_empty_tables(spark, docs_of):
    none = docs_of([]).where("false")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    for df in (line_dedup(none), dc.decontaminate(none, items), minhash.near_copies(none), substring.cut_repeats(none)):
        assert df.count() == 0
