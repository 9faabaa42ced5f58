import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from tasklode.llm import suffix_dedup
from tests.llm.shared import AWKWARD, DOCS, docs


def brute(rows, length):
    seen = Counter(t[i : i + length] for _, t in rows for i in range(len(t) - length + 1))
    out = []
    for d, t in rows:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[: len(t)]
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        runs = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out.append((str(d), len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def texts_of(seed, count, length):
    rnd = random.Random(seed)
    words = lambda n: " ".join(rnd.choice(["é", "ab", "c", f"w{rnd.randint(0, 3000)}"]) for _ in range(n))
    shared = [words(rnd.randint(10, 150)) for _ in range(6)]
    out = []
    for _ in range(count):
        t = words(rnd.randint(0, 200))
        for _ in range(rnd.choice([0, 0, 1, 2])):
            s = rnd.choice(shared)
            a = rnd.randint(0, len(s) // 2)
            t += s[a : a + rnd.randint(0, len(s))] + words(rnd.randint(0, 30))
        out.append(t)
        if rnd.random() < 0.15:
            out.append(out[rnd.randrange(len(out))])
        if rnd.random() < 0.15 and t:
            at = rnd.randrange(len(t))
            out.append(t[:at] + "X" + t[at + 1 :])
    out.append("ab" * 400)
    out.append("z" * (length + 1))
    out.append("y" * length)
    return out


@pytest.mark.parametrize(("seed", "length", "q"), [(1, 200, 50), (2, 80, 20), (3, 60, 25), (4, 40, 8)])
def test_against_brute_force(spark, seed, length, q, monkeypatch):
    if seed == 3:
        monkeypatch.setattr(suffix_dedup, "CELLS", (6, 1))
    if seed == 4:
        monkeypatch.setattr(suffix_dedup, "PART", 300)
    rows = [(i if i % 29 else None, t) for i, t in enumerate(texts_of(seed, 150, length))] + [r for r in AWKWARD if not r[1] or len(r[1]) < 20_000]
    out = suffix_dedup.measure(docs(spark, rows).repartition(3), length, q).collect()
    want = brute([(d, (t or "").encode()) for d, t in rows], length)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == want


def test_text_without_its_repeats(spark):
    passage = "passage " * 40
    df = spark.createDataFrame([(1, "first " + passage + "é", "a"), (2, passage + "second", "b"), (3, "alone", "c"), (4, None, None)], "doc_id long, text string, spans string")
    out = {r.doc_id: (r.text, r.spans) for r in suffix_dedup.removed(df).collect()}
    assert out == {1: ("firsté", "a"), 2: ("second", "b"), 3: ("alone", "c"), 4: (None, None)}


def test_clashing_columns_and_the_least_id(spark):
    passage = "passage " * 40
    rows = [(-(1 << 63), "first " + passage, 1), (2, passage + "second", 2), (None, None, 3), (None, "x" * 300, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, cls long").selectExpr("*", "1 AS __cls", "2 AS _cls", "3 AS h1", "4 AS _spans", "5 AS id", "6 AS none", "7 AS key", "8 AS at")
    out = suffix_dedup.removed(df)
    assert out.columns == df.columns
    assert {r.cls: r.text for r in out.collect()} == {1: "first", 2: "second", 3: None, 4: ""}
    ids = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.measure(df.filter("cls < 3")).collect()}
    assert ids == {-(1 << 63): (326, 321), 2: (326, 320)}


def test_pointers_tell_strings_apart():
    rng = np.random.default_rng(1)
    data = np.frombuffer(b"abab" * 200 + bytes(rng.integers(97, 99, 3000, np.uint8)), np.uint8)
    own = suffix_dedup.Pointers(data, 8, 45)
    assert sorted(own.levels) == [8, 16, 32]
    for size in (8, 15, 25, 45):
        start = np.arange(len(data) - size + 1)
        ids = own.hash(start, size, np.zeros(len(start), np.int64))
        strings = [data[i : i + size].tobytes() for i in start]
        assert len(set(ids.tolist())) == len(set(strings)) == len(set(zip(ids.tolist(), strings, strict=True)))


def test_long_words_and_empty(spark):
    rows = [(1, "abc " * 30_000), (2, "x" * 50_000), (3, "")]
    out = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.measure(docs(spark, rows)).collect()}
    assert out == {1: (120_000, 1), 2: (50_000, 1), 3: (0, 0)}
    assert suffix_dedup.measure(spark.createDataFrame([], DOCS)).count() == 0
