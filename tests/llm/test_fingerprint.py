import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from tasklode.llm import fingerprint
from tests.llm.shared import AWKWARD, DOCS, docs


def bag(text):
    w = text.split(" ")
    return Counter(zip(w, w[1:], strict=False))


def jaccard(a, b):
    return sum((a & b).values()) / sum((a | b).values())


@pytest.mark.parametrize("share", [0.1, 0.5, 0.8, 1.0])
def test_collisions_follow_generalised_jaccard(share):
    rnd, wants, gots = random.Random(9), [], []
    for _ in range(60):
        w = [f"w{rnd.randint(0, 120)}" for _ in range(300)]
        v = w[: int(300 * share)] + [f"v{rnd.randint(0, 120)}" for _ in range(300 - int(300 * share))]
        a, b = " ".join(w), " ".join(v)
        s, some = fingerprint.signatures([a.encode(), b.encode()])
        wants.append(jaccard(bag(a), bag(b)))
        gots.append(fingerprint.likeness(s[:1], some[:1], s[1:], some[1:])[0])
    assert abs(np.mean(gots) - np.mean(wants)) < 0.03


def test_long_texts_without_a_shared_pair_are_unlike():
    rnd = np.random.default_rng(3)
    a, b = (" ".join(f"{x}{k}" for k in rnd.integers(0, 50_000, 200_000)) for x in "ab")
    s, some = fingerprint.signatures([a.encode(), b.encode(), f"{a} {b}".encode()])
    assert fingerprint.likeness(s[:1], some[:1], s[1:2], some[1:2])[0] <= 1 / 64
    assert abs(fingerprint.likeness(s[:1], some[:1], s[2:], some[2:])[0] - 0.5) < 0.2


def test_counts_weigh():
    a, b = "x y " * 50 + "p q", "x y " * 10 + "p q"
    s, some = fingerprint.signatures([a.encode(), b.encode()])
    assert abs((s[0] == s[1]).mean() - jaccard(bag(a.strip()), bag(b.strip()))) < 0.2 and some.all()


@pytest.mark.parametrize("partitions", ["1", "3", "7"])
def test_rows_and_their_neighbours(spark, partitions):
    rows = [*AWKWARD, *((100 + i, f"text {i} of some length é " * (i % 5)) for i in range(40))]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        out = fingerprint.fingerprints(docs(spark, rows[::-1])).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    ordered = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    follows = [t for _, t in ordered[1:]] + [ordered[0][1]]
    want, prints = [], {}
    for (d, t), f in zip(ordered, follows, strict=True):
        want.append((str(d), len(t), hashlib.sha256(fingerprint.edited(t, f).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in out) == sorted(want)
    texts = {str(d): t for d, t in ordered}
    for r in out:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert prints.setdefault(texts[str(r.doc_id)], r.fingerprint) == r.fingerprint
        assert r.near_edited == 1 or r.fingerprint != r.edited_fingerprint


def test_likeness_of_rows_against_brute_force(spark):
    rnd = random.Random(5)
    base = [f"w{rnd.randint(0, 300)}" for _ in range(400)]
    rows = []
    for i in range(60):
        keep = rnd.randint(0, 400)
        rows.append((i, " ".join(base[:keep] + [f"x{rnd.randint(0, 9_999)}" for _ in range(400 - keep)])))
    out = {r.doc_id: r for r in fingerprint.fingerprints(docs(spark, rows)).collect()}
    near, changed = [], []
    for (i, a), (_, b) in zip(rows, [*rows[1:], rows[0]], strict=True):
        near.append(out[i].near_next - jaccard(bag(a), bag(b)))
        changed.append(out[i].near_edited - jaccard(bag(a), bag(fingerprint.edited(a, b))))
    for errors in (near, changed):
        assert abs(np.mean(errors)) < 0.05 and np.abs(errors).max() < 0.3


def test_equal_ids_follow_in_one_order(spark):
    rows = [(1, f"text {i} with words") for i in range(50)] + [(2, "last one")]
    out = fingerprint.fingerprints(docs(spark, rows)).collect()
    assert len(out) == 51 and sorted(r.n_chars for r in out) == sorted(len(t) for _, t in rows)


def test_edits_and_few_rows(spark):
    assert fingerprint.edited("abcdefghi", "XYZ") == "abcdefgXY" and fingerprint.edited("abcdefgh", "X") == "abcdefX" and fingerprint.edited("abc", "X") == "abc"
    one = fingerprint.fingerprints(spark.createDataFrame([(1, "one two three four")], DOCS)).first()
    assert (one.near_next, one.n_chars) == (1.0, 18)
    assert fingerprint.fingerprints(spark.createDataFrame([], DOCS)).count() == 0
