import re
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
import tokenizers
from tasklode.llm import secrets
from tests.llm.shared import needs_testdata
from tests.llm.test_ngram_join import shingles
from tests.llm.test_quality import brute as quality_of
from tests.llm.test_secrets import brute as secrets_of

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def documents(spark):
    words = lambda k, n: " ".join(f"w{k * 1000 + i}" for i in range(n))
    passage = " ".join(f"shared{i}" for i in range(60))
    texts = [
        words(1, 100), words(1, 100), words(1, 99) + " changed", words(2, 80) + " " + passage, words(3, 50) + " " + passage + " é " + words(4, 30),
        "short text", None, "", "again and again " * 30, words(5, 40) + ' token = "0123456789abcdef0123" ' + words(6, 20), words(7, 3000),
    ]
    rows = [(i, t, "en", f"src{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[10], (None, words(8, 30), None, None, None)], COLUMNS)


def test_stages_take_effect(spark):
    docs = documents(spark)
    quality, near, passages, masking, pack = (f for _, f in corpus_pipeline.STAGES)
    one = quality(spark, docs, "")
    assert sorted(map(str, rows_of(one))) == sorted(str(r) for r in rows_of(docs) if quality_of(r[1])[-1])
    two = near(spark, one, "")
    assert sorted(str(r[0]) for r in rows_of(two)) == sorted(["0", "3", "4", "9", "10", "None"])
    three = passages(spark, two, "")
    kept = {r[0]: r[1] for r in rows_of(three)}
    assert "shared30" not in kept[3] + kept[4] and "w3048 w304" in kept[4] and " é w4000" in kept[4] and kept[10] == rows_of(docs)[10][1]
    assert all(r[4] == len(r[1]) for r in rows_of(three))
    four = masking(spark, three, "")
    assert {r[0] for r in rows_of(three) if secrets_of(r[1])} == {9} == {r[0] for r in rows_of(four) if "[secret]" in r[1]}
    assert not any(secrets_of(r[1]) for r in rows_of(four))
    for df in (one, two, three, four):
        assert df.columns == docs.columns
    assert {r.doc_id for r in pack(spark, four, "").collect()} == {0, 3, 4, 9, 10, None}


def test_empty(spark):
    df = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, "")
    assert df.count() == 0


def least_of_groups(rows):
    """Rows by text sets: one of each group at a similarity of 0.8, and all without words."""
    sets = [shingles(r[1], 5) for r in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    root[a] = root[b] = min(root[a], root[b])
    best = {}
    for i, r in enumerate(rows):
        key = root[i] if sets[i] else ("alone", i)
        if key not in best or (r[0] is None, r[0] or 0) < (best[key][0] is None, best[key][0] or 0):
            best[key] = r
    return list(best.values())


def without_repeats(rows, length=200):
    data = [(r[1] or "").encode() for r in rows]
    seen = Counter(t[i : i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for r, t in zip(rows, data, strict=True):
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append((r[0], bytes(b for b, g in zip(t, gone, strict=True) if not g).decode("utf-8", "ignore")))
    return out


def test_the_whole_run_against_brute_force(spark, tmp_path):
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    rows = [r for r in rows_of(documents(spark)) if quality_of(r[1])[-1]]
    left = without_repeats(least_of_groups(rows))
    tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((d, len(tokenizer.encode(secrets.masked(t), add_special_tokens=False).ids) + 1) for d, t in left)
    got = Counter()
    placed = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id] += r.length
        placed.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert Counter(got.items()) == want
    for parts in placed.values():
        ends = [0, *(a + n for a, n in sorted(parts))]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048


@needs_testdata
@pytest.mark.parametrize("number", [0, 1])
def test_first_stages_over_a_whole_table(spark, number):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    if number == 0:
        want = {r[0] for r in rows_of(docs) if quality_of(r[1])[-1]}
    else:
        sets = {r[0]: shingles(r[1], 5) for r in rows_of(docs)}
        root = {d: d for d in sets}
        for _ in range(3):
            for a in sets:
                for b in sets:
                    if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                        root[a] = root[b] = min(root[a], root[b])
        want = {d for d in root if root[d] == d}
    assert {r[0] for r in rows_of(corpus_pipeline.STAGES[number][1](spark, docs, ""))} == want
    assert re.match("quality|n-gram", corpus_pipeline.STAGES[number][0])
