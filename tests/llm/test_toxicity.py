import random
import zlib

import numpy as np
from tasklode.llm import toxicity
from tests.llm.shared import AWKWARD, DOCS, docs

BAD = ["scumbag", "moronic", "trashy"]


def corpus(n, seed, misspelt=False):
    rnd = random.Random(seed)
    plain = ["".join(rnd.choices("abcdefghilmnorstu", k=rnd.randint(2, 9))) for _ in range(300)]
    texts, labels = [], []
    for i in range(n):
        w = rnd.choices(plain, k=rnd.randint(5, 300))
        if i % 3 == 0:
            bad = rnd.choice(BAD)
            w.insert(rnd.randrange(len(w)), bad + rnd.choice("xyz") if misspelt else bad)
        texts.append(" ".join(w))
        labels.append(int(i % 3 == 0))
    return texts, labels


def accuracy(model, texts, labels):
    kept = toxicity._Words(model.weight)
    return np.mean([(model.score(t, kept) >= 0.5) == bool(y) for t, y in zip(texts, labels, strict=True)])


def test_held_out_and_misspelt_words():
    model = toxicity.fit(*corpus(600, 1))
    assert accuracy(model, *corpus(300, 2)) > 0.95
    assert accuracy(model, *corpus(300, 3, misspelt=True)) > 0.9


def slow_score(model, text):
    """Every window of eight words, half overlapping: the mean weight of all n-grams of all its words, the largest counts."""
    words, best = (text or "").lower().split(), None
    for at in range(0, max(1, len(words) - 4), 4):
        bag = [b for w in words[at : at + 8] for b in toxicity.word_buckets(w)]
        mean = sum(float(model.weight[b]) for b in bag) / max(len(bag), 100)
        best = mean if best is None or mean > best else best
    return 1 / (1 + np.exp(-((best if words else 0.0) + model.bias)))


def test_scores_are_those_of_all_windows():
    model = toxicity.fit(*corpus(90, 1))
    texts = [*corpus(40, 6)[0], None, "", "word", "scumbag " * 9, "trashy trashy " + "calm " * 3_000, *(t for _, t in AWKWARD if t and len(t) < 20_000)]
    kept = toxicity._Words(model.weight)
    assert np.allclose([model.score(t, kept) for t in texts], [slow_score(model, t) for t in texts], atol=1e-6)


def test_scores_do_not_depend_on_what_a_worker_has_seen(monkeypatch):
    model = toxicity.fit(*corpus(90, 1))
    texts = corpus(20, 5)[0]
    want = [model.score(t, toxicity._Words(model.weight)) for t in texts]
    monkeypatch.setattr(toxicity, "KEPT_WORDS", 1_000)
    kept = toxicity._Words(model.weight)
    assert np.allclose([model.score(t, kept) for t in texts], want)


def test_rows_folds_and_labels(spark):
    texts, labels = corpus(200, 4)
    rows = [*AWKWARD, *((1000 + i, t) for i, t in enumerate(texts))]
    marks = spark.createDataFrame([*((1000 + i, 1, y) for i, y in enumerate(labels)), (None, 1, 1), (1, None, None), (99_999, 0, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.score(docs(spark, rows), marks).collect()
    assert len(out) == len(rows)
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    swapped = marks.selectExpr("doc_id", "quality", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    again = toxicity.score(docs(spark, rows), swapped).collect()
    assert sorted((str(r.doc_id), r.score) for r in out) == sorted((str(r.doc_id), r.score) for r in again)


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {round(r.score, 6) for r in toxicity.score(docs(spark), none).collect()} == {0.01}
    assert toxicity.score(spark.createDataFrame([], DOCS), none).count() == 0
