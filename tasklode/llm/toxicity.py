"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of itself and its character n-grams, hashed to buckets; an unseen misspelling
shares most of its n-grams with what it was made from. The embeddings of a window of words are
averaged into a softmax over two classes; a text is as toxic as its most toxic window, so that a few
words in a long text count as much as in a short one. Training looks at the window that is the most
toxic just now, of every text in the sample, and moves embeddings and softmax together.

At scoring time, a bucket's embedding times the softmax's weights is one number, and a word's sum
of them is kept by the worker.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasklode.llm.common import text_steps, two

BUCKETS, WIDTH = 1 << 17, 16
GRAMS = (3, 4, 5)
WINDOW = 8
#: Buckets that a window's sum is divided by at least, so that a lone odd word isn't a whole average.
LEAST_BAG = 100
#: Labelled texts of each class, at most, that the model is fitted to.
SAMPLE = 1_500
#: Code points of a text in the sample, at most: what reaches the driver is bounded. Longer ones are only scored.
LONGEST = 20_000
EPOCHS, RATE, DECAY, SEED = 150, 0.05, 1e-4, 11
#: Words whose sums a worker keeps.
KEPT_WORDS = 400_000
STEP_WORDS = 100 * WINDOW
FOLDS = 5


def word_buckets(word: str) -> list[int]:
    """Buckets of ``<word>`` and its n-grams, in bytes."""
    marked = f"<{word}>".encode()
    grams = [marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)]
    return [crc32(g) % BUCKETS for g in (marked, *grams)]


def words_of(text: str | None) -> list[str]:
    """The lower-case words, all of them."""
    return (text or "").lower().split()


def windows_of(n_words: int) -> np.ndarray:
    """Starts of windows of WINDOW words, half overlapping; every word is in one."""
    return np.arange(0, max(1, n_words - WINDOW // 2), WINDOW // 2)


class _Words(dict):
    """A worker's memory of words: the place of a word's sum and count in two arrays."""

    def __init__(self, weight: np.ndarray) -> None:
        self.weight = weight.tolist()
        self.sums, self.counts = np.zeros(KEPT_WORDS), np.zeros(KEPT_WORDS)

    def __missing__(self, word: str) -> int:
        ids, place = word_buckets(word), len(self)
        self.sums[place], self.counts[place] = sum(map(self.weight.__getitem__, ids)), len(ids)
        self[word] = place
        return place


@dataclass(frozen=True)
class Model:
    """``weight`` is each bucket's embedding times the difference of the softmax's weights."""

    weight: np.ndarray
    bias: float

    def score(self, text: str | None, kept: _Words) -> float:
        """Probability of the toxic class."""
        words = words_of(text)
        if not words:
            return float(1 / (1 + np.exp(-self.bias)))
        top = -np.inf
        for at in range(0, len(words), STEP_WORDS):  # steps overlap by a window
            part = words[at : at + STEP_WORDS + WINDOW]
            if len(kept) + len(part) > KEPT_WORDS:
                kept.clear()
            top = max(top, float(_windows(np.array(list(map(kept.__getitem__, part))), kept.sums, kept.counts).max()))
        return float(1 / (1 + np.exp(-(top + self.bias))))


def _windows(places: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean over the bag of each window of one text."""
    starts = windows_of(len(places))
    total, size = (np.append(0, np.cumsum(x[places])) for x in (sums, counts))
    stops = np.minimum(starts + WINDOW, len(places))
    return (total[stops] - total[starts]) / np.maximum(size[stops] - size[starts], LEAST_BAG)


def fit(texts: list[str], labels: list[int], seed: int = SEED) -> Model:
    """Embeddings and softmax fitted jointly (Adagrad, full batches of the most toxic windows)."""
    rnd = np.random.default_rng(seed)
    vectors = rnd.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    soft = rnd.normal(0, 0.3, (WIDTH, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    y = np.asarray(labels)
    known: dict[str, int] = {}
    places, starts, stops, owner = [], [], [], []
    for i, text in enumerate(texts):
        words = words_of(text)
        if words:
            s = windows_of(len(words)) + len(places)
            places += [known.setdefault(w, len(known)) for w in words]
            starts.append(s)
            stops.append(np.minimum(s + WINDOW, len(places)))
            owner.append(np.full(len(s), i))
    if len(set(y.tolist())) < 2 or not owner:
        share = (float(np.mean(y)) if len(y) else 0.0) * 0.98 + 0.01
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    places, starts, stops, owner = np.array(places), np.concatenate(starts), np.concatenate(stops), np.concatenate(owner)
    bags = [np.array(word_buckets(w), np.int32) for w in known]
    counts = np.array([len(b) for b in bags])
    bag_from = np.append(0, np.cumsum(counts)[:-1])
    flat = np.concatenate(bags)
    del bags, known
    total = np.append(0, np.cumsum(counts[places]))
    size = total[stops] - total[starts]
    divisor = np.maximum(size, LEAST_BAG)
    head = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    in_text = np.diff(np.append(head, len(owner)))
    docs = owner[head]
    share = np.bincount(y[docs], minlength=2)
    importance = (len(docs) / (2 * np.maximum(share, 1)))[y[docs]]
    grad_v, grad_s, grad_b = np.full(BUCKETS, 1e-6, np.float32), np.full(soft.shape, 1e-6, np.float32), np.full(2, 1e-6, np.float32)

    def spread(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return np.repeat(first - np.append(0, np.cumsum(lengths)[:-1]), lengths) + np.arange(lengths.sum())

    for _ in range(EPOCHS):
        weight = vectors @ (soft[:, 1] - soft[:, 0])
        of_word = np.add.reduceat(weight[flat], bag_from)
        total = np.append(0, np.cumsum(of_word[places], dtype=np.float64))
        toxic = (total[stops] - total[starts]) / divisor
        at = np.flatnonzero(toxic == np.repeat(np.maximum.reduceat(toxic, head), in_text))
        at = at[np.append(True, owner[at][1:] != owner[at][:-1])]  # the first of equals
        chosen = places[spread(starts[at], (stops - starts)[at])]
        own = flat[spread(bag_from[chosen], counts[chosen])]
        lengths = size[at]
        rows = np.repeat(np.arange(len(at)), lengths)
        mean = np.add.reduceat(vectors[own], np.append(0, np.cumsum(lengths)[:-1])) / divisor[at][:, None]
        z = mean @ soft + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(at)), y[docs]] -= 1
        p *= importance[:, None] / len(at)
        g_soft, g_bias = mean.T @ p + DECAY * soft, p.sum(0)
        g_mean = (p @ soft.T) / divisor[at][:, None]
        touched, back = np.unique(own, return_inverse=True)
        g_vec = np.stack([np.bincount(back, g_mean[rows, k], len(touched)) for k in range(WIDTH)], 1)
        grad_v[touched] += (g_vec**2).sum(1)
        grad_s += g_soft**2
        grad_b += g_bias**2
        vectors[touched] -= 10 * RATE * g_vec / np.sqrt(grad_v[touched])[:, None]
        soft -= RATE * g_soft / np.sqrt(grad_s)
        bias -= RATE * g_bias / np.sqrt(grad_b)
    return Model((vectors @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fold(doc_id) -> F.Column:
    """crc32 of the id as text, modulo FOLDS; a null id counts as held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)), F.lit(0))


def sample(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", most: int = SAMPLE) -> tuple[list[str], list[int]]:
    """At most ``most`` texts of each class outside fold 0, in the order of a hash of their ids; none over LONGEST.

    First the ids are picked, then only their texts are read. An id with several texts gives the
    least of them; an id with both labels counts as toxic.
    """
    one = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
        .filter("doc_id IS NOT NULL AND y IN (0, 1)")
        .filter(fold(F.col("doc_id")) != 0)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    docs = docs.filter(F.coalesce(F.char_length("text"), F.lit(0)) <= LONGEST)
    present = one.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    picked = [present.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))
    rows = docs.join(chosen, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
    return [r["text"] for r in rows], [r["y"] for r in rows]


def score(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Only rows outside fold 0 are learnt from. A null or empty text gets the score of a text
    without words. Without labels of both classes, the score is the same for all. Repeated rows and
    null ids are kept. Empty in, empty out. Texts of any length are scored whole, in steps of words.
    """
    docs = two(docs, id_col, text_col)
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(*sample(docs, labels, label_col, most)))  # half a megabyte, whatever the input

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        kept = _Words(own.weight)
        for batch in batches:
            for part in text_steps(batch):
                scores = [own.score(t, kept) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.mapInArrow(rows, "doc_id long, score double").select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
