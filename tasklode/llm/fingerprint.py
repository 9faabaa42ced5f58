"""Document fingerprints by consistent weighted sampling.

A text is the bag of its pairs of neighbouring words (a single word is its own pair), each a term of
64 bits and weighted by its count. For every term and each of SAMPLES samples, r and c are
gamma(2, 1) and b uniform, all made of hashes of the term; a term of weight s has
t = floor(ln s / r + b), y = exp(r (t - b)) and a = c / (y exp r). The least a picks (term, t), and
two texts pick the same with the probability of their generalised Jaccard similarity, however long
they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tasklode.llm.common import BASE, MIX_A, MIX_B, mix, text_steps, two, words, written

SAMPLES, SEED = 64, 7
#: Rows of (term, samples) that are held at once, and that are computed at once (temporaries stay in the CPU's cache).
HELD, COMPUTED = 65_536, 512
_LOW = np.uint64(0xFFFFFFFF)
_RESULT = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _offer(log_a: np.ndarray, terms: np.ndarray, t: np.ndarray) -> np.ndarray:
    """a in the high half, so that the least number is the least a; in the low half what is picked."""
    bits = log_a.view(np.uint32)
    ordered = bits ^ ((bits.view(np.int32) >> 31).view(np.uint32) | np.uint32(1 << 31))
    # terms are hashes already; the odd factor tells up to 2 ** 16 values of t of a term apart
    picked = (terms.astype(np.uint32)[:, None] + t.astype(np.int32).view(np.uint32) * np.uint32(0x9E37)) & np.uint32(0xFFFF)
    return ordered.astype(np.uint64) << np.uint64(32) | picked


def _uniforms(h: np.ndarray, shift: int) -> np.ndarray:
    """23 bits of each hash as a number between 0 and 1, both excluded."""
    x = (h >> np.uint64(shift)).astype(np.uint32) & np.uint32((1 << 23) - 1)
    return (x.astype(np.float32) + np.float32(0.5)) * np.float32(2**-23)


#: What makes a term's hash that of one sample.
_SALTS = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * BASE + np.uint64(SEED))


def _computed(terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """What each term of its weight offers to each sample, from hashes of the term."""
    with np.errstate(over="ignore"):
        first = mix(terms[:, None] + _SALTS)
        second = mix(first + BASE)
    r = -np.log(_uniforms(first, 41) * _uniforms(first, 18))
    b = ((first.astype(np.uint32) & np.uint32((1 << 18) - 1)).astype(np.float32) + np.float32(0.5)) * np.float32(2**-18)
    log_c = np.log(-np.log(_uniforms(second, 41) * _uniforms(second, 18)))
    t = np.floor(np.log(weights).astype(np.float32)[:, None] / r + b)
    return _offer(log_c - r * (t - b) - r, terms, t)


def offers(terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """What each term of its weight offers to each sample."""
    out = np.empty((len(terms), SAMPLES), np.uint64)
    for at in range(0, len(terms), COMPUTED):
        part = slice(at, at + COMPUTED)
        out[part] = _computed(terms[part], weights[part])
    return out


def bags(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, term) with the counts, in the order of terms."""
    hashes, _, _, owner = words(texts)
    count = np.bincount(owner, minlength=len(texts))
    pair = np.append(owner[1:] == owner[:-1], False) if len(owner) else np.zeros(0, bool)
    alone = count[owner] == 1
    with np.errstate(over="ignore"):
        keys = mix(hashes * MIX_A + np.append(hashes[1:], np.uint64(0)) * MIX_B * pair)
    use = pair | alone
    terms, which = np.unique(keys[use], return_inverse=True)
    both, weights = np.unique(which.astype(np.int64) << 32 | owner[use].astype(np.int64), return_counts=True)
    return both & ((1 << 32) - 1), terms[both >> 32], weights


def signatures(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The picked samples (16 bits each) of each text, and whether it has any term."""
    owner, terms, weights = bags(texts)
    least = np.full((len(texts), SAMPLES), ~np.uint64(0))
    for at in range(0, len(terms), HELD):
        part = slice(at, at + HELD)
        # equal terms of equal weights are computed once
        by_weight = np.lexsort((weights[part], terms[part]))
        own, term, weight = owner[part][by_weight], terms[part][by_weight], weights[part][by_weight]
        new = np.append(True, (term[1:] != term[:-1]) | (weight[1:] != weight[:-1]))
        offered = offers(term[new], weight[new])
        by_owner = np.argsort(own, kind="stable")
        row, own = (np.cumsum(new) - 1)[by_owner], own[by_owner]
        heads = np.flatnonzero(np.append(True, own[1:] != own[:-1])).tolist()
        for a, b in zip(heads, [*heads[1:], len(own)], strict=True):
            np.minimum(least[own[a]], offered[row[a:b]].min(0), out=least[own[a]])
    some = np.zeros(len(texts), bool)
    some[owner] = True
    return (least & _LOW).astype(np.uint16), some


def likeness(a: np.ndarray, a_some: np.ndarray, b: np.ndarray, b_some: np.ndarray) -> np.ndarray:
    """Share of equal samples; 1 of two texts without words, 0 of one and another."""
    same = (a == b).mean(1)
    return np.where(a_some & b_some, same, (a_some == b_some).astype(float))


def edited(text: str, following: str) -> str:
    """The last quarter (rounded down) of the code points replaced by the first of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _packed(signature: np.ndarray, some: bool) -> bytes:
    return signature.astype("<u2").tobytes() if some else b""


def _digest(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
    """Result rows of texts and the text that follows each."""
    changed = [edited(a, b) for a, b in zip(texts, following, strict=True)]
    at: dict[str, int] = {}  # most texts are also the next one of another
    own, new, other = ([at.setdefault(t, len(at)) for t in part] for part in (texts, changed, following))
    samples, some = signatures([t.encode() for t in at])
    columns = (
        (ids, pa.int64()),
        ([len(t) for t in texts], pa.int64()),
        ([hashlib.sha256(c.encode()).digest() for c in changed], pa.binary()),
        ([_packed(*x) for x in zip(samples[own], some[own], strict=True)], pa.binary()),
        ([_packed(*x) for x in zip(samples[new], some[new], strict=True)], pa.binary()),
        (likeness(samples[own], some[own], samples[new], some[new]), pa.float64()),
        (likeness(samples[own], some[own], samples[other], some[other]), pa.float64()),
    )
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], names=[c.split()[0] for c in _RESULT.split(", ")])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text and of its edited form, with their likeness and that to the next text.

    Texts are in the order of doc_id (nulls first), those of equal ids in that of a hash; after the last comes the first. A
    null text is empty; a text without words has an empty fingerprint. Equal texts have equal
    fingerprints. Repeated rows follow each other. A single row is its own next. Empty in, empty out.

    The texts are dealt by ranges of ids and each partition is read in order, so a text is shuffled
    once; the first and last text of each partition are put together afterwards.
    """
    docs = two(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    ranges = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    fields = [c.split() for c in _RESULT.split(", ")]
    blank = [pa.nulls(1, {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}[t]) for _, t in fields]
    edges = ["text", "part", "first"]

    def edge(doc_id: int | None, text: str, first: bool) -> pa.RecordBatch:
        own = TaskContext.get().partitionId()
        columns = [pa.array([doc_id], pa.int64()), *blank[1:], pa.array([text], pa.string()), pa.array([own], pa.int64()), pa.array([first])]
        return pa.RecordBatch.from_arrays(columns, names=[*(n for n, _ in fields), *edges])

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            for part in text_steps(batch):
                ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
                if before is None:
                    yield edge(ids[0], texts[0], True)
                else:
                    ids, texts = [before[0], *ids], [before[1], *texts]
                before = ids[-1], texts[-1]
                if len(ids) > 1:
                    done = _digest(ids[:-1], texts[:-1], texts[1:])
                    n = done.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [*done.columns, pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_())], names=[*done.schema.names, *edges]
                    )
        if before is not None:
            yield edge(*before, False)

    def at_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _digest(*(batch.column(n).to_pylist() for n in ("doc_id", "text", "following")))

    dealt = docs.repartitionByRange(*ranges).sortWithinPartitions(*ranges, F.col("text").asc())
    done = written(dealt.mapInArrow(in_order, f"{_RESULT}, text string, part long, first boolean"), "fingerprints")
    # the last text of a partition goes with the first of the next that has rows; only the numbers of partitions meet in a task
    ends = done.filter("first IS NOT NULL").select("doc_id", "text", "part", "first")
    along = Window.orderBy("part")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = ends.filter("first").select("part", F.coalesce(F.lead("part").over(along), F.first("part").over(whole)).alias("after"))
    following = ends.filter("first").select(F.col("part").alias("after"), F.col("text").alias("following"))
    joined = ends.filter("NOT first").join(after, "part").join(following, "after").select("doc_id", "text", "following")
    both = done.filter("first IS NULL").select(*(n for n, _ in fields)).unionByName(joined.mapInArrow(at_edges, _RESULT))
    return both.select(*(F.lower(F.hex(n)).alias(n) if t == "binary" else F.col(n) for n, t in fields))
