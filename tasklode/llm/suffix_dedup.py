"""Removal of repeated byte strings, by bucket-pointer refinement of sampled suffixes.

Suffixes are put in the bucket of their first q bytes, and buckets are refined by the identifiers of
buckets at later offsets, until ``length`` bytes are told apart. An identifier stands for a string
(it is a 64-bit hash of the identifiers that it is made of, not a rank), so the one at a later offset
is at hand wherever the bytes are: strings of 2q bytes are told by two identifiers q bytes apart, those
of 4q by two of the former 2q bytes apart, and so on; each doubling reuses the identifiers of the
one before, and two that overlap tell strings of the lengths between.

Only sampled suffixes are bucketed first. Two equal strings of ``length`` bytes have the same least
q-gram at the same place (a window's minimiser), so windows are taken in runs that share it; a run is
in the bucket of its q-gram, and a bucket with one member is done: none of its windows repeats. In
a bucket, runs whose covers (the strings over all their windows) are equal are repeats at once; a
bucket with several covers is refined, by one member of each cover, of which the covered bytes go on.
Its windows are put in cells by their distance to the q-gram, smaller from round to round (CELLS), and
a cell in the bucket of the string that all its windows share (the core): again equal covers are
repeats, a core that is alone makes none, and a core with several covers is refined, down to single
windows. Covers are hashed by another function than cores, so what is removed agrees in 128 bits.

Buckets meet in JVM aggregations of plain longs, combined before they travel. Texts that are copies
as a whole are one class; only one row of a class is read for refinement.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasklode.llm.common import (
    BASE, BYTE_HASH, INVERSE, MIX_A, MIX_B, KeyFilter, as_bytes, as_long, as_unsigned, clashes, dropped, free_names, identity, mix, powers, text_hashes, text_steps, two, with_column, written,
)

#: Bytes of the first buckets' strings, windows in a cell (by distance) in each round, and bytes of a long text that one step reads.
Q_GRAM, CELLS, PART = 50, (16, 4, 1), 1 << 22
_PLACE = np.uint64((1 << 24) - 1)
ALL, OPEN = 1, 2
#: Bits of a distance; a unit of windows is place << 2 * FAR | greatest distance << FAR | least.
FAR = 10
#: The second hash of strings: another base (odd) and other values of bytes.
BASE_2 = mix(np.array([BASE]))[0] | np.uint64(1)
INVERSE_2 = np.uint64(pow(int(BASE_2), -1, 1 << 64))
BYTE_HASH_2 = mix(BYTE_HASH ^ MIX_A)


class Strings:
    """Hashes of any string of some bytes, from sums of powers."""

    def __init__(self, data: np.ndarray, second: bool = False) -> None:
        n = len(data)
        values, base, inverse = (BYTE_HASH_2, BASE_2, INVERSE_2) if second else (BYTE_HASH, BASE, INVERSE)
        self.inverse = inverse
        self.total, self.back = np.zeros(n + 1, np.uint64), powers(n + 1, inverse)
        with np.errstate(over="ignore"):
            np.cumsum(values[data] * powers(n, base), out=self.total[1:])

    def hash(self, start: np.ndarray, size: np.ndarray | int, salt: np.ndarray | int = 0) -> np.ndarray:
        """Of the strings of ``size`` bytes at ``start``."""
        with np.errstate(over="ignore"):
            own = np.asarray(size).astype(np.uint64) * MIX_A + np.asarray(salt).astype(np.uint64) * MIX_B
            return mix((self.total[start + size] - self.total[start]) * self.back[start] + own)


class Pointers:
    """Bucket identifiers of the strings of q, 2q, 4q, ... bytes at every offset of some bytes."""

    def __init__(self, data: np.ndarray, q: int, most: int) -> None:
        self.size, self.of = q, Strings(data).hash(np.arange(max(0, len(data) - q + 1)), q)
        self.levels = {q: self.of}
        while 2 * self.size <= most:
            self.of = self.joined(self.of[: max(0, len(self.of) - self.size)], self.of[self.size :])
            self.size *= 2
            self.levels[self.size] = self.of

    @staticmethod
    def joined(first: np.ndarray, later: np.ndarray) -> np.ndarray:
        """The identifier of a bucket that is refined by that of a later offset."""
        with np.errstate(over="ignore"):
            return mix(first * MIX_B + mix(later ^ MIX_A))

    def hash(self, start: np.ndarray, size: int, salt: np.ndarray) -> np.ndarray:
        """Of the strings of ``size`` bytes at ``start``: two identifiers of the longest strings at hand, which may overlap."""
        near = max(x for x in self.levels if x <= size)
        of = self.levels[near]
        with np.errstate(over="ignore"):
            return mix(self.joined(of[start], of[start + size - near]) + salt.astype(np.uint64) * MIX_A)


class Step:
    """The windows of some texts, and the place of each window's least q-gram."""

    def __init__(self, parts: list[tuple[int, int, bytes]], length: int) -> None:
        """``parts``: row, place in the text and bytes."""
        self.length = length
        self.text = np.array([p[0] for p in parts], np.int64)
        sizes = np.array([len(p[2]) for p in parts], np.int64)
        begin = np.append(0, np.cumsum(sizes)[:-1])
        #: What to add to a place here to get the place in the text.
        self.shift = np.array([p[1] for p in parts], np.int64) - begin
        self.data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
        # windows that lie in one part
        counts = sizes - length + 1
        self.part = np.repeat(np.arange(len(parts)), counts)
        self.window = np.repeat(begin - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(counts.sum())

    def runs(self, q: int) -> tuple[np.ndarray, ...]:
        """(bucket identifier, place, first window, last window, part) of each run of windows with the same least q-gram."""
        n = len(self.data)
        ids = Strings(self.data).hash(np.arange(n - q + 1), q)
        grams = ids & ~_PLACE | np.arange(n - q + 1, dtype=np.uint64)
        place = (sliding_least(grams, self.length - q + 1)[self.window] & _PLACE).astype(np.int64)
        heads = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (self.part[1:] != self.part[:-1])))
        tails = np.append(heads[1:], len(place)) - 1
        return ids[place[heads]], place[heads], self.window[heads], self.window[tails], self.part[heads]


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, from the running minima of blocks from both ends."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, ~np.uint64(0))
    padded[:n] = x
    shaped = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(shaped, axis=1).ravel()
    behind = np.minimum.accumulate(shaped[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - width + 1
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def _steps(batches: Iterator[pa.RecordBatch], firsts: KeyFilter, length: int, most: int) -> Iterator[tuple[np.ndarray, Step]]:
    """Classes, and a step over about ``most`` bytes of the rows that are the first of their class; a longer
    text has several steps, which share no window."""
    for batch in batches:
        for part in text_steps(batch):
            cls = as_unsigned(part.column("cls"))
            first = firsts.has(cls ^ as_unsigned(part.column("id")))
            held, count = [], 0
            for i, text in enumerate(as_bytes(part.column("text"))):
                for a in range(0, len(text) - length + 1 if first[i] else 0, most):
                    held.append((i, a, text[a : a + most + length - 1]))
                    count += len(held[-1][2])
                    if count >= most:
                        yield cls, Step(held, length)
                        held, count = [], 0
            if held:
                yield cls, Step(held, length)


def unit(place: np.ndarray, far: np.ndarray, near: np.ndarray) -> np.ndarray:
    return (place << 2 * FAR | far << FAR | near).astype(np.int64).view(np.uint64)


_MEMBER = "core long, cover long, cls long, at long"


def _members(core: np.ndarray, cover: np.ndarray, cls: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([as_long(x) for x in (core, cover, cls, at)], names=["core", "cover", "cls", "at"])


def _common_grams(docs: DataFrame, firsts: KeyFilter, length: int, q: int) -> DataFrame:
    """(core) of the first buckets that have several members."""
    shipped, most = docs.sparkSession.sparkContext.broadcast(firsts), PART

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, step in _steps(batches, shipped.value, length, most):
            yield pa.RecordBatch.from_arrays([as_long(step.runs(q)[0])], names=["core"])

    return written(docs.mapInArrow(grams, "core long").groupBy("core").agg(F.count("*").alias("n")).filter("n > 1").select("core"), "grams")


def _runs(docs: DataFrame, firsts: KeyFilter, common: KeyFilter, length: int, q: int) -> DataFrame:
    """(core, cover, cls, at) of the runs whose bucket may have several members."""
    shipped, most = docs.sparkSession.sparkContext.broadcast((firsts, common)), PART

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_of, shared = shipped.value
        for cls, step in _steps(batches, first_of, length, most):
            core, *rest = step.runs(q)
            has = shared.has(core)
            if has.any():
                place, first, last, part = (x[has] for x in rest)
                cover = Strings(step.data, second=True).hash(first, last - first + length, place - first)
                yield _members(core[has], cover, cls[step.text[part]], unit(place + step.shift[part], place - first, place - last))

    return written(docs.mapInArrow(runs, _MEMBER), "runs")


def _refined(members: DataFrame) -> DataFrame:
    """(cls, at, state): ALL of every member whose cover another has too; OPEN of one member of each cover of a
    core with several covers."""
    covers = members.groupBy("core", "cover").agg(F.min("cls").alias("low"), F.max("cls").alias("high"), F.min("at").alias("near"), F.max("at").alias("far"), F.min_by("at", "cls").alias("at"))
    repeated = covers.filter("low <> high OR near <> far").select("core", "cover")
    several = covers.groupBy("core").agg(F.min("cover").alias("least"), F.max("cover").alias("most")).filter("least <> most").select("core")
    gone = members.join(repeated, ["core", "cover"], "left_semi").select("cls", "at", F.lit(ALL).alias("state"))
    open_ = covers.join(several, "core", "left_semi").select(F.col("low").alias("cls"), "at", F.lit(OPEN).alias("state"))
    return written(gone.unionByName(open_), "refined")


def _near(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """cls, text and ``needed``'s other columns of the rows that ``needed`` (cls, id, none, ...) names."""
    shipped = docs.sparkSession.sparkContext.broadcast(KeyFilter(needed.select(F.col("cls").bitwiseXOR(F.col("id")).alias("key")), "key"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            may = shipped.value.has(as_unsigned(batch.column("cls")) ^ as_unsigned(batch.column("id")))
            yield from text_steps(batch.filter(pa.array(may)))

    key = ["cls", "id", "none"]
    return docs.select(*key, "text").mapInArrow(rows, "cls long, id long, none boolean, text string").join(needed, key).dropDuplicates(key).drop("id", "none")


def _snippets(docs: DataFrame, open_: DataFrame, info: DataFrame, length: int) -> DataFrame:
    """(cls, place, at, bytes) of the open runs: the bytes that their windows cover."""
    units = open_.groupBy("cls").agg(F.collect_list("at").alias("units"))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_steps(batch):
                rows = [
                    (cls, at >> 2 * FAR, at, text[(at >> 2 * FAR) - (at >> FAR & _MASK) : (at >> 2 * FAR) - (at & _MASK) + length])
                    for cls, text, own in zip(part.column("cls").to_pylist(), as_bytes(part.column("text")), part.column("units").to_pylist(), strict=True)
                    for at in own
                ]
                for k in range(0, len(rows), 10_000):
                    columns = zip(*rows[k : k + 10_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["cls", "place", "at", "bytes"])

    return written(_near(docs, units.join(info, "cls")).mapInArrow(sliced, "cls long, place long, at long, bytes binary"), "snippets")


_MASK = (1 << FAR) - 1


def _split(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``count`` items: the number of its owner, and its own among them."""
    return np.repeat(np.arange(len(count)), count), np.arange(count.sum()) - np.repeat(np.append(0, np.cumsum(count)[:-1]), count)


def _cells(snippets: DataFrame, length: int, q: int, size: int) -> DataFrame:
    """(core, cover, cls, at) of the cells of ``size`` windows of the units in column ``units``."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_steps(batch, "bytes"):
                cls, run = as_unsigned(part.column("cls")), part.column("at").to_numpy()
                bytes_ = as_bytes(part.column("bytes"))
                begin = np.append(0, np.cumsum(np.fromiter(map(len, bytes_), np.int64, len(bytes_))))[:-1]
                data = np.frombuffer(b"".join(bytes_), np.uint8)
                lists = part.column("units")
                row, _ = _split(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
                units = lists.flatten().to_numpy(zero_copy_only=False)
                # only the cells in which the run has windows
                far_run, near_run = run[row] >> FAR & _MASK, run[row] & _MASK
                low, high = np.maximum(units & _MASK, near_run) // size, np.minimum(units >> FAR & _MASK, far_run) // size
                of, k = _split(np.maximum(high - low + 1, 0))
                row, place, far_run, near_run = row[of], units[of] >> 2 * FAR, far_run[of], near_run[of]
                near = (low[of] + k) * size
                far = near + size - 1
                whole = (near >= near_run) & (far <= far_run)
                gram = begin[row] + far_run  # where the q-gram is, here
                own, at = cls[row], unit(place, far, near)
                core = Pointers(data, q, length - size + 1).hash(gram - near, length - size + 1, near)
                cover = mix(own ^ mix(at + BASE))  # of a part of a cell: like no other
                cover[whole] = Strings(data, second=True).hash((gram - far)[whole], length + size - 1, near[whole])
                yield _members(core, cover, own, at)

    return written(snippets.mapInArrow(cells, _MEMBER), "cells")


def merged(starts: list[int], stops: list[int]) -> list[tuple[int, int]]:
    """The union of spans: maximal runs, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts, stops, strict=True)):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _spans(docs: DataFrame, rows: DataFrame, length: int, q: int) -> DataFrame:
    """(cls, spans) of the classes that have repeated windows, a written table; spans may overlap."""
    if length - q >= 1 << FAR or max(CELLS) > length - q + 1:
        raise ValueError("length and q don't suit the units and cells")
    info = rows.groupBy("cls").agg(F.min(F.struct("none", "id")).alias("one")).select("cls", "one.*")
    firsts = KeyFilter(info.select(F.col("cls").bitwiseXOR(F.col("id")).alias("key")), "key")
    common = _common_grams(docs, firsts, length, q)
    members = _runs(docs, firsts, KeyFilter(common, "core"), length, q)
    found = [_refined(members)]
    dropped(common, members)
    snippets = _snippets(docs, found[0].filter(F.col("state") == OPEN), info, length)
    units = snippets.withColumn("units", F.array("at"))
    for size in CELLS:
        members = _cells(units.select("cls", "at", "bytes", "units"), length, q, size)
        found.append(_refined(members))
        dropped(members)
        place = F.shiftright("at", 2 * FAR).alias("place")
        open_ = found[-1].filter(F.col("state") == OPEN).groupBy("cls", place).agg(F.collect_list("at").alias("units"))
        units = snippets.join(open_, ["cls", "place"])
    mask = F.lit(_MASK)
    place, far, near = F.shiftright("at", 2 * FAR), F.shiftright("at", FAR).bitwiseAND(mask), F.col("at").bitwiseAND(mask)
    spans = [x.filter(F.col("state") == ALL).select("cls", (place - far).alias("start"), (place - near + length).alias("stop")) for x in found]
    out = written(reduce(DataFrame.unionByName, spans).groupBy("cls").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "spans")
    dropped(snippets, *found)
    return out


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, list[int]]:
    """(cls, id, none, text) of every row; (doc_id, cls, id, none, n_bytes, sha) as a written table; the clashes of the classes."""
    docs = two(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *text_hashes("text"))
    told = [F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none")]
    rows = written(docs.select("doc_id", "h1", "h2", *told, F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "rows")
    clashing = clashes(rows.select("h1", "h2").distinct(), "h1", "h2")
    cls = identity("h1", "h2", clashing).alias("cls")
    return docs.select(cls, *told, "text"), rows.withColumn("cls", cls).drop("h1", "h2"), clashing


def _repeated_spans(docs: DataFrame, rows: DataFrame, length: int, q: int) -> DataFrame:
    """(cls, n_bytes, sha, none, id, copies, spans), one row per class; spans are null if there are none."""
    copies = rows.groupBy("cls").agg(F.first("n_bytes").alias("n_bytes"), F.first("sha").alias("sha"), F.min(F.struct("none", "id")).alias("one"), F.count("*").alias("copies"))
    long = docs.filter(F.octet_length("text") >= length)
    return copies.select("cls", "n_bytes", "sha", "one.*", "copies").join(_spans(long, rows.filter(F.col("n_bytes") >= length), length, q), "cls", "left")


def measure(docs: DataFrame, length: int = 200, q: int = Q_GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the
    same or another row; overlaps count. A null text is empty and loses nothing, as does one shorter
    than ``length``. Repeated rows are copies, so both lose all. Null ids are kept. Empty in, empty out.
    A long text is read in steps of PART bytes.
    """
    docs, rows, _ = _prepared(docs, id_col, text_col)
    found = _repeated_spans(docs, rows, length, q)
    copied = (F.col("copies") > 1) & (F.col("n_bytes") >= length)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(as_bytes(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                runs = merged([s["start"] for s in spans], [s["stop"] for s in spans])
                rest = hashlib.sha256(cut(text, runs)).hexdigest()
                out.append((sum(b - a for a, b in runs), len(runs), rest))
            columns = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("cls"), *columns], names=["cls", "n_removed", "n_spans", "kept_sha256"])

    partly = written(found.filter(~copied & F.col("spans").isNotNull()).select("cls", "id", "none", "spans"), "partly")
    cutted = _near(docs, partly).select("cls", "text", "spans").mapInArrow(kept, "cls long, n_removed long, n_spans long, kept_sha256 string")
    none = hashlib.sha256(b"").hexdigest()
    of_class = found.drop("id", "none").join(cutted, "cls", "left").select(
        "cls",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copied, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, F.lit(none)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
    return rows.select("doc_id", "cls", "n_bytes").join(of_class, "cls").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def cut(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """What is left of ``text`` without the runs."""
    pieces, at = [], 0
    for a, b in runs:
        pieces.append(text[at:a])
        at = b
    return b"".join([*pieces, text[at:]])


def removed(docs: DataFrame, length: int = 200, q: int = Q_GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated bytes cut from the text, as ``measure`` counts them; all columns stay,
    whatever their names.

    A character of which a cut leaves only a part goes as well. A null text stays null.
    """
    prepared, rows, clashing = _prepared(docs, id_col, text_col)
    found = _repeated_spans(prepared, rows, length, q)
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    every = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    key, cuts, h1, h2 = free_names(docs, ["cls", "spans", "h1", "h2"])
    spans = found.select(F.col("cls").alias(key), F.when(whole, every).otherwise(F.col("spans")).alias(cuts)).filter(F.col(cuts).isNotNull())

    names = docs.columns

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_steps(batch, text_col):
                texts = []
                for data, own in zip(part.column(text_col).cast(pa.binary()).to_pylist(), part.column(cuts).to_pylist(), strict=True):
                    if data is not None and own is not None:
                        data = cut(data, merged([s["start"] for s in own], [min(s["stop"], len(data)) for s in own])).decode("utf-8", "ignore").encode()
                    texts.append(data)
                yield with_column(part, text_col, pa.array(texts, pa.binary()).cast(pa.string())).select(names)

    hashed = docs.withColumns(dict(zip((h1, h2), text_hashes(text_col), strict=True)))
    joined = hashed.withColumn(key, identity(h1, h2, clashing)).join(spans, key, "left")
    return joined.select(*(F.col(f"`{n}`") for n in names), cuts).mapInArrow(without, docs.schema)
