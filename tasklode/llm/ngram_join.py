"""N-gram Jaccard join by parity sketches, and its groups of linked texts.

The distinct word n-grams of a text are dealt to the blocks of a sketch by their hash; a block is
the XOR of the codes of its n-grams, so an n-gram in only one of two texts changes one block, and
the number of blocks that differ is a lower bound of the symmetric difference. Two texts that link
differ in at most t n-grams, t by their sizes; of t + 1 + z blocks at least z + 1 agree. Texts are
sketched per size band (a text whose partners can be in a smaller band also in that).

So a text in whose sketch fewer than z + 1 blocks occur elsewhere links with nothing. Of s such
blocks a text keeps its s - z rarest: the rarest block on which two linked texts agree has z more
common ones after it in both, so both keep it. Passages that many texts share drop out that way.
Texts that share a kept block are candidates; a bit sketch of 512 parities, whose Hamming distance
bounds the symmetric difference too, rejects most that aren't linked, and the sets of the others are
intersected.

Copies (equal sets) are one class from the start. Components grow in rounds: every class that shares
a block with another component is held against one class of it, the most alike of a few by the
parities. Rounds end when they find no link, or after MOST_ROUNDS. A group of near copies that link
becomes one component in a few rounds and doesn't make all its pairs.

What links are left between components is found by the n-grams of the classes that still share a block
with another component, in one order for all: first those that one component alone has, then those that
few have. A set of which k n-grams come from a place on shares at most k with a set whose first common
n-gram is there, so two that link have a common n-gram early enough in both, and only such pairs are held
against each other. Pages of one template that link with none make no pairs if each has its own n-grams
besides the template's: those fill the early places. Near misses that each lack other parts of what
they share are the worst case: n texts with edits of their own at random places, of a likeness just below
``percent``, make up to n * (n - 1) / 2 pairs.

The texts are read four times (sizes and classes, counts of blocks, sketches of what is left, and in
``one_of_each`` the rows that stay); only texts with z + 1 common blocks leave their task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tasklode.llm.common import (
    BASE, MIX_A, MIX_B, KeyFilter, as_bytes, as_long, as_unsigned, binaries, clashes, dropped, free_names, identity, longs, mix, text_hashes, text_steps, two, words, written,
)
from tasklode.llm.components import components

#: Growth of the size bands, and the share of further blocks (z) over t + 1.
BAND_RATIO, SPARE = 1.6, 0.35
PARITY_WORDS = 8
MOST_ROUNDS = 4


@dataclass(frozen=True)
class Band:
    """Sizes from ``low`` to ``own`` and partners up to ``top``; ``blocks`` of which ``kept`` are keys."""

    low: int
    own: int
    top: int
    blocks: int
    kept: int


@lru_cache(8)
def bands(percent: int, largest: int) -> tuple[Band, ...]:
    """Bands up to sizes of ``largest`` for a similarity of ``percent``; those where only equal sets link are left out."""
    out, low = [], 1
    while low <= largest:
        own = max(low, int(low * BAND_RATIO) - 1)
        top = own * 100 // percent
        differ = most_differ(own, top, percent)
        if differ:
            out.append(Band(low, own, top, differ + 1 + -(-int((differ + 1) * SPARE * 100) // 100), differ + 1))
        low = own + 1
    return tuple(out)


def most_differ(a, b, percent: int):
    """The largest symmetric difference of sets of these sizes that link."""
    return (100 - percent) * (a + b) // (100 + percent)


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash) of the distinct n-grams in order, and the size of each text's set."""
    hashes, _, _, owner = words(texts, lower=True)
    count = np.bincount(owner, minlength=len(texts))
    with np.errstate(over="ignore"):
        steps = mix(np.arange(1, n + 1, dtype=np.uint64) * MIX_B) | np.uint64(1)  # unrelated, so that no order of words cancels
        total = hashes * steps[0]
        for k in range(1, n):
            total[:-k or None] += hashes[k:] * steps[k]
        whole = np.zeros(len(hashes), bool)
        if len(hashes) >= n:
            whole[: len(hashes) - n + 1] = owner[: len(hashes) - n + 1] == owner[n - 1 :]
        values = mix(total[whole])
        # a text of fewer words: all of them, as one
        first = np.append(0, np.cumsum(count)[:-1])
        short = np.flatnonzero((count > 0) & (count < n))
        alone = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = count[short] > k
            alone[has] += hashes[first[short[has]] + k] * steps[k] * MIX_A
        alone = mix(alone + count[short].astype(np.uint64) * MIX_B)
    owners, values = np.concatenate((owner[whole], short)), np.concatenate((values, alone))
    order = np.lexsort((values, owners))
    owners, values = owners[order], values[order]
    if len(values):
        keep = np.append(True, (values[1:] != values[:-1]) | (owners[1:] != owners[:-1]))
        owners, values = owners[keep], values[keep]
    return owners, values, np.bincount(owners, minlength=len(texts))


def _per_set(ufunc, values: np.ndarray, owners: np.ndarray, count: int) -> np.ndarray:
    out = np.zeros(count, np.uint64)
    if len(owners):
        heads = np.flatnonzero(np.append(True, owners[1:] != owners[:-1]))
        out[owners[heads]] = ufunc.reduceat(values, heads)
    return out


def classes(texts: list[bytes], owners: np.ndarray, values: np.ndarray, sizes: np.ndarray, n: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers of each set, together its identity.

    A set so small that one other n-gram breaks the link is numbered by its n-grams themselves, the
    others by their hashes: sets that differ in two n-grams would need two clashes.
    """
    with np.errstate(over="ignore"):
        one = mix(_per_set(np.add, mix(values ^ MIX_A), owners, len(sizes)) + sizes.astype(np.uint64) * BASE)
        other = mix(_per_set(np.add, mix(values * MIX_B ^ BASE), owners, len(sizes)) ^ sizes.astype(np.uint64) * MIX_A)
    for i in np.flatnonzero((sizes > 0) & (most_differ(sizes, sizes, percent) < 2)):
        own = texts[i].lower().split()
        grams = {b" ".join(own[k : k + n]) for k in range(max(1, len(own) - n + 1))}
        other[i] = int.from_bytes(hashlib.blake2b(b"\n".join(sorted(grams)), digest_size=8).digest(), "little")
    return one, other


def parities(owners: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """Each n-gram flips one of 64 * PARITY_WORDS bits."""
    code = mix(values ^ MIX_B)
    bit, word = np.uint64(1) << (code >> np.uint64(58)), code & np.uint64(PARITY_WORDS - 1)
    return np.stack([_per_set(np.bitwise_xor, bit * (word == np.uint64(k)), owners, count) for k in range(PARITY_WORDS)], axis=1)


def block_keys(owners: np.ndarray, values: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, text, band, z) of all blocks of each text, in all its bands; by band, then text."""
    keys, texts, numbers, spare = [], [], [], []
    first = np.append(0, np.cumsum(sizes)[:-1])
    codes = mix(values ^ BASE)
    for number, band in enumerate(bands(percent, int(sizes.max(initial=0)))):
        member = np.flatnonzero((sizes >= band.low) & (sizes <= band.top))
        if not len(member):
            continue
        length = sizes[member]
        at = np.repeat(first[member] - np.append(0, np.cumsum(length)[:-1]), length) + np.arange(length.sum())
        # hashes are in order within a text, and so are their blocks
        block = np.repeat(np.arange(len(member)) * band.blocks, length) + ((values[at] >> np.uint64(32)) * np.uint64(band.blocks) >> np.uint64(32)).astype(np.int64)
        heads = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        code, held = np.zeros(len(member) * band.blocks, np.uint64), np.zeros(len(member) * band.blocks, np.uint64)
        code[block[heads]] = np.bitwise_xor.reduceat(codes[at], heads)
        held[block[heads]] = np.diff(np.append(heads, len(block)))
        place = np.tile(np.arange(band.blocks, dtype=np.uint64), len(member))
        with np.errstate(over="ignore"):
            keys.append(mix(code ^ mix((np.uint64(number) << np.uint64(32)) + place + held * BASE)))
        texts.append(np.repeat(member, band.blocks))
        numbers.append(np.full(len(code), number))
        spare.append(np.full(len(code), band.blocks - band.kept))
    if not keys:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    return tuple(np.concatenate(x) for x in (keys, texts, numbers, spare))


_INFO = ("n", *(f"p{i}" for i in range(PARITY_WORDS)))


class Sets:
    """The sets of the texts of a step, with their classes."""

    def __init__(self, texts: list[bytes], n: int, percent: int, clashing: list[int]) -> None:
        self.owners, self.values, self.sizes = shingle_sets(texts, n)
        self.one, self.other = classes(texts, self.owners, self.values, self.sizes, n, percent)
        hit = np.isin(self.one.view(np.int64), clashing)
        self.cls = np.where(hit, self.other, self.one)

    def only(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owners, values, sizes) of the chosen texts, numbered anew."""
        keep = chosen[self.owners]
        number = np.cumsum(chosen) - 1
        return number[self.owners[keep]], self.values[keep], self.sizes[chosen]


def _described(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, one, other, n, h1, h2) of every row: class and size of its set, and two hashes of the text."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in text_steps(batch):
                sets = Sets(as_bytes(step.column("text")), n, percent, [])
                yield pa.RecordBatch.from_arrays(
                    [step.column("doc_id"), as_long(sets.one), as_long(sets.other), pa.array(sets.sizes, pa.int64()), step.column("h1"), step.column("h2")],
                    names=["doc_id", "one", "other", "n", "h1", "h2"],
                )

    return written(docs.mapInArrow(describe, "doc_id long, one long, other long, n long, h1 long, h2 long"), "sets")


def _first(rows: DataFrame) -> DataFrame:
    """(one, other, doc_id, n) of every class with words; doc_id is the least, or null if no row has one."""
    return written(rows.filter("n > 0").groupBy("one", "other").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n")), "classes")


def _id():
    """What a row is told by, besides its class: its id (zero for null)."""
    return F.coalesce("doc_id", F.lit(0))


def _common_blocks(docs: DataFrame, firsts: KeyFilter, clashing: list[int], n: int, percent: int) -> DataFrame:
    """(key) of the blocks that several classes have, and some that only one has."""
    shipped = docs.sparkSession.sparkContext.broadcast(firsts)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in text_steps(batch):
                sets = Sets(as_bytes(step.column("text")), n, percent, clashing)
                chosen = shipped.value.has(sets.cls ^ as_unsigned(step.column("id"))) & (sets.sizes > 0)
                keys, *_ = block_keys(*sets.only(chosen), percent)
                yield pa.RecordBatch.from_arrays([as_long(keys)], names=["key"])

    keys = docs.select(_id().alias("id"), "text").mapInArrow(blocks, "key long")
    return written(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "common")


def _sketched(docs: DataFrame, info: DataFrame, firsts: KeyFilter, common: KeyFilter, clashing: list[int], n: int, percent: int) -> DataFrame:
    """(cls, n, p0, ..., keys, bands, spare, codes) of the classes that may have z + 1 common blocks in a band:
    their common blocks with band and z, and the hashes of the set, in order."""
    shipped = docs.sparkSession.sparkContext.broadcast((firsts, common))
    names = ["cls", "id", "none", *_INFO, "keys", "bands", "spare", "codes"]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, shared = shipped.value
        for batch in batches:
            for step in text_steps(batch):
                sets = Sets(as_bytes(step.column("text")), n, percent, clashing)
                chosen = first.has(sets.cls ^ as_unsigned(step.column("id"))) & (sets.sizes > 0)
                keys, text, band, spare = block_keys(*sets.only(chosen), percent)
                has = shared.has(keys)
                keys, text, band, spare = keys[has], text[has], band[has], spare[has]
                # they are in order of band and text
                heads = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (band[1:] != band[:-1]))) if len(keys) else np.zeros(0, np.int64)
                count = np.diff(np.append(heads, len(keys)))
                able = np.repeat(count > spare[heads], count) if len(keys) else np.zeros(0, bool)
                keys, text, band, spare = keys[able], text[able], band[able], spare[able]
                order = np.argsort(text, kind="stable")
                number = np.flatnonzero(chosen)[np.unique(text)]
                each = np.unique(text, return_counts=True)[1]
                left = np.zeros(len(chosen), bool)
                left[number] = True
                owners, values, sizes = sets.only(left)
                bits = parities(owners, values, len(sizes))
                yield pa.RecordBatch.from_arrays(
                    [
                        as_long(sets.cls[left]), step.column("id").take(pa.array(number)), step.column("none").take(pa.array(number)),
                        pa.array(sizes, pa.int64()), *(as_long(bits[:, i]) for i in range(PARITY_WORDS)),
                        longs(keys[order], each), longs(band[order], each), longs(spare[order], each), binaries(values, sizes),
                    ],
                    names=names,
                )

    schema = "cls long, id long, none boolean, " + ", ".join(f"{x} long" for x in _INFO) + ", keys array<long>, bands array<long>, spare array<long>, codes binary"
    rows = docs.select(_id().alias("id"), F.col("doc_id").isNull().alias("none"), "text").mapInArrow(sketch, schema)
    own = info.select("cls", _id().alias("id"), F.col("doc_id").isNull().alias("none"))
    out = written(rows.join(own, ["cls", "id", "none"], "left_semi").dropDuplicates(["cls", "id", "none"]).drop("id", "none"), "sketches")
    shipped.unpersist()
    return out


def _kept_blocks(sketches: DataFrame) -> DataFrame:
    """(key, cls): of each class and band, the s - z rarest of its s common blocks."""
    rows = sketches.select("cls", F.explode(F.arrays_zip("keys", "bands", "spare")).alias("b")).select("cls", "b.keys", "b.bands", "b.spare").withColumnRenamed("keys", "key")
    common = rows.groupBy("key").agg(F.count("*").alias("classes")).filter("classes > 1")
    own = Window.partitionBy("cls", "bands")
    ranked = rows.join(common, "key").withColumn("s", F.count("*").over(own)).withColumn("place", F.row_number().over(own.orderBy("classes", "key")))
    return written(ranked.filter(F.col("place") <= F.col("s") - F.col("spare")).select("key", "cls"), "blocks")


def _linked(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(root_a, root_b) of the pairs (a, b, root_a, root_b) whose sets link. Only sets that the pairs name are dealt out."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    sets = sketches.select("cls", "codes").join(named, "cls", "left_semi")
    a, b = (sets.select(F.col("cls").alias(x), F.col("codes").alias(f"codes_{x}")) for x in "ab")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("codes_a"), batch.column("codes_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate((x, y)))
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("root_a"), batch.column("root_b")], names=["root_a", "root_b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(a, "a").join(b, "b").select("root_a", "root_b", "codes_a", "codes_b").mapInArrow(rows, "root_a long, root_b long")


def _differ():
    """How many parities of a pair (columns p0_a, ..., p0_b, ...) differ: at most as many as n-grams."""
    return sum((F.bit_count(F.col(f"p{i}_a").bitwiseXOR(F.col(f"p{i}_b"))) for i in range(PARITY_WORDS)), F.lit(0))


def _possible(percent: int):
    """Whether the sizes and parities of a pair (and columns n_a, n_b) allow a link."""
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    return sizes & (_differ() * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent))


def _side(df: DataFrame, x: str, *more) -> DataFrame:
    return df.select(*more, F.col("cls").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in _INFO))


def _met(member: DataFrame, number: int) -> DataFrame:
    """(key, cls, root, b, root_b) of the blocks (key, cls, root) that have several components: b is a class of
    another component in the block, or null; a written table.

    In each block, the classes meet its least class by a hash, and those of that one's component the
    greatest. In the first round the hash is of the class alone, so a group of near copies meets few; then
    of the block too, so a class meets another in each block.
    """
    member = member.repartition("key").withColumn("h", F.xxhash64(F.lit(number), "key", "cls") if number else F.xxhash64("cls"))
    ends = member.groupBy("key").agg(
        F.min_by("cls", "h").alias("low"), F.min_by("root", "h").alias("low_root"), F.max_by("cls", "h").alias("high"), F.max_by("root", "h").alias("high_root"),
        F.min("root").alias("least"), F.max("root").alias("most"),
    )
    met = member.join(ends.filter("least <> most").drop("least", "most"), "key")

    def other(what: str):
        return F.when(F.col("root") != F.col("low_root"), F.col("low" + what)).when(F.col("root") != F.col("high_root"), F.col("high" + what))

    return written(met.select("key", "cls", "root", other("").alias("b"), other("_root").alias("root_b")), "met")


def _proposed(met: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """One pair (a, b) at most for each class a, with their components: of the classes that it meets, the one most alike by the parities."""
    near = met.filter("b IS NOT NULL").select(F.col("cls").alias("a"), F.col("root").alias("root_a"), "b", "root_b").distinct()
    able = near.join(_side(sketches, "b"), "b").join(_side(sketches, "a"), "a").filter(_possible(percent))
    best = F.min(F.struct((_differ() / (F.col("n_a") + F.col("n_b"))).alias("d"), "b", "root_a", "root_b"))
    return able.groupBy("a").agg(best.alias("best")).select("a", "best.b", "best.root_a", "best.root_b")


def _renamed(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with the component ``root`` that ``roots`` (node, root) puts in its place."""
    new = roots.filter("node <> root").select(F.col("node").alias("root"), F.col("root").alias("new_root"))
    return rows.join(new, "root", "left").withColumn("root", F.coalesce("new_root", "root")).drop("new_root")


def _grams(sets: DataFrame) -> DataFrame:
    """(gram, cls, root, n): a row for each n-gram of a set (cls, root, n, codes)."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in text_steps(batch, "codes"):
                codes, n = as_bytes(step.column("codes")), step.column("n").to_numpy(zero_copy_only=False)
                rest = (pa.array(np.repeat(step.column(c).to_numpy(zero_copy_only=False), n)) for c in ("cls", "root", "n"))
                yield pa.RecordBatch.from_arrays([as_long(np.frombuffer(b"".join(codes), np.uint64)), *rest], names=["gram", "cls", "root", "n"])

    return sets.select("cls", "root", "n", "codes").mapInArrow(expand, "gram long, cls long, root long, n long")


def _early(open_: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(gram, cls, root, n, rest, main) of the n-grams early enough in their set to be the first that it shares
    with one that it links with; a written table.

    N-grams of one component come first and are left out, then those of few components. ``rest`` counts a set's
    n-grams from this one on; ``main`` says whether its component is the one with most of the classes that have the n-gram.
    """
    grams = _grams(sketches.join(open_.select("cls", "root").distinct(), "cls"))
    of_root = grams.groupBy("gram", "root").agg(F.count("*").alias("classes"))
    spread = of_root.groupBy("gram").agg(F.count("*").alias("roots"), F.max_by("root", "classes").alias("most")).filter("roots > 1")
    spread = written(spread, "spread")
    own = Window.partitionBy("cls")
    placed = grams.join(spread, "gram").withColumn("rest", F.count("*").over(own) - F.row_number().over(own.orderBy("roots", "gram")) + 1)
    # of a set that it links with, any shares percent of its own size at least
    early = placed.filter(F.col("rest") * 100 >= F.col("n") * percent)
    out = written(early.select("gram", "cls", "root", "n", "rest", (F.col("root") == F.col("most")).alias("main")), "early")
    dropped(spread)
    return out


def _sharing(early: DataFrame, percent: int) -> DataFrame:
    """(a, b, root_a, root_b) of two components, a no larger than b, for each early n-gram after which enough are left in both to
    link; a pair may repeat.

    Rows meet by n-gram, step of b's size, and component: those of an n-gram's main one only others, so
    that a large component doesn't meet itself.
    """
    step = lambda n: F.floor(F.log2(n) * 6)
    largest = F.expr(f"rest * {100 + percent} DIV {percent} - n")
    side = lambda df, x: df.select("gram", "step", "main", F.col("cls").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("root", "n", "rest")))
    others = F.when(F.col("main"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    small = early.filter(F.col("rest") * (100 + percent) >= F.col("n") * 2 * percent)
    a = side(small.withColumn("step", F.explode(F.sequence(step("n"), step(largest)))).withColumn("main", F.explode(others)), "a")
    b = side(early.withColumn("step", step("n")), "b")
    enough = F.least("rest_a", "rest_b") * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent
    once = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    return a.join(b, ["gram", "step", "main"]).filter(once & enough & (F.col("root_a") != F.col("root_b"))).select("a", "b", "root_a", "root_b")


def _components(docs: DataFrame, rows: DataFrame, first: DataFrame, clashing: list[int], n: int, percent: int) -> DataFrame | None:
    """(node, root) of the classes that links put in another's component; a written table, or None if there is none."""
    spark: SparkSession = docs.sparkSession
    info = first.withColumn("cls", identity("one", "other", clashing))
    firsts = KeyFilter(info.select(F.col("cls").bitwiseXOR(_id()).alias("place")), "place")
    common = _common_blocks(docs, firsts, clashing, n, percent)
    sketches = _sketched(docs, info, firsts, KeyFilter(common, "key"), clashing, n, percent)
    dropped(common)
    blocks = _kept_blocks(sketches)

    def able(pairs: DataFrame) -> DataFrame:
        """The pairs that the bit sketch allows, once each."""
        told = pairs.distinct().join(_side(sketches, "b"), "b").join(_side(sketches, "a"), "a")
        return told.filter(_possible(percent)).select("a", "b", "root_a", "root_b")

    def joined(pairs: DataFrame) -> DataFrame | None:
        """(node, root) of the components that links among ``pairs`` join; None if there is none."""
        pairs = written(pairs, "pairs")
        links = written(_linked(pairs, sketches, percent), "links")
        roots = None if links.isEmpty() else components(links.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
        dropped(pairs, links)
        return roots

    def with_roots(groups: DataFrame | None, roots: DataFrame) -> DataFrame:
        # what is joined were roots till now, so no node of ``groups`` is among them
        new = roots.filter("node <> root")
        out = written(new if groups is None else _renamed(groups, roots).select("node", "root").unionByName(new), "groups")
        if groups is not None:
            dropped(groups)
        return out

    groups, met = None, _met(blocks.withColumn("root", F.col("cls")), 0)
    dropped(blocks)
    for number in range(MOST_ROUNDS):
        roots = joined(_proposed(met, sketches, percent))
        if roots is None:
            break
        groups, last = with_roots(groups, roots), met
        met = _met(_renamed(last.select("key", "cls", "root"), roots), number + 1)
        dropped(last, roots)
    early = _early(met, sketches, percent)
    roots = joined(able(_sharing(early, percent)))
    if roots is not None:
        groups = with_roots(groups, roots)
        dropped(roots)
    dropped(met, sketches, early)
    return groups


def _placed(docs: DataFrame, rows: DataFrame, n: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """(one, other, root, doc_id) of every class with words: its component, and its least id; the tables that it reads."""
    first = _first(rows)
    clashing = clashes(first.select("one", "other"), "one", "other")
    groups = _components(docs, rows, first, clashing, n, percent)
    placed = first.withColumn("cls", identity("one", "other", clashing))
    if groups is None:
        return placed.select("one", "other", F.col("cls").alias("root"), "doc_id"), [first]
    placed = placed.join(groups.withColumnRenamed("node", "cls"), "cls", "left")
    return placed.select("one", "other", F.coalesce("root", "cls").alias("root"), "doc_id"), [first, groups]


def _told(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and two hashes of the text, 128 bits together."""
    return two(docs, id_col, text_col).select("doc_id", "text", *text_hashes("text"))


def link_groups(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text's set is its distinct n-grams,
    all its words as one if they are fewer, nothing without words. Rows link if 100 * intersection >=
    percent * union; component_id is the least doc_id that links reach. Rows without words link with
    nothing. Repeated rows are kept and are one class. A null id has the component of its set (null
    if no row of it has an id). Empty in, empty out. A text is one step of its task, whose memory is
    some hundred times the bytes of the longest text.
    """
    docs = _told(docs, id_col, text_col)
    rows = _described(docs, n, percent)
    placed, _ = _placed(docs, rows, n, percent)
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = placed.join(least, "root").select("one", "other", "component_id")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n", "one", "other").join(of_class, ["one", "other"], "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of linked rows, the one with the least id (nulls last).

    Rows without words all stay, as do all columns, whatever their names. Of rows that are equal in id
    and text, any one stays; of those with equal id and set, the one with the least hash of its text.
    """
    told = _told(docs, id_col, text_col)
    rows = _described(told, n, percent)
    placed, used = _placed(told, rows, n, percent)
    key = ["none", "id", "h1", "h2"]
    own = rows.filter("n > 0").select("one", "other", F.col("doc_id").isNull().alias("none"), _id().alias("id"), "h1", "h2")
    best = own.join(placed.select("one", "other", "root"), ["one", "other"]).groupBy("root").agg(F.min(F.struct(*key)).alias("best")).select("best.*")
    best = written(own.join(best, key, "left_semi").groupBy(*key).agg(F.count("*").alias("copies")), "best")
    dropped(rows, *used)

    has_word = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    names = free_names(docs, key)
    whole = docs.filter(has_word).withColumns(dict(zip(names, [F.col(id_col).isNull(), F.coalesce(F.col(id_col).cast("long"), F.lit(0)), *text_hashes(text_col)], strict=True)))

    def chosen(which: str) -> DataFrame:
        return whole.join(best.filter(which).select(*(F.col(k).alias(x) for k, x in zip(key, names, strict=True))), names, "left_semi")

    kept = chosen("copies = 1").drop(*names).unionByName(docs.filter(~has_word))
    if best.filter("copies > 1").isEmpty():
        return kept
    return kept.unionByName(chosen("copies > 1").dropDuplicates(names).drop(*names))
