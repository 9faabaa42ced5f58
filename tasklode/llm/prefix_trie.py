"""The trie of conversations' prefixes, by names of power-of-two blocks of turns.

Equal turns get a dense name; a block of 2 ** (k + 1) turns is named by the pair of the names of its halves,
in a join for each power. A prefix is named by the pair of a shorter prefix's name and a block's, following the
binary digits of its length from the highest: lengths whose lowest digit is 2 ** k are named in round k, so each
prefix and each block at a multiple of its own length is named once, and the rounds grow with the logarithm of
the longest conversation. Equal names are equal prefixes, that is nodes.

A node's least member also is the least of the node's descendants on its own path, so every conversation owns
one path of nodes; sums over a subtree are sums over its members of what they own below, and need no walk.

No conversation and no node is gathered in one task: places come from sampled ranges, sums along a
conversation from blocks of turns, and ids of a node are hashed from joined stretches in a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tasklode.llm.common import dropped, written

WORDS = r"[^\x20\x09-\x0D]+"
#: Turns of a conversation whose sums one window takes, as a power of two.
BLOCK = 10
#: Bits of a name below those of its round.
_NAME_BITS = 56
_WITHIN = (1 << 33) - 1
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_BEFORE = (Window.unboundedPreceding, -1)


def _placed(df: DataFrame) -> DataFrame:
    """With the number of the task that holds a row, and the row's place there."""
    return df.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id().bitwiseAND(F.lit(_WITHIN))})


def ordered(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Written tables (c, pos, key, words) of the turns and (c, length) of the conversations.

    Turns are in order of their number, null first, then of their role and a digest of role and text, so that
    equal numbers have one order; ``pos`` is from 0. Null roles and texts are empty. Rows without a conversation's id
    belong to none and are left out; repeated rows are turns of their own. ``key`` is a SHA-256 of role and text.
    """
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in (role_col, text_col))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.select(
        F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("turn"), role.alias("role"), key.alias("key"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"), F.monotonically_increasing_id().alias("row"),
    ).filter("c IS NOT NULL")
    order = ["c", F.col("turn").asc_nulls_first(), "role", "key", "row"]
    dealt = written(_placed(turns.repartitionByRange(*order).sortWithinPartitions(*order)).select("c", "key", "words", "part", "place"), "turns")
    own = Window.partitionBy("c")
    parts = dealt.groupBy("c", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    starts = written(
        parts.select("c", "part", (F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(*_BEFORE)), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(own).alias("length")),
        "starts",
    )
    placed = written(dealt.join(starts.drop("length"), ["c", "part"]).select("c", (F.col("place") + F.col("shift")).alias("pos"), "key", "words"), "placed")
    lengths = written(starts.select("c", "length").distinct(), "lengths")
    dropped(dealt, starts)
    return placed, lengths


def shared_heads(turns: DataFrame, lengths: DataFrame, group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """(c, pos, key, words, length) and (c, length), both written, after each conversation took over a head.

    Conversation c gets the first h turns of conversation c - c % group (as many as that has), and after them its
    own turns from its turn h on, where h is the unsigned CRC-32 of its decimal id modulo ``heads``.
    """
    h = F.crc32(F.col("c").cast("string").cast("binary")) % heads
    told = lengths.select("c", "length", h.alias("h"), (F.col("c") - F.col("c") % group).alias("base"))
    other = lengths.select(F.col("c").alias("base"), F.col("length").alias("base_length"))
    told = told.join(other, "base", "left").withColumn("b", F.least("h", F.coalesce("base_length", F.lit(0))))
    told = written(told.select("c", "base", "h", "b", (F.col("b") + F.greatest(F.col("length") - F.col("h"), F.lit(0))).alias("length")), "shapes")
    blocks = (F.col("pos") / (1 << BLOCK)).cast("long")
    # a conversation's shape meets its turns block by block, so that a long one is no single key
    every = told.join(lengths.select("c", F.col("length").alias("own")), "c").select(
        "c", "h", "b", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("own") - 1, BLOCK))).alias("block")
    )
    rest = turns.withColumn("block", blocks).join(every, ["c", "block"]).filter("pos >= h").select("c", (F.col("pos") - F.col("h") + F.col("b")).alias("pos"), "key", "words", "length")
    first = turns.filter((F.col("pos") < heads - 1) & (F.col("c") % group == 0)).select(F.col("c").alias("base"), "pos", "key", "words")
    taken = told.filter("b > 0").join(first, "base").filter("pos < b").select("c", "pos", "key", "words", "length")
    rebuilt, shapes = written(rest.unionByName(taken), "rebuilt"), written(told.select("c", "length"), "lengths")
    dropped(told)
    return rebuilt, shapes


def _named(values: DataFrame, round_: int) -> DataFrame:
    """Distinct rows of ``values`` with a name: dense numbers from 0, over the number of the round; written."""
    found = written(_placed(values.distinct()), "names")
    counts = found.groupBy("part").agg(F.count("*").alias("n"))
    base = counts.select("part", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(*_BEFORE)), F.lit(0)).alias("base"))  # a row a task
    named = found.join(F.broadcast(base), "part").withColumn("name", F.col("base") + F.col("place") + F.lit(round_ << _NAME_BITS))
    named = named.select(*values.columns, "name")
    named.written_to = found.written_to
    return named


def _blocks(turns: DataFrame, longest: int) -> list[DataFrame]:
    """Written (c, j, name, words, length) of each power: names of blocks j and the words of their last turns."""
    names = _named(turns.select("key"), 0)
    out = [written(turns.join(names, "key").select("c", F.col("pos").alias("j"), "name", "words", "length"), "blocks")]
    dropped(names)
    for k in range(1, longest.bit_length()):
        odd = F.col("j") % 2 == 1
        halves = out[-1].filter(F.col("length") >= 1 << k).groupBy("c", F.shiftright("j", 1).alias("j")).agg(
            F.max(F.when(~odd, F.col("name"))).alias("left"), F.max(F.when(odd, F.col("name"))).alias("right"),
            F.max(F.when(odd, F.col("words"))).alias("words"), F.max("length").alias("length"),
        ).filter("right IS NOT NULL")
        names = _named(halves.select("left", "right"), k)
        out.append(written(halves.join(names, ["left", "right"]).select("c", "j", "name", "words", "length"), "blocks"))
        dropped(names)
    return out


def _prefixes(turns: DataFrame, longest: int) -> list[DataFrame]:
    """Written parts of (c, depth, name, words, length): the name of each conversation's prefix of each length from 1."""
    blocks, done = _blocks(turns, longest), []
    for k in reversed(range(len(blocks))):
        even = blocks[k].filter(F.col("j") % 2 == 0).select("c", F.shiftleft("j", k).alias("from"), F.shiftleft(F.col("j") + 1, k).alias("depth"), F.col("name").alias("block"), "words", "length")
        told = even.filter("from = 0").withColumn("prefix", F.lit(-1).cast("long"))
        if done:
            before = reduce(DataFrame.unionByName, done).select("c", F.col("depth").alias("from"), F.col("name").alias("prefix"))
            told = told.unionByName(even.filter("from > 0").join(before, ["c", "from"]))
        names = _named(told.select("prefix", "block"), k)
        done.append(written(told.join(names, ["prefix", "block"]).select("c", "depth", "name", "words", "length"), "prefixes"))
        dropped(names)
    dropped(*blocks)
    return done


def _digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of (conv_id, depth, c): the SHA-256 of each node's joined ids in order.

    Ranges of nodes and ids are joined where they lie; a node's stretches then pass through one hash in a stream, so
    a task holds a stretch at a time, however many ids a node has.
    """

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[int, int], list[int]] = {}
            for conv, depth, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                found.setdefault((conv, depth), []).append(c)
            rows = [(conv, depth, own[0], ",".join(map(str, own))) for (conv, depth), own in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["conv_id", "depth", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            out = []
            for conv, depth, ids in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "depth", "ids")), strict=True):
                if (conv, depth) != now:
                    if now is not None:
                        out.append((*now, digest.hexdigest()))
                    now, digest = (conv, depth), hashlib.sha256(ids.encode())
                else:
                    digest.update(f",{ids}".encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["conv_id", "depth", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_pydict({"conv_id": [now[0]], "depth": [now[1]], "ends_sha256": [digest.hexdigest()]})

    order = ["conv_id", "depth", "c"]
    dealt = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(stretches, "conv_id long, depth long, first long, ids string")
    return dealt.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first").mapInArrow(hashed, "conv_id long, depth long, ends_sha256 string")


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of all prefixes of conversations with (c, pos, key, words, length) and (c, length); see ``NODES``.

    A node is told by its least member and its depth. Conversations without turns are members of the root alone; no
    conversations, no rows.
    """
    told = lengths.agg(F.min("c").alias("root"), F.max("length").alias("longest")).first()
    if told.root is None:
        return lengths.sparkSession.createDataFrame([], NODES)
    root, empty = F.lit(told.root).cast("long"), F.lit(hashlib.sha256(b"").hexdigest())
    parts = _prefixes(turns, told.longest)
    if not parts:  # all are without turns
        parts = [written(turns.select("c", F.col("pos").alias("depth"), F.col("pos").alias("name"), "words", "length"), "prefixes")]
    prefixes = reduce(DataFrame.unionByName, parts)
    nodes = written(prefixes.groupBy("name").agg(F.min("c").alias("rep"), F.count("*").alias("n"), F.max("length").alias("longest")), "nodes")
    own, leaf = F.col("c") == F.col("rep"), F.col("longest") == F.col("depth")
    members = written(
        prefixes.join(nodes, "name").select(
            "c", "depth", "rep", (F.col("depth") == F.col("length")).alias("ends"), own.alias("own"), (own & leaf).cast("long").alias("leaf"),
            F.when(own, (F.col("n") - 1) * F.col("words")).otherwise(0).alias("saved"), F.shiftright(F.col("depth") - 1, BLOCK).alias("block"),
        ),
        "members",
    )
    dropped(nodes, *parts)

    conv = Window.partitionBy("c")
    blocks = members.groupBy("c", "block").agg(F.sum("saved").alias("s"), F.max("leaf").alias("l"), F.max_by("rep", "depth").alias("last"))
    blocks = blocks.select(
        "c", "block", F.coalesce(F.sum("s").over(conv.orderBy(F.desc("block")).rowsBetween(*_BEFORE)), F.lit(0)).alias("later"),
        F.sum("s").over(conv).alias("total"), F.max("l").over(conv).alias("leaves"), F.lag("last").over(conv.orderBy("block")).alias("rep_before"),
    )
    down = Window.partitionBy("c", "block").orderBy(F.desc("depth"))
    below = members.join(blocks, ["c", "block"]).select(
        "rep", "depth", "leaves",
        F.when(F.col("own"), F.col("later") + F.sum("saved").over(down)).otherwise(F.col("total")).alias("saved"),
        F.when(F.col("own"), F.coalesce(F.lead("rep").over(down), "rep_before", root)).alias("parent"),
    )
    found = below.groupBy(F.col("rep").alias("conv_id"), "depth").agg(
        F.max("parent").alias("parent_conv_id"), F.count("*").alias("n_convs"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")
    )
    all_ = lengths.agg(F.count("*").alias("n_convs")).crossJoin(members.agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved")))  # one row each
    top = all_.select(
        root.alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs",
        F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"),
    )
    found = written(found.unionByName(top), "found")
    children = found.filter("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    ends = members.filter("ends").select(F.col("rep").alias("conv_id"), "depth", "c")
    ends = ends.unionByName(lengths.filter("length = 0").select(root.alias("conv_id"), F.lit(0).cast("long").alias("depth"), "c"))
    out = found.join(children, ["conv_id", "depth"], "left").join(_digests(ends), ["conv_id", "depth"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", empty).alias("ends_sha256"),
    )
