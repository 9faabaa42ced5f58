"""Best-fit packing of documents into sequences, planned over the histogram of lengths.

Only the counts of pieces by length (at most ``capacity`` of them, whatever the input) reach the
driver. Best fit over the counts gives runs: pieces of one length, by rank, take the same place in
consecutive sequences. Pieces get their rank within their length without meeting in one task
(ranks within a salt, plus the count of the salts before), and take their slot by joining on its block of ranks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tasklode.llm.bpe import added_tokens, encode_added, encoding
from tasklode.llm.common import two, written

#: Pieces of one length that one task ranks, about.
RANKED_TOGETHER = 100_000
LEAST_SALTS = 64
#: Rows of the plan up to which it is broadcast; beyond it is joined by a shuffle.
BROADCAST_RUNS = 500_000
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first, over counts by length: runs (length, first rank, pieces, first sequence, offset).

    Open sequences are kept as ranges by the room they have left; a step fills a whole range, so
    the work depends on the number of lengths, not on that of the pieces.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    rooms: list[int] = []  # sorted
    open_: dict[int, list[tuple[int, int]]] = {}
    used = 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in open_:
                insort(rooms, room)
                open_[room] = []
            open_[room].append((first, n))

    for length in sorted((x for x in counts if counts[x] > 0), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens doesn't fit in {capacity}")
        left, rank = counts[length], 0
        while left:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, n = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[i]
            else:
                room, first, n = capacity, used, -(-left // (capacity // length))
                used += n
            each = min(room // length, left)  # the tightest room is the one just used
            full = min(n, left // each)
            for layer in range(each):
                runs.append((length, rank, full, first, capacity - room + layer * length))
                rank += full
            left -= full * each
            put(room - each * length, first, full)
            put(room, first + full, n - full)
    return runs


def widths(runs: list[tuple[int, int, int, int, int]], counts: dict[int, int]) -> dict[int, int]:
    """Ranks in a block, by length: as many blocks as runs, so that a piece meets only the few runs of its block."""
    of_length = Counter(r[0] for r in runs)
    return {length: -(-counts[length] // n) for length, n in of_length.items()}


def by_block(runs: list[tuple[int, int, int, int, int]], width: dict[int, int]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, block, first rank, pieces, first sequence, offset): each run in every block of ranks that it reaches;
    at most twice as many as runs."""
    out = []
    for length, first, n, sequence, offset in runs:
        w = width[length]
        out += [(length, block, first, n, sequence, offset) for block in range(first // w, (first + n - 1) // w + 1)]
    return out


def pieces_of(docs: DataFrame, path: str, pattern: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each piece; only the first may be short of ``capacity``."""
    added = added_tokens(path)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.array([*encode_added(enc, text or "", added), end_id], "<u4")
                first = len(ids) % capacity or min(len(ids), capacity)
                bounds = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    for column, x in zip(out, (doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())), strict=True):
                        column.append(x)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return two(docs, id_col, text_col).mapInArrow(rows, _PIECE)


def pack(docs: DataFrame, path: str, pattern: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Added tokens of the vocabulary (in the json beside ``path``) are matched inside texts. A document is its ids and ``end_id``, so a null or empty text is one piece of length 1. Rows
    with equal ids are separate documents; null ids are kept. Ties in length are ranked by a hash of
    the row, so pieces of one length can change places. Very long texts are many pieces. Empty in, empty out.
    """
    spark = docs.sparkSession
    found = pieces_of(docs, path, pattern, capacity, end_id, id_col, text_col)
    # a row's own number is in its hash, so that equal rows don't share one
    pieces = written(found.withColumn("own", F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = plan(histogram, capacity)
    width = widths(runs, histogram)
    runs = by_block(runs, width)
    wide = F.broadcast(spark.createDataFrame(list(width.items()), "w_length long, width long"))  # a row for each length
    slots = spark.createDataFrame(runs or [(0,) * 6], "run_length long, run_block long, first_rank long, run_pieces long, first_sequence long, run_offset long")
    if len(runs) <= BROADCAST_RUNS:
        slots = F.broadcast(slots)

    salts = LEAST_SALTS + sum(histogram.values()) // RANKED_TOGETHER
    salted = pieces.withColumn("salt", F.pmod("own", F.lit(salts)))
    of_length = Window.partitionBy("length")
    before = (
        salted.groupBy("length", "salt")
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(of_length.orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
        .join(wide, F.col("length") == F.col("w_length"))
        .select(F.col("length").alias("b_length"), F.col("salt").alias("b_salt"), F.coalesce("before", F.lit(0)).alias("before"), "width")
    )
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "own")
    ranked = (
        salted.withColumn("within", F.row_number().over(within) - 1)
        .join(before, (F.col("length") == F.col("b_length")) & (F.col("salt") == F.col("b_salt")))
        .withColumn("rank", F.col("before") + F.col("within"))
        .withColumn("block", F.floor(F.col("rank") / F.col("width")))
    )
    same = (F.col("length") == F.col("run_length")) & (F.col("block") == F.col("run_block"))
    here = same & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("run_pieces"))
    return ranked.join(slots, here).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"),
        F.col("run_offset").alias("offset"),
    )
