"""Byte-level BPE encoding and decoding.

Texts are pre-tokenised in overlapping chunks that run in parallel. Two neighbours agree from the
first pre-token boundary that both find in their overlap (the pattern looks ahead, never back, so
equal positions mean equal matches from there on); the chunks are cut there and the pieces between
the cuts are encoded, again in parallel. A text whose chunks don't resynchronise within an overlap
is encoded as one piece. Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasklode.llm.common import text_steps, two, written

#: Chars after a boundary that must be there for it to be certain: the pattern's longest look.
MARGIN = 8
_KEY = ["doc_id", "digest"]


@lru_cache(2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The ranks in ``path`` with ``pattern``, without special tokens; once per worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def added_tokens(path: str) -> dict[str, int]:
    """Ids of the added tokens in the json of the same name as the ranks file ``path``; none if there is no such json."""
    whole = f"{os.path.splitext(path)[0]}.json"
    if not os.path.exists(whole):
        return {}
    with open(whole, encoding="utf-8") as file:
        tokens = json.load(file)["added_tokens"]
    for x in tokens:
        if x["single_word"] or x["lstrip"] or x["rstrip"]:
            raise ValueError(f"the added token {x['content']!r} looks at what is around it")
    return {x["content"]: x["id"] for x in tokens}


def encode_added(enc: tiktoken.Encoding, text: str, added: dict[str, int]) -> list[int]:
    """Ids of ``text`` as the tokenizers library gives them: cut at added tokens (first, then longest), the rest encoded in parts."""
    if not any(x in text for x in added):
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for i, part in enumerate(regex.split(f"({'|'.join(map(regex.escape, sorted(added, key=len, reverse=True)))})", text)):
        ids += [added[part]] if i % 2 else enc.encode_ordinary(part)
    return ids


def packed(ids: list[int] | np.ndarray) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.asarray(ids, "<u4").tobytes()


def boundaries(text: str, pattern: str, last: bool) -> list[int]:
    """Ends of pre-tokens of a chunk that are certain and don't follow white space."""
    most = len(text) if last else len(text) - MARGIN
    return [e for m in regex.compile(pattern).finditer(text) if (e := m.end()) <= most and not text[e - 1].isspace()]


def stitch(chunks: list[tuple[list[int], list[int]]], size: int) -> list[int] | None:
    """Cuts between chunks, relative to each right-hand chunk: the first shared boundary.

    ``chunks`` has (boundaries in the head, boundaries in the tail less ``size``) of each chunk in
    order; None if two neighbours share none.
    """
    cuts = []
    for (_, tail), (head, _) in zip(chunks, chunks[1:], strict=False):
        shared = set(tail) & {0, *head}
        if not shared:
            return None
        cuts.append(min(shared))
    return cuts


def _encode_rows(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    enc = encoding(path, pattern)
    for batch in batches:
        for part in text_steps(batch):
            ids = [packed(enc.encode_to_numpy(x or "", disallowed_special=())) for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])


def _encode_long(docs: DataFrame, path: str, pattern: str, size: int, overlap: int) -> DataFrame:
    """(doc_id, ids) of texts longer than ``size`` code points, which are written once and read in parallel."""
    long = written(docs, "long").groupBy("doc_id", F.sha2("text", 256).alias("digest")).agg(F.any_value("text").alias("text"), F.count("*").alias("copies"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                text = row["text"]
                count = -(-len(text) // size)
                rows = [
                    {"doc_id": row["doc_id"], "digest": row["digest"], "k": k, "last": k == count - 1, "text": text[k * size : (k + 1) * size + overlap]}
                    for k in range(count)
                ]
                yield from pa.Table.from_pylist(rows, schema=schema).to_batches()

    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("k", pa.int32()), ("last", pa.bool_()), ("text", pa.string())])
    chunks = long.select("doc_id", "digest", "text").mapInArrow(split, "doc_id long, digest string, k int, last boolean, text string")
    chunks = chunks.repartition("doc_id", "digest", "k")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [boundaries(t, pattern, last) for t, last in zip(batch.column("text").to_pylist(), batch.column("last").to_pylist(), strict=True)]
            heads = [[x for x in b if x <= overlap] for b in found]
            tails = [[x - size for x in b if x >= size] for b in found]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in ("doc_id", "digest", "k")), pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))],
                names=["doc_id", "digest", "k", "head", "tail"],
            )

    def cut(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k")
        cuts = stitch([(list(h), list(t)) for h, t in zip(group["head"], group["tail"], strict=True)], size)
        out = group[["doc_id", "digest", "k"]].copy()
        out["start"] = [0, *cuts] if cuts is not None else 0
        out["stop"] = [*(size + c for c in cuts), -1] if cuts is not None else -1
        out["whole"] = cuts is None
        return out

    cuts = (
        chunks.mapInArrow(mark, "doc_id long, digest string, k int, head array<int>, tail array<int>")
        .groupBy("doc_id", "digest")
        .applyInPandas(cut, "doc_id long, digest string, k int, start int, stop int, whole boolean")
    )

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            rows = batch.to_pylist()
            ids = [enc.encode_ordinary(r["text"][r["start"] : None if r["stop"] < 0 else r["stop"]]) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in (*_KEY, "k")), pa.array([packed(x) for x in ids], pa.binary())], names=[*_KEY, "k", "ids"]
            )

    same = [F.col(f"c.{x}").eqNullSafe(F.col(f"t.{x}")) for x in _KEY]
    placed = cuts.alias("c").join(chunks.alias("t"), [*same, F.col("c.k") == F.col("t.k"), ~F.col("c.whole")])
    parts = placed.select("c.doc_id", "c.digest", "c.k", "c.start", "c.stop", "t.text").unionByName(
        cuts.filter("whole AND k = 0").alias("c").join(long.alias("t"), same).select("c.doc_id", "c.digest", "c.k", "c.start", "c.stop", "t.text")
    )
    encoded = (
        parts.mapInArrow(pieces, "doc_id long, digest string, k int, ids binary")
        .groupBy("doc_id", "digest")
        .agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = [b"".join(x["ids"] for x in parts) for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in _KEY), pa.array(whole, pa.binary())], names=[*_KEY, "ids"])

    return (
        encoded.mapInArrow(joined, "doc_id long, digest string, ids binary")
        .alias("c")
        .join(long.drop("text").alias("t"), same)
        .select(F.col("c.doc_id").alias("doc_id"), "c.ids", "t.copies")
        .select("doc_id", "ids", F.explode(F.sequence(F.lit(1), "copies")).alias("_"))
        .drop("_")
    )


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", size: int = 65_536, overlap: int = 2_048) -> DataFrame:
    """(doc_id, ids): each whole text's ids as little-endian unsigned 32-bit integers.

    One row per input row. A null or empty text has no ids; a null id is kept. Equal rows give
    equal rows. Texts of over ``size`` code points are encoded in chunks of ``size`` that share
    ``overlap`` code points, any other text is one chunk. An empty table gives an empty table.
    """
    docs = two(docs, id_col, text_col)
    short = docs.filter(F.coalesce(F.char_length("text"), F.lit(0)) <= size)
    once = short.mapInArrow(lambda it: _encode_rows(it, path, pattern), "doc_id long, ids binary")
    return once.unionByName(_encode_long(docs.filter(F.char_length("text") > size), path, pattern, size, overlap))


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded`` (in place of one of that name): the bytes of the ids, concatenated. Null ids give null."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            for part in text_steps(batch, ids_col):
                out = [None if x is None else enc.decode_bytes(np.frombuffer(x, "<u4").tolist()) for x in part.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=[*part.schema.names, "decoded"])

    kept = encoded.drop("decoded")
    return kept.mapInArrow(rows, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", decoded binary")
