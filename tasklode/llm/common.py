"""What the operators share: tables in the cluster's shared folder, filters of keys, and word hashes of a batch."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step handles; temporaries are some tens of times this.
STEP_BYTES = 1 << 19
_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only in local mode (tests), where one machine does all."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="tasklode-"))
    return f"file://{_own_dir[0]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, reread: the lineage is cut there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more: what was made of them is written too."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def two(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id (as long) and the text, so that further columns can have any name."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def text_hashes(text_col: str) -> list:
    """Two 64-bit hashes h1 and h2 of a text (null is empty), 128 bits together, as columns."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2")]


def free_names(df: DataFrame, wanted: list[str]) -> list[str]:
    """Names for further columns that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    return [next(x for k in range(1, 100) if (x := "_" * k + name).lower() not in taken) for name in wanted]


def text_steps(batch: pa.RecordBatch, column: str = "text", step: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of about ``step`` bytes of text each; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, start = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > step:
            yield batch.slice(start, i - start)
            total, start = 0, i
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def as_unsigned(column: pa.Array) -> np.ndarray:
    """A column of longs without nulls as uint64."""
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Neighbouring stretches of ``data``, of ``sizes`` items each, as a binary column."""
    ends = np.append(0, np.cumsum(sizes)) * data.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def longs(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """As ``binaries``, as lists of longs."""
    ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(data).view(np.int64)))


#: Bits of a filter of keys: 16 a key within these bounds.
LEAST_FILTER, MOST_FILTER = 20, 28


class KeyFilter:
    """A bit filter of long keys (spread evenly): false for most that aren't in it. Its size is bounded
    whatever the number of keys (at most 32 MB), and what passes wrongly is for a later step to drop."""

    def __init__(self, keys: DataFrame, key: str) -> None:
        bits = min(MOST_FILTER, max(LEAST_FILTER, (16 * keys.count()).bit_length()))
        place = F.pmod(F.col(key), F.lit(1 << bits)) + 1
        rows = keys.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
        self.low = np.uint64((1 << bits) - 1)
        self.map = np.zeros(1 << bits >> 3, np.uint8)
        for r in rows.collect():
            at = (r["k"] - 1) * 4096
            self.map[at : at + 4096] = np.frombuffer(r["m"], np.uint8)[: len(self.map) - at]

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Of an array of uint64."""
        p = (keys & self.low).astype(np.int64)
        return (self.map[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)


#: Clashes of 64-bit numbers that the driver may hold.
MOST_CLASHES = 100_000


def clashes(numbered: DataFrame, first: str, second: str) -> list[int]:
    """The values of ``first`` that stand with several of ``second``, of distinct rows.

    Together the two are an identity of 128 bits; where ``first`` clashes, ``second`` is used in its
    place, so one long tells rows apart. About n * n / 2 ** 65 values clash by chance, which is none up
    to billions of rows.
    """
    found = [r[0] for r in numbered.groupBy(first).agg(F.count("*").alias("n")).filter("n > 1").select(first).limit(MOST_CLASHES + 1).collect()]
    if len(found) > MOST_CLASHES:
        raise ValueError("too many clashes of 64-bit hashes")
    return found


def identity(first: str, second: str, clashing: list[int]):
    """The one long, as a column."""
    return F.when(F.col(first).isin(clashing), F.col(second)).otherwise(F.col(first)) if clashing else F.col(first)


def with_column(batch: pa.RecordBatch, column: str, values: pa.Array) -> pa.RecordBatch:
    """``batch`` with other values in a column that it has."""
    at = batch.schema.get_field_index(column)
    return batch.set_column(at, batch.schema.field(at), values)


#: Odd multipliers and mixing constants of 64-bit hashes.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; every output bit depends on every input bit."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= MIX_A
    x ^= x >> np.uint64(27)
    x *= MIX_B
    x ^= x >> np.uint64(31)
    return x


_kept_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: np.uint64) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept by the worker."""
    kept = _kept_powers.get(int(base))
    if kept is None or len(kept) < n:
        kept = np.full(max(n, STEP_BYTES + 1), base, np.uint64)
        kept[0] = 1
        np.cumprod(kept, out=kept)
        if n <= 2 * STEP_BYTES:
            _kept_powers[int(base)] = kept
    return kept[:n]


INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: A value of full 64 bits for each byte, so that a sum of powers spreads at once.
BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` of the texts, in order.

    Returns a 64-bit hash, start and end (in the texts joined by a newline) of each word, and
    the index of its text. ``lower`` maps A-Z to a-z first.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    n = len(data)
    with np.errstate(over="ignore"):
        values = BYTE_HASH[_LOWER[data] if lower else data]
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(n, BASE), out=total[1:])
        back = powers(n + 1, INVERSE)
        hashes = mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    owner = np.searchsorted(np.cumsum(lengths), starts, "right")
    return hashes, starts, ends, owner
