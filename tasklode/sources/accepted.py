"""A table of accepted rows that each key enters once: published first, then marked by a commit record.

Layout under the folder: ``data/at=<n>`` has the rows that commit n added, ``keys/bucket=<b>/at=<n>`` all keys of a bucket as
of commit n, ``commits/at=<n>`` the record that makes both visible. A batch reads the last record and the one
snapshot of each bucket that its own keys fall in, so the files it reads don't grow with the table or the number of
batches; what a batch wrote before it died is overwritten when it runs again. One writer at a time.
"""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 256
#: Commit records that stay, with the snapshots that they name.
KEPT = 3


def _fs(spark: SparkSession, path: str) -> tuple[Any, Any]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the complete subfolders at=<n>, in order."""
    fs, where = _fs(spark, folder)
    if not fs.exists(where):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(where) if x.isDirectory()]
    path = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(n[3:]) for n in names if n.startswith("at=") and fs.exists(path(f"{folder}/{n}/_SUCCESS")))


def last_commit(spark: SparkSession, folder: str) -> dict[str, Any]:
    """The last record: its number, the number of each bucket's snapshot, and each writer's last batch."""
    numbers = _numbers(spark, f"{folder}/commits")
    if not numbers:
        return {"at": -1, "buckets": {}, "writers": {}, "n_buckets": None}
    return json.loads(spark.read.text(f"{folder}/commits/at={numbers[-1]}").first().value)


def _bucket(key: str, n: int):
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(n)).cast("int")


def accept(batch: DataFrame, folder: str, key: str, order: str, writer: str, number: int, buckets: int = BUCKETS) -> bool:
    """Adds the rows of ``batch`` whose key isn't there yet, the first of equal keys by ``order``; false if this writer's batch was committed before.

    Rows without a key are an error. The number of buckets is that of the first commit.
    """
    spark = batch.sparkSession
    record = last_commit(spark, folder)
    if number <= record["writers"].get(writer, -1):
        return False
    n, at = record["n_buckets"] or buckets, record["at"] + 1
    checked = F.when(F.col(key).isNotNull(), _bucket(key, n)).otherwise(F.raise_error(F.lit("a row without a key")).cast("int"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    columns = batch.columns
    rows = batch.select(F.struct(*columns).alias("row"), checked.alias("bucket"), F.col(key).alias("key"), place.alias("place")).filter("place = 1").drop("place").persist()
    try:
        touched = sorted(r.bucket for r in rows.select("bucket").distinct().collect())  # at most ``buckets``
        paths = [f"{folder}/keys/bucket={b}/at={record['buckets'][str(b)]}" for b in touched if str(b) in record["buckets"]]
        there = spark.read.schema(rows.select("key", "bucket").schema).parquet(*paths) if paths else rows.select("key", "bucket").limit(0)
        fresh = rows.join(there.select("key"), "key", "left_anti")
        # published: the rows, and the new snapshot of each bucket in one file or a few
        fresh.select("row.*").write.mode("overwrite").parquet(f"{folder}/data/at={at}")
        whole = there.unionByName(fresh.select("key", "bucket")).repartition("bucket").withColumn("to", F.col("bucket"))
        whole.write.mode("overwrite").partitionBy("to").parquet(f"{folder}/next/at={at}")
        fs, path = _fs(spark, folder)[0], spark._jvm.org.apache.hadoop.fs.Path
        for b in touched:
            target = path(f"{folder}/keys/bucket={b}/at={at}")
            fs.delete(target, True)
            fs.mkdirs(target.getParent())
            fs.rename(path(f"{folder}/next/at={at}/to={b}"), target)
        fs.delete(path(f"{folder}/next/at={at}"), True)
    finally:
        rows.unpersist()
    # marked
    record = {"at": at, "n_buckets": n, "buckets": record["buckets"] | {str(b): at for b in touched}, "writers": record["writers"] | {writer: number}}
    text = json.dumps(record, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/commits/at={at}")
    _forget(spark, folder, touched, record)
    return True


def _forget(spark: SparkSession, folder: str, touched: list[int], record: dict[str, Any]) -> None:
    """Deletes old records, and the snapshots of this batch's buckets that no kept record names."""
    fs, path = _fs(spark, folder)[0], spark._jvm.org.apache.hadoop.fs.Path
    numbers = _numbers(spark, f"{folder}/commits")
    for n in numbers[:-KEPT]:
        fs.delete(path(f"{folder}/commits/at={n}"), True)
    oldest = numbers[-KEPT:][0]
    for b in touched:
        own = sorted(int(x.getPath().getName()[3:]) for x in fs.listStatus(path(f"{folder}/keys/bucket={b}")))
        # the snapshot that the oldest kept record names is the last one up to it
        named = max((n for n in own if n <= oldest), default=-1)
        for n in own:
            if n < named:
                fs.delete(path(f"{folder}/keys/bucket={b}/at={n}"), True)


def accepted(spark: SparkSession, folder: str) -> DataFrame:
    """All committed rows; rows of a batch that hasn't been committed aren't seen. Nothing committed is an error."""
    top = last_commit(spark, folder)["at"]
    if top < 0:
        raise ValueError(f"nothing is committed in {folder}")
    return spark.read.option("basePath", f"{folder}/data").parquet(f"{folder}/data").filter(F.col("at") <= top).drop("at")


def writer_of(checkpoint: str) -> str:
    """A stream's name: its checkpoint's, as batches are numbered there."""
    return hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
