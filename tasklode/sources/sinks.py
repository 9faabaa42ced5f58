"""Writers: atomic small documents, manifests, exclusive and idempotent outputs, event logs and reports."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tasklode.functions.hashing import canonical_hash, ordered_hash
from tasklode.functions.names import free
from tasklode.functions.text import log_value


def atomic_json(path: str | Path, value: Any) -> None:
    """A small document with sorted keys, complete or not there: a synced temporary file, then a rename."""
    path = Path(path)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(value, f, ensure_ascii=False, indent=2, sort_keys=True, allow_nan=False)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def write_once(path: str | Path, value: Any) -> bool:
    """Writes a document that isn't there yet; an equal one is left alone, a different one is an error."""
    path = Path(path)
    if path.exists():
        if canonical_hash(json.loads(path.read_text(encoding="utf-8"))) != canonical_hash(value):
            raise FileExistsError(f"{path} has other content")
        return False
    atomic_json(path, value)
    return True


def write_exclusive(df: DataFrame, path: str, rows_per_file: int = 0) -> None:
    """JSON lines to a new folder; one that exists is an error. ``rows_per_file`` bounds a file (0: doesn't)."""
    df.write.mode("errorifexists").option("maxRecordsPerFile", rows_per_file).json(path)


def artifacts(spark: SparkSession, folder: str, schema: str, key: str) -> DataFrame:
    """The current row of each key that ``save_artifacts`` left in a folder; none if there is no folder yet.

    The versions are JSON lines in folders ``version=N``, one a save; of a key the greatest finished version counts, by partial maxima.
    """
    (version,) = free([f.name for f in StructType.fromDDL(schema)], wanted=["version"])
    done = [f"{folder}/version={n}" for n, finished in _versions(spark, folder).items() if finished]
    if not done:
        return spark.createDataFrame([], schema)
    files = spark.read.schema(schema).json(done)
    rows = files.withColumn(version, F.regexp_extract(F.col("_metadata.file_path"), r"/version=([0-9]+)/", 1).cast("long"))
    return rows.groupBy(key).agg(F.max_by(F.struct(*files.columns), version).alias("r")).select("r.*")


def _versions(spark: SparkSession, folder: str) -> dict[int, bool]:
    """The versions in a folder of artifacts, and whether each is finished (its job left ``_SUCCESS``)."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    there = path(folder)
    system = there.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(there)] if system.exists(there) else []
    return {int(n.removeprefix("version=")): system.exists(path(f"{folder}/{n}/_SUCCESS")) for n in names if n.startswith("version=")}


def save_artifacts(rows: DataFrame, folder: str, key: str, update: bool = False) -> int:
    """Saves artifacts under their keys as the next version; returns it. One writer at a time.

    A null key, a key twice in ``rows``, or (without ``update``) one that is there already is an error, and nothing is written; with ``update`` a new
    version replaces those that are there. What marks a version as finished is written last, so a version counts whole or not at all.
    """
    spark = rows.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    held = artifacts(spark, folder, schema, key).select(key)
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    bad = counts.filter((F.col("n") > 1) | F.col(key).isNull()).select(key)
    if not update:
        bad = bad.unionByName(counts.join(held, key, "left_semi").select(key))
    found = bad.limit(1).collect()
    if found:
        raise FileExistsError(f"{key} {found[0][0]!r} is null, repeated, or there already")
    version = 1 + max(_versions(spark, folder), default=0)
    rows.write.mode("errorifexists").json(f"{folder}/version={version}")
    return version


def write_manifest(tasks: DataFrame, position: str, folder: str, metadata: dict[str, str]) -> str:
    """Tasks in order as JSON lines with their ordered-id hash beside; returns the hash."""
    digest = tasks.agg(ordered_hash("task_id", position).alias("h")).first().h
    tasks.repartitionByRange(position).sortWithinPartitions(position).write.mode("errorifexists").json(f"{folder}/tasks")
    _document(tasks.sparkSession, {**metadata, "task_ids_sha256": digest}, f"{folder}/metadata")
    return digest


def _document(spark: SparkSession, value: Any, folder: str) -> None:
    """A small JSON document as a folder of one text file, wherever Spark can write."""
    text = json.dumps(value, ensure_ascii=False, sort_keys=True, allow_nan=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(folder)


def file_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """(name, bytes, sha256) of the files that a writer left in a folder, of their bytes as written."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def freeze(
    rows: DataFrame, reason: str, tokens: str, folder: str, thresholds: tuple[int, ...] = (8192, 16384, 24576, 32768), selected: tuple[str, ...] = (), facts: dict[str, Any] | None = None,
    sources: DataFrame | None = None, rows_per_file: int = 100_000,
) -> dict[str, Any]:
    """Writes kept rows (train), their ``selected`` columns (selection), the hashes of all these files and a manifest; refuses an existing folder.

    The manifest has the counts by reason, token statistics, an order-free checksum of what was kept, ``facts``, and for each
    part the number, bytes and hash of its files: the SHA-256 of their SHA-256s in order. ``sources`` (path, sha256) are the
    artifacts that the rows came from; they are kept beside and hashed in order of their paths. The manifest is written last:
    a folder without one is not a frozen set. Files are read back as they were written, ``rows_per_file`` rows each, so a
    task holds one file. All of it goes where Spark writes, never to the driver's disk.
    """
    spark = rows.sparkSession
    kept = rows.filter(F.col(reason).isNull()).drop(reason)
    parts = {"train": kept} | ({"selection": kept.select(*selected)} if selected else {})
    if sources is not None:
        parts["sources"] = sources.select("path", "sha256").distinct()
    told = {}
    for name, part in parts.items():
        write_exclusive(part, f"{folder}/{name}", rows_per_file)
        write_exclusive(file_hashes(spark, f"{folder}/{name}"), f"{folder}/hashes/{name}")
        told[name] = _digest_of(spark, folder, name)
    if sources is not None:
        told["sources"]["paths_sha256"] = parts["sources"].agg(ordered_hash("sha256", "path").alias("h")).first().h
    reasons = {r[reason] or "kept": r["count"] for r in rows.groupBy(reason).count().collect()}
    quantiles = F.percentile(tokens, F.array(*map(F.lit, (0.5, 0.75, 0.9, 0.95, 0.99)))).alias("q")
    over = (F.count_if(F.col(tokens) > t).alias(f"over_{t}") for t in thresholds)
    sums = kept.agg(F.count("*").alias("n"), F.min(tokens).alias("min"), quantiles, F.max(tokens).alias("max"), F.avg(tokens).alias("mean"), *over).first().asDict()
    text = F.to_json(F.struct(*kept.columns))
    checksum = kept.agg(F.bit_xor(F.xxhash64(text)).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), text)).alias("b")).first()
    manifest = {"reasons": reasons, "tokens": sums, "content_checksum": [checksum.a or 0, checksum.b or 0], "parts": told, **(facts or {})}
    _document(spark, manifest, f"{folder}/manifest")
    return manifest


def _digest_of(spark: SparkSession, folder: str, part: str) -> dict[str, Any]:
    """Number, bytes and hash of a part's files, by the hashes kept beside it."""
    hashes = spark.read.schema("name string, bytes long, sha256 string").json(f"{folder}/hashes/{part}")
    row = hashes.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), ordered_hash("sha256", "sha256").alias("sha256")).first()
    return row.asDict()


def frozen_manifest(spark: SparkSession, folder: str) -> dict[str, Any]:
    """The manifest of a frozen set; a folder without one was never finished, which is an error."""
    return json.loads(spark.read.text(f"{folder}/manifest").first().value)


def frozen_problems(spark: SparkSession, folder: str) -> DataFrame:
    """(part, name, problem): files of a frozen set that are changed, missing or more than were written; a part whose list of
    hashes isn't the manifest's has a row without a name. Empty if all is as it was written."""
    out = spark.createDataFrame([], "part string, name string, problem string")
    for part, want in frozen_manifest(spark, folder)["parts"].items():
        now, then = file_hashes(spark, f"{folder}/{part}"), spark.read.schema("name string, bytes long, sha256 string").json(f"{folder}/hashes/{part}")
        both = now.select("name", F.col("sha256").alias("now")).join(then.select("name", F.col("sha256").alias("then")), "name", "full")
        problem = F.when(F.col("now").isNull(), "missing").when(F.col("then").isNull(), "not in the list").when(F.col("now") != F.col("then"), "changed")
        out = out.unionByName(both.select(F.lit(part).alias("part"), "name", problem.alias("problem")).filter("problem IS NOT NULL"))
        if {k: v for k, v in want.items() if k != "paths_sha256"} != _digest_of(spark, folder, part):
            out = out.unionByName(spark.createDataFrame([(part, None, "list differs from the manifest")], out.schema))
    return out


def invalidate(path: str | Path, reason: str, version: str, at: str, status: str = "invalidated_by_implementation_bug") -> list[tuple[str, str]]:
    """Marks a run's manifest as invalid; returns the (key, value) rows for its run state. A mark that is there keeps its time and reason."""
    path = Path(path)
    manifest = json.loads(path.read_text(encoding="utf-8"))
    marks = {"invalidated_at": at, "invalidation_reason": reason, "invalidation_code_version": version}
    manifest = {**marks, **manifest, "status": status}
    atomic_json(path, manifest)
    return [("status", status), *((k, str(manifest[k])) for k in marks)]


def append_events(events: DataFrame, path: str) -> None:
    """Appends JSON lines; NaN or infinity in a double column is an error."""
    for f in events.schema:
        if f.dataType.simpleString() in ("double", "float"):
            bad = F.isnan(f.name) | (F.abs(f.name) == float("inf"))
            events = events.withColumn(f.name, F.when(bad, F.raise_error(F.lit("not a number")).cast("double")).otherwise(F.col(f.name)))
    events.write.mode("append").json(path)


def append_log(events: DataFrame, time: str, event: str, fields: list[str], path: str) -> None:
    """Appends ``time event key=value ...`` lines with safe values."""
    parts = [F.col(time).cast("string"), log_value(event), *(F.concat(F.lit(f"{c}="), log_value(F.col(c).cast("string"))) for c in fields)]
    events.select(F.concat_ws(" ", *parts).alias("value")).write.mode("append").text(path)


def current_rows(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The current row of each key of an append-only log of versions (last write wins)."""
    whole = F.struct(*log.columns)
    return log.groupBy(key).agg(F.max_by(whole, F.struct(*order)).alias("r")).select("r.*")


def markdown(rows: DataFrame, title: str, most: int = 1000) -> str:
    """A small result as a Markdown table; more than ``most`` rows are an error."""
    def shown(x: Any) -> str:
        return "-" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x)

    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows for the table {title!r}")
    names = rows.columns
    lines = [f"## {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join([*lines, *("| " + " | ".join(shown(r[n]) for n in names) + " |" for r in rows.limit(most).collect())]) + "\n"
