"""Catalogs, manifests, artifact folders, logs and small driver-side files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tasklode.functions.hashing import ordered_hash

TASK = "task_id string, scenario string, official_split string, source_index long, domain string, category string"


def json_array(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Records of a file that is one JSON array (plain or .gz), with position; anything else is an error.

    One file can't be split; it is read once and dealt out.
    """
    ddl = schema if isinstance(schema, str) else schema.simpleString()
    raw = spark.read.text(path, wholetext=True)
    kept = F.ltrim(F.regexp_replace("value", "^﻿", ""))
    checked = F.when(F.substr(kept, F.lit(1), F.lit(1)) == "[", F.col("value")).otherwise(F.raise_error(F.lit("expected a JSON array")).cast("string"))
    kind = f"array<{ddl}>" if ddl.startswith("struct") else f"array<struct<{ddl_to_fields(ddl)}>>"
    rows = raw.select(F.posexplode(F.from_json(checked, kind, {"mode": "FAILFAST"})).alias("position", "r"))
    return rows.repartition(max(1, spark.sparkContext.defaultParallelism)).select(F.col("position").cast("long"), "r.*")


def ddl_to_fields(ddl: str) -> str:
    """``a string, b array<x>`` as the fields of a struct type."""
    return StructType.fromDDL(ddl).simpleString().removeprefix("struct<").removesuffix(">")


def manifest(spark: SparkSession, path: str, expected_count: int | None = None, expected_hash: str | None = None) -> DataFrame:
    """Tasks of a manifest (an object with tasks, or a list) in order, with position.

    Ids must be there and unique; the count and the ordered hash must be as expected and as recorded.
    """
    fields = ddl_to_fields(TASK)
    whole = spark.read.text(path, wholetext=True)
    body = F.when(F.ltrim("value").startswith("["), F.concat(F.lit('{"tasks":'), F.col("value"), F.lit("}"))).otherwise(F.col("value"))
    parsed = F.from_json(body, f"struct<metadata: struct<task_ids_sha256: string>, tasks: array<struct<{fields}>>>", {"mode": "FAILFAST"})
    rows = whole.select(parsed.alias("m")).select(F.col("m.metadata.task_ids_sha256").alias("recorded"), F.posexplode("m.tasks").alias("position", "t"))
    facts = rows.agg(
        F.count("*").alias("n"), F.count_distinct("t.task_id").alias("ids"), F.count_if(F.coalesce("t.task_id", F.lit("")) == "").alias("blank"),
        ordered_hash("t.task_id", "position").alias("hash"), F.max("recorded").alias("recorded"),
    ).first()
    if facts.blank or facts.n != facts.ids:
        raise ValueError("task ids must be non-empty and unique")
    if expected_count is not None and facts.n != expected_count:
        raise ValueError(f"expected {expected_count} tasks, found {facts.n}")
    for what in (expected_hash, facts.recorded):
        if what is not None and what != facts.hash:
            raise ValueError("ordered id hash differs")
    return rows.select(F.col("position").cast("long"), "t.*")


def task_ids(tasks: DataFrame, scenario: str, split: str) -> DataFrame:
    """``tasks`` if each has the scenario and split; else an error."""
    wrong = tasks.filter(~(F.col("scenario").eqNullSafe(F.lit(scenario)) & F.col("official_split").eqNullSafe(F.lit(split)))).limit(1).count()
    if wrong:
        raise ValueError(f"a task is not of {scenario}/{split}")
    return tasks


def artifacts(spark: SparkSession, folders: list[str], schema: str, key: str = "attempt_id") -> DataFrame:
    """One JSON document per file of several folders; unreadable ones are skipped, later folders win by key."""
    out = None
    for rank, folder in enumerate(folders):
        rows = spark.read.schema(schema + ", __corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "__corrupt").json(folder)
        rows = rows.withColumn("__file", F.col("_metadata.file_name")).withColumn("__rank", F.lit(rank)).filter("__corrupt IS NULL").drop("__corrupt")
        out = rows if out is None else out.unionByName(rows)
    w = Window.partitionBy(key).orderBy(F.desc("__rank"), F.desc("__file"))
    return out.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__rank").withColumnRenamed("__file", "file_name")


def hashed_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file_name, sha256, record, raw) of JSON files: hash and record come from the same bytes; a bad one has a null record."""
    rows = spark.read.format("binaryFile").load(path)
    text = F.decode("content", "UTF-8")
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.sha2("content", 256).alias("sha256"), F.from_json(text, f"struct<{ddl_to_fields(schema)}>").alias("record"), text.alias("raw"))


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool) -> DataFrame:
    """JSON lines; a bad line is an error if ``strict``, else it is left out."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def log_lines(spark: SparkSession, path: str, needle: str, last: int) -> DataFrame:
    """The last lines with ``needle``, the last first, with their fields as a map: by file name, then by their order in the file."""
    place = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__line")]
    lines = spark.read.text(path).select("value", *place).filter(F.contains("value", F.lit(needle)))
    lines = lines.orderBy(F.desc("__file"), F.desc("__block"), F.desc("__line")).limit(last)
    return lines.select("value", F.str_to_map("value", F.lit(" "), F.lit("=")).alias("fields"))


def runs(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Run manifests under a wildcard, with their path and whether an invalidation marker is set."""
    return spark.read.schema(schema).option("multiLine", True).json(pattern).withColumn("path", F.col("_metadata.file_path"))


def runs_with_status(spark: SparkSession, pattern: str, schema: str, ledger_status: DataFrame, run: str = "run_id") -> DataFrame:
    """``runs`` with the status of their ledger (run, ledger_status), null where there is none; the ledger's word stands
    over the manifest's in ``current_status``."""
    told = runs(spark, pattern, schema).join(ledger_status.select(run, "ledger_status"), run, "left")
    return told.withColumn("current_status", F.coalesce("ledger_status", "status"))


def env_file(text: str) -> dict[str, str]:
    """KEY=VALUE lines; comments and blank lines are skipped, quotes around a value go."""
    out = {}
    for line in text.splitlines():
        key, mark, value = line.strip().removeprefix("export ").partition("=")
        if mark and key and not key.startswith("#"):
            out[key.strip()] = value.strip().strip("'\"")
    return out


def merged_config(base: dict, override: dict) -> dict:
    """``base`` with ``override``; sections merge one level deep."""
    return {**base, **{k: {**base[k], **v} if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in override.items()}}


def literal_block(text: str, key: str) -> str:
    """The literal block ``key: |`` of a text that need not be valid YAML elsewhere, without its indent."""
    lines = text.splitlines()
    at = next((i for i, x in enumerate(lines) if x.strip() in (f"{key}: |", f"{key}: |-")), None)
    if at is None:
        raise ValueError(f"no block {key}")
    outer = len(lines[at]) - len(lines[at].lstrip())
    block = []
    for line in lines[at + 1 :]:
        if line.strip() and len(line) - len(line.lstrip()) <= outer:
            break
        block.append(line)
    indent = min((len(x) - len(x.lstrip()) for x in block if x.strip()), default=0)
    return "\n".join(x[indent:] for x in block).rstrip("\n")
