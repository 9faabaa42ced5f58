"""Session factory and table loading."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


#: Bytes of an Arrow batch, unless the session sets another bound than Spark's own: a worker holds a few batches at once.
BATCH_BYTES, SPARK_BATCH_BYTES = 4 << 20, 64 << 20


def ship(spark: SparkSession) -> None:
    """Gives the workers this package, once per application (they may not share the driver's import path),
    and bounds the batches that they get."""
    context, bound = spark.sparkContext, "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound, None) == f"{SPARK_BATCH_BYTES}b":
        spark.conf.set(bound, f"{BATCH_BYTES}b")
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tasklode-")) / "tasklode-package.zip"
    with zipfile.ZipFile(target, "w") as package:
        for path in sorted(root.rglob("*.py")):
            package.write(path, path.relative_to(root.parent))
    context.addPyFile(str(target))


def session(name: str = "tasklode", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and skew-join splitting.

    On a cluster the master comes from the environment; here ``local[cpus]`` is the default.
    Extra ``conf`` keys use ``__`` for dots (``spark__sql__shuffle__partitions="8"``).
    """
    builder = (
        SparkSession.builder.appName(name)
        .master(f"local[{cpus}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a temporary one only in local mode, where one machine does all."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tasklode-"))
    return context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the shared folder: its lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; column pruning and filters reach the Parquet scan."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
