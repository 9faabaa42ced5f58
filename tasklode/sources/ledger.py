"""A ledger in SQLite as a Python data source: a batch scan with pushed filters, and a stream of its completed rows."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan,
    LessThanOrEqual, Not, StringStartsWith,
)

ATTEMPTS = "rowid long, attempt_id string, task_id string, scenario string, status string, artifact_path string, started_at string, finished_at string, teacher_attempt int"
ACCEPTED = "rowid long, accepted_id string, attempt_id string, task_id string, artifact_path string, accepted_at string"
SCHEMAS = {"attempts": ATTEMPTS, "accepted": ACCEPTED, "run_state": "key string, value string"}
#: Rows of a partition, unless the option ``rowsPerPartition`` says otherwise.
ROWS = 100_000
_COMPARED = {EqualTo: "=", EqualNullSafe: "IS", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def condition(f: Filter, names: Iterable[str]) -> tuple[str, list] | None:
    """A filter as a condition of SQLite and its values; None if it has no such form."""
    if isinstance(f, Not):
        inner = condition(f.child, names)
        # a null keeps its row out on both sides, except with a null-safe comparison
        return None if inner is None or isinstance(f.child, EqualNullSafe) else (f"NOT ({inner[0]})", inner[1])
    if len(f.attribute) != 1 or f.attribute[0] not in names:
        return None
    name = f.attribute[0]
    if isinstance(f, (IsNull, IsNotNull)):
        return f"{name} IS {'NOT ' if isinstance(f, IsNotNull) else ''}NULL", []
    if isinstance(f, In):
        return f"{name} IN ({', '.join('?' * len(f.value))})", list(f.value)
    if isinstance(f, StringStartsWith) and f.value:
        return f"substr({name}, 1, ?) = ?", [len(f.value), f.value]
    if type(f) in _COMPARED and (f.value is None or isinstance(f.value, (str, int, float))):
        return f"{name} {_COMPARED[type(f)]} ?", [f.value]
    return None


class _Rows(InputPartition):
    """Rows after ``low`` up to ``high``."""

    def __init__(self, low: int, high: int) -> None:
        super().__init__((low, high))
        self.low, self.high = low, high


class _Scan:
    """What both readers need; the file must be where every executor can read it."""

    def __init__(self, options: dict, names: list[str]) -> None:
        self.path, self.table, self.names = options["path"], options.get("table", "attempts"), names
        self.rows, self.count, self.guarded = int(options.get("rowsperpartition", ROWS)), int(options.get("partitions", "0")), options.get("errors") == "rows"
        self.where: list[str] = []
        self.values: list = []
        if self.table not in SCHEMAS:
            raise ValueError(f"no table {self.table}")

    def open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def ranges(self, low: int, high: int) -> list[_Rows]:
        """Row numbers after ``low`` up to ``high`` in ranges of ``rows``, or in ``count`` ranges."""
        step = -(-(high - low) // self.count) if self.count else self.rows
        return [_Rows(a, min(high, a + step)) for a in range(low, high, max(step, 1))]

    def statement(self, partition: _Rows) -> tuple[str, list]:
        own = [n for n in self.names if n != "error"]
        conditions = ["rowid > ?", "rowid <= ?", *self.where]
        return f"SELECT {', '.join(own) or 'NULL'} FROM {self.table} WHERE {' AND '.join(conditions)} ORDER BY rowid", [partition.low, partition.high, *self.values]

    def fetch(self, partition: _Rows) -> Iterator[tuple]:
        tail = (None,) if "error" in self.names else ()
        blank = [None] * len([n for n in self.names if n != "error"])
        try:
            with self.open() as db:
                for row in db.execute(*self.statement(partition)):
                    yield (*(row if blank else ()), *tail)
        except sqlite3.Error as e:
            if not self.guarded:
                raise
            yield (*blank, str(e))


class _Reader(_Scan, DataSourceReader):
    """Partitions are ranges of row numbers. Filters go into SQLite's WHERE and are left for Spark to check again,
    as SQLite may take a number and its text for equal; those on rowid also bound the ranges."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            found = condition(f, [n for n in self.names if n != "error"])
            if found is not None and not self.guarded:
                self.where.append(found[0])
                self.values += found[1]
            yield f

    def partitions(self) -> list[_Rows]:
        try:
            with self.open() as db:
                bounds = f"SELECT min(rowid), max(rowid) FROM {self.table}"
                on_rowid = [w for w in self.where if w.startswith("rowid ") and "?" in w and " IN " not in w]
                values = iter(self.values)
                own = [[next(values) for _ in range(w.count("?"))] for w in self.where]
                taken = [v for w, vs in zip(self.where, own, strict=True) if w in on_rowid for v in vs]
                low, high = db.execute(f"{bounds} WHERE {' AND '.join(on_rowid)}" if on_rowid else bounds, taken).fetchone()
        except sqlite3.Error:
            if not self.guarded:
                raise
            return [_Rows(0, 0)]
        return self.ranges(low - 1, high) if low is not None else [_Rows(0, 0)]

    def read(self, partition: _Rows) -> Iterator[tuple]:
        return self.fetch(partition)


class _Stream(_Scan, DataSourceStreamReader):
    """The offset is a row number: all rows up to it are complete, that is none before it is still in progress.

    A row that is in progress holds back those after it until it ends, so a stream that is stopped and started again goes on
    with the first item that it hasn't handed on, and a batch that failed is read again from the same numbers.
    """

    def initialOffset(self) -> dict:  # noqa: N802
        return {"rowid": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        with self.open() as db:
            top = db.execute(f"SELECT coalesce(max(rowid), 0) FROM {self.table}").fetchone()[0]
            if self.table == "attempts":
                open_ = db.execute("SELECT min(rowid) FROM attempts WHERE status = 'in_progress'").fetchone()[0]
                top = top if open_ is None else open_ - 1
        return {"rowid": top}

    def partitions(self, start: dict, end: dict) -> list[_Rows]:
        return self.ranges(start["rowid"], end["rowid"])

    def read(self, partition: _Rows) -> Iterator[tuple]:
        return self.fetch(partition)


class LedgerSource(DataSource):
    """``spark.read.format("ledger").option("path", ...).option("table", "attempts")``, or ``readStream``.

    ``errors="rows"`` adds a column error to a batch scan and makes an unreadable file a row; filters aren't pushed then.
    """

    @classmethod
    def name(cls) -> str:
        return "ledger"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "attempts")] + (", error string" if self.options.get("errors") == "rows" else "")

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options), schema.names)

    def streamReader(self, schema) -> _Stream:  # noqa: N802
        return _Stream(dict(self.options), schema.names)


def _registered(spark: SparkSession) -> None:
    spark.dataSource.register(LedgerSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_ledger(spark: SparkSession, path: str, table: str = "attempts", errors_as_rows: bool = False, partitions: int | None = None, rows: int = ROWS) -> DataFrame:
    """A table of the ledger: a partition for each ``rows`` row numbers, or ``partitions`` of them.

    Spark keeps what it pushed into a Python source with the table, and a later query that pushes nothing would get the
    filters of the one before. So the table comes with a filter that all its rows pass, which every query pushes anew.
    """
    _registered(spark)
    reader = spark.read.format("ledger").option("path", path).option("table", table).option("rowsPerPartition", rows).option("partitions", partitions or 0)
    if errors_as_rows:
        return reader.option("errors", "rows").load()
    told = reader.load()
    return told.filter(f"{told.columns[0]} IS NOT NULL")


def stream_ledger(spark: SparkSession, path: str, table: str = "attempts", rows: int = ROWS) -> DataFrame:
    """The table's rows as they are completed, each once, in order of their numbers from batch to batch."""
    _registered(spark)
    return spark.readStream.format("ledger").option("path", path).option("table", table).option("rowsPerPartition", rows).load()
