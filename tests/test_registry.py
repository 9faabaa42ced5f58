import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from tasklode.plans import collection, contracts  # noqa: F401  register their queries
from tasklode.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    def plain(x):
        return None if x is None or x is pd.NA or x != x else round(float(x), 6) + 0.0 if isinstance(x, (float, np.floating)) else x

    out = [tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)]
    return sorted(out, key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE_SQL[name]).fetchdf()
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.toPandas()) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_order_of_the_input_does_not_matter(spark):
    from tasklode.operators import sampling

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    once, again = (sampling.stratified_sample(d, 50, "doc_id", ["lang", "source"]).collect() for d in (docs, docs.orderBy("text").repartition(7)))
    assert sorted(once) == sorted(again) and len(once) == 50


def test_entry_without_the_optional_part(monkeypatch):
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def without(name, *a, **b):
        if name == "corpus_pipeline" or name.startswith("tasklode.llm"):
            raise ModuleNotFoundError(name, name=name)
        return real(name, *a, **b)

    monkeypatch.setattr(builtins, "__import__", without)
    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLE_SQL)
    sys.modules.pop("__spark_entry__", None)
