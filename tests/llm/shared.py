"""Fixtures in common: a table of awkward texts, and DuckDB over small tables."""

import pytest

#: Nulls, empty and very long texts, ties and repeated rows.
AWKWARD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "word"),
    (5, "Größe über çà 漢字 e\u0301 \U0001f600 don't 12345"),
    (5, "Größe über çà 漢字 e\u0301 \U0001f600 don't 12345"),
    (None, "no id here, but a text of some words"),
    (6, "abc " * 30_000),
    (7, "x" * 50_000),
    (8, "\n\n\n  \n" * 2_000 + "end"),
    (9, "one two three four five six seven eight nine ten eleven"),
]
DOCS = "doc_id long, text string"


def docs(spark, rows=AWKWARD, extra=True):
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        df = df.selectExpr("*", "1 AS n_tokens", "'x' AS ids", "0 AS piece", "'y' AS host", "2 AS key", "3 AS salt", "4 AS n", "5 AS kept")
    return df


needs_testdata = pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.001"), reason="no test tables")
