import math

import numpy as np
import pytest
from tasklode.llm import queries, whitening
from tests.llm.shared import needs_testdata

SCHEMA = "vec_id long, embedding array<double>"
RNG = np.random.default_rng(5)


def slow(rows, components=8):
    """Brute force: exact integers, then numpy over all rows at once."""
    kept = [(i, [math.floor(1024 * c) + 100_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, dims = len(kept), len(kept[0][1])
    sums = [sum(x[k] for _, x in kept) for k in range(dims)]
    apart = [[n * x[k] - sums[k] for k in range(dims)] for _, x in kept]
    centred = np.array(apart, float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    out = {}
    for (i, _), row, a in zip(kept, centred, apart, strict=True):
        out.setdefault(i, []).append((sum(x * x for x in a), row @ vectors[:, order] / np.sqrt(values[order])))
    return n, out, values[order] / values.sum(), vectors[:, order]


def rows_of(n, dims, base=0):
    spread = np.linspace(1, 3, dims)
    return [(base + i, (RNG.normal(size=dims) * spread).tolist()) for i in range(n)]


def held(out, want):
    n, rows, explained, _ = want
    got = {}
    for r in out:
        got.setdefault(r.vec_id, {})[r.component] = r
    assert set(got) == set(rows)
    signs = {}
    for i, parts in got.items():
        assert sorted(parts) == list(range(1, len(explained) + 1))
        for c, r in parts.items():
            deviation, values = rows[i][0]
            assert (r.n, int(r.deviation)) == (n, deviation)
            assert r.explained == pytest.approx(explained[c - 1], rel=1e-9) and r.identity_error < 1e-9
            sign = signs.setdefault(c, 1 if r.whitened * values[c - 1] >= 0 else -1)
            assert sign * r.whitened == pytest.approx(values[c - 1], abs=1e-7)


@pytest.mark.parametrize(("n", "dims", "parts"), [(300, 12, 5), (40, 3, 7), (64, 8, 1)])
def test_equals_brute_force(spark, n, dims, parts):
    rows = rows_of(n, dims)
    held(whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect(), slow(rows))


def test_rows_that_are_left_out_and_extra_columns(spark):
    rows = rows_of(50, 5)
    bad = [(900, None), (901, [1.0, None, 2.0, 3.0, 4.0]), (902, [float("nan")] * 5), (903, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (904, [None])]
    df = spark.createDataFrame([*rows, *bad], SCHEMA).selectExpr("*", "1 AS n", "2 AS component", "'x' AS vector", "3 AS whitened")
    held(whitening.whiten(df).collect(), slow([*rows, *bad]))


def test_repeated_rows_and_null_ids(spark):
    rows = rows_of(30, 4)
    rows = [*rows, rows[0], rows[0], (None, [9.0, 1.0, 2.0, 3.0])]
    out = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 33 * 4 and {r.n for r in out} == {33}
    assert sum(r.vec_id is None for r in out) == 4 and len({r.whitened for r in out if r.vec_id == 0}) == 4


def test_components_without_variance_have_no_values(spark):
    flat = [(i, [float(i % 7), 2.0 * (i % 7), 5.0]) for i in range(20)]
    out = whitening.whiten(spark.createDataFrame(flat, SCHEMA)).collect()
    assert {r.component for r in out if r.whitened is not None} == {1} and {round(r.explained, 9) for r in out} == {1.0, 0.0}
    assert max(r.identity_error for r in out) < 1e-9
    alone = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA)).collect()
    assert [(r.component, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in alone] == [(1, 1, 0, None, 0.0, 0.0), (2, 1, 0, None, 0.0, 0.0)]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [None])], [(1, [])]])
def test_nothing_to_whiten(spark, rows):
    df = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
    assert df.count() == 0 and [c for c, _ in df.dtypes] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_different_lengths_are_an_error(spark):
    with pytest.raises(Exception, match="vectors of"):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], SCHEMA))


def test_large_entries_stay_exact(spark):
    rows = [(i, [x * 1e9 for x in v]) for i, v in rows_of(60, 3)]
    held(whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect(), slow(rows))


def test_merges_are_those_of_all_rows():
    x = RNG.integers(99_000, 101_000, (100, 6))
    whole = whitening.state_of(x, whitening.exact_sums(x))
    state = None
    for a in range(0, 100, 9):
        state = whitening.merge(state, whitening.state_of(x[a : a + 9], whitening.exact_sums(x[a : a + 9])))
    assert state[:2] == whole[:2] and np.allclose(state[2], whole[2], rtol=1e-12)


@needs_testdata
def test_query_over_the_given_vectors(spark):
    path = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    held(queries.op11_whitening(spark, path).collect(), slow(rows))
