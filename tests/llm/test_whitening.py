import numpy as np
import pytest
from pyspark.sql import functions as F

from tileframe.llm import whitening


def plain(vectors):
    x = np.unique(np.floor(256 * np.array(vectors, np.float64)).astype(np.int64), axis=0)
    n, sums = len(x), x.sum(axis=0)
    covariance = (x - sums / n).T @ (x - sums / n) / n
    values, components = np.linalg.eigh(covariance)
    return n, sums, values[::-1], components[:, ::-1], np.trace(covariance)


def close(got, vectors, k):
    n, sums, values, components, trace = plain(vectors)
    by_id = dict(enumerate(vectors))
    sign = None
    for r in got:
        x = np.floor(256 * np.array(by_id[r.id], np.float64)).astype(np.int64)
        assert r.x == x.tolist() and r.n == n and r.deviation == int(((n * x - sums) ** 2).sum())
        want = (x - sums / n) @ components[:, :k] / np.sqrt(values[:k])
        sign = np.sign(want * np.array(r.whitened)) if sign is None else sign
        assert np.allclose(np.array(r.whitened) * sign, want, atol=1e-7)
        assert np.allclose(r.variances, values[:k], rtol=1e-9) and np.isclose(r.trace, trace) and r.identity_error < 1e-4


def test_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = whitening.whiten(rows, components=4).collect()
    of = {r.vec_id: r.embedding for r in rows.collect()}
    assert len(got) == len(of)
    close([r.__class__(**(r.asDict() | {"id": i})) for i, r in enumerate(sorted(got, key=lambda r: r.id))], [of[i] for i in sorted(of)], 4)


@pytest.mark.parametrize("rows_per_block", [4, 4096])
def test_copies_count_once_and_blocks_do_not_matter(spark, monkeypatch, rows_per_block):
    monkeypatch.setattr(whitening, "ROWS", rows_per_block)
    monkeypatch.setattr(whitening, "COLUMNS", 3)
    rng = np.random.default_rng(1)
    vectors = [*rng.normal(size=(40, 5)).astype(np.float32).tolist()]
    vectors += [vectors[0]] * 30
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    close(whitening.whiten(df).collect(), vectors, 5)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [None, [], [1.0, None], [nan, 1.0], [inf, 1.0], [1.0], [0.0, -0.0], [1.0, 2.0], [1.0, 2.0], [-0.001, 3.0], [5.0, 1.0]]
    rows = [(i if i != 9 else None, v, "clash") for i, v in enumerate(vectors)]
    df = spark.createDataFrame([*rows, rows[7]], "vec_id long, embedding array<float>, x string").selectExpr("*", "'clash' as v", "'clash' as id", "'clash' as index")
    got = whitening.whiten(df, components=4).collect()
    assert sorted(str(r.id) for r in got) == ["10", "6", "7", "7", "8", "None"]
    assert all(r.n == 4 and len(r.whitened) == 2 for r in got)
    one = next(r for r in got if r.id is None)
    assert one.x == [-1, 768]
    assert len({str(r.whitened) for r in got if r.id in (7, 8)}) == 1


def test_no_variance_and_empty_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert [(r.n, r.deviation, r.whitened) for r in whitening.whiten(df).collect()] == [(1, 0, [])] * 2
    for none in (df.limit(0), df.where("vec_id = 1").withColumn("embedding", F.lit(None).cast("array<float>"))):
        assert whitening.whiten(none, components=4).collect() == []
