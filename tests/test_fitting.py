"""Components, barrier descent, trees by levels and ranks by hash: against dense numpy and the plain loops."""

import __spark_entry__ as entry
import numpy as np
import pytest
from corpusforge.operators import fitting as L
from corpusforge.operators import ml as M
from pyspark.sql import Window
from pyspark.sql import functions as F


def test_components_equal_dense_ones(spark, sf):
    rows = sorted(spark.read.parquet(f"{sf}/embeddings.parquet").collect())
    x = np.array([r.embedding for r in rows], float)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    found = L.components(spark.read.parquet(f"{sf}/embeddings.parquet").repartition(5), "embedding", 64, 3)
    assert np.allclose(found.variance, values[::-1][:3]) and np.isclose(found.total, values.sum()) and found.rows == len(x)
    assert np.allclose(np.abs((found.axes * vectors[:, ::-1][:, :3].T).sum(axis=1)), 1) and (found.axes.max(axis=1) >= np.abs(found.axes).max(axis=1)).all()
    got = {r.id: (r.x, r.y) for r in entry.queries()["pca_2d"](spark, sf).collect()}
    want = (x - x.mean(axis=0)) @ found.axes[:2].T
    assert len(got) == len(x) and np.allclose([got[r.vec_id] for r in rows], want, atol=1e-5)
    # What two components leave out is the variance along all others.
    error = ((x - x.mean(axis=0) - want @ found.axes[:2]) ** 2).sum(axis=1).mean()
    assert np.isclose(error, found.total - found.variance[:2].sum())


def test_components_of_odd_rows(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0, 2.0],), (None,), ([1.0],)], "v array<double>")
    found = L.components(df, "v", 2, 1)
    assert found.rows == 2 and np.allclose(found.axes, [[1, 0]]) and np.allclose(found.variance, [1])
    assert L.components(df.limit(0), "v", 2, 1).rows == 0


@pytest.mark.parametrize("tasks", [1, 3])
def test_barrier_descent_equals_the_loop(spark, tasks):
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 3))
    y = (x @ [1.5, -2.0, 0.3] + 0.5 + r.normal(size=300) > 0).astype(int)
    df = spark.createDataFrame([(*map(float, v), int(t)) for v, t in zip(x, y)], "a double, b double, c double, t int")
    w, b = L.logistic_fit(df, ["a", "b", "c"], "t", 0.3, 60, tasks)
    want, bias = M.logistic(x, y, 0.3, 60)
    assert np.allclose(w, want, atol=1e-9) and abs(b - bias) < 1e-9


def test_barrier_descent_of_few_rows(spark):
    one = spark.createDataFrame([(1.0, 1)], "a double, t int")
    w, b = L.logistic_fit(one, ["a"], "t", 0.1, 3, 4)  # tasks without rows take part
    assert np.allclose(w, M.logistic(np.array([[1.0]]), np.array([1]), 0.1, 3)[0])
    assert L.logistic_fit(one.limit(0), ["a"], "t", 0.1, 3, 2)[1] == 0.0


def unfolded(nodes, k=0):
    n = nodes[k]
    return n.label if n.left < 0 else (n.feature, n.threshold, unfolded(nodes, n.left), unfolded(nodes, n.right))


def plain(node):
    return (int(node[0]), float(node[1]), plain(node[2]), plain(node[3])) if isinstance(node, tuple) else int(node)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_tree_by_levels_equals_the_recursive_one(spark, seed):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(400, 3)), 1 if seed == 2 else 6)  # many ties, or none
    y = ((x[:, 0] > 0.2).astype(int) + 2 * ((x[:, 1] * x[:, 2] > 0) & (r.random(400) < 0.9)).astype(int)) % 3 + 5
    df = spark.createDataFrame([(*map(float, v), int(t)) for v, t in zip(x, y)], "a double, b double, c double, t int").repartition(4)
    nodes = L.tree_fit(df, ["a", "b", "c"], "t", 4)
    assert unfolded(nodes) == plain(M.tree(x, y, 4))
    assert sum(sum(n.counts) for n in nodes if n.left < 0) == 400


def test_tree_of_odd_rows(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 1), (None, 1), (float("nan"), 1), (5.0, None)], "a double, t int")
    nodes = L.tree_fit(df, ["a"], "t")
    assert unfolded(nodes) == (0, 1.0, 0, 1)
    assert [r[0] for r in df.select(L.tree_label(nodes, ["a"])).collect()] == [0, 1, 1, 1, 1]
    assert unfolded(L.tree_fit(df.limit(0), ["a"], "t")) == 0 and unfolded(L.tree_fit(df.where("t = 1"), ["a"], "t")) == 1


def test_models_of_the_documents(spark, sf):
    q = entry.queries()
    rows = q["tree_documents"](spark, sf).collect()
    n = spark.read.parquet(f"{sf}/labels.parquet").count()
    assert len(rows) == n and np.mean([r.quality == r.predicted for r in rows]) > 0.9
    fitted = q["logistic_documents"](spark, sf).collect()
    assert len(fitted) == n and np.mean([r.quality == r.predicted for r in fitted]) > 0.85 and all(r.predicted == int(r.p >= 0.5) for r in fitted)


@pytest.mark.parametrize("edge", [1, 5, 20_000])
def test_first_by_hash_equals_a_window(spark, edge):
    df = spark.range(3000).select(F.col("id").alias("k"), F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 == 7, F.lit(None)).otherwise(F.concat(F.lit("g"), F.col("id") % 40)).alias("g"))
    digest = M.order_key("k", 9)
    for take in (F.floor(0.3 * F.col("n") + 0.5), F.least(F.lit(25), F.col("n")), F.lit(0), F.col("n"), F.col("n") + 5):
        got = L.first_by_hash(df, digest, "k", "g", take, "taken", edge)
        w = Window.partitionBy("g")
        want = df.withColumn("n", F.count("*").over(w)).withColumn("r", F.row_number().over(w.orderBy(digest, "k"))).where(F.col("r") <= take)
        assert got.columns == ["k", "g", "taken"] and got.count() == 3000
        assert sorted(r.k for r in got.where("taken").collect()) == sorted(r.k for r in want.collect())
    assert L.first_by_hash(df.limit(0), digest, "k", "g", F.col("n")).count() == 0
