"""The graph convolution against dense numpy, gradients against differences, accuracy against a network without the graph."""

import __spark_entry__ as entry
import numpy as np
from corpusforge.operators import graphnet as N


def planted(spark, n=120, seed=4):
    """Three communities; features say little, neighbours much."""
    r = np.random.default_rng(seed)
    y = np.arange(n) % 3
    x = np.eye(3)[y] + r.normal(size=(n, 3))
    edges = [(i, j) for i in range(n) for j in range(i) if r.random() < (0.12 if y[i] == y[j] else 0.008)]
    train = r.random(n) < 0.4
    nodes = spark.createDataFrame([(i, *map(float, x[i]), int(y[i]), bool(train[i])) for i in range(n)], "id long, a double, b double, c double, y long, train boolean")
    return nodes.repartition(3), spark.createDataFrame(edges + edges[:5] + [(j, i) for i, j in edges[:9]], "src long, dst long"), x, y, train, edges


def dense(n, edges):
    a = np.eye(n)
    for i, j in edges:
        a[i, j] = a[j, i] = 1
    d = a.sum(axis=1)
    return a / np.sqrt(np.outer(d, d))


def forward(p, x, y, train, w0, w1):
    z = p @ np.maximum(p @ x @ w0, 0) @ w1
    z = z - z.max(axis=1, keepdims=True)
    logp = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    return -logp[train, y[train]].mean(), logp


def test_products_loss_and_gradients(spark):
    nodes, edges, x, y, train, pairs = planted(spark)
    p = dense(len(x), pairs)
    got = np.zeros_like(p)
    for r in N.normalized(edges, nodes).collect():
        got[r.src, r.dst] = r.w
    assert np.allclose(got, p)
    graph = N.Graph(nodes, edges, ["a", "b", "c"], 3)
    net = graph.start(4, 1)
    loss, d0, d1 = graph.gradients(net)
    want, _ = forward(p, x, y, train, net.w0, net.w1)
    assert np.isclose(loss, want)
    for w, g in ((net.w0, d0), (net.w1, d1)):
        for at in [(0, 0), (1, 2), (2, 1)]:
            kept = w[at]
            w[at] = kept + 1e-6
            up, _ = forward(p, x, y, train, net.w0, net.w1)
            w[at] = kept - 1e-6
            down, _ = forward(p, x, y, train, net.w0, net.w1)
            w[at] = kept
            assert abs((up - down) / 2e-6 - g[at]) < 1e-6


def accuracy(graph, net, y, train):
    predicted = {r.id: r.predicted for r in graph.predict(net).collect()}
    return np.mean([predicted[i] == y[i] for i in range(len(y)) if not train[i]])


def test_neighbours_help(spark):
    nodes, edges, x, y, train, _ = planted(spark)
    graph = N.Graph(nodes, edges, ["a", "b", "c"], 3)
    net = graph.fit(8, 10)
    assert net.losses[-1] < net.losses[0]
    alone = N.Graph(nodes, edges.limit(0), ["a", "b", "c"], 3)  # loops only: a network over the node's own features
    with_graph, without = accuracy(graph, net, y, train), accuracy(alone, alone.fit(8, 10), y, train)
    assert with_graph > 0.85 and with_graph > without + 0.1


def test_nearest_edges_and_odd_graphs(spark, sf):
    rows = sorted(spark.read.parquet(f"{sf}/embeddings.parquet").limit(60).collect())
    x = np.array([r.embedding for r in rows], float)
    df = spark.createDataFrame([(r.vec_id, r.embedding) for r in rows], "id long, vec array<float>")
    got = {}
    for r in N.nearest_edges(df, 3).collect():
        got.setdefault(r.src, set()).add(r.dst)
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), 9)
    np.fill_diagonal(d, np.inf)
    ids = np.array([r.vec_id for r in rows])
    assert got == {ids[i]: set(ids[np.lexsort((ids, d[i]))[:3]]) for i in range(len(ids))}
    lone = spark.createDataFrame([(1, 0.5, None, True), (2, 1.0, 0, True)], "id long, a double, y long, train boolean")
    graph = N.Graph(lone, spark.createDataFrame([], "src long, dst long"), ["a"], 2)
    assert graph.trained == 1 and {r.id for r in graph.predict(graph.fit(2, 1)).collect()} == {1, 2}


def fitted_densely(p, x, y, train, classes, hidden=16, rounds=12, rate=0.05):
    r, s = np.random.default_rng(0), p @ x
    draw = lambda a, b: r.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b))
    w = [draw(x.shape[1], hidden), draw(hidden, classes)]
    m, v = [0.0, 0.0], [0.0, 0.0]
    for t in range(1, rounds + 1):
        h = np.maximum(s @ w[0], 0)
        z = p @ (h @ w[1])
        q = np.exp(z - z.max(axis=1, keepdims=True))
        back = p @ ((q / q.sum(axis=1, keepdims=True) - np.eye(classes)[y]) * train[:, None] / train.sum())
        for k, g in enumerate((s.T @ ((back @ w[1].T) * (h > 0)) + 5e-4 * w[0], h.T @ back)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            w[k] = w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return (p @ (np.maximum(s @ w[0], 0) @ w[1])).argmax(axis=1)


def test_query_equals_a_dense_network(spark, sf):
    rows = sorted(spark.read.parquet(f"{sf}/embeddings.parquet").collect())
    got = {r.id: r for r in entry.queries()["graph_network"](spark, sf).collect()}
    assert len(got) == len(rows) and all(r.held_out == (r.id % 5 == 0) for r in got.values())
    x, y, ids = np.array([r.embedding for r in rows], float), np.array([r.label for r in rows]), np.array([r.vec_id for r in rows])
    pairs = []
    for i in range(len(x)):
        d = np.round(np.sqrt(((x[i] - x) ** 2).sum(axis=1)), 9)
        d[i] = np.inf
        pairs += [(i, j) for j in np.lexsort((ids, d))[:5]]
    want = fitted_densely(dense(len(x), pairs), x, y, ids % 5 != 0, int(y.max()) + 1)
    assert np.mean([got[i].predicted == k for i, k in zip(ids, want)]) > 0.99
