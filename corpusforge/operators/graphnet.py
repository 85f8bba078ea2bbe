"""A graph convolution network whose nodes and edges stay in tables.

    Z = P relu(P X W0) W1,  P = D^-1/2 (A + 1) D^-1/2

A product with P is a join of edges to values and a sum by node; P X is worked out once, so a round has two such products, with as
many columns as there are classes. What a node does by itself (the layers' small products) runs in Arrow batches; the weights'
gradients are sums of outer products, added up before and after the shuffle. Only the weights, of fixed size, are on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint, ship


def nearest_edges(df: DataFrame, k: int = 5) -> DataFrame:
    """src, dst: each row's k nearest others of (id, vec), ties by id. Blocks meet blocks: the work grows with the square of the rows."""
    from .ml import _matrix, in_blocks, nearest_rows

    rows = df.select("id", "vec")

    def best(a, b):
        found = []
        if len(a) and len(b):
            mine, ids = a["id"].to_numpy(), b["id"].to_numpy()
            for r, places, d in nearest_rows(_matrix(a), _matrix(b), ids, k + 1):
                found += [(int(mine[r]), int(ids[j]), float(x)) for j, x in zip(places, d, strict=True) if ids[j] != mine[r]][:k]
        return pd.DataFrame(found, columns=["src", "dst", "d"])

    rank = F.row_number().over(Window.partitionBy("src").orderBy("d", "dst"))
    return in_blocks(rows, rows, best, "src bigint, dst bigint, d double").withColumn("r", rank).where(F.col("r") <= k).select("src", "dst")


def normalized(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, dst, w: the entries of P for an undirected graph with a loop at every node; edges may be repeated or one way."""
    both = edges.select("src", "dst").where("src <> dst")
    both = both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    all_ = both.unionByName(nodes.select(F.col("id").alias("src"), F.col("id").alias("dst")))
    degree = all_.groupBy("src").agg(F.count("*").alias("n"))
    ends = all_.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("n").alias("m")), "dst")
    return ends.select("src", "dst", (1 / F.sqrt(F.col("n").cast("double") * F.col("m"))).alias("w"))


def spread(p: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """P times the values (id, columns): a join by neighbour, and sums by node that are started before the shuffle."""
    met = p.join(values.withColumnRenamed("id", "dst"), "dst")
    return met.groupBy(F.col("src").alias("id")).agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in columns])


def _block(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.column_stack([np.asarray(batch.column(n), float) for n in names]) if batch.num_rows else np.zeros((0, len(names)))


@dataclass
class Network:
    """The two layers' weights, and the mean loss of the training nodes in each round."""

    w0: np.ndarray
    w1: np.ndarray
    losses: list[float]


class Graph:
    """nodes: id, x (columns `features`), y (class from 0, null: unknown), train (boolean); edges: src, dst."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, features: list[str], classes: int):
        ship(nodes.sparkSession)
        self.features, self.classes = features, classes
        self.z = [f"z{k}" for k in range(classes)]
        self.p = checkpoint(normalized(edges, nodes))
        smooth = spread(self.p, nodes.select("id", *features), features)
        self.nodes = checkpoint(smooth.join(nodes.select("id", "y", (F.col("train") & F.col("y").isNotNull()).alias("train")), "id"))
        self.trained = self.nodes.where("train").count()

    def start(self, hidden: int, seed: int) -> Network:
        r, d = np.random.default_rng(seed), len(self.features)
        draw = lambda a, b: r.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b))
        return Network(draw(d, hidden), draw(hidden, self.classes), [])

    def scores(self, net: Network) -> DataFrame:
        """id and the class scores of every node."""
        features, z, w0, w1 = self.features, self.z, net.w0, net.w1

        def layers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = np.maximum(_block(batch, features) @ w0, 0) @ w1
                yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, out.T)], names=["id", *z])

        own = self.nodes.select("id", *features).mapInArrow(layers, f"id bigint, {', '.join(f'{c} double' for c in z)}")
        return spread(self.p, own, z)

    def gradients(self, net: Network) -> tuple[float, np.ndarray, np.ndarray]:
        """Mean loss of the training nodes, and the weights' gradients."""
        features, z, w0, w1 = self.features, self.z, net.w0, net.w1
        top = F.greatest(*[F.col(c) for c in z]) if len(z) > 1 else F.col(z[0])
        total = F.log(sum((F.exp(F.col(c) - top) for c in z), F.lit(0.0))) + top
        train = self.nodes.where("train").select("id", "y")
        known = self.scores(net).join(train, "id")
        n = float(max(1, self.trained))
        off = known.select(
            "id", *[((F.exp(F.col(c) - total) - (F.col("y") == k).cast("double")) / n).alias(c) for k, c in enumerate(z)],
            (sum((F.when(F.col("y") == k, total - F.col(c)).otherwise(0.0) for k, c in enumerate(z)), F.lit(0.0)) / n).alias("loss"),
        )
        # The loss travels as one more column; only its sum is used, taken before P spreads it.
        off = checkpoint(off)
        loss = off.agg(F.sum("loss")).first()[0] or 0.0
        back = spread(self.p, off.drop("loss"), z).join(self.nodes.select("id", *features), "id")

        def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            d0, d1 = np.zeros_like(w0), np.zeros_like(w1)
            for batch in batches:
                s, g = _block(batch, features), _block(batch, z)
                h = np.maximum(s @ w0, 0)
                d1 += h.T @ g
                d0 += s.T @ ((g @ w1.T) * (h > 0))
            both = np.concatenate([d0.ravel(), d1.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(both))), pa.array(both)], names=["k", "g"])

        sums = back.select(*features, *z).mapInArrow(outer, "k bigint, g double").groupBy("k").agg(F.sum("g").alias("g")).collect()
        flat = np.zeros(w0.size + w1.size)
        for r in sums:
            flat[r["k"]] = r["g"]
        return float(loss), flat[: w0.size].reshape(w0.shape), flat[w0.size :].reshape(w1.shape)

    def fit(self, hidden: int = 16, rounds: int = 12, rate: float = 0.05, decay: float = 5e-4, seed: int = 0) -> Network:
        """Adam over whole-graph gradients, with weight decay on the first layer."""
        net = self.start(hidden, seed)
        m, v = ([np.zeros_like(net.w0), np.zeros_like(net.w1)] for _ in range(2))
        for step in range(1, rounds + 1):
            loss, d0, d1 = self.gradients(net)
            net.losses.append(loss)
            for k, (w, g) in enumerate(((net.w0, d0 + decay * net.w0), (net.w1, d1))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return net

    def predict(self, net: Network) -> DataFrame:
        """id and the class of the greatest score; ties: the first."""
        z = F.array(*[F.round(c, 9) for c in self.z])
        return self.scores(net).select("id", (F.array_position(z, F.array_max(z)) - 1).cast("bigint").alias("predicted"))
