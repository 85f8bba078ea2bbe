"""Models fitted where the rows are: second moments and components, gradient descent in barrier mode, trees level by level."""

from __future__ import annotations

import socket
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, ship

# Second moments and principal components


def moments(df: DataFrame, column: str, dim: int) -> DataFrame:
    """The summed products of a vector's numbers, a one put before them: i, j (0 is the one), x. A task sends its sums once."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim + 1))
        for batch in batches:
            rows = batch.column(0)
            x = np.ones((len(rows), dim + 1))
            x[:, 1:] = np.asarray(rows.flatten(), float).reshape(len(rows), dim)
            total += x.T @ x
        i, j = np.divmod(np.arange((dim + 1) ** 2), dim + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "x"])

    whole = df.where(F.col(column).isNotNull() & (F.size(column) == dim)).select(F.col(column).cast("array<double>").alias("v"))
    return whole.mapInArrow(run, "i bigint, j bigint, x double").groupBy("i", "j").agg(F.sum("x").alias("x"))


@dataclass
class Components:
    """Mean, components (a row each) and the variance along each, largest first; a component's largest number is positive."""

    mean: np.ndarray
    axes: np.ndarray
    variance: np.ndarray
    total: float
    rows: int


def components(df: DataFrame, column: str, dim: int, k: int = 2) -> Components:
    """The first k principal components (L13): one pass over the rows; only dim x dim sums reach the driver."""
    sums = np.zeros((dim + 1, dim + 1))
    for r in moments(df, column, dim).collect():
        sums[r["i"], r["j"]] = r["x"]
    n = max(1.0, sums[0, 0])
    mean = sums[0, 1:] / n
    covariance = sums[1:, 1:] / n - np.outer(mean, mean)
    values, vectors = np.linalg.eigh(covariance)
    axes = vectors[:, ::-1][:, :k].T.copy()
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
    return Components(mean, axes, values[::-1][:k], float(np.trace(covariance)), int(sums[0, 0]))


def projected(vec: Column, found: Components) -> list[Column]:
    """A vector's place along each component, as JVM-side expressions."""
    out = []
    for axis in found.axes:
        weights = F.array(*map(F.lit, axis.tolist()))
        products = F.zip_with(vec, weights, lambda x, w: x.cast("double") * w)
        out.append(F.aggregate(products, F.lit(0.0), lambda s, x: s + x) - F.lit(float(axis @ found.mean)))
    return out


# Logistic regression in barrier mode (L3)

#: Seconds that a task of a barrier waits for another.
PATIENCE = 600


class _Meeting:
    """Sums of arrays over the tasks of a barrier stage; the first task adds them up, in the tasks' order."""

    def __init__(self, context):
        self.rank, infos = context.partitionId(), context.getTaskInfos()
        self.server, self.others = None, []
        port = 0
        if self.rank == 0:
            self.server = socket.create_server(("", 0), backlog=len(infos))
            self.server.settimeout(PATIENCE)
            port = self.server.getsockname()[1]
        port = int(context.allGather(str(port))[0])
        if self.rank == 0:
            known = {}
            for _ in infos[1:]:
                other, _ = self.server.accept()
                other.settimeout(PATIENCE)
                known[int.from_bytes(self._read(other, 4), "little")] = other
            self.others = [known[k] for k in sorted(known)]
        else:
            self.first = socket.create_connection((infos[0].address.rpartition(":")[0] or infos[0].address, port), PATIENCE)
            self.first.settimeout(PATIENCE)
            self.first.sendall(self.rank.to_bytes(4, "little"))

    def __enter__(self):
        return self

    def __exit__(self, *_):
        for s in [*self.others, self.server] if self.rank == 0 else [self.first]:
            s.close()

    @staticmethod
    def _read(s: socket.socket, size: int) -> bytes:
        held = b""
        while len(held) < size:
            part = s.recv(size - len(held))
            if not part:
                raise ConnectionError("another task of the stage is gone")
            held += part
        return held

    def summed(self, numbers: np.ndarray) -> np.ndarray:
        size = numbers.nbytes
        if self.rank:
            self.first.sendall(numbers.tobytes())
            return np.frombuffer(self._read(self.first, size))
        total = numbers.copy()
        for s in self.others:
            total += np.frombuffer(self._read(s, size))
        for s in self.others:
            s.sendall(total.tobytes())
        return total



def logistic_fit(df: DataFrame, columns: list[str], target: str, rate: float = 0.01, rounds: int = 1000, tasks: int | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias by batch gradient descent from zero: one job whose tasks keep their rows and exchange gradient sums each round.

    All tasks must run at once, so there are as many as the cluster has cores (or `tasks`). They meet once through the barrier, which tells where the
    first task listens (a barrier takes about a second, too long for every round); each round's sums then go to it and back over sockets.
    It adds them in the tasks' order, all take the same step, and it sends the result. A lost task breaks the others' sockets, so the stage starts
    again, from the rows. Nulls count as zeros; an empty table gives zeros.
    """
    spark = df.sparkSession
    ship(spark)
    d = len(columns)
    tasks = tasks or spark.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import BarrierTaskContext

        context = BarrierTaskContext.get()
        held = [np.column_stack([np.asarray(c.fill_null(0), float) for c in batch.columns]) for batch in batches if batch.num_rows]
        rows = np.concatenate(held) if held else np.zeros((0, d + 1))
        x, y = np.ascontiguousarray(rows[:, :d]), rows[:, d]

        w, b = np.zeros(d), 0.0
        with _Meeting(context) as meeting:
            n = max(1.0, meeting.summed(np.array([float(len(y))]))[0])
            for _ in range(rounds):
                off = 1 / (1 + np.exp(-np.clip(x @ w + b, -250, 250))) - y
                step = meeting.summed(np.append(x.T @ off, off.sum())) / n
                w, b = w - rate * step[:d], b - rate * step[d]
        if context.partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array([w.tolist()], pa.list_(pa.float64())), pa.array([float(b)])], names=["w", "b"])

    rows = df.select(*[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(columns)], F.col(target).cast("double").alias("y"))
    found = rows.repartition(tasks).mapInArrow(run, "w array<double>, b double", barrier=True).collect()
    return (np.array(found[0]["w"]), found[0]["b"]) if found else (np.zeros(d), 0.0)  # an empty plan has no tasks


# Decision trees level by level (L4)


@dataclass
class Node:
    """A leaf has a label; an inner node a feature, a threshold (up to which rows go left) and two children."""

    label: int
    counts: list[int]
    feature: int = -1
    threshold: float = 0.0
    left: int = -1
    right: int = -1


def _gini(counts: np.ndarray) -> np.ndarray:
    n = counts.sum(axis=-1)
    return 1 - ((counts / np.maximum(n, 1)[..., None]) ** 2).sum(axis=-1)


def tree_fit(df: DataFrame, columns: list[str], target: str, depth: int = 5) -> list[Node]:
    """A Gini tree over all thresholds, the first node the root: all nodes of a level are split in the same jobs.

    The counts of labels by (node, feature, value) are sorted in parts; each part needs only the counts before it, a few numbers a part and
    node, to try every threshold it holds. Of equally good splits the first feature's, then the smallest threshold wins. Labels are
    whole numbers, of a bounded number of classes; nulls and NaN are larger than every number.
    """
    ship(df.sparkSession)
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
    rows = checkpoint(df.where(F.col(target).isNotNull()).select(*[value(c).alias(f"x{k}") for k, c in enumerate(columns)], F.col(target).cast("bigint").alias("y")))
    by = sorted((r["y"], r["count"]) for r in rows.groupBy("y").count().collect())
    if not by:
        return [Node(0, [])]
    labels = [y for y, _ in by]
    leaf = lambda counts: Node(labels[int(np.argmax(counts))], [int(n) for n in counts])
    nodes = [leaf([n for _, n in by])]
    hot = [F.count_if(F.col("y") == y).alias(f"n{k}") for k, y in enumerate(labels)]
    names = [f"n{k}" for k in range(len(labels))]
    open_ = [0]
    for _ in range(depth):
        open_ = [k for k in open_ if sum(n > 0 for n in nodes[k].counts) > 1]
        if not open_:
            break
        at = place(nodes, [F.col(f"x{k}") for k in range(len(columns))])
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(f"x{k}").alias("v")) for k in range(len(columns))]))
        runs = rows.withColumn("node", at).where(F.col("node").isin(open_)).select("node", "y", each.alias("e")).select("node", "e.f", "e.v", "y").groupBy("node", "f", "v").agg(*hot)
        parts = runs.repartitionByRange("node", "f", "v").sortWithinPartitions("node", "f", "v").withColumn("part", F.spark_partition_id())
        parts = checkpoint(parts)
        before: dict[tuple[int, int, int], np.ndarray] = {}
        whole: dict[tuple[int, int], np.ndarray] = {}
        for r in sorted(parts.groupBy("part", "node", "f").agg(*[F.sum(n).alias(n) for n in names]).collect()):
            key = r["node"], r["f"]
            before[r["part"], *key] = whole.get(key, np.zeros(len(labels)))
            whole[key] = before[r["part"], *key] + np.array([r[n] for n in names], float)

        def best(batches, before=before, whole=whole):
            found: dict[int, tuple] = {}
            carried: dict[tuple, np.ndarray] = {}
            for batch in batches:
                part, node, f = (np.asarray(batch.column(c)) for c in ("part", "node", "f"))
                v, counts = np.asarray(batch.column("v"), float), np.column_stack([np.asarray(batch.column(n), float) for n in names])
                starts = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (f[1:] != f[:-1])]) if len(node) else []
                for a, b in zip(starts, [*starts[1:], len(node)]):
                    key = int(part[a]), int(node[a]), int(f[a])
                    left = carried.get(key, before[key]) + np.cumsum(counts[a:b], axis=0)
                    carried[key] = left[-1]
                    right = whole[key[1:]] - left
                    n, m = left.sum(axis=1), right.sum(axis=1)
                    score = np.where(m > 0, np.round((n * _gini(left) + m * _gini(right)) / (n + m), 12), np.inf)
                    k = int(np.argmin(score))
                    if np.isfinite(score[k]):
                        here = float(score[k]), key[2], float(v[a + k]), left[k].tolist()
                        if key[1] not in found or here < found[key[1]]:
                            found[key[1]] = here
            keys, all_ = list(found), list(found.values())
            kinds = [pa.float64(), pa.int32(), pa.float64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *(pa.array([x[k] for x in all_], t) for k, t in enumerate(kinds))], names=["node", "score", "f", "v", "counts"])

        splits: dict[int, tuple] = {}
        for r in parts.mapInArrow(best, "node int, score double, f int, v double, counts array<double>").collect():
            here = r["score"], r["f"], r["v"], r["counts"]
            if r["node"] not in splits or here < splits[r["node"]]:
                splits[r["node"]] = here
        following = []
        for k, (_, f, v, counts) in sorted(splits.items()):
            other = (np.array(nodes[k].counts) - np.array(counts)).tolist()
            nodes[k].feature, nodes[k].threshold, nodes[k].left, nodes[k].right = f, v, len(nodes), len(nodes) + 1
            following += [len(nodes), len(nodes) + 1]
            nodes += [leaf(counts), leaf(other)]
        open_ = following
    return nodes


def place(nodes: list[Node], features: list[Column], at: int = 0, of=lambda nodes, k: k) -> Column:
    """The leaf that a row falls into (or what `of` makes of it), as one nested condition."""
    node = nodes[at]
    if node.left < 0:
        return F.lit(of(nodes, at))
    return F.when(features[node.feature] <= F.lit(node.threshold), place(nodes, features, node.left, of)).otherwise(place(nodes, features, node.right, of))


def tree_label(nodes: list[Node], columns: list[str]) -> Column:
    """The label of the leaf."""
    features = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns]
    return place(nodes, features, of=lambda nodes, k: nodes[k].label).cast("bigint")


# Ranks by hash without a window over a stratum (M1, M3, M4)

#: Rows of a stratum's edge group up to which they are ranked; hex digits that a count adds; strata up to which their edges are broadcast.
EDGE, DIGITS, BROADCAST = 20_000, 3, 100_000


def first_by_hash(df: DataFrame, digest: Column, key: str, group: str, take: Column, out: str = "taken", edge: int = EDGE) -> DataFrame:
    """The rows, marked where they are among the first `take` (of the column n, the stratum's rows) by (digest, key) in their stratum.

    Counts by the leading digits of the digest find the group at each stratum's edge, then by the next digits within it, until
    few rows are left; only these are ranked, to find the last row taken. Rows with equal digest and key are taken or left together.
    """
    rows = df.select(F.col(group).alias("g"), digest.alias("h"), F.col(key).alias("key"))
    from pyspark.sql import Window

    sizes = rows.groupBy("g").agg(F.count("*").alias("n"))
    edges = checkpoint(sizes.select("g", take.cast("bigint").alias("left"), F.lit("").alias("prefix"), F.col("n").alias("size")).where("left > 0"))
    few = edges.count() <= BROADCAST
    hint = F.broadcast if few else (lambda x: x)
    digits = 0
    while digits < 30:
        largest = edges.agg(F.max("size")).first()[0] or 0
        if largest <= edge:
            break
        digits += DIGITS
        # A stratum that is small enough goes on without a count: its whole group is looked at below.
        e = edges.select(F.col("g").alias("eg"), "left", "prefix")
        within = rows.join(hint(e), rows["g"].eqNullSafe(F.col("eg")) & F.startswith("h", "prefix"))
        counts = within.groupBy("g", "left", F.substring("h", 1, digits).alias("prefix")).agg(F.count("*").alias("size"))
        w = Window.partitionBy("g").orderBy("prefix")  # at most 16 ** DIGITS counts a stratum
        below = F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.withColumn("below", below).where((F.col("below") < F.col("left")) & (F.col("left") <= F.col("below") + F.col("size")))
        last = counts.select("g", (F.col("left") - F.col("below")).alias("left"), "prefix", "size")
        # Where more is asked for than there is, all rows are taken.
        over = edges.join(last.select(F.col("g").alias("lg")), edges["g"].eqNullSafe(F.col("lg")), "left_anti").select("g", F.col("size").alias("left"), "prefix", F.lit(0).cast("bigint").alias("size"))
        edges = checkpoint(last.unionByName(over))
    e = edges.select(F.col("g").alias("eg"), "left", "prefix")
    within = rows.join(hint(e), rows["g"].eqNullSafe(F.col("eg")) & F.startswith("h", "prefix"))
    rank = F.row_number().over(Window.partitionBy("g").orderBy("h", "key"))
    last = within.withColumn("r", rank).where(F.col("r") <= F.col("left")).groupBy("g").agg(F.max(F.struct("h", "key")).alias("last"))
    last = checkpoint(last.select(F.col("g").alias("_g"), F.col("last").alias("_last")))
    place_ = F.struct(digest.alias("h"), F.col(key).alias("key"))
    joined = df.join(hint(last), df[group].eqNullSafe(F.col("_g")), "left")
    return joined.withColumn(out, F.coalesce(place_ <= F.col("_last"), F.lit(False))).drop("_g", "_last")
