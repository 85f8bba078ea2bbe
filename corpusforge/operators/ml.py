"""Scaling, splits, samples, kNN, logistic regression, trees, clustering and their measures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ratio
from ..session import checkpoint
from .fitting import first_by_hash, logistic_fit, tree_fit, tree_label


def order_key(key: str, seed: int) -> Column:
    """A fixed shuffle order: the md5 of key and seed, the same in every engine."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))


def numbered(df: DataFrame, *order: Column, out: str = "n") -> DataFrame:
    """The rows with their number by a total order, from 0 (W5): sorted parts and the counts before them, so no task has all rows."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).persist()
    sizes = parts.groupBy("_part").count().collect()  # a row a partition
    before, total = {}, 0
    for r in sorted(sizes):
        before[r["_part"]] = total
        total += r["count"]
    if not before:
        return parts.select(*df.columns, F.lit(0).cast("long").alias(out))
    offset = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("_part")]
    return parts.select(*df.columns, (F.col("_at") + offset).cast("long").alias(out))


def stratified_split(df: DataFrame, key: str, label: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """Marks round(share n) rows of each label as train (M4): those first by hash, found without a window over a label."""
    marked = first_by_hash(df, order_key(key, seed), key, label, F.floor(share * F.col("n") + 0.5), "_own")
    return marked.withColumn("split", F.when(F.col("_own"), "train").otherwise("test")).drop("_own")


def stratified_sample(df: DataFrame, key: str, group: str, n: int, seed: int = 1) -> DataFrame:
    """n rows: as many of each group, topped up from the rest (M1, M3)."""
    groups = max(1, df.select(group).distinct().count())
    marked = first_by_hash(df, order_key(key, seed), key, group, F.least(F.lit(n // groups), F.col("n")), "_own").withColumn("_h", order_key(key, seed + 1))
    return marked.orderBy(F.desc("_own"), F.when(F.col("_own"), F.lit("")).otherwise(F.col("_h")), key).limit(n).drop("_own", "_h")


def systematic_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """Every step-th row by key, n of them (M6); the step comes from the count."""
    step = max(1, df.count() // max(1, n))
    return numbered(df.select(key), F.col(key), out="_r").where(F.col("_r") % step == 0).orderBy("_r").limit(n).select(key)


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """z-scores by the population deviation (L1)."""
    stats = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"{c}_m"), F.stddev_pop(c).alias(f"{c}_s"))])
    return df.join(F.broadcast(stats)).select(*[c for c in df.columns if c not in columns], *[F.when(F.col(f"{c}_s") == 0, F.lit(0.0)).otherwise((F.col(c) - F.col(f"{c}_m")) / F.col(f"{c}_s")).alias(c) for c in columns])  # one row


def exact(a, b):
    """Euclidean distances of rows that stand side by side, by plain differences, as the measures to be matched."""
    return np.sqrt(((a - b) ** 2).sum(axis=1))


def _norms(x):
    return np.einsum("ij,ij->i", x, x)


def _about(a, b, bn):
    """Squared distances of the rows of a to those of b by one matrix product, and how far each row's may be off."""
    an = _norms(a)
    sq = a @ b.T
    sq *= -2
    sq += an[:, None]
    sq += bn
    return sq, 1e-12 * (1 + an + np.fmax.reduce(bn, initial=0.0))


def nearest_rows(vec, other, ids, k, decimals=9, step=64):
    """Of every row of vec its k nearest of other by (distance rounded, id): (row, places, distances).

    The product's distances leave few that may be among the k nearest; these are worked out by plain differences.
    """
    norms = _norms(other)
    for at in range(0, len(vec), step):
        some = vec[at : at + step]
        sq, off = _about(some, other, norms)
        edge = np.partition(sq, k - 1, axis=1)[:, k - 1] if len(other) > k else np.full(len(some), np.inf)
        # Up to what a rounded distance may hide, on both sides of the edge.
        far = (np.sqrt(np.maximum(edge + off, 0)) + 2 * 10.0**-decimals) ** 2 + off
        near = ~(sq > far[:, None])  # what is no number stays, and is ordered last
        for r in range(len(some)):
            places = np.flatnonzero(near[r])
            d = np.round(exact(some[r], other[places]), decimals)
            first = np.lexsort((ids[places], d))[:k]
            yield at + r, places[first], d[first]


def within(vec, other, eps, step=64):
    """Which rows of other lie within eps of rows of vec, (start, marks) for some rows at once; what is too near to eps to tell is worked out plainly."""
    norms = _norms(other)
    for at in range(0, len(vec), step):
        some = vec[at : at + step]
        sq, off = _about(some, other, norms)
        hit = sq <= (eps * eps + off)[:, None]
        rows, places = np.nonzero(hit & (sq >= (eps * eps - off)[:, None]))
        if len(rows):
            hit[rows, places] = exact(some[rows], other[places]) <= eps
        yield at, hit


def knn(train: DataFrame, test: DataFrame, k: int = 5, block: int = 4096) -> DataFrame:
    """Majority label of the k nearest train rows (L2); ties go to the smaller id, then the smaller label.

    Both have id, vec, label, and are dealt to blocks of about `block` rows; every block of test rows meets every block of
    train rows (a query set against all rows), which gives each its k best, and the k best of all blocks vote.
    """
    blocks, parts = (max(1, -(-df.count() // block)) for df in (train, test))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = train.select(deal(blocks).alias("block"), F.col("id").alias("tid"), F.col("vec").alias("tv"), F.col("label").cast("long").alias("tl")).select("*", every(parts).alias("part"))
    left = test.select(deal(parts).alias("part"), "id", "vec", F.col("label").alias("actual")).select("*", every(blocks).alias("block"))

    def best(tests, trains):
        if not len(tests) or not len(trains):
            return pd.DataFrame({"id": [], "actual": [], "tid": [], "tl": [], "d": []})
        tids, labels, rows = trains["tid"].to_numpy(), trains["tl"].to_numpy(), []
        found = nearest_rows(np.stack(tests["vec"]).astype(float), np.stack(trains["tv"]).astype(float), tids, k)
        own, actual = tests["id"].to_numpy(), tests["actual"].to_numpy()
        for r, places, d in found:
            rows += [(own[r], actual[r], tids[j], labels[j], x) for j, x in zip(places, d, strict=True)]
        return pd.DataFrame(rows, columns=["id", "actual", "tid", "tl", "d"])

    top = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(best, "id bigint, actual bigint, tid bigint, tl bigint, d double")
    top = top.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("d", "tid"))).where(F.col("r") <= k)
    votes = top.groupBy("id", "actual", "tl").agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "tl"))
    return votes.withColumn("r", first).where("r = 1").select("id", F.col("actual"), F.col("tl").alias("predicted"))


def binary_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1; 0 where undefined."""
    hit = lambda a, p: F.sum(((F.col(actual) == a) & (F.col(predicted) == p)).cast("long"))
    c = df.agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("tp", "fp", "fn", "tn", F.round((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), 6).alias("accuracy"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * p * r, p + r), 6).alias("f1"))


def gini(counts: np.ndarray) -> float:
    n = counts.sum()
    return 1 - float(((counts / n) ** 2).sum()) if n else 0.0


def logistic(x: np.ndarray, y: np.ndarray, rate: float = 0.01, rounds: int = 1000) -> tuple[np.ndarray, float]:
    """Batch gradient descent from zero weights (L3)."""
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(rounds):
        d = 1 / (1 + np.exp(-np.clip(x @ w + b, -250, 250))) - y
        w -= rate * (x.T @ d) / len(y)
        b -= rate * d.mean()
    return w, float(b)


def tree(x: np.ndarray, y: np.ndarray, depth: int = 5):
    """Gini tree over all thresholds; the first best split wins (L4). A leaf is a label, a node (feature, threshold, left, right)."""
    labels, n = np.unique(y, return_counts=True)
    if depth == 0 or len(labels) < 2:
        return labels[np.argmax(n)]
    best, split = np.inf, None
    hot = (y[:, None] == labels).astype(float)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, left = x[order, f], np.cumsum(hot[order], axis=0)
        for i in np.flatnonzero(v[1:] > v[:-1]):
            a, b = left[i], left[-1] - left[i]
            score = (a.sum() * gini(a) + b.sum() * gini(b)) / len(y)
            if score < best - 1e-12:
                best, split = score, (f, v[i])
    if split is None:
        return labels[np.argmax(n)]
    go = x[:, split[0]] <= split[1]
    return (*split, tree(x[go], y[go], depth - 1), tree(x[~go], y[~go], depth - 1))


def tree_predict(node, row) -> object:
    while isinstance(node, tuple):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node


def kmeans(df: DataFrame, k: int, column: str = "vec", restarts: int = 10, seed: int = 42) -> DataFrame:
    """The clustering of least cost among restarts (L7), by the built-in distributed k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.withColumn("_features", array_to_vector(F.col(column).cast("array<double>"))).cache()
    models = [KMeans(k=k, seed=seed + i, featuresCol="_features", predictionCol="cluster", maxIter=50).fit(rows) for i in range(restarts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(rows).drop("_features")


def in_blocks(df: DataFrame, other: DataFrame, work, schema: str, block: int = 4096) -> DataFrame:
    """What work(rows, others) makes of every block of rows with every block of the other table: all pairs, none of them a row.

    Both tables have id and vec; a task holds two blocks. The work grows with the product of the tables, not the memory.
    """
    mine, theirs = (max(1, -(-d.count() // block)) for d in (df, other))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = df.withColumn("_a", deal(mine)).withColumn("_b", every(theirs))
    # Fresh columns: the two tables may be the same.
    right = other.select(*[F.col(c).alias(c) for c in other.columns]).withColumn("_b", deal(theirs)).withColumn("_a", every(mine))
    return left.groupBy("_a", "_b").cogroup(right.groupBy("_a", "_b")).applyInPandas(work, schema)


def _matrix(frame: pd.DataFrame):
    return np.stack(frame["vec"]).astype(float)


def _distances(a: pd.DataFrame, b: pd.DataFrame, step: int = 64):
    """Euclidean distances of the rows of a to those of b, some rows of a at once: (rows of a, distances).

    By a matrix product; where rows are so near that it would lose digits, by plain differences.
    """
    vec, other = _matrix(a), _matrix(b)
    norms = _norms(other)
    for at in range(0, len(vec), step):
        some = vec[at : at + step]
        sq, off = _about(some, other, norms)
        rows, places = np.nonzero(sq <= 1e6 * off[:, None])
        d = np.sqrt(np.maximum(sq, 0, out=sq), out=sq)
        if len(rows):
            d[rows, places] = exact(some[rows], other[places])
        yield a.iloc[at : at + step], d


def dbscan(df: DataFrame, eps: float = 0.5, least: int = 5) -> DataFrame:
    """Clusters by density (L9): id, cluster (smallest core id of the component; -1 for noise).

    Three passes over blocks: neighbours are counted; of the links between core rows, each pair of blocks sends only those
    that join its rows; a border row takes the smallest cluster within reach. Rounds over the links are checkpointed.
    """
    rows = df.select("id", "vec")

    def count(a, b):
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "n": []})
        return pd.DataFrame({"id": a["id"], "n": np.concatenate([hit.sum(axis=1) for _, hit in within(_matrix(a), _matrix(b), eps)])})

    core = in_blocks(rows, rows, count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("id")
    cores = checkpoint(rows.join(core, "id", "left_semi"))

    def link(a, b):
        found = []
        if len(a) and len(b):
            ids, root = b["id"].to_numpy(), {}

            def top(x):
                while root.setdefault(x, x) != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            mine = a["id"].to_numpy()
            for at, hit in within(_matrix(a), _matrix(b), eps):
                for r, k in zip(*np.nonzero(hit), strict=True):
                    i, j = int(mine[at + r]), int(ids[k])
                    x, y = top(i), top(j)
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        found.append((i, j))
        return pd.DataFrame(found, columns=["a", "b"])

    links = in_blocks(cores, cores, link, "a bigint, b bigint").distinct()
    both = checkpoint(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = checkpoint(cores.select("id", F.col("id").alias("label")))
    while True:
        # The smallest label next to a row, and then that label's own.
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        moved = label.join(near, "id", "left").select("id", F.least("label", F.coalesce("near", "label")).alias("label"))
        jumped = moved.join(moved.select(F.col("id").alias("label"), F.col("label").alias("_next")), "label", "left")
        moved = checkpoint(jumped.select("id", F.coalesce("_next", "label").alias("label")))
        same = moved.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first() == label.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()
        label = moved
        if same:
            break
    reached = rows.join(label, "id", "left_anti")

    def border(a, b):
        found = []
        if len(a) and len(b):
            labels, mine = b["label"].to_numpy(), a["id"].to_numpy()
            marked = ((int(mine[at + r]), own) for at, hit in within(_matrix(a), _matrix(b), eps) for r, own in enumerate(hit))
            found = [(i, int(labels[own].min())) for i, own in marked if own.any()]
        return pd.DataFrame(found, columns=["id", "border"])

    edge = in_blocks(reached, checkpoint(cores.join(label, "id")), border, "id bigint, border bigint").groupBy("id").agg(F.min("border").alias("border"))
    out = df.join(label, "id", "left").join(edge, "id", "left")
    return out.select(*df.columns, F.coalesce("label", "border", F.lit(-1)).cast("long").alias("cluster"))


def ward(x: np.ndarray, k: int) -> np.ndarray:
    """Ward's agglomerative clustering of a bounded matrix (L10): labels 0..k-1 in order of first row."""
    size, center = {i: 1 for i in range(len(x))}, {i: x[i].astype(float) for i in range(len(x))}
    member = {i: [i] for i in range(len(x))}
    while len(size) > k:
        ids = np.array(list(size))
        c, n = np.stack([center[i] for i in ids]), np.array([size[i] for i in ids], float)
        sq = (c * c).sum(1)
        d = (sq[:, None] + sq - 2 * c @ c.T) * (n[:, None] * n / (n[:, None] + n))
        np.fill_diagonal(d, np.inf)
        a, b = np.unravel_index(np.argmin(d), d.shape)
        i, j = int(ids[min(a, b)]), int(ids[max(a, b)])
        center[i] = (center[i] * size[i] + center[j] * size[j]) / (size[i] + size[j])
        size[i] += size.pop(j)
        member[i] += member.pop(j)
        del center[j]
    out = np.zeros(len(x), int)
    for label, i in enumerate(sorted(member, key=lambda i: min(member[i]))):
        out[member[i]] = label
    return out


def cluster_indices(df: DataFrame, dim: int) -> DataFrame:
    """Calinski-Harabasz and Davies-Bouldin of (id, vec, cluster), noise (-1) left out (L11); one pass for the centres."""
    rows = df.where("cluster <> -1")
    long = rows.select("id", "cluster", F.posexplode("vec").alias("d", "x")).withColumn("x", F.col("x").cast("double"))
    centre = long.groupBy("cluster", "d").agg(F.avg("x").alias("c"))
    whole = long.groupBy("d").agg(F.avg("x").alias("w"))
    size = rows.groupBy("cluster").agg(F.count("*").alias("n"))
    spread = long.join(centre, ["cluster", "d"]).groupBy("id", "cluster").agg(F.sum(F.pow(F.col("x") - F.col("c"), 2)).alias("sq"))
    within = spread.groupBy("cluster").agg(F.sum("sq").alias("wss"), F.avg(F.sqrt("sq")).alias("s"))
    between = centre.join(whole, "d").groupBy("cluster").agg(F.sum(F.pow(F.col("c") - F.col("w"), 2)).alias("b"))
    per = size.join(within, "cluster").join(between, "cluster")
    ch = per.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("b")).alias("bss"), F.sum("wss").alias("wss"))
    gap = centre.alias("p").join(centre.alias("q"), "d").where("p.cluster <> q.cluster").groupBy(F.col("p.cluster").alias("i"), F.col("q.cluster").alias("j")).agg(F.sqrt(F.sum(F.pow(F.col("p.c") - F.col("q.c"), 2))).alias("m"))
    worst = gap.join(within.select(F.col("cluster").alias("i"), F.col("s").alias("si")), "i").join(within.select(F.col("cluster").alias("j"), F.col("s").alias("sj")), "j").groupBy("i").agg(F.max((F.col("si") + F.col("sj")) / F.col("m")).alias("r"))
    db = worst.agg(F.avg("r").alias("davies_bouldin"))
    return ch.join(F.broadcast(db)).select("k", "n", F.round((F.col("bss") / (F.col("k") - 1)) / (F.col("wss") / (F.col("n") - F.col("k"))), 6).alias("calinski_harabasz"), F.round("davies_bouldin", 6).alias("davies_bouldin"))


def cluster_profile(df: DataFrame, dim: int) -> DataFrame:
    """Size, share and the mean of every feature of (vec, cluster), one row a feature (A39); summed before the shuffle."""
    total = df.agg(F.count("*").alias("all"))
    means = [F.avg(F.get("vec", F.lit(d)).cast("double")).alias(f"m{d}") for d in range(dim)]
    g = df.groupBy("cluster").agg(F.count("*").alias("n"), *means).join(F.broadcast(total))  # one row
    return g.select("cluster", "n", (100 * F.col("n") / F.col("all")).alias("pct"), F.posexplode(F.array(*[f"m{d}" for d in range(dim)])).alias("d", "mean")).withColumn("d", F.col("d").cast("long"))


def silhouette(df: DataFrame) -> DataFrame:
    """Mean silhouette by Euclidean distance over (id, vec, cluster) (L11): distances are summed by cluster within blocks."""
    rows = df.where("cluster <> -1").select("id", "vec", "cluster")

    def sums(a, b):
        found = []
        if len(a) and len(b):
            ids, (names, of) = b["id"].to_numpy(), np.unique(b["cluster"].to_numpy(), return_inverse=True)
            hot = np.eye(len(names))[of]
            for some, d in _distances(a, b):
                own = some["id"].to_numpy()[:, None] == ids[None]
                d[own] = 0
                total, times = d @ hot, hot.sum(axis=0) - own @ hot
                found += [(i, int(c), int(names[k]), float(total[r, k]), float(times[r, k])) for r, (i, c) in enumerate(zip(some["id"], some["cluster"], strict=True)) for k in range(len(names))]
        return pd.DataFrame(found, columns=["id", "cluster", "other", "d", "n"])

    d = in_blocks(rows, rows, sums, "id bigint, cluster bigint, other bigint, d double, n double").groupBy("id", "cluster", "other").agg((F.sum("d") / F.nullif(F.sum("n"), F.lit(0.0))).alias("d"))
    ab = d.groupBy("id").agg(F.min(F.when(F.col("cluster") == F.col("other"), F.col("d"))).alias("a"), F.min(F.when(F.col("cluster") != F.col("other"), F.col("d"))).alias("b"))
    s = F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return ab.agg(F.round(F.avg(s), 6).alias("silhouette"), F.count("*").alias("n"))


def softmax(values: Column) -> Column:
    """Shares of an array of numbers."""
    top = F.array_max(values)
    powers = F.transform(values, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda s, y: s + y))


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product of two matrices of (i, j, x), as a join and sums."""
    right = b.select(F.col("i").alias("k"), F.col("j").alias("_j"), F.col("x").alias("_x"))
    joined = a.select("i", F.col("j").alias("k"), "x").join(right, "k")
    return joined.groupBy("i", F.col("_j").alias("j")).agg(F.sum(F.col("x") * F.col("_x")).alias("x"))


def random_sample(df: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    """n rows in hash order (M5)."""
    return df.orderBy(order_key(key, seed), key).limit(n)


def calibration_sample(df: DataFrame, key: str, text: str, seed: int = 49, short: int = 150) -> DataFrame:
    """A development set of 15 % of the rows, 40 to 100 of them, short texts first (M2)."""
    rows = df.count()
    n = min(max(40, int(0.15 * rows)), 100, rows)
    return df.orderBy(F.desc(F.length(text) <= short), order_key(key, seed), key).limit(n)


def uniform(key: str, salt: str) -> Column:
    """A number from 0 to 1 that depends on key and salt alone."""
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(salt)).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def simulated(df: DataFrame, key: str, label: str, labels: int, accuracy: float, rater: int) -> DataFrame:
    """A rater that keeps the label (0 to labels - 1) with a probability, and else takes one of the others (M7)."""
    away = 1 + F.floor((labels - 1) * uniform(key, f"v{rater}")).cast("int")
    return df.withColumn("label", F.when(uniform(key, f"u{rater}") < accuracy, F.col(label)).otherwise((F.col(label) + away) % labels))


def logistic_predict(df: DataFrame, columns: list[str], target: str, rate: float = 0.01, rounds: int = 1000) -> DataFrame:
    """The rows with p and predicted by logistic regression fitted to them (L3), in one barrier job (`fitting.logistic_fit`)."""
    w, b = logistic_fit(df, columns, target, rate, rounds)
    z = sum((F.lit(float(k)) * F.col(c) for k, c in zip(w, columns, strict=True)), F.lit(float(b)))
    p = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(250.0)), F.lit(-250.0))))
    return df.withColumn("p", p).withColumn("predicted", (F.col("p") >= 0.5).cast("long"))


def tree_column(df: DataFrame, columns: list[str], target: str, depth: int = 5) -> DataFrame:
    """The rows with the label of a tree fitted to them (L4), level by level (`fitting.tree_fit`), as one nested condition."""
    return df.withColumn("predicted", tree_label(tree_fit(df, columns, target, depth), columns))


def best_k(df: DataFrame, ks, column: str = "vec", seed: int = 42) -> DataFrame:
    """k and silhouette of the k-means with the greatest mean silhouette (squared distances); ties: the smaller k."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    rows = df.withColumn("_features", array_to_vector(F.col(column).cast("array<double>"))).cache()
    score = ClusteringEvaluator(featuresCol="_features", predictionCol="cluster")
    found = [(score.evaluate(KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="cluster", maxIter=50).fit(rows).transform(rows)), k) for k in ks]
    best = max(found, key=lambda x: (x[0], -x[1]))
    return df.sparkSession.createDataFrame([(best[1], best[0])], "k long, silhouette double")
