"""Quality rules: gradient-boosted trees over document statistics.

Statistics of the whole text are worked out in one pass over Arrow batches; the trees are fitted on all labelled
documents and applied in a second pass. What the fitting needs of the documents are counts: of each feature's values on
a grid, for the bins' edges, and sums of gradients by node and bin, whole numbers. Up to `HELD` documents' bins, ten
bytes each, are summed on the driver, more of them in a job a level; the trees are the same.
More symbols, repeats or capitals never raise the verdict (monotonic constraints).

Defined results: a null or empty text has no words, fails the base rule and is not kept; words are separated by
ASCII white space only; repeated rows get the same result; ties at the threshold are kept; without labels of both
kinds, the base rule alone decides; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting, runtime
from .boosting import Trees

#: Labelled documents whose bins the driver holds, at most: beyond, it gets their sums. Bins of a feature.
HELD, BINS = 1 << 18, 64
#: Low bits of a float32 that the grid of the features' values leaves out: steps of a 2048th.
GRID = 12
#: The verdict drops a document if its probability of quality is below this.
KEEP_FROM = 0.5

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The trees' features, and those with a constraint: the verdict never rises with them.
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "distinct", "capitals", "digits", "marks", "line_words")
FALLING = ("symbols", "dup_lines", "repeats", "capitals", "marks")
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_MARKS = b"!?"


def repeated_words(words: list[bytes], window: int = 8) -> int:
    """Words inside windows of 8 words that are found twice or more, the first included.

    Words are numbered; windows of 2, 4 and 8 words get the numbers of their different halves, so equal numbers are equal words.
    """
    n = len(words)
    if n <= window:
        return 0
    seen: dict[bytes, int] = {}
    a = np.fromiter(map(seen.setdefault, words, range(n)), np.int64, n)
    if len(seen) == n:
        return 0
    for step in (1, 2, 4):
        pairs = a[:-step] * n + a[step:]
        a = np.unique(pairs, return_inverse=True)[1] if step < 4 else pairs
    ordered = np.sort(a)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(a, twice))
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The base counts and the trees' features of one whole text."""
    text = text or ""
    data = text.encode()
    words = data.split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    dup = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    size = max(1, len(data))
    features = (
        float(np.log1p(n)),
        word_chars / max(1, n),
        symbols / max(1, word_chars),
        dup / max(1, len(lines)),
        repeats / max(1, n),
        len(set(words)) / max(1, n),
        (len(data) - len(data.translate(None, _UPPER))) / size,
        (len(data) - len(data.translate(None, _DIGIT))) / size,
        (len(data) - len(data.translate(None, _MARKS))) / size,
        n / max(1, len(lines)),
    )
    return (n, word_chars, symbols, dup, repeats), features


def labelled(df: DataFrame, labels: DataFrame) -> DataFrame:
    """features and quality of every labelled document; of rows under one doc_id, the least features."""
    named = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))

    def work(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "features": [list(statistics(t)[1]) for t in batch.column("text").to_pylist()]}

    # Only numbers are shuffled, not texts.
    found = runtime.per_batch(df.where(F.col("doc_id").isNotNull()), "doc_id bigint, features array<double>", work, ["doc_id", "text"])
    return found.groupBy("doc_id").agg(F.min("features").alias("features")).join(named, "doc_id").select("features", "quality")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(FEATURES))


def edges_of(found: DataFrame) -> list[np.ndarray]:
    """The edges of each feature's bins: quantiles of all documents' values on the grid, from their counts."""

    def count(batches):
        for batch in batches:
            x = _matrix(batch.column("features")).astype(np.float32).view(np.int32) >> GRID
            key, n = np.unique(x.astype(np.int64) + (np.arange(len(FEATURES)) << 32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    sums = found.select("features").mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toArrow().sort_by("key")
    key, n = sums.column("key").to_numpy(), sums.column("n").to_numpy()
    edges = []
    for f in range(len(FEATURES)):
        own = key >> 32 == f
        below = np.cumsum(n[own])
        at = np.searchsorted(below, np.linspace(0, 1, BINS + 1)[1:-1] * (below[-1] - 1), side="right")
        edges.append(((((np.unique((key[own] & 0xFFFFFFFF)[at]) + 1) << GRID) - 1).astype(np.int32)).view(np.float32).astype(np.float64))
    return edges


def sums_in_jobs(binned: DataFrame):
    """The histograms of rows that stay where they are: a job a level, sums of whole numbers."""
    sc = binned.sparkSession.sparkContext

    def sums(trees: Trees, t: int, level: int) -> np.ndarray:
        shared = sc.broadcast(trees)

        def run(batches):
            total = np.zeros((2, len(FEATURES), 2**level, BINS))
            for batch in batches:
                x, y = _bins(batch)
                total += boosting.histograms(x, y, shared.value.margin(x, t), shared.value.leaves(x, t), level, BINS)
            flat = total.ravel()
            cell = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(flat[cell].astype(np.int64))], names=["cell", "n"])

        got = binned.mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        flat = np.zeros(2 * len(FEATURES) * 2**level * BINS)
        flat[got.column("cell").to_numpy()] = got.column("n").to_numpy()
        shared.unpersist()
        return flat.reshape(2, len(FEATURES), 2**level, BINS)

    return sums


def _bins(batch) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, len(FEATURES))
    return x, batch.column("quality").to_numpy().astype(np.float64)


def train(df: DataFrame, labels: DataFrame, held: int = HELD, **kinds) -> Trees | None:
    """The trees, fitted on all labelled documents; None without labels of both kinds."""
    found = runtime.checkpoint(labelled(df, labels))
    n = {r["quality"]: r["count"] for r in found.groupBy("quality").count().collect()}
    if len(n) < 2:
        return None
    edges = edges_of(found)

    def work(batch: pa.RecordBatch) -> dict:
        return {"bins": [x.tobytes() for x in boosting.bins_of(_matrix(batch.column("features")), edges)], "quality": batch.column("quality")}

    binned = runtime.per_batch(found, "bins binary, quality int", work, ["features", "quality"])
    if sum(n.values()) <= held:
        sums = boosting.sums_held(*_bins(binned.toArrow()), BINS)
    else:
        sums = sums_in_jobs(runtime.checkpoint(binned))
    return boosting.grow(edges, n[1] / sum(n.values()), sums, {FEATURES.index(f): -1 for f in FALLING}, **kinds)


def judge(df: DataFrame, trees: Trees | None, keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the verdict's probability for every document."""
    schema = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, probability double"

    def work(batch: pa.RecordBatch) -> dict:
        found = [statistics(t) for t in batch.column("text").to_pylist()]
        base = np.array([b for b, _ in found], dtype=np.int64).reshape(-1, len(BASE))
        p = np.ones(len(found)) if trees is None else trees.probability(np.array([f for _, f in found]))
        failed = (base[:, 0] < 20) | (100 * base[:, 4] > 30 * base[:, 0])
        return {
            "doc_id": batch.column("doc_id"),
            **{name: base[:, k] for k, name in enumerate(BASE)},
            "base_failed": failed,
            "kept": ~failed & (p >= keep_from),
            "probability": p,
        }

    return runtime.per_batch(df, schema, work, ["doc_id", "text"])


def keep(df: DataFrame, trees: Trees | None, keep_from: float = KEEP_FROM) -> DataFrame:
    """The documents that pass the base rule and the trees' verdict, with all their columns."""

    def verdict(batch: pa.RecordBatch) -> list[bool]:
        found = [statistics(t) for t in batch.column("text").to_pylist()]
        p = np.ones(len(found)) if trees is None else trees.probability(np.array([f for _, f in found]))
        return [b[0] >= 20 and 100 * b[4] <= 30 * b[0] and q >= keep_from for (b, _), q in zip(found, p.tolist(), strict=True)]

    return runtime.filtered(df, verdict, ["text"])
