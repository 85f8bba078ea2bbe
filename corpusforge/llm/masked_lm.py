"""Masked pseudo-likelihood: a bidirectional window network predicts every token from both sides.

Words are counted over all documents (one shuffle of partial counts). The most frequent words, `VOCABULARY` at most (a
histogram of the counts gives the cut-off), have ids of their own in the network; the rest share `OTHERS` ids by hash.
The network reads the words before and behind the hidden one, as classes, and predicts its id in two stages, both from
the context: the class, through a hidden layer, then the id within the class. Classes are clusters of ids with like
neighbours, counted over every window of all documents. A word of a shared id has its own share of
that id, its count in the *other* documents of the corpus: these counts grow with the corpus, stay distributed and
meet the documents' words in a shuffled join. A document's score is the sum of its words' conditional log-probabilities.

Training, in numpy, is over every window of all documents: the likelihood of the whole corpus and its gradient depend only
on how often each class stands between each two classes, and each id behind and before each class. These counts, whole
numbers in a table of fixed size, are summed over all documents, so the network is the same however the table is split.
The documents are encoded once, to two bytes a word in a checkpoint; neighbours and windows are both counted from it.

Defined results: words are lower-cased (A-Z) and separated by ASCII white space; beyond the ends stands a
boundary id; a null or empty text has 0 tokens, sum 0 and a null mean; repeated rows get the same scores; ties in
frequency are kept in or left out together; a word that no other document has counts as half a word; with nothing to
learn from, the network keeps its start values; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from itertools import compress, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime

VOCABULARY, OTHERS, CLASSES, DIM, HIDDEN = 4096, 64, 64, 16, 32
#: Neighbours told apart, by rank up to the last, which all rarer ones share; steps and rate of the training; partial counts kept.
FEATURES, STEPS, RATE, PARTIAL = 256, 120, 0.05, 200_000
#: Windows that are scored together, and counted together; words outside the vocabulary whose ids are kept.
BLOCK, COUNTED, KNOWN = 1 << 15, 1 << 18, 150_000
#: Unit of the log counts summed for a document: whole numbers, so the order of the sum does not matter.
LOG_UNIT = 1 << 30
#: Count of a word that no other document has.
UNSEEN = 0.5


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def word_counts(df: DataFrame) -> DataFrame:
    """word (binary), n: over all documents; each task sums before it sends."""
    runtime.ship(df.sparkSession)

    def run(batches):
        found: Counter = Counter()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
            found.clear()
            return batch

        for batch in batches:
            for text in batch.column("text").to_pylist():
                found.update(words_of(text))
                if len(found) >= PARTIAL:
                    yield out()
        yield out()

    return df.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int = VOCABULARY) -> list[tuple[bytes, int]]:
    """The words above the least count that at most `most` words reach, the most frequent first.

    The cut-off comes from a histogram (a row for each 64th of a doubling, a few thousand at most): no task sorts words.
    """
    band = F.floor(F.log2("n") * 64)
    bands = sorted(counts.groupBy(band.alias("b")).count().collect(), reverse=True)
    total, edge = 0, None
    for r in bands:
        total += r["count"]
        if total > most:
            break
        edge = r["b"]
    if edge is None:
        return []
    top = counts.where(band >= edge).collect()
    return sorted(((bytes(r["word"]), r["n"]) for r in top), key=lambda x: (-x[1], x[0]))


def other(word: bytes) -> int:
    """The shared id of a word outside the vocabulary: by the hash of its last letters and length."""
    return xxhash.xxh32_intdigest(word[-2:] + bytes([min(len(word), 20)])) % OTHERS


def classes_of(near: np.ndarray, seed: int = 5) -> np.ndarray:
    """The class of each id (0, the boundary, has its own): clusters by the square roots of the shares of their neighbours."""
    ids, near = len(near), near.astype(np.float32)
    near = np.sqrt(near / np.maximum(1, near.sum(axis=1, keepdims=True)))
    r = np.random.default_rng(seed)
    found = 1 + np.arange(ids) % (CLASSES - 1)
    seen = np.flatnonzero(near.any(axis=1))
    if len(seen) >= CLASSES:
        x = near[seen]
        centre = x[r.choice(len(seen), CLASSES - 1, replace=False)]
        for _ in range(12):
            own = np.argmax(2 * x @ centre.T - (centre * centre).sum(axis=1), axis=1)
            size = np.bincount(own, minlength=CLASSES - 1)
            centre = np.stack([np.bincount(own, x[:, k], CLASSES - 1) for k in range(x.shape[1])], axis=1).astype(np.float32) / np.maximum(1, size)[:, None]
            empty = np.flatnonzero(size == 0)
            centre[empty] = x[r.choice(len(seen), len(empty))]
        found[seen] = 1 + own
    found[0] = 0
    return found


class Ids(dict):
    """The id of each word; that of one outside the vocabulary is worked out and kept, up to a bound."""

    def __init__(self, words: list[bytes]):
        super().__init__({w: 1 + k for k, w in enumerate(words)})
        self.words = words

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN + len(self.words):
            self.clear()
            self.update((w, 1 + k) for k, w in enumerate(self.words))
        found = self[word] = 1 + len(self.words) + other(word)
        return found

    def __reduce__(self):
        return Ids, (self.words,)


@dataclass
class WindowNetwork:
    """ids: 0 boundary, 1.. vocabulary, then the shared ones; of: class by id; share: log of a shared id's summed count.

    p: f, g (classes, DIM) stand for the class before and behind; a, b, v, c lead to the class; u, d to the id within it.
    """

    ids: Ids
    of: np.ndarray
    p: dict[str, np.ndarray]
    share: np.ndarray = field(default_factory=lambda: np.zeros(OTHERS))

    def __post_init__(self):
        self.vocabulary = frozenset(self.ids.words)

    @property
    def base(self) -> int:
        return 1 + len(self.ids.words)

    def encode(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))

    def sides(self) -> np.ndarray:
        """The inputs (classes * classes, 2 DIM) of all pairs of classes before and behind."""
        n = len(self.p["f"])
        return np.concatenate([np.repeat(self.p["f"], n, axis=0), np.tile(self.p["g"], (n, 1))], axis=1)

    def tables(self) -> dict[str, np.ndarray]:
        """By (before, behind, class): log-probability of the class less the log of the sum within it; by (class, id): logits."""
        p = self.p
        z = np.tanh(self.sides() @ p["a"] + p["b"]) @ p["v"] + p["c"]
        z -= _log_sum(z)[:, None]
        before, behind = p["f"] @ p["u"][:DIM] + p["d"], p["g"] @ p["u"][DIM:]
        for k in range(CLASSES):
            own = np.flatnonzero(self.of == k)
            if len(own):
                z[:, k] -= np.log(np.exp(before[:, own]) @ np.exp(behind[:, own]).T).ravel()
        return {"of_class": z.ravel(), "before": before, "behind": behind}

    def log_probabilities(self, before: np.ndarray, ids: np.ndarray, behind: np.ndarray) -> np.ndarray:
        """The log-probability of each id between its neighbours' ids: that of its class, and of the id within it."""
        if not hasattr(self, "_tables"):
            self._tables = self.tables()
        t, l, r = self._tables, self.of[before], self.of[behind]
        return t["of_class"][(l * CLASSES + r) * CLASSES + self.of[ids]] + t["before"][l, ids] + t["behind"][r, ids]

    def log_probability(self, words: list[bytes]) -> float:
        """The summed conditional log-probabilities of a document's ids: a shared id stands for all its words."""
        ids = np.concatenate([[0], self.encode(words), [0]])
        return float(self.log_probabilities(ids[:-2], ids[1:-1], ids[2:]).sum())

    def gradients(self, n: Windows) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss (negative log-probability) of the counted windows and its gradients."""
        p, total = self.p, max(1, n.total)
        x = self.sides()
        h = np.tanh(x @ p["a"] + p["b"])
        z = h @ p["v"] + p["c"]
        z -= _log_sum(z)[:, None]
        seen = n.between.reshape(-1, CLASSES)
        loss = -(seen * z).sum()
        dz = np.exp(z) * seen.sum(axis=1, keepdims=True) - seen
        dh = (dz @ p["v"].T) * (1 - h * h)
        grads = {"v": h.T @ dz, "c": dz.sum(0), "a": x.T @ dh, "b": dh.sum(0)}
        dx = (dh @ p["a"].T).reshape(CLASSES, CLASSES, 2 * DIM)
        before, behind = p["f"] @ p["u"][:DIM] + p["d"], p["g"] @ p["u"][DIM:]
        loss -= (n.before * before).sum() + (n.behind * behind).sum()
        d_before, d_behind = -n.before.astype(np.float64), -n.behind.astype(np.float64)
        for k in range(CLASSES):
            own = np.flatnonzero(self.of == k)
            if not len(own):
                continue
            left, right, times = np.exp(before[:, own]), np.exp(behind[:, own]), n.between[:, :, k]
            z = left @ right.T
            loss += (times * np.log(z)).sum()
            share = times / z
            d_before[:, own] += left * (share @ right)
            d_behind[:, own] += right * (share.T @ left)
        grads["d"] = d_before.sum(0)
        grads["u"] = np.concatenate([p["f"].T @ d_before, p["g"].T @ d_behind])
        grads["f"] = dx[:, :, :DIM].sum(axis=1) + d_before @ p["u"][:DIM].T
        grads["g"] = dx[:, :, DIM:].sum(axis=0) + d_behind @ p["u"][DIM:].T
        return float(loss) / total, {k: g / total for k, g in grads.items()}

    def fit(self, windows: Windows, steps: int = STEPS, rate: float = RATE) -> list[float]:
        """Adam along the gradient over all counted windows; the mean losses."""
        m, s = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        losses = []
        for i in range(1, steps + 1 if windows.total else 1):
            loss, grads = self.gradients(windows)
            losses.append(loss)
            for k, g in grads.items():
                m[k] += 0.1 * (g - m[k])
                s[k] += 0.01 * (g * g - s[k])
                self.p[k] = self.p[k] - rate * (1 - 0.9 * i / steps) * (m[k] / (1 - 0.9**i)) / (np.sqrt(s[k] / (1 - 0.99**i)) + 1e-10)
        return losses


def _log_sum(z: np.ndarray) -> np.ndarray:
    top = z.max(axis=1)
    return top + np.log(np.exp(z - top[:, None]).sum(axis=1))


class Windows:
    """Counts over windows: between (before, behind, own class), before and behind (neighbour's class, own id)."""

    def __init__(self, ids: int):
        self.between = np.zeros((CLASSES, CLASSES, CLASSES), np.int64)
        self.before, self.behind = (np.zeros((CLASSES, ids), np.int64) for _ in range(2))

    @property
    def total(self) -> int:
        return int(self.between.sum())

    def add(self, model: WindowNetwork, before: np.ndarray, ids: np.ndarray, behind: np.ndarray) -> None:
        l, r, n = model.of[before], model.of[behind], self.before.shape[1]
        self.between += np.bincount((l * CLASSES + r) * CLASSES + model.of[ids], minlength=CLASSES**3).reshape(self.between.shape)
        self.before += np.bincount(l * n + ids, minlength=CLASSES * n).reshape(self.before.shape)
        self.behind += np.bincount(r * n + ids, minlength=CLASSES * n).reshape(self.behind.shape)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.between.ravel(), self.before.ravel(), self.behind.ravel()])

    @classmethod
    def of_flat(cls, flat: np.ndarray, ids: int) -> Windows:
        found, a, b = cls(ids), CLASSES**3, CLASSES * ids
        found.between, found.before, found.behind = flat[:a].reshape(found.between.shape), flat[a : a + b].reshape(CLASSES, ids), flat[a + b :].reshape(CLASSES, ids)
        return found


def network(top: list[tuple[bytes, int]], others: list[int], of: np.ndarray | None = None, seed: int = 5) -> WindowNetwork:
    """The untrained network; its biases give each class and each id its share of the corpus."""
    n = 1 + len(top) + OTHERS
    weight = np.concatenate([[1.0], [c for _, c in top], np.maximum(1, np.array(others, np.float64))])
    of = np.concatenate([[0], 1 + np.arange(n - 1) % (CLASSES - 1)]) if of is None else of
    mass = np.bincount(of, weight, CLASSES)
    r = np.random.default_rng(seed)
    p = {
        "f": r.normal(0, 0.3, (CLASSES, DIM)), "g": r.normal(0, 0.3, (CLASSES, DIM)), "a": r.normal(0, 0.3, (2 * DIM, HIDDEN)), "b": np.zeros(HIDDEN),
        "v": r.normal(0, 0.05, (HIDDEN, CLASSES)), "c": np.log(np.maximum(mass, 1.0) / max(1.0, mass.sum())), "u": r.normal(0, 0.05, (2 * DIM, n)), "d": np.log(weight / mass[of]),
    }
    return WindowNetwork(Ids([w for w, _ in top]), of.astype(np.int64), p, np.log(weight[1 + len(top) :]))


def train(df: DataFrame, vocabulary: int = VOCABULARY, steps: int = STEPS) -> WindowNetwork:
    """The trained network."""
    return train_on(df, runtime.checkpoint(word_counts(df)), vocabulary, steps)


def train_on(df: DataFrame, counts: DataFrame, vocabulary: int = VOCABULARY, steps: int = STEPS) -> WindowNetwork:
    """The network trained with the given word counts; only the vocabulary and tables of fixed size reach the driver."""
    runtime.ship(df.sparkSession)
    top = most_frequent(counts, vocabulary)
    shared = df.sparkSession.sparkContext.broadcast({w for w, _ in top})  # at most `vocabulary` words

    def tally(batches):
        n = [0] * OTHERS
        for batch in batches:
            for w, c in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if w not in shared.value:
                    n[other(w)] += c
        yield pa.RecordBatch.from_arrays([pa.array(range(OTHERS)), pa.array(n)], names=["k", "n"])

    sums = {r["k"]: r["n"] for r in counts.mapInArrow(tally, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    others = [sums.get(k, 0) for k in range(OTHERS)]
    plain = network(top, others)
    ids = runtime.checkpoint(encoded(df, plain))
    model = network(top, others, classes_of(count_neighbours(ids, len(plain.of))))
    model.fit(count_encoded(ids, model), steps)
    return model


def encoded(df: DataFrame, model: WindowNetwork) -> DataFrame:
    """ids (binary): a boundary and the ids of each document; they need the vocabulary only, not the classes."""
    shared, kind = df.sparkSession.sparkContext.broadcast(model), id_type(len(model.of))

    def work(batch: pa.RecordBatch) -> dict:
        model = shared.value
        return {"ids": [np.concatenate([[0], model.encode(words_of(t))]).astype(kind).tobytes() for t in batch.column("text").to_pylist()]}

    return runtime.per_batch(df, "ids binary", work, ["text"])


def id_type(ids: int) -> str:
    return "<u2" if ids <= 1 << 16 else "<u4"


def windows_in(batch: pa.RecordBatch, kind: str):
    """(before, own, behind) of every window of encoded documents, in blocks."""
    for part in runtime.slices(batch):
        flat = np.frombuffer(b"".join([*part.column("ids").to_pylist(), bytes(4)]), kind).astype(np.int64)
        at = np.flatnonzero(flat)
        for k in range(0, len(at), COUNTED):
            here = at[k : k + COUNTED]
            yield flat[here - 1], flat[here], flat[here + 1]


def count_neighbours(ids: DataFrame, n: int) -> np.ndarray:
    """How often each of n ids has each neighbour (n, 2 FEATURES), before and behind, over all encoded documents.

    A task sends a row for each id that it meets; rows are summed by id in tasks of their own, the driver gets one an id.
    """
    kind, width = id_type(n), 2 * FEATURES
    schema = "id int, n binary"

    def batch_of(found: list[int], rows) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["id", "n"])

    def count(batches):
        near = np.zeros((2, n * FEATURES), np.int64)
        for batch in batches:
            for before, own, behind in windows_in(batch, kind):
                for side, other_id in enumerate((before, behind)):
                    near[side] += np.bincount(own * FEATURES + np.minimum(other_id, FEATURES - 1), minlength=n * FEATURES)
        near = near.reshape(2, n, FEATURES)
        seen = np.flatnonzero(near[0].any(axis=1))  # every window has both sides
        for k in range(0, len(seen), 512):
            own = seen[k : k + 512]
            yield batch_of(own.tolist(), np.concatenate([near[0, own], near[1, own]], axis=1))

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column("id").to_pylist(), batch.column("n"), strict=True):
                if i not in total:
                    total[i] = np.zeros(width, np.int64)
                total[i] += np.frombuffer(row.as_buffer(), np.int64)
        yield batch_of(list(total), total.values())

    near = np.zeros((n, width), np.int64)
    for r in ids.mapInArrow(count, schema).repartition("id").mapInArrow(add, schema).collect():
        near[r["id"]] = np.frombuffer(r["n"], np.int64)
    return near


def gathered(texts: list[str | None], model: WindowNetwork):
    """(before, own, behind, document) of every window of the texts, in blocks; and each text's words."""
    words = [words_of(t) for t in texts]
    size = np.array([len(w) for w in words], np.int64)
    flat = np.zeros(int(size.sum()) + len(size) + 1, np.int64)  # a boundary before each text and at the end
    owner = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(owner)) + owner + 1
    flat[at] = np.concatenate([model.encode(w) for w in words]) if len(owner) else 0
    parts = (slice(k, k + BLOCK) for k in range(0, len(at), BLOCK))
    return words, ((flat[at[k] - 1], flat[at[k]], flat[at[k] + 1], owner[k]) for k in parts)


def count_windows(df: DataFrame, model: WindowNetwork) -> Windows:
    """The counts over every window of all documents."""
    return count_encoded(encoded(df, model), model)


def count_encoded(ids: DataFrame, model: WindowNetwork) -> Windows:
    """The counts over encoded documents; each task sends what is not zero, the driver gets one sum a cell."""
    shared, kind = ids.sparkSession.sparkContext.broadcast(model), id_type(len(model.of))

    def run(batches):
        own = Windows(len(shared.value.of))
        for batch in batches:
            for before, middle, behind in windows_in(batch, kind):
                own.add(shared.value, before, middle, behind)
        flat = own.flat()
        cell = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(flat[cell])], names=["cell", "n"])

    sums = ids.mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    flat = Windows(len(model.of)).flat()
    flat[sums.column("cell").to_numpy()] = sums.column("n").to_numpy()
    return Windows.of_flat(flat, len(model.of))


def score(df: DataFrame, model: WindowNetwork, counts: DataFrame | None = None) -> DataFrame:
    """doc_id, n_tokens, log_probability (sum), mean_log_probability and unseen_share of every document.

    unseen_share: of its words, those that no other document of the corpus has. A row of each document and one of each of
    its different words outside the vocabulary meet the counts by word, and each other again by row. A document's own
    row has a key with a space, which no word has.
    """
    counts = word_counts(df) if counts is None else counts
    runtime.ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> dict:
        model = shared.value
        rows, docs, texts = (batch.column(c).to_pylist() for c in ("row", "doc_id", "text"))
        words, blocks = gathered(texts, model)
        sums, rest, times, of_rest, base, outer = np.zeros(len(rows)), [], [], [], model.base, []
        for before, ids, behind, owner in blocks:
            z = model.log_probabilities(before, ids, behind)
            z -= np.where(ids >= base, model.share[np.maximum(ids - base, 0)], 0.0)
            sums += np.bincount(owner, z, len(rows))
            outer.append(ids >= base)
        outer = iter(np.concatenate(outer).tolist() if outer else [])
        for row, own in zip(rows, words, strict=True):
            outside = Counter(compress(own, islice(outer, len(own))))
            rest += outside
            times += outside.values()
            of_rest += [row] * len(outside)
        sizes = [len(w) for w in words]
        own = [b" %d" % r for r in rows]
        none = [None] * len(rest)
        return {
            "row": rows + of_rest, "doc_id": docs + none, "n_tokens": sizes + none, "sum": sums.tolist() + none, "word": own + rest, "times": [0] * len(rows) + times,
        }

    keyed = df.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    sent = runtime.per_batch(keyed, "row bigint, doc_id bigint, n_tokens bigint, sum double, word binary, times bigint", work, ["row", "doc_id", "text"])
    # Words seen once are seen in no other document: they need not be met.
    met = sent.join(counts.where("n > 1").hint("merge"), "word", "left")
    others = F.coalesce("n", F.col("times")) - F.col("times")
    log_n = F.rint(F.log(F.greatest(others.cast("double"), F.lit(UNSEEN))) * LOG_UNIT).cast("long") * F.col("times")
    unseen = F.when(others <= 0, F.col("times")).otherwise(0)
    by_row = met.select("row", "doc_id", "n_tokens", "sum", log_n.alias("log_n"), unseen.alias("unseen")).groupBy("row")
    by_row = by_row.agg(*[F.max(c).alias(c) for c in ("doc_id", "n_tokens", "sum")], F.sum("log_n").alias("log_n"), F.sum("unseen").alias("unseen"))
    total = F.col("sum") + F.col("log_n") / LOG_UNIT
    some = F.col("n_tokens") > 0
    return by_row.select(
        "doc_id", "n_tokens", total.alias("log_probability"), F.when(some, total / F.col("n_tokens")).alias("mean_log_probability"), F.when(some, F.col("unseen") / F.col("n_tokens")).alias("unseen_share")
    )
