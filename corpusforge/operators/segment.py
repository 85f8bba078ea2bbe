"""Segmentation: tokenizers, unsupervised vocabularies, Viterbi and HMM decoding, and metrics over token lists.

Metrics are relational; decoding runs over Arrow batches with the vocabulary in a broadcast (its size is a parameter).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate, chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from ..session import checkpoint

#: Blocks of the rule tokenizer, first match first.
BLOCKS = (
    r"https?://\S+|www\.\S+|[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.]+|@[\p{L}\p{N}_\-.]{1,30}"
    r"|[\x{4e00}-\x{9fff}]+|[\x{3040}-\x{30ff}]+|[A-Za-z][A-Za-z0-9'’\-]*|[0-9]+(?:\.[0-9]+)?|\S"
)
TAGS = {"B": 0, "M": 1, "E": 2, "S": 3}


def blocks(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(BLOCKS), F.lit(0))


def normal(tokens: Column) -> Column:
    """Tokens with a letter or digit."""
    return F.filter(tokens, lambda t: t.rlike(r"[\p{L}\p{N}]"))


def boundaries(tokens: Column) -> Column:
    """End offsets of all tokens but the last, in the space of the tokens' own characters.

    A running sum, linear in the tokens: a fold over arrays would copy its array for each of them.
    """

    def ends(lengths: pa.Array) -> pa.Array:
        # Over the flat values of all lists: sums from each list's start, and each list's last one left out.
        n = pc.fill_null(pc.list_value_length(lengths), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        sums = np.cumsum(pc.fill_null(lengths.flatten(), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        stops = np.cumsum(n)
        before = np.where(stops - n > 0, sums[np.maximum(stops - n, 1) - 1] if len(sums) else 0, 0)
        keep = np.ones(len(sums), bool)
        keep[stops[n > 0] - 1] = False
        values = pa.array((sums - np.repeat(before, n))[keep].astype(np.int32))
        offsets = np.concatenate([[0], np.cumsum(np.maximum(n - 1, 0))]).astype(np.int32)
        mask = lengths.is_null() if lengths.null_count else None
        return pa.ListArray.from_arrays(pa.array(offsets), values, mask=mask)

    return F.arrow_udf(ends, "array<int>")(F.transform(tokens, F.length))


def ends_in(text: str, tokens: list[str]) -> list[int]:
    """Where the tokens end in the text itself, each looked for behind the one before; the text's own end is no boundary."""
    out, at = [], 0
    for t in tokens:
        found = text.find(t, at) if t else -1
        if found < 0:
            continue  # not in the text: it has no place there
        at = found + len(t)
        if at < len(text):
            out.append(at)
    return out


def aligned_boundaries(text: Column, tokens: Column) -> Column:
    """Ends of tokens as offsets in the text, marks and spaces counted (W10), so that the text can be cut at them."""

    def ends(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for start, n in slices(texts):
            rows = zip(texts.slice(start, n).to_pylist(), lists.slice(start, n).to_pylist(), strict=True)
            out.append(pa.array([None if t is None or x is None else ends_in(t, x) for t, x in rows], pa.list_(pa.int32())))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))

    return F.arrow_udf(ends, "array<int>")(text, tokens)


def cut(text: Column, ends: Column) -> Column:
    """A text cut at sorted offsets."""
    starts = F.concat(F.array(F.lit(0)), ends)
    stops = F.concat(ends, F.array(F.length(text)))
    return F.filter(F.zip_with(starts, stops, lambda a, b: F.substring(text, a + 1, b - a)), lambda x: x != "")


def tags(tokens: Column) -> Column:
    """B, M, E, S tags as 0 to 3."""
    one = lambda t: F.when(F.length(t) == 1, F.array(F.lit(3))).otherwise(F.concat(F.array(F.lit(0)), F.array_repeat(F.lit(1), F.length(t) - 2), F.array(F.lit(2))))
    return F.flatten(F.transform(F.filter(tokens, lambda t: t != ""), one))


def delimiter_tokens(c: Column) -> Column:
    """Tokens of an answer: parted by slashes if there are any, else by white space."""
    return F.filter(F.transform(F.when(F.contains(c, F.lit("/")), F.split(c, "/")).otherwise(F.split(c, r"\s+")), lambda t: F.trim(t)), lambda t: t != "")


def consistent(text: Column, tokens: Column) -> Column:
    """Whether the tokens are the text, spaces aside."""
    return F.regexp_replace(F.array_join(tokens, ""), r"\s+", "") == F.regexp_replace(text, r"\s+", "")


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = F.round(F.when(tp + fp == 0, 0.0).otherwise(tp / (tp + fp)), 4), F.round(F.when(tp + fn == 0, 0.0).otherwise(tp / (tp + fn)), 4)
    f = F.round(F.when(2 * tp + fp + fn == 0, 0.0).otherwise(2 * tp / (2 * tp + fp + fn)), 4)
    return [p.alias("precision"), r.alias("recall"), f.alias("f1")]


def shared_counts(ref: Column, hyp: Column) -> Column:
    """How many tokens two lists have in common, counts included (J10), within the row."""

    def counts(refs: pa.Array, hyps: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(refs), 16):
            rows = zip(refs.slice(at, 16).to_pylist(), hyps.slice(at, 16).to_pylist(), strict=True)
            out += [(Counter(r or ()) & Counter(h or ())).total() for r, h in rows]
        return pa.array(out, pa.int64())

    return F.arrow_udf(counts, "bigint")(ref, hyp)


def multiset_match(df: DataFrame, key: str, ref: str, hyp: str) -> DataFrame:
    """Per key: tokens in common with their counts, tokens of ref, tokens of hyp (J10); keys without any token are left out.

    Keys of one row, nearly all, are matched within the row; only tokens of keys with several rows, or none, are shuffled.
    """
    count = lambda rows, c, n: rows.select(key, F.explode(c).alias("t")).groupBy(key, "t").agg(F.count("*").alias(n))
    again = df.groupBy(key).count().where("count > 1").select(key)
    size = lambda c: F.greatest(F.size(c), F.lit(0)).cast("long")
    alone = df.where(F.col(key).isNotNull()).join(again, key, "left_anti")
    alone = alone.select(key, shared_counts(F.col(ref), F.col(hyp)).alias("tp"), size(ref).alias("n_ref"), size(hyp).alias("n_hyp")).where("n_ref + n_hyp > 0")
    rest = df.where(F.col(key).isNull()).unionByName(df.where(F.col(key).isNotNull()).join(again, key, "left_semi"))
    both = count(rest, ref, "r").join(count(rest, hyp, "h"), [key, "t"], "full").fillna(0, ["r", "h"])
    return alone.unionByName(both.groupBy(key).agg(F.sum(F.least("r", "h")).alias("tp"), F.sum("r").alias("n_ref"), F.sum("h").alias("n_hyp")))


def boundary_scores(df: DataFrame, ref: str, hyp: str) -> DataFrame:
    """Micro P, R, F1 of boundaries over all rows."""
    a, b = boundaries(normal(F.col(ref))), boundaries(normal(F.col(hyp)))
    # Places are different within a row, so what is not shared is the rest. One row's three counts are made once.
    rows = df.select(a.alias("a"), b.alias("b")).select(F.size("a").alias("na"), F.size("b").alias("nb"), F.size(F.array_intersect("a", "b")).alias("both")).where("na >= 0 AND nb >= 0")
    sums = rows.agg(F.sum("both").alias("tp"), F.sum(F.col("nb") - F.col("both")).alias("fp"), F.sum(F.col("na") - F.col("both")).alias("fn"))
    return sums.select("tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def consensus(df: DataFrame, methods: list[str], votes: int, text: str | None = None) -> Column:
    """Boundaries that at least `votes` methods share (A27): a sorted place that stands `votes` times in a row.

    Places are those of the tokens' own characters; with a text they are offsets in it (`aligned_boundaries`), where `cut` can cut.
    """
    place_of = lambda m: boundaries(normal(F.col(m))) if text is None else aligned_boundaries(F.col(text), normal(F.col(m)))
    every = F.array_sort(F.flatten(F.array(*[place_of(m) for m in methods])))
    # The one-element array binds the sorted places, so that they are worked out once.
    return F.flatten(F.transform(F.array(every), lambda e: F.array_distinct(F.filter(e, lambda x, i: F.get(e, i + votes - 1) == x))))


#: Bytes of texts whose tokens are made at once, and bytes (as estimated) of runs and tokens that a task remembers.
AT_ONCE, REMEMBERED = 1 << 17, 50_000_000


class Memo(dict):
    """What was made of earlier strings, forgotten as a whole once it takes more than `room` bytes; a very long string is not kept."""

    def __init__(self, room: int = REMEMBERED):
        super().__init__()
        self.room, self.held = room, 0

    def keep(self, key: str, value: list[str]) -> list[str]:
        size = 300 + 4 * len(key) + 60 * len(value) + 4 * sum(map(len, value))  # an upper estimate, objects included
        if size * 20 <= self.room:
            if self.held + size > self.room:
                self.clear()
                self.held = 0
            self.held += size
            self[key] = value
        return value


def slices(texts: pa.Array, most: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    """(start, length) of neighbouring rows with about `most` bytes of text together, at least one row each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, stop - at
        at = stop


def tokens_added(df: DataFrame, text: str, out: str, make: Callable[[], Callable], most: int = AT_ONCE) -> DataFrame:
    """The rows with the tokens of a text. make() gives a task's function from texts to lists of tokens, or to their Arrow array.

    Only the tokens of `most` bytes of text stand in Python's memory at a time, however many rows a batch has.
    """
    schema = T_.StructType([*df.schema, T_.StructField(out, T_.ArrayType(T_.StringType()))])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = make()
        for batch in batches:
            for start, n in slices(batch.column(at), most):
                rows = batch.slice(start, n)
                lists = cut(rows.column(at).to_pylist())
                if not isinstance(lists, pa.Array):
                    lists = pa.array(lists, pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*rows.columns, lists], names=[*rows.schema.names, out])

    return df.mapInArrow(run, schema)


#: Runs of letters, runs of digits and single marks.
PARTS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")


def by_runs(decode: Callable[[str], list[str]]) -> Callable[[list[str | None]], list[list[str]]]:
    """From texts to tokens: each run of letters as decode gives it, digits and marks as they stand; runs are remembered."""
    memo = Memo()

    def one(p: str) -> list[str]:
        if not p[0].isalpha():
            return [p]
        found = memo.get(p)
        return memo.keep(p, decode(p)) if found is None else found

    return lambda texts: [[t for p in PARTS.findall((x or "").lower()) for t in one(p)] for x in texts]


class FlatTokens:
    """From texts to an Arrow array of their tokens, as by_runs has them, without a Python object a token.

    `ends` gives for runs of letters, which stand behind each other in a string, where their tokens end. The tokens of a text
    are its bytes without white space, so only their lengths are worked out; a piece's different runs are decoded once.
    """

    SPACE, LETTER, DIGIT, MARK, OTHER, NEW = range(6)  # other: a word's character that begins no run of letters, such as a fraction

    def __init__(self, ends: Callable[[str, np.ndarray], np.ndarray], piece: int = 1 << 18):
        self.ends, self.piece = ends, piece
        self.kinds = np.full(0x110000, self.NEW, np.uint8)

    def kind(self, points: np.ndarray) -> np.ndarray:
        found = self.kinds[points]
        new = np.unique(points[found == self.NEW])
        for c in map(chr, new.tolist()):
            part = PARTS.fullmatch(c)
            self.kinds[ord(c)] = self.SPACE if not part else self.LETTER if c.isalpha() else self.DIGIT if re.match(r"\d", c) else self.OTHER if re.match(r"[^\W_]", c) else self.MARK
        return self.kinds[points] if len(new) else found

    def pieces(self, text: str) -> Iterator[tuple[int, str, np.ndarray, np.ndarray, np.ndarray]]:
        """Place, text, code points, kinds and starts of parts of neighbouring pieces; a piece ends where a part does."""
        at, size = 0, self.piece
        while at < len(text):
            piece = text[at : at + size]
            points = np.frombuffer(piece.encode("utf-32-le"), np.uint32)
            kind = self.kind(points)
            group = np.where(kind == self.OTHER, np.uint8(self.LETTER), kind)
            starts = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (group[1:] == self.MARK)]))
            if at + size < len(text):  # the last part may go on
                if len(starts) == 1:
                    size *= 2
                    continue
                stop = int(starts[-1])
                piece, points, kind, starts = piece[:stop], points[:stop], kind[:stop], starts[:-1]
            yield at, piece, points, kind, starts
            at, size = at + len(piece), self.piece

    @staticmethod
    def widths(points: np.ndarray) -> np.ndarray:
        """Bytes of each character in UTF-8."""
        return np.uint8(1) + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)

    def lengths(self, data: bytes, points: np.ndarray, kind: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a piece: how many tokens each part has (white space none), the tokens' bytes, and the text without white space."""
        width = self.widths(points)
        stops = np.concatenate([[0], np.cumsum(width, dtype=np.int32)]).astype(np.int32)
        edges = stops[np.append(starts, len(points))]
        first, n = kind[starts], np.ones(len(starts), np.int64)
        n[first == self.SPACE] = 0
        runs = first == self.LETTER
        parts = pa.StringArray.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(data))
        coded = parts.filter(pa.array(runs)).dictionary_encode()
        code, words = coded.indices.to_numpy(), coded.dictionary
        joined = str(words.buffers()[2].slice(0, pc.sum(pc.binary_length(words)).as_py()), "utf-8") if len(words) else ""
        sizes = pc.utf8_length(words).to_numpy().astype(np.int64)
        own = np.concatenate([[0], np.cumsum(self.widths(np.frombuffer(joined.encode("utf-32-le"), np.uint32)), dtype=np.int64)])
        places = np.flatnonzero(self.ends(joined, sizes)) + 1
        token_bytes, until = np.diff(own[places], prepend=0), np.searchsorted(places, np.cumsum(sizes), "right")
        count = np.diff(until, prepend=0)
        k = count[code]
        n[runs] = k
        source = np.repeat((until - count)[code] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        decoded = np.repeat(runs, n)
        out = np.empty(len(decoded), np.int32)
        out[decoded] = token_bytes[source]
        out[~decoded] = np.diff(edges)[~runs & (n > 0)]
        return n, out, np.frombuffer(data, np.uint8)[np.repeat(kind != self.SPACE, width)]

    def __call__(self, texts: list[str | None]) -> pa.ListArray:
        low = [(x or "").lower() for x in texts]
        begins = np.cumsum([0, *(len(x) + 1 for x in low)])
        offsets, before, bytes_, data = np.zeros(len(begins), np.int32), 0, [np.zeros(1, np.int32)], []
        for at, piece, points, kind, starts in self.pieces("\n".join(low)):
            n, out, rest = self.lengths(piece.encode(), points, kind, starts)
            here = slice(*np.searchsorted(begins, [at, at + len(piece)]))  # texts that begin in this piece
            offsets[here] = before + np.concatenate([[0], np.cumsum(n)])[np.searchsorted(starts, begins[here] - at)]
            before += len(out)
            offsets[here.stop :] = before
            bytes_.append(out)
            data.append(rest)
        ends = np.cumsum(np.concatenate(bytes_), dtype=np.int32)
        values = pa.StringArray.from_buffers(before, pa.py_buffer(ends), pa.py_buffer(np.concatenate(data) if data else b""))
        return pa.ListArray.from_arrays(pa.array(offsets), values)


def max_match(text: str, vocabulary: set[str], longest: int = 4) -> list[str]:
    """Longest dictionary hit of 2 or more characters from the left, else a character."""
    out, i = [], 0
    while i < len(text):
        n = next((n for n in range(min(longest, len(text) - i), 1, -1) if text[i : i + n] in vocabulary), 1)
        out.append(text[i : i + n])
        i += n
    return out


def viterbi(text: str, logp: dict[str, float], unknown: float, longest: int = 4, penalty: float = 0.0) -> list[str]:
    """Best unigram path; the first of equal ones."""
    best, back = [0.0] + [-math.inf] * len(text), [0] * (len(text) + 1)
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - longest), j):
            word = text[i:j]
            p = logp.get(word, unknown if j - i == 1 else -math.inf)
            if best[i] + p - penalty > best[j]:
                best[j], back[j] = best[i] + p - penalty, i
    out, j = [], len(text)
    while j:
        out.append(text[back[j] : j])
        j = back[j]
    return out[::-1]


def segmented(df: DataFrame, method: str, vocabulary: dict[str, int], text: str = "text", out: str = "tokens", longest: int = 4, smooth: float = 0.1, penalty: float = 0.0) -> DataFrame:
    """Tokens by max_match or viterbi; runs of letters are decoded, digits and marks stand alone."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        words = shared.value
        total = sum(words.values())
        logp = {w: math.log((n + smooth) / (total + smooth)) for w, n in words.items()}
        unknown, known = math.log(smooth / (total + smooth)), set(words)
        return by_runs(lambda run: max_match(run, known, longest) if method == "max_match" else viterbi(run, logp, unknown, longest, penalty))

    return tokens_added(df, text, out, make)


#: Letters of a run from which on it is taken in segments of that length, and letters of segments that are worked on at once.
LONG, SEGMENTS = 512, 1 << 17


class BmesHmm:
    """BMES hidden Markov model: Baum-Welch with expected counts summed in parallel, Viterbi ending in E or S.

    Runs are stepped through side by side, the longest first, so that those with a t-th letter stand in front.
    """

    ALLOWED = np.array([[0, 1, 1, 0], [0, 1, 1, 0], [1, 0, 0, 1], [1, 0, 0, 1]], float)
    #: The two states that each state may follow, and the two that may follow it.
    BEFORE, BEHIND = np.array([[2, 3], [0, 1], [0, 1], [2, 3]]), np.array([[1, 2], [1, 2], [0, 3], [0, 3]])

    def __init__(self, symbols: list[str]):
        n = len(symbols) + 1
        self.ids = np.full(max(map(ord, symbols), default=0) + 2, n - 1, np.int32)  # by code point; the last one stands for all beyond
        self.ids[[ord(c) for c in symbols]] = np.arange(n - 1)
        self.start = np.array([0.5, 0, 0, 0.5])
        self.move = self.ALLOWED / self.ALLOWED.sum(axis=1, keepdims=True)
        r = np.random.default_rng(0)
        self.emit = r.dirichlet(np.ones(n) * 50, 4)

    def encode(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.ids[np.minimum(points, len(self.ids) - 1)]

    @staticmethod
    def steps(lengths: np.ndarray) -> np.ndarray:
        """For each t, how many of the runs, the longest first, have a t-th letter."""
        return np.searchsorted(-lengths, -np.arange(lengths.max(initial=0)))

    def step(self, a: np.ndarray) -> np.ndarray:
        """State probabilities (4, runs) one move on."""
        (i, j), m = self.BEFORE.T, self.move
        return a[i] * m[i, range(4)][:, None] + a[j] * m[j, range(4)][:, None]

    def step_back(self, e: np.ndarray) -> np.ndarray:
        """Weights of the next letter's states (4, runs), one move back."""
        (i, j), m = self.BEHIND.T, self.move
        return e[i] * m[range(4), i][:, None] + e[j] * m[range(4), j][:, None]

    def expected(self, x: np.ndarray, lengths: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected transitions and emissions of runs of letters, which stand behind each other in x, each counted n times."""
        starts, long = np.cumsum(lengths) - lengths, lengths > LONG
        short = np.flatnonzero(~long & (lengths > 0))
        k = len(short)
        first = np.repeat(self.start[:, None], k, axis=1)
        move, emit = self._expected(x, starts[short], lengths[short], n[short], first, np.ones((4, k)), np.ones(k, bool))
        for r in np.flatnonzero(long):
            for part in self._segments(x[starts[r] : starts[r] + lengths[r]]):
                m, e = self._expected(x[starts[r] :], part[0], part[1], np.full(len(part[0]), n[r]), *part[2:])
                move += m
                emit += e
        return move, emit

    def _segments(self, x: np.ndarray) -> Iterator[tuple]:
        """A long run in segments that share their end letters, as arguments of _expected, some at a time.

        A segment's product of matrices takes the probabilities before it to those behind it, and the weights behind it
        to those before it; products are made side by side, and only they are gone through in order.
        """
        k = (len(x) - 1) // LONG  # the last segment has the rest, too
        rows = x[: (k - 1) * LONG].reshape(k - 1, LONG)
        product = np.repeat(np.eye(4)[None], k - 1, axis=0)
        for t in range(LONG):
            product = (product * self.emit[:, rows[:, t]].T[:, None, :]) @ self.move
            product /= product.sum(axis=(1, 2), keepdims=True)
        first, leave = np.empty((4, k)), np.ones((4, k))
        first[:, 0] = self.start
        for j in range(k - 1):
            p = first[:, j] @ product[j]
            first[:, j + 1] = p / p.sum()
        b = np.ones(4)
        for c in x[: (k - 1) * LONG : -1]:
            b = self.move @ (self.emit[:, c] * b)
            b /= b.sum()
        for j in range(k - 2, -1, -1):  # b: the weights at the first letter of segment j + 1, without that letter
            leave[:, j] = b
            b = product[j] @ (self.emit[:, x[(j + 1) * LONG]] * b)
            b /= self.emit[:, x[j * LONG]]
            b /= b.sum()
        starts = np.arange(k) * LONG
        lengths = np.where(starts == (k - 1) * LONG, len(x) - starts, LONG + 1)
        for at in range(0, k, max(1, SEGMENTS // LONG)):
            some = slice(at, at + max(1, SEGMENTS // LONG))
            yield starts[some], lengths[some], first[:, some], leave[:, some], starts[some] == (k - 1) * LONG

    def _expected(self, x: np.ndarray, starts: np.ndarray, lengths: np.ndarray, n: np.ndarray, first: np.ndarray, leave: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected counts by a scaled forward-backward: from the probabilities before the first letter to the weights behind the last.

        Where not `last`, the next segment has a row's last letter as its own first, and counts it.
        """
        order = np.argsort(-lengths, kind="stable")
        starts, lengths, n, first, leave, last = starts[order], lengths[order], n[order].astype(float), first[:, order], leave[:, order], last[order]
        alive, width = self.steps(lengths), self.emit.shape[1]
        letters, a, scale = [], [], []
        for t, k in enumerate(alive):
            letters.append(x[starts[:k] + t])
            p = (self.step(a[-1][:, :k]) if t else first) * self.emit[:, letters[-1]]
            scale.append(np.maximum(p.sum(axis=0), 1e-300))
            a.append(p / scale[-1])
        move, emit, b = np.zeros((4, 4)), np.zeros(self.emit.shape), np.empty((4, 0))
        for t in range(len(alive) - 1, -1, -1):
            k, more = alive[t], b.shape[1]
            ends = leave[:, more:k] / np.maximum((a[t][:, more:] * leave[:, more:k]).sum(axis=0), 1e-300)
            if more:
                e = self.emit[:, letters[t + 1]] * b / scale[t + 1]
                move += (a[t][:, :more] * n[:more]) @ e.T
                b = np.concatenate([self.step_back(e), ends], axis=1)
            else:
                b = ends
            gamma = a[t] * b
            gamma *= np.concatenate([n[:more], n[more:k] * last[more:k]]) / np.maximum(gamma.sum(axis=0), 1e-300)
            for s in range(4):
                emit[s] += np.bincount(letters[t], gamma[s], width)
        return move * self.move, emit

    def fit(self, runs: DataFrame, rounds: int = 6) -> BmesHmm:
        """runs: text and n, different runs with their counts; each round is one job whose sums are added by cell, so one table comes back.

        A task's sums are rounded to six places and added as decimals, so the order in which they arrive does not matter.
        """
        for _ in range(rounds):
            model = self

            def sums(batches, model=model):
                move, emit = np.zeros((4, 4)), np.zeros_like(model.emit)
                for batch in batches:
                    for at, k in slices(batch.column(0)):
                        rows = batch.slice(at, k)
                        texts = rows.column(0).to_pylist()
                        m, e = model.expected(model.encode("".join(texts)), np.array(list(map(len, texts))), rows.column(1).to_numpy())
                        move += m
                        emit += e
                cells = np.concatenate([move.ravel(), emit.ravel()])
                used = np.flatnonzero(cells)
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(cells[used])], names=["cell", "x"])

            exact = F.sum(F.round("x", 6).cast("decimal(38,6)")).cast("double")
            rows = runs.select("text", "n").mapInArrow(sums, "cell bigint, x double").groupBy("cell").agg(exact.alias("x")).collect()
            cells = np.zeros(16 + self.emit.size)
            for r in rows:
                cells[r["cell"]] = r["x"]
            move = cells[:16].reshape(4, 4) + 1e-6 * self.ALLOWED
            emit = cells[16:].reshape(self.emit.shape) + 1e-3
            self.move, self.emit = move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True)
        return self

    def cut(self, text: str) -> list[str]:
        return self.cut_all([text])[0]

    def cut_all(self, texts: list[str]) -> list[list[str]]:
        joined, lengths = "".join(texts), np.array(list(map(len, texts)), np.int64)
        places = np.flatnonzero(self.ends(joined, lengths)) + 1  # a run's last letter ends a token
        tokens = [joined[i:j] for i, j in zip(chain([0], places.tolist()), places.tolist())]
        at = [0, *np.searchsorted(places, np.cumsum(lengths), "right").tolist()]
        return [tokens[i:j] for i, j in zip(at, at[1:])]

    def ends(self, joined: str, lengths: np.ndarray) -> np.ndarray:
        """For runs of letters that stand behind each other: whether a letter ends a token, by the best path that ends in E or S."""
        with np.errstate(divide="ignore"):
            logs = np.log(self.move), np.log(self.emit), np.log(self.start)
        x, stops = self.encode(joined), np.cumsum(lengths)
        starts, ends = stops - lengths, np.zeros(len(x), bool)
        short = np.flatnonzero((lengths > 0) & (lengths <= LONG))
        self._best(x, starts[short], lengths[short], ends, *logs)
        for r in np.flatnonzero(lengths > LONG):
            ends[starts[r] : stops[r]] = self._best_of_long(x[starts[r] : stops[r]], *logs)
        return ends

    def _best(self, x: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ends: np.ndarray, move: np.ndarray, emit: np.ndarray, start: np.ndarray) -> None:
        """Marks in `ends` where the tokens of runs end, which are stepped through side by side; of equal paths the earlier state."""
        order = np.argsort(-lengths, kind="stable")
        starts = starts[order]
        alive, state = self.steps(lengths[order]), np.empty(len(order), np.int64)
        back, score = [], start[:, None]
        for t, k in enumerate(alive):
            if t:
                one, two = np.empty((4, k)), np.empty((4, k))
                for way, (be, bm) in ((one, (2, 0)), (two, (3, 1))):  # B and S follow E or S, M and E follow B or M
                    np.add(score[be, :k], move[be, ::3, None], out=way[::3])
                    np.add(score[bm, :k], move[bm, 1:3, None], out=way[1:3])
                back.append(two > one)
                score = np.maximum(one, two, out=one)
            score = score + emit[:, x[starts[:k] + t]]
            over = alive[t + 1] if t + 1 < len(alive) else 0
            state[over:k] = np.where(score[2, over:] > score[3, over:], 2, 3)
        for t in range(len(alive) - 1, -1, -1):
            k = alive[t]
            ends[starts[:k] + t] = state[:k] >= 2
            if t:
                state[:k] = self.BEFORE[state[:k], back[t - 1][state[:k], np.arange(k)].astype(np.int8)]

    def _best_of_long(self, x: np.ndarray, move: np.ndarray, emit: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Where the tokens of one run end: the sums and choices of _best in plain numbers, a byte a letter for the choices."""
        (i, j), every = self.BEFORE.T, range(4)
        (b1, m1, e1, s1), (b2, m2, e2, s2) = move[i, every].tolist(), move[j, every].tolist()
        b, m, e, s = (start + emit[:, x[0]]).tolist()
        back = bytearray(len(x))
        for at in range(0, len(x), SEGMENTS):
            for t, (eb, em, ee, es) in enumerate(emit[:, x[at : at + SEGMENTS]].T.tolist(), at):
                if not t:
                    continue
                b_, b__, m_, m__, e_, e__, s_, s__ = e + b1, s + b2, b + m1, m + m2, b + e1, m + e2, e + s1, s + s2
                back[t] = (b__ > b_) | (m__ > m_) << 1 | (e__ > e_) << 2 | (s__ > s_) << 3
                b, m, e, s = max(b_, b__) + eb, max(m_, m__) + em, max(e_, e__) + ee, max(s_, s__) + es
        state, ends, before = 2 if e > s else 3, np.zeros(len(x), bool), self.BEFORE.tolist()
        for t in range(len(x) - 1, -1, -1):
            if state >= 2:
                ends[t] = True
            state = before[state][back[t] >> state & 1]
        return ends


def without_stops(tokens: Column, stops) -> Column:
    """Tokens that are neither stop words nor digits alone."""
    return F.filter(tokens, lambda t: ~t.isin(list(stops)) & ~t.rlike("^[0-9]+$"))


def merged(tokens: list[str], vocabulary: set[str], part: str = r"[一-鿿]+") -> list[str]:
    """Adjacent tokens joined where the joined text is in the dictionary, the longest first."""
    fits, longest = re.compile(part).fullmatch, max(map(len, vocabulary), default=0)
    out, i = [], 0
    while i < len(tokens):
        size = 1
        if fits(tokens[i]):
            for n in range(min(longest, len(tokens) - i), 1, -1):
                if "".join(tokens[i : i + n]) in vocabulary and all(map(fits, tokens[i : i + n])):
                    size = n
                    break
        out.append("".join(tokens[i : i + size]))
        i += size
    return out


def untagged(text: str, tags: list[int]) -> list[str]:
    """Tokens of a text from its B, M, E, S tags (G11, back)."""
    out, word = [], ""
    for c, t in zip(text, tags, strict=True):
        if t in (TAGS["B"], TAGS["S"]) and word:
            out.append(word)
            word = ""
        word += c
        if t in (TAGS["E"], TAGS["S"]):
            out.append(word)
            word = ""
    return [*out, word] if word else out


def pseudo_vocabulary(df: DataFrame, tokens: str, least: int = 2, sizes: tuple[int, int] = (2, 4)) -> DataFrame:
    """Tokens of 2 to 4 characters that occur at least twice, with their counts."""
    t = df.select(F.explode(tokens).alias("token")).where(F.length("token").between(*sizes))
    return t.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def compression(df: DataFrame, text: str, hyp: str, ref: str) -> DataFrame:
    """Characters, tokens, characters a token, and the share of tokens that the reference never has."""
    k = df.select(F.explode(normal(F.col(hyp))).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    known = df.select(F.explode(normal(F.col(ref))).alias("t")).distinct().withColumn("known", F.lit(True))
    sums = k.join(known, "t", "left").agg(F.sum("n").alias("tokens"), F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)).alias("oov"))
    chars = df.agg(F.sum(F.length(text)).alias("chars"))
    return chars.join(F.broadcast(sums)).select("chars", "tokens", F.round(F.col("chars") / F.greatest("tokens", F.lit(1)), 3).alias("compression"), F.round(F.col("oov") / F.greatest("tokens", F.lit(1)), 4).alias("oov_rate"))  # one row each


def match_rates(df: DataFrame, key: str, ref: str, hyp: str, f1: float = 0.9) -> DataFrame:
    """Share of rows with equal tokens, and with a token F1 of at least f1."""
    m = multiset_match(df, key, ref, hyp).withColumn("f", F.round(2 * F.col("tp") / (F.col("n_ref") + F.col("n_hyp")), 4))
    rows = df.select(key, (normal(F.col(ref)) == normal(F.col(hyp))).cast("int").alias("exact")).join(m, key, "left")
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("exact"), 4).alias("exact_match"), F.round(F.avg(F.coalesce((F.col("f") >= f1).cast("int"), F.lit(0))), 4).alias("approx_match"))


def hmm_segmented(df: DataFrame, text: str = "text", out: str = "tokens", symbols: int = 3000, rounds: int = 3) -> DataFrame:
    """Tokens by the hidden Markov model, fitted to the different runs of letters with their counts."""
    letters = df.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))).alias("text")).groupBy("text").agg(F.count("*").alias("n"))
    letters = checkpoint(letters)  # every round reads them again
    counts = letters.select("n", F.explode(F.split("text", "")).alias("c")).where("c <> ''").groupBy("c").agg(F.sum("n").alias("n"))
    model = BmesHmm([r["c"] for r in counts.orderBy(F.desc("n"), "c").limit(symbols).collect()]).fit(letters, rounds)
    shared = df.sparkSession.sparkContext.broadcast(model)
    return tokens_added(df, text, out, lambda: FlatTokens(shared.value.ends), 1 << 19)


def calibrated(dev: DataFrame, vocabulary: dict[str, int], reference: Column, smooths=(0.01, 0.1, 0.5, 1.0, 2.0), penalties=tuple(0.5 * k for k in range(12)), mean: float = 2.1, away: float = 0.45) -> DataFrame:
    """smooth, penalty, f1 and mean_len of the best grid point (G7, O5): boundary F1, among points whose mean length is near, if any.

    dev is a bounded sample; every text meets every point of the grid, in parallel.
    """
    grid = dev.sparkSession.createDataFrame([(float(s), float(p)) for s in smooths for p in penalties], "smooth double, penalty double")
    shared = dev.sparkSession.sparkContext.broadcast(vocabulary)
    rows = dev.select("text", reference.alias("ref")).join(F.broadcast(grid))  # 60 rows

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, parts = shared.value, PARTS
        total, known = sum(words.values()), {}

        def ends(tokens) -> set[int]:
            return set(accumulate([len(t) for t in tokens][:-1]))

        for frame in frames:
            found = []
            for text, ref, smooth, penalty in zip(frame["text"], frame["ref"], frame["smooth"], frame["penalty"], strict=True):
                if smooth not in known:
                    known[smooth] = {w: math.log((n + smooth) / (total + smooth)) for w, n in words.items()}, math.log(smooth / (total + smooth))
                logp, unknown = known[smooth]
                own = [t for p in parts.findall((text or "").lower()) for t in (viterbi(p, logp, unknown, penalty=penalty) if p[0].isalpha() else [p])]
                a, b = ends(own), ends(list(ref))
                found.append((smooth, penalty, 1.0 if not a and not b else 2 * len(a & b) / max(1, len(a) + len(b)), sum(map(len, own)), len(own)))
            yield pd.DataFrame(found, columns=["smooth", "penalty", "f1", "chars", "tokens"])

    scored = rows.mapInPandas(run, "smooth double, penalty double, f1 double, chars bigint, tokens bigint")
    points = scored.groupBy("smooth", "penalty").agg(F.avg("f1").alias("f1"), (F.sum("chars") / F.greatest(F.sum("tokens"), F.lit(1))).alias("mean_len"))
    near = F.abs(F.col("mean_len") - mean) <= away
    best = F.max_by(F.struct("smooth", "penalty", "f1", "mean_len"), F.struct(near, F.round("f1", 9), F.round("mean_len", 9), -F.col("penalty"), -F.col("smooth")))
    return points.agg(best.alias("b")).select("b.smooth", "b.penalty", F.round("b.f1", 6).alias("f1"), F.round("b.mean_len", 6).alias("mean_len"))


def all_words(text: str, vocabulary: set[str], longest: int = 4) -> list[str]:
    """Every dictionary word of two characters or more in a text, by place, then length; characters in none stand alone (G2's full mode)."""
    found = [(i, n) for i in range(len(text)) for n in range(2, min(longest, len(text) - i) + 1) if text[i : i + n] in vocabulary]
    covered = {j for i, n in found for j in range(i, i + n)}
    return [text[i : i + n] for i, n in sorted(found + [(i, 1) for i in range(len(text)) if i not in covered])]
