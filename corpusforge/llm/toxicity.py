"""Toxicity: Levenshtein automata over a lexicon trie, with scores for the words around a hit.

The lexicon is learnt: words, and beginnings of words (stems), that stand in far more toxic than clean labelled documents,
by likelihood ratio (`EVIDENCE`) and by `LIFT`, and not in one group
of near copies only (`SPREAD`); of a word and its stems the one with most evidence is kept. Terms form a trie. A
word of a text becomes a Levenshtein automaton (a bit mask of its positions for each number of errors), which runs along the
trie's arcs: a subtree is left when no position is alive, so all terms within the allowed errors (`errors_of` a term's length) are
met in one walk. Words that no term can be near to skip it: those that agree with none when each loses a letter (one error), or share no intact
piece with any (a term within k errors keeps one of k + 1 pieces).

Each hit is scored by its term and errors, its spelling, quotation marks next to it and the `WINDOW` words before and behind it: weights are
log-odds of toxic against clean documents, shrunk to no opinion where there is little evidence. Words of quotation and report around
a hit thus lower it as far as clean documents have them. A document's evidence is the logarithm of its hits' summed odds; a monotone table
(pooled neighbours) turns it into a probability. A training document is scored without its own counts when the table is made.

All labelled documents that may be learnt from are used, equal texts once (the label of most of them; ties: toxic). Fixed in size are the
candidates for the lexicon (`CANDIDATES`, those of most evidence), and the tables of words around hits (`BUCKETS`, by hash). Counts are whole numbers,
so the model does not depend on how a table is split.

Defined results: a null, empty or wordless text has no hits and the score of documents without any; a null doc_id counts as the empty string for the hash
(held out) and has no label; null labels are ignored; of several labels of a document the largest counts; without any label of either kind all scores are the share of
toxic ones (0.5 if there are no labels); repeated rows get a row each; an empty table gives an empty table; other columns, whatever their names, are never read; texts are
read whole, long ones in chunks of words that overlap by a window.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runtime

#: A word, with single marks inside it (as in a disguised spelling), or a quotation mark.
TOKEN = re.compile(r"[^\W_]+(?:[@$*!|+][^\W_]+)*|[\"“”„«»‹›]")
QUOTES = frozenset("\"“”„«»‹›")
FOLDS, SHORTEST, STEM, LONGEST_STEM = 5, 3, 4, 8
EVIDENCE, LIFT, CANDIDATES = 24.0, 5.0, 20_000
#: Groups that toxic documents are dealt to by what they say, and how many (as 1 / the sum of squared shares) a term must stand in.
GROUPS, SPREAD = 8, 2.5
WINDOW, BUCKETS, SHRINK, CLIP = 4, 4096, 16.0, 6.0
GRID, STEP = 120, 0.5
#: Keys counted by a task before it hands them on; words remembered by a worker; words of a chunk of a long text.
HELD, REMEMBERED, CHUNK, LONG_TEXT = 300_000, 300_000, 100_000, 1 << 20


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


def errors_of(term: str, stem: bool) -> int:
    """The errors that a spelling of the term may have."""
    if stem:
        return 1 if len(term) >= 6 else 0
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


# Lexicon


class Lexicon:
    """A trie of terms, walked by the Levenshtein automaton of a word. terms: (text, stem), the most telling first."""

    def __init__(self, terms: list[tuple[str, bool]]) -> None:
        self.terms = terms
        self.root: list = [{}, [], 0]  # arcs, ends (term, stem, errors), most errors below
        #: Words of few errors and what they leave when a letter is missing, by length of the words that may be near; stems likewise, by their own length.
        self.short: dict[int, set] = {}
        self.stems: dict[int, set] = {}
        #: Stems without errors by length, and halves of the others by place, with the lengths of the stems that have them there.
        self.exact: dict[int, set] = {}
        self.halves: dict[tuple[int, int], dict[str, set]] = {}
        #: Pieces by their place, and by length of the words that may be near, with the letters of their terms.
        self.pieces: dict[int, dict[tuple, dict]] = {}
        for k, (term, stem) in enumerate(terms):
            allowed, node = errors_of(term, stem), self.root
            node[2] = max(node[2], allowed)
            for c in term:
                node = node[0].setdefault(c, [{}, [], 0])
                node[2] = max(node[2], allowed)
            node[1].append((k, stem, allowed))
            less = {term} | ({term[:j] + term[j + 1 :] for j in range(len(term))} if allowed else set())
            if stem and not allowed:
                self.exact.setdefault(len(term), set()).add(term)
            elif stem:
                self.stems.setdefault(len(term), set()).update(less)
                half = len(term) // 2
                self.halves.setdefault((0, half), {}).setdefault(term[:half], set()).add(len(term))
                for d in (-1, 0, 1):
                    self.halves.setdefault((half + d, len(term) + d), {}).setdefault(term[half:], set()).add(len(term))
            elif allowed < 2:
                for length in range(len(term) - allowed, len(term) + allowed + 1):
                    self.short.setdefault(length, set()).update(less)
            else:
                self._cut(term, allowed)

    def _cut(self, term: str, errors: int) -> None:
        """Notes where an intact piece of the term may stand in a word with that many errors."""
        n = len(term)
        at = [n * k // (errors + 1) for k in range(errors + 2)]
        places = [(0, at[1], term[: at[1]]), (at[-2] - n, None, term[at[-2] :])]
        for k in range(1, errors):
            places += [(at[k] + d, at[k + 1] + d, term[at[k] : at[k + 1]]) for d in range(1 - errors, errors) if at[k] + d >= 0]
        for length in range(n - errors, n + errors + 1):
            here = self.pieces.setdefault(length, {})
            for a, b, piece in places:
                here.setdefault((a, b), {}).setdefault(piece, []).append((frozenset(term), errors))

    def possible(self, word: str) -> bool:
        """False only for words that no term can be near to: equal words, or words an error apart, agree when each may lose a letter."""
        near = self.short.get(len(word))
        if near is not None:
            if word in near:
                return True
            for k in range(len(word)):
                if word[:k] + word[k + 1 :] in near:
                    return True
        for n, stems in self.exact.items():
            if word[:n] in stems:
                return True
        for (a, b), lengths in self.halves.items():
            for n in lengths.get(word[a:b], ()):
                near, start = self.stems[n], word[: n + 1]
                if start[: n - 1] in near or start[:n] in near or start in near:
                    return True
                for k in range(len(start)):
                    left = start[:k] + start[k + 1 :]
                    if left in near or left[:-1] in near:
                        return True
        for (a, b), pieces in self.pieces.get(len(word), {}).items():
            for letters, errors in pieces.get(word[a:b], ()):
                if len(letters.difference(word)) <= errors:  # each error takes one letter of the term at most
                    return True
        return False

    def find(self, word: str) -> tuple[int, int] | None:
        """The nearest term and its errors (ties: the most telling term); None if none is near enough."""
        return self.walk(word) if self.possible(word) else None

    def walk(self, word: str) -> tuple[int, int] | None:
        """As `find`, by the automaton alone: bit i of row e says that i letters of the word are read with e errors."""
        masks: dict[str, int] = {}
        for k, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << k
        full, end = (1 << (len(word) + 1)) - 1, 1 << len(word)
        start = tuple((1 << (e + 1)) - 1 & full for e in range(self.root[2] + 1))
        best, stack = None, [(self.root, start)]
        while stack:
            node, rows = stack.pop()
            for c, child in node[0].items():
                mask = masks.get(c, 0)
                now = (rows[0] & mask) << 1
                after, alive = [now], now
                for e in range(1, child[2] + 1):
                    now = (((rows[e] & mask) << 1) | rows[e - 1] | (rows[e - 1] << 1) | (now << 1)) & full
                    after.append(now)
                    alive |= now
                if not alive:
                    continue
                for k, stem, errors in child[1]:
                    for e in range(errors + 1):
                        if after[e] if stem else after[e] & end:
                            if best is None or (e, k) < best[:2]:
                                best = (e, k)
                            break
                if child[0]:
                    stack.append((child, after))
        return None if best is None else (best[1], best[0])


def words_of(text: str) -> list[str]:
    return [w for w in TOKEN.findall(text.lower()) if w not in QUOTES]


def stems_of(words: set[str]) -> set[str]:
    """The beginnings of a text's words, each once."""
    return {w[:k] for k in range(STEM, LONGEST_STEM + 1) for w in words if len(w) >= k}


def group_of(tokens: list[str]) -> int:
    """A text's group: near copies mostly share the least hash of two words."""
    least = min((zlib.crc32(f"{a} {b}".encode()) for a, b in zip(tokens, tokens[1:])), default=0)
    return zlib.crc32(b"%d" % least) % GROUPS


def _chosen(candidates: list[tuple[str, bool]]) -> list[tuple[str, bool]]:
    """Of words and stems, the most telling first, those that are no stem of, and do not start with, one before them."""
    kept, beginnings, stems = [], set(), set()
    for term, stem in candidates:
        inside = any(term[:k] in stems for k in range(STEM, len(term) + 1))
        if inside or (stem and term in beginnings):
            continue
        kept.append((term, stem))
        beginnings.update(term[:k] for k in range(1, len(term) + 1))
        if stem:
            stems.add(term)
    return kept


def lexicon(training: DataFrame, toxic: int, clean: int) -> list[tuple[str, bool]]:
    """The terms of training documents (toxic, text), of which so many are toxic and clean."""
    if not toxic or not clean:
        return []
    runtime.ship(training.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Words, then stems. A key's toxic documents by group lie in one number, 32 bits each.
        toxic_of: tuple[dict[str, int], dict[str, int]] = ({}, {})
        clean_of = (Counter(), Counter())

        def out(stem: bool) -> pa.RecordBatch:
            marked, plain = toxic_of[stem], clean_of[stem]
            rest = plain.keys() - marked.keys()
            groups = np.zeros((GROUPS, len(marked) + len(rest)), np.int64)
            packed = b"".join(n.to_bytes(4 * GROUPS, "little") for n in marked.values())
            groups[:, : len(marked)] = np.frombuffer(packed, "<u4").reshape(-1, GROUPS).T
            keys = [*marked, *rest]
            columns = [pa.array(keys, pa.string()), pa.array(np.full(len(keys), stem)), *map(pa.array, groups), pa.array([plain.get(k, 0) for k in keys], pa.int64())]
            marked.clear()
            plain.clear()
            return pa.RecordBatch.from_arrays(columns, names=["term", "stem", *names])

        for batch in batches:
            for part in runtime.slices(batch):
                for is_toxic, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    tokens = words_of(text)
                    words = set(tokens)
                    both = {w for w in words if len(w) >= SHORTEST}, stems_of(words)
                    if is_toxic:
                        one = 1 << 32 * group_of(tokens)
                        for counts, keys in zip(toxic_of, both):
                            for key in keys:
                                counts[key] = counts.get(key, 0) + one
                    else:
                        clean_of[0].update(both[0])
                        clean_of[1].update(both[1])
                    for stem in (False, True):
                        if len(clean_of[stem]) + len(toxic_of[stem]) > HELD:
                            yield out(stem)
        yield out(False)
        yield out(True)

    names = [*(f"t{g}" for g in range(GROUPS)), "b"]
    counted = training.select("toxic", "text").mapInArrow(run, f"term string, stem boolean, {', '.join(f'{n} bigint' for n in names)}")
    summed = counted.groupBy("term", "stem").agg(*(F.sum(n).alias(n) for n in names))
    total = lambda power: sum((F.col(f"t{g}") ** power for g in range(GROUPS)), F.lit(0.0))
    a, b, share = total(1), F.col("b"), toxic / (toxic + clean)
    both = a + b
    ratio = 2 * (a * F.log(a / (both * share)) + F.when(b > 0, b * F.log(b / (both * (1 - share)))).otherwise(0.0))
    spread = a * a >= SPREAD * total(2)
    telling = summed.where((a > 0) & (a * clean >= LIFT * toxic * b) & spread).withColumn("g", F.round(ratio, 6)).where(F.col("g") >= EVIDENCE)
    # A stem must tell twice as much as a word, which may be misspelled anywhere; of equal ones longer stems come first.
    rank = F.desc(F.when(F.col("stem"), F.col("g") / 2).otherwise(F.col("g")))
    top = telling.orderBy(rank, "stem", F.desc(F.length("term")), "term").limit(CANDIDATES).select("term", "stem").collect()
    return _chosen([(r["term"], r["stem"]) for r in top])


# Hits


def _hash(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


def _chunks(text: str) -> Iterator[tuple[list[str], int, int]]:
    """The words of a text in lists, with the part of each that is its own; the rest belongs to its neighbours."""
    if len(text) <= LONG_TEXT:
        words = TOKEN.findall(text)
        yield words, 0, len(words)
        return
    words, lead = [], 0
    for m in TOKEN.finditer(text):
        words.append(m[0])
        if len(words) == CHUNK + lead + WINDOW:
            yield words, lead, len(words) - WINDOW
            words, lead = words[-2 * WINDOW :], WINDOW
    yield words, lead, len(words)


class Finder:
    """Finds hits and their features; remembers words that it has looked up, up to a bound."""

    def __init__(self, terms: list[tuple[str, bool]]) -> None:
        self.lexicon, self.known = Lexicon(terms), {}
        self.spelled = 3 * len(terms)
        self.before, self.behind = self.spelled + BUCKETS, self.spelled + 2 * BUCKETS
        self.quoted = self.spelled + 3 * BUCKETS
        self.features = self.quoted + 4

    def hits(self, text: str | None) -> Iterator[list[int]]:
        """The features of every hit: term and errors first, its spelling, marks next to it, then words around it."""
        if not text or not self.lexicon.terms:
            return
        known = self.known
        for words, begin, end in _chunks(text.lower()):
            found = {}
            for word in set(words):
                hit = known.get(word, 0)
                if hit == 0:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    hit = known[word] = self.lexicon.find(word) if word not in QUOTES else None
                if hit is not None:
                    found[word] = hit
            if not found:
                continue
            for k in range(begin, end):
                hit = found.get(words[k])
                if hit is not None:
                    left, right = words[max(0, k - WINDOW) : k], words[k + 1 : k + 1 + WINDOW]
                    marks = 2 * any(w in QUOTES for w in left) + any(w in QUOTES for w in right)
                    features = [3 * hit[0] + hit[1], self.spelled + _hash(words[k]), self.quoted + marks]
                    features += [self.before + _hash(w) for w in left if w not in QUOTES and w not in found]
                    features += [self.behind + _hash(w) for w in right if w not in QUOTES and w not in found]
                    yield features


def _logit(p: np.ndarray) -> np.ndarray:
    return np.log(p) - np.log1p(-p)


@dataclass
class Model:
    """Terms, counts of toxic and clean documents by feature, and the probability of every step of evidence."""

    terms: list[tuple[str, bool]]
    toxic: int
    clean: int
    hit_toxic: int = 0
    hit_clean: int = 0
    a: np.ndarray = field(default_factory=lambda: np.zeros(0))
    b: np.ndarray = field(default_factory=lambda: np.zeros(0))
    none: float = 0.5
    table: np.ndarray = field(default_factory=lambda: np.full(GRID, 0.5))

    def weights(self, ids: np.ndarray, own: int | None = None) -> np.ndarray:
        """Log-odds of features; own: a document's label (0 or 1), whose counts are left out, as each of them is in it."""
        less_a, less_b = float(own == 1), float(own == 0)
        a, b = self.a[ids] - less_a, self.b[ids] - less_b
        toxic, clean = self.toxic - less_a, self.clean - less_b
        hit_toxic, hit_clean = self.hit_toxic - less_a, self.hit_clean - less_b
        spelled = 3 * len(self.terms)
        share = (hit_toxic + 0.5) / (hit_toxic + hit_clean + 1)
        out = _logit((a + SHRINK * share) / (a + b + SHRINK)) - _logit(np.float64(share))
        seen = lambda x, y: np.log((x + 0.5) / (toxic + 1)) - np.log((y + 0.5) / (clean + 1))
        term = ids < spelled
        if term.any():
            errors, exact = ids[term] % 3, ids[term] - ids[term] % 3
            # A spelling that is rarely seen leans to half the term's weight for each error.
            lean = seen(self.a[exact], self.b[exact]) * 0.5**errors
            n = a[term] + b[term]
            out[term] = np.where(errors == 0, seen(a[term], b[term]), (n * seen(a[term], b[term]) + 2 * lean) / (n + 2))
        return out

    def evidence(self, hits: list[list[int]], own: int | None = None) -> float:
        """The logarithm of the summed odds of the hits."""
        ids, at = np.unique(np.concatenate([np.asarray(h, np.int64) for h in hits]), return_inverse=True)
        weights, place, odds = self.weights(ids, own)[at], 0, []
        for h in hits:
            w = weights[place : place + len(h)]
            place += len(h)
            odds.append(w[0] + w[1] + max(-CLIP, min(CLIP, float(w[2:].sum()))))
        top = max(odds)
        return top + math.log(sum(math.exp(x - top) for x in odds))


def step_of(evidence: float) -> int:
    return int(min(GRID - 1, max(0, math.floor(evidence / STEP) + GRID // 4)))


def monotone(toxic: np.ndarray, total: np.ndarray, share: float) -> np.ndarray:
    """Probabilities by step that never fall, by pooling neighbours; steps without documents take the pool below (the first: above)."""
    pools: list[list[float]] = []
    for k in range(len(total)):
        if not total[k]:
            if pools:
                pools[-1][2] += 1
            continue
        pools.append([toxic[k] + share, total[k] + 1.0, 1 if pools else k + 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            t, n, width = pools.pop()
            pools[-1][0] += t
            pools[-1][1] += n
            pools[-1][2] += width
    if not pools:
        return np.full(len(total), share)
    return np.concatenate([np.full(int(width), t / n) for t, n, width in pools])


# Training and scoring


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled documents that may be learnt from, equal texts once: toxic (boolean), text."""
    text = F.coalesce("text", F.lit(""))
    named = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text, F.lit(1)).alias("h"), F.xxhash64(text, F.lit(2)).alias("g")
    )
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    marks = marks.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    ids = named.select("doc_id", "h", "g").join(marks, "doc_id").groupBy("h", "g").agg(F.min("doc_id").alias("doc_id"), (F.avg("toxic") >= 0.5).alias("toxic"))
    return named.join(ids, ["doc_id", "h", "g"]).select("toxic", "text")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of all documents that may be learnt from. Tables on the way lie in the shared folder and are deleted."""
    spark = docs.sparkSession
    folder = f"{runtime.shared_folder(spark)}/toxicity-{uuid.uuid4().hex}"
    try:
        training_rows(docs, labels).write.parquet(f"{folder}/rows")
        rows = spark.read.parquet(f"{folder}/rows")
        counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
        toxic, clean = counts.get(True, 0), counts.get(False, 0)
        model = Model(lexicon(rows, toxic, clean), toxic, clean)
        share = (toxic + 0.5) / (toxic + clean + 1)
        model.none = share
        if model.terms:
            hits_of(rows, model.terms).write.parquet(f"{folder}/hits")
            _count(model, spark.read.parquet(f"{folder}/hits"), share)
        return model
    finally:
        runtime.delete(spark, folder)


def hits_of(rows: DataFrame, terms: list[tuple[str, bool]]) -> DataFrame:
    """The hits of training documents that have any: toxic, hits (features of each hit)."""
    runtime.ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(terms)
        for batch in batches:
            for part in runtime.slices(batch):
                labels, hits = [], []
                for is_toxic, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found = list(finder.hits(text))
                    if found:
                        labels.append(is_toxic)
                        hits.append(found)
                yield pa.RecordBatch.from_arrays([pa.array(labels, pa.bool_()), pa.array(hits, pa.list_(pa.list_(pa.int32())))], names=["toxic", "hits"])

    return rows.select("toxic", "text").mapInArrow(run, "toxic boolean, hits array<array<int>>")


def _count(model: Model, hits: DataFrame, share: float) -> None:
    """Counts features by label, then evidence by label without a document's own counts: fixed numbers of sums."""
    size = Finder(model.terms).features
    model.a, model.b = np.zeros(size), np.zeros(size)
    each = hits.select("toxic", F.explode(F.array_distinct(F.flatten("hits"))).alias("f"))
    for r in each.groupBy("toxic", "f").count().collect():
        (model.a if r["toxic"] else model.b)[r["f"]] = r["count"]
    n = {r["toxic"]: r["count"] for r in hits.groupBy("toxic").count().collect()}
    model.hit_toxic, model.hit_clean = n.get(True, 0), n.get(False, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = np.zeros((2, GRID), np.int64)
        for batch in batches:
            for label, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grid[int(label), step_of(model.evidence(found, int(label)))] += 1
        used = np.argwhere(grid)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used[:, 0] == 1), pa.array(used[:, 1], pa.int32()), pa.array(grid[tuple(used.T)], pa.int64())], names=["toxic", "step", "n"]
        )

    grid = np.zeros((2, GRID))
    for r in hits.mapInArrow(run, "toxic boolean, step int, n bigint").groupBy("toxic", "step").agg(F.sum("n").alias("n")).collect():
        grid[int(r["toxic"]), r["step"]] = r["n"]
    model.table = monotone(grid[1], grid.sum(0), share)
    without_toxic, without = model.toxic - model.hit_toxic, model.toxic + model.clean - model.hit_toxic - model.hit_clean
    model.none = (without_toxic + share) / (without + 1)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every document's probability of being toxic: doc_id, held_out, score, predicted, n_hits, terms (those hit, in order)."""
    runtime.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(model.terms)
        for batch in batches:
            for part in runtime.slices(batch):
                scores, numbers, terms = [], [], []
                for text in part.column(2).to_pylist():
                    hits = list(finder.hits(text))
                    scores.append(float(model.table[step_of(model.evidence(hits))]) if hits else model.none)
                    numbers.append(len(hits))
                    terms.append([model.terms[k][0] for k in dict.fromkeys(h[0] // 3 for h in hits)])
                columns = [part.column(0), part.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
                columns += [pa.array(numbers, pa.int64()), pa.array(terms, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted", "n_hits", "terms"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int, n_hits bigint, terms array<string>")
