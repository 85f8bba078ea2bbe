"""Spelling variants: words one edit apart, found through forward and backward minimal acyclic automata.

Two words one edit apart share their first or their last half exactly: with s code points in the shorter one and
h = s // 2, their common prefix or their common suffix has at least h. So each word is dealt to the cell of its first h
and to that of its last h letters, once as the shorter and once as the longer word of a pair; a cell is all that a pair
needs. A task reads its cells in order, a block of cells at a time. A block's words are the language of a minimal acyclic
automaton (of the reversed words for cells of endings) whose arcs carry the perfect-hash numbers of words: a word walks its
half exactly, then leaves by one arc that does not spell it (a replacement or an insertion), and must be completed exactly;
the sum of the arcs' numbers finds the partner's count. A pair whose first halves agree is left to the cell of
beginnings, so each pair is found once and nothing is shuffled to tell pairs apart.

Cells over `HOT_CELL` words are dealt anew by the halves of what is not fixed yet (again either half must agree), until
they are small or nothing is left to halve; the pairs are the same. No cell is cut and no pair left out.

A word's form is its near word of largest count if that is at least `RATIO` times its own; a chain of forms multiplies
the count by that at every step, which bounds the doublings that find the roots.

Defined results: a null or empty text has no words; a null doc_id is written as nothing before the colon; a run of one code
point that is deleted gives no word; ties between near words go to the smallest in code-point order; repeated rows count
again; an empty table gives an empty table; other columns, whatever their names, are never read; texts are taken whole, long
ones run by run.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runtime

RUN = re.compile("[A-Za-zÀ-ÿ]+")
EVERY, LEAST_LENGTH, LEAST_COUNT, RATIO = 199, 6, 5, 5
#: Words in a cell beyond which it is dealt to finer ones; words of a block, after the cell that reaches it.
HOT_CELL, BLOCK = 4000, 4000
#: Different words that a task counts before it hands them on.
HELD = 200_000
#: Code points beyond which a text's runs are not listed at once.
LONG_TEXT = 1 << 20
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def _lower(run: str) -> str:
    return run.lower() if run.isascii() else run.translate(_LOWER)


def words_of(doc_id: int | None, text: str | None) -> Iterator[tuple[str, int]]:
    """The words of one text with their counts, one code point deleted where the hash says so; any length."""
    if not text:
        return
    runs = Counter(RUN.findall(text) if len(text) <= LONG_TEXT else (m[0] for m in RUN.finditer(text)))
    lowered: dict[str, int] = {}
    for run, n in runs.items():
        word = _lower(run)
        lowered[word] = lowered.get(word, 0) + n
    start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    for word, n in lowered.items():
        h = zlib.crc32(word.encode(), start)
        if h % EVERY == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        yield word, n


def word_counts(docs: DataFrame) -> DataFrame:
    """Every word of at least `LEAST_LENGTH` code points that occurs at least `LEAST_COUNT` times: word, n."""
    runtime.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            part = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return part

        for batch in batches:
            for part in runtime.slices(batch):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for word, n in words_of(doc_id, text):
                        if len(word) >= LEAST_LENGTH:
                            held[word] = held.get(word, 0) + n
                    if len(held) > HELD:
                        yield out()
        if held:
            yield out()

    counted = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Automaton:
    """The minimal acyclic automaton of a sorted list of different words; arcs carry the numbers of words before them."""

    def __init__(self, words: list[str]) -> None:
        register: dict[tuple, dict] = {}
        self.root: dict = {}
        path, letters = [self.root], []  # the states along the last word, and its letters

        def close(keep: int) -> None:
            while len(letters) > keep:
                state = path.pop()
                key = tuple((c, id(child)) for c, child in state.items())
                path[-1][letters.pop()] = register.setdefault(key, state)

        before = ""
        for word in words:
            k = 0
            for a, b in zip(word, before):
                if a != b:
                    break
                k += 1
            close(k)
            for c in word[k:]:
                state: dict = {}
                path[-1][c] = state
                path.append(state)
                letters.append(c)
            path[-1][""] = None  # the word ends here; always the first arc, as words come in order
            before = word
        close(0)
        self._number()

    def _number(self) -> None:
        """Turns arcs into (child, words of this state that come before), from the last states to the root."""
        order, seen, stack = [], set(), [self.root]
        while stack:
            state = stack.pop()
            if isinstance(state, tuple):
                order.append(state[0])
            elif id(state) not in seen:
                seen.add(id(state))
                stack.append((state,))
                stack.extend(child for child in state.values() if child is not None)
        size = {}
        for state in order:
            n = 0
            for c, child in state.items():
                state[c] = (child, n)
                n += size[id(child)] if child is not None else 1
            size[id(state)] = n
        self.states, self.words = len(order), size[id(self.root)]

    def number(self, word: str, at: int = 0, state: dict | None = None, before: int = 0) -> int:
        """The place of the word among all, from the state and the number that its first `at` letters led to; -1: none."""
        state = self.root if state is None else state
        for k in range(at, len(word)):
            arc = state.get(word[k])
            if arc is None:
                return -1
            state = arc[0]
            before += arc[1]
        return before if "" in state else -1

    def near(self, word: str, exact: int) -> Iterator[tuple[int, str]]:
        """Words that replace one letter or hold one more, behind the first `exact` letters: (number, word), each once.

        An inserted letter stands at the last of the places where it could, so it always differs from the next one.
        """
        state, before = self.root, 0
        for k in range(exact):
            arc = state.get(word[k])
            if arc is None:
                return
            state = arc[0]
            before += arc[1]
        for k in range(exact, len(word)):
            c = word[k]
            follow = word[k + 1] if k + 1 < len(word) else ""
            for other, (child, offset) in state.items():
                if other == c or other == "":
                    continue
                if follow in child:
                    found = self.number(word, k + 1, child, before + offset)
                    if found >= 0:
                        yield found, word[:k] + other + word[k + 1 :]
                if c in child:
                    found = self.number(word, k, child, before + offset)
                    if found >= 0:
                        yield found, word[:k] + other + word[k:]
            arc = state.get(c)
            if arc is None:
                return
            state = arc[0]
            before += arc[1]
        for other, (child, offset) in state.items():
            if other and "" in child:
                yield before + offset, word + other


def _cell(shorter: Column, left: Column, right: Column, below: Column, backward: bool) -> Column:
    """A cell's place: which letters it fixes (the first `left`, the last `right`), and for what length of the shorter word."""
    word = F.col("word")
    key = F.concat_ws("|", F.lit("B" if backward else "F"), shorter, left, right, below, F.substring(word, F.lit(1), left), F.substring(word, F.length(word) - right + 1, right))
    return F.struct(
        key.alias("cell"), F.lit(backward).alias("backward"), shorter.alias("shorter"), left.alias("left"), right.alias("right"), below.alias("below")
    )


_OPEN = 1 << 30


def _halves(shorter: Column, left: Column, right: Column, below: Column) -> Column:
    """The two cells that halve what is not fixed: beginnings, and endings of pairs whose beginnings do not agree."""
    half = ((shorter - left - right) / 2).cast("int")
    return F.array(_cell(shorter, left + half, right, below, False), _cell(shorter, left, right + half, left + half, True))


_AS_ROW = ["cell", "backward", "shorter", "left", "right", "below", "word", "n"]


def cells(words: DataFrame) -> DataFrame:
    """Each word in the cells of its halves, as the shorter word of a pair and as the longer one."""
    zero, length = F.lit(0), F.length("word")
    both = F.concat(_halves(length, zero, zero, F.lit(_OPEN)), _halves(length - 1, zero, zero, F.lit(_OPEN)))
    dealt = words.select("word", "n", F.explode(both).alias("at")).select("at.*", "word", "n")
    return dealt.where(F.col("shorter") >= LEAST_LENGTH).select(_AS_ROW)


def dealt(words: DataFrame, hot_cell: int = HOT_CELL) -> DataFrame:
    """The words in cells, those over `hot_cell` words dealt to finer ones."""
    rows, done = cells(words), None
    while True:
        counts = runtime.checkpoint(rows.groupBy("cell").agg(F.count("*").alias("n"), F.first(F.col("shorter") - F.col("left") - F.col("right")).alias("open")))
        hot = counts.where((F.col("n") > hot_cell) & (F.col("open") > 1)).select("cell", F.lit(True).alias("hot"))
        if hot.isEmpty():
            return rows if done is None else done.union(rows)
        marked = runtime.checkpoint(runtime.join_split(rows, hot, "cell", counts, "left"))
        calm = marked.where(F.col("hot").isNull()).select(_AS_ROW)
        done = calm if done is None else done.union(calm)
        halves = F.explode(_halves(F.col("shorter"), F.col("left"), F.col("right"), F.col("below"))).alias("at")
        rows = marked.where("hot").select("word", "n", halves).select("at.*", "word", "n").select(_AS_ROW)


def _pairs(block: list[tuple]) -> Iterator[tuple[str, int, str, int]]:
    """Pairs of a block of cells, all forward or all backward: (word, n, partner, n of the partner), each pair once."""
    backward = block[0][1]
    counts = {}
    for row in block:
        counts[row[6][::-1] if backward else row[6]] = row[7]
    language = sorted(counts)
    held = [counts[w] for w in language]
    automaton = Automaton(language)
    for _, _, shorter, left, right, below, word, n in block:
        if len(word) != shorter:
            continue
        if not backward:
            ending = word[shorter - right :]
            for number, other in automaton.near(word, left):
                if len(other) == shorter and other < word:
                    continue  # found from there
                if right and not other.endswith(ending):
                    continue
                if below < _OPEN and other.startswith(word[:below]):
                    continue
                yield word, n, other, held[number]
        else:
            start, agreed = word[:left], word[:below]
            for number, other in automaton.near(word[::-1], right):
                other = other[::-1]
                if len(other) == shorter and other < word:
                    continue
                if other.startswith(agreed) or not other.startswith(start):
                    continue
                yield word, n, other, held[number]


def near_words(words: DataFrame, hot_cell: int = HOT_CELL) -> DataFrame:
    """For every word with near words: word, n_near, near (the one of largest count, the smallest of equals), near_n.

    words: word (different, at least `LEAST_LENGTH` code points), n.
    """
    runtime.ship(words.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        cell: list[tuple] = []

        def found() -> pa.RecordBatch:
            best: dict[str, list] = {}
            for a, n, b, m in _pairs(block):
                for word, near, near_n in ((a, b, m), (b, a, n)):
                    known = best.get(word)
                    if known is None:
                        best[word] = [1, near, near_n]
                        continue
                    known[0] += 1
                    if near_n > known[2] or (near_n == known[2] and near < known[1]):
                        known[1:] = near, near_n
            block.clear()
            held = list(best.values())
            return pa.RecordBatch.from_arrays(
                [pa.array(best.keys(), pa.string()), *(pa.array([v[k] for v in held], t) for k, t in ((0, pa.int64()), (1, pa.string()), (2, pa.int64())))],
                names=["word", "n_near", "near", "near_n"],
            )

        for batch in batches:
            for part in runtime.slices(batch):
                for row in zip(*(c.to_pylist() for c in part.columns)):
                    if cell and row[0] != cell[0][0]:
                        if len(cell) > 1:
                            if block and block[0][1] != cell[0][1]:
                                yield found()
                            block.extend(cell)
                        cell.clear()
                        if len(block) >= BLOCK:
                            yield found()
                    cell.append(row)
        if len(cell) > 1:
            if block and block[0][1] != cell[0][1]:
                yield found()
            block.extend(cell)
        if block:
            yield found()

    rows = dealt(words, hot_cell).repartition("cell").sortWithinPartitions("cell")
    each = rows.mapInArrow(run, "word string, n_near bigint, near string, near_n bigint")
    best = F.min(F.struct((-F.col("near_n")).alias("down"), F.col("near"))).alias("best")
    return each.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", "best.near", (-F.col("best.down")).alias("near_n"))


def roots(forms: DataFrame, most: int, ratio: int = RATIO, least: int = LEAST_COUNT) -> DataFrame:
    """The last word of each chain of forms: word, root. forms: word, form (not null); most: the largest count of a word."""
    steps, n = 0, least
    while n * ratio <= most:
        n, steps = n * ratio, steps + 1
    links, reach = runtime.checkpoint(forms.select("word", F.col("form").alias("root"))), 1
    while reach < steps:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = runtime.checkpoint(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
        reach *= 2
    return links


def variants(docs: DataFrame, hot_cell: int = HOT_CELL) -> DataFrame:
    """Every word of the documents with its form and root: word, n, n_near, form, form_n, root."""
    words = runtime.checkpoint(word_counts(docs))
    most = words.agg(F.max("n")).first()[0] or 0
    known = words.join(near_words(words, hot_cell), "word", "left")
    is_form = F.col("near_n") >= RATIO * F.col("n")
    known = runtime.checkpoint(
        known.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(is_form, F.col("near")).alias("form"),
            F.when(is_form, F.col("near_n")).alias("form_n"),
        )
    )
    last = roots(known.where(F.col("form").isNotNull()), most)
    return known.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))
