"""Dictionary segmentation by the word graph (G1, G2): the rule tokenizer, its full and search modes, and tags.

A dictionary is a trie whose ends carry a count and a tag. Over a run of letters and digits its hits are the arcs of a graph; the
best path, by the sum of the words' log shares, is worked out from the right end, so each place is looked at once. Runs
are decoded in Arrow batches and remembered up to a bound; the dictionary is broadcast, and its size is a parameter (`MOST`).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .corpus import grams_of
from .segment import Memo, merged, slices

#: Words of a learnt dictionary by length in characters, and lengths of its words.
MOST, LENGTHS = 2000, (2, 3, 4)
#: Count and tag of a word that a user adds (fixed values).
USER_COUNT, USER_TAG = 10_000, "nz"
#: The blocks of `segment.BLOCKS` for this module's engine.
_BLOCKS = regex.compile(
    r"https?://\S+|www\.\S+|[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.]+|@[\p{L}\p{N}_\-.]{1,30}"
    r"|[一-鿿]+|[぀-ヿ]+|[A-Za-z][A-Za-z0-9'’\-]*|[0-9]+(?:\.[0-9]+)?|\S"
)
_RUNS = regex.compile(r"[\p{L}\p{M}\p{N}]+|\s+|.", regex.S)
_LETTERS = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_PLAIN, _WORDY = regex.compile(r"[A-Za-z0-9]"), regex.compile(r"[\p{L}\p{N}]")
_NUMBER, _LATIN = regex.compile(r"[0-9]+(?:\.[0-9]+)?"), regex.compile(r"[A-Za-z][A-Za-z0-9'’\-]*")


@dataclass
class Dictionary:
    """Words with their counts and tags, as a trie: a node is (following letters, count, tag, log of the count); a count of 0 is no word."""

    root: list = field(default_factory=lambda: [{}, 0, "", 0.0])
    total: int = 0
    user: set[str] = field(default_factory=set)

    @classmethod
    def of(cls, words, user=()) -> Dictionary:
        """From (word, count, tag), and words that a user adds: these count `USER_COUNT` and may join parts."""
        found = cls()
        for word, count, tag in words:
            found.add(word, count, tag)
        for word in user:
            found.add(word, USER_COUNT, USER_TAG)
            if len(word) >= 2:
                found.user.add(word)
        return found

    def add(self, word: str, count: int, tag: str = "") -> None:
        if not word or count <= 0:
            return
        node = self.root
        for c in word:
            node = node[0].setdefault(c, [{}, 0, "", 0.0])
        self.total += count - node[1]
        node[1:] = count, tag, math.log(count)

    def words_at(self, text: str, at: int) -> Iterator[tuple[int, int]]:
        """(end, count) of every word that starts at a place, the shortest first."""
        node = self.root
        for end in range(at, len(text)):
            node = node[0].get(text[end])
            if node is None:
                return
            if node[1]:
                yield end + 1, node[1]

    def get(self, word: str) -> tuple[int, str]:
        node = self.root
        for c in word:
            node = node[0].get(c)
            if node is None:
                return 0, ""
        return node[1], node[2]


def graph(text: str, words: Dictionary) -> list[list[tuple[int, int]]]:
    """By place the words that start there, as (end, count); a place without any has its own character, counted 0."""
    return [list(words.words_at(text, k)) or [(k + 1, 0)] for k in range(len(text))]


def best_path(text: str, words: Dictionary) -> list[str]:
    """The words of the most likely path; a character in no word weighs as one count; of equal paths the longer first word wins.

    Neighbouring single Latin letters and digits that no word holds stay one token.
    """
    root, log_total, n = words.root, math.log(words.total or 1), len(text)
    best, to = [0.0] * (n + 1), [0] * n
    for k in range(n - 1, -1, -1):
        # The arcs of a place are met while they are followed. A character may always stand alone, so every place can be left.
        top, at, node, end = best[k + 1] - log_total, k + 1, root, k
        while end < n:
            node = node[0].get(text[end])
            if node is None:
                break
            end += 1
            if node[1]:
                weight = node[3] - log_total + best[end]
                if weight >= top or end == k + 1:
                    top, at = weight, end
        best[k], to[k] = top, at
    out, loose, at = [], "", 0
    while at < len(text):
        word = text[at : to[at]]
        if len(word) == 1 and _PLAIN.match(word):
            loose += word
        else:
            if loose:
                out.append(loose)
                loose = ""
            out.append(word)
        at = to[at]
    return [*out, loose] if loose else out


def every_word(text: str, words: Dictionary) -> list[str]:
    """All words of two characters or more in the text, by place, then length; characters in none stand alone (full mode)."""
    out, covered = [], 0
    for k, arcs in enumerate(graph(text, words)):
        long = [end for end, count in arcs if count and end > k + 1]
        if not long and k >= covered:
            out.append(text[k])
        out += [text[k:end] for end in long]
        covered = max(covered, *long, 0) if long else covered
    return out


def search_words(text: str, words: Dictionary) -> list[str]:
    """The path's words, each after the dictionary's words of two, then three characters inside it (search mode)."""
    out = []
    for word in best_path(text, words):
        for n in (2, 3):
            if len(word) > n:
                out += [word[k : k + n] for k in range(len(word) - n + 1) if words.get(word[k : k + n])[0]]
        out.append(word)
    return out


def tag_of(word: str, words: Dictionary) -> str:
    """The dictionary's tag; a number is `m`, Latin letters `eng`, all else `x`."""
    return words.get(word)[1] or ("m" if _NUMBER.fullmatch(word) else "eng" if _LATIN.fullmatch(word) else "x")


def rule_tokens(text: str | None, words: Dictionary, mode: str = "path", remembered: Memo | None = None) -> list[str]:
    """The rule tokenizer (G1): graph path of every run, cut into blocks of one kind, joined by user words; marks alone are dropped.

    mode: `path`, `full` or `search`, the last two without joining.
    """
    if not text:
        return []
    cut = {"path": best_path, "full": every_word, "search": search_words}[mode]
    memo = Memo() if remembered is None else remembered
    joins = mode == "path" and bool(words.user)

    def parts_of(run: str) -> list[str]:
        parts = cut(run, words) if _WORDY.match(run) else [run]
        parts = [b for p in parts for b in _BLOCKS.findall(p)] if mode == "path" else parts
        return parts if joins else [p for p in parts if _WORDY.search(p)]

    out: list[str] = []
    # Without user words nothing crosses a run, and marks and spaces, which leave no token, need not be looked at.
    for run in (_RUNS if joins else _LETTERS).findall(text):
        if joins and run.isspace():
            continue
        found = memo.get(run)
        out += memo.keep(run, parts_of(run)) if found is None else found
    return [w for w in merged(out, words.user) if _WORDY.search(w)] if joins else out


def learnt(docs: DataFrame, text: str = "text", most: int = MOST) -> list[tuple[str, int, str]]:
    """A dictionary of the commonest strings of 2 to 4 letters, at most `most` of each length: (word, count, tag); ties by text.

    The texts are read once: the strings of all lengths are counted together, from the different runs of letters.
    """
    runs = docs.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))).alias("r")).groupBy("r").agg(F.count("*").alias("n"))
    counts = runs.select("n", F.explode(F.concat(*[grams_of(F.col("r"), n) for n in LENGTHS])).alias("w")).groupBy("w").agg(F.sum("n").alias("n")).persist()
    found = []
    for size in LENGTHS:
        top = counts.where(F.length("w") == size).orderBy(F.desc("n"), "w").limit(most)
        found += [(r["w"], r["n"], "n") for r in top.collect()]
    counts.unpersist()
    return found


def segmented(df: DataFrame, words: Dictionary, mode: str = "path", text: str = "text", out: str = "tokens", tagged: bool = False) -> DataFrame:
    """The rows with the tokens of a text, lower case; tagged: (word, tag) pairs instead.

    Tokens are made for some texts at a time (`segment.slices`) and told apart from their lists only by offsets.
    """
    shared = df.sparkSession.sparkContext.broadcast(words)
    kind = T.StructType([T.StructField("word", T.StringType()), T.StructField("tag", T.StringType())]) if tagged else T.StringType()
    schema = T.StructType([*df.schema, T.StructField(out, T.ArrayType(kind))])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, tags = Memo(), Memo()

        def tag(w: str) -> str:
            found = tags.get(w)
            return (tags.keep(w, [tag_of(w, shared.value)]) if found is None else found)[0]

        for batch in batches:
            for start, n in slices(batch.column(at)):
                rows, flat, ends = batch.slice(start, n), [], [0]
                for t in rows.column(at).to_pylist():
                    flat += rule_tokens(t and t.lower(), shared.value, mode, memo)
                    ends.append(len(flat))
                values = pa.array(flat, pa.string())
                if tagged:
                    values = pa.StructArray.from_arrays([values, pa.array(map(tag, flat), pa.string(), size=len(flat))], ["word", "tag"])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([*rows.columns, lists], names=[*rows.schema.names, out])

    return df.mapInArrow(run, schema)
