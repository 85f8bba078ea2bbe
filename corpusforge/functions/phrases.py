"""Phrases of a table replaced in one pass (T11): a trie with failure links, leftmost longest matches, in Arrow batches."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of the scripts for which conversion is meant (Han), as the guard's pattern has them.
HAN = r"[\x{4e00}-\x{9fff}]"


class Phrases:
    """Finds the phrases of a table in a text: of those that start first the longest, then on behind it."""

    def __init__(self, table: dict[str, str]) -> None:
        self.values: list[str | None] = [None]
        self.next: list[dict[str, int]] = [{}]
        self.depth = [0]
        for phrase, value in table.items():
            if not phrase:
                continue
            state = 0
            for c in phrase:
                following = self.next[state].get(c)
                if following is None:
                    following = self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.values.append(None)
                    self.depth.append(self.depth[state] + 1)
                state = following
            self.values[state] = value
        self.fail = [0] * len(self.next)
        #: The longest phrase that ends in a state, itself or behind its failure links; -1: none.
        self.ends = [-1] * len(self.next)
        todo = deque([0])
        while todo:
            state = todo.popleft()
            if self.values[state] is not None:
                self.ends[state] = state
            elif state:
                self.ends[state] = self.ends[self.fail[state]]
            for c, child in self.next[state].items():
                if state:
                    back = self.fail[state]
                    while back and c not in self.next[back]:
                        back = self.fail[back]
                    self.fail[child] = self.next[back].get(c, 0)
                todo.append(child)

    def replace(self, text: str) -> str:
        """The text with every match replaced. A match is settled once no phrase that starts earlier, or there, can still grow."""
        out, copied, state, at = [], 0, 0, 0
        start = stop = -1  # the best match so far
        value = ""
        n = len(text)
        while True:
            if at < n:
                c = text[at]
                while state and c not in self.next[state]:
                    state = self.fail[state]
                state = self.next[state].get(c, 0)
                at += 1
                begins = at - self.depth[state]
            else:
                begins = at + 1
            if start >= 0 and begins > start:  # all that could still match starts later
                out += [text[copied:start], value]
                copied = at = stop
                state, start = 0, -1
                if copied >= n:
                    break
                continue
            if at >= n and begins > n:
                break
            end = self.ends[state]
            if end >= 0:
                place = at - self.depth[end]
                if start < 0 or place < start or (place == start and at > stop):
                    start, stop, value = place, at, self.values[end]
        return "".join([*out, text[copied:]]) if out else text


def converted(c: Column, table: dict[str, str], where: str | None = HAN) -> Column:
    """The text with the table's phrases replaced; only texts that the pattern `where` finds something in go through Python."""
    def run(texts: pa.Array) -> pa.Array:
        phrases = Phrases(table)
        return pa.array([None if t is None else phrases.replace(t) for t in texts.to_pylist()], pa.string())

    changed = F.arrow_udf(run, "string")
    return changed(c) if where is None else F.coalesce(changed(F.when(c.rlike(where), c)), c)
