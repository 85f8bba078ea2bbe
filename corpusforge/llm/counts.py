"""Token counts by a compiled finite-state transducer whose transitions carry counts.

The encoding of a prefix ends in exactly one token, and two tokens stand side by side in an encoding if and only if
the pair of them encodes to itself. So the count of each prefix follows from the counts of a few earlier
prefixes. A state holds those: for every start of a possible token the place in the trie of tokens, the token
that ends there and its count less the present one. Reading a character moves to the next state and adds the
transition's count (which may be negative, as a later merge can undo two tokens). States and transitions
are compiled when first met and kept, up to a bound.

No token has a space after another character, so the transducer is in its start state before every run of
spaces. The map of a chunk takes a state to the state behind it and the count: behind the first such place it is
constant, and what stands before (all of a chunk without a space) is a map worked out for the state that the text before the
chunk suggests; from another state it is read only until it meets that path. So the maps of a text's chunks are worked
out apart from each other, and compose associatively, in pairs, in a prefix scan.

Defined results: a null or empty text has 0 tokens; characters outside the vocabulary count one token per
UTF-8 byte; repeated rows are counted independently; an empty table gives an empty table; extra
columns are ignored unless named in `keep`.
"""

from __future__ import annotations

import gc
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime
from .bpe import Memo

#: Compiled states and known token pairs that are kept, and the code points of a chunk.
STATES, PAIRS, CHUNK = 200_000, 400_000, 1 << 14
#: Characters read before a chunk to find its likely state, and between the states kept of a map's path.
WARM, PATH = 256, 64
#: Words whose counts are kept.
WORDS = 400_000
#: The token of a character outside the vocabulary, and of a start: any token may follow.
OTHER = -1


class State:
    """live: see CountTransducer.compile; space: whether the last character read was a space."""

    __slots__ = ("live", "next", "space")

    def __init__(self, live, space: bool):
        self.live, self.space, self.next = live, space, {}


class CountTransducer:
    """Counts of a sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        ordinary = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.text_of = {i: model.id_to_piece(i).replace("▁", " ") for i in ordinary}
        self.score = {self.text_of[i]: (-model.get_score(i), i) for i in ordinary}
        self.none = (float("inf"), OTHER)
        if any(" " in x.lstrip(" ") for x in self.score):
            raise ValueError("a token goes on after a space: words are not independent")
        # The trie: children of each node, and the token that ends there.
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int | None] = [None]
        for x, (_, i) in self.score.items():
            if len(x) > 1 and self.merged(list(x)) != [x]:
                continue  # never the result of the merges
            node = 0
            for c in x:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                node = self.children[node][c]
            self.ends[node] = i
        self.pairs: dict[tuple[int, int], bool] = {}
        self.reset()
        self.words = Memo(lambda x: self.count(" " + x), WORDS)

    def reset(self) -> None:
        self.states: dict[tuple, State] = {}
        self.start = self.state(((0, OTHER, 0),), False)

    def state(self, live: tuple, space: bool) -> State:
        found = self.states.get((live, space))
        if found is None:
            found = self.states[live, space] = State(live, space)
        return found

    def merged(self, parts: list[str]) -> list[str]:
        """The merges of the model itself, in place: best score first, then leftmost."""
        score, none = self.score.get, self.none
        scores = [score(a + b, none)[0] for a, b in zip(parts, parts[1:], strict=False)]
        while scores:
            best = min(scores)
            if best == none[0]:
                break
            i = scores.index(best)
            parts[i] += parts[i + 1]
            del parts[i + 1], scores[i]
            if i:
                scores[i - 1] = score(parts[i - 1] + parts[i], none)[0]
            if i < len(scores):
                scores[i] = score(parts[i] + parts[i + 1], none)[0]
        return parts

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens stand side by side in an encoding."""
        if left == OTHER:
            return True
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            a, b = self.text_of[left], self.text_of[right]
            found = self.pairs[left, right] = self.merged([*a, *b]) == [a, b]
        return found

    def compile(self, state: State, c: str) -> tuple[State, int]:
        """The transition of a state on a character: the next state and the count to add."""
        token, delta, moved = None, 0, []
        for node, last, less in state.live:
            child = self.children[node].get(c)
            if child is None:
                continue
            if token is None and self.ends[child] is not None and self.fits(last, self.ends[child]):
                token, delta = self.ends[child], less + 1
            moved.append((child, last, less))
        if token is None:
            token, delta, moved = OTHER, len(c.encode()), []
        live = tuple((node, last, less - delta) for node, last, less in moved if self.children[node])
        if len(self.states) >= STATES:
            self.reset()
            gc.collect()
        found = state.next[c] = (self.state((*live, (0, token, 0)), c == " "), delta)
        return found

    def count(self, unit: str) -> int:
        """The count of a run of spaces with what follows it up to the next space."""
        state, n = self.start, 0
        for c in unit:
            step = state.next.get(c) or self.compile(state, c)
            state = step[0]
            n += step[1]
        return n

    def read(self, state: State, text: str) -> tuple[State, int]:
        """The state behind a text read from a state, and the count; before a run of spaces stands the start state."""
        n = 0
        for c in text:
            if c == " " and not state.space:
                state = self.start
            step = state.next.get(c) or self.compile(state, c)
            state = step[0]
            n += step[1]
        return state, n

    def chunk_map(self, chunk: str, before: str = "") -> ChunkMap:
        """The map of a chunk of text, given the characters before it; spaces are plain spaces."""
        cut = next((m.start() + 1 for m in _START.finditer(chunk)), len(chunk))
        rest = chunk[cut:]
        return ChunkMap(self, chunk[:cut], self.constant(rest) if rest else None, self.read(self.start, before[-WARM:])[0])

    def constant(self, text: str) -> tuple[State, int]:
        """The state behind a text that begins with a run of spaces after another character, and the count."""
        if "  " in text:
            units = re.findall(r" +[^ ]*", text)
            n = sum(map(self.count, units[:-1]))
        else:
            words = text.split(" ")
            n = sum(map(self.words.__getitem__, words[1:-1]))
            units = [" " + words[-1]]
        state, last = self.read(self.start, units[-1])
        return state, n + last

    def tokens(self, text: str) -> int:
        """The count of a whole text: its chunks' maps, composed in pairs until one is left, from the start state."""
        if not text:
            return 0
        text = " " + text.replace("▁", " ")
        if len(text) <= CHUNK:
            return self.constant(text)[1]
        maps = [self.chunk_map(text[at : at + CHUNK], text[max(0, at - WARM) : at]) for at in range(0, len(text), CHUNK)]
        while len(maps) > 1:
            maps = [Composed(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        return maps[0](self.start)[1]


#: The character before a run of spaces.
_START = re.compile(r"[^ ](?= )")


class ChunkMap:
    """State to (state, count) over a chunk: what stands before its first start, then the constant rest (None: no start)."""

    def __init__(self, transducer: CountTransducer, head: str, rest: tuple[State, int] | None, likely: State):
        self.transducer, self.head, self.rest, self.likely = transducer, head, rest, likely
        #: The path from the likely state: the states and counts at every `PATH` characters, and at the end.
        self.path, state, n = [], likely, 0
        for at in range(0, len(head), PATH):
            state, more = transducer.read(state, head[at : at + PATH])
            n += more
            self.path.append((state.live, state.space, n))
        self.end = state, n

    def __call__(self, state: State) -> tuple[State, int]:
        behind, n = self.end
        if (state.live, state.space) != (self.likely.live, self.likely.space):
            now, n = state, 0
            for k, (live, space, then) in enumerate(self.path):
                now, more = self.transducer.read(now, self.head[k * PATH : (k + 1) * PATH])
                n += more
                if (now.live, now.space) == (live, space):  # from here on both paths are one
                    now, n = self.end[0], n + self.end[1] - then
                    break
            behind = now
        return (behind, n) if self.rest is None else (self.rest[0], n + self.rest[1])


class Composed:
    """The map of two adjoining chunks; its value at the first one's likely state is worked out at once."""

    def __init__(self, a: ChunkMap | Composed, b: ChunkMap | Composed):
        self.a, self.b, self.likely = a, b, a.likely
        self.known = self.value(a.likely)

    def value(self, state: State) -> tuple[State, int]:
        between, n = self.a(state)
        behind, more = self.b(between)
        return behind, n + more

    def __call__(self, state: State) -> tuple[State, int]:
        same = (state.live, state.space) == (self.likely.live, self.likely.space)
        return self.known if same else self.value(state)


_loaded: dict[str, CountTransducer] = {}


def loaded(path: str) -> CountTransducer:
    if path not in _loaded:
        _loaded[path] = CountTransducer(path)
    return _loaded[path]


def count_tokens(df: DataFrame, path: str, text: str = "text", out: str = "n_tokens", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and the tokens of each row's whole text."""
    keep = list(keep)
    source = runtime.unused(keep, "text")
    schema = runtime.kept_and(df, keep, f"`{out}` bigint")

    def work(batch: pa.RecordBatch) -> dict:
        transducer = loaded(path)
        return {c: batch.column(c) for c in keep} | {out: [transducer.tokens(t or "") for t in batch.column(source).to_pylist()]}

    return runtime.per_batch(df.select(*map(runtime.quoted, keep), runtime.quoted(text).alias(source)), schema, work, [*keep, source])


def limits(df: DataFrame, path: str, most: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    sized = df.select("doc_id", "text", F.octet_length(runtime.whole_text()).cast("long").alias("n_bytes"))
    counted = count_tokens(sized, path, keep=("doc_id", "n_bytes"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > most).alias("over_limit"))
