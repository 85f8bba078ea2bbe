"""BPE encoding and decoding as streaming transducers with bounded lookahead.

`sufficient_lookahead` finds, from the merge list alone, how many bytes beyond a token's end can still
change that token. Two tokens may stand side by side in an encoding if and only if no merge crosses their border
(`ByteBpe.fits`), and an encoding is the one sequence of tokens in which all neighbours may. So the encoding of each
prefix ends in one token, which follows from those of a few earlier prefixes: a state holds, for every start of a
token that may still grow, its place in the trie of tokens and the token before it. Reading a byte moves to the next
state, which names the last token; states are compiled when first met and kept, up to a bound. A token is emitted once
the lookahead stands behind its end, or the piece ends, so a piece of any length takes constant memory. Pieces
repeat, so the transducer's output for short ones is kept in a bounded memo. The decoder turns ids into bytes and
bytes into text with an incremental state machine.

Defined results: a null text is the empty text; an empty text has no ids and decodes to the empty text;
bytes that are not UTF-8 (possible only for ids that no encoder made) decode to U+FFFD; repeated rows and ties
are encoded independently; an empty table gives an empty table; extra columns are ignored unless named in
`keep`, and an output name that is already in `keep` is an error.
"""

from __future__ import annotations

import codecs
import gc
import hashlib
import json
import re
from collections.abc import Iterator
from itertools import accumulate
from operator import getitem

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime

#: Fixed values of the byte-level vocabulary: its pattern of pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Entries of the memo of finished pieces, its longest piece, and the text taken at once (code points).
MEMO_ENTRIES, MEMO_LENGTH, SEGMENT = 240_000, 64, 1 << 17
#: Below this, str.isalpha and the pattern's letters are the same in every version of Unicode.
LATIN = "\u0250"
#: Pairs of tokens of which it is known whether they stand side by side.
PAIRS = 400_000
#: Compiled states that are kept.
STATES = 150_000


def byte_names() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in plain}
    spare = iter(range(256, 512))
    return {b: names.get(b) or chr(next(spare)) for b in range(256)}


def vocabulary(path: str) -> tuple[list[bytes], dict[str, int], dict[str, int], list]:
    """Bytes by id, ids of the special strings, ids by name, and the merges of a byte-level file of the tokenizers library."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    vocab, back = model["model"]["vocab"], {c: b for b, c in byte_names().items()}
    special = {x["content"]: x["id"] for x in model["added_tokens"]}
    bytes_of = [b""] * (1 + max([*vocab.values(), *special.values()]))
    for token, i in vocab.items():
        bytes_of[i] = bytes(back[c] for c in token)
    for token, i in special.items():
        bytes_of[i] = token.encode()
    return bytes_of, special, vocab, model["model"]["merges"]


def sufficient_lookahead(merges: list[tuple[int, int, int]], length: dict[int, int]) -> dict[int, int]:
    """Bytes beyond the end of each token that can still change it; merges: (left, right, result) in rank order.

    A token that starts at a settled boundary is disturbed only by a merge with its right neighbour. That merge
    needs the neighbour to be settled at its own, earlier rank. One pass in rank order therefore adds up the
    longest chain; a result inherits what its right part needs beyond the same end.
    """
    ahead = dict.fromkeys(length, 0)
    for left, right, result in merges:
        beyond_left, beyond_right = ahead[left], ahead[right]
        ahead[result] = max(ahead[result], beyond_right, beyond_left - length[right])
        ahead[left] = max(beyond_left, length[right] + beyond_right)
    return ahead


class Memo(dict):
    """A bounded map of pieces to their output; a missing piece is worked out and kept.

    Two generations: when the young one is full it becomes the old one, so pieces in use survive.
    """

    def __init__(self, work, entries: int = MEMO_ENTRIES, longest: int = MEMO_LENGTH):
        super().__init__()
        self.work, self.entries, self.longest, self.old = work, entries, longest, {}

    def __missing__(self, piece):
        found = self.old.get(piece)
        if found is None:
            found = self.work(piece)
            if len(piece) > self.longest:
                return found
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[piece] = found
        return found


class State(dict):
    """A state of the encoder: the next states by byte. token: the last one of what was read; live: see ByteBpe.compile."""

    __slots__ = ("live", "owner", "token")

    def __init__(self, owner: ByteBpe, live: tuple):
        super().__init__()
        self.owner, self.live, self.token = owner, live, live[-1][1]

    def __missing__(self, b: int) -> State:
        found = self[b] = self.owner.compile(self, b)
        return found


class ByteBpe:
    """Encoder and decoder of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        self.bytes_of, self.special, vocab, merges = vocabulary(path)
        names = byte_names()
        self.first = [vocab[names[b]] for b in range(256)]
        rules = []
        for pair in merges:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            rules.append((vocab[a], vocab[b], vocab[a + b]))
        self.rank = {rule[:2]: k for k, rule in reversed(list(enumerate(rules)))}
        self.result = [rule[2] for rule in rules]
        self.ahead = sufficient_lookahead(rules, {i: len(x) for i, x in enumerate(self.bytes_of)})
        self.lookahead = max(self.ahead.values())
        self.longest = max(map(len, self.bytes_of))
        #: Bytes that wait in a stream before tokens are emitted, at least.
        self.window = 2 * (self.lookahead + self.longest) + 256
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.bytes_of))]
        self.length = [len(x) for x in self.bytes_of]
        self._spines(rules)
        self._trie()
        self.pattern = regex.compile(PIECES)
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.pieces = Memo(lambda x: self.pack(self.transduce(x.encode())), MEMO_ENTRIES // 3)
        self.spaced = Memo(self.of_word)
        self.uneven = re.compile(r"\s\s|\s$|^\s")

    def pack(self, ids: list[int]) -> bytes:
        return b"".join(map(self.packed.__getitem__, ids))

    def merge(self, ids: list[int]) -> list[int]:
        """All merges of a list of ids, in place: the lowest rank first, then the leftmost. The definition, for tests."""
        rank, result, none = self.rank.get, self.result, len(self.result)
        ranks = [rank(pair, none) for pair in zip(ids, ids[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == none:
                break
            i = ranks.index(least)
            ids[i] = result[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), none)
        return ids

    def _spines(self, rules: list[tuple[int, int, int]]) -> None:
        """The parts at each token's ends while it is built: (part, rank at which it becomes the next one), inner first."""
        never = len(rules)
        made: dict[int, tuple[int, int, int]] = {}
        for k, (left, right, result) in enumerate(rules):
            if made.get(left, (-1,))[0] > k or made.get(right, (-1,))[0] > k:
                raise ValueError("a merge comes before its parts' own")
            made.setdefault(result, (k, left, right))
        self.from_left: list[list[tuple[int, int]]] = [[] for _ in self.bytes_of]
        self.from_right: list[list[tuple[int, int]]] = [[] for _ in self.bytes_of]
        for token in [*self.first, *sorted(made, key=lambda t: made[t][0])]:
            for spine, side in ((self.from_left, 1), (self.from_right, 2)):
                if token in made:
                    rank, part = made[token][0], made[token][side]
                    inner = spine[part]
                    spine[token] = [*inner[:-1], (part, rank), (token, never)]
                else:
                    spine[token] = [(token, never)]
        self.known_fits: dict[int, bool] = {}

    def fits(self, left: int, right: int) -> bool:
        """Whether the tokens stand side by side in an encoding: no merge crosses the border while they are built.

        The parts next to the border are followed through the ranks; at one rank the leftmost merge comes first, so the
        left token's own part goes before a crossing merge and the right token's after it.
        """
        a, b = self.from_right[left], self.from_left[right]
        i = j = 0
        rank, none = self.rank.get, len(self.result)
        while True:
            part, until = a[i]
            other, other_until = b[j]
            crossing = rank((part, other), none)
            if crossing < until and crossing <= other_until and crossing < none:
                return False
            if until <= other_until:
                if until == none:
                    return True
                i += 1
            else:
                j += 1

    def _trie(self) -> None:
        """The trie of tokens: the node behind a node and a byte, and the token that ends at a node, or -1."""
        special = set(self.special.values())
        self.children: list[dict[int, int]] = [{}]
        self.ends = [-1]
        for i, text in enumerate(self.bytes_of):
            if i in special or not self.from_left[i]:
                continue
            node = 0
            for b in text:
                if b not in self.children[node]:
                    self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                node = self.children[node][b]
            self.ends[node] = i
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, State] = {}
        self.start = State(self, ((0, -1),))

    def compile(self, state: State, b: int) -> State:
        """The state behind a state and a byte. Of all starts, the earliest first, the first whose token fits gives the last token."""
        token, moved, known = -1, [], self.known_fits
        for node, before in state.live:
            child = self.children[node].get(b)
            if child is None:
                continue
            if token < 0 and self.ends[child] >= 0:
                if before < 0:
                    token = self.ends[child]
                else:
                    pair = before << 20 | self.ends[child]
                    ok = known.get(pair)
                    if ok is None:
                        if len(known) >= PAIRS:
                            known.clear()
                        ok = known[pair] = self.fits(before, self.ends[child])
                    if ok:
                        token = self.ends[child]
            if self.children[child]:
                moved.append((child, before))
        live = (*moved, (0, token))
        found = self.states.get(live)
        if found is None:
            if len(self.states) >= STATES:
                self.reset()
                gc.collect()
            found = self.states[live] = State(self, live)
        return found

    def transduce(self, piece: bytes) -> list[int]:
        """The ids of one piece: `stream` over a piece that is there at once."""
        if len(piece) > self.window:
            return [i for part in self.stream([piece]) for i in part]
        return self.chain([s.token for s in accumulate(piece, getitem, initial=self.start)])

    def chain(self, tokens: list[int]) -> list[int]:
        """The tokens of an encoding from the last token of each of its prefixes, the empty one first."""
        out, at, length = [], len(tokens) - 1, self.length
        while at > 0:
            token = tokens[at]
            out.append(token)
            at -= length[token]
        out.reverse()
        return out

    def stream(self, blocks) -> Iterator[list[int]]:
        """The ids of one piece that comes in blocks of bytes: each token is emitted once it is stable.

        What is pending is never longer than the window and one block of a few hundred bytes.
        """
        state, tokens, length = self.start, [-1], self.length
        for block in blocks:
            for at in range(0, len(block), 512):
                states = list(accumulate(block[at : at + 512], getitem, initial=state))
                state = states[-1]
                tokens += [s.token for s in states[1:]]
                if len(tokens) <= self.window:
                    continue
                out, end = [], 0
                for i in self.chain(tokens):
                    if end + length[i] + self.lookahead >= len(tokens):
                        break
                    out.append(i)
                    end += length[i]
                if out:
                    tokens = tokens[end:]
                    yield out
        yield self.chain(tokens)

    def of_word(self, word: str) -> bytes:
        """A space and the word: Latin letters are one piece with their space."""
        if word.isalpha() and max(word) < LATIN:
            return self.pack(self.transduce(b" " + word.encode()))
        return self.of_pieces(" " + word)

    def of_pieces(self, text: str) -> bytes:
        get = self.pieces.__getitem__
        return b"".join(map(get, self.pattern.findall(text)))

    def of_plain(self, text: str) -> Iterator[bytes]:
        """Packed ids of a text without special strings, a segment at a time.

        A space between two characters that are not white space always starts a piece, so a text may be cut there.
        """
        at, n = 0, len(text)
        while at < n:
            end = min(n, at + SEGMENT)
            while end < n:
                cut = text.find(" ", end, n - 1)
                if cut < 0:
                    end = n
                elif not text[cut - 1].isspace() and not text[cut + 1].isspace():
                    end = cut
                    break
                else:
                    end = cut + 1
            part = text[at:end]
            if at and end - at > 1:  # part starts with the space at the cut
                head, part = " ", part[1:]
            else:
                head = ""
            if self.uneven.search(part):
                yield self.of_pieces(head + part)
            else:
                first, *rest = part.split(" ")
                get = self.spaced.__getitem__
                yield (get(first) if head else self.of_pieces(first)) + b"".join(map(get, rest))
            at = end

    def blocks(self, text: str) -> Iterator[bytes]:
        """Ids of a whole text in packed blocks: what one segment of the text gives at most."""
        if self.split is None or not any(x in text for x in self.special):
            yield from self.of_plain(text)
            return
        for k, part in enumerate(self.split.split(text)):
            if k % 2:
                yield self.packed[self.special[part]]
            else:
                yield from self.of_plain(part)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, packed as little-endian unsigned 32-bit integers."""
        return b"".join(self.blocks(text))

    def decode(self, packed: bytes, block: int = 1 << 16) -> Iterator[str]:
        """Text of packed ids, a block of ids at a time."""
        return self.decode_blocks(packed[at : at + 4 * block] for at in range(0, len(packed), 4 * block))

    def decode_blocks(self, blocks) -> Iterator[str]:
        """Text of packed ids that come in blocks: ids to bytes, bytes to text as far as they are complete."""
        machine, table = codecs.getincrementaldecoder("utf-8")(errors="replace"), self.bytes_of.__getitem__
        for block in blocks:
            yield machine.decode(b"".join(map(table, memoryview(block).cast("I"))))
        yield machine.decode(b"", True)

    def digest(self, text: str) -> tuple[int, str, str]:
        """Tokens of a whole text, the digest of its ids and of the text they decode to, a block at a time."""
        n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()

        def seen():
            nonlocal n
            for block in self.blocks(text):
                n += len(block) // 4
                of_ids.update(block)
                yield block

        for part in self.decode_blocks(seen()):
            of_text.update(part.encode())
        return n, of_ids.hexdigest(), of_text.hexdigest()


_loaded: dict[str, ByteBpe] = {}


def loaded(path: str) -> ByteBpe:
    """One encoder a process and path, with its memo."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and the packed ids of each row's whole text."""
    keep = list(keep)
    source = runtime.unused(keep, "text")
    schema = runtime.kept_and(df, keep, f"`{out}` binary")

    def work(batch: pa.RecordBatch) -> dict:
        bpe = loaded(path)
        ids = [bpe.encode(t or "") for t in batch.column(source).to_pylist()]
        return {c: batch.column(c) for c in keep} | {out: ids}

    return runtime.per_batch(df.select(*map(runtime.quoted, keep), runtime.quoted(text).alias(source)), schema, work, [*keep, source])


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded", keep: tuple[str, ...] = ("doc_id", "ids")) -> DataFrame:
    """The kept columns and the text of each row's packed ids."""
    keep = list(keep)
    source = runtime.unused(keep, "ids")
    schema = runtime.kept_and(df, keep, f"`{out}` string")

    def work(batch: pa.RecordBatch) -> dict:
        bpe = loaded(path)
        texts = ["".join(bpe.decode(x or b"")) for x in batch.column(source).to_pylist()]
        return {c: batch.column(c) for c in keep} | {out: texts}

    return runtime.per_batch(df.select(*map(runtime.quoted, keep), runtime.quoted(ids).alias(source)), schema, work, [*keep, source])


def round_trip(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, each row's packed ids and the text they decode to, in one pass and one worker."""
    keep = list(keep)
    source = runtime.unused(keep, "text")
    schema = runtime.kept_and(df, keep, "ids binary, decoded string")

    def work(batch: pa.RecordBatch) -> dict:
        bpe = loaded(path)
        ids = [bpe.encode(t or "") for t in batch.column(source).to_pylist()]
        return {c: batch.column(c) for c in keep} | {"ids": ids, "decoded": ["".join(bpe.decode(x)) for x in ids]}

    return runtime.per_batch(df.select(*map(runtime.quoted, keep), runtime.quoted(text).alias(source)), schema, work, [*keep, source])


def digests(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document: neither ids nor decoded text is ever whole in memory."""

    def work(batch: pa.RecordBatch) -> dict:
        bpe = loaded(path)
        n, ids, decoded = zip(*(bpe.digest(t or "") for t in batch.column("text").to_pylist()), strict=True)
        return {"doc_id": batch.column("doc_id"), "n_tokens": n, "ids_sha256": ids, "decoded_sha256": decoded}

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return runtime.per_batch(df.select("doc_id", "text"), schema, work, ["doc_id", "text"])
