"""Packing by minimum bin slack: a bitset subset-sum picks the remaining lengths that fill each window best.

Every partition packs its own documents, in groups of `GROUP` documents: no shuffle, memory bounded by a group, and a
partition that is worked out again gives the same pieces. A document of 2048 ids or more gives full windows as they
come; its rest waits. A window is opened with the longest waiting length; the reachable sums of the others are one
big integer, shifted once for each power-of-two share of a length's count; the reachable sum closest to the
capacity is traced back to counts of lengths. A window less full than `SLACK` stays open for the next group. At a
partition's end a length that no others complete is set aside while the others go on; then each window of those set
aside takes the best sum and a part of one more piece. Only what is left of one window is laid end to end and cut to
power-of-two sequences, which need no padding.

Defined results: a null or empty text has one id (the end id), so one piece; repeated rows are packed as separate
documents, also under equal doc_ids; ties take the earliest document; an empty table gives an empty table;
extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime
from .bpe import PIECES, loaded, vocabulary

CAPACITY, END_ID, GROUP, SLACK = 2048, 1, 4096, 4
#: White space, or other characters, in one run, beyond which a text is encoded by this package's own encoder.
LONG_RUN = 20_000
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Counts of lengths whose sum is as close to the capacity as the given counts allow.

    Each length's count is split into shares of 1, 2, 4, ... and the rest; bit s of `reached` says that the sum s can
    be made. The sums reached before each share allow the trace back.
    """
    reached, steps = 1, []
    limit = (1 << (capacity + 1)) - 1
    full = 1 << capacity
    for length in sorted(counts, reverse=True):
        most = min(counts[length], capacity // length)
        share = 1
        while most > 0:
            take = min(share, most)
            steps.append((length, take, reached))
            reached |= (reached << (length * take)) & limit
            most -= take
            share *= 2
        if reached & full:
            break
    left = reached.bit_length() - 1
    used: dict[int, int] = defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> left & 1:
            used[length] += take
            left -= length * take
    return dict(used)


class Packer:
    """Windows of a partition. Pieces are (row, start, length, crc, ids or None)."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY):
        self.capacity, self.next = capacity, first_sequence
        self.waiting: dict[int, deque] = defaultdict(deque)
        self.out: list[tuple] = []
        self.by_sums = 0  # ids in windows made of whole pieces by subset sums

    def place(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.out.append((doc_id, start, n, zlib.crc32(ids), total, self.next, at))
            at += n
        self.next += 1

    def add(self, doc_id, ids: bytes) -> None:
        """A document: its full windows at once, its rest to those that wait."""
        n, step = len(ids) // 4, self.capacity
        at = 0
        while n - at >= step:
            self.place([(doc_id, at, ids[4 * at : 4 * (at + step)], n)])
            at += step
        if n > at:
            self.waiting[n - at].append((doc_id, at, ids[4 * at :], n))

    def take(self, length: int) -> tuple:
        piece = self.waiting[length].popleft()
        if not self.waiting[length]:
            del self.waiting[length]
        return piece

    def longest(self) -> tuple[int, dict[int, int], int]:
        """The longest waiting length, the counts of others that fill its window best, and the window's ids."""
        longest = max(self.waiting)
        counts = {n: len(q) for n, q in self.waiting.items()}
        counts[longest] -= 1
        used = fill({n: c for n, c in counts.items() if c}, self.capacity - longest)
        return longest, used, longest + sum(n * c for n, c in used.items())

    def taken(self, longest: int, used: dict[int, int]) -> list[tuple]:
        return [self.take(longest)] + [self.take(n) for n, c in used.items() for _ in range(c)]

    def pack(self, last: bool = False) -> None:
        """Windows from what waits; one that is not nearly full stays for later pieces, unless they are the last.

        At the last call a longest length that no others complete is set aside, and the rest go on without it.
        """
        aside = {}
        while self.waiting:
            longest, used, total = self.longest()
            if last and total < self.capacity:
                aside[longest] = self.waiting.pop(longest)
                continue
            if total < self.capacity - SLACK and sum(len(q) for q in self.waiting.values()) < GROUP:
                break
            self.by_sums += total
            self.place(self.taken(longest, used))
        self.waiting.update(aside)
        if last:
            self.finish()

    def finish(self) -> None:
        """The rest: the best sum for each window and a part of one more piece; at the end, powers of two.

        No piece left by a best sum fits the gap as a whole, so the shortest is cut and its other part waits on.
        """
        left = sum(n * len(q) for n, q in self.waiting.items())
        while left >= self.capacity:
            longest, used, total = self.longest()
            pieces = self.taken(longest, used)
            if gap := self.capacity - total:
                doc_id, start, ids, n = self.take(min(self.waiting))
                pieces.append((doc_id, start, ids[: 4 * gap], n))
                self.waiting[len(ids) // 4 - gap].append((doc_id, start + gap, ids[4 * gap :], n))
            self.place(pieces)
            left -= self.capacity
        rest = deque(self.take(n) for n in sorted(self.waiting, reverse=True) for _ in range(len(self.waiting[n])))
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            pieces = []
            while size:
                doc_id, start, ids, total = rest.popleft()
                n = min(size, len(ids) // 4)
                pieces.append((doc_id, start, ids[: 4 * n], total))
                if n < len(ids) // 4:
                    rest.appendleft((doc_id, start + n, ids[4 * n :], total))
                size -= n
            self.place(pieces)


class Encoder:
    """Ids of a byte-level BPE file of the tokenizers library, by tiktoken's engine over the same vocabulary.

    The ids are those of the tokenizers library (tests hold them equal); the engine takes a third of its time. Its pattern
    matcher recurses on long runs of white space, so texts with a long run go to this package's own encoder.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        bytes_of, self.special, _, _ = vocabulary(path)
        apart = set(self.special.values())
        ranks = {x: i for i, x in enumerate(bytes_of) if i not in apart}
        self.engine = tiktoken.Encoding("packing", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=self.special)
        self.long_run = re.compile(rf"\s{{{LONG_RUN}}}|\S{{{LONG_RUN}}}")

    def encode(self, text: str) -> bytes:
        if len(text) > LONG_RUN and self.long_run.search(text):
            return loaded(self.path).encode(text)
        if any(x in text for x in self.special):
            ids = self.engine.encode(text, allowed_special="all", disallowed_special=())
        else:
            ids = self.engine.encode_ordinary(text)
        return array("I", ids).tobytes()


_loaded: dict[str, Encoder] = {}


def pack(df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document's ids, by sequence: see SCHEMA."""
    runtime.ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gc

        gc.disable()
        context = TaskContext.get()
        packer = Packer((context.partitionId() if context else 0) << 40, capacity)
        if path not in _loaded:
            _loaded[path] = Encoder(path)
        encode, tail, waiting = _loaded[path].encode, end_id.to_bytes(4, "little"), 0

        def out():
            rows, packer.out = packer.out, []
            columns = list(zip(*rows, strict=True)) or [()] * len(NAMES)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=NAMES)

        for batch in batches:
            for part in runtime.slices(batch):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    packer.add(doc_id, encode(text or "") + tail)
                    waiting += 1
                    if waiting >= GROUP:
                        packer.pack()
                        waiting = 0
                gc.collect(0)
                yield out()
        packer.pack(last=True)
        yield out()

    return df.select("doc_id", F.col("text")).mapInArrow(run, SCHEMA)
