"""SimHash near-duplicates by covering locality-sensitive hashing.

For a radius r, every nonzero vector v of r + 1 bits gives a mask: position i of the fingerprint belongs to it if
the inner product of v with the position's own vector is odd. The positions' vectors run evenly through all nonzero
ones. Two fingerprints that differ in at most r positions span at most r dimensions, so some v is orthogonal to
all of them: that mask covers no differing position, and the pair collides in its table. No pair is missed.

Equal fingerprints are one node. A bucket yields only links that join its parts (a spanning forest of the pairs
within the radius), never all pairs. Buckets over `HOT_BUCKET` are dealt to finer ones, by a second covering of the
positions outside their mask. Components are the smallest reachable label, by large-star and small-star rounds.

Defined results: a null text is the empty text; no words give fingerprint zero, linked like any other; one or two
words are one shingle; ties at exactly half do not set a bit; repeated rows and equal doc_ids are kept; a null
doc_id never names a component unless it has no other; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime

BITS, RADIUS, SEED, SHINGLE = 64, 3, 42, 3
#: Fingerprints in a bucket beyond which it is dealt to finer ones.
HOT_BUCKET = 2000
_PLANES = np.array([[b >> k & 1 for k in range(8)] for b in range(256)], np.int64)


def masks(bits: int = BITS, radius: int = RADIUS, positions: list[int] | None = None) -> list[int]:
    """Covering masks over the positions (all of them by default), as unsigned integers."""
    positions = list(range(bits)) if positions is None else positions
    vectors = (1 << (radius + 1)) - 1
    own = {p: 1 + k % vectors for k, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (own[p] & v).bit_count() & 1) for v in range(1, vectors + 1)]


def simhash(text: str | None) -> int:
    """The 64-bit fingerprint of a whole text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        h = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        start = np.cumsum(size) - size
        ends = (start + size - 1)[SHINGLE - 1 :].tolist()
        digest = xxhash.xxh64_intdigest
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(start.tolist(), ends, strict=False)), np.uint64, len(words) - SHINGLE + 1)
    n = len(h)
    octets = h.astype("<u8").view(np.uint8).reshape(n, 8)
    if n > 256:
        ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _PLANES for k in range(8)])
    else:
        ones = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit integer."""

    def work(batch: pa.RecordBatch) -> dict:
        found = np.array([simhash(t) for t in batch.column("_text").to_pylist()], np.uint64)
        return {"doc_id": batch.column("doc_id"), "fp": found.view(np.int64)}

    return runtime.per_batch(df.select("doc_id", F.col(text).alias("_text")), "doc_id bigint, fp bigint", work, ["doc_id", "_text"])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _tables(nodes: DataFrame, column: str = "fp") -> DataFrame:
    """A row for each table: its number and the covered part of the fingerprint."""
    keys = F.array(*[F.struct(F.lit(k).alias("t"), F.col(column).bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks())])
    return nodes.select(column, F.explode(keys).alias("k")).select(column, "k.t", "k.key")


def _finer(rows: DataFrame) -> DataFrame:
    """Rows of hot buckets, dealt by a second covering over the positions that their mask leaves out."""
    every = (1 << BITS) - 1
    second = []
    for k, m in enumerate(masks()):
        outside = [p for p in range(BITS) if (every ^ m) >> p & 1]
        second.append(F.array(*[F.struct(F.lit(1000 + 100 * k + j).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m | x))).alias("key")) for j, x in enumerate(masks(radius=RADIUS, positions=outside))]))
    keys = F.element_at(F.array(*second), F.col("t") + 1)
    return rows.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.key")


def forest(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that join the given different fingerprints exactly as all pairs within the radius do.

    Each fingerprint is visited once and compared with those not yet reached, a row at a time.
    """
    if len(fps) == 2:
        return [(0, 1)] if (int(fps[0]) ^ int(fps[1])).bit_count() <= radius else []
    found, away = [], np.arange(len(fps))
    while len(away):
        queue, away = [int(away[0])], away[1:]
        while queue and len(away):
            i = queue.pop()
            near = np.bitwise_count(fps[away] ^ fps[i]) <= radius
            hit = away[near].tolist()
            found += [(i, j) for j in hit]
            queue += hit
            away = away[~near]
    return found


def _bucket_links(batches):
    """Links of the buckets, which come one after the other in rows sorted by table and key."""
    kept = None

    def runs(t, key, fp, last):
        if not len(fp):
            return [], (t, key, fp)
        new = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
        bounds = np.concatenate([[0], new, [len(fp)]])
        stop = len(bounds) - 1 if last else len(bounds) - 2
        sizes = np.diff(bounds)
        out = []
        for k in np.flatnonzero(sizes[:stop] > 1):
            own = fp[bounds[k] : bounds[k + 1]]
            out += [(int(own[i]), int(own[j])) for i, j in forest(own.view(np.uint64))]
        rest = slice(bounds[stop], None)
        return out, (t[rest], key[rest], fp[rest])

    def batch_of(found):
        a = np.array([x for x, _ in found], np.int64)
        b = np.array([y for _, y in found], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        t, key, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("t", "key", "fp"))
        if kept is not None:
            t, key, fp = (np.concatenate(x) for x in zip(kept, (t, key, fp), strict=True))
        found, kept = runs(t, key, fp, last=False)
        if found:
            yield batch_of(found)
    if kept is not None:
        found, _ = runs(*kept, last=True)
        if found:
            yield batch_of(found)


def links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) of different fingerprints that join them as all pairs within the radius do; nodes: distinct fp."""
    runtime.ship(nodes.sparkSession)
    rows = _tables(nodes)
    hot = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > HOT_BUCKET).select("t", "key")
    hot = runtime.checkpoint(hot)
    if not hot.isEmpty():
        cold = rows.join(hot, ["t", "key"], "left_anti")
        rows = cold.select("fp", "t", "key").unionByName(_finer(rows.join(hot, ["t", "key"], "left_semi").select("fp", "t", "key")))
    dealt = rows.select("t", "key", "fp").repartition("t", "key").sortWithinPartitions("t", "key", "fp")
    return dealt.mapInArrow(_bucket_links, "a bigint, b bigint").distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """node, label: the smallest node reachable over the edges (a, b), by alternating large and small stars."""
    edges = runtime.checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    for _ in range(rounds):
        # Large star: all greater neighbours of a node go to the smallest node around it.
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = runtime.checkpoint(small.where("u <> v").distinct())
        before, state = state, edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    raise RuntimeError("the components did not settle")


def labels(prints: DataFrame) -> DataFrame:
    """fp, label (the component's smallest fingerprint), n (rows): of every different fingerprint of prints (fp)."""
    nodes = runtime.checkpoint(prints.groupBy("fp").agg(F.count("*").alias("n")))
    found = components(links(nodes.select("fp"))).select(F.col("node").alias("fp"), "label")
    return nodes.join(found, "fp", "left").select("fp", "n", F.coalesce("label", "fp").alias("label"))


def near_duplicates(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    prints = runtime.checkpoint(fingerprints(df, text))
    labelled = runtime.checkpoint(labels(prints))
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    named = labelled.join(first, "fp").select("fp", "label", "first")
    smallest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    of_label = labelled.groupBy("label").agg(F.count("*").alias("n"))
    of = runtime.join_split(named.select("fp", "label"), smallest, "label", of_label).select("fp", "component_id")
    return runtime.join_split(prints, of, "fp", labelled.select("fp", "n")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(df: DataFrame, text: str = "text") -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest doc_id, then the smallest row hash.

    Rows are told apart by doc_id and a hash of all their columns, so different texts under one doc_id are different
    rows; rows without a doc_id come last in a component. Of rows that are equal in every column one is left. Map columns,
    which have no hash, do not count here: rows that differ in nothing else are equal. Columns may have any names.
    """
    mine, one = runtime.unused(df.columns, "_row"), runtime.unused(df.columns, "_kept")
    hashed = [runtime.quoted(f.name) for f in df.schema if "map" not in f.dataType.simpleString()]
    row = F.xxhash64(*hashed)

    def work(batch: pa.RecordBatch) -> dict:
        found = np.array([simhash(t) for t in batch.column(text).to_pylist()], np.uint64)
        return {"doc_id": batch.column("doc_id"), "row": batch.column("row"), "fp": found.view(np.int64)}

    keyed = df.select("doc_id", text, row.alias("row"))
    prints = runtime.checkpoint(runtime.per_batch(keyed, "doc_id bigint, row bigint, fp bigint", work, ["doc_id", text, "row"]))
    labelled = runtime.checkpoint(labels(prints))
    # The best row of each fingerprint, then of each component: a minimum, summed up before each shuffle.
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))
    best = prints.groupBy("fp").agg(F.min(place).alias("best"))
    first = labelled.join(best, "fp").groupBy("label").agg(F.min("best").alias("best"))
    first = runtime.checkpoint(first.select(F.col("best.doc_id").alias("_first"), F.col("best.row").alias("_row")))
    kept = df.withColumn(mine, row)
    kept = kept.join(first, kept["doc_id"].eqNullSafe(first["_first"]) & (kept[mine] == first["_row"]), "left_semi")
    # Only rows that are equal in every column are left to be told apart: their places are few, or one of many rows.
    times = prints.groupBy("doc_id", "row").agg(F.count("*").alias("n")).where("n > 1")
    repeated = runtime.checkpoint(times.join(first, times["doc_id"].eqNullSafe(first["_first"]) & (times["row"] == first["_row"]), "left_semi").select(F.col("doc_id").alias("_first"), F.col("row").alias("_repeated")))
    if repeated.isEmpty():
        return kept.drop(mine)
    same = kept["doc_id"].eqNullSafe(repeated["_first"]) & (kept[mine] == repeated["_repeated"])
    once = kept.join(repeated, same, "left_anti").select(*map(runtime.quoted, df.columns))
    copies = kept.join(repeated, same, "left_semi").groupBy("doc_id", mine).agg(F.any_value(F.struct(*map(runtime.quoted, df.columns))).alias(one))
    return once.unionByName(copies.select(f"{one}.*"))
