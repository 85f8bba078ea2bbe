"""What the operators of this subpackage share: shipping, checkpoints, bounded samples."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import checkpoint, shared_folder, ship  # noqa: F401

#: ASCII white space, the separators of every "word" in this subpackage.
WORD = r"[^\x20\x09-\x0D]+"


def delete(spark: SparkSession, folder: str) -> None:
    """Deletes a folder through Spark's own file systems."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def quoted(name: str) -> Column:
    """The column of that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(taken: Iterable[str], name: str) -> str:
    """The name, lengthened until no taken one equals it (Spark's names do not tell cases apart)."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name += "_"
    return name


def kept_and(df: DataFrame, keep: Iterable[str], out: str) -> StructType:
    """The schema of the kept columns of a table, followed by the columns of a DDL string."""
    added = StructType.fromDDL(out)
    for name in keep:
        if name in added.names:
            raise ValueError(f"the column {name} is kept already")
    return StructType([*(df.schema[c] for c in keep), *added])


def per_batch(
    df: DataFrame, schema: str | StructType, work: Callable[[pa.RecordBatch], dict[str, Iterable]], columns: list[str]
) -> DataFrame:
    """Maps Arrow batches of the named columns; work returns the values of each output column."""
    ship(df.sparkSession)
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    types = {f.name: f.type for f in to_arrow_schema(schema)}
    names = list(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the memos hold many small objects, which a full collection would scan again and again
        for batch in batches:
            for part in slices(batch):
                out = work(part)
                gc.collect(0)
                yield pa.RecordBatch.from_arrays([as_array(out[n], types[n]) for n in names], names=names)
            pa.default_memory_pool().release_unused()

    return df.select(*map(quoted, columns)).mapInArrow(run, schema)


def as_array(values: Iterable, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, kind)


#: Rows handed to Python code at once, so that a batch's word lists stay small.
SLICE_ROWS, SLICE_BYTES = 2000, 4 << 20


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    rows = batch.num_rows
    if not rows:
        return
    step = max(1, min(SLICE_ROWS, int(rows * SLICE_BYTES / max(1, batch.nbytes))))
    for at in range(0, rows, step):
        yield batch.slice(at, step)


def whole_text(name: str = "text"):
    """The text, a null one as the empty string."""
    return F.coalesce(F.col(name), F.lit(""))


def least(df: DataFrame, value: Column, rows: int, bits: int = 12) -> int | None:
    """A bound at or below which at least `rows` of a column's 64-bit hashes lie, and at most as many more; None: no rows.

    Found from counts by leading bits, then by the next ones within the last of these: a task sends at most
    2 ** bits counts, however many rows it has. Equal hashes are not told apart.
    """
    below, low, shift = 0, -(1 << 63), 64
    while shift > 0:
        width = min(bits, shift)
        within = df.select(value.alias("h")).where(F.col("h").between(F.lit(low), F.lit(low + (1 << shift) - 1)))
        shift -= width
        # The bits below the sign bit's flip count up from the lowest hash.
        place = F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(1 << 63))), shift).bitwiseAND(F.lit((1 << width) - 1))
        counts = within.groupBy(place.alias("b")).count().collect()
        if not counts:
            return None if not below else low - 1
        for r in sorted(counts, key=lambda r: r["b"]):
            at, n = low + (r["b"] << shift), r["count"]
            if below + n >= rows:
                break
            below += n
        else:
            return low + (1 << (shift + width)) - 1
        if below + n <= 2 * rows:
            return at + (1 << shift) - 1
        low = at
    return low


def bounded_sample(df: DataFrame, key: str, rows: int, *columns: str, where: Column | None = None, seed: int = 7) -> list:
    """At most `rows` rows with the smallest hash of the key: the same ones however the table is split.

    The edge of the sample is found over counts of the hashes' leading bits; then only rows below the edge are looked at
    again. Rows without a key are left out. What a row holds should be bounded, as slices of texts are.
    """
    mixed, where = F.xxhash64(F.col(key), F.lit(seed)), F.lit(True) if where is None else where
    keyed = df.where(F.col(key).isNotNull())
    edge = least(keyed.where(where), mixed, rows)
    if edge is None:
        return []
    picked = keyed.where((mixed <= F.lit(edge)) & where).select(mixed.alias("_h"), *columns).orderBy("_h", *columns).limit(rows)
    return sorted(picked.collect(), key=lambda r: (r["_h"], str(r)))


def filtered(df: DataFrame, keep: Callable[[pa.RecordBatch], Iterable], columns: list[str]) -> DataFrame:
    """The rows, with all their columns, for which keep says true; it sees the named columns of a batch."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        for batch in batches:
            for part in slices(batch):
                kept = part.filter(pa.array(keep(part.select(columns)), pa.bool_()))
                gc.collect(0)
                if kept.num_rows:
                    yield kept

    return df.mapInArrow(run, df.schema)


#: A value that more than this share of the rows has (and at least so many rows) is dealt to `SALTS` parts in a join.
HOT_SHARE, HOT_ROWS, SALTS = 1000, 20_000, 64


def join_split(rows: DataFrame, lookup: DataFrame, key: str, counts: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined to lookup (one row a key); keys that many rows have are dealt to several parts.

    counts: key and n, the rows of each key. Fewer than `HOT_SHARE` keys can be hot, so their list is bounded.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = [r[0] for r in counts.where(F.col("n") > max(HOT_ROWS, total // HOT_SHARE)).select(key).collect()]
    if not hot:
        return rows.join(lookup, key, how)
    is_hot = F.col(key).isin(hot)
    left = rows.withColumn("_salt", F.when(is_hot, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.lit(0)))
    every = F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")
    right = lookup.withColumn("_salt", F.explode(F.when(is_hot, every).otherwise(F.array(F.lit(0).cast("bigint")))))
    return left.join(right, [key, "_salt"], how).drop("_salt")
