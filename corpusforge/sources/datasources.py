"""Readers and a writer for Spark's Data Source API: archives, saved answers of a paged API, and batches for a graph store.

    register(spark)
    spark.read.format("archive_csv").option("path", folder).load()

Each file is a partition, opened where it is read and streamed, so neither the driver nor a task holds a file whole. Paths are
folders that driver and executors share; other stores go through their own file system, by the path's scheme.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import ship

#: Rows of an Arrow batch that a reader hands on; bytes read at once.
ROWS, BLOCK = 4096, 1 << 20
#: Rows of a batch for the graph store (fixed values).
NODE_BATCH, EDGE_BATCH = 500, 1000


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str, suffix: str) -> list[str]:
    """The files of a folder with that ending (or the file itself), by name."""
    store, inner = _store(path)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [inner]
    return sorted(f.path for f in store.get_file_info(fs.FileSelector(inner, allow_not_found=True)) if f.type == fs.FileType.File and f.path.lower().endswith(suffix))


def _member(archive: zipfile.ZipFile, suffix: str) -> str | None:
    """The first file of that ending in an archive."""
    return next((n for n in archive.namelist() if n.lower().endswith(suffix)), None)


def json_elements(text: io.TextIOBase) -> Iterator[str]:
    """The elements of a JSON array (or the one object), as texts, reading a block at a time."""
    decoder, held, more, started, is_list = json.JSONDecoder(), "", True, False, False
    while True:
        held = held.lstrip(" \t\r\n,") if started else held.lstrip("﻿ \t\r\n")
        if held and not started:
            started, is_list = True, held[0] == "["
            held = held[is_list:]
            continue
        if is_list and held[:1] == "]":
            return
        if held:
            try:
                _, end = decoder.raw_decode(held)
            except ValueError:
                if not more:
                    raise
            else:
                # A number may go on behind what looks like its end, also in the next block.
                if not more or end < len(held) and held[end] in ",]} \t\r\n":
                    yield held[:end]
                    held = held[end:]
                    if not is_list:
                        return
                    continue
        elif not more:
            return
        block = text.read(BLOCK)
        more = bool(block)
        held += block


@dataclass
class File(InputPartition):
    path: str
    place: int = 0


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict, suffix: str):
        self.schema, self.options, self.suffix = schema, options, suffix

    def partitions(self) -> list[File]:
        return [File(path, k) for k, path in enumerate(_files(self.options["path"], self.suffix))]

    def read(self, partition: File | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # a folder without files has one partition, of nothing
            yield from self._batches(self._rows(partition))

    def _open(self, partition: File):
        store, _ = _store(self.options["path"])
        return store.open_input_file(partition.path)

    def _batches(self, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds, held = to_arrow_schema(self.schema), []

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kinds, strict=True)], schema=kinds)

        for row in rows:
            held.append(row)
            if len(held) == ROWS:
                yield out()
                held = []
        if held:
            yield out()


class ArchiveCsv(DataSource):
    """The first CSV of every ZIP archive of a folder, all columns as text; the archive's name comes first, then the row's number.

    Columns follow the given schema by name, or the header of the first archive. Archives without a CSV give no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "archive_csv"

    def schema(self) -> str:
        for path in _files(self.options["path"], ".zip"):
            with _store(self.options["path"])[0].open_input_file(path) as f, zipfile.ZipFile(f) as archive:
                member = _member(archive, ".csv")
                if member:
                    with archive.open(member) as inner:
                        header = next(csv.reader(io.TextIOWrapper(inner, "utf-8-sig", newline="")), [])
                    return ", ".join(["archive string", "row bigint", *(f"`{c.replace('`', '``')}` string" for c in header)])
        return "archive string, row bigint"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _CsvReader(schema, dict(self.options), ".zip")


class _CsvReader(_Reader):
    def _rows(self, partition: File) -> Iterator[tuple]:
        own = partition.path.rpartition("/")[2]
        with self._open(partition) as f, zipfile.ZipFile(f) as archive:
            member = _member(archive, ".csv")
            if member is None:
                return
            with archive.open(member) as inner:
                rows = csv.reader(io.TextIOWrapper(inner, "utf-8-sig", newline=""))
                header = {c: k for k, c in enumerate(next(rows, []))}
                places = [header.get(c, -1) for c in self.schema.names[2:]]
                for number, row in enumerate(r for r in rows if r):
                    # An empty or missing field is null.
                    yield own, number, *((row[k] or None) if 0 <= k < len(row) else None for k in places)


class ArchiveJson(DataSource):
    """The elements of the first JSON array of every ZIP archive of a folder: archive, row, value (its text)."""

    @classmethod
    def name(cls) -> str:
        return "archive_json"

    def schema(self) -> str:
        return "archive string, row bigint, value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _JsonReader(schema, dict(self.options), ".zip")


class _JsonReader(_Reader):
    def _rows(self, partition: File) -> Iterator[tuple]:
        with self._open(partition) as f, zipfile.ZipFile(f) as archive:
            member = _member(archive, ".json")
            if member is not None:
                with archive.open(member) as inner:
                    for number, value in enumerate(json_elements(io.TextIOWrapper(inner, "utf-8-sig"))):
                        yield partition.path.rpartition("/")[2], number, value


class ArchiveFiles(DataSource):
    """What the archives of a folder are: archive, n_bytes, md5, member (its first CSV or JSON), error."""

    @classmethod
    def name(cls) -> str:
        return "archive_files"

    def schema(self) -> str:
        return "archive string, n_bytes bigint, md5 string, member string, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _FilesReader(schema, dict(self.options), ".zip")


class _FilesReader(_Reader):
    def _rows(self, partition: File) -> Iterator[tuple]:
        digest, size, member, error = hashlib.md5(), 0, None, None
        with self._open(partition) as f:
            while block := f.read(BLOCK):
                digest.update(block)
                size += len(block)
        try:
            with self._open(partition) as f, zipfile.ZipFile(f) as archive:
                member = _member(archive, (".csv", ".json"))
            error = None if member else "no csv or json in zip"
        except (zipfile.BadZipFile, ValueError) as e:
            error = str(e) or type(e).__name__
        yield partition.path.rpartition("/")[2], size, digest.hexdigest(), member, error


class SavedPages(DataSource):
    """Saved answers of a paged API, one file a page in order of their names: page, file, body."""

    @classmethod
    def name(cls) -> str:
        return "saved_pages"

    def schema(self) -> str:
        return "page bigint, file string, body string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PagesReader(schema, dict(self.options), self.options.get("suffix", ".json"))


class _PagesReader(_Reader):
    def _rows(self, partition: File) -> Iterator[tuple]:
        with self._open(partition) as f:
            yield partition.place, partition.path.rpartition("/")[2], f.read().decode("utf-8-sig")


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    rows: int


class GraphBatches(DataSource):
    """A sink of JSON lines in files of at most `batch` rows, as a graph store takes them: `kind` is nodes or edges.

    A task writes under names of its job and its own attempt. Commit lists the files of the tasks that count in `<kind>.manifest.json`, which readers
    go by and which replaces the one before it, and deletes what other attempts of the job wrote; abort deletes all that the job wrote. A lost
    executor may still leave files: they are in no list.
    """

    @classmethod
    def name(cls) -> str:
        return "graph_batches"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _GraphWriter(schema, dict(self.options), overwrite)


class _GraphWriter(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.names, self.kind, self.path, self.overwrite = schema.names, options.get("kind", "nodes"), options["path"], overwrite
        self.job = uuid.uuid4().hex[:12]
        self.batch = int(options.get("batch", EDGE_BATCH if self.kind == "edges" else NODE_BATCH))

    def write(self, iterator) -> Written:
        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        attempt, files, held, rows = uuid.uuid4().hex, [], [], 0

        def out():
            name = f"{self.kind}-{self.job}-{attempt}-{len(files):05d}.jsonl"
            with store.open_output_stream(f"{folder}/{name}") as f:
                f.write("".join(held).encode())
            files.append(name)
            held.clear()

        try:
            for row in iterator:
                held.append(json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str) + "\n")
                rows += 1
                if len(held) == self.batch:
                    out()
            if held:
                out()
        except BaseException:
            self._delete(files)
            raise
        return Written(files, rows)

    def _delete(self, files: list[str]) -> None:
        store, folder = _store(self.path)
        for name in files:
            if store.get_file_info(f"{folder}/{name}").type == fs.FileType.File:
                store.delete_file(f"{folder}/{name}")

    def commit(self, messages) -> None:
        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        target, before = f"{folder}/{self.kind}.manifest.json", {"files": [], "rows": 0}
        if store.get_file_info(target).type == fs.FileType.File:
            before = json.loads(store.open_input_file(target).read())
        new = {"files": sorted(f for m in messages if m for f in m.files), "rows": sum(m.rows for m in messages if m)}
        if not self.overwrite:
            new = {"files": before["files"] + new["files"], "rows": before["rows"] + new["rows"]}
        with store.open_output_stream(target + ".new") as f:
            f.write(json.dumps(new).encode())
        store.move(target + ".new", target)
        kept = set(new["files"])
        self._delete([f for f in [*self._written(), *(before["files"] if self.overwrite else [])] if f not in kept])

    def _written(self) -> list[str]:
        """The files of this job, of all attempts."""
        store, folder = _store(self.path)
        names = (f.base_name for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)))
        return [n for n in names if n.startswith(f"{self.kind}-{self.job}-")]

    def abort(self, messages) -> None:
        self._delete(self._written())


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session, and sends this package to the executors."""
    ship(spark)
    for source in (ArchiveCsv, ArchiveJson, ArchiveFiles, SavedPages, GraphBatches):
        spark.dataSource.register(source)


def until_empty(pages: DataFrame, body: str = "body", items: str = "comments") -> DataFrame:
    """The pages before the first one without items (S9): a crawl stops there."""
    n = F.size(F.try_variant_get(F.try_parse_json(body), f"$.{items}", "array<variant>"))
    first = pages.where(F.coalesce(n, F.lit(0)) <= 0).agg(F.min("page").alias("_first"))
    return pages.join(F.broadcast(first)).where(F.col("_first").isNull() | (F.col("page") < F.col("_first"))).drop("_first")  # one row


def table_manifest(df: DataFrame, label: str | None = None, by: str | None = None) -> DataFrame:
    """n_rows, n_columns, missing, duplicated (rows equal to another), labels (counts by value, as JSON in order) and digest of a table, by part if named.

    The digest does not depend on the order of rows: the sum of the first 60 bits of their md5. Rows are compared by md5 of all columns.
    """
    columns = [c for c in df.columns if c != by and not (by and c == "row")]
    text: list[Column] = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in columns]
    part = F.col(by) if by else F.lit("")
    missing = sum((F.col(f"`{c}`").isNull().cast("bigint") for c in columns), F.lit(0).cast("bigint"))
    rows = df.select(part.alias("part"), F.md5(F.concat_ws("\1", *text).cast("binary")).alias("h"), missing.alias("missing"), (F.col(label).cast("string") if label else F.lit(None).cast("string")).alias("label"))
    number = F.conv(F.substring("h", 1, 15), 16, 10).cast("decimal(38,0)")
    once = rows.groupBy("part", "h", "label").agg(F.count("*").alias("n"), F.max("missing").alias("missing"))
    whole = once.groupBy("part").agg(
        F.sum("n").alias("n_rows"), F.sum(F.col("n") * F.col("missing")).alias("missing"), F.sum(F.col("n") - 1).alias("duplicated"), F.sum(F.col("n") * number).cast("string").alias("digest")
    )
    counts = once.where("label IS NOT NULL").groupBy("part", "label").agg(F.sum("n").alias("n")).groupBy("part")
    counts = counts.agg(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("label", "n"))), lambda x: F.concat(F.lit('"'), x["label"], F.lit('":'), x["n"].cast("string"))), ","), F.lit("}")).alias("labels"))
    return whole.join(counts, "part", "left").select(F.col("part").alias(by or "part"), "n_rows", F.lit(len(columns)).cast("bigint").alias("n_columns"), "missing", "duplicated", "labels", "digest")


def archive_manifest(spark: SparkSession, folder: str, label: str | None = None) -> DataFrame:
    """Every archive of a folder: what it is, and its table's manifest (S11); archives that cannot be read say why."""
    files = spark.read.format("archive_files").option("path", folder).load()
    rows = spark.read.format("archive_csv").option("path", folder).load()
    known = table_manifest(rows, label if label in rows.columns else None, by="archive")
    return files.join(known, "archive", "left").withColumn("ok", F.col("error").isNull())
