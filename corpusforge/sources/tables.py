"""Sources and sinks: CSV, JSON, JSONL, HTML, nested API answers, partitioned and report outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ml import numbered

#: Columns of the unified crawl table (fixed).
UNIFIED = ("doc_id", "source", "source_type", "site", "domain", "doc_url", "author", "rating_star", "rating_title", "comment_time", "votes", "text_raw", "crawl_time", "page")


def csv_strings(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """CSV with all columns as text; what is missing is the empty text."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return reader.csv(path).fillna("")


def csv_typed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a given schema (S2, S3); dates are parsed by their type."""
    return spark.read.option("header", True).schema(schema).csv(path)


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first path that exists, on any file system that Spark reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(conf).exists(at):
            return p
    return None


def unified(df: DataFrame, mapping: dict[str, str | Column], columns: tuple[str, ...] = UNIFIED) -> DataFrame:
    """The fixed columns: mapped ones, or the column of that name, or the empty text."""
    def one(c):
        m = mapping.get(c, c)
        x = m if isinstance(m, Column) else F.col(m) if m in df.columns else F.lit("")
        return F.coalesce(x.cast("string"), F.lit("")).alias(c)

    return df.select(*[one(c) for c in columns])


def labelled(df: DataFrame, name: str, order: str, text: str | None = None, label: str | None = None) -> DataFrame:
    """A labelled table in the unified form: text and label by name or place, id from the row's number."""
    text = text or ("review" if "review" in df.columns else df.columns[1])
    label = label or ("label" if "label" in df.columns else df.columns[0])
    df = numbered(df, F.col(order), out="_number")
    number = F.col("_number")
    key = F.substring(F.md5(F.concat_ws("::", F.lit(name), number.cast("string")).cast("binary")), 1, 16)
    return df.select(key.alias("doc_id"), F.lit(name).alias("source"), F.col(text).cast("string").alias("text_raw"), F.col(label).cast("string").alias("rating_title"))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that do not parse are left out."""
    # Parsed from plain lines: the reader's own record column may not be asked for alone, as count() does.
    parsed = F.from_json("value", T.StructType.fromDDL(schema).add("_bad", T.StringType()), {"columnNameOfCorruptRecord": "_bad"})
    rows = spark.read.text(path).where(F.trim("value") != "").select(parsed.alias("r"))
    return rows.where(F.col("r").isNotNull() & F.col("r._bad").isNull()).select(*[F.col(f"r.`{c}`") for c in T.StructType.fromDDL(schema).names])


def api_comments(df: DataFrame, body: str = "body") -> DataFrame:
    """Comments of a paged API's answers; answers with another code than 200 have none."""
    v = F.from_json(body, "code int, total bigint, comments array<struct<commentId:bigint,time:bigint,likedCount:bigint,content:string,user:struct<nickname:string>>>")
    rows = df.withColumn("_v", v).where("_v.code = 200").select(*df.columns, F.explode("_v.comments").alias("c"))
    from ..functions.text import local_time

    return rows.select(*[c for c in df.columns if c != body], F.col("c.commentId").alias("comment_id"), local_time(F.col("c.time")).alias("comment_time"), F.col("c.likedCount").alias("votes"), F.col("c.user.nickname").alias("author"), F.col("c.content").alias("text_raw"))


def daily_arrays(df: DataFrame, body: str, fields: list[str]) -> DataFrame:
    """Parallel arrays of a weather answer as one row a day."""
    schema = "daily struct<time:array<string>," + ",".join(f"{f}:array<double>" for f in fields) + ">"
    v = F.from_json(body, schema)["daily"]
    rows = df.select(F.explode(F.arrays_zip(v["time"].alias("time"), *[v[f].alias(f) for f in fields])).alias("d"))
    return rows.select(F.to_date("d.time").alias("day"), *[F.col(f"d.{f}").alias(f) for f in fields])


def page_probe(pages: DataFrame) -> DataFrame:
    """Size, title and script of fetched pages."""
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return pages.select("page_id", F.octet_length("html").cast("long").alias("n_bytes"), F.left(F.trim(title), F.lit(80)).alias("title"), F.col("html").rlike(r"[\x{4e00}-\x{9fff}]").alias("has_han"), (F.octet_length("html") > 500).alias("ok"))


def html_list(pages: DataFrame, pattern: str, columns: list[str], html: str = "html") -> DataFrame:
    """One row a match of a pattern with groups, in page order."""
    places = F.regexp_extract_all(html, F.lit(pattern), F.lit(0))
    rows = pages.select(*[c for c in pages.columns if c != html], F.posexplode(places).alias("pos", "_m"))
    return rows.select(*[c for c in rows.columns if c != "_m"], *[F.regexp_extract("_m", pattern, k + 1).alias(c) for k, c in enumerate(columns)])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header (K1); for a small result, coalesce before."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_by_source(df: DataFrame, path: str, slugs: dict[str, str], column: str = "source", fallback: str = "other") -> None:
    """One folder a source (K3)."""
    slug = F.coalesce(F.create_map(*[F.lit(x) for kv in slugs.items() for x in kv])[F.col(column)], F.lit(fallback)) if slugs else F.lit(fallback)
    df.withColumn("slug", slug).write.mode("overwrite").partitionBy("slug").json(path)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Path, size, lines and md5 prefix of files (K6)."""
    files = spark.read.format("binaryFile").load(path)
    lines = F.length(F.regexp_replace(F.decode("content", "ISO-8859-1"), r"[^\n]", "")).cast("long")
    return files.select("path", F.col("length").alias("n_bytes"), lines.alias("n_lines"), F.substring(F.md5("content"), 1, 8).alias("md5"))


def markdown(df: DataFrame, most: int = 10_000) -> str:
    """A small result as a Markdown table (K5); one of more than `most` rows is no such table, and an error."""
    from ..functions.text import markdown_cell

    rows = df.select(*[markdown_cell(F.col(c)).alias(c) for c in df.columns]).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *["| " + " | ".join(r) + " |" for r in rows]])


def write_report(df: DataFrame, path: str) -> None:
    """A report as one CSV file's text with a byte order mark, as spreadsheets want it (K1): all rows, streamed through the one task that one file needs."""
    named = df.select(*[F.col(f"`{c}`").cast("string").alias(c if k else "\ufeff" + c) for k, c in enumerate(df.columns)])
    writer = named.coalesce(1).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
    writer.option("nullValue", "").option("emptyValue", "").csv(path)


def without_index(df: DataFrame) -> DataFrame:
    """Without the unnamed columns that an index leaves in a file."""
    return df.select(*[c for c in df.columns if not (c == "" or c.startswith("Unnamed: ") or c == "_c0")])


#: The schema of extracted knowledge (fixed names).
KNOWLEDGE = (
    "model string, elapsed_seconds double, input_tokens bigint, output_tokens bigint, parsed struct<entities:array<struct<id:string,type:string,name:string,properties:map<string,string>>>,"
    "relationships:array<struct<source:string,target:string,type:string,properties:map<string,string>>>,rules:array<string>>"
)


def knowledge(spark: SparkSession, path: str) -> DataFrame:
    """Extraction answers, one file each; those without a parsed part are left out (S18). Rules that are objects stay as JSON."""
    files = spark.read.option("wholetext", True).text(path)
    return files.select(F.from_json("value", KNOWLEDGE).alias("k")).select("k.*").where("parsed IS NOT NULL")


def judged_answers(spark: SparkSession, path: str) -> DataFrame:
    """Answers of a judge, JSON lines: case, ideal tokens, scores by method (G15's ingest), one row a case and method."""
    rows = jsonl(spark, path, "case string, ideal array<string>, scores map<string,double>")
    return rows.select("case", "ideal", F.explode_outer("scores").alias("method", "score"))


def save_arrays(spark: SparkSession, arrays: dict, path: str) -> None:
    """Parameters of a model: one row an array, with its shape (K9)."""
    rows = [(k, list(map(int, v.shape)), v.astype(float).ravel().tolist()) for k, v in arrays.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, numbers array<double>").write.mode("overwrite").parquet(path)


def load_arrays(spark: SparkSession, path: str) -> dict:
    import numpy as np

    return {r["name"]: np.array(r["numbers"]).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}
