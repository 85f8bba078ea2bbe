"""Semi-structured text: JSON repair, answers of models, nested exports."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def unfenced(c: Column) -> Column:
    """What stands in a code fence, or the text itself (V1)."""
    inner = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.btrim(F.when(inner != "", inner).otherwise(c), F.lit(" \t\r\n"))


def _parsed(s: str):
    try:
        json.loads(s)
    except ValueError:
        return None
    return s


def repair_text(text: str | None) -> str | None:
    """A ladder of repairs, each tried only if the one before does not parse (V2); null if none does.

    Unlike the scripts to be matched, comments are cut only outside quotes, and closers are in nesting order.
    """
    if text is None:
        return None
    fence = re.search(r"```(?:json)?\s*(.*?)(?:```|$)", text, re.S)
    s = (fence.group(1) if fence else text).strip()
    if found := _parsed(s):
        return found
    s = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*', lambda m: m.group(1) or "", s)
    s = re.sub(r",(\s*[\]}])", r"\1", s)
    s = re.sub(r":\s*(-?\d+(?:\.\d+)?\s*[-~]\s*-?\d+(?:\.\d+)?)(\s*[,}\]])", r': "\1"\2', s)
    if found := _parsed(s):
        return found
    if '"' not in s and (found := _parsed(s.replace("'", '"'))):
        return found
    cut = s
    while cut:
        stack, inside, skip = [], False, False
        for c in cut:
            if skip:
                skip = False
            elif c == "\\" and inside:
                skip = True
            elif c == '"':
                inside = not inside
            elif not inside and c in "[{":
                stack.append("]" if c == "[" else "}")
            elif not inside and c in "]}" and stack:
                stack.pop()
        if not inside and (found := _parsed(cut.rstrip().rstrip(",") + "".join(reversed(stack)))):
            return found
        cut = cut[: max(cut.rfind(","), 0)]
    return None


def repaired(c: Column) -> Column:
    """repair_text over Arrow batches; the function travels with the plan."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(repair_text)

    return F.pandas_udf(run, StringType())(c)


def run_sizes(df: DataFrame, payload: str) -> DataFrame:
    """Entities, relations and rules of each run's payload."""
    v = F.from_json(payload, "entities array<string>, relationships array<string>, rules array<string>")
    size = lambda c: F.coalesce(F.size(v[c]), F.lit(0)).cast("long")
    return df.withColumns({"n_entities": size("entities"), "n_relations": size("relationships"), "n_rules": size("rules")})


EXPORT = "id bigint, data struct<sample_id:string,text:string>, annotations array<struct<completed_by:bigint,was_cancelled:boolean,lead_time:double,created_at:string,result:array<struct<from_name:string,value:struct<choices:array<string>,text:array<string>>>>>>"


def annotations(tasks: DataFrame) -> DataFrame:
    """One row an annotation that was not cancelled, with its first label and reason."""
    a = tasks.select("id", "data", F.explode("annotations").alias("a")).where(~F.coalesce("a.was_cancelled", F.lit(False)))
    first = lambda name: F.get(F.filter("a.result", lambda r: r["from_name"] == name), F.lit(0))["value"]
    return a.select(F.col("id").alias("task_id"), "data.sample_id", "data.text", F.col("a.completed_by").alias("annotator"), F.get(first("sentiment")["choices"], F.lit(0)).alias("label"), F.get(first("reason")["text"], F.lit(0)).alias("reason"), F.col("a.lead_time").alias("lead_time"), F.col("a.created_at").alias("created_at"))


def cache_misses(df: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose md5 key the cache does not hold."""
    return df.withColumn("k", F.md5(F.col(text).cast("binary"))).join(cache.select("k").distinct(), "k", "left_anti")


def prompt(df: DataFrame, columns: list[str], order: str, rows: int = 20) -> DataFrame:
    """A header, the first rows and a summary as one text (V3)."""
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in columns])
    head = df.orderBy(order).limit(rows).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("l")))), lambda x: x["l"]), "\n").alias("body"))
    tail = df.agg(F.concat(F.lit("rows: "), F.count("*"), F.lit(", from "), F.min(order).cast("string"), F.lit(" to "), F.max(order).cast("string")).alias("tail"))
    return head.join(F.broadcast(tail)).select(F.concat_ws("\n", F.lit(",".join(columns)), "body", "tail").alias("prompt"))  # one row each


#: Names that wrap a list of answers, the first that holds one counts (fixed values).
WRAPPERS = ("results", "segments", "result", "data", "output")


def unwrapped(answer: Column) -> Column:
    """The list in an answer (V1): the answer itself, or the list under a wrapper's name, else the object's first list; null if there is none.

    The answer is parsed once, to a VARIANT; lists come back as arrays of VARIANT.
    """
    text = unfenced(answer)
    value = F.try_parse_json(text)
    under = lambda path: F.try_variant_get(value, path, "array<variant>")
    # A VARIANT keeps an object's keys in order of their names; the text has the order in which they stand.
    fields = F.try_variant_get(value, "$", "map<string,variant>")
    lists = F.filter(F.transform(F.json_object_keys(text), lambda k: F.try_variant_get(F.element_at(fields, k), "$", "array<variant>")), lambda x: x.isNotNull())
    return F.coalesce(under("$"), *[under(f"$.{name}") for name in WRAPPERS], F.get(lists, F.lit(0)))


def variant_text(x: Column) -> Column:
    """A VARIANT as text: a string itself, all else as JSON."""
    return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(F.to_json(x))


def answers(df: DataFrame, answer: str, expected: Column) -> DataFrame:
    """The rows with items (texts), n_items and ok: whether the answer has as many items as expected (V1); other answers have no items."""
    found = df.withColumns({"_list": unwrapped(F.col(answer)), "_expected": expected})
    fits = F.coalesce(F.size("_list") == F.col("_expected"), F.lit(False))
    items = F.when(fits, F.transform("_list", variant_text))
    return found.select(*df.columns, items.alias("items"), F.when(F.col("_list").isNotNull(), F.size("_list").cast("long")).alias("n_items"), fits.alias("ok"))


def payload_parts(df: DataFrame, payload: str) -> DataFrame:
    """key, the kind of its value, and the number of items of every part of a JSON payload (A42), by `variant_explode`: a row a part."""
    rows = df.select(*df.columns, F.try_parse_json(payload).alias("_value"))
    parts = rows.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_value").outer())).drop("_value", "pos")
    size = F.size(F.try_variant_get("value", "$", "array<variant>"))
    kind = F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0)
    return parts.select(*df.columns, "key", kind.alias("kind"), F.when(size >= 0, size).otherwise(1).cast("long").alias("n_items"))
