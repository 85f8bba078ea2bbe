"""Phrase conversion against plain leftmost longest matching, and small sinks and helpers."""

import json
import random
import re

import pytest
from corpusforge.functions import phrases as P
from corpusforge.functions import text as T
from corpusforge.operators import semi as J
from corpusforge.sources import tables as R
from pyspark.sql import functions as F


def longest_first(text, table):
    out, at = "", 0
    while at < len(text):
        hit = max((p for p in table if p and text.startswith(p, at)), key=len, default=None)
        out += table[hit] if hit else text[at]
        at += len(hit) if hit else 1
    return out


def test_replace_equals_leftmost_longest():
    rng = random.Random(8)
    for _ in range(3000):
        letters = rng.choice(["ab", "abc", "酒庄里"])
        table = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 5))): rng.choice(["", "X", "yz"]) for _ in range(rng.randint(0, 7))}
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 25)))
        assert P.Phrases(table).replace(text) == longest_first(text, table), (text, table)


def test_a_long_match_that_fails_falls_back():
    table = {"abcd": "1", "b": "2", "cc": "3"}
    assert P.Phrases(table).replace("abcc") == "a23" and P.Phrases({"": "x"}).replace("abc") == "abc" and P.Phrases({}).replace("") == ""


def test_conversion_runs_where_the_script_is(spark):
    table = {"這是": "这是", "一個": "一个", "測試": "测试", "x": "no"}
    df = spark.createDataFrame([("這是一個測試x",), ("plain x",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(P.converted(F.col("t"), table)).collect()] == ["这是一个测试no", "plain x", None, ""]
    cleaned = df.select(T.clean(F.col("t"), phrases={"這是": "这是", "一個": "一个", "測試": "测试"})).collect()
    assert [r[0] for r in cleaned] == ["这是一个测试x", "plain x", "", ""]


def test_every_document_of_the_table(spark, sf):
    from corpusforge.plans import advanced

    table = {p: f"<{p}>" for p in advanced._PHRASES}
    pattern = re.compile("|".join(sorted(map(re.escape, table), key=lambda p: -len(p))))
    finder = P.Phrases(table)
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        assert finder.replace(r.text) == pattern.sub(lambda m: table[m[0]], r.text)


def test_reports_are_written_whole(spark, tmp_path):
    rows = spark.range(250).selectExpr("id", "IF(id = 3, 'a \"b\", c', 'x|y') AS t")
    R.write_report(rows.repartition(4), str(tmp_path / "r"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*")))
    assert text.count("\n") == 251 and text.startswith("﻿id,t") and '3,"a ""b"", c"' in text
    assert R.markdown(rows).count("\n") == 251 and "| 5 | x/y |" in R.markdown(rows)
    with pytest.raises(ValueError, match="more than 100 rows"):
        R.markdown(rows, 100)


def test_json_lines_csv_and_inventory(spark, tmp_path):
    rows = spark.createDataFrame([("k1", ["a", "b"]), ("k2", [])], "k string, t array<string>")
    R.write_jsonl(rows.coalesce(1), str(tmp_path / "cache"))
    R.write_jsonl(spark.createDataFrame([("k3", ["c"])], rows.schema), str(tmp_path / "cache"), append=True)
    back = R.jsonl(spark, str(tmp_path / "cache"), "k string, t array<string>")
    assert {r.k: r.t for r in back.collect()} == {"k1": ["a", "b"], "k2": [], "k3": ["c"]}
    texts = spark.createDataFrame([("x",), ("new",)], "text string")
    known = texts.where("text = 'x'").select(F.md5(F.col("text").cast("binary")).alias("k"))
    assert [r.text for r in J.cache_misses(texts, known).collect()] == ["new"]
    R.write_csv(spark.createDataFrame([("a,b", 'q"'), (None, "z")], "m string, n string").coalesce(1), str(tmp_path / "c"))
    assert {tuple(r) for r in R.csv_strings(spark, str(tmp_path / "c")).collect()} == {("a,b", 'q"'), ("", "z")}
    files = {r.path.rpartition("/")[2]: r for r in R.inventory(spark, str(tmp_path / "cache" / "*.json")).collect()}
    assert sum(r.n_lines for r in files.values()) == 3 and all(r.n_bytes > 0 and len(r.md5) == 8 for r in files.values())


def test_prompt_and_run_sizes(spark):
    days = spark.createDataFrame([(f"2024-01-{k:02d}", float(k)) for k in range(1, 32)], "day string, t double")
    lines = J.prompt(days, ["day", "t"], "day", 3).first().prompt.split("\n")
    assert lines == ["day,t", "2024-01-01,1.0", "2024-01-02,2.0", "2024-01-03,3.0", "rows: 31, from 2024-01-01 to 2024-01-31"]
    runs = spark.createDataFrame([("m", json.dumps({"entities": ["a", "b"], "rules": ["r"]})), ("n", "{}")], "model string, payload string")
    got = {r.model: (r.n_entities, r.n_relations, r.n_rules) for r in J.run_sizes(runs, "payload").collect()}
    assert got == {"m": (2, 0, 1), "n": (0, 0, 0)}
    assert spark.range(1).select(T.silver_label(F.lit("正面"), F.lit("负面")), T.silver_label(F.lit(None), F.lit("负面"))).first() == ("正面", "负面")
