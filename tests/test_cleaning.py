"""Cleaning steps and rules against their plain patterns, over every character; no text is searched more often than it must be."""

import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusforge.functions import text as T

SPACES = "\t\n\x0b\f\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def plans(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def characters(spark):
    """Each character alone, within a text and in a run, for 0 to 1FFFF without surrogates."""
    cs = [chr(k) for k in range(0x20000) if not 0xD800 <= k < 0xE000]
    return spark.createDataFrame([(f"{c}x{c}é{c}{c} y{c}",) for c in cs] + [(f"{c}x{c}{c} y",) for c in cs[:256]], "t string").repartition(16).cache()


def same(df, got, want):
    assert df.where(~got.eqNullSafe(want)).limit(3).collect() == []


# The rules


def test_kept_characters_are_those_outside_the_class_of_dropped_ones(characters):
    t, without = F.col("t"), F.regexp_replace("t", f"{T.NOT_KEPT}+", "")
    same(characters, T.kept(t), F.length(without))
    same(characters, T.dedup_key(t), F.lower(without))
    same(characters, F.coalesce(T.invalid_reason(t) == "digits_or_symbol_only", F.lit(False)), (F.length(t) >= 4) & t.rlike(r"^[^\p{L}]+$"))


def test_share_of_kept_characters_wherever_they_stand(spark):
    rng = random.Random(7)
    texts = ["", "a", "…", "…" * 90 + "a" * 10, "a" * 15 + "…" * 85, "…" * 85 + "a" * 15, "…" * 86 + "a" * 14, "a" * 14 + "…" * 86, "好" * 3 + "😀" * 17, "😀" * 17 + "好" * 3, "😀" * 18 + "好" * 2, None]
    texts += ["".join(rng.choices("a9好…😀 é", (2, 1, 1, 14, 5, 5, 3), k=rng.randint(1, 60))) for _ in range(600)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.keeps_less(F.col("t"), 0.15).alias("less"), T.invalid_reason(F.col("t")).alias("reason")).collect()
    seen = set()
    for r in rows:
        want = None if r.t is None else len(re.sub(r"[^一-鿿぀-ヿa-zA-Z0-9]", "", r.t)) / max(len(r.t), 1) < 0.15
        assert r.less is want
        letters = any(c.isalpha() for c in r.t or "")
        reason = None if r.t is None else "too_short" if len(r.t) < 4 else "digits_or_symbol_only" if not letters else "punctuation_dominant" if want else None
        assert r.reason == reason
        seen.add(reason)
    assert len(seen) == 4


def test_advertisements_are_found_beside_other_letters(spark):
    texts = ["Grüße und v信 hier", "Grüße ohne Werbung", "plain words only", "QQ群 with plain words", "没有广告词的句子", "請加微信谢谢"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.invalid_reason(F.col("t"))).collect()]
    assert got == ["advertisement", None, None, "advertisement", None, "advertisement"]
    own = T.Profile(ads=("buy now", "加群"))
    assert spark.createDataFrame([("please BUY NOW today",)], "t string").select(T.invalid_reason(F.col("t"), own)).first()[0] == "advertisement"


@pytest.mark.parametrize("name", ["source_quality_report", "drop_reasons"])
def test_no_search_stops_at_every_dropped_character(spark, sf, name):
    plan = plans(entry.queries()[name](spark, sf))
    assert T.NOT_KEPT not in plan and r"^[^\p{L}]+$" not in plan and T.KEPT in plan


# The steps


@pytest.mark.parametrize("name", ["newline", "emoji", "control", "half", "space"])
def test_steps_equal_their_plain_patterns_on_every_character(characters, name):
    t, r = F.col("t"), F.regexp_replace
    plain = {
        "newline": r(t, r"\r\n?", "\n"), "emoji": r(t, T.EMOJI, " "), "control": r(t, T.CONTROL, ""), "half": F.translate(t, T.FULL, T.HALF),
        "space": F.trim(r(t, f"[{T.SPACE}]+", " ")),
    }
    same(characters, T.step(name, t), plain[name])


def test_runs_of_mixed_white_space_and_line_ends(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choices(SPACES + "aé", [1] * len(SPACES) + [9, 3], k=rng.randint(0, 25))) for _ in range(800)] + ["", "\r\n\r\r\n", "a\r", "\x00a\x1f\x7f​", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", T.step("space", F.col("t")).alias("s"), T.step("newline", F.col("t")).alias("n")).collect():
        assert r.s == (None if r.t is None else re.sub(f"[{SPACES}]+", " ", r.t).strip(" "))
        assert r.n == (None if r.t is None else re.sub("\r\n?", "\n", r.t))


def test_clean_full_searches_for_runs_of_plain_space_only(spark, sf):
    plan = plans(entry.queries()["clean_full"](spark, sf))
    assert "&&[^ ]]" not in plan and " {2,}" in plan


# Examples (F25)


def test_dropped_examples_work_a_reason_out_once(spark, sf, tmp_path):
    assert "Filter CASE" not in plans(entry.queries()["dropped_examples"](spark, sf))
    texts = ["ab", "x", "12345 678", "", "a………………………………", "please 加微信 now", "good food", None, "c" * 70 + " 加群", "zz"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in entry.queries()["dropped_examples"](spark, str(tmp_path)).select("reason", "doc_id", "example").collect())
    assert got == [("advertisement", 5, "please 加微信 now"), ("advertisement", 8, "c" * 60), ("digits_or_symbol_only", 2, "12345 678"), ("punctuation_dominant", 4, "a………………………………"), ("too_short", 0, "ab"), ("too_short", 1, "x"), ("too_short", 3, "")]
