"""Columns of any name, also the operators' own helper names, pass through every operator and stage unchanged."""

import corpus_pipeline
import pytest
from corpusforge.llm import bpe, counts, entries, secrets, simhash
from pyspark.sql import functions as F

HELPERS = (
    "_text _ids _row _ROW _kept _first _repeated _salt _bucket _copy _tail _h text_ row fp t key n label best first at found use value kind group path pages host "
    "spans score held_out kept mask part word cell near root hot ids_ tokens n_words state symbol row_ terms hits url page place slot copy"
).split()


def tokenizer(name):
    return entries._tokenizer(name)


@pytest.fixture(scope="module")
def docs(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    df = df.unionAll(df.limit(7))  # repeated rows
    seen = {c.lower() for c in df.columns}
    for k, name in enumerate(HELPERS):
        if name.lower() not in seen:
            df = df.withColumn(name, F.concat(F.lit(f"{k}:"), F.col("doc_id").cast("string")))
            seen.add(name.lower())
    return spark.createDataFrame(df.collect(), df.schema)


def rows(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", ["quality", "language", "near_duplicates", "secrets"])
def test_stages_pass_columns_through(name, spark, sf, docs):
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, sf)
    assert out.columns == docs.columns and out.schema == docs.schema
    columns = [c for c in docs.columns if name != "secrets" or c not in ("text", "n_chars")]
    whole = rows(docs, columns)
    got = rows(out, columns)
    assert got and all(r in whole for r in got)
    if name == "near_duplicates":
        assert len(got) == len(set(got))
    if name == "secrets":
        assert got == whole


def test_operators_keep_any_column(docs):
    keep = tuple(c for c in docs.columns if c != "text")
    path = tokenizer("byte_bpe_50k.json")
    tokens = bpe.encode(docs, path, keep=keep, out="the ids")
    want = rows(docs, keep)
    assert rows(tokens, keep) == want
    back = bpe.decode(tokens, path, ids="the ids", out="back", keep=(*keep, "the ids"))
    assert rows(back, keep) == want and rows(back, ("back",)) == rows(docs, ("text",))
    assert rows(bpe.round_trip(docs, path, keep=tuple(c for c in keep if c not in ("ids", "decoded"))), keep) == want
    assert rows(counts.count_tokens(docs, tokenizer("piece_bpe_32k.model"), keep=(*keep, "text"), out="n tokens"), (*keep, "text")) == rows(docs, (*keep, "text"))
    assert rows(secrets.scan(docs.drop("found"), None, keep=tuple(c for c in keep if c != "found")), ("_text", "doc_id")) == rows(docs, ("_text", "doc_id"))


def test_rows_that_differ_only_in_a_map_are_one(spark):
    df = spark.createDataFrame([(1, "a b c", {"x": 1}), (1, "a b c", {"x": 2}), (2, "other words here", {})], "doc_id long, text string, m map<string,int>")
    assert sorted(r.doc_id for r in simhash.keep_first(df).collect()) == [1, 2]


@pytest.mark.parametrize("query", sorted(entries.queries()))
def test_queries_ignore_extra_columns(query, spark, sf, docs, tmp_path):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    results = []
    for k, df in enumerate((plain, docs)):
        at = tmp_path / str(k)
        df.write.parquet(str(at / "documents.parquet"))
        for t in ("labels", "pages"):
            table = spark.read.parquet(f"{sf}/{t}.parquet").limit(60)
            for name in HELPERS if k else ():
                if name.lower() not in {c.lower() for c in table.columns}:
                    table = table.withColumn(name, F.lit("clash"))
            table.write.parquet(str(at / f"{t}.parquet"))
        found = entries.queries()[query](spark, str(at))
        results.append((found.columns, sorted(map(str, found.collect()))))
    if query == "op7_packing":  # which documents share a sequence depends on how files are split
        assert results[0][0] == results[1][0] and len(results[0][1]) > 0
    else:
        assert results[0] == results[1]


def test_languages_of_short_texts_are_learnt(spark):
    from corpusforge.llm import langid

    rows = [(k, "kurz da" if k % 2 else "here is a longer english text about the weather", "de" if k % 2 else "en") for k in range(200)]
    languages, network = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), steps=60)
    assert languages == ["de", "en"]
    assert langid.judged(["kurz da", "the weather is here"], languages, network)[0] == ["de", "en"]


def test_long_documents_are_learnt_from_in_every_part(spark):
    from corpusforge.llm import langid

    text = "".join(f"{k:06d} " for k in range(6000))
    [*parts] = langid.sample_of(spark.createDataFrame([(2, text, "x")], "doc_id long, text string, lang string"))
    places = [text.index(part) for part, lang in parts]
    assert len(parts) == langid.WINDOWS and all(len(part) == langid.WINDOW for part, _ in parts)
    assert [p * langid.WINDOWS // len(text) for p in places] == list(range(langid.WINDOWS))


def test_long_credentials_are_learnt_whole(spark):
    import random

    rng = random.Random(4)
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    docs = spark.createDataFrame([(k, f"some words token: {key(300)} and more words here {key(2000)}") for k in range(60)], "doc_id long, text string")
    values = {r["value"] for r in secrets.strings_of(docs).where("kind <> 'plain'").collect()}
    assert {len(v) for v in values} == {300, 2000}
    formats = secrets.train(docs)
    assert formats is not None and all(formats.secret(v) for v in values)
    prefixed = spark.createDataFrame([("a", "fit", f"key-{c}" + key(20)) for c in "0123456789" * 3] + [("b", "fit", "AKIA" + key(16).upper()) for _ in range(30)], "group string, use string, value string")
    assert secrets.beginnings(prefixed, {"a": 30, "b": 30}) == {"a": "key-", "b": "AKIA"}
