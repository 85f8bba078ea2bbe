"""The pipeline's stages, held against each other and against its own input."""

import corpus_pipeline
from corpusforge.llm import secrets, simhash
from pyspark.sql import functions as F


def test_stages_keep_columns_and_decisions(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "secrets", "packing"]
    seen = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        at = str(tmp_path / name)
        stage(spark, docs, sf).write.parquet(at)
        docs = spark.read.parquet(at)
        assert docs.columns == columns
        now = {r.doc_id for r in docs.collect()}
        assert now <= seen and len(now) > 0.5 * len(seen)
        if name == "near_duplicates":
            whole = {r.doc_id: r.component_id for r in simhash.near_duplicates(before).collect()}
            assert now == set(whole.values())
        if name == "secrets":
            assert now == seen
            assert all(not secrets.base_spans(r.text) and r.n_chars == len(r.text) for r in docs.collect())
        seen = now
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {p.doc_id for p in pieces} == seen


def test_run_on_whole_and_empty_tables(spark, sf, tmp_path):
    assert corpus_pipeline.run(spark, sf).count() > 0
    for t in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_and_columns_pass_through(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40).withColumn("an odd, name", F.lit("x")).withColumn("fp", F.lit(1)).withColumn("_first", F.lit("y"))
    long_ = "wordy text that goes on in one line " * 60_000  # 2 MB
    odd = docs.limit(1)
    for i, t in ((None, None), (10**9, None), (10**9 + 1, ""), (10**9 + 1, " \n"), (10**9 + 2, long_), (10**9 + 3, " " * 2_000_000), (10**9 + 4, "x" * 2_000_000)):
        docs = docs.unionByName(odd.withColumn("doc_id", F.lit(i).cast("long")).withColumn("text", F.lit(t)))
    docs = docs.withColumn("text", docs["text"]).repartition(4)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = str(tmp_path / name)
        stage(spark, docs, sf).write.parquet(at)
        docs = spark.read.parquet(at)
        assert "an odd, name" in docs.columns and "_first" in docs.columns
    assert 0 < corpus_pipeline.STAGES[-1][1](spark, docs, sf).count()
