"""Queries that SQL cannot express, held against plain Python over the whole table; sources and sinks of the further operators."""

import hashlib
import math
import re
import unicodedata
from collections import Counter

import duckdb
import numpy as np

import __spark_entry__ as entry
from corpusforge.functions import text as T
from corpusforge.operators import agreement as A
from corpusforge.operators import corpus as C
from corpusforge.operators import graph as G
from corpusforge.operators import ml as M
from corpusforge.operators import segment as Z
from corpusforge.plans import catalogue
from corpusforge.sources import tables as R


def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


SP = "[\\s\x0b\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def clean_by_hand(t):
    """Every step with the pattern module of Python, without guards."""
    import regex

    rx = lambda p: regex.compile(re.sub(r"\\x\{([0-9a-fA-F]+)\}", lambda m: regex.escape(chr(int(m[1], 16))), p).replace(r"\x0b", "\x0b"))
    t = re.sub("\r\n?", "\n", t or "")
    for p, to in ((T.HTML_TAG, " "), (T.ENTITY, " "), (T.URL, " "), (T.EMAIL, " "), (T.MENTION, " "), (T.TOPIC, r"\1"), (T.BRACKET, " "), (T.EMOJI, " "), (T.META, " "), (T.CONTROL, "")):
        t = rx(p).sub(to, t)
    t = unicodedata.normalize("NFC", t).translate(str.maketrans(T.FULL, T.HALF))
    t = re.sub(f"{SP}+", " ", t).strip(" ")
    t = re.sub(r"(?s)([^\n])\1{6,}", r"\1\1\1", t)
    return t.strip(T.STRIP)


def test_clean_full_on_the_table_and_odd_texts(spark, sf):
    docs = texts(spark, sf)
    got = {r.doc_id: r for r in catalogue.queries()["clean_full"](spark, sf).collect()}
    assert got.keys() == docs.keys()
    for k, t in docs.items():
        want = clean_by_hand(t)
        assert (got[k].clean_md5, got[k].n) == (md5(want), len(want))
    odd = [None, "", "  a\u3000\u3000b \t\n c\x85d ", "ＡＢ１　x", "e\u0301 caf\u00e9", "aaaaaaaaaa b", "<b>x</b>&nbsp;y", "☀ z", "a\u200bb", " \u00a0", "one  two   three "]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    assert [r.text_clean for r in C.cleaned(df).orderBy("doc_id").collect()] == [clean_by_hand(t) for t in odd]


def test_unigram_segmenters_on_the_table(spark, sf):
    vocabulary = catalogue._vocabulary(spark, sf)
    total, words = sum(vocabulary.values()), set(vocabulary)
    logp, unknown = {w: math.log((n + 0.1) / (total + 0.1)) for w, n in vocabulary.items()}, math.log(0.1 / (total + 0.1))
    ways = {"seg_maxmatch": lambda p: Z.max_match(p, words, 2), "seg_viterbi": lambda p: Z.viterbi(p, logp, unknown, 2)}
    docs = texts(spark, sf)
    for name, way in ways.items():
        got = {r.doc_id: r for r in catalogue.queries()[name](spark, sf).collect()}
        for k, t in docs.items():
            want = [x for p in re.findall(r"[^\W\d_]+|\d+|[^\w\s]|_", t.lower()) for x in (way(p) if p[0].isalpha() else [p])]
            assert (got[k].n_tokens, got[k].tokens_md5) == (len(want), md5(" ".join(want)))


def test_viterbi_is_the_best_of_all_paths():
    logp = {"a": -1.0, "b": -1.5, "ab": -1.9, "ba": -2.0, "aba": -3.4}

    def every(t):
        return [[]] if not t else [[t[:n], *rest] for n in range(1, min(3, len(t)) + 1) if n == 1 or t[:n] in logp for rest in every(t[n:])]

    for t in ("ab", "abab", "aabba", "bca"):
        score = lambda path: sum(logp.get(w, -5.0) for w in path)
        assert abs(score(Z.viterbi(t, logp, -5.0)) - max(map(score, every(t)))) < 1e-9


def test_hmm_and_calibration(spark, sf):
    q, docs = entry.queries(), texts(spark, sf)
    assert {r.doc_id for r in q["seg_hmm"](spark, sf).collect()} == docs.keys()
    df = spark.createDataFrame([(1, "abab cd abab"), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.tokens for r in Z.hmm_segmented(df).collect()}
    assert "".join(got[1]) == "ababcdabab" and got[2] == got[3] == []
    dev = spark.createDataFrame([("abab ab",), ("ba ab",)], "text string")
    vocabulary = {"a": 5, "b": 5, "ab": 9, "ba": 1}
    ref = catalogue.F.regexp_extract_all("text", catalogue.F.lit("ab|ba|[a-z]"), catalogue.F.lit(0))
    best = Z.calibrated(dev, vocabulary, ref, smooths=(0.1, 1.0), penalties=(0.0, 2.0)).collect()
    assert len(best) == 1 and best[0].f1 == 1.0
    assert q["seg_calibrate"](spark, sf).count() == 1


def test_tags_merge_and_vocabularies(spark):
    assert Z.untagged("abcde", [0, 1, 2, 3, 0]) == ["abc", "d", "e"] and Z.untagged("", []) == []
    assert Z.merged(["贺", "兰", "山", "x", "酒", "庄"], {"贺兰山", "贺兰", "酒庄"}) == ["贺兰山", "x", "酒庄"]
    df = spark.createDataFrame([(["ab", "ab", "c", "abcde", "xy"],)], "t array<string>")
    assert [tuple(r) for r in Z.pseudo_vocabulary(df, "t").collect()] == [("ab", 2)]


def test_small_models_equal_plain_loops(spark, sf):
    q = entry.queries()
    rows = q["logistic_gd"](spark, sf).collect()
    from corpusforge.plans import further as X

    series = sorted(M.standardize(X._series(spark, sf), X._FEATURES).select("day", *X._FEATURES, "target").collect())
    x, y = np.array([list(r)[1:-1] for r in series]), np.array([r.target for r in series], float)
    w, b = [0.0] * 5, 0.0
    for _ in range(1000):
        d = 1 / (1 + np.exp(-np.clip(x @ np.array(w) + b, -250, 250))) - y
        w = [w[k] - 0.01 * sum(d * x[:, k]) / len(y) for k in range(5)]
        b -= 0.01 * sum(d) / len(y)
    p = 1 / (1 + np.exp(-(x @ np.array(w) + b)))
    got = {r.day: r for r in rows}
    assert all(abs(got[r.day].p - p[k]) < 1e-5 and got[r.day].predicted == (got[r.day].p >= 0.5) for k, r in enumerate(series))
    raw = sorted(X._series(spark, sf).select("day", *X._FEATURES, "target").collect())
    tree = M.tree(np.array([list(r)[1:-1] for r in raw]), np.array([r.target for r in raw]))
    got = {r.day: r.predicted for r in q["tree_predict"](spark, sf).collect()}
    assert all(got[r.day] == M.tree_predict(tree, list(r)[1:-1]) for r in raw)
    assert np.mean([got[r.day] == r.target for r in raw]) > 0.8


def ward_by_hand(x, k):
    groups = [[i] for i in range(len(x))]
    cost = lambda g: float(((x[g] - x[g].mean(axis=0)) ** 2).sum())
    while len(groups) > k:
        _, i, j = min((cost(a + b) - cost(a) - cost(b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        groups[i] = groups[i] + groups.pop(j)
    return {frozenset(g) for g in groups}


def test_ward_and_choices_of_k(spark, sf):
    x = np.random.default_rng(3).normal(size=(14, 3))
    labels = M.ward(x, 4)
    assert {frozenset(np.flatnonzero(labels == k).tolist()) for k in range(4)} == ward_by_hand(x, 4)
    q = entry.queries()
    assert {r.cluster for r in q["ward_labels"](spark, sf).collect()} == {0, 1, 2, 3}
    points = spark.createDataFrame([(k, [float(k % 3) * 50 + 0.1 * (k // 3), 0.0]) for k in range(30)], "id long, vec array<double>")
    best = M.best_k(points, range(2, 6)).collect()[0]
    assert best.k == 3 and best.silhouette > 0.99
    assert {r.method for r in q["method_comparison"](spark, sf).collect()} == {"label", "kmeans"}
    assert sum(r.n for r in q["kmeans_sizes"](spark, sf).collect()) == spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert 2 <= q["kmeans_best_k"](spark, sf).collect()[0].k <= 10


def test_blocks_give_the_same_for_any_size(spark, monkeypatch):
    r = np.random.default_rng(5)
    df = spark.createDataFrame([(k, v.tolist(), int(k % 3)) for k, v in enumerate(r.normal(size=(60, 2)))], "id long, vec array<double>, label int")
    train, test = df.where("id % 4 <> 0"), df.where("id % 4 = 0")
    want = sorted(M.knn(train, test, block=10_000).collect())
    assert sorted(M.knn(train, test, block=7).collect()) == want
    whole = M.silhouette(df.withColumnRenamed("label", "cluster")).collect()
    labels = sorted(M.dbscan(df.select("id", "vec"), eps=0.4, least=4).collect())
    monkeypatch.setattr(M.in_blocks, "__defaults__", (9,))
    assert M.silhouette(df.withColumnRenamed("label", "cluster")).collect() == whole
    assert sorted(M.dbscan(df.select("id", "vec"), eps=0.4, least=4).collect()) == labels


def test_numbers_without_a_single_task(spark):
    df = spark.range(500).selectExpr("id", "(id * 7919) % 1000 as x").repartition(5)
    got = sorted((r.n, r.x) for r in M.numbered(df, df["x"], df["id"]).collect())
    assert [n for n, _ in got] == list(range(500)) and [x for _, x in got] == sorted(x for _, x in got)
    assert M.numbered(df.limit(0), df["x"]).count() == 0


def test_simulated_rater_keeps_most_labels(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "cast(id % 4 as int) as label")
    rows = M.simulated(df, "doc_id", "label", 4, 0.8, 1).collect()
    same = np.mean([r.label == r.doc_id % 4 for r in rows])
    assert 0.77 < same < 0.83 and {r.label for r in rows} == {0, 1, 2, 3}
    away = Counter((r.label - r.doc_id) % 4 for r in rows if r.label != r.doc_id % 4)
    assert all(0.27 < away[k] / sum(away.values()) < 0.4 for k in (1, 2, 3))


def test_graph_tables_replace_and_read_back(spark, sf, tmp_path):
    d = catalogue.daily(spark, sf)
    for _ in range(2):  # the second load replaces the first
        G.load(G.nodes(d), G.edges(d), str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/nodes").count() == G.nodes(d).count()
    assert spark.read.parquet(f"{tmp_path}/edges").count() == G.edges(d).count()


def test_jsonl_counts_and_typed_csv(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": "x", "t": ["a", "b"]}\nnot json\n\n{"k": "y", "t": []}\n', encoding="utf-8")
    rows = R.jsonl(spark, str(tmp_path / "a.jsonl"), "k string, t array<string>")
    assert rows.count() == 2 and sorted(r.k for r in rows.collect()) == ["x", "y"] and rows.selectExpr("1").count() == 2
    (tmp_path / "a.csv").write_text("day,x\n2024-01-02,1.5\n", encoding="utf-8")
    assert str(R.csv_typed(spark, str(tmp_path / "a.csv"), "day date, x double").collect()[0].day) == "2024-01-02"
    df = spark.createDataFrame([("t1", "1"), ("t2", "0")], "review string, label string")
    assert [r.text_raw for r in R.labelled(df, "s", "review").orderBy("text_raw").collect()] == ["t1", "t2"]


def test_rates_lookups_and_filters_on_nulls(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 1), (3, "　 ", 0), (4, "text", 3)], "id long, text string, a int")
    assert [r.id for r in df.where(T.missing(df["text"])).collect()] == [1, 2, 3]
    assert [r.id for r in df.where(C.all_in(["a"], [0, 3])).collect()] == [1, 3, 4]
    assert C.numeric(df) == ["id", "a"] and {r["name"]: r.missing for r in C.overview(df).collect()} == {"id": 0, "text": 1, "a": 0}
    assert A.judged(spark.createDataFrame([("m", 3, 4.0), ("m", 2, None)], "model string, tokens long, score double")).collect()[0].mean_score == 2.0
    star = spark.createDataFrame([("39.9",), ("40.2",), ("30.7",), ("",), (None,), ("x",)], "s string")
    assert [r.l for r in star.select(T.star_label_truncated(star["s"]).alias("l")).collect()] == ["无法判断", "正面", "中性", "", "", "无法判断"]


def test_neural_segmenter(spark, sf):
    from corpusforge.operators import tagger as N

    assert N.tags_of(["ab", "c", "def"]) == [0, 2, 3, 0, 1, 2]
    model = N.Tagger(list("abcdef"), size=4, hidden=3)
    ids, tags = model.encode("abcdefz"), np.array([0, 1, 2, 3, 0, 2, 3])
    _, grads = model.gradients(ids, tags)
    r = np.random.default_rng(1)
    for k, p in model.p.items():
        at = tuple(int(r.integers(n)) for n in p.shape)
        old = p[at]
        p[at] = old + 1e-5
        up = model.gradients(ids, tags)[0]
        p[at] = old - 1e-5
        down = model.gradients(ids, tags)[0]
        p[at] = old
        assert abs((up - down) / 2e-5 - grads[k][at]) < 1e-7
    samples = [["ab", "c"], ["c", "ab", "def"], ["def", "ab"], ["c", "c", "def"]] * 8
    model = N.Tagger(list("abcdef"))
    losses = model.fit(samples, rounds=8)
    assert losses[-1] < 0.2 * losses[0] and model.cut("abcdefab") == ["ab", "c", "def", "ab"] and model.cut("") == []
    df = spark.createDataFrame([(1, "abc 12 defab!"), (2, None), (3, "")], "doc_id long, text string")
    assert {x.doc_id: x.tokens for x in N.tagged(df, model).collect()} == {1: ["ab", "c", "12", "def", "ab", "!"], 2: [], 3: []}
    # Over the whole table, the tokens are the texts' own characters.
    docs = texts(spark, sf)
    got = {x.doc_id: x.n_tokens for x in entry.queries()["seg_neural"](spark, sf).collect()}
    assert got.keys() == docs.keys() and all(got[k] <= len(t) for k, t in docs.items())


def test_more_sources_and_sinks(spark, sf, tmp_path):
    df = spark.createDataFrame([("a,b", 1), ('q"x', None)], "t string, n int").coalesce(1)
    R.write_report(df, str(tmp_path / "report"))
    data = b"".join(sorted(f.read_bytes() for f in (tmp_path / "report").glob("part-*")))
    assert data.decode("utf-8") == '\ufefft,n\n"a,b",1\n"q""x",\n'
    assert R.without_index(spark.createDataFrame([(0, 1)], "`Unnamed: 0` int, x int")).columns == ["x"]
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "a.json").write_text('{"model": "m", "input_tokens": 3, "parsed": {"entities": [{"id": "e1", "type": "T", "name": "N", "properties": {"p": "1"}}], "rules": ["r"]}}', encoding="utf-8")
    (tmp_path / "k" / "b.json").write_text('{"model": "n", "parsed": null}', encoding="utf-8")
    got = R.knowledge(spark, str(tmp_path / "k")).collect()
    assert [(r.model, r.parsed.entities[0].properties["p"], r.parsed.rules) for r in got] == [("m", "1", ["r"])]
    (tmp_path / "j.jsonl").write_text('{"case": "1", "ideal": ["a"], "scores": {"x": 7.5, "y": 3}}\n', encoding="utf-8")
    assert sorted((r.method, r.score) for r in R.judged_answers(spark, str(tmp_path / "j.jsonl")).collect()) == [("x", 7.5), ("y", 3.0)]
    arrays = {"w": np.arange(6.0).reshape(2, 3), "b": np.array([1.5])}
    R.save_arrays(spark, arrays, str(tmp_path / "m"))
    assert all(np.array_equal(v, arrays[k]) for k, v in R.load_arrays(spark, str(tmp_path / "m")).items())
    one = spark.createDataFrame([("Record_1", "t_max", "1<2", "float"), ("Record_1", "hasEvent", "x", "iri")], "s string, p string, o string, datatype string")
    import xml.etree.ElementTree as ET

    root = ET.fromstring("".join(r.value for r in G.rdf_xml(one).collect()))
    assert len(root) == 1 and sorted((x.text or "") for x in root[0]) == ["", "1<2"]
    han = spark.createDataFrame([("這是",), ("abc",)], "t string")
    assert [r[0] for r in han.select(T.simplified(han["t"], {"這": "这", "a": "z"})).collect()] == ["这是", "abc"]
    assert re.fullmatch(r"\d{4}-\d\d-\d\d \d\d:\d\d", spark.range(1).select(T.now_text()).first()[0])
    assert Z.all_words("贺兰山酒", {"贺兰", "贺兰山", "兰山"}) == ["贺兰", "贺兰山", "兰山", "酒"]


def test_lineage_of_a_folder_of_parts(spark, tmp_path):
    spark.range(20).withColumnRenamed("id", "doc_id").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    rows = catalogue.queries()["lineage"](spark, str(tmp_path)).collect()
    assert len(rows) == 20 and {r["src_file"] for r in rows} == {"documents.parquet"}


def test_task_ids_of_more_than_four_digits_equal_the_sql(spark, tmp_path):
    spark.range(10_050).withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted(tuple(r) for r in catalogue.queries()["task_ids"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW labels AS SELECT * FROM '{tmp_path}/labels.parquet/*.parquet'")
    assert got == sorted(con.execute(catalogue.oracle_sql()["task_ids"]).fetchall())
