"""Goldens and edge rows of the reference's operators."""

import itertools
import json
import math
import random
import statistics
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from corpusforge.functions import stats as S
from corpusforge.functions import text as T
from corpusforge.operators import agreement as A
from corpusforge.operators import corpus as C
from corpusforge.operators import graph as G
from corpusforge.operators import ml as M
from corpusforge.operators import segment as Z
from corpusforge.operators import semi as J
from corpusforge.operators import series as D
from corpusforge.plans import catalogue
from corpusforge.sources import tables as R
from corpusforge.streaming import events as E


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.x for r in df.select("k", expression(F.col("v")).alias("x")).orderBy("k").collect()]


def test_clean_goldens(spark):
    cases = {
        "<p>好喝&nbsp;！</p>https://a.com @张三 #话题# [大笑] 😀 全角１２３": "好喝 ！ 话题 全角123",
        "通过大众点评消费\n酒庄很漂亮[比心]\n好": "酒庄很漂亮 好",
        "Contact a.b@c.org now!!!  see www.x.com/y": "Contact now!!! see",
        "soooooooooo good": "sooo good",
        "Ａｂｃ　１２３": "Abc 123",
        "café time": "café time",
        "人均￥88元 推荐菜：羊排 不错": "不错",
        "……！！": "……",
        None: "",
        "": "",
        " 　\t": "",
    }
    assert column(spark, list(cases), T.clean) == list(cases.values())
    once = list(cases.values())
    assert column(spark, once, T.clean) == once


def test_invalid_reasons_and_ids(spark):
    assert column(spark, ["好吃", "12345 678", "a………………………………", "please 加微信 now", "good food"], T.invalid_reason) == ["too_short", "digits_or_symbol_only", "punctuation_dominant", "advertisement", None]
    assert column(spark, ["x"], lambda c: T.stable_id(F.lit("dianping"), c, F.lit("y"), F.lit("2024-01-01"))) == ["b6579a28d869ad50"]
    assert column(spark, ["40", "30", "10", "20.4", "", None, "x"], T.star_label) == [T.POSITIVE, T.NEUTRAL, T.NEGATIVE, T.NEGATIVE, T.UNCLEAR, T.UNCLEAR, T.UNCLEAR]
    assert column(spark, ["好喝！\n2026-09出行｜游玩1-2小时｜情侣夫妻"], T.site_b_content) == ["好喝！"]


def test_clip_at_the_edges(spark):
    values = ["x" * 500, "x" * 501, "a" * 350 + "。" + "b" * 300, "a" * 200 + "。" + "b" * 400, "a" * 310 + "，" + "b" * 20 + "。" + "c" * 300, "😀" * 501]
    assert column(spark, values, T.clip) == [values[0], "x" * 500, "a" * 350 + "。", values[3][:500], "a" * 310 + "，" + "b" * 20 + "。", "😀" * 500]


def test_keep_first_and_heads(spark):
    rows = spark.createDataFrame([(3, "a", "z"), (1, "a", "y"), (2, "b", None), (4, None, "q"), (5, None, "r")], "id int, k string, v string")
    assert sorted((r.id, r.v) for r in C.keep_first(rows, ["k"], ["id"]).collect()) == [(1, "y"), (2, None), (4, "q")]
    assert C.keep_first(rows.limit(0), ["k"], ["id"]).count() == 0
    assert sorted(r.id for r in C.head_of_groups(rows, ["k"], [F.col("id")], 1).collect()) == [1, 2, 4]


def test_streak_goldens(spark):
    flags = [True, True, False, True, True, False, False, True]
    df = spark.createDataFrame(list(enumerate(flags)), "day int, f boolean")
    got = lambda **k: [r.n for r in D.streak(df, "f", "n", **k).orderBy("day").collect()]
    assert got() == [1, 2, 1, 2, 3, 1, 1, 2]
    assert got(exact=True) == [1, 2, 0, 1, 2, 0, 0, 1]
    assert got(reset=True) == [1, 2, 0, 2, 3, 0, 0, 2]


def test_agreement_goldens(spark):
    items = ["PPP", "PNP", "NNN", "PPU", "UNP", "NNP", "PPP", "UUU"]
    long = spark.createDataFrame([(i, str(k + 1), c) for i, x in enumerate(items) for k, c in enumerate(x)], "item int, rater string, label string")
    want = {("1", "2"): (0.75, 0.34375, 0.619048, 0.233285), ("1", "3"): (0.625, 0.40625, 0.368421, 0.288275), ("2", "3"): (0.5, 0.328125, 0.255814, 0.263109)}
    for r in A.cohen(A.pairs(long)).collect():
        assert all(abs(a - b) < 1e-6 for a, b in zip((r.po, r.pe, r.kappa, r.se), want[r.ra, r.rb], strict=True))
        assert abs(r.p - 2 * (1 - statistics.NormalDist().cdf(abs(r.z)))) < 1e-6
    f = A.fleiss(long).first()
    assert (round(f.p_bar, 6), round(f.p_e, 6), round(f.kappa, 6)) == (0.625, 0.378472, 0.396648)
    assert round(A.krippendorff(long).first().alpha, 6) == 0.396648
    m = A.majority(long).collect()
    assert sum(r.p_i == 1 for r in m) == 4 and sum(r.votes == 1 for r in m) == 1
    same = spark.createDataFrame([(i, r, "P") for i in range(3) for r in "ab"], "item int, rater string, label string")
    assert A.cohen(A.pairs(same)).first().kappa is None and A.krippendorff(same).first().alpha is None
    a, b = [0, 1, 2, 2, 1, 0, 2, 1], [0, 2, 2, 1, 1, 0, 0, 1]
    both = spark.createDataFrame([("x", "y", i, j) for i, j in zip(a, b, strict=True)], "ra string, rb string, a int, b int")
    assert [round(A.weighted(both, p).first().kappa, 6) for p in (1, 2)] == [0.428571, 0.414634]
    assert column(spark, [0.2, 0.21, -0.1, 1.0], S.band, "double") == ["slight", "fair", "—", "almost perfect"]


def test_profile_goldens(spark):
    texts = spark.createDataFrame([("酒庄好",), ("酒庄美",), ("好酒庄",)], "text string")
    got = {r.gram: (r.n, round(r.pmi, 6)) for r in C.pmi_vocabulary(texts, least=1, score=-99).collect()}
    assert got["酒庄"] == (3, 1.098612) and got["庄好"] == (1, 0.405465)
    counts = spark.createDataFrame([("bad", 0, 9), ("ok", 0, 3), ("good", 1, 10), ("ok", 1, 6)], "token string, label int, n int")
    assert {r.token: (r.log_odds, r.z) for r in C.log_odds(counts).collect()} == {"bad": (6.2395, 1.863), "good": (-5.2936, -1.666), "ok": (-0.5752, -0.824)}


def test_segmentation_goldens(spark):
    df = spark.createDataFrame([(1, "酒庄|的|风景|很|好".split("|"), "酒庄|的|风景|很好|。".split("|"))], "k int, a array<string>, b array<string>")
    r = Z.boundary_scores(df, "a", "b").first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1) == (3, 0, 1, 1.0, 0.75, 0.8571)
    m = Z.multiset_match(df.withColumn("b", Z.normal(F.col("b"))), "k", "a", "b").first()
    assert (m.tp, m.n_hyp - m.tp, m.n_ref - m.tp) == (3, 1, 2)
    assert df.select(Z.tags(F.col("a"))).first()[0] == [0, 2, 3, 0, 2, 3, 3]
    assert column(spark, ["门票/80/元/，/游玩/1/-/2/小时/。"], Z.delimiter_tokens)[0] == ["门票", "80", "元", "，", "游玩", "1", "-", "2", "小时", "。"]
    assert spark.createDataFrame([("abcde",)], "t string").select(Z.cut(F.col("t"), F.array(F.lit(1), F.lit(3)))).first()[0] == ["a", "bc", "de"]
    assert column(spark, ["visit http://a.b/c 酒庄 A1-b 3.5!"], Z.blocks)[0] == ["visit", "http://a.b/c", "酒庄", "A1-b", "3.5", "!"]


def regular_tokens(text):
    """By hand: runs of letters and of digits; of both together; letters in fours and runs of digits."""
    kind = lambda c: unicodedata.category(c)[0] if unicodedata.category(c)[0] in "LN" else ""
    runs = [(k, "".join(g)) for k, g in itertools.groupby(text, kind) if k]
    both = ["".join(g) for k, g in itertools.groupby(text, lambda c: bool(kind(c))) if k]
    return [t for _, t in runs], both, [p for k, t in runs for p in ([t[i : i + 4] for i in range(0, len(t), 4)] if k == "L" else [t])]


def test_segmentation_queries_read_whole_texts(spark, tmp_path):
    r = random.Random(9)
    texts = ["".join(r.choice("abcdefg12 .é酒") for _ in range(n)) for n in (0, 1, 40, 299, 301, 5000)] + ["x" * 300 + " tail99", "word " * 20_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: catalogue.queries()[name](spark, str(tmp_path)).collect()
    tokens = [regular_tokens(t) for t in texts]
    ends = [[set(itertools.accumulate(map(len, m[:-1]))) for m in three] for three in tokens]
    both = lambda i, j: sum(len(e[i] & e[j]) for e in ends)
    size = lambda i: sum(len(e[i]) for e in ends)
    s = run("seg_boundary_f1")[0]
    assert (s.tp, s.fp, s.fn) == (both(0, 2), size(2) - both(0, 2), size(0) - both(0, 2))
    same = sum((Counter(m[0]) & Counter(m[2])).total() for m in tokens)
    s = run("seg_segment_f1")[0]
    assert (s.tp, s.fp, s.fn) == (same, sum(len(m[2]) for m in tokens) - same, sum(len(m[0]) for m in tokens) - same)
    assert {(x.a, x.b, x.both, x.na, x.nb) for x in run("seg_pairwise")} == {(i + 1, j + 1, both(i, j), size(i), size(j)) for i in range(3) for j in range(i + 1, 3)}
    third = [t for m in tokens for t in m[2]]
    s = run("seg_describe")[0]
    assert (s.tokens, s.vocab, s.mean_len) == (len(third), len(set(third)), round(sum(map(len, third)) / len(third), 4))
    shared = [e[0] & e[1] & e[2] for e in ends]
    assert {x.doc_id: (x.n, x.place_sum) for x in run("seg_consensus")} == {k: (len(e), sum(e)) for k, e in enumerate(shared)}
    rate = lambda k: round(len(shared[k]) / len(set().union(*ends[k])), 4) if set().union(*ends[k]) else 1.0
    assert {x.doc_id: x.rate for x in run("seg_agree_rate")} == {k: rate(k) for k in range(len(texts))}


def test_consensus_of_two_votes(spark):
    df = spark.createDataFrame([(["ab", "c", "d"], ["a", "bc", "d"], ["a", "b", "c", "d"])], "a array<string>, b array<string>, c array<string>")
    assert [df.select(Z.consensus(df, ["a", "b", "c"], v)).first()[0] for v in (1, 2, 3)] == [[1, 2, 3], [1, 2, 3], [3]]


def test_decoders_restore_the_text(spark):
    words = {"ab": 5, "a": 2, "b": 2, "cd": 3, "c": 1, "d": 1}
    for method in ("max_match", "viterbi"):
        df = Z.segmented(spark.createDataFrame([("abcd a1 zz",), (None,), ("",)], "text string"), method, words)
        got = [r.tokens for r in df.collect()]
        assert "".join(got[0]) == "abcda1zz" and got[0][:2] == ["ab", "cd"] and got[1] == got[2] == []
    runs = spark.createDataFrame([("abab", 4), ("abc", 2), ("ab", 9), ("c", 3)], "text string, n int")
    hmm = Z.BmesHmm(list("abc")).fit(runs, 4)
    assert "".join(hmm.cut("ababc")) == "ababc" and hmm.cut("") == [] and np.allclose(hmm.move.sum(axis=1), 1)


def test_json_repair():
    assert json.loads(J.repair_text('{"a":[1,2,],}')) == {"a": [1, 2]}
    assert json.loads(J.repair_text('{"streak": 1-5}')) == {"streak": "1-5"}
    assert json.loads(J.repair_text('x ```json\n{"u": "http://a/b"}\n```')) == {"u": "http://a/b"}
    assert json.loads(J.repair_text('{"a":[{"b":1},{"b":2')) == {"a": [{"b": 1}, {"b": 2}]}
    assert json.loads(J.repair_text("{'a': 1}")) == {"a": 1}
    assert J.repair_text("hopeless") is None and J.repair_text(None) is None and J.repair_text("") is None


def test_exports_and_sources(spark, tmp_path):
    task = {"id": 7, "data": {"sample_id": "T1", "text": "x"}, "annotations": [{"completed_by": 1, "was_cancelled": False, "lead_time": 2.5, "created_at": "c", "result": [{"from_name": "sentiment", "value": {"choices": ["P"]}}, {"from_name": "reason", "value": {"text": ["why"]}}]}, {"completed_by": 2, "was_cancelled": True, "lead_time": 1.0, "created_at": "c", "result": []}]}
    (tmp_path / "t.json").write_text(json.dumps([task]))
    r = J.annotations(spark.read.schema(J.EXPORT).option("multiLine", True).json(str(tmp_path / "t.json"))).collect()
    assert len(r) == 1 and (r[0].sample_id, r[0].label, r[0].reason) == ("T1", "P", "why")
    (tmp_path / "a.csv").write_text('doc_id,text\n1,"a ""q""\nline"\n2,\n')
    assert [x.text for x in R.csv_strings(spark, str(tmp_path / "a.csv")).collect()] == ['a "q"\nline', ""]
    assert R.first_existing(spark, [str(tmp_path / "no"), str(tmp_path / "a.csv")]) == str(tmp_path / "a.csv")
    body = json.dumps({"code": 200, "total": 1, "comments": [{"commentId": 5, "time": 0, "likedCount": 2, "content": "hi", "user": {"nickname": "n"}}]})
    c = R.api_comments(spark.createDataFrame([(1, body), (2, '{"code": 500}')], "page int, body string")).collect()
    assert [(x.page, x.author, x.comment_time) for x in c] == [(1, "n", "1970-01-01 00:00:00")]
    d = R.daily_arrays(spark.createDataFrame([('{"daily": {"time": ["2024-01-01", "2024-01-02"], "t": [1.5, null]}}',)], "body string"), "body", ["t"]).collect()
    assert [x.t for x in d] == [1.5, None]
    u = R.unified(spark.createDataFrame([("x", 3)], "text string, votes int"), {"text_raw": "text", "source": F.lit("s")}).first()
    assert (u.text_raw, u.source, u.votes, u.author) == ("x", "s", "3", "")
    R.write_by_source(spark.createDataFrame([("a", 1), ("b", 2)], "source string, n int"), str(tmp_path / "by"), {"a": "first"})
    assert {p.name for p in (tmp_path / "by").iterdir() if p.is_dir()} == {"slug=first", "slug=other"}
    assert R.markdown(spark.createDataFrame([("a|b\nc", None)], "x string, y string")).splitlines()[2] == "| a/b c |  |"


def test_graph(spark):
    spo = spark.createDataFrame([("r1", "k", "1", "integer"), ("r1", "e", "x", "iri"), ("r2", "k", "2", "integer")], "s string, p string, o string, datatype string")
    assert [(r.r, r.v) for r in G.match(spo, ("?r", "e", "x"), ("?r", "k", "?v")).collect()] == [("r1", "1")]
    lines = sorted(r.value for r in G.ntriples(spo).collect())
    assert lines[0].endswith("#x> .") and '"1"^^<http://www.w3.org/2001/XMLSchema#integer>' in lines[1]
    nodes = spark.createDataFrame([("A", "n", 1, {"x": "1", "y": "1"}), ("A", "n", 2, {"x": "2"})], "label string, name string, at int, props map<string,string>")
    assert G.merge_nodes(nodes, ["label", "name"], "props", "at").first().props == {"x": "2", "y": "1"}
    ends = spark.createDataFrame([("E1", "dust"), ("E2", "wind")], "id string, name string")
    rel = spark.createDataFrame([("E1", "E2", "caused by")], "source string, target string, type string")
    assert [tuple(r) for r in G.relate(rel, ends).collect()] == [("dust", "wind", "CAUSED_BY")] and G.relate(rel, ends, "name").count() == 0
    days = spark.sql("SELECT explode(array(DATE'2024-01-01', DATE'2024-01-02', DATE'2024-01-03', DATE'2024-01-05')) AS day").withColumn("n", F.lit(2))
    assert G.next_day(days).count() == 2 and [r.hops for r in G.paths(days, "n").collect()] == [2]


def test_learners():
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 2))
    y = (x[:, 0] + x[:, 1] > 0).astype(int)
    w, b = M.logistic(x, y)
    assert ((x @ w + b > 0) == y).mean() > 0.97
    node = M.tree(x, y)
    assert np.mean([M.tree_predict(node, v) == t for v, t in zip(x, y, strict=True)]) > 0.9
    two = np.concatenate([r.normal(0, 0.1, (20, 2)), r.normal(5, 0.1, (20, 2))])
    assert M.ward(two, 2).tolist() == [0] * 20 + [1] * 20


def test_clusters(spark):
    r = random.Random(1)
    pts = [(i, [r.gauss(c, 0.1), r.gauss(c, 0.1)]) for i, c in enumerate([0] * 10 + [5] * 10)] + [(20, [50.0, 50.0])]
    got = {x.id: x.cluster for x in M.dbscan(spark.createDataFrame(pts, "id long, vec array<double>"), eps=0.6, least=4).collect()}
    assert [got[i] for i in (0, 9, 10, 19, 20)] == [0, 0, 10, 10, -1]
    assert len({x.cluster for x in M.kmeans(spark.createDataFrame(pts[:20], "id long, vec array<double>"), 2, restarts=2).collect()}) == 2


def test_stream_equals_batch(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/events.parquet")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = E.windowed_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), late="100 days")
    q = stream.writeStream.format("memory").queryName("win").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    one = {(r.start, r.event_type): (r.n, round(r.total, 6)) for r in spark.table("win").collect()}
    assert one == {(r.start, r.event_type): (r.n, round(r.total, 6)) for r in E.windowed_counts(rows).collect()} and not math.isnan(sum(v[1] for v in one.values()))


def test_near_rows_by_product_are_those_by_differences():
    """Copies, ties and distances at the edge: the matrix product decides nothing that it cannot tell."""
    import numpy as np

    from corpusforge.operators import ml as M

    r = np.random.default_rng(3)
    vec = np.round(r.normal(0, 1, (150, 8)), 1)
    vec[100:] = vec[:50] + (r.random((50, 1)) < 0.5) * 0.1 * np.eye(8)[0]
    for shift in (0, 1000.0):
        x, ids = vec + shift, r.permutation(150)
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        for k in (1, 6, 150, 200):
            for row, places, own in M.nearest_rows(x, x, ids, k, step=7):
                want = np.lexsort((ids, np.round(d[row], 9)))[:k]
                assert places.tolist() == want.tolist() and own.tolist() == np.round(d[row], 9)[want].tolist()
        for eps in (0.0, 0.1, float(d[0, 5]), 2.0):
            hits = np.concatenate([h for _, h in M.within(x, x, eps, step=7)])
            assert (hits == (d <= eps)).all()


def test_boundaries_and_matches_of_odd_rows(spark):
    """Null and empty lists, texts of several slices, keys that repeat and keys that are null."""
    from pyspark.sql import functions as F

    from corpusforge.operators import segment as Z

    rows = [(1, "ab c", ["ab", "c"], ["ab", "c"]), (2, None, None, ["x"]), (3, "", [], []), (4, "aab", ["a", "a", "b"], ["a", "b", "b"]), (4, "ab", ["b"], ["b", "a"]), (None, "q", ["q"], ["q"]), (5, "z" * 9, ["z"] * 9, ["zz"])]
    df = spark.createDataFrame(rows, "k long, x string, r array<string>, h array<string>").coalesce(1)
    got = [r[0] for r in df.select(Z.boundaries(F.col("r"))).collect()]
    assert got == [[2], None, [], [1, 2], [], [], list(range(1, 9))]
    assert [r[0] for r in df.select(Z.aligned_boundaries(F.col("x"), F.col("r"))).collect()] == [[2], None, [], [1, 2], [], [], list(range(1, 9))]
    found = sorted((tuple(r) for r in Z.multiset_match(df, "k", "r", "h").select("k", "tp", "n_ref", "n_hyp").collect()), key=str)
    assert found == sorted([(1, 2, 2, 2), (2, 0, 0, 1), (4, 4, 4, 5), (None, 0, 1, 1), (5, 0, 9, 1)], key=str)
    plan = Z.multiset_match(df, "k", "r", "h")._jdf.queryExecution().toString()
    assert "ArrowEvalPython" in plan
