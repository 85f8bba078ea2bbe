"""The word graph against enumeration of all its paths, and the rule tokenizer's parts."""

import hashlib
import math
import random
from collections import Counter

import __spark_entry__ as entry
import regex
from corpusforge.operators import segment as Z
from corpusforge.operators import wordgraph as W
from pyspark.sql import functions as F


def paths(text, known):
    """Every way to cut a text into words and single characters."""
    if not text:
        yield []
        return
    for n in range(1, len(text) + 1):
        if n == 1 or text[:n] in known:
            for rest in paths(text[n:], known):
                yield [text[:n], *rest]


def joined_singles(words):
    """Neighbouring single letters and digits as one token."""
    out, loose = [], ""
    for w in words:
        if len(w) == 1 and w.isascii() and w.isalnum():
            loose += w
        else:
            out += [loose] * bool(loose) + [w]
            loose = ""
    return out + [loose] * bool(loose)


def test_best_path_beats_every_other_path():
    rng = random.Random(1)
    for trial in range(150):
        letters = "abé" if trial % 2 else "酒庄风景好"
        known = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 4))): rng.randint(1, 500) for _ in range(12)}
        words = W.Dictionary.of((w, n, "n") for w, n in known.items())
        assert words.total == sum(known.values())
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))
        weight = lambda p: sum(math.log(known.get(w, 1)) - math.log(words.total) for w in p)  # noqa: B023, E731
        best = max(paths(text, known), key=lambda p: (round(weight(p), 9), [len(w) for w in p]))
        got = W.best_path(text, words)
        assert "".join(got) == text
        if max(weight(p) for p in paths(text, known) if joined_singles(p) == got) < weight(best) - 1e-9:
            raise AssertionError((text, got, best))


def test_modes_and_tags():
    words = W.Dictionary.of([("中国", 50, "ns"), ("科学", 30, "n"), ("科学院", 20, "n"), ("中国科学院", 40, "nt"), ("学院", 10, "n")])
    text = "中国科学院很大"
    assert W.best_path(text, words) == ["中国科学院", "很", "大"]
    assert W.every_word(text, words) == ["中国", "中国科学院", "科学", "科学院", "学院", "很", "大"]
    assert W.search_words(text, words) == ["中国", "科学", "学院", "科学院", "中国科学院", "很", "大"]
    assert [W.tag_of(w, words) for w in ("中国", "80", "4.5", "wine", "很")] == ["ns", "m", "m", "eng", "x"]
    assert W.best_path("", words) == W.every_word("", words) == [] and W.best_path("abc1", words) == ["abc1"]


def test_rule_tokenizer_cuts_blocks_joins_user_words_and_drops_marks():
    words = W.Dictionary.of([("风景", 30, "n"), ("酒", 900, "n"), ("庄", 900, "n")], user=["酒庄"])
    assert W.rule_tokens("酒庄的风景很好，80元！wine", words) == ["酒庄", "的", "风景", "很", "好", "80", "元", "wine"]
    assert words.get("酒庄") == (W.USER_COUNT, W.USER_TAG)
    split = W.Dictionary.of([("酒", 10**9, "n"), ("庄", 10**9, "n")])
    split.user.add("酒庄")  # a word that the path cuts is joined again
    assert W.best_path("酒庄", split) == ["酒", "庄"] and W.rule_tokens("酒庄", split) == ["酒庄"]
    assert W.rule_tokens(None, words) == W.rule_tokens("", words) == W.rule_tokens(" ，。!?", words) == []


def brute_dictionary(texts):
    runs = Counter(r for t in texts for r in regex.findall(r"\p{L}+", t.lower()))
    found = []
    for size in W.LENGTHS:
        grams = Counter()
        for r, n in runs.items():
            for k in range(len(r) - size + 1):
                grams[r[k : k + size]] += n
        found += [(w, n, "n") for w, n in sorted(grams.items(), key=lambda x: (-x[1], x[0]))[: W.MOST]]
    return found


def test_queries_over_all_documents(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(W.learnt(spark.read.parquet(f"{sf}/documents.parquet"))) == sorted(brute_dictionary(docs.values()))
    words = W.Dictionary.of(brute_dictionary(docs.values()))
    for name, mode in (("seg_rule", "path"), ("seg_search", "search"), ("seg_full", "full")):
        got = {r.doc_id: r for r in entry.queries()[name](spark, sf).collect()}
        assert got.keys() == docs.keys()
        for k in sorted(docs)[::10]:
            tokens = W.rule_tokens(docs[k].lower(), words, mode)
            assert (got[k].n_tokens, got[k].tokens_md5) == (len(tokens), hashlib.md5(" ".join(tokens).encode()).hexdigest())
            if mode == "path":
                kept = regex.sub(r"[^\p{L}\p{N}]", "", docs[k].lower())
                assert regex.sub(r"[^\p{L}\p{N}]", "", "".join(tokens)) == kept
    tags = entry.queries()["tag_counts"](spark, sf).collect()
    whole = sum(r.n_tokens for r in entry.queries()["seg_rule"](spark, sf).collect())
    assert sum(r.n for r in tags) == whole and {r.tag for r in tags} <= {"n", "m", "eng", "x"}


def test_aligned_consensus_cuts_the_text_itself(spark):
    text = "酒庄，风景 很好！"
    lists = [["酒庄", "，", "风景", "很好", "！"], ["酒庄", "风景", "很", "好"], ["酒", "庄", "风景", "很好"]]
    assert Z.ends_in(text, lists[1]) == [2, 5, 7, 8] and Z.ends_in(text, ["风景", "酒庄", "", "好"]) == [5, 8] and Z.ends_in("", ["x"]) == []
    df = spark.createDataFrame([(text, *lists), ("", [], [], []), (None, None, None, None)], "x string, a array<string>, b array<string>, c array<string>")
    places = Z.consensus(df, ["a", "b", "c"], 3, "x")
    got = df.select(places.alias("p"), Z.cut(F.col("x"), places).alias("t")).collect()
    assert got[0].p == [2, 5, 8] and got[0].t == ["酒庄", "，风景", " 很好", "！"]
    assert got[1].p == [] and got[2].p is None


def test_tokens_are_made_in_bounded_slices():
    import pyarrow as pa

    from corpusforge.operators import segment as Z

    texts = pa.array(["x" * 60, None, "", "y" * 50, "z" * 500, "a"])
    assert list(Z.slices(texts, 100)) == [(0, 3), (3, 1), (4, 1), (5, 1)]
    assert list(Z.slices(texts.slice(3), 1000)) == [(0, 3)] and list(Z.slices(texts.slice(6), 9)) == []
    memo = Z.Memo(room=20_000)
    for k in range(1000):
        memo.keep(f"run{k}", ["run", str(k)])
    assert 0 < len(memo) < 50 and memo.held <= memo.room
    assert memo.keep("l" * 10_000, ["l"] * 10_000) and "l" * 10_000 not in memo


def test_batches_leave_in_slices(spark, monkeypatch):
    """A batch of many texts leaves in several pieces, with the rows and tokens of whole batches."""
    from corpusforge.operators import segment as Z

    monkeypatch.setattr(Z, "AT_ONCE", 50)
    words = W.Dictionary.of([("ab", 5, "n"), ("abc", 3, "n"), ("bc", 2, "n")])
    texts = ["abcab 12 a-b", None, "", "ABC" * 40, "bc, bc"] * 20
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, text string").coalesce(1)
    for mode in ("path", "full", "search"):
        got = {r["id"]: r["tokens"] for r in W.segmented(df, words, mode).collect()}
        assert got == {k: W.rule_tokens(t and t.lower(), words, mode) for k, t in enumerate(texts)}
    pairs = {r["id"]: [(x["word"], x["tag"]) for x in r["tokens"]] for r in W.segmented(df, words, tagged=True).collect()}
    assert pairs == {k: [(w, W.tag_of(w, words)) for w in W.rule_tokens(t and t.lower(), words)] for k, t in enumerate(texts)}
    assert W.learnt(df, most=1) == [("bc", 860, "n"), ("abc", 820, "n"), ("abca", 800, "n")]


def test_runs_tagged_together_equal_runs_tagged_alone():
    import numpy as np

    from corpusforge.operators import tagger as N

    model = N.Tagger(list("abcdefgh"))
    model.fit([["ab", "c", "def"], ["gh", "abc"]], rounds=3)
    r = np.random.default_rng(1)
    texts = ["".join(r.choice(list("abcdefghz"), r.integers(0, 12))) for _ in range(400)] + ["abc" * 300]
    assert model.cut_all(texts, cells=40) == model.cut_all(texts) == [model.cut(t) for t in texts]


def test_grams_of_long_runs_take_one_pass(spark):
    """A run of 400,000 letters, which a substring by place would walk 400,000 times; letters beyond the first plane count as one."""
    import time

    from corpusforge.operators import corpus as C

    run = "é𠀀b" * 133_334
    start = time.time()
    rows = spark.createDataFrame([(run,), ("ab",), ("x",)], "text string")
    got = {r["gram"]: r["n"] for r in C.char_ngrams(rows, 2).collect()}
    assert got == {"é𠀀": 133_334, "𠀀b": 133_334, "bé": 133_333, "ab": 1}
    assert {w: n for w, n, _ in W.learnt(rows) if len(w) == 4} == {"é𠀀bé": 133_333, "𠀀bé𠀀": 133_333, "bé𠀀b": 133_333}
    assert time.time() - start < 60
