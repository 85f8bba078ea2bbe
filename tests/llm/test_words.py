"""Spelling variants, toxicity and the filter audit: against brute force, SQL and edge rows."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from corpusforge.llm import entries, filter_audit, runtime, spelling, toxicity

LONG = "lengthy wording " * 90_000  # over a million code points
EDGE = [(None, None), (1, None), (2, ""), (3, " \n"), (4, "x"), (5, "Ünder ÜNDER über"), (6, "same text"), (7, "same text"), (7, "same text"), (None, "same text"), (8, LONG)]
#: Names that the operators use for columns of their own.
CLASHES = "word n near cell hot salt digest part mask good toxic label sums first kept_n h g term stem score held_out hits _salt _text".split()


def frame(spark, rows):
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    for name in CLASHES:
        df = df.withColumn(name, df["source"])
    return df


# op11


def variants_by_hand(rows):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    n = Counter()
    for doc_id, text in rows:
        for run in spelling.RUN.findall(text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    gaps, near = defaultdict(set), defaultdict(set)
    for w in n:
        for k in range(len(w)):
            gaps[w[:k] + "\0" + w[k + 1 :]].add(w)
            if w[:k] + w[k + 1 :] in n:
                near[w].add(w[:k] + w[k + 1 :])
                near[w[:k] + w[k + 1 :]].add(w)
    for group in gaps.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n[w], len(near[w]), form[w], n.get(form[w]), root)
    return out


def as_rows(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


def test_spelling_of_the_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = as_rows(entries.op11_spelling(spark, sf))
    assert got == variants_by_hand(docs) and any(v[2] for v in got.values())


@pytest.mark.parametrize("hot_cell", [1, 3, 4000])
def test_spelling_of_crowded_cells(spark, hot_cell):
    rng = random.Random(3)
    words = {"".join(rng.choice("abà") for _ in range(rng.randint(6, 9))) for _ in range(900)} | {"aaaaaa", "aaaaaaa", "baaaaa", "aaaaab", "aaaaaab"}
    rows = [(k, f"{w} {w.upper() if w.isascii() else w} " * rng.choice([3, 4, 20, 120])) for k, w in enumerate(sorted(words))]
    want = variants_by_hand(rows)
    assert sum(v[1] for v in want.values()) > 1500 and any(want[v[2]][2] for v in want.values() if v[2])
    assert as_rows(spelling.variants(frame(spark, rows), hot_cell)) == want


def test_spelling_of_odd_rows(spark):
    assert as_rows(spelling.variants(frame(spark, EDGE))) == variants_by_hand(EDGE)
    assert as_rows(spelling.variants(frame(spark, []))) == {}


def test_automaton_is_minimal_and_numbers_words():
    words = sorted({"".join(w) for k in range(1, 5) for w in itertools.product("ab", repeat=k)})
    automaton = spelling.Automaton(words)
    assert [automaton.number(w) for w in words] == list(range(len(words))) and automaton.number("c") == automaton.number("aaaaa") == -1
    assert automaton.states == 5  # one state for each number of letters that may follow
    for w in words:
        for exact in range(len(w)):
            got = sorted(o for _, o in automaton.near(w, exact))
            same = lambda v: v[:exact] == w[:exact]
            replaced = {v for v in words if len(v) == len(w) and sum(a != b for a, b in zip(v, w)) == 1}
            longer = {v for v in words if len(v) == len(w) + 1 and any(v[:k] + v[k + 1 :] == w for k in range(len(v)))}
            # An insertion counts at the last place where it could stand.
            longer = {v for v in longer if next((k for k in range(len(w)) if v[k] != w[k]), len(w)) >= exact}
            assert got == sorted({v for v in replaced if same(v)} | longer)


# op12


def distance(a, b):
    row = list(range(len(b) + 1))
    for k, x in enumerate(a, 1):
        before, row[0] = row[0], k
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_lexicon_walk_equals_distances():
    rng = random.Random(5)
    terms = [("worthless", False), ("clown", False), ("scum", False), ("lostra", True), ("vequ", True), ("disgusting", False), ("clone", False)]
    lexicon = toxicity.Lexicon(terms)
    words = [t for t, _ in terms] + ["", "x", "lostraüber", "lstraan", "vequix"]
    for _ in range(4000):
        word = list(rng.choice(terms)[0] + rng.choice(["", "", "an", "chen"]))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "o", "1", "s"])
        words.append("".join(word))
    hits = 0
    for word in words:
        found = []
        for k, (term, stem) in enumerate(terms):
            d = min(distance(term, word[:j]) for j in range(len(word) + 1)) if stem else distance(term, word)
            if d <= toxicity.errors_of(term, stem):
                found.append((d, k))
        want = None if not found else min(found)[::-1]
        assert lexicon.walk(word) == want, word
        assert lexicon.find(word) == want, word
        hits += want is not None
    assert 500 < hits < len(words)


def planted(n=1800):
    """Documents that abuse, documents that quote the same words, and plain ones; some abuse is misspelled."""
    rng = random.Random(11)
    plain = ["".join(rng.choice("aeioustrnlmd") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    bad, rows, labels = ["grobian", "lumpenhund", "schuft"], [], []
    for k in range(n):
        words = [rng.choice(plain) for _ in range(60)]
        kind, at = k % 6, rng.randrange(5, 50)
        term = rng.choice(bad)
        if kind == 0:
            words[at:at] = [term]
        elif k % 18 == 1:
            words[at:at] = ["report", "quoted", "him", '"', term, '"', "as", "saying"]
        elif kind == 2 and k % 12 == 2:
            wrong = rng.randrange(len(term))
            words[at:at] = [term[:wrong] + rng.choice("xyzq0") + term[wrong + 1 :]]
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(kind == 0 or (kind == 2 and k % 12 == 2))))
    return rows, labels


def test_toxicity_tells_quotation_from_abuse(spark):
    rows, labels = planted()
    docs = frame(spark, rows)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'t' AS term", "'x' AS text")
    model = toxicity.train(docs, marks)
    assert {t for t, stem in model.terms if not stem} >= {"grobian", "lumpenhund", "schuft"}
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    toxic = {k: t for k, _, t in labels}
    held = [k for k in toxic if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k].held_out == (k in set(held)) and got[k].predicted == int(got[k].score >= 0.5) for k in toxic)
    assert sum(got[k].predicted == toxic[k] for k in held) >= 0.97 * len(held)
    quoted = [k for k in held if k % 18 == 1]
    assert quoted and sum(got[k].predicted for k in quoted) <= 0.1 * len(quoted)
    # Held-out labels change nothing.
    other = [(k, q, 1 - t if k in set(held) else t) for k, q, t in labels]
    again = toxicity.train(docs.repartition(3), spark.createDataFrame(other, "doc_id long, quality int, toxic int").repartition(2))
    assert again.terms == model.terms and (again.a == model.a).all() and (again.table == model.table).all() and again.none == model.none


def test_toxicity_of_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.score(frame(spark, EDGE), toxicity.train(frame(spark, EDGE), none)).collect()
    assert len(rows) == len(EDGE) and all(r.score == 0.5 and r.predicted == 1 for r in rows)
    model = toxicity.train(*(f(spark, x) for f, x in ((frame, planted()[0]), (lambda s, x: s.createDataFrame(x, "doc_id long, quality int, toxic int"), planted()[1]))))
    got = toxicity.score(frame(spark, [*EDGE, (9, LONG + " grobian " + LONG)]), model).collect()
    assert len(got) == len(EDGE) + 1 and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in got if r.predicted} == {9}
    assert toxicity.score(frame(spark, []), model).count() == 0
    assert toxicity.train(frame(spark, []), none).terms == []


def test_long_texts_are_read_whole(monkeypatch):
    finder = toxicity.Finder([("grobian", False)])
    text = " ".join(["ab", "cd", '"', "grobian", "ef", "gh", "ij", "kl"] * 40)
    whole = list(finder.hits(text))
    monkeypatch.setattr(toxicity, "LONG_TEXT", 10)
    for chunk in (9, 16, 50):
        monkeypatch.setattr(toxicity, "CHUNK", chunk)
        assert list(finder.hits(text)) == whole
    assert len(whole) == 40


def test_toxicity_query(spark, sf):
    rows = entries.op12_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert {"doc_id", "held_out", "score", "predicted"} <= set(rows[0].asDict())


# op13


def audit_by_sql(docs, labels):
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("labels", labels.toPandas())
    r = con.execute(filter_audit.SQL)
    names = [d[0] for d in r.description]
    return sorted(tuple(row[names.index(c)] for c in sorted(names)) for row in r.fetchall())


def audit_rows(df):
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def test_audit_of_the_table(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    assert audit_rows(entries.op13_filter_audit(spark, sf)) == audit_by_sql(docs, labels)


def audit_by_hand(rows, labels):
    """rows: (doc_id, text, source). Every order is applied filter by filter."""
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    fails = []
    for doc_id, text, source in rows:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        copy = doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows)
        rules = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), "D": any(c in "#$%&*|" for c in text), "E": copy}
        fails.append((source or "", doc_id in good, doc_id in toxic, {f for f, v in rules.items() if v}))
    out, shapley = [], Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {f[0] for f in fails}:
            left = [f for f in fails if f[0] == part]
            for k, letter in enumerate(order):
                gone = [f for f in left if letter in f[3]]
                left = [f for f in left if letter not in f[3]]
                mine = [f for f in fails if f[0] == part]
                failing = sum(letter in f[3] for f in mine)
                shapley[part, letter] += len(gone)
                out.append((order, part, k + 1, len(left), len(gone), failing - len(gone), sum(f[3] == {letter} for f in mine), sum(f[1] for f in gone), sum(f[2] for f in gone)))
    return {(o, p, s): (*rest, shapley[p, o[s - 1]]) for o, p, s, *rest in out}


def test_audit_of_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, t, "s") for i, t in EDGE]
    texts = ["Word " * 60, " ".join(f"w{k}" for k in range(70)), "CAPS AND $igns", "CAPS AND $igns", " ".join(f"X{k}|" for k in range(55)), None, ""]
    rows += [(rng.choice([None, *range(20, 60)]), rng.choice(texts), rng.choice([None, "", "p", "q"])) for _ in range(150)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(60), *range(30), None]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in CLASHES:
        docs = docs.withColumn(name, docs["doc_id"])
    got = filter_audit.audit(docs.repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    values = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r.filter_order, r.part, r.step): tuple(r[v] for v in values) for r in got.collect()} == audit_by_hand(rows, labels)
    types = dict(got.dtypes)
    assert types["step"] == "int" and types["part"] == types["filter_order"] == "string" and all(types[v] == "bigint" for v in values)
    assert filter_audit.audit(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_transform_inverts(spark):
    rng = random.Random(9)
    cells = [(part, m, rng.randint(0, 9), rng.randint(0, 9)) for part in "xy" for m in range(16)]
    counts = spark.createDataFrame([(p, m % 2 == 0, False, m, a, b) for p, m, a, b in cells], "part string, good boolean, toxic boolean, mask int, kept_n long, copy_n long")
    for r in filter_audit.cells(filter_audit.parities(counts)).collect():
        mine = {m: (a, b) for p, m, a, b in cells if p == r.part}
        assert r["all"] == [mine[m][0] for m in range(16)] + [mine[m][1] for m in range(16)]
        assert r["good"] == [n if m % 2 == 0 else 0 for m, n in enumerate(r["all"])] and r["toxic"] is None


def test_shared_folder_is_left_clean(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runtime, "shared_folder", lambda spark: str(tmp_path))
    rows, labels = planted(60)
    toxicity.train(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("toxicity")]
