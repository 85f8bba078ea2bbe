"""All queries of the inventory with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions import text as T
from ..operators import agreement as A
from ..operators import corpus as C
from ..operators import graph as G
from ..operators import ml as M
from ..operators import segment as Z
from ..operators import semi as J
from ..operators import series as D
from ..session import ship
from ..sources import tables as R
from ..streaming import events as E

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Cleaning. The SQL's classes are those of the expressions, spelt for RE2.

_SP = r"\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LATIN = ("nfc", "squash", "metadata")


def _rx(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to}', 'g')"


def _steps_sql(column: str = "text") -> list[tuple[str, str]]:
    """Each step over t, in order."""
    clean = [
        ("newline", _rx("t", r"\r\n?", "\n")),
        ("markup", _rx(_rx("t", T.HTML_TAG, " "), T.ENTITY, " ")),
        ("links", _rx(_rx(_rx("t", T.URL, " "), T.EMAIL, " "), T.MENTION, " ")),
        ("topic", _rx("t", T.TOPIC, r"\1")),
        ("bracket", _rx("t", T.BRACKET, " ")),
        ("emoji", _rx("t", T.EMOJI, " ")),
        ("control", _rx("t", T.CONTROL, "")),
        ("half", f"translate(t, '{T.FULL}', '{T.HALF}')"),
        ("space", _rx(_rx("t", f"[{_SP}]+", " "), f"^[{_SP}]+|[{_SP}]+$", "")),
        ("strip", f"trim(t, '{T.STRIP}')"),
    ]
    return clean


def _clean_sql(columns: str, source: str = "documents") -> str:
    """A common table c: the columns and t, the cleaned text."""
    out = f"c0 AS (SELECT {columns}, coalesce(text, '') AS t FROM {source})"
    for k, (_, x) in enumerate(_steps_sql()):
        out += f", c{k + 1} AS (SELECT * REPLACE ({x} AS t) FROM c{k})"
    return out + f", c AS (SELECT * FROM c{len(_steps_sql())})"


_KEY = _rx("t", T.NOT_KEPT, "")
_REASON = (
    "CASE WHEN length(t) < 4 THEN 'too_short' WHEN regexp_matches(t, '^[^\\p{L}]+$') THEN 'digits_or_symbol_only' "
    f"WHEN length({_KEY}) / greatest(length(t), 1)::DOUBLE < 0.15 THEN 'punctuation_dominant' "
    "WHEN " + " OR ".join(f"contains(lower(t), '{w.lower()}')" for w in T.AD_WORDS) + " THEN 'advertisement' END"
)


def _clip_sql(x: str = "t") -> str:
    cases = " ".join(f"WHEN instr(reverse(left({x}, 500)), '{m}') > 0 AND 500 - instr(reverse(left({x}, 500)), '{m}') >= 300 THEN left({x}, 501 - instr(reverse(left({x}, 500)), '{m}'))" for m in "。！？，； ")
    return f"CASE WHEN length({x}) <= 500 THEN {x} {cases} ELSE left({x}, 500) END"


_UNIQUE = (
    _clean_sql("doc_id, lang, source") + f", v AS (SELECT doc_id, lang, source, {_clip_sql()} AS t FROM c WHERE ({_REASON}) IS NULL)"
    ", e AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, t ORDER BY doc_id) = 1)"
    f", u AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY lang, lower({_KEY}) ORDER BY doc_id) = 1)"
)


@query(f"WITH {_clean_sql('doc_id')} SELECT doc_id, md5(t) AS clean_md5, length(t)::BIGINT AS n FROM c")
def clean_documents(spark, sf):
    rows = C.cleaned(table(spark, sf, "documents"), without=LATIN)
    return rows.select("doc_id", F.md5(F.encode("text_clean", "UTF-8")).alias("clean_md5"), F.length("text_clean").cast("long").alias("n"))


@query()
def clean_full(spark, sf):
    rows = C.cleaned(table(spark, sf, "documents"))
    return rows.select("doc_id", F.md5(F.encode("text_clean", "UTF-8")).alias("clean_md5"), F.length("text_clean").cast("long").alias("n"))


_COUNTS = "WITH " + _clean_sql("doc_id").rsplit(", c AS", 1)[0] + " SELECT " + ", ".join(f"(SELECT count(*) FROM c{k} a JOIN c{k + 1} b USING (doc_id) WHERE a.t <> b.t)::BIGINT AS n_{name}" for k, (name, _) in enumerate(_steps_sql()))


@query(_COUNTS)
def clean_step_counts(spark, sf):
    return C.step_counts(table(spark, sf, "documents"))


@query(f"WITH {_clean_sql('doc_id, lang')} SELECT lang, coalesce({_REASON}, 'valid') AS reason, count(*)::BIGINT AS n FROM c GROUP BY ALL")
def invalid_reasons(spark, sf):
    rows = C.cleaned(table(spark, sf, "documents"), without=LATIN)
    return rows.groupBy("lang", F.coalesce(T.invalid_reason(F.col("text_clean")), F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {_clean_sql('doc_id')} SELECT doc_id, length({_clip_sql()})::BIGINT AS n, md5({_clip_sql()}) AS clip_md5 FROM c")
def clip_text(spark, sf):
    cut = T.clip(F.col("text_clean"))
    return C.cleaned(table(spark, sf, "documents"), without=LATIN).select("doc_id", F.length(cut).cast("long").alias("n"), F.md5(F.encode(cut, "UTF-8")).alias("clip_md5"))


@query("SELECT doc_id, source, text AS text FROM (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY source, text ORDER BY doc_id) = 1)")
def dedup_exact(spark, sf):
    return C.keep_first(table(spark, sf, "documents").select("doc_id", "source", "text"), ["source", "text"], ["doc_id"])


@query(f"WITH c AS (SELECT doc_id, source, text AS t FROM documents) SELECT doc_id, source FROM c QUALIFY row_number() OVER (PARTITION BY source, lower({_KEY}) ORDER BY doc_id) = 1")
def dedup_near(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source", T.dedup_key(F.col("text")).alias("k"))
    return C.keep_first(rows, ["source", "k"], ["doc_id"]).select("doc_id", "source")


@query("SELECT min(doc_id) AS doc_id, count(*)::BIGINT AS copies FROM documents GROUP BY text")
def dedup_global(spark, sf):
    return table(spark, sf, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("text")


@query("SELECT doc_id, substring(md5(concat_ws(chr(1), source, doc_id::VARCHAR, lang)), 1, 16) AS stable_id FROM documents")
def doc_id_md5(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.stable_id(F.col("source"), F.col("doc_id"), F.col("lang")).alias("stable_id"))


@query(
    f"WITH {_UNIQUE}, s AS (SELECT lang, count(*) AS s0 FROM documents GROUP BY lang) "
    "SELECT s.lang, s0::BIGINT AS n_in, count(u.doc_id)::BIGINT AS n_out, round(100 * count(u.doc_id) / greatest(s0, 1), 2) AS kept_pct, round(avg(length(t)), 4) AS mean_chars, sum(u.doc_id)::BIGINT AS id_sum, min(md5(t)) AS min_md5 "
    "FROM s LEFT JOIN u ON s.lang = u.lang GROUP BY s.lang, s0"
)
def source_quality_report(spark, sf):
    docs = table(spark, sf, "documents")
    kept = C.valid_unique_keys(docs, "lang", "doc_id", without=LATIN).groupBy("lang").agg(F.count("*").alias("n_out"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.sum("doc_id").alias("id_sum"), F.min("text_md5").alias("min_md5"))
    return docs.groupBy("lang").agg(F.count("*").alias("n_in")).join(kept, "lang", "left").select("lang", "n_in", F.coalesce("n_out", F.lit(0).cast("long")).alias("n_out"), F.round(100 * F.coalesce("n_out", F.lit(0)) / F.greatest("n_in", F.lit(1)), 2).alias("kept_pct"), "mean_chars", "id_sum", "min_md5")


@query(f"WITH {_UNIQUE} SELECT lang, reason, count(*)::BIGINT AS n FROM (SELECT c.lang, CASE WHEN u.doc_id IS NOT NULL THEN 'kept' WHEN e.doc_id IS NOT NULL THEN 'near_duplicate' WHEN v.doc_id IS NOT NULL THEN 'duplicate' ELSE 'invalid' END AS reason FROM c LEFT JOIN v USING (doc_id) LEFT JOIN e USING (doc_id) LEFT JOIN u USING (doc_id)) GROUP BY ALL")
def drop_reasons(spark, sf):
    rows = C.cleaned(table(spark, sf, "documents"), without=LATIN)
    rows = rows.withColumn("ok", T.invalid_reason(F.col("text_clean")).isNull()).withColumn("t", T.clip(F.col("text_clean")))
    rows = rows.select("doc_id", "lang", "ok", F.xxhash64("t").alias("h"), F.xxhash64(T.dedup_key(F.col("t"))).alias("k"))
    first = F.when(F.col("ok"), F.row_number().over(Window.partitionBy("lang", "ok", "h").orderBy("doc_id")) == 1).otherwise(False)
    rows = rows.withColumn("first", first)
    near = F.when(F.col("first"), F.row_number().over(Window.partitionBy("lang", "first", "k").orderBy("doc_id")) == 1).otherwise(False)
    reason = F.when(~F.col("ok"), "invalid").when(~F.col("first"), "duplicate").when(~near, "near_duplicate").otherwise("kept")
    return rows.select("lang", reason.alias("reason")).groupBy("lang", "reason").agg(F.count("*").alias("n"))


# Corpus profiles

_DESC = "count({0})::BIGINT AS n, round(avg({0}), 4) AS mean, round(stddev_samp({0}), 4) AS std, min({0})::BIGINT AS min, round(quantile_cont({0}, 0.25), 4) AS q1, round(quantile_cont({0}, 0.5), 4) AS q2, round(quantile_cont({0}, 0.75), 4) AS q3, max({0})::BIGINT AS max"


def _describe(c: str):
    q = lambda p: F.round(F.expr(f"percentile({c}, {p})"), 4)
    return [F.count(c).alias("n"), F.round(F.avg(c), 4).alias("mean"), F.round(F.stddev_samp(c), 4).alias("std"), F.min(c).cast("long").alias("min"), q(0.25).alias("q1"), q(0.5).alias("q2"), q(0.75).alias("q3"), F.max(c).cast("long").alias("max")]


@query(f"SELECT {_DESC.format('length(text)')} FROM documents")
def length_stats(spark, sf):
    return table(spark, sf, "documents").select(F.length("text").alias("x")).agg(*_describe("x"))


@query(f"SELECT lang, {_DESC.format('length(text)')} FROM documents GROUP BY lang")
def length_by_lang(spark, sf):
    return table(spark, sf, "documents").select("lang", F.length("text").alias("x")).groupBy("lang").agg(*_describe("x"))


@query("SELECT least(floor(least(length(text), 10000) / 200), 49)::BIGINT AS bin, count(*)::BIGINT AS n FROM documents GROUP BY ALL")
def length_hist(spark, sf):
    return table(spark, sf, "documents").groupBy(F.least(F.floor(F.least(F.length("text"), F.lit(10000)) / 200), F.lit(49)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT quality::BIGINT AS quality, round(quantile_cont(length(text), 0.25), 4) AS q1, round(quantile_cont(length(text), 0.5), 4) AS q2, round(quantile_cont(length(text), 0.75), 4) AS q3 FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def length_box(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.length("text").alias("x")).join(table(spark, sf, "labels"), "doc_id")
    return rows.groupBy(F.col("quality").cast("long").alias("quality")).agg(*[F.round(F.expr(f"percentile(x, {p})"), 4).alias(n) for p, n in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))])


_TOK = "tok AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS token FROM documents)"


def _words(spark, sf):
    return C.words(table(spark, sf, "documents").select("doc_id", "lang", "text")).drop("text")


@query(f"WITH {_TOK} SELECT token, count(*)::BIGINT AS n FROM tok GROUP BY token ORDER BY n DESC, token LIMIT 50")
def top_tokens(spark, sf):
    return C.top_tokens(_words(spark, sf), 50)


@query(f"WITH {_TOK}, k AS (SELECT quality::BIGINT AS quality, token, count(*)::BIGINT AS n FROM tok JOIN labels USING (doc_id) GROUP BY ALL) SELECT quality, token, n FROM k QUALIFY row_number() OVER (PARTITION BY quality ORDER BY n DESC, token) <= 15")
def class_top_tokens(spark, sf):
    rows = _labelled_counts(spark, sf).select(F.col("label").cast("long").alias("quality"), "token", "n")
    return C.head_of_groups(rows, ["quality"], [F.desc("n"), F.asc("token")], 15).select("quality", "token", "n")


@query(f"WITH {_TOK}, k AS (SELECT token, count(*)::BIGINT AS n FROM tok GROUP BY token ORDER BY n DESC, token LIMIT 1000) SELECT row_number() OVER (ORDER BY n DESC, token)::BIGINT AS rank, token, n FROM k")
def zipf_rank(spark, sf):
    top = C.top_tokens(_words(spark, sf), 1000)
    return top.select(F.row_number().over(Window.orderBy(F.desc("n"), "token")).cast("long").alias("rank"), "token", "n")


@query(f"WITH {_TOK}, k AS (SELECT token, count(*) AS n FROM tok GROUP BY token) SELECT count(*)::BIGINT AS vocab, sum((n = 1)::INT)::BIGINT AS hapax, round(sum((n = 1)::INT) / count(*)::DOUBLE, 6) AS ratio FROM k")
def hapax_ratio(spark, sf):
    k = _words(spark, sf).groupBy("token").agg(F.count("*").alias("n"))
    once = F.sum((F.col("n") == 1).cast("long"))
    return k.agg(F.count("*").alias("vocab"), once.alias("hapax"), F.round(once / F.count("*"), 6).alias("ratio"))


@query(f"WITH {_TOK} SELECT lang, count(DISTINCT token)::BIGINT AS vocab FROM tok GROUP BY lang")
def vocab_size(spark, sf):
    return _words(spark, sf).select("lang", "token").distinct().groupBy("lang").agg(F.count("*").alias("vocab"))


_LABELLED = f"{_TOK}, k AS (SELECT token, quality AS label, count(*) AS n FROM tok JOIN labels USING (doc_id) GROUP BY ALL)"


def _labelled_counts(spark, sf):
    """Labels meet their documents before words are made of them, so that only counts are shuffled."""
    docs = table(spark, sf, "documents").select("doc_id", "text").join(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    return C.words(docs.select("label", "text")).groupBy("token", "label").agg(F.count("*").alias("n"))


@query(
    f"WITH {_LABELLED}, two AS (SELECT token, sum(CASE WHEN label = 0 THEN n ELSE 0 END) AS y0, sum(CASE WHEN label = 1 THEN n ELSE 0 END) AS y1 FROM k GROUP BY token), "
    "s AS (SELECT sum(y0) AS n0, sum(y1) AS n1, sum(y0) + sum(y1) AS n, 0.01::DOUBLE * (sum(y0) + sum(y1)) AS a0 FROM two), "
    "p AS (SELECT token, y0, y1, a0 * (y0 + y1) / n AS w, n0, n1, a0 FROM two, s WHERE y0 + y1 >= 8), "
    "d AS (SELECT *, (y0 + w) / (n0 + a0) AS p0, (y1 + w) / (n1 + a0) AS p1 FROM p) "
    "SELECT token, y0::BIGINT AS y0, y1::BIGINT AS y1, round(ln(p0 / (1 - p0)) - ln(p1 / (1 - p1)), 4) AS log_odds, round((ln(p0 / (1 - p0)) - ln(p1 / (1 - p1))) / sqrt(1 / (y0 + w) + 1 / (y1 + w)), 3) AS z FROM d"
)
def log_odds(spark, sf):
    return C.log_odds(_labelled_counts(spark, sf))


@query(
    f"WITH {_LABELLED}, kept AS (SELECT * FROM k WHERE length(token) >= 2), top AS (SELECT token, sum(n) AS total, count(*) AS df FROM kept GROUP BY token ORDER BY total DESC, token LIMIT 4000), "
    "w AS (SELECT label, token, n * (ln((1 + (SELECT count(DISTINCT label) FROM kept)) / (1 + df)::DOUBLE) + 1) AS w FROM kept JOIN top USING (token)), "
    "x AS (SELECT label, token, w / sqrt(sum(w * w) OVER (PARTITION BY label)) AS tfidf FROM w) "
    "SELECT label::BIGINT AS label, token, round(tfidf, 6) AS tfidf FROM x QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(tfidf, 6) DESC, token) <= 12"
)
def tfidf_top(spark, sf):
    rows = C.tf_idf(_labelled_counts(spark, sf)).select(F.col("label").cast("long").alias("label"), "token", F.round("tfidf", 6).alias("tfidf"))
    return C.head_of_groups(rows, ["label"], [F.desc("tfidf"), F.asc("token")], 12)


@query(
    "WITH j AS (SELECT text, quality FROM documents JOIN labels USING (doc_id)), s AS (SELECT quality, count(*) AS k FROM j GROUP BY quality) "
    "SELECT count(*)::BIGINT AS rows, sum((text IS NULL)::INT)::BIGINT AS missing, (count(*) - count(DISTINCT text))::BIGINT AS duplicates, round(avg(length(text)), 4) AS mean_len, floor(quantile_cont(length(text), 0.5))::BIGINT AS median_len, max(length(text))::BIGINT AS max_len, "
    "(SELECT count(*) FROM s)::BIGINT AS classes, round((SELECT max(k) / greatest(min(k), 1)::DOUBLE FROM s), 6) AS imbalance FROM j"
)
def dataset_profile(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    p = C.dataset_profile(rows, "text", "quality")
    return p.withColumns({"mean_len": F.round("mean_len", 4), "imbalance": F.round("imbalance", 6)})


_NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a in _NUM for b in _NUM) + ")")
def corr_matrix(spark, sf):
    return C.correlation(table(spark, sf, "lineitem"), list(_NUM)).withColumn("r", F.round("r", 6))


_RUN = "run AS (SELECT r, count(*) AS m FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS r FROM documents) GROUP BY r)"
_GRAM = "(SELECT gram, sum(m)::BIGINT AS n FROM (SELECT m, unnest(list_transform(range(1, length(r) - {1} + 2), lambda i: substring(r, i, {1}))) AS gram FROM run WHERE length(r) >= {1}) GROUP BY gram)"


@query(f"WITH {_RUN} SELECT gram, n FROM {_GRAM.format(0, 2)} ORDER BY n DESC, gram LIMIT 300")
def char_ngrams(spark, sf):
    return C.char_ngrams(table(spark, sf, "documents"), 2).orderBy(F.desc("n"), "gram").limit(300)


@query(
    f"WITH {_RUN}, one AS {_GRAM.format(0, 1)}, two AS (SELECT * FROM {_GRAM.format(0, 2)} ORDER BY n DESC, gram LIMIT 4000), t AS (SELECT sum(n)::DOUBLE AS chars FROM one), "
    "p AS (SELECT two.gram, two.n, ln(two.n::DOUBLE * chars / (a.n::DOUBLE * b.n)) AS pmi FROM two JOIN one a ON a.gram = substring(two.gram, 1, 1) JOIN one b ON b.gram = substring(two.gram, 2, 1), t WHERE two.n >= 3) "
    "SELECT gram, n, round(pmi, 6) AS pmi, round(n * pmi * pow(2.0, 1.5), 4) AS score FROM p WHERE n * pmi * pow(2.0, 1.5) >= 4.0"
)
def pmi_vocab(spark, sf):
    return C.pmi_vocabulary(table(spark, sf, "documents")).select("gram", "n", F.round("pmi", 6).alias("pmi"), F.round("score", 4).alias("score"))


# Segmentation metrics over regular tokenizers as methods

_M1, _M2, _M3 = r"[\p{L}]+|[\p{N}]+", r"[\p{L}\p{N}]+", r"[\p{L}]{1,4}|[\p{N}]+"
_SEG = f"seg AS (SELECT doc_id, regexp_extract_all(text, '{_M1}') AS m1, regexp_extract_all(text, '{_M2}') AS m2, regexp_extract_all(text, '{_M3}') AS m3 FROM documents)"
# Boundaries p of each method m: running sums of the tokens' lengths, without the last.
_BOUND = (
    f"{_SEG}, lm AS (" + " UNION ALL ".join(f"SELECT doc_id, {k} AS m, m{k} AS ts FROM seg" for k in (1, 2, 3)) + "), tk AS (SELECT doc_id, m, unnest(ts) AS t, generate_subscripts(ts, 1) AS i, len(ts) AS n FROM lm), "
    "b AS (SELECT doc_id, m, p FROM (SELECT doc_id, m, i, n, sum(length(t)) OVER (PARTITION BY doc_id, m ORDER BY i)::BIGINT AS p FROM tk) WHERE i < n)"
)


def _methods(spark, sf):
    x = F.col("text")
    return table(spark, sf, "documents").select("doc_id", x.alias("x"), *[F.regexp_extract_all(x, F.lit(p), F.lit(0)).alias(m) for m, p in (("m1", _M1), ("m2", _M2), ("m3", _M3))])


def _prf_sql(tp, fp, fn):
    return f"{tp}::BIGINT AS tp, {fp}::BIGINT AS fp, {fn}::BIGINT AS fn, round(CASE WHEN {tp} + {fp} = 0 THEN 0 ELSE {tp} / ({tp} + {fp})::DOUBLE END, 4) AS precision, round(CASE WHEN {tp} + {fn} = 0 THEN 0 ELSE {tp} / ({tp} + {fn})::DOUBLE END, 4) AS recall, round(CASE WHEN 2 * {tp} + {fp} + {fn} = 0 THEN 0 ELSE 2 * {tp} / (2 * {tp} + {fp} + {fn})::DOUBLE END, 4) AS f1"


@query(f"WITH {_BOUND}, s AS (SELECT count(r.p) FILTER (h.p IS NOT NULL) AS tp, count(h.p) FILTER (r.p IS NULL) AS fp, count(r.p) FILTER (h.p IS NULL) AS fn FROM (SELECT * FROM b WHERE m = 1) r FULL JOIN (SELECT * FROM b WHERE m = 3) h ON r.doc_id = h.doc_id AND r.p = h.p) SELECT {_prf_sql('tp', 'fp', 'fn')} FROM s")
def seg_boundary_f1(spark, sf):
    return Z.boundary_scores(_methods(spark, sf), "m1", "m3")


@query(f"WITH {_SEG}, r AS (SELECT doc_id, unnest(m1) AS t FROM seg), h AS (SELECT doc_id, unnest(m3) AS t FROM seg), rc AS (SELECT doc_id, t, count(*) AS r FROM r GROUP BY ALL), hc AS (SELECT doc_id, t, count(*) AS h FROM h GROUP BY ALL), "
       f"s AS (SELECT sum(least(coalesce(r, 0), coalesce(h, 0))) AS tp, sum(coalesce(h, 0)) - sum(least(coalesce(r, 0), coalesce(h, 0))) AS fp, sum(coalesce(r, 0)) - sum(least(coalesce(r, 0), coalesce(h, 0))) AS fn FROM rc FULL JOIN hc USING (doc_id, t)) SELECT {_prf_sql('tp', 'fp', 'fn')} FROM s")  # fmt: skip
def seg_segment_f1(spark, sf):
    m = Z.multiset_match(_methods(spark, sf), "doc_id", "m1", "m3").agg(F.sum("tp").alias("tp"), (F.sum("n_hyp") - F.sum("tp")).alias("fp"), (F.sum("n_ref") - F.sum("tp")).alias("fn"))
    return m.select("tp", "fp", "fn", *Z.prf(F.col("tp"), F.col("fp"), F.col("fn")))


@query(f"WITH {_BOUND}, k AS (SELECT m, count(*) AS n FROM b GROUP BY m), x AS (SELECT p.m AS a, q.m AS b, count(*) AS n FROM b p JOIN b q ON p.doc_id = q.doc_id AND p.p = q.p AND p.m < q.m GROUP BY ALL) SELECT a::BIGINT AS a, b::BIGINT AS b, x.n::BIGINT AS both, ka.n::BIGINT AS na, kb.n::BIGINT AS nb, round(2 * x.n / greatest(ka.n + kb.n, 1)::DOUBLE, 4) AS f1 FROM x JOIN k ka ON ka.m = a JOIN k kb ON kb.m = b")
def seg_pairwise(spark, sf):
    rows = _methods(spark, sf)
    bounds = [Z.boundaries(Z.normal(F.col(m))) for m in ("m1", "m2", "m3")]
    pairs = [(i, j) for i in range(3) for j in range(i + 1, 3)]
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(i + 1).cast("long").alias("a"), F.lit(j + 1).cast("long").alias("b"), F.size(F.array_intersect(bounds[i], bounds[j])).alias("both"), F.size(bounds[i]).alias("na"), F.size(bounds[j]).alias("nb")) for i, j in pairs])).alias("x")).select("x.*")
    s = long.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("both", "na", "nb")])
    return s.withColumn("f1", F.round(2 * F.col("both") / F.greatest(F.col("na") + F.col("nb"), F.lit(1)), 4))


@query(f"WITH {_SEG}, t AS (SELECT unnest(m3) AS t FROM seg), n AS (SELECT count(*) AS tokens, round(avg(length(t)), 4) AS mean_len, round(avg((length(t) = 1)::INT), 4) AS single_share, count(DISTINCT t) AS vocab FROM t) SELECT tokens::BIGINT AS tokens, mean_len, single_share, vocab::BIGINT AS vocab FROM n")
def seg_describe(spark, sf):
    t = _methods(spark, sf).select(F.explode(Z.normal(F.col("m3"))).alias("t"))
    return t.agg(F.count("*").alias("tokens"), F.round(F.avg(F.length("t")), 4).alias("mean_len"), F.round(F.avg((F.length("t") == 1).cast("int")), 4).alias("single_share"), F.countDistinct("t").alias("vocab"))


@query(f"WITH {_BOUND}, v AS (SELECT doc_id, p FROM b GROUP BY ALL HAVING count(*) >= 3) SELECT d.doc_id, count(v.p)::BIGINT AS n, coalesce(sum(v.p), 0)::BIGINT AS place_sum FROM documents d LEFT JOIN v USING (doc_id) GROUP BY d.doc_id")
def seg_consensus(spark, sf):
    c = Z.consensus(_methods(spark, sf), ["m1", "m2", "m3"], 3)
    return _methods(spark, sf).select("doc_id", c.alias("c")).select("doc_id", F.size("c").cast("long").alias("n"), F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + x).alias("place_sum"))


@query(f"WITH {_BOUND}, v AS (SELECT doc_id, p, count(*) AS n FROM b GROUP BY ALL), r AS (SELECT doc_id, sum((n = 3)::INT) / count(*)::DOUBLE AS r FROM v GROUP BY doc_id) SELECT d.doc_id, round(coalesce(r, 1), 4) AS rate FROM documents d LEFT JOIN r USING (doc_id)")
def seg_agree_rate(spark, sf):
    b = [Z.boundaries(Z.normal(F.col(m))) for m in ("m1", "m2", "m3")]
    either, both = F.size(F.array_union(F.array_union(b[0], b[1]), b[2])), F.size(F.array_intersect(F.array_intersect(b[0], b[1]), b[2]))
    return _methods(spark, sf).select("doc_id", F.round(F.when(either == 0, 1.0).otherwise(both / either), 4).alias("rate"))


def _vocabulary(spark, sf, most: int = 3000) -> dict[str, int]:
    """The unsupervised vocabulary's best bigrams and all letters: at most `most` words and an alphabet."""
    docs = table(spark, sf, "documents")
    two = C.pmi_vocabulary(docs).orderBy(F.desc("score"), "gram").limit(most).select("gram", "n")
    one = C.char_ngrams(docs, 1).orderBy(F.desc("n"), "gram").limit(most)
    return {r["gram"]: r["n"] for r in two.unionByName(one).collect()}


@query()
def seg_maxmatch(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return Z.segmented(docs, "max_match", _vocabulary(spark, sf), longest=2).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ").cast("binary")).alias("tokens_md5"))


@query()
def seg_viterbi(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return Z.segmented(docs, "viterbi", _vocabulary(spark, sf), longest=2).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ").cast("binary")).alias("tokens_md5"))


# Labels and agreement. A third rater is derived from the text's length.

_RATERS = "long AS (SELECT doc_id AS item, 'a' AS rater, quality AS label FROM labels UNION ALL SELECT doc_id, 'b', toxic FROM labels UNION ALL SELECT l.doc_id, 'c', (n_chars > 1000)::INT FROM labels l JOIN documents USING (doc_id)), pr AS (SELECT p.rater AS ra, q.rater AS rb, p.label AS a, q.label AS b, p.item FROM long p JOIN long q ON p.item = q.item AND p.rater < q.rater)"


def _long(spark, sf):
    labels = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", (F.col("n_chars") > 1000).cast("int").alias("long")), "doc_id")
    return labels.select(F.col("doc_id").alias("item"), F.explode(F.create_map(F.lit("a"), F.col("quality"), F.lit("b"), F.col("toxic"), F.lit("c"), F.col("long"))).alias("rater", "label"))


@query(f"WITH {_RATERS} SELECT ra, rb, a::BIGINT AS a, b::BIGINT AS b, count(*)::BIGINT AS n FROM pr GROUP BY ALL")
def contingency(spark, sf):
    return A.contingency(A.pairs(_long(spark, sf))).select("ra", "rb", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "n")


_COHEN = f"{_RATERS}, t AS (SELECT ra, rb, count(*) AS n, avg((a = b)::INT) AS po, avg(a) AS pa, avg(b) AS pb FROM pr GROUP BY ra, rb), k AS (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS pe FROM t), c AS (SELECT *, (po - pe) / (1 - pe) AS kappa, sqrt(po * (1 - po) / (n * (1 - pe) * (1 - pe))) AS se FROM k)"


@query(f"WITH {_COHEN} SELECT ra, rb, n::BIGINT AS n, round(po, 6) AS po, round(pe, 6) AS pe, round(kappa, 6) AS kappa, round(se, 6) AS se, round(kappa / se, 4) AS z, round(kappa - 1.96 * se, 6) AS low, round(kappa + 1.96 * se, 6) AS high FROM c")
def cohen_kappa(spark, sf):
    k = A.cohen(A.pairs(_long(spark, sf)))
    return k.select("ra", "rb", "n", *[F.round(c, 6).alias(c) for c in ("po", "pe", "kappa", "se")], F.round("z", 4).alias("z"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(f"WITH {_COHEN} SELECT ra, rb, CASE WHEN kappa BETWEEN 0 AND 0.2 THEN 'slight' WHEN kappa BETWEEN 0.2 AND 0.4 THEN 'fair' WHEN kappa BETWEEN 0.4 AND 0.6 THEN 'moderate' WHEN kappa BETWEEN 0.6 AND 0.8 THEN 'substantial' WHEN kappa BETWEEN 0.8 AND 1 THEN 'almost perfect' ELSE '—' END AS band FROM c")
def agreement_band(spark, sf):
    return A.cohen(A.pairs(_long(spark, sf))).select("ra", "rb", S.band(F.col("kappa")).alias("band"))


_ITEMS = f"{_RATERS}, ic AS (SELECT item, label, count(*) AS n FROM long GROUP BY ALL), it AS (SELECT item, sum(n) AS m, sum(n * n) AS sq FROM ic GROUP BY item)"


@query(
    f"WITH {_ITEMS}, mean AS (SELECT count(*) AS items, avg(m) AS m, avg((sq - m) / (m * (m - 1))::DOUBLE) AS p_bar FROM it), sh AS (SELECT label, sum(n) / (SELECT count(*) FROM long)::DOUBLE AS pj FROM ic GROUP BY label), ch AS (SELECT sum(pj * pj) AS pe, sum(pj * pj * pj) AS p3 FROM sh) "
    "SELECT items::BIGINT AS items, round(p_bar, 6) AS p_bar, round(pe, 6) AS p_e, round((p_bar - pe) / (1 - pe), 6) AS kappa, round(sqrt(2 / (items * m * (m - 1))) * sqrt(pe - (2 * m - 3) * pe * pe + 2 * (m - 2) * p3) / (1 - pe), 6) AS se FROM mean, ch"
)
def fleiss_kappa(spark, sf):
    return A.fleiss(_long(spark, sf)).select("items", *[F.round(c, 6).alias(c) for c in ("p_bar", "p_e", "kappa", "se")])


@query(
    f"WITH {_ITEMS}, s AS (SELECT label, n, m FROM ic JOIN it USING (item) WHERE m >= 2), o AS (SELECT sum(n)::DOUBLE AS total, sum(n * (n - 1) / (m - 1)::DOUBLE) AS same FROM s), e AS (SELECT sum(k * k)::DOUBLE AS sq FROM (SELECT label, sum(n) AS k FROM s GROUP BY label)) "
    "SELECT round(1 - (1 - same / total) / (1 - sq / (total * total)), 6) AS alpha, round(1 - same / total, 6) AS d_o, round(1 - sq / (total * total), 6) AS d_e FROM o, e"
)
def krippendorff_alpha(spark, sf):
    return A.krippendorff(_long(spark, sf)).select(*[F.round(c, 6).alias(c) for c in ("alpha", "d_o", "d_e")])


def _weighted_sql(power: int) -> str:
    w = lambda a, b: f"pow(abs({a} - {b}), {power})"
    return (
        "o AS (SELECT quality + toxic AS a, CASE WHEN n_chars > 2000 THEN 2 WHEN n_chars > 800 THEN 1 ELSE 0 END AS b FROM labels JOIN documents USING (doc_id)), "
        f"w{power} AS (SELECT {power} AS power, 1 - sum({w('a', 'b')}) * count(*)::DOUBLE / (SELECT sum({w('x.a', 'y.b')} * x.n * y.n) FROM (SELECT a, count(*)::DOUBLE AS n FROM o GROUP BY a) x, (SELECT b, count(*)::DOUBLE AS n FROM o GROUP BY b) y) AS kappa FROM o)"
    )


@query(f"WITH {_weighted_sql(1)}, {_weighted_sql(2).split('), ', 1)[1]} SELECT power::BIGINT AS power, round(kappa, 6) AS kappa FROM (SELECT * FROM w1 UNION ALL SELECT * FROM w2)")
def weighted_kappa(spark, sf):
    n = F.col("n_chars")
    both = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select(F.lit("a").alias("ra"), F.lit("b").alias("rb"), (F.col("quality") + F.col("toxic")).alias("a"), F.when(n > 2000, 2).when(n > 800, 1).otherwise(0).alias("b"))
    return G.union_all([A.weighted(both, p).select(F.lit(p).cast("long").alias("power"), F.round("kappa", 6).alias("kappa")) for p in (1, 2)])


@query(f"WITH {_COHEN}, q AS (SELECT ra, rb, sum((a = 1 AND b = 1)::INT) AS n11, sum((a = 1 AND b = 0)::INT) AS n10, sum((a = 0 AND b = 1)::INT) AS n01, sum((a = 0 AND b = 0)::INT) AS n00 FROM pr GROUP BY ra, rb) SELECT ra, rb, n11::BIGINT AS both, n10::BIGINT AS first, n01::BIGINT AS second, n00::BIGINT AS none, round(kappa, 6) AS kappa FROM q JOIN c USING (ra, rb)")
def binary_kappa(spark, sf):
    return A.binary(A.pairs(_long(spark, sf))).withColumn("kappa", F.round("kappa", 6))


@query(f"WITH {_ITEMS} SELECT ic.item, label::BIGINT AS majority, n::BIGINT AS votes, m::BIGINT AS m, round((sq - m) / (m * (m - 1))::DOUBLE, 6) AS p_i FROM ic JOIN it USING (item) QUALIFY row_number() OVER (PARTITION BY ic.item ORDER BY n DESC, label) = 1")
def item_majority(spark, sf):
    return A.majority(_long(spark, sf)).select("item", F.col("majority").cast("long").alias("majority"), "votes", "m", F.round("p_i", 6).alias("p_i"))


@query(f"WITH {_RATERS} SELECT least(a, b)::BIGINT AS x, greatest(a, b)::BIGINT AS y, count(*)::BIGINT AS n FROM pr WHERE a <> b GROUP BY ALL")
def confusion_pairs(spark, sf):
    return A.confusions(A.pairs(_long(spark, sf))).select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "n")


@query(f"WITH {_RATERS} SELECT rater, label::BIGINT AS label, count(*)::BIGINT AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY rater), 4) AS pct FROM long GROUP BY rater, label")
def annotator_stats(spark, sf):
    k = _long(spark, sf).groupBy("rater", F.col("label").cast("long").alias("label")).agg(F.count("*").alias("n"))
    return k.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("rater")), 4))


@query(f"WITH {_RATERS} SELECT item, max(CASE WHEN rater = 'a' THEN label END)::BIGINT AS a, max(CASE WHEN rater = 'b' THEN label END)::BIGINT AS b, max(CASE WHEN rater = 'c' THEN label END)::BIGINT AS c FROM long GROUP BY item")
def annot_long_to_wide(spark, sf):
    return A.wide(_long(spark, sf), ["a", "b", "c"]).select("item", *[F.col(c).cast("long").alias(c) for c in "abc"])


@query("SELECT doc_id, CASE WHEN s >= 40 THEN '正面' WHEN s = 30 THEN '中性' WHEN s IN (10, 20) THEN '负面' ELSE '无法判断' END AS label, CASE WHEN s >= 40 THEN 1 WHEN s IN (10, 20) THEN 0 END::BIGINT AS bin FROM (SELECT doc_id, (doc_id % 6) * 10 AS s FROM documents)")
def weak_label(spark, sf):
    label = T.star_label(((F.col("doc_id") % 6) * 10).cast("string"))
    return table(spark, sf, "documents").select("doc_id", label.alias("label"), T.binary_label(label).cast("long").alias("bin"))


_POS, _NEG = ["the", "and", "der", "que"], ["###", "$$$", "stupid", "!!"]


@query("SELECT doc_id, CASE WHEN p > n THEN '正面' WHEN n > p THEN '负面' ELSE '中性' END AS label FROM (SELECT doc_id, " + " + ".join(f"contains(text, '{w}')::INT" for w in _POS) + " AS p, " + " + ".join(f"contains(text, '{w}')::INT" for w in _NEG) + " AS n FROM documents)")
def lexicon_label(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.lexicon_label(F.col("text"), _POS, _NEG).alias("label"))


# Samples and splits

@query("SELECT doc_id, CASE WHEN r <= floor(0.8 * n + 0.5) THEN 'train' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR || ':42'), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)")
def split_stratified(spark, sf):
    return M.stratified_split(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", "lang").select("doc_id", "split")


@query("WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR || ':1'), doc_id) <= 120 // (SELECT count(DISTINCT lang) FROM documents) AS own, md5(doc_id::VARCHAR || ':2') AS h FROM documents) SELECT doc_id, lang FROM r ORDER BY own DESC, CASE WHEN own THEN '' ELSE h END, doc_id LIMIT 120")
def sample_stratified(spark, sf):
    return M.stratified_sample(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", "lang", 120)


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS n FROM documents) WHERE r % greatest(1, n // 20) = 0 ORDER BY r LIMIT 20")
def systematic_sample(spark, sf):
    return M.systematic_sample(table(spark, sf, "documents"), "doc_id", 20)


# Daily series from orders

_DAY = (
    "day AS (SELECT o_orderdate::DATE AS day, floor(max(o_totalprice) / 1000) / 10.0::DOUBLE AS t_max, floor(min(o_totalprice) / 1000) / 10.0::DOUBLE - 3 AS t_min, greatest(count(*) - 4, 0)::DOUBLE AS rain, (max(o_custkey) % 25)::DOUBLE AS wind, (min(o_orderkey) % 100)::DOUBLE AS humidity FROM orders GROUP BY ALL), "
    "f AS (SELECT *, t_min <= 0 AS frost_day, t_max >= 35 AS heat_day, t_max >= 38 AS severe_heat_day, rain < 1 AS dry_day, wind >= 17 AS strong_wind_day, wind >= 15 AND humidity <= 30 AS dust_storm_risk, rain >= 1 AS rainy_day FROM day), "
    "g AS (SELECT *, sum((NOT dry_day)::INT) OVER (ORDER BY day) AS gd, sum((NOT rainy_day)::INT) OVER (ORDER BY day) AS gr FROM f), "
    "w AS (SELECT * EXCLUDE (gd, gr), row_number() OVER (PARTITION BY gd ORDER BY day)::BIGINT AS dry_streak, CASE WHEN rainy_day THEN row_number() OVER (PARTITION BY gr ORDER BY day) ELSE 0 END::BIGINT AS rain_streak FROM g)"
)


def daily(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(
        (F.floor(F.max("o_totalprice") / 1000) / 10).alias("t_max"), (F.floor(F.min("o_totalprice") / 1000) / 10 - 3).alias("t_min"), F.greatest(F.count("*") - 4, F.lit(0)).cast("double").alias("rain"), (F.max("o_custkey") % 25).cast("double").alias("wind"), (F.min("o_orderkey") % 100).cast("double").alias("humidity")
    )
    return D.streak(D.streak(D.flags(o), "dry_day", "dry_streak"), "rainy_day", "rain_streak", reset=True)


@query(f"WITH {_DAY} SELECT * FROM w")
def daily_flags(spark, sf):
    return daily(spark, sf)


@query(f"WITH {_DAY} SELECT month(day)::BIGINT AS month, max(dry_streak)::BIGINT AS dry, max(rain_streak)::BIGINT AS rain FROM w GROUP BY ALL")
def max_streak(spark, sf):
    return daily(spark, sf).groupBy(F.month("day").cast("long").alias("month")).agg(F.max("dry_streak").alias("dry"), F.max("rain_streak").alias("rain"))


@query(f"WITH {_DAY}, x AS (SELECT day, dry_day, CASE WHEN dry_day THEN sum(dry_day::INT) OVER (PARTITION BY gd ORDER BY day) ELSE 0 END::BIGINT AS n FROM g) SELECT day, n FROM x")
def dry_streak_exact(spark, sf):
    return D.streak(daily(spark, sf).select("day", "dry_day"), "dry_day", "n", exact=True).select("day", "n")


@query(f"WITH {_DAY}, m AS (SELECT month(day) AS month, " + ", ".join(f"sum({c}::INT) AS {c}" for c in D.FLAGS[:5]) + " FROM w GROUP BY ALL) SELECT r.month::BIGINT AS month, " + ", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in D.FLAGS[:5]) + " FROM (SELECT unnest(range(1, 13)) AS month) r LEFT JOIN m ON r.month = m.month")
def month_report(spark, sf):
    return D.monthly(daily(spark, sf))


@query(f"WITH {_DAY}, p AS (SELECT * FROM (VALUES ('bud', [3, 4]), ('flower', [5, 6]), ('growth', [6, 7, 8]), ('ripen', [8, 9, 10])) v(period, months)) SELECT period, " + ", ".join(f"sum({c}::INT)::BIGINT AS {c}" for c in D.FLAGS[:5]) + " FROM w JOIN p ON list_contains(months, month(day)) GROUP BY period")
def period_report(spark, sf):
    return D.by_period(daily(spark, sf))


@query(f"WITH {_DAY} SELECT day, t_max, rain FROM w WHERE frost_day OR heat_day OR dry_streak >= 5 OR strong_wind_day OR dust_storm_risk")
def high_risk_days(spark, sf):
    return D.high_risk(daily(spark, sf)).select("day", "t_max", "rain")


@query(f"WITH {_DAY} SELECT CASE WHEN month(day) IN (3, 4, 5) THEN 'spring' WHEN month(day) IN (6, 7, 8) THEN 'summer' WHEN month(day) IN (9, 10, 11) THEN 'autumn' ELSE 'winter' END AS season, sum(frost_day::INT)::BIGINT AS frost, sum(heat_day::INT)::BIGINT AS heat, max(dry_streak)::BIGINT AS dry FROM w GROUP BY ALL")
def season_counts(spark, sf):
    m = F.month("day")
    season = F.when(m.isin(3, 4, 5), "spring").when(m.isin(6, 7, 8), "summer").when(m.isin(9, 10, 11), "autumn").otherwise("winter")
    return daily(spark, sf).groupBy(season.alias("season")).agg(F.sum(F.col("frost_day").cast("long")).alias("frost"), F.sum(F.col("heat_day").cast("long")).alias("heat"), F.max("dry_streak").alias("dry"))


@query(f"WITH {_DAY} SELECT strftime(day, '%Y-%m') AS ym, round(avg(t_max), 6) AS avg_max, round(avg(wind), 6) AS avg_wind, sum(rain)::BIGINT AS sum_rain, count(*)::BIGINT AS days FROM w GROUP BY ALL")
def yearmonth_rollup(spark, sf):
    return daily(spark, sf).groupBy(F.date_format("day", "yyyy-MM").alias("ym")).agg(F.round(F.avg("t_max"), 6).alias("avg_max"), F.round(F.avg("wind"), 6).alias("avg_wind"), F.sum("rain").cast("long").alias("sum_rain"), F.count("*").alias("days"))


# Triples and graph patterns

_TRI = f"{_DAY}, s AS (SELECT 'Record_' || strftime(day, '%Y%m%d') AS s, * FROM w), tri AS (SELECT s, 'hasEvent' AS p, e || '_instance' AS o, 'iri' AS datatype FROM (" + " UNION ALL ".join(f"SELECT s, '{f}' AS e FROM s WHERE {f}" for f in D.FLAGS) + ") UNION ALL SELECT s, 'dry_streak', dry_streak::VARCHAR, 'integer' FROM s UNION ALL SELECT s, 'rain_streak', rain_streak::VARCHAR, 'integer' FROM s UNION ALL SELECT s, 'day', day::VARCHAR, 'date' FROM s" + "".join(f" UNION ALL SELECT s, '{c}', {c}::VARCHAR, 'float' FROM s" for c in ("t_max", "t_min", "rain", "wind", "humidity")) + ")"


def _spo(spark, sf):
    return G.triples(daily(spark, sf))


@query(f"WITH {_TRI} SELECT s, p, o, datatype FROM tri")
def triples(spark, sf):
    return _spo(spark, sf)


@query(f"WITH {_DAY} SELECT day, t_max FROM w WHERE t_max > 35 ORDER BY t_max DESC, day")
def sparql_hot(spark, sf):
    spo = G.triples(daily(spark, sf))
    return G.match(spo, ("?r", "day", "?d"), ("?r", "t_max", "?t")).select(F.to_date("d").alias("day"), F.col("t").cast("double").alias("t_max")).where("t_max > 35").orderBy(F.desc("t_max"), "day")


@query(f"WITH {_DAY} SELECT count(*)::BIGINT AS n FROM w WHERE rainy_day")
def sparql_count(spark, sf):
    return G.match(_spo(spark, sf), ("?r", "hasEvent", "rainy_day_instance")).agg(F.count("*").alias("n"))


@query(f"WITH {_TRI} SELECT o AS event, count(*)::BIGINT AS n FROM tri WHERE p = 'hasEvent' GROUP BY o ORDER BY n DESC, event")
def sparql_event_counts(spark, sf):
    return G.match(_spo(spark, sf), ("?r", "hasEvent", "?e")).groupBy(F.col("e").alias("event")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event")


@query(f"WITH {_DAY} SELECT day, dry_streak FROM w ORDER BY dry_streak DESC, day LIMIT 5")
def sparql_top5(spark, sf):
    return G.match(_spo(spark, sf), ("?r", "day", "?d"), ("?r", "dry_streak", "?n")).select(F.to_date("d").alias("day"), F.col("n").cast("long").alias("dry_streak")).orderBy(F.desc("dry_streak"), "day").limit(5)


@query(f"WITH {_DAY} SELECT day, rain FROM w WHERE rain > 0 ORDER BY rain DESC, day LIMIT 5")
def sparql_top_rain(spark, sf):
    return daily(spark, sf).where("rain > 0").select("day", "rain").orderBy(F.desc("rain"), "day").limit(5)


_EDGE = f"{_DAY}, ev AS (" + " UNION ALL ".join(f"SELECT day, '{f}' AS event FROM w WHERE {f}" for f in D.FLAGS) + ")"


@query(f"WITH {_EDGE} SELECT event, count(*)::BIGINT AS n FROM ev GROUP BY event")
def graph_event_counts(spark, sf):
    return G.events(daily(spark, sf)).groupBy("event").agg(F.count("*").alias("n"))


@query(f"WITH {_DAY} SELECT a.day AS src, b.day AS dst FROM w a JOIN w b ON b.day = a.day + 1")
def next_day(spark, sf):
    return G.next_day(daily(spark, sf))


@query(f"WITH {_DAY} SELECT day AS src, strftime(day, '%Y-%m') AS dst FROM w")
def in_month(spark, sf):
    d = daily(spark, sf).select(F.col("day").alias("src"), F.date_format("day", "yyyy-MM").alias("k"))
    months = d.select(F.col("k").alias("dst")).distinct()
    return d.join(months, F.col("k") == F.col("dst")).select("src", "dst")


@query(f"WITH {_EDGE} SELECT 'HAS_EVENT' AS type, count(*)::BIGINT AS n FROM ev UNION ALL SELECT 'NEXT_DAY', count(*)::BIGINT FROM w a JOIN w b ON b.day = a.day + 1 UNION ALL SELECT 'IN_MONTH', count(*)::BIGINT FROM w")
def edge_type_counts(spark, sf):
    d = daily(spark, sf)
    parts = [("HAS_EVENT", G.events(d).select("event")), ("NEXT_DAY", G.next_day(d)), ("IN_MONTH", d)]
    return G.union_all([p.agg(F.count("*").alias("n")).select(F.lit(n).alias("type"), "n") for n, p in parts])


@query(f"WITH {_EDGE} SELECT 'Record' AS label, count(*)::BIGINT AS n FROM w UNION ALL SELECT 'Event', count(DISTINCT event)::BIGINT FROM ev UNION ALL SELECT 'Month', count(DISTINCT strftime(day, '%Y-%m'))::BIGINT FROM w")
def node_label_counts(spark, sf):
    d = daily(spark, sf)
    return G.union_all([d.agg(F.count("*").alias("n")).select(F.lit("Record").alias("label"), "n"), G.events(d).agg(F.countDistinct("event").alias("n")).select(F.lit("Event").alias("label"), "n"), d.agg(F.countDistinct(F.date_format("day", "yyyy-MM")).alias("n")).select(F.lit("Month").alias("label"), "n")])


@query(f"WITH {_EDGE} SELECT event, day AS day FROM ev WHERE day = DATE '1996-07-01' UNION ALL SELECT 'NEXT_DAY', b.day FROM w a JOIN w b ON b.day = a.day + 1 WHERE a.day = DATE '1996-07-01'")
def out_edges(spark, sf):
    d, at = daily(spark, sf), F.to_date(F.lit("1996-07-01"))
    return G.events(d).where(F.col("day") == at).select("event", "day").unionByName(G.next_day(d).where(F.col("src") == at).select(F.lit("NEXT_DAY").alias("event"), F.col("dst").alias("day")))


@query(f"WITH {_EDGE} SELECT day, count(*)::BIGINT AS n, string_agg(event, ',' ORDER BY event) AS events FROM ev GROUP BY day HAVING count(*) >= 3")
def multi_event_days(spark, sf):
    return G.events(daily(spark, sf)).groupBy("day").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("event")), ",").alias("events")).where("n >= 3")


@query(f"WITH {_EDGE} SELECT event, count(*)::BIGINT AS n FROM ev WHERE strftime(day, '%Y-%m') = '1996-07' GROUP BY event ORDER BY n DESC, event")
def month_event_counts(spark, sf):
    return G.events(daily(spark, sf)).where(F.date_format("day", "yyyy-MM") == "1996-07").groupBy("event").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event")


@query(f"WITH {_DAY} SELECT a.n::BIGINT AS hot, b.n::BIGINT AS dry FROM (SELECT count(*) AS n FROM w WHERE heat_day) a, (SELECT count(*) AS n FROM w WHERE dry_day) b WHERE a.n > 0 AND b.n > 0")
def two_model_count(spark, sf):
    d = daily(spark, sf)
    n = d.agg(F.count_if("heat_day").alias("hot"), F.count_if("dry_day").alias("dry"))
    return n.where("hot > 0 AND dry > 0")  # a grouped count of nothing has no row, so the pair has none


@query(
    f"WITH RECURSIVE {_DAY}, hop AS (SELECT day AS start, day AS cur, 0 AS hops FROM w WHERE dry_streak > 1 UNION ALL SELECT start, w.day, hops + 1 FROM hop JOIN w ON w.day = hop.cur + 1 WHERE hops < 10 AND w.dry_streak > 0) SELECT start AS start, cur AS \"end\", hops::BIGINT AS hops FROM hop WHERE hops >= 2"
)
def dry_paths(spark, sf):
    return G.paths(daily(spark, sf), "dry_streak").select("start", "end", F.col("hops").cast("long").alias("hops"))


# Features, classifiers, clusters

_VEC = "v AS (SELECT vec_id AS id, embedding AS vec, label FROM embeddings)"


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").cast("long").alias("label"))


@query("WITH s AS (SELECT avg(p_size) AS m1, stddev_pop(p_size) AS s1, avg(p_retailprice) AS m2, stddev_pop(p_retailprice) AS s2 FROM part) SELECT p_partkey, round((p_size - m1) / s1, 6) AS p_size, round((p_retailprice - m2) / s2, 6) AS p_retailprice FROM part, s")
def standardize(spark, sf):
    rows = M.standardize(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])
    return rows.select("p_partkey", F.round("p_size", 6).alias("p_size"), F.round("p_retailprice", 6).alias("p_retailprice"))


_DIST = "sqrt(list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2]))))"
_KNN = f"{_VEC}, d AS (SELECT t.id, t.label AS actual, r.id AS tid, r.label AS tl, {_DIST.format('t.vec', 'r.vec')} AS d FROM v t, v r WHERE t.id % 5 = 0 AND r.id % 5 <> 0), n AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(d, 9), tid) <= 5), k AS (SELECT id, actual, tl, count(*) AS c FROM n GROUP BY ALL), p AS (SELECT id, actual, tl AS predicted FROM k QUALIFY row_number() OVER (PARTITION BY id ORDER BY c DESC, tl) = 1)"


def _knn(spark, sf):
    v = _vectors(spark, sf)
    return M.knn(v.where("id % 5 <> 0"), v.where("id % 5 = 0"))


@query(f"WITH {_KNN} SELECT id, actual::BIGINT AS actual, predicted::BIGINT AS predicted FROM p")
def knn_predict(spark, sf):
    return _knn(spark, sf)


@query(f"WITH {_KNN}, c AS (SELECT sum((actual < 5 AND predicted < 5)::INT) AS tp, sum((actual >= 5 AND predicted < 5)::INT) AS fp, sum((actual < 5 AND predicted >= 5)::INT) AS fn, sum((actual >= 5 AND predicted >= 5)::INT) AS tn FROM p) SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1 FROM c")
def binary_metrics(spark, sf):
    p = _knn(spark, sf).select((F.col("actual") < 5).cast("int").alias("a"), (F.col("predicted") < 5).cast("int").alias("b"))
    return M.binary_metrics(p, "a", "b")


@query(f"WITH {_KNN} SELECT actual::BIGINT AS actual, predicted::BIGINT AS predicted, count(*)::BIGINT AS n FROM p GROUP BY ALL")
def confusion_matrix(spark, sf):
    return _knn(spark, sf).groupBy("actual", "predicted").agg(F.count("*").alias("n"))


@query(
    f"WITH {_VEC}, l AS (SELECT id, label, unnest(vec)::DOUBLE AS x, unnest(range(1, len(vec) + 1)) AS d FROM v), c AS (SELECT label, d, avg(x) AS c FROM l GROUP BY ALL), w AS (SELECT d, avg(x) AS w FROM l GROUP BY d), sp AS (SELECT id, label, sum((x - c) * (x - c)) AS sq FROM l JOIN c USING (label, d) GROUP BY ALL), wi AS (SELECT label, count(*) AS n, sum(sq) AS wss, avg(sqrt(sq)) AS s FROM sp GROUP BY label), be AS (SELECT label, sum((c - w) * (c - w)) AS b FROM c JOIN w USING (d) GROUP BY label), "
    "ch AS (SELECT count(*) AS k, sum(n) AS n, sum(n * b) AS bss, sum(wss) AS wss FROM wi JOIN be USING (label)), gap AS (SELECT p.label AS i, q.label AS j, sqrt(sum((p.c - q.c) * (p.c - q.c))) AS m FROM c p JOIN c q ON p.d = q.d AND p.label <> q.label GROUP BY ALL), r AS (SELECT i, max((a.s + b.s) / m) AS r FROM gap JOIN wi a ON a.label = i JOIN wi b ON b.label = j GROUP BY i) "
    "SELECT k::BIGINT AS k, n::BIGINT AS n, round((bss / (k - 1)) / (wss / (n - k)), 6) AS calinski_harabasz, round((SELECT avg(r) FROM r), 6) AS davies_bouldin FROM ch"
)
def cluster_indices(spark, sf):
    return M.cluster_indices(_vectors(spark, sf).withColumnRenamed("label", "cluster"), 64)


@query(f"WITH {_VEC}, d AS (SELECT a.id, a.label, b.label AS jl, avg({_DIST.format('a.vec', 'b.vec')}) AS d FROM v a JOIN v b ON a.id <> b.id GROUP BY ALL), ab AS (SELECT id, min(CASE WHEN label = jl THEN d END) AS a, min(CASE WHEN label <> jl THEN d END) AS b FROM d GROUP BY id) SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette, count(*)::BIGINT AS n FROM ab")
def silhouette(spark, sf):
    return M.silhouette(_vectors(spark, sf).withColumnRenamed("label", "cluster"))


@query(f"WITH {_VEC}, l AS (SELECT label, unnest(vec)::DOUBLE AS x, generate_subscripts(vec, 1) - 1 AS d FROM v) SELECT label::BIGINT AS cluster, count(*)::BIGINT AS n, round(100 * count(*) / (SELECT count(*) FROM v), 4) AS pct, d::BIGINT AS d, round(avg(x), 6) AS mean FROM l GROUP BY label, d")
def cluster_profile(spark, sf):
    v = _vectors(spark, sf).withColumnRenamed("label", "cluster")
    return M.cluster_profile(v, 64).select("cluster", "n", F.round("pct", 4).alias("pct"), "d", F.round("mean", 6).alias("mean"))


@query()
def kmeans_sizes(spark, sf):
    return M.kmeans(_vectors(spark, sf), 10).groupBy(F.col("cluster").cast("long").alias("cluster")).agg(F.count("*").alias("n"))


@query(
    f"WITH RECURSIVE {_VEC}, e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON {_DIST.format('a.vec', 'b.vec')} <= 1.0), core AS MATERIALIZED (SELECT a AS id FROM e GROUP BY a HAVING count(*) >= 5), "
    "ce AS MATERIALIZED (SELECT a, b FROM e JOIN core x ON x.id = a JOIN core y ON y.id = b), r AS (SELECT id, id AS label FROM core UNION SELECT ce.b, r.label FROM r JOIN ce ON ce.a = r.id), l AS (SELECT id, min(label) AS label FROM r GROUP BY id), "
    "o AS (SELECT e.a AS id, min(l.label) AS border FROM e JOIN l ON l.id = e.b GROUP BY e.a) SELECT v.id, coalesce(l.label, o.border, -1)::BIGINT AS cluster FROM v LEFT JOIN l ON l.id = v.id LEFT JOIN o ON o.id = v.id"
)
def dbscan_labels(spark, sf):
    return M.dbscan(_vectors(spark, sf).select("id", "vec"), eps=1.0).select("id", "cluster")


# Semi-structured

@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT event_id, regexp_replace(props, '\\}$', ',\"range\": \"1-5\"}') AS fixed FROM events")
def json_repair(spark, sf):
    broken = F.concat(F.lit("```json\n"), F.regexp_replace("props", r"\}$", ',"range": 1-5,}'), F.lit("\n```"))
    return table(spark, sf, "events").select("event_id", J.repaired(broken).alias("fixed"))


@query("SELECT event_type AS model, count(*)::BIGINT AS runs, round(sum(length(props)), 0)::BIGINT AS chars, round(avg(value), 4) AS elapsed FROM events GROUP BY event_type")
def llm_compare(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("model")).agg(F.count("*").alias("runs"), F.sum(F.length("props")).alias("chars"), F.round(F.avg("value"), 4).alias("elapsed"))


@query("SELECT page_id, regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1, len(regexp_extract_all(html, '<li>'))::BIGINT AS n_items FROM pages")
def html_fields(spark, sf):
    one = lambda p: F.regexp_extract("html", p, 1)
    return table(spark, sf, "pages").select("page_id", one("<title[^>]*>([^<]*)</title>").alias("title"), one("<h1>([^<]*)</h1>").alias("h1"), F.regexp_count("html", F.lit("<li>")).cast("long").alias("n_items"))


@query("SELECT page_id, octet_length(encode(html))::BIGINT AS n_bytes, left(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), 80) AS title, regexp_matches(html, '[\\x{4e00}-\\x{9fff}]') AS has_han, octet_length(encode(html)) > 500 AS ok FROM pages")
def html_title_probe(spark, sf):
    return R.page_probe(table(spark, sf, "pages"))


@query("SELECT page_id, m.pos::BIGINT AS pos, regexp_extract(m.x, 'href=\"([^\"]*)\">([^<]*)</a>', 1) AS href, regexp_extract(m.x, 'href=\"([^\"]*)\">([^<]*)</a>', 2) AS label FROM (SELECT page_id, unnest(list_transform(regexp_extract_all(html, 'href=\"[^\"]*\">[^<]*</a>'), lambda x, i: {'pos': i - 1, 'x': x})) AS m FROM pages)")
def html_links(spark, sf):
    return R.html_list(table(spark, sf, "pages").select("page_id", "html"), 'href="([^"]*)">([^<]*)</a>', ["href", "label"]).withColumn("pos", F.col("pos").cast("long"))


@query("SELECT conv_id, turn, coalesce(lag(role) OVER w, '') AS before, role, coalesce(lead(role) OVER w, '') AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def turn_windows(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce(F.lag("role").over(w), F.lit("")).alias("before"), "role", F.coalesce(F.lead("role").over(w), F.lit("")).alias("after"))


@query("WITH t AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}]+') AS ws FROM benchmark), p AS (SELECT item_id, unnest(range(1, len(ws) + 1)) AS i, ws FROM t), c AS (SELECT ws[i] AS center, unnest(list_concat(ws[greatest(i - 2, 1):i - 1], ws[i + 1:i + 2])) AS context FROM p) SELECT center, context, count(*)::BIGINT AS n FROM c GROUP BY ALL")
def context_pairs(spark, sf):
    ws = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0))
    rows = table(spark, sf, "benchmark").select(ws.alias("ws")).select("ws", F.posexplode("ws").alias("i", "center"))
    before = F.slice("ws", F.greatest(F.col("i") - 1, F.lit(1)), F.least(F.col("i"), F.lit(2)))
    return rows.select("center", F.explode(F.concat(before, F.slice("ws", F.col("i") + 2, F.lit(2)))).alias("context")).groupBy("center", "context").agg(F.count("*").alias("n"))


@query("SELECT l.doc_id, quality::BIGINT AS quality FROM labels l ANTI JOIN (SELECT doc_id FROM documents WHERE lang = 'en') e ON l.doc_id = e.doc_id")
def anti_join_skip(spark, sf):
    en = table(spark, sf, "documents").where("lang = 'en'").select("doc_id")
    return table(spark, sf, "labels").join(en, "doc_id", "left_anti").select("doc_id", F.col("quality").cast("long").alias("quality"))


@query("SELECT md5(text) AS k FROM conversations SEMI JOIN (SELECT DISTINCT md5(text) AS h FROM conversations WHERE role = 'user') u ON md5(text) = u.h")
def cache_hits(spark, sf):
    rows = table(spark, sf, "conversations").select("role", F.md5(F.encode("text", "UTF-8")).alias("k"))
    return rows.join(rows.where("role = 'user'").select(F.col("k").alias("h")).distinct(), F.col("k") == F.col("h"), "left_semi").select("k")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf):
    rows = E.windowed_counts(table(spark, sf, "events"))
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
