"""Queries over word graphs, nested answers, components, and models fitted across the cluster, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions import text as T
from ..functions.phrases import converted
from ..operators import corpus as C
from ..operators import fitting as L
from ..operators import graphnet as N
from ..operators import ml as M
from ..operators import segment as Z
from ..operators import semi as J
from ..operators import wordgraph as W
from ..sources.datasources import table_manifest
from .catalogue import _KEY, _M1, _M2, _M3, _REASON, LATIN, _clean_sql, _methods, _vectors, query, table


def _digest(df):
    """doc_id, the number of tokens and the md5 of the tokens."""
    return df.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ").cast("binary")).alias("tokens_md5"))


def _dictionary(spark, sf):
    return W.Dictionary.of(W.learnt(table(spark, sf, "documents")))


@query()
def seg_rule(spark, sf):
    return _digest(W.segmented(table(spark, sf, "documents").select("doc_id", "text"), _dictionary(spark, sf)))


@query()
def seg_search(spark, sf):
    return _digest(W.segmented(table(spark, sf, "documents").select("doc_id", "text"), _dictionary(spark, sf), "search"))


@query()
def seg_full(spark, sf):
    return _digest(W.segmented(table(spark, sf, "documents").select("doc_id", "text"), _dictionary(spark, sf), "full"))


@query()
def tag_counts(spark, sf):
    """How often the rule tokenizer gives each tag, by language."""
    tagged = W.segmented(table(spark, sf, "documents").select("lang", "text"), _dictionary(spark, sf), tagged=True)
    return tagged.select("lang", F.explode("tokens.tag").alias("tag")).groupBy("lang", "tag").agg(F.count("*").alias("n"))


# Nested answers. Each event is answered for: its items stand under a name, or under none, and some answers are short.

_NAMES = ("results", "segments", "result", "data", "output", "zeta")
_ITEMS_SQL = "[event_type, props, user_id::VARCHAR]"


def _answer(spark, sf):
    items = F.array(F.to_json(F.struct(F.col("event_type").alias("t"))), "props", F.col("user_id").cast("string"))
    listed = F.concat(F.lit("["), F.array_join(F.when(F.col("event_id") % 5 == 0, F.slice(items, 1, 2)).otherwise(items), ", "), F.lit("]"))
    k = F.col("event_id") % 9
    name = F.element_at(F.array(*map(F.lit, _NAMES)), F.least(k, F.lit(5)).cast("int") + 1)
    wrapped = F.concat(F.lit('{"note": 1, "'), name, F.lit('": '), listed, F.lit(', "alpha": []}'))
    answer = F.when(k == 6, listed).when(k == 7, F.concat(F.lit("```json\n"), wrapped, F.lit("\n```"))).when(k == 8, F.lit("no answer")).otherwise(wrapped)
    return table(spark, sf, "events").select("event_id", answer.alias("answer"))


@query(
    "WITH e AS (SELECT *, event_id % 9 AS k, CASE WHEN event_id % 5 = 0 THEN 2 ELSE 3 END AS n FROM events) "
    "SELECT event_id, k <> 8 AND n = 3 AS ok, CASE WHEN k <> 8 THEN n END::BIGINT AS n_items, "
    "CASE WHEN k <> 8 AND n = 3 THEN '{\"t\":\"' || event_type || '\"}|{\"k\":' || (props->>'k') || '}|' || user_id END AS items FROM e"
)
def answers_unwrapped(spark, sf):
    return J.answers(_answer(spark, sf), "answer", F.lit(3)).select("event_id", "ok", "n_items", F.array_join("items", "|").alias("items"))


@query(
    "WITH e AS (SELECT event_id % 9 AS k, CASE WHEN event_id % 5 = 0 THEN 2 ELSE 3 END AS n FROM events WHERE event_id % 9 < 6), "
    "p AS (SELECT ['results', 'segments', 'result', 'data', 'output', 'zeta'][k + 1] AS key, 'ARRAY' AS kind, n FROM e UNION ALL SELECT 'note', 'BIGINT', 1 FROM e UNION ALL SELECT 'alpha', 'ARRAY', 0 FROM e) "
    "SELECT key, kind, count(*)::BIGINT AS answers, sum(n)::BIGINT AS n_items FROM p GROUP BY ALL"
)
def payload_sizes(spark, sf):
    parts = J.payload_parts(_answer(spark, sf).where(F.col("event_id") % 9 < 6), "answer")
    return parts.groupBy("key", "kind").agg(F.count("*").alias("answers"), F.sum("n_items").alias("n_items"))


_ROW = "concat_ws(chr(1), d.doc_id::VARCHAR, coalesce(d.text, chr(0)), coalesce(d.lang, chr(0)), coalesce(d.source, chr(0)), coalesce(d.n_chars::VARCHAR, chr(0)))"


@query(
    f"WITH r AS (SELECT lang, md5({_ROW}) AS h FROM documents d), l AS (SELECT lang, count(*) AS n FROM r GROUP BY lang) "
    "SELECT '' AS part, count(*)::BIGINT AS n_rows, 5::BIGINT AS n_columns, 0::BIGINT AS missing, (count(*) - count(DISTINCT h))::BIGINT AS duplicated, "
    "(SELECT '{' || string_agg('\"' || lang || '\":' || n, ',' ORDER BY lang) || '}' FROM l) AS labels, (sum(('0x' || left(h, 15))::BIGINT::HUGEINT))::VARCHAR AS digest FROM r"
)
def dataset_manifest(spark, sf):
    return table_manifest(table(spark, sf, "documents"), "lang")


# Components and models over whole tables


@query(
    "WITH x AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1)::BIGINT - 1 AS d FROM embeddings), m AS (SELECT d, avg(x) AS m FROM x GROUP BY d), c AS (SELECT id, d, x - m AS x FROM x JOIN m USING (d)) "
    "SELECT a.d AS i, b.d AS j, round(avg(a.x * b.x), 7) AS covariance FROM c a JOIN c b ON a.id = b.id AND a.d <= b.d GROUP BY ALL"
)
def covariances(spark, sf):
    sums = L.moments(_vectors(spark, sf), "vec", 64)
    n = sums.where("i = 0 AND j = 0").select(F.col("x").alias("n"))
    mean = sums.where("i = 0 AND j > 0").select("j", F.col("x").alias("s"))
    both = sums.where("i > 0 AND j >= i").join(mean, "j").join(mean.select(F.col("j").alias("i"), F.col("s").alias("t")), "i").join(F.broadcast(n))  # one row
    value = F.col("x") / F.col("n") - F.col("s") * F.col("t") / (F.col("n") * F.col("n"))
    return both.select((F.col("i") - 1).alias("i"), (F.col("j") - 1).alias("j"), F.round(value, 7).alias("covariance"))


@query()
def pca_2d(spark, sf):
    vectors = _vectors(spark, sf)
    x, y = L.projected(F.col("vec"), L.components(vectors, "vec", 64, 2))
    return vectors.select("id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


_TEXT_FEATURES = ["chars", "words", "capitals", "marks", "spread"]


def _text_features(spark, sf):
    """Every labelled document with numbers of its whole text, each between 0 and about 1."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.greatest(F.length("text"), F.lit(1))
    docs = table(spark, sf, "documents").select(
        "doc_id",
        (F.log1p(F.length("text").cast("double")) / 12).alias("chars"),
        (F.size(words) / n).alias("words"),
        (F.regexp_count("text", F.lit("[A-Z]")) / n).alias("capitals"),
        (F.regexp_count("text", F.lit("[#*$%&|<>]")) / n).alias("marks"),
        (F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1))).alias("spread"),
    )
    return docs.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


@query()
def logistic_documents(spark, sf):
    """Quality by gradient descent over all labelled documents."""
    rows = M.standardize(_text_features(spark, sf), _TEXT_FEATURES)
    return M.logistic_predict(rows, _TEXT_FEATURES, "quality", rate=0.5, rounds=200).select("doc_id", "quality", F.round("p", 6).alias("p"), "predicted")


@query()
def tree_documents(spark, sf):
    """Quality by an exact tree over all labelled documents."""
    return M.tree_column(_text_features(spark, sf), _TEXT_FEATURES, "quality").select("doc_id", "quality", "predicted")


# Phrases, and helpers with a query of their own

#: Phrases that overlap, nest and start in one another.
_PHRASES = ("the", "then", "thener", "er the", "of the", "tion", "tionen", "en", "ent", "nt", "hat", "that", "a", "ion er", "schen", "ung der", "ción", "eaux", "th", "erth")


@query(
    f"SELECT doc_id, md5(regexp_replace(text, '{'|'.join(sorted(_PHRASES, key=lambda p: -len(p)))}', '<\\0>', 'g')) AS marked_md5 FROM documents"
)
def phrases_marked(spark, sf):
    marked = converted(F.col("text"), {p: f"<{p}>" for p in _PHRASES}, where=None)
    return table(spark, sf, "documents").select("doc_id", F.md5(F.encode(marked, "UTF-8")).alias("marked_md5"))


_SHORT = T.SHORT_COMMENT


@query(
    f"WITH {_clean_sql('doc_id')} SELECT doc_id, CASE WHEN length(t) < 2 THEN 'too_short' WHEN length(t) > 400 THEN 'too_long' WHEN regexp_matches(t, '^[^\\p{{L}}]+$') THEN 'digits_or_symbol_only' "
    f"WHEN length({_KEY}) / greatest(length(t), 1)::DOUBLE < 0.15 THEN 'punctuation_dominant' WHEN " + " OR ".join(f"contains(lower(t), '{w.lower()}')" for w in _SHORT.ads) + " THEN 'advertisement' END AS reason FROM c"
)
def short_comment_reasons(spark, sf):
    rows = C.cleaned(table(spark, sf, "documents"), without=LATIN)
    return rows.select("doc_id", T.invalid_reason(F.col("text_clean"), _SHORT).alias("reason"))


_LEVEL = "['超预期', '很棒', '满意', '不错', '一般', '差', '不满意', '', 'x'][doc_id % 9 + 1]"


@query(
    f"WITH l AS (SELECT doc_id, {_LEVEL} AS level FROM documents) SELECT doc_id, CASE WHEN level IN ('超预期', '很棒', '满意', '不错') THEN '正面' WHEN level = '一般' THEN '中性' WHEN level IN ('差', '不满意') THEN '负面' ELSE '无法判断' END AS label, "
    "CASE level WHEN '超预期' THEN 50 WHEN '很棒' THEN 50 WHEN '满意' THEN 40 WHEN '不错' THEN 40 WHEN '一般' THEN 30 WHEN '差' THEN 20 WHEN '不满意' THEN 10 WHEN '' THEN 0 END::BIGINT AS star FROM l"
)
def level_labels(spark, sf):
    level = F.element_at(F.array(*map(F.lit, [*T.LEVELS, "x"])), (F.col("doc_id") % 9 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", T.level_label(level).alias("label"), T.level_star(level).cast("long").alias("star"))


@query("SELECT doc_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0::DOUBLE) ELSE printf('%.1f MB', b / 1048576.0::DOUBLE) END AS size FROM (SELECT doc_id, strlen(text) * 7 AS b FROM documents)")
def text_sizes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.human_bytes(F.octet_length("text") * 7).alias("size"))


@query("SELECT doc_id, len(w)::BIGINT AS n, md5(array_to_string(w, ' ')) AS tokens_md5 FROM (SELECT doc_id, list_filter(regexp_split_to_array(translate(lower(text), '.,!?''\"', ''), '\\s+'), lambda x: x <> '') AS w FROM documents)")
def latin_words(spark, sf):
    w = T.latin_tokens(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(w).cast("long").alias("n"), F.md5(F.encode(F.array_join(w, " "), "UTF-8")).alias("tokens_md5"))


@query("SELECT event_id, round(1 / (1 + exp(-greatest(least((value - 50) / 10, 250), -250))), 6) AS p FROM events")
def event_odds(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(S.sigmoid((F.col("value") - 50) / 10), 6).alias("p"))


@query("SELECT count(*)::BIGINT AS n, (count(*) FILTER (doc_id % 4 <> 0 OR NOT regexp_matches(text, '[\\p{L}\\p{N}]')))::BIGINT AS consistent FROM documents")
def token_consistency(spark, sf):
    """Tokens that are the text pass the check; where the first token is missing they do not."""
    tokens = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"), F.lit(0))
    given = F.when((F.col("doc_id") % 4 == 0) & F.col("text").rlike(r"[\p{L}\p{N}]"), F.slice(tokens, F.lit(2), F.size(tokens))).otherwise(tokens)
    ok = Z.consistent(F.col("text"), given)
    return table(spark, sf, "documents").agg(F.count("*").alias("n"), F.count_if(ok).alias("consistent"))


@query("SELECT split, lang, count(*)::BIGINT AS n FROM (SELECT lang, CASE WHEN r <= floor(0.9 * n + 0.5) THEN 'train' ELSE 'test' END AS split FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR || ':42'), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)) GROUP BY ALL")
def split_class_counts(spark, sf):
    """The classes of a 90/10 split."""
    return M.stratified_split(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", "lang", 0.9).groupBy("split", "lang").agg(F.count("*").alias("n"))


@query(
    f"WITH {_clean_sql('doc_id, text')}, r AS (SELECT doc_id, {_REASON} AS reason, left(text, 60) AS example FROM c) SELECT reason, doc_id, example FROM r WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY reason ORDER BY doc_id) <= 3"
)
def dropped_examples(spark, sf):
    """The first three texts that each rule drops."""
    rows = C.cleaned(table(spark, sf, "documents"), without=LATIN)
    # Exploded from an array of one, as the filter would work the reason out once more.
    rows = rows.select("doc_id", F.explode(F.array(T.invalid_reason(F.col("text_clean")))).alias("reason"), F.left("text", F.lit(60)).alias("example")).where("reason IS NOT NULL")
    return C.head_of_groups(rows, ["reason"], [F.col("doc_id")], 3).select("reason", "doc_id", "example")


@query("SELECT date_trunc('month', o_orderdate)::DATE::VARCHAR AS month, o_orderpriority AS series, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def figure_series(spark, sf):
    """The numbers behind a figure of monthly series."""
    month = F.date_format(F.trunc("o_orderdate", "month"), "yyyy-MM-dd")
    return table(spark, sf, "orders").groupBy(month.alias("month"), F.col("o_orderpriority").alias("series")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query()
def graph_network(spark, sf):
    """Labels of embeddings by two graph convolutions over their five nearest neighbours; a fifth of the rows is held out."""
    vectors = _vectors(spark, sf)
    names = [f"x{k}" for k in range(64)]
    held = F.col("id") % 5 == 0
    classes = (vectors.agg(F.max("label")).first()[0] or 0) + 1
    nodes = vectors.select("id", *[F.get("vec", F.lit(k)).cast("double").alias(c) for k, c in enumerate(names)], F.col("label").alias("y"), (~held).alias("train"))
    graph = N.Graph(nodes, N.nearest_edges(vectors), names, classes)
    found = graph.predict(graph.fit())
    return vectors.select("id", "label", held.alias("held_out")).join(found, "id")


# Where several segmenters agree, as offsets in the text itself

_ALIGNED = "".join(
    f"a{k} AS (SELECT doc_id, length(text) AS n, unnest(regexp_extract_all(text, '{p}')) AS t, unnest(regexp_split_to_array(text, '{p}')[1:len(regexp_extract_all(text, '{p}'))]) AS gap, "
    f"generate_subscripts(regexp_extract_all(text, '{p}'), 1) AS i FROM documents), e{k} AS (SELECT doc_id, n, (sum(length(gap) + length(t)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS p FROM a{k}), "
    for k, p in ((1, _M1), (2, _M2), (3, _M3))
)


@query(
    f"WITH {_ALIGNED} v AS (SELECT doc_id, p FROM (SELECT * FROM e1 UNION ALL SELECT * FROM e2 UNION ALL SELECT * FROM e3) WHERE p < n GROUP BY ALL HAVING count(*) >= 3) "
    "SELECT d.doc_id, count(v.p)::BIGINT AS n, coalesce(sum(v.p), 0)::BIGINT AS place_sum FROM documents d LEFT JOIN v USING (doc_id) GROUP BY d.doc_id"
)
def seg_consensus_aligned(spark, sf):
    c = Z.consensus(_methods(spark, sf), ["m1", "m2", "m3"], 3, "x")
    placed = _methods(spark, sf).select("doc_id", c.alias("c"))
    return placed.select("doc_id", F.size("c").cast("long").alias("n"), F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + x).alias("place_sum"))
