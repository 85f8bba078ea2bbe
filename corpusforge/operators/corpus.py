"""Cleaning, validity, dedup, reports and corpus profiles over tables of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by a total order (W3, O9, O10): a minimum of structs, summed before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = df.groupBy(*keys).agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_row"))
    return packed.select(*[F.col(k) for k in keys], *[F.col(f"_row.{c}").alias(c) for c in (*order, *rest)]).select(*df.columns)


def head_of_groups(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """At most n rows a group, by the order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def cleaned(df: DataFrame, text: str = "text", profile: T.Profile = T.SITE_REVIEW, without: tuple[str, ...] = ()) -> DataFrame:
    """The rows with text_clean. It is exploded from an array of one, which keeps later filters from repeating its work."""
    return df.drop("text_clean").select("*", F.explode(F.array(T.clean(F.col(text), profile, without))).alias("text_clean"))


def step_counts(df: DataFrame, text: str = "text", profile: T.Profile = T.SITE_REVIEW, steps: tuple[str, ...] = ("newline", "markup", "links", "topic", "bracket", "emoji", "control", "half", "space", "strip")) -> DataFrame:
    """How many rows each cleaning step changed (A2), in one pass."""
    out = df.select(F.coalesce(F.col(text), F.lit("")).alias("_0"))
    for k, name in enumerate(steps):
        out = out.withColumn(f"_{k + 1}", T.step(name, F.col(f"_{k}"), profile))
    return out.agg(*[F.coalesce(F.sum((F.col(f"_{k}") != F.col(f"_{k + 1}")).cast("long")), F.lit(0).cast("long")).alias(f"n_{name}") for k, name in enumerate(steps)])


def valid_unique(df: DataFrame, scope: str, order: str, profile: T.Profile = T.SITE_REVIEW, without: tuple[str, ...] = ()) -> DataFrame:
    """Clean, drop invalid rows, clip, keep the first of equal texts and then of equal keys within the scope."""
    rows = cleaned(df, profile=profile, without=without).where(T.invalid_reason(F.col("text_clean"), profile).isNull())
    rows = rows.withColumn("text_clean", T.clip(F.col("text_clean"), profile.clip))
    rows = rows.withColumn("dedup_key", T.dedup_key(F.col("text_clean")))
    return keep_first(keep_first(rows, [scope, "text_clean"], [order]), [scope, "dedup_key"], [order])


def valid_unique_keys(df: DataFrame, scope: str, order: str, profile: T.Profile = T.SITE_REVIEW, without: tuple[str, ...] = ()) -> DataFrame:
    """The rows of `valid_unique` without their texts: scope, order, n_chars and text_md5; no text is shuffled."""
    rows = cleaned(df.select(scope, order, "text"), profile=profile, without=without).where(T.invalid_reason(F.col("text_clean"), profile).isNull())
    md5 = lambda c: F.md5(F.encode(c, "UTF-8"))
    rows = rows.select(scope, order, F.explode(F.array(T.clip(F.col("text_clean"), profile.clip))).alias("t"))
    rows = rows.select(scope, order, F.length("t").alias("n_chars"), md5(F.col("t")).alias("text_md5"), md5(T.dedup_key(F.col("t"))).alias("key_md5"))
    return keep_first(keep_first(rows, [scope, "text_md5"], [order]), [scope, "key_md5"], [order])


def words(df: DataFrame, text: str = "text") -> DataFrame:
    """One row a word: lower-case runs of letters and digits, with the other columns."""
    return df.withColumn("token", F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))))


def top_tokens(df: DataFrame, n: int, keys: list[str] | None = None) -> DataFrame:
    """The n most frequent tokens, of each key if keys are given; ties by token."""
    counts = df.groupBy(*(keys or []), "token").agg(F.count("*").alias("n"))
    order = [F.desc("n"), F.asc("token")]
    return head_of_groups(counts, keys, order, n) if keys else counts.orderBy(*order).limit(n)


def log_odds(counts: DataFrame, least: int = 8, prior: float = 0.01) -> DataFrame:
    """Log-odds with an informative prior and z (A17); counts: token, label (0 or 1), n."""
    two = counts.groupBy("token").agg(F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("y0"), F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("y1"))
    total = two.agg(F.sum("y0").alias("n0"), F.sum("y1").alias("n1"))
    n, a0 = F.col("n0") + F.col("n1"), prior * (F.col("n0") + F.col("n1"))
    w = a0 * (F.col("y0") + F.col("y1")) / n
    p = [(F.col(f"y{k}") + w) / (F.col(f"n{k}") + a0) for k in (0, 1)]
    logit = [F.log(x / (1 - x)) for x in p]
    z = (logit[0] - logit[1]) / F.sqrt(1 / (F.col("y0") + w) + 1 / (F.col("y1") + w))
    scored = two.where(F.col("y0") + F.col("y1") >= least).join(F.broadcast(total))  # one row
    return scored.select("token", F.col("y0").cast("long"), F.col("y1").cast("long"), F.round(logit[0] - logit[1], 4).alias("log_odds"), F.round(z, 3).alias("z"))


def tf_idf(counts: DataFrame, features: int = 4000) -> DataFrame:
    """TF-IDF of class documents (A18): counts of token and label; the most frequent tokens, L2 norm by class."""
    kept = counts.where(F.length("token") >= 2)
    top = kept.groupBy("token").agg(F.sum("n").alias("total"), F.count("*").alias("df")).orderBy(F.desc("total"), "token").limit(features)
    classes = kept.agg(F.countDistinct("label").alias("classes"))
    weight = F.col("n") * (F.log((1 + F.col("classes")) / (1 + F.col("df"))) + 1)
    rows = kept.join(top, "token").join(F.broadcast(classes)).select("label", "token", weight.alias("w"))  # one row
    norm = rows.groupBy("label").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return rows.join(norm, "label").select("label", "token", (F.col("w") / F.col("norm")).alias("tfidf"))


def grams_of(run: Column, n: int) -> Column:
    """All n-grams of characters of a string, in one pass: a substring by place would walk from the beginning each time."""
    return F.regexp_extract_all(run, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))


def char_ngrams(df: DataFrame, n: int, text: str = "text") -> DataFrame:
    """Counts of the n-grams of characters within runs of letters."""
    runs = df.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\p{L}+"), F.lit(0))).alias("r")).groupBy("r").agg(F.count("*").alias("m")).where(F.length("r") >= n)
    grams = runs.select("m", F.explode(grams_of(F.col("r"), n)).alias("gram"))
    return grams.groupBy("gram").agg(F.sum("m").alias("n"))


def pmi_vocabulary(df: DataFrame, text: str = "text", least: int = 3, top: int = 4000, power: float = 1.5, score: float = 4.0) -> DataFrame:
    """Bigrams with their pointwise mutual information and score (A24); all three shares over the character total."""
    one = char_ngrams(df, 1, text)
    two = char_ngrams(df, 2, text).orderBy(F.desc("n"), "gram").limit(top).where(F.col("n") >= least)
    total = one.agg(F.sum("n").alias("chars"))
    part = lambda k, at: one.select(F.col("gram").alias(f"c{k}"), F.col("n").alias(f"n{k}"))
    rows = two.withColumn("c1", F.substring("gram", 1, 1)).withColumn("c2", F.substring("gram", 2, 1)).join(part(1, 1), "c1").join(part(2, 2), "c2").join(F.broadcast(total))  # one row
    pmi = F.log(F.col("n").cast("double") * F.col("chars") / (F.col("n1").cast("double") * F.col("n2")))
    return rows.select("gram", "n", pmi.alias("pmi")).withColumn("score", F.col("n") * F.col("pmi") * F.pow(F.lit(2.0), F.lit(power))).where(F.col("score") >= score)


def near_rate(df: DataFrame, text: str = "text") -> Column:
    key = T.dedup_key(F.col(text))
    return 1 - F.countDistinct(key) / F.greatest(F.count("*"), F.lit(1))


def dataset_profile(df: DataFrame, text: str, label: str) -> DataFrame:
    """Rows, missing, duplicates, classes, imbalance, lengths."""
    by = df.groupBy(label).agg(F.count("*").alias("k"))
    sizes = by.agg(F.count("*").alias("classes"), (F.max("k") / F.greatest(F.min("k"), F.lit(1))).alias("imbalance"))
    whole = df.agg(
        F.count("*").alias("rows"),
        F.sum(F.col(text).isNull().cast("long")).alias("missing"),
        (F.count("*") - F.countDistinct(text)).alias("duplicates"),
        F.avg(F.length(text)).alias("mean_len"),
        F.expr(f"percentile(length({text}), 0.5)").cast("long").alias("median_len"),
        F.max(F.length(text)).cast("long").alias("max_len"),
    )
    return whole.join(F.broadcast(sizes))  # one row each


def correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of each pair in long form (A19), in one pass."""
    pairs = [(a, b) for a in columns for b in columns]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])).alias("x")).select("x.*")


def all_in(columns: list[str], values: list) -> Column:
    """Whether every one of the columns has one of the values."""
    found = F.lit(True)
    for c in columns:
        found = found & F.col(c).isin(values)
    return found


def of_length(df: DataFrame, text: str, least: int, most: int) -> DataFrame:
    return df.where(F.length(text).between(least, most))


def numeric(df: DataFrame) -> list[str]:
    """The numeric columns."""
    from pyspark.sql.types import NumericType

    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def overview(df: DataFrame) -> DataFrame:
    """name, type, missing, n of every column (P13), in one pass."""
    one = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"m_{c}") for c in df.columns])
    rows = [F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f"m_{f.name}").alias("missing"), F.col("n")) for f in df.schema]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def lookup(df: DataFrame, known: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    """The rows with the value of their key, or the default."""
    return df.join(known.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), default))


def distinct_chars(df: DataFrame, text: str = "text") -> DataFrame:
    """How many different characters the texts have (A16); each text sends its own only once."""
    own = F.array_distinct(F.split(F.col(text), ""))
    return df.select(F.explode(own).alias("c")).where("c <> ''").distinct().agg(F.count("*").alias("chars"))


def next_chars(df: DataFrame, text: str = "text") -> DataFrame:
    """Counts of each character with the following one."""
    chars = df.select(F.filter(F.split(text, ""), lambda c: c != "").alias("x"))
    pairs = F.arrays_zip(F.slice("x", F.lit(1), F.greatest(F.size("x") - 1, F.lit(0))).alias("c"), F.slice("x", F.lit(2), F.size("x")).alias("following"))
    return chars.where(F.size("x") > 1).select(F.explode(pairs).alias("r")).select("r.c", "r.following").groupBy("c", "following").agg(F.count("*").alias("n"))
