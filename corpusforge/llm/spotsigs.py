"""SpotSigs fingerprints with DataFrame functions only.

A signature is an anchor (a very common word) with the next `CHAIN` content words after it, other anchors
skipped. A text's fingerprint is the set of its signatures' 64-bit hashes, sorted. Two fingerprints are compared
by their Jaccard likeness. `similar_pairs` finds every pair of at least the threshold: fingerprints are
partitioned by set length (a pair's lengths differ by at most the factor of the threshold), each is indexed by its
rarest signatures only (as many as any partner must share one of), and the bound by lengths prunes before the
sets are intersected.

Defined results: words are runs of letters and digits, in lower case. A text with no full chain after an anchor
(another language, only names, a word or two) takes every word as an anchor; with fewer words than a chain, the
whole lower-case text is its one signature, so a null text, the empty text and white space are each like
themselves. Equal texts have equal fingerprints. Repeated rows and equal doc_ids are kept, in the order of doc_id,
then of the text; null doc_ids come last. An empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import runtime

#: The anchors: common function words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be but by for from had has have he her his if in is it its not of on or she that the their "
    "there they this to was we were what when which who will with would you "
    "als auf aus bei das dass dem den der des die ein eine einen einer er es für hat ich ihr im ist mit nach nicht "
    "noch nur oder sich sie sind und uns von vor war wie wir zu zum zur über "
    "au aux avec ce cette dans de du elle en est et il ils je la le les leur mais ne nous ou par pas plus pour que qui "
    "sa se ses son sont sur un une vous "
    "al como con cuando del donde el ella ellos era este esta fue ha hay las lo los más mi muy no nos para pero por "
    "si sin sobre son su sus también te tiene todo una uno y ya"
).split()

#: Content words in a chain, and anchors in a row that a chain skips before each; after as many, the next one counts
#: as a content word (so that no text, however odd, makes the pattern search deep).
CHAIN, SKIP = 2, 20

_WORD, _GAP = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]"


def _anchor_pattern() -> str:
    """The anchors as one alternation, grouped by first letter so that few are tried at a word."""
    groups: dict[str, list[str]] = {}
    for word in sorted(set(ANCHORS), key=lambda w: (w[0], -len(w), w)):
        groups.setdefault(word[0], []).append(word[1:])
    return "(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in groups.items()) + f")(?!{_WORD})"


_ANCHOR = _anchor_pattern()
#: At an anchor: it and the next content words; the anchors skipped are never given back.
_SPOT = f"(?<!{_WORD})(?=({_ANCHOR}(?:(?:{_GAP}++{_ANCHOR}){{0,{SKIP}}}+{_GAP}++{_WORD}++){{{CHAIN}}}))"
_PLAIN = f"(?<!{_WORD})(?=({_WORD}++(?:{_GAP}++{_WORD}++){{{CHAIN}}}))"
_SKIPPED = f"{_GAP}++(?:{_ANCHOR}{_GAP}++){{0,{SKIP}}}+"


def signatures(text: Column) -> Column:
    """The sorted set of a text's signature hashes."""
    low = F.lower(F.coalesce(text, F.lit("")))
    spots = F.regexp_extract_all(low, F.lit(_SPOT), F.lit(1))
    plain = F.regexp_extract_all(low, F.lit(_PLAIN), F.lit(1))
    hashes = F.transform(spots, lambda x: F.xxhash64(F.regexp_replace(x, _SKIPPED, " ")))
    words = F.transform(plain, lambda x: F.xxhash64(F.regexp_replace(x, f"{_GAP}++", " ")))
    return F.array_sort(
        F.array_distinct(F.when(F.size(hashes) > 0, hashes).when(F.size(words) > 0, words).otherwise(F.array(F.xxhash64(low))))
    )


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two fingerprints (sets of hashes), 0 to 1."""
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def digest(fingerprint: Column) -> Column:
    """A short text of a fingerprint: its size and the digest of its set."""
    return F.concat_ws(":", F.size(fingerprint), F.md5(F.array_join(fingerprint, ",").cast("binary")))


def fingerprint(df: DataFrame, text: str = "text", out: str = "signatures") -> DataFrame:
    """The rows with their fingerprints; an existing column of that name is replaced."""
    return df.withColumn(out, signatures(F.col(text)))


def similar_pairs(prints: DataFrame, key: str = "doc_id", sets: str = "signatures", threshold: float = 0.8) -> DataFrame:
    """Pairs (a, b, likeness) of fingerprints with at least the threshold; equal sets are one class.

    prints holds key and sets. The result pairs class representatives (their smallest key); `membership` gives
    each key's representative. No pair of different sets is lost: ordered by frequency, two sets of lengths
    m and n with Jaccard t share one of the first m - ceil(t m) + 1 signatures.
    """
    classes = prints.where(F.col(key).isNotNull()).groupBy(F.col(sets).alias("sigs")).agg(F.min(key).alias("rep"))
    classes = classes.withColumn("n", F.size("sigs"))
    single = classes.select("rep", "n", F.explode("sigs").alias("sig"))
    often = single.groupBy("sig").agg(F.count("*").alias("often"))
    ordered = (
        single.join(often, "sig")
        .groupBy("rep", "n")
        .agg(F.array_sort(F.collect_list(F.struct("often", "sig"))).alias("ranked"))
        .withColumn("prefix", (F.col("n") - F.ceil(F.col("n") * threshold) + 1).cast("int"))
    )
    # Length partitions grow by the factor 1 / threshold: a partner lies in the same one or a neighbour.
    part = F.floor(F.log("n") / F.log(F.lit(1 / threshold))).cast("int")
    index = ordered.select("rep", "n", part.alias("part"), F.explode(F.slice("ranked", F.lit(1), F.col("prefix"))).alias("r"))
    index = index.select("rep", "n", "part", F.col("r.sig").alias("sig"))
    left = index.select(F.col("rep").alias("a"), F.col("n").alias("na"), "sig", F.explode(F.array(*[F.col("part") + d for d in (-1, 0, 1)])).alias("part"))
    right = index.select(F.col("rep").alias("b"), F.col("n").alias("nb"), "sig", "part")
    near = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    found = left.join(right, ["sig", "part"]).where(near & (F.col("na") >= F.col("nb") * threshold)).select("a", "b").distinct()
    sets_of = classes.select("rep", "sigs")
    return (
        found.join(sets_of.select(F.col("rep").alias("a"), F.col("sigs").alias("sa")), "a")
        .join(sets_of.select(F.col("rep").alias("b"), F.col("sigs").alias("sb")), "b")
        .select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness"))
        .where(F.col("likeness") >= threshold)
    )


def membership(prints: DataFrame, key: str = "doc_id", sets: str = "signatures") -> DataFrame:
    """Each key with the smallest key that has the same set."""
    reps = prints.groupBy(sets).agg(F.min(key).alias("rep"))
    return prints.select(key, sets).join(reps, sets).select(key, "rep")


def with_next(df: DataFrame, order: str, columns: list[str], buckets: int) -> DataFrame:
    """Adds next_<column>: the value in the next row by descending order; after the last, the first row's.

    Rows are dealt to ranges of the order column, at most `buckets`, so no task holds all. The top row of each range is
    also dealt to the range above it, where it stands last; these few rows are found by a scan of the order column.
    """
    edges = df.agg(F.percentile_approx(order, [k / buckets for k in range(1, buckets)], 10_000).alias("q")).first()["q"] or []
    edges = sorted(set(edges))
    # At most `buckets` ranges: what the driver holds does not grow with the table.
    bucket = F.when(F.col(order).isNull(), F.lit(-1)).otherwise(
        F.aggregate(F.array(*[F.lit(e) for e in edges]).cast(f"array<{df.schema[order].dataType.simpleString()}>"), F.lit(0), lambda n, e: n + (e <= F.col(order)).cast("int"))
        if edges
        else F.lit(0)
    )
    placed = df.withColumn("_bucket", bucket)
    filled = sorted((r["_bucket"], r["top"]) for r in placed.select("_bucket", order).groupBy("_bucket").agg(F.max(order).alias("top")).collect())
    if not filled:
        return placed.select(*df.columns, *[F.col(c).alias(f"next_{c}") for c in columns]).limit(0)
    ranges = [b for b, _ in filled]
    top, above = [None] * (len(edges) + 2), [None] * (len(edges) + 2)
    for k, (b, value) in enumerate(filled):
        top[b + 1], above[b + 1] = value, ranges[(k + 1) % len(ranges)]
    window = Window.partitionBy("_bucket").orderBy("_tail", F.col(order).desc_nulls_last(), *[F.col(c).asc_nulls_first() for c in columns])
    at = F.col("_bucket") + 2
    to = F.element_at(F.array(*[F.lit(x) for x in above]).cast("array<int>"), at)
    is_top = F.col(order).eqNullSafe(F.element_at(F.array(*[F.lit(x) for x in top]).cast(f"array<{df.schema[order].dataType.simpleString()}>"), at))
    copies = F.when(is_top, F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("t")), F.struct(to.alias("b"), F.lit(1).alias("t")))).otherwise(
        F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("t")))
    )
    dealt = placed.withColumn("_copy", F.explode(copies)).drop("_bucket").select(*df.columns, F.col("_copy.b").alias("_bucket"), F.col("_copy.t").alias("_tail"))
    led = dealt.select("*", *[F.lead(c).over(window).alias(f"next_{c}") for c in columns])
    return led.where("_tail = 0").drop("_bucket", "_tail")


def edited(df: DataFrame) -> DataFrame:
    """doc_id, n_chars, digests of the fingerprints of every text and of its edited text, and their likeness."""
    spark = df.sparkSession
    buckets = 4 * max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    base = df.select("doc_id", runtime.whole_text().alias("text"))
    base = fingerprint(base).withColumn("n_chars", F.length("text").cast("long"))
    both = with_next(base, "doc_id", ["text", "signatures"], buckets)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    text = F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.left("next_text", half))
    both = fingerprint(both.withColumn("edited", text), "edited", "edited_signatures")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        digest(F.col("signatures")).alias("fingerprint"),
        digest(F.col("edited_signatures")).alias("edited_fingerprint"),
        likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
        likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"),
    )
