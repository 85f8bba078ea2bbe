"""Filter interaction audit by the Walsh-Hadamard transform.

A document's failures of five filters are a mask of five bits. For each part and label (all documents, good ones, toxic ones)
32 sums are formed, one for each set s of filters: a document adds +1 if it fails an even number of the filters in s, else
-1. The sums are linear, so they are added up before and after the shuffle and no mask is ever grouped by; the transform is its
own inverse but for the factor 32, so 32 signed sums of them, shifted right by 5 bits, are the exact counts of the 32 masks.
From these cells every step of every order follows without another look at the documents: what a filter removes behind given
others is a sum of cells, and its Shapley number over all 120 orders is closed: of a document's k failed filters each
comes first in 120 / k orders.

Filters: A under 50 words; B 100 * different words < 65 * words; C 100 * capitals A-Z > 5 * code points; D any of `#$%&*|`;
E the text is that of a smaller doc_id. A to D depend on the text alone; E needs the smallest doc_id of each text: rows are
counted by document, then by text, part and label, and only these counts meet by the text's digest (at most three
labels' rows a part, however many copies there are).

Defined results: a null or empty text has no words, so it fails A and not B or C; null and empty texts are equal; a null
doc_id is never a copy and makes none, and has no label; rows that share the smallest doc_id and the text are no copies of each
other; a null source is the part of the empty string; a document that several label rows name is good (toxic) if one says so; repeated
rows count each; an empty table gives an empty result; other columns are never read; texts are taken whole.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
COPY = 1 << FILTERS.index("E")
LABELS = ("all", "good", "toxic")
#: Rows without a doc_id are dealt to so many parts of the join.
SALTS = 64


def _fails(text: Column) -> Column:
    """The mask of the filters A to D."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, different = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    rules = (n < 50, 100 * different < 65 * n, 100 * capitals > 5 * F.length(text), text.rlike("[#$%&*|]"))
    return sum((F.when(rule, 1 << k).otherwise(0) for k, rule in enumerate(rules)), F.lit(0)).cast("int")


def _even(a: Column, b: Column) -> Column:
    """+1 if the two masks share an even number of bits, else -1."""
    return 1 - 2 * F.bit_count(a.bitwiseAND(b)).bitwiseAND(F.lit(1))


def counted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents by part, label and mask of A to D: part, good, toxic, mask, kept_n and copy_n (those that E fails).

    Rows are counts of equal texts in a part, not yet summed over texts.
    """
    text = F.coalesce("text", F.lit(""))
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0).cast("int")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        salt.alias("salt"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        _fails(text).alias("mask"),
    )
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    no = F.lit(False)
    known = rows.join(marks.withColumn("salt", F.lit(0)), ["doc_id", "salt"], "left").select(
        "doc_id", "salt", "part", "digest", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")
    )
    group = ["digest", "part", "mask", "good", "toxic"]
    by_document = known.groupBy("doc_id", "salt", *group).agg(F.count("*").alias("n"))
    by_text = by_document.groupBy(*group).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"),
        F.min("doc_id").alias("first"),
        F.min_by(F.when(F.col("doc_id").isNotNull(), F.col("n")), "doc_id").alias("of_first"),
    )
    first = F.min("first").over(Window.partitionBy("digest"))
    kept = F.col("unnamed") + F.when(F.col("first") == first, F.col("of_first")).otherwise(0)
    return by_text.select("part", "good", "toxic", "mask", "n", kept.alias("kept_n")).select(
        "part", "good", "toxic", "mask", "kept_n", (F.col("n") - F.col("kept_n")).alias("copy_n")
    )


def parities(counts: DataFrame) -> DataFrame:
    """The 32 signed sums of every part and label: part, label, sums."""
    label = F.array(F.lit("all"), F.when(F.col("good"), F.lit("good")), F.when(F.col("toxic"), F.lit("toxic")))
    by_label = counts.select("part", "mask", "kept_n", "copy_n", F.explode(F.array_compact(label)).alias("label"))
    sums = []
    for s in range(MASKS):
        copies = -F.col("copy_n") if s & COPY else F.col("copy_n")
        sums.append(F.sum(_even(F.col("mask"), F.lit(s)) * (F.col("kept_n") + copies)).alias(f"s{s}"))
    return by_label.groupBy("part", "label").agg(*sums).select("part", "label", F.array(*(F.col(f"s{s}") for s in range(MASKS))).alias("sums"))


def cells(sums: DataFrame) -> DataFrame:
    """The exact count of every mask, by part and label: part, all, good, toxic (arrays of 32; null: no such label)."""
    every = F.sequence(F.lit(0), F.lit(MASKS - 1))
    zero = F.lit(0).cast("bigint")

    def cell(m: Column) -> Column:
        terms = F.transform(F.col("sums"), lambda total, s: total * _even(m, s))
        return F.shiftright(F.aggregate(terms, zero, lambda a, b: a + b), len(FILTERS))

    masks = sums.select("part", "label", F.transform(every, cell).alias("cells"))
    return masks.groupBy("part").agg(*(F.first(F.when(F.col("label") == name, F.col("cells")), ignorenulls=True).alias(name) for name in LABELS))


def _steps() -> Column:
    """Every step of every order: filter_order, step, mine (the filter's bit), prior (the bits of those before it)."""
    found = []
    for order in permutations(FILTERS):
        prior = 0
        for k, letter in enumerate(order):
            mine = 1 << FILTERS.index(letter)
            found.append(f"named_struct('filter_order', '{''.join(order)}', 'step', {k + 1}, 'mine', {mine}, 'prior', {prior})")
            prior |= mine
    return F.expr(f"array({', '.join(found)})")


def orders(masks: DataFrame) -> DataFrame:
    """What each step of each order keeps, removes and loses: one row a part, order and step, from the cells."""
    zero = F.lit(0).cast("bigint")

    def total(name: str, where) -> Column:
        """The sum of the label's cells whose mask passes; `where` may give a weight instead of a truth value."""
        weighed = F.transform(F.col(name), lambda n, m: n * where(m).cast("bigint"))
        return F.coalesce(F.aggregate(weighed, zero, lambda a, b: a + b), zero)

    mine, prior = F.col("mine"), F.col("prior")
    fails = lambda m: m.bitwiseAND(mine) != 0
    new = lambda m: fails(m) & (m.bitwiseAND(prior) == 0)
    all_orders = 120
    return masks.select("*", F.inline(_steps())).select(
        "part",
        "filter_order",
        "step",
        total("all", lambda m: m.bitwiseAND(mine.bitwiseOR(prior)) == 0).alias("kept"),
        total("all", new).alias("removed"),
        total("all", lambda m: fails(m) & (m.bitwiseAND(prior) != 0)).alias("redundant"),
        total("all", lambda m: m == mine).alias("unique_fails"),
        total("good", new).alias("good_lost"),
        total("toxic", new).alias("toxic_lost"),
        total("all", lambda m: F.when(fails(m), F.lit(all_orders) / F.bit_count(m)).otherwise(0)).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over all documents, by part (their source)."""
    return orders(cells(parities(counted(docs, labels))))


#: The same rows from the documents themselves: every order is applied filter by filter.
SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), firsts AS (
  SELECT text, min(doc_id) AS first_id FROM docs GROUP BY text
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), worded AS (
  SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM docs
), failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > first_id THEN 16 ELSE 0 END AS fails
  FROM worded JOIN firsts USING (text) LEFT JOIN marks USING (doc_id)
), grouped AS (
  SELECT part, good, toxic, fails, count(*) AS n FROM failed GROUP BY part, good, toxic, fails
), letters(letter, bit) AS (
  VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, step, bits[step] AS mine, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS prior
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), applied AS (
  SELECT part, filter_order, step, mine,
    sum(CASE WHEN fails & (prior | mine) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN fails & prior = 0 AND fails & mine <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails & prior <> 0 AND fails & mine <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = mine THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails & prior = 0 AND fails & mine <> 0 THEN n * good ELSE 0 END) AS good_lost,
    sum(CASE WHEN fails & prior = 0 AND fails & mine <> 0 THEN n * toxic ELSE 0 END) AS toxic_lost
  FROM grouped, steps GROUP BY part, filter_order, step, mine
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, mine))::BIGINT AS shapley
FROM applied
"""
