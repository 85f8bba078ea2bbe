"""Rater agreement over long tables (item, rater, label)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import normal_cdf


def pairs(long: DataFrame) -> DataFrame:
    """Each item's pairs of raters a < b."""
    a = long.select("item", F.col("rater").alias("ra"), F.col("label").alias("a"))
    b = long.select("item", F.col("rater").alias("rb"), F.col("label").alias("b"))
    return a.join(b, "item").where("ra < rb")


def contingency(both: DataFrame) -> DataFrame:
    return both.groupBy("ra", "rb", "a", "b").agg(F.count("*").alias("n"))


def cohen(both: DataFrame) -> DataFrame:
    """Po, Pe, kappa, SE, z, p and the 95 % interval of every pair of raters (A29); kappa is null where Pe is 1."""
    table = contingency(both)
    keys = ["ra", "rb"]
    row = table.groupBy(*keys, F.col("a").alias("l")).agg(F.sum("n").alias("x"))
    col = table.groupBy(*keys, F.col("b").alias("l")).agg(F.sum("n").alias("y"))
    total = table.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    chance = row.join(col, [*keys, "l"]).groupBy(*keys).agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    rows = total.join(chance, keys, "left").select(*keys, "n", (F.col("same") / F.col("n")).alias("po"), (F.coalesce("xy", F.lit(0)) / (F.col("n").cast("double") * F.col("n"))).alias("pe"))
    rows = rows.withColumn("kappa", F.when(F.col("pe") < 1, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))))
    rows = rows.withColumn("se", F.when(F.col("pe") < 1, F.sqrt(F.col("po") * (1 - F.col("po")) / (F.col("n") * F.pow(1 - F.col("pe"), 2)))))
    z = F.when(F.col("se") > 0, F.col("kappa") / F.col("se"))
    return rows.withColumn("z", z).withColumn("p", 2 * (1 - normal_cdf(F.abs("z")))).withColumn("low", F.col("kappa") - 1.96 * F.col("se")).withColumn("high", F.col("kappa") + 1.96 * F.col("se"))


def weighted(both: DataFrame, power: int) -> DataFrame:
    """Weighted kappa of ordinal labels with weights |i - j| or its square."""
    keys = ["ra", "rb"]
    table = contingency(both)
    w = lambda a, b: F.pow(F.abs(F.col(a).cast("double") - F.col(b)), F.lit(power))
    seen = table.groupBy(*keys).agg(F.sum(w("a", "b") * F.col("n")).alias("observed"), F.sum("n").alias("n"))
    row = table.groupBy(*keys, F.col("a").alias("i")).agg(F.sum("n").alias("x"))
    col = table.groupBy(*keys, F.col("b").alias("j")).agg(F.sum("n").alias("y"))
    chance = row.join(col, keys).groupBy(*keys).agg(F.sum(w("i", "j") * F.col("x") * F.col("y")).alias("expected"))
    return seen.join(chance, keys).select(*keys, F.when(F.col("expected") > 0, 1 - F.col("observed") * F.col("n") / F.col("expected")).alias("kappa"))


def binary(both: DataFrame) -> DataFrame:
    """The 2 x 2 counts and kappa of labels 0 and 1, of every pair of raters."""
    hit = lambda a, b: F.count_if((F.col("a") == a) & (F.col("b") == b))
    c = both.groupBy("ra", "rb").agg(hit(1, 1).alias("both"), hit(1, 0).alias("first"), hit(0, 1).alias("second"), hit(0, 0).alias("none"))
    n = F.col("both") + F.col("first") + F.col("second") + F.col("none")
    pa, pb = (F.col("both") + F.col("first")) / n, (F.col("both") + F.col("second")) / n
    po, pe = (F.col("both") + F.col("none")) / n, pa * pb + (1 - pa) * (1 - pb)
    return c.withColumn("kappa", F.when(pe < 1, (po - pe) / (1 - pe)))


def distances(both: DataFrame) -> DataFrame:
    """How often ordinal labels are so far apart."""
    return both.groupBy(F.abs(F.col("a") - F.col("b")).cast("long").alias("distance")).agg(F.count("*").alias("n"))


def collapsed(long: DataFrame, groups: dict, others: bool = False) -> DataFrame:
    """Labels by their group (A30's variants); items with a label of no group are left out, unless others keep theirs."""
    group = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])[F.col("label")]
    rows = long.withColumn("label", F.coalesce(group, "label") if others else group)
    return rows if others else rows.join(rows.where("label IS NULL").select("item").distinct(), "item", "left_anti")


def item_counts(long: DataFrame) -> DataFrame:
    return long.groupBy("item", "label").agg(F.count("*").alias("n"))


def fleiss(long: DataFrame) -> DataFrame:
    """Mean agreement, chance agreement, kappa and its SE (A30); raters an item: m, at least 2."""
    counts = item_counts(long)
    items = counts.groupBy("item").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("sq"))
    mean = items.agg(F.count("*").alias("items"), F.avg("m").alias("m"), F.avg((F.col("sq") - F.col("m")) / (F.col("m") * (F.col("m") - 1))).alias("p_bar"))
    total = long.agg(F.count("*").alias("all"))
    share = counts.groupBy("label").agg(F.sum("n").alias("k")).join(F.broadcast(total)).withColumn("pj", F.col("k") / F.col("all"))  # one row
    chance = share.agg(F.sum(F.pow("pj", F.lit(2))).alias("p_e"), F.sum(F.pow("pj", F.lit(3))).alias("p3"))
    pe, m = F.col("p_e"), F.col("m")
    kappa = F.when(pe < 1, (F.col("p_bar") - pe) / (1 - pe))
    se = F.when(pe < 1, F.sqrt(2 / (F.col("items") * m * (m - 1))) * F.sqrt(pe - (2 * m - 3) * pe * pe + 2 * (m - 2) * F.col("p3")) / (1 - pe))
    return mean.join(F.broadcast(chance)).select("items", "p_bar", "p_e", kappa.alias("kappa"), se.alias("se"))  # one row each


def krippendorff(long: DataFrame) -> DataFrame:
    """Nominal alpha with missing labels allowed (A31), without the small-sample correction."""
    counts = item_counts(long)
    sized = counts.join(counts.groupBy("item").agg(F.sum("n").alias("m")), "item").where("m >= 2")
    observed = sized.agg(F.sum("n").alias("total"), F.sum(F.col("n") * (F.col("n") - 1) / (F.col("m") - 1)).alias("same"))
    share = sized.groupBy("label").agg(F.sum("n").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("sq"))
    de = 1 - F.col("sq") / (F.col("total").cast("double") * F.col("total"))
    do = 1 - F.col("same") / F.col("total")
    return observed.join(F.broadcast(share)).select(F.when(de > 0, 1 - do / de).alias("alpha"), do.alias("d_o"), de.alias("d_e"))  # one row each


def majority(long: DataFrame) -> DataFrame:
    """Each item's most frequent label (ties: the smaller), its votes and P_i."""
    counts = item_counts(long)
    items = counts.groupBy("item").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("sq"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("n"), "label"))
    top = counts.withColumn("rank", rank).where("rank = 1").select("item", F.col("label").alias("majority"), F.col("n").alias("votes"))
    p_i = F.when(F.col("m") > 1, (F.col("sq") - F.col("m")) / (F.col("m") * (F.col("m") - 1)))
    return top.join(items, "item").select("item", "majority", "votes", "m", p_i.alias("p_i"))


def confusions(both: DataFrame) -> DataFrame:
    """Unordered pairs of different labels."""
    return both.where("a <> b").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).groupBy("x", "y").agg(F.count("*").alias("n"))


def wide(long: DataFrame, raters: list[str]) -> DataFrame:
    """One row an item, one column a rater (V5)."""
    return long.groupBy("item").pivot("rater", raters).agg(F.max("label"))


def accuracy(df: DataFrame, label: str, weak: str) -> DataFrame:
    """Share of rows in which the label is the weak one."""
    return df.agg(F.avg((F.col(label) == F.col(weak)).cast("int")).alias("accuracy"), F.count("*").alias("n"))


def judged(df: DataFrame) -> DataFrame:
    """Requests, tokens and the mean score of each model; a missing score counts as 0."""
    return df.groupBy("model").agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"), (F.sum("score") / F.count("*")).alias("mean_score"))
