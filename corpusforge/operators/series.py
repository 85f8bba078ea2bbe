"""Hazard flags, streaks, seasonal reports over a daily series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FLAGS = ("frost_day", "heat_day", "severe_heat_day", "dry_day", "strong_wind_day", "dust_storm_risk", "rainy_day")


def flags(df: DataFrame) -> DataFrame:
    """Threshold flags of temperature, rain, wind and humidity."""
    c = F.col
    return df.withColumns(
        {
            "frost_day": c("t_min") <= 0, "heat_day": c("t_max") >= 35, "severe_heat_day": c("t_max") >= 38, "dry_day": c("rain") < 1,
            "strong_wind_day": c("wind") >= 17, "dust_storm_risk": (c("wind") >= 15) & (c("humidity") <= 30), "rainy_day": c("rain") >= 1,
        }
    )


def streak(df: DataFrame, flag: str, out: str, order: str = "day", exact: bool = False, reset: bool = False) -> DataFrame:
    """Length of the run so far.

    By default the row that ends a run counts as the first of the next one, as in the tables to be matched; with
    exact, runs count from 1 and other rows are 0; reset sets other rows to 0. The series is one row a day.
    """
    w = Window.orderBy(order)
    group = df.withColumn("_g", F.sum((~F.col(flag)).cast("int")).over(w))
    n = F.row_number().over(Window.partitionBy("_g").orderBy(order))
    if exact:
        n = F.sum(F.col(flag).cast("int")).over(Window.partitionBy("_g").orderBy(order))
    n = n.cast("long")
    return group.withColumn(out, F.when(~F.col(flag), F.lit(0).cast("long")).otherwise(n) if reset or exact else n).drop("_g")


def monthly(df: DataFrame, columns: tuple[str, ...] = FLAGS[:5]) -> DataFrame:
    """Days of each flag by month of the year; months without days count 0."""
    months = df.sparkSession.range(1, 13).select(F.col("id").alias("month"))
    sums = df.groupBy(F.month("day").cast("long").alias("month")).agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in columns])
    return months.join(sums, "month", "left").select("month", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in columns])


#: Growth periods and their months.
PERIODS = {"bud": (3, 4), "flower": (5, 6), "growth": (6, 7, 8), "ripen": (8, 9, 10)}


def by_period(df: DataFrame, columns: tuple[str, ...] = FLAGS[:5]) -> DataFrame:
    """Days of each flag by growth period; a day may belong to two."""
    names = F.array_compact(F.array(*[F.when(F.month("day").isin(*m), F.lit(p)) for p, m in PERIODS.items()]))
    return df.withColumn("period", F.explode(names)).groupBy("period").agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in columns])


def high_risk(df: DataFrame, dust: bool = True) -> DataFrame:
    """Days with frost, heat, a long dry run, strong wind."""
    risk = F.col("frost_day") | F.col("heat_day") | (F.col("dry_streak") >= 5) | F.col("strong_wind_day")
    return df.where(risk | F.col("dust_storm_risk") if dust else risk)


def year_month(df: DataFrame) -> DataFrame:
    """Averages by calendar month, rounded to one digit (A10)."""
    return df.groupBy(F.date_format("day", "yyyy-MM").alias("ym")).agg(
        F.round(F.avg("t_max"), 1).alias("avg_max"), F.round(F.avg("t_min"), 1).alias("avg_min"), F.round(F.sum("rain"), 1).alias("sum_rain"), F.round(F.avg("wind"), 1).alias("avg_wind"), F.count("*").alias("days")
    )


def features(df: DataFrame) -> DataFrame:
    """Range and mean of the temperatures, and whether two or more flags are set."""
    count = sum((F.col(c).cast("int") for c in FLAGS[1:]), F.col(FLAGS[0]).cast("int"))
    return df.withColumns({"temp_range": F.col("t_max") - F.col("t_min"), "temp_avg": (F.col("t_max") + F.col("t_min")) / 2, "target": (count >= 2).cast("long")})
