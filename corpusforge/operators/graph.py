"""Tables to triples and property graphs; pattern, aggregate and path queries over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .series import FLAGS

DATA = {"t_max": "float", "t_min": "float", "rain": "float", "wind": "float", "humidity": "float", "dry_streak": "integer", "rain_streak": "integer", "day": "date"}


def triples(df: DataFrame) -> DataFrame:
    """(s, p, o, datatype) of each day's data, and an edge to each event it has (R6); empty values are left out."""
    s = F.concat(F.lit("Record_"), F.date_format("day", "yyyyMMdd"))
    rows = [F.struct(s.alias("s"), F.lit(p).alias("p"), F.col(p).cast("string").alias("o"), F.lit(t).alias("datatype")) for p, t in DATA.items() if p in df.columns]
    rows += [F.struct(s.alias("s"), F.lit("hasEvent").alias("p"), F.when(F.col(f), F.lit(f"{f}_instance")).alias("o"), F.lit("iri").alias("datatype")) for f in FLAGS]
    return df.select(F.explode(F.array(*rows)).alias("x")).select("x.*").where(F.col("o").isNotNull() & (F.col("o") != ""))


def match(spo: DataFrame, *patterns: tuple[str, str, str]) -> DataFrame:
    """A basic graph pattern (J15): variables start with ?, other terms are constants; joins on shared variables."""
    found = None
    for s, p, o in patterns:
        part = spo
        names = {}
        for column, term in (("s", s), ("p", p), ("o", o)):
            if term.startswith("?"):
                names[column] = term[1:]
            else:
                part = part.where(F.col(column) == term)
        part = part.select(*[F.col(c).alias(n) for c, n in names.items()])
        found = part if found is None else found.join(part, [c for c in part.columns if c in found.columns])
    return found


def ntriples(spo: DataFrame, base: str = "http://example.org/series#") -> DataFrame:
    """Triples as N-Triples lines (K7)."""
    iri = lambda c: F.concat(F.lit(f"<{base}"), c, F.lit(">"))
    literal = F.concat(F.lit('"'), F.regexp_replace("o", r'(["\\])', r"\\$1"), F.lit('"^^<http://www.w3.org/2001/XMLSchema#'), F.col("datatype"), F.lit(">"))
    return spo.select(F.concat_ws(" ", iri(F.col("s")), iri(F.col("p")), F.when(F.col("datatype") == "iri", iri(F.col("o"))).otherwise(literal), F.lit(".")).alias("value"))


def events(df: DataFrame) -> DataFrame:
    """Edges day - event from the flags."""
    return df.select("day", F.explode(F.array(*[F.when(F.col(f), F.lit(f)) for f in FLAGS])).alias("event")).where("event is not null")


def next_day(df: DataFrame) -> DataFrame:
    """Edges to the following calendar day, as an equi join."""
    return df.select(F.col("day").alias("src")).withColumn("dst", F.date_add("src", 1)).join(df.select(F.col("day").alias("dst")), "dst").select("src", "dst")


def merge_nodes(rows: DataFrame, keys: list[str], props: str, order: str) -> DataFrame:
    """One node a key; later properties replace earlier ones."""
    parts = rows.select(*keys, order, F.explode(props).alias("k", "v"))
    last = parts.groupBy(*keys, "k").agg(F.max_by("v", order).alias("v"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(props))


def relate(relations: DataFrame, entities: DataFrame, match_on: str = "id") -> DataFrame:
    """Relations with both ends found by id, or by name as in the tables to be matched."""
    end = lambda c: entities.select(F.col(match_on).alias(c), F.col("name").alias(f"{c}_name"))
    kind = F.upper(F.regexp_replace("type", r"\s+", "_"))
    return relations.join(end("source"), "source").join(end("target"), "target").select("source_name", "target_name", kind.alias("type"))


def paths(df: DataFrame, value: str, most: int = 10, start_over: float = 1, all_over: float = 0) -> DataFrame:
    """Chains of 2 to `most` next-day hops whose first node is over start_over and all over all_over (Q4).

    Next-day edges form chains, so a path is a run of consecutive days: windows over each run replace a recursion.
    """
    run = F.date_sub("day", F.row_number().over(Window.orderBy("day")).cast("int"))
    rows = df.select("day", value).withColumn("run", run)
    ahead = Window.partitionBy("run").orderBy("day").rowsBetween(0, most)
    rows = rows.withColumn("days", F.collect_list("day").over(ahead)).withColumn("values", F.collect_list(value).over(ahead)).where(F.col(value) > start_over)
    hops = rows.withColumn("hops", F.explode(F.sequence(F.lit(2), F.lit(most)))).where(F.size("days") > F.col("hops"))
    ok = F.forall(F.slice("values", F.lit(1), F.col("hops") + 1), lambda x: x > all_over)
    return hops.where(ok).select(F.col("day").alias("start"), F.element_at("days", F.col("hops") + 1).alias("end"), "hops")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def nodes(df: DataFrame) -> DataFrame:
    """Record, event and month nodes with their properties, one row a node."""
    props = ("t_max", "t_min", "rain", "wind")
    day = F.col("day").cast("string")
    records = df.select(F.lit("Record").alias("label"), day.alias("id"), *props, F.lit(1).cast("long").alias("days"))
    none = [F.lit(None).cast("double").alias(c) for c in props]
    kinds = events(df).select(F.lit("Event").alias("label"), F.col("event").alias("id")).distinct().select("label", "id", *none, F.lit(None).cast("long").alias("days"))
    months = df.groupBy(F.date_format("day", "yyyy-MM").alias("id")).agg(*[F.avg(c).alias(c) for c in ("t_max", "t_min")], F.sum("rain").alias("rain"), F.avg("wind").alias("wind"), F.count("*").alias("days"))
    return union_all([records, kinds, months.select(F.lit("Month").alias("label"), "id", *props, "days")])


def edges(df: DataFrame) -> DataFrame:
    """HAS_EVENT, NEXT_DAY and IN_MONTH edges."""
    day = lambda c: F.col(c).cast("string")
    has = events(df).select(F.lit("HAS_EVENT").alias("type"), day("day").alias("src"), F.col("event").alias("dst"))
    following = next_day(df).select(F.lit("NEXT_DAY").alias("type"), day("src").alias("src"), day("dst").alias("dst"))
    month = df.select(F.lit("IN_MONTH").alias("type"), day("day").alias("src"), F.date_format("day", "yyyy-MM").alias("dst"))
    return union_all([has, following, month])


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes, with the ends' labels (Q1)."""
    end = lambda c: nodes.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"))
    return edges.join(end("src"), "src").join(end("dst"), "dst")


def uniqueness(nodes: DataFrame) -> DataFrame:
    """Nodes of each label, and those whose id is not their own (Y2)."""
    ids = nodes.groupBy("label", "id").agg(F.count("*").alias("k"))
    return ids.groupBy("label").agg(F.sum("k").alias("n"), (F.sum("k") - F.count("*")).alias("repeated"))


def rules(runs: DataFrame) -> DataFrame:
    """id (<model>_rule_<i>), model and text of each run's rules."""
    one = runs.select("model", F.posexplode("rules").alias("i", "rule"))
    return one.select(F.concat("model", F.lit("_rule_"), F.col("i").cast("string")).alias("id"), "model", F.trim("rule").alias("rule")).where("rule <> ''")


def load(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Writes both tables, replacing what was there (Y1, K8): nodes by label, edges by type."""
    nodes.write.mode("overwrite").partitionBy("label").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").partitionBy("type").parquet(f"{folder}/edges")


#: Predicate names of the other ontology (fixed).
FUNCTIONAL = {
    "t_max": "has_temperature_max", "t_min": "has_temperature_min", "rain": "has_precipitation", "wind": "has_wind_speed_max", "humidity": "has_humidity",
    "day": "has_date", "frost_day": "has_frost", "heat_day": "has_heat", "severe_heat_day": "has_severe_heat", "dry_day": "has_dry", "dry_streak": "has_dry_streak",
    "strong_wind_day": "has_strong_wind", "dust_storm_risk": "has_dust_storm", "rainy_day": "has_rainy", "rain_streak": "has_continuous_rain_streak",
}


def functional_triples(df: DataFrame) -> DataFrame:
    """(s, p, o) with one value a property, flags as true and false."""
    s = F.concat(F.lit("Record_"), F.date_format("day", "yyyyMMdd"))
    rows = [F.struct(s.alias("s"), F.lit(p).alias("p"), F.col(c).cast("string").alias("o")) for c, p in FUNCTIONAL.items() if c in df.columns]
    return df.select(F.explode(F.array(*rows)).alias("x")).select("x.*").where("o IS NOT NULL")


def rdf_xml(spo: DataFrame, base: str = "http://example.org/series#") -> DataFrame:
    """Triples as RDF/XML, one description a subject (K7); a line each, between the lines of head and foot."""
    text = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    link = F.concat(F.lit("<s:"), "p", F.lit(f' rdf:resource="{base}'), text(F.col("o")), F.lit('"/>'))
    literal = F.concat(F.lit("<s:"), "p", F.lit(' rdf:datatype="http://www.w3.org/2001/XMLSchema#'), "datatype", F.lit('">'), text(F.col("o")), F.lit("</s:"), "p", F.lit(">"))
    parts = spo.select("s", F.when(F.col("datatype") == "iri", link).otherwise(literal).alias("x")).groupBy("s").agg(F.array_join(F.array_sort(F.collect_list("x")), "").alias("x"))
    body = parts.select(F.lit(1).alias("k"), F.concat(F.lit(f'<rdf:Description rdf:about="{base}'), text(F.col("s")), F.lit('">'), "x", F.lit("</rdf:Description>")).alias("value"))
    ends = spo.sparkSession.createDataFrame([(0, f'<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:s="{base}">'), (2, "</rdf:RDF>")], "k int, value string")
    return ends.unionByName(body).orderBy("k", "value").select("value")
