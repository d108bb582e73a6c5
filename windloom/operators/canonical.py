"""Canonical JSON and fingerprints: equal for texts that say the same, whatever the order of keys, blanks and spelling of numbers.

A text's tree is a VARIANT, whose keys are in order at each level. Numbers without exponent are exact up to 38 digits and lose
closing zeros (1.50, 1.5; 2.0, 2); those with an exponent or more digits are doubles, and are spelled like the others from a
thousandth to ten million. Arrays keep their order. NULL for NULL, for what isn't JSON and for objects with a key twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windloom.operators.catalogue import cables, catalogues, pick
from windloom.operators.decide import DISCOUNT, HOURS, PRICE_MWH, YEARS
from windloom.operators.layers import polygons
from windloom.operators.routing import tree_edges
from windloom.sources import bindings

#: A string, or else the closing zero of a double.
STRING_OR_ZERO = r'("(?:[^"\\]++|\\.)*+")|\.0(?=[,\]}]|$)'
#: The contexts of a project, in the order of the columns; and what stands for land that nobody described.
CONTEXTS = ("topology", "electrical", "evaluation", "economic", "land_routing", "land_economic")
NO_LAND = {"land_routing": "LAND_ROUTING_NONE", "land_economic": "LAND_ECONOMIC_NONE"}


def canonical(text: Column) -> Column:
    """A JSON text with keys in order, no blanks, and one spelling of each number."""
    return F.regexp_replace(F.to_json(F.try_parse_json(text)), STRING_OR_ZERO, "$1")


def fingerprint(text: Column) -> Column:
    """SHA-256 of the canonical text."""
    return F.sha2(canonical(text), 256)


def record(**fields: Column) -> Column:
    """JSON of a record, unknown values as null."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})


def set_fingerprints(members: DataFrame, by: list[str]) -> DataFrame:
    """One fingerprint for the JSON members (column ``text``) of each group, whatever their order; repeats count. What is gathered
    is 64 letters a member. A member that isn't JSON counts by its text as it is, NULL as itself.
    """
    each = members.select(*by, F.coalesce(fingerprint(F.col("text")), F.concat(F.lit("-"), F.sha2("text", 256)), F.lit("--")).alias("digest"))
    return each.groupBy(*by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("digest")), ","), 256).alias("fingerprint"))


def layer_names(features: DataFrame) -> DataFrame:
    """Id of each GeoJSON feature (feature, text): the first of three properties that is there; if it is null, or none is there, a
    hash of the whole feature. Errors: MALFORMED, EMPTY_ID, DUPLICATE_ID (each of those that share one).

    Ids are counted by partial aggregates and joined back; blank ones, which may be very many, take no part in that.
    """
    form = "type string, properties map<string,string>"
    rows = features.withColumns({"whole": canonical(F.col("text")), "p": F.from_json("text", form)["properties"]})
    has = lambda k: F.coalesce(F.map_contains_key("p", k), F.lit(False))
    given = F.when(has("constraint_id"), F.col("p")["constraint_id"]).when(has("layer_id"), F.col("p")["layer_id"]).when(has("id"), F.col("p")["id"])
    name = F.when(F.col("whole").isNotNull(), F.trim(F.coalesce(given, F.concat(F.lit("constraint-"), F.substring(F.sha2("whole", 256), 1, 16)))))
    rows = rows.select("feature", name.alias("layer_id")).withColumn("key", F.when(F.col("layer_id") != "", F.col("layer_id")))
    twice = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    error = F.when(F.col("layer_id").isNull(), "MALFORMED").when(F.col("layer_id") == "", "EMPTY_ID").when(F.col("n") > 1, "DUPLICATE_ID")
    return rows.join(twice, "key", "left").select("feature", "layer_id", error.alias("error"))


def canonical_layer_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of layers whose features are written with keys in this order or that, and numbers in two spellings (test binding)."""
    k = F.col("o_orderkey")
    say = lambda x: x.cast("string")
    own = F.concat_ws(",", F.when(k % 3 == 0, F.concat(F.lit('"constraint_id": '), F.when(k % 9 == 0, "null").otherwise(F.concat(F.lit('"c'), say(k % 5000), F.lit('"'))))), F.when(k % 4 == 0, F.concat(F.lit('"layer_id": " l'), say(k), F.lit('"'))), F.when(k % 5 == 0, F.lit('"id": " "')), F.concat(F.lit('"mode": "'), F.col("o_orderpriority"), F.lit('"')))
    place = F.concat(F.lit('"coordinates": ['), say(k % 40), F.when(k % 2 == 0, ".0").otherwise(""), F.lit(", 5.50]"))
    shape = F.when(k % 7 < 3, F.concat(F.lit('{"type": "Point", '), place, F.lit("}"))).otherwise(F.concat(F.lit("{"), place, F.lit(', "type": "Point"}')))
    text = F.concat(F.lit('{"type": "Feature", "properties": {'), own, F.lit('}, "geometry": '), shape, F.when(k % 31 != 0, "}").otherwise(""))
    return layer_names(bindings.table(spark, sf_dir, "orders").select(k.alias("feature"), text.alias("text")))


def context_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON members (project, context, text) of each project's contexts (test bindings)."""
    edges, turbines, land = tree_edges(spark, sf_dir), bindings.turbines(spark, sf_dir), polygons(spark, sf_dir).where("not is_hard")
    k, text = F.col("layer"), lambda context, **fields: (F.lit(context).alias("context"), record(**fields).alias("text"))
    ends = F.format_string("%03d:%03d", F.floor(F.col("node") / 2).cast("int"), F.col("node").cast("int"))
    feeders = edges.groupBy("project", "feeder").agg(F.array_sort(F.collect_list(ends)).alias("e"), F.array_sort(F.collect_list(F.col("node").cast("int"))).alias("w"))  # of one feeder
    shut = k % 6 == 0
    options = F.array(*[F.struct(F.lit(m).alias("mode"), (k * m_price % 900).alias("upfront"), F.lit(None).cast("string").alias("price_date")) for m, m_price in (("EASEMENT", 7), ("PURCHASE", 31))])
    return reduce(
        DataFrame.unionByName,
        (
            feeders.select("project", *text("topology", wtgs=F.col("w"), edges=F.col("e"))),
            turbines.select("project", *text("electrical", node=F.col("turbine_id"), active_kw=F.col("kw"))),
            cables(spark, sf_dir).select(F.col("catalogue").alias("project"), *text("electrical", cable=F.col("cable_type_id"), max_current_a=F.col("max_current_a"), derating=(F.col("derating_milli") / 1000).cast("decimal(9,3)"), parallel=F.col("parallel_count"))),
            edges.select("project", *text("evaluation", segment=F.concat_ws("-", "feeder", "node"), route=F.array(*[F.array(f"x{i}", f"y{i}") for i in (1, 2)]))),
            catalogues(spark, sf_dir).select(F.col("catalogue").alias("project"), *text("economic", currency=F.upper(F.trim("currency")), catalogue_id=F.col("name"), price_date=F.col("price_date"), years=F.lit(YEARS), discount=F.lit(str(DISCOUNT)), hours=F.lit(HOURS), price=F.lit(str(PRICE_MWH)))),
            land.where(shut).select("project", *text("land_routing", parcel=k)),
            land.select("project", *text("land_economic", parcel=k, owner=F.when(k % 5 != 0, pick(["A", "B", "C"], k % 3)), availability=F.when(shut, "UNAVAILABLE").otherwise("AVAILABLE"), options=options)),
        ),
    )


def context_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven fingerprints of each project: of its six contexts, and of its state as a whole. Land that isn't described has one of its own."""
    found = set_fingerprints(context_members(spark, sf_dir), ["project", "context"])
    each = found.groupBy("project").agg(*[F.max(F.when(F.col("context") == c, F.col("fingerprint"))).alias(c) for c in CONTEXTS])
    none = {c: F.coalesce(c, fingerprint(F.lit(f'"{word}"'))) for c, word in NO_LAND.items()}
    return each.withColumns(none).select("project", *CONTEXTS, fingerprint(record(**{c: F.col(c) for c in reversed(CONTEXTS)})).alias("state"))


QUERIES = (canonical_layer_ids, context_fingerprints)
