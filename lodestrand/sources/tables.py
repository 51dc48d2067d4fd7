"""The given tables as evidence: sentences of documents, candidate sets of orders, triples of the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, title, lang, sent_idx, sentence, unit): texts cut at line ends and full stops; blank ones are left out, but count.

    The title of a document is its source and id. A null text has no sentences.
    """
    title = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"))
    each = docs.select("doc_id", title.alias("title"), "lang", F.posexplode_outer(F.split("text", r"[\n.]")).alias("sent_idx", "raw"))
    clean = each.withColumn("sentence", F.trim(F.regexp_replace("raw", r"\s+", " "))).where(F.length("sentence") > 0)
    return clean.select("doc_id", "title", "lang", "sent_idx", "sentence", X.sentence_unit(F.col("title"), F.col("sent_idx"), F.col("sentence")).alias("unit"))


def candidates(spark: SparkSession, sf_dir: str, unit: str = "p_brand", lineitem: DataFrame | None = None) -> DataFrame:
    """(example, candidate, score, units): the orders of a customer, by price, with the ``unit`` values of their lines.

    Units are distinct, in the order of line, part and supplier. An order without lines has none. ``lineitem`` stands in
    for the given table.
    """
    lines = (table(spark, sf_dir, "lineitem") if lineitem is None else lineitem).join(table(spark, sf_dir, "part").select("p_partkey", F.col(unit).alias("unit")), F.col("l_partkey") == F.col("p_partkey"))
    own = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "unit"))).alias("lines"))
    units = own.select("l_orderkey", F.array_distinct(F.col("lines.unit")).alias("units"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("example"), F.col("o_orderkey").alias("candidate"), F.col("o_totalprice").alias("score"))
    return orders.join(units, orders["candidate"] == units["l_orderkey"], "left").select("example", "candidate", "score", F.coalesce("units", F.array().cast("array<string>")).alias("units"))


def gold(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None, unit: str = "p_brand") -> DataFrame:
    """(example, golds): up to two alternatives for a customer, brands of lines with a high discount, returned or accepted.

    ``lineitem`` stands in for the given table, ``unit`` for the brand.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("example"))
    lines = (table(spark, sf_dir, "lineitem") if lineitem is None else lineitem).where((F.col("l_discount") >= 0.08) & F.col("l_returnflag").isin("R", "A"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col(unit).alias("unit"))
    each = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("example", "l_returnflag").agg(F.array_sort(F.collect_set("unit")).alias("units"))
    pick = lambda flag: F.max(F.when(F.col("l_returnflag") == flag, F.col("units")))
    both = each.groupBy("example").agg(pick("R").alias("first"), pick("A").alias("second"))
    return both.select("example", F.filter(F.array("first", "second"), lambda x: x.isNotNull()).alias("golds"))


def mutated_gold(lineitem: DataFrame) -> DataFrame:
    """``lineitem`` with other values in the columns that only gold reads: gold lines leave it, all others enter it."""
    golden = F.coalesce((F.col("l_discount") >= 0.08) & F.col("l_returnflag").isin("R", "A"), F.lit(False))
    discount = F.when(golden, 0.0).otherwise(0.1).cast(lineitem.schema["l_discount"].dataType)
    flag = F.when(golden, "N").otherwise(F.when(F.col("l_linenumber") % 2 == 0, "R").otherwise("A"))
    return lineitem.withColumns({"l_discount": discount, "l_returnflag": flag})


def grains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(example, dataset, domain): a customer's market segment and region."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("c_custkey").alias("example"), F.col("c_mktsegment").alias("dataset"), F.col("n_regionkey").alias("domain"))
