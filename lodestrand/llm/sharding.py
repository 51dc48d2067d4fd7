"""Proportional stratified interleaving: every shard gets the mixture of sources, and shard sizes differ by one row at most."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import require, written

SEED, SHARDS = 7, 8
BIN_ROWS = 100_000


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row: id_col, size long (UTF-8 bytes plus 1), text_crc32 long, source, rank_share double, shard int, slot long.

    Rows are shuffled within their source by a seeded hash of the id. A row of rank r of n stands at (r - 0.5) / n; all
    rows in this order are cut into ``shards`` runs whose lengths differ by one at most, so each run has its share of
    every source. slot is the place in the shard, from 0. Ranks come from counts of hash bins plus a sort inside a bin,
    so that a source of any size is ranked by many tasks.

    A null text has 0 bytes and the checksum of none; null sources form a source of their own. Rows that repeat are
    placed one by one. An empty table gives no rows. Other columns are ignored. A very long text is
    measured whole, by one task.
    """
    require(docs, id_col, text_col, source_col)
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).alias("crc"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"),
    )
    rows = written(rows.withColumn("h", F.xxhash64("h", F.col("id"))), "rows")
    total = rows.count()
    bins = max(64, -(-total // BIN_ROWS))
    # the hash as a number in [0, 2^31), cut into bins in its order
    binned = rows.withColumn("bin", F.floor((F.shiftright("h", 33) + F.lit(1 << 30)) * bins / F.lit(float(1 << 31))).cast("long"))
    counts = binned.groupBy("source", "bin").agg(F.count("*").alias("n"))
    in_source = Window.partitionBy("source")
    before = counts.select(F.col("source").alias("s"), F.col("bin").alias("b"), (F.sum("n").over(in_source.orderBy("bin")) - F.col("n")).alias("before"), F.sum("n").over(in_source).alias("of"))
    in_bin = F.row_number().over(Window.partitionBy("source", "bin").orderBy("h", "id", "crc", "size"))
    ranked = binned.withColumn("in_bin", in_bin).join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")))
    placed = ranked.select("id", "source", "size", "crc", "h", ((F.col("before") + F.col("in_bin") - 0.5) / F.col("of")).alias("share"))
    placed = placed.withColumn("cut", F.least(F.floor(F.col("share") * bins), F.lit(bins - 1)).cast("long"))
    # ``bins`` rows: small enough for one task at any input, as a bin stands for 100,000 rows
    starts = placed.groupBy("cut").agg(F.count("*").alias("n")).select(F.col("cut").alias("c"), (F.sum("n").over(Window.orderBy("cut")) - F.col("n")).alias("start"))
    at = F.row_number().over(Window.partitionBy("cut").orderBy("share", F.xxhash64("source"), "source", "h", "id", "crc", "size"))
    ordered = placed.withColumn("at", at).join(starts, F.col("cut") == F.col("c")).withColumn("at", F.col("start") + F.col("at") - 1)
    shard = F.expr(f"at * {shards} div {max(1, total)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return ordered.withColumn("shard", shard.cast("int")).select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.col("source").alias(source_col), F.col("share").alias("rank_share"), "shard", (F.col("at") - first).cast("long").alias("slot"))
