"""Benchmark decontamination by winnowing, in DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_UPPER, require

WINDOW, GRAM = 10, 5
#: Benchmark windows are broadcast up to this count (about 100 bytes of words each); a larger benchmark is joined by shuffle.
BROADCAST_WINDOWS = 200_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: F.Column) -> F.Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; null has none."""
    ascii_only = F.length(text) == F.octet_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_UPPER.lower()))
    return F.coalesce(F.array_remove(F.split(low, NOT_WORD), ""), F.array().cast("array<string>"))


def _grams(w: str, k: int) -> F.Column:
    """Hashes of every k consecutive words; empty where there are fewer."""
    return F.expr(f"if(size({w}) < {k}, cast(array() as array<bigint>), transform(sequence(1, size({w}) - {k} + 1), i -> xxhash64(slice({w}, i, {k}))))")


def _winnow(h: str, width: int) -> F.Column:
    """Places (from 1) of the leftmost least hash of every ``width`` consecutive ones, each place once."""
    return F.expr(
        f"if(size({h}) < {width}, cast(array() as array<int>), array_distinct(transform(sequence(1, size({h}) - {width} + 1), "
        f"i -> i - 1 + cast(array_position(slice({h}, i, {width}), array_min(slice({h}, i, {width}))) as int))))"
    )


def benchmark_windows(items: DataFrame, item_col: str, text_col: str, window: int, gram: int) -> DataFrame:
    """Each distinct window once: (length, window array, print long, at int: the print's place in it, items array)."""
    w = items.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where("size(w) > 0 and item is not null")
    spans = w.select("item", F.explode_outer(F.expr(f"if(size(w) <= {window}, array(w), transform(sequence(1, size(w) - {window - 1}), i -> slice(w, i, {window})))")).alias("window"))
    each = spans.groupBy("window").agg(F.collect_set("item").alias("items"))
    hashed = each.withColumn("length", F.size("window")).withColumn("h", _grams("window", gram))
    at = F.expr(f"if(length = {window}, cast(array_position(h, array_min(h)) as int), 1)")
    mark = F.expr(f"if(length = {window}, array_min(h), xxhash64(window))")
    return hashed.select("length", "window", mark.alias("print"), at.alias("at"), "items")


def find_hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Every occurrence of a benchmark window in a document: (doc, tkey, start from 1, length, items array).

    A window is ``window`` consecutive words of an item, or a whole item of fewer (not none). Documents keep the least
    ``gram``-word hash of each sliding window, benchmark windows likewise; equal hashes join, and a join is a hit if the
    words around it equal the whole window. As a window of words has one least hash wherever it stands, none is missed.
    Items below ``window`` words match by the hash of all their words; there is a pass for each such length, below
    ``window`` in number. (doc, tkey): the id and the text's hash.
    """
    marks = benchmark_windows(items, item_col, item_text_col, window, gram)
    sizes = marks.groupBy("length").count().collect()  # one row for each length up to ``window``
    short = sorted(r["length"] for r in sizes if r["length"] < window)
    keyed = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("tkey"), words(F.col(text_col)).alias("w"))
    prints = keyed.withColumn("h", _grams("w", gram)).withColumn("p", _winnow("h", window - gram + 1))
    # the outer form keeps the planner from filtering on the arrays' sizes below, which would build them twice
    passes = [prints.select("doc", "tkey", "w", "h", F.explode_outer("p").alias("at_doc")).withColumn("mark", F.expr("h[at_doc - 1]"))]
    for size in short:
        own = keyed.withColumn("h", _grams("w", size))
        passes.append(own.select("doc", "tkey", "w", F.posexplode_outer("h").alias("pos", "mark")).withColumn("at_doc", F.col("pos") + 1))
    low = F.greatest(F.col("at_doc") - window, F.lit(1))
    near = [p.select("doc", "tkey", "at_doc", "mark", low.alias("low"), F.slice("w", low, F.lit(2 * window)).alias("near")) for p in passes]
    if sum(r["count"] for r in sizes) <= broadcast_windows:
        marks = F.broadcast(marks)
    hits = None
    for size, side in zip([window, *short], near, strict=True):
        own = marks.where(F.col("length") == size).drop("length")
        start = F.col("at_doc") - F.col("at") + 1
        same = (F.col("mark") == F.col("print")) & (start >= 1) & (F.slice("near", F.greatest(start - F.col("low") + 1, F.lit(1)), F.lit(size)) == F.col("window"))
        found = side.join(own, same).select("doc", "tkey", start.alias("start"), F.lit(size).alias("length"), "items")
        hits = found if hits is None else hits.union(found)
    return hits


def scan(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", **how) -> DataFrame:
    """For every row of ``docs``: id_col, n_words long, n_hit long, items (array of item ids as strings, sorted), n_items long.

    n_hit counts the words inside any occurrence of a window. A null or empty text has no words; a null or empty item no
    windows; an item with a null id is ignored. Rows that repeat an id and a text each give a row. Without items nothing
    is hit; an empty table gives no rows. Other columns are ignored. A very long text is read whole, by one task.
    """
    require(docs, id_col, text_col)
    require(items, item_col, item_text_col)
    hits = find_hits(docs, items, id_col, text_col, item_col, item_text_col, **how)
    # the words that spans [start, start + length) cover, spans in order of their starts, longer first
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("stop")))),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("stop")),
        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(s["stop"], x["start"]))).alias("n"), F.greatest(s["stop"], x["stop"]).alias("stop")),
        lambda s: s["n"].cast("long"),
    )
    per_doc = hits.groupBy("doc", "tkey").agg(covered.alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.size(words(F.col(text_col))).cast("long").alias("n_words"))
    joined = rows.join(per_doc, F.col("id").eqNullSafe(F.col("doc")) & (F.col("key") == F.col("tkey")), "left")
    items_found = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), items_found.alias("items"), F.size(items_found).cast("long").alias("n_items"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, as they are, in which no benchmark window occurs; null and empty texts stay, and columns of any name."""
    hits = find_hits(docs, items, id_col, text_col, **how).select(F.struct("doc", "tkey").alias("hit")).distinct()
    return docs.alias("d").join(hits.alias("h"), F.col(f"d.{id_col}").eqNullSafe(F.col("h.hit.doc")) & (F.xxhash64(f"d.{text_col}") == F.col("h.hit.tkey")), "left_anti")
