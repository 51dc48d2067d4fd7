"""Ranking candidates of an example, and choosing how long a prefix to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sets as S

EPSILON = 1e-12
PREFIXES = (1, 2, 3, 5)


def rank(candidates: DataFrame, most: int | None = None) -> DataFrame:
    """Adds rank within example: higher score first, then smaller candidate; keeps the first ``most``."""
    order = Window.partitionBy("example").orderBy(F.desc("score"), "candidate")
    ranked = candidates.withColumn("rank", F.row_number().over(order))
    return ranked if most is None else ranked.where(F.col("rank") <= most)


def lists(candidates: DataFrame, most: int = 5) -> DataFrame:
    """One row for each example: ranked, an array of (rank, score, units, candidate), ``most`` long at most."""
    each = rank(candidates, most).groupBy("example").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "units", "candidate"))).alias("ranked"))
    return each.withColumn("spread", spread(F.col("ranked")))


def spread(ranked: Column) -> Column:
    """Population deviation of the scores."""
    n = F.size(ranked)
    mean = F.aggregate(ranked, F.lit(0.0), lambda s, x: s + x["score"]) / n
    return F.aggregate(ranked, F.lit(0.0), lambda s, x: s + F.pow(x["score"] - mean, F.lit(2.0)), lambda s: F.sqrt(s / n))


def prefix_units(ranked: Column, k: Column | int) -> Column:
    """Ordered union of the units of the first k candidates."""
    return S.ordered_union(F.transform(F.slice(ranked, 1, k), lambda x: x["units"]))


def fixed_prefixes(candidates: DataFrame, prefixes: tuple[int, ...] = PREFIXES) -> DataFrame:
    """(example, k, units) for each k of ``prefixes``; an example of fewer candidates gives all it has."""
    each = lists(candidates, max(prefixes)).withColumn("k", F.explode(F.array(*map(F.lit, prefixes))))
    return each.select("example", "k", prefix_units(F.col("ranked"), F.col("k")).alias("units"))


def novelty(ranked: Column, at: Column) -> Column:
    """Share of a candidate's units that none before it has; 0 for one without units. at: from 1."""
    own = F.element_at(ranked, at)["units"]
    return S.ratio(F.size(F.array_except(own, prefix_units(ranked, at - 1))), F.size(own))


def adaptive(candidates: DataFrame, threshold: float, most: int = 5) -> DataFrame:
    """(example, selected_k, reason, units): the first candidate, then each next one whose relative strength times novelty is
    ``threshold`` or more, up to the first that falls below."""
    each = lists(candidates, most)
    top = F.col("ranked")[0]["score"]

    def utility(i: Column) -> Column:
        strength = F.when(F.col("spread") <= EPSILON, F.lit(1.0)).otherwise(F.exp((F.element_at(F.col("ranked"), i)["score"] - top) / F.greatest("spread", F.lit(EPSILON))))
        return strength * novelty(F.col("ranked"), i)

    later = F.filter(F.sequence(F.lit(1), F.size("ranked")), lambda i: i > 1)
    failed = F.filter(later, lambda i: utility(i) < threshold)
    found = each.withColumn("failed", failed).withColumn("selected_k", F.when(F.size("failed") > 0, F.col("failed")[0] - 1).otherwise(F.size("ranked")))
    # fixed values: the reasons, as users match on them
    reason = F.when(F.size("failed") > 0, "utility_below_tau").when(F.size("ranked") < most, "candidate_list_exhausted").otherwise("k_max_reached")
    return found.select("example", "selected_k", reason.alias("reason"), prefix_units(F.col("ranked"), F.col("selected_k")).alias("units"))


def decisions(candidates: DataFrame, most: int = 5) -> DataFrame:
    """A row for each prefix that has a next candidate: scores, gap and strength in units of spread, sizes, novelty, overlap."""
    each = lists(candidates, most).withColumn("at", F.explode(F.filter(F.sequence(F.lit(1), F.size("ranked")), lambda i: i < F.size("ranked"))))
    now, after = F.element_at("ranked", F.col("at")), F.element_at("ranked", F.col("at") + 1)
    had = prefix_units(F.col("ranked"), F.col("at"))
    fresh, size = F.size(F.array_except(after["units"], had)), F.size(after["units"])
    scale = F.greatest("spread", F.lit(EPSILON))
    return each.select(
        "example", "at", now["score"].alias("cur"), after["score"].alias("nxt"), F.exp((after["score"] - F.col("ranked")[0]["score"]) / scale).alias("rel_top"),
        ((now["score"] - after["score"]) / scale).alias("gap"), F.size(had).alias("cum_size"), size.alias("next_size"), fresh.alias("new_units"),
        S.ratio(fresh, size).alias("novelty"), S.ratio(size - fresh, size).alias("overlap"),
    )


def stepwise_k(decisions: DataFrame, probability: Column, threshold: float) -> DataFrame:
    """(example, selected_k): goes from 1 to 2, 3 and 5 while the probability at the prefix is ``threshold`` or more."""
    go = decisions.where(F.col("at") <= 3).groupBy("example").pivot("at", [1, 2, 3]).agg(F.first(probability >= threshold))
    ok = lambda k: F.coalesce(F.col(str(k)), F.lit(False))
    return go.select("example", F.when(~ok(1), 1).when(~ok(2), 2).when(~ok(3), 3).otherwise(5).alias("selected_k"))


def best_prefix(scored: DataFrame) -> DataFrame:
    """(example, k, f1): of (example, k, f1, size) rows the highest F1, then the fewest units, then the smallest k."""
    return scored.groupBy("example").agg(F.min_by("k", F.struct(-F.col("f1"), "size", "k")).alias("k"), F.max("f1").alias("f1"))


def pareto(points: DataFrame, key: str = "example") -> DataFrame:
    """Points (k, precision, recall, size) of an example that no other beats: none is as good in all three and better in one."""
    other = points.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in ("precision", "recall", "size")))
    as_good = (F.col("_precision") >= F.col("precision")) & (F.col("_recall") >= F.col("recall")) & (F.col("_size") <= F.col("size"))
    better = (F.col("_precision") > F.col("precision")) | (F.col("_recall") > F.col("recall")) | (F.col("_size") < F.col("size"))
    return points.join(other, (F.col(key) == F.col("_key")) & as_good & better, "left_anti")


def hash_rank(rows: DataFrame, group: str, key: str) -> DataFrame:
    """Adds k, the rank of a row in its group in the order of the key's MD5, and n, the size of the group.

    Rows are counted by the first three digits of the hash and ranked inside such a bin on top of the counts before it;
    so a group of any size is ranked by many tasks, and no window but that over 4,096 counts holds a whole group.
    """
    digest = F.md5(F.col(key).cast("string").cast("binary"))
    own = rows.withColumn("_hash", digest).withColumn("_bin", F.substring("_hash", 1, 3))
    counts = own.groupBy(group, "_bin").agg(F.count("*").alias("_count"))
    whole = Window.partitionBy(group)
    before = counts.select(F.col(group).alias("_group"), F.col("_bin").alias("_of"), (F.sum("_count").over(whole.orderBy("_bin")) - F.col("_count")).alias("_before"), F.sum("_count").over(whole).alias("n"))
    in_bin = F.row_number().over(Window.partitionBy(group, "_bin").orderBy("_hash", key))
    ranked = own.withColumn("_in_bin", in_bin).join(before, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_bin") == F.col("_of")))
    return ranked.select(*rows.columns, (F.col("_before") + F.col("_in_bin")).alias("k"), "n")
