"""Column functions on sets held as arrays: scores, unions, references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.nullif(b, F.lit(0)))


def harmonic(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / F.nullif(p + r, F.lit(0.0)))


def scores(found: Column, gold: Column, both_empty: float = 0.0) -> Column:
    """(precision, recall, f1, jaccard, exact, contains) of distinct arrays; an empty side scores 0.

    Two empty sets are equal, so exact is 1; their F1 and Jaccard are ``both_empty``: 0 by precision and recall, 1 where
    nothing to find and nothing found counts as right.
    """
    both = F.size(F.array_intersect(found, gold))
    p, r = ratio(both, F.size(found)), ratio(both, F.size(gold))
    same = (both == F.size(found)) & (both == F.size(gold))
    none = (F.size(found) == 0) & (F.size(gold) == 0)
    return F.struct(
        p.alias("precision"), r.alias("recall"), F.when(none, F.lit(both_empty)).otherwise(harmonic(p, r)).alias("f1"),
        F.when(none, F.lit(both_empty)).otherwise(ratio(both, F.size(found) + F.size(gold) - both)).alias("jaccard"),
        same.cast("int").alias("exact"), (both == F.size(gold)).cast("int").alias("contains"),
    )


def best_of(found: Column, golds: Column) -> Column:
    """Scores against the alternative of highest F1, the first of equal ones; all zero where none shares a member."""
    zero = F.struct(*(F.lit(0.0).alias(n) for n in ("precision", "recall", "f1", "jaccard")), F.lit(0).alias("exact"), F.lit(0).alias("contains"))
    return F.aggregate(golds, zero, lambda best, gold: F.when(scores(found, gold)["f1"] > best["f1"], scores(found, gold)).otherwise(best))


def ordered_union(arrays: Column) -> Column:
    return F.array_distinct(F.flatten(arrays))


def subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def reference(found: Column, golds: Column) -> Column:
    """(missing, extra, size, position) of the alternative that is nearest: fewest missing, fewest extra, smallest, first."""
    each = F.transform(golds, lambda g, i: F.struct(F.size(F.array_except(g, found)).alias("missing"), F.size(F.array_except(found, g)).alias("extra"), F.size(g).alias("size"), i.alias("position")))
    return F.array_min(each)


def outcome(found: Column, golds: Column) -> Column:
    """exact, complete_nonminimal, incomplete or disjoint against non-empty alternatives; null without one."""
    same = F.exists(golds, lambda g: subset(g, found) & subset(found, g))
    holds = F.exists(golds, lambda g: subset(g, found))
    meets = F.exists(golds, lambda g: F.arrays_overlap(g, found))
    return F.when(F.size(golds) == 0, F.lit(None)).when(same, "exact").when(holds, "complete_nonminimal").when(meets, "incomplete").otherwise("disjoint")
