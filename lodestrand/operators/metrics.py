"""Evaluation: answers, supports, outcomes, and their aggregates at several grains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sets as S
from ..functions import text as X
from .graph import stored

GUARDED = ("yes", "no", "noanswer")


def bag_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))


def token_scores(predicted: Column, gold: Column) -> Column:
    """(precision, recall, f1, em) of answers as bags of tokens; a yes, no or noanswer that differs from the other scores 0.

    Answers are normalised once: the lambda binds the results, so that counting doesn't evaluate them for each token.
    """

    def score(x: Column) -> Column:
        clash = (x["p"].isin(*GUARDED) | x["g"].isin(*GUARDED)) & (x["p"] != x["g"])
        both = F.when(clash, F.lit(0)).otherwise(bag_overlap(x["a"], x["b"]))
        precision, recall = S.ratio(both, F.size(x["a"])), S.ratio(both, F.size(x["b"]))
        return F.struct(precision.alias("precision"), recall.alias("recall"), S.harmonic(precision, recall).alias("f1"), (x["p"] == x["g"]).cast("int").alias("em"))

    def cut(x: Column) -> Column:
        words = lambda t: F.filter(F.split(t, " "), lambda w: w != "")
        return F.struct(x["p"].alias("p"), x["g"].alias("g"), words(x["p"]).alias("a"), words(x["g"]).alias("b"))

    bound = F.array(F.struct(X.normalize_answer(predicted).alias("p"), X.normalize_answer(gold).alias("g")))
    return F.transform(F.transform(bound, cut), score)[0]


def joint(answer: Column, support: Column) -> Column:
    """Products of precision and of recall, their harmonic mean, and the product of exact matches; null where support is."""
    p, r = answer["precision"] * support["precision"], answer["recall"] * support["recall"]
    return F.struct(p.alias("precision"), r.alias("recall"), S.harmonic(p, r).alias("f1"), (answer["em"] * support["exact"]).alias("em"))


def macro_and_pooled(rows: DataFrame, group: str, *values: str) -> DataFrame:
    """One row: for each value the mean of group means (macro_) and of all rows (pooled_)."""
    means = rows.groupBy(group).agg(*(F.avg(v).alias(v) for v in values), *(F.sum(v).alias(f"s_{v}") for v in values), *(F.count(v).alias(f"n_{v}") for v in values))
    return means.agg(*(F.avg(v).alias(f"macro_{v}") for v in values), *((F.sum(f"s_{v}") / F.nullif(F.sum(f"n_{v}"), F.lit(0))).alias(f"pooled_{v}") for v in values))


def outcome_cells(rows: DataFrame, *grains: str) -> DataFrame:
    """Counts of (outcome, correct) overall and by each grain: (grain, value, outcome, correct, n); absent cells are 0."""
    each = None
    for grain in ("overall", *grains):
        value = F.lit("all") if grain == "overall" else F.col(grain).cast("string")
        part = rows.groupBy(value.alias("value")).agg(
            *(F.count_if((F.col("outcome") == o) & (F.col("correct") == c)).alias(f"{o}|{int(c)}") for o in ("exact", "complete_nonminimal", "incomplete", "disjoint") for c in (True, False))
        )
        names = [c for c in part.columns if c != "value"]
        cells = part.select(F.lit(grain).alias("grain"), "value", F.explode(F.array(*(F.struct(F.lit(c.split("|")[0]).alias("outcome"), F.lit(int(c.split("|")[1])).alias("correct"), F.col(f"`{c}`").alias("n")) for c in names))).alias("cell"))
        part = cells.select("grain", "value", "cell.outcome", "cell.correct", "cell.n")
        each = part if each is None else each.union(part)
    return each


def transitions(before: DataFrame, after: DataFrame, key: str = "example", value: str = "outcome") -> DataFrame:
    """(was, now, n) of rows paired by key."""
    other = after.select(key, F.col(value).alias("now"))
    return before.select(key, F.col(value).alias("was")).join(other, key).groupBy("was", "now").agg(F.count("*").alias("n"))


def pearson(x: Column, y: Column) -> Column:
    """Correlation of rows; 0 for fewer than two or without variance in either."""
    n, mx, my = F.count("*"), F.avg(x), F.avg(y)
    cov = F.avg(x * y) - mx * my
    vx, vy = F.avg(x * x) - mx * mx, F.avg(y * y) - my * my
    return F.when((n < 2) | (vx <= 1e-9) | (vy <= 1e-9), F.lit(0.0)).otherwise(cov / F.nullif(F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0))), F.lit(0.0)))


def binary(rows: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """One row: the four counts, precision, recall, F1."""
    counts = rows.agg(F.count_if(truth & guess).alias("tp"), F.count_if(~truth & guess).alias("fp"), F.count_if(truth & ~guess).alias("fn"), F.count_if(~truth & ~guess).alias("tn"))
    p, r = S.ratio(F.col("tp"), F.col("tp") + F.col("fp")), S.ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumns({"precision": p, "recall": r}).withColumn("f1", S.harmonic(F.col("precision"), F.col("recall")))


def roc_auc(rows: DataFrame, truth: str, score: str) -> DataFrame:
    """One row (auc): the share of (positive, negative) pairs in the right order, ties for half; null without both kinds.

    Rows are counted by score first. Scores are then cut at 255 approximate quantiles: one window sums over the 256 parts,
    another over the distinct scores of a part, so no task holds them all.
    """
    cuts = F.percentile_approx(F.col(score).cast("double"), [k / 256 for k in range(1, 256)], 2560)
    bounds = rows.agg(cuts).first()[0] or []
    by_score = rows.groupBy(score).agg(F.sum(F.col(truth).cast("long")).alias("pos"), F.count("*").alias("n")).withColumn("neg", F.col("n") - F.col("pos"))
    part = F.lit(0)
    for b in sorted(set(bounds)):
        part = part + (F.col(score) >= F.lit(b)).cast("int")
    by_part = by_score.withColumn("part", part)
    sums = by_part.groupBy("part").agg(F.sum("neg").alias("part_neg"))  # 256 rows at most
    before = sums.select("part", F.coalesce(F.sum("part_neg").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.sum("neg").over(Window.partitionBy("part").orderBy(score).rowsBetween(Window.unboundedPreceding, -1))
    right = by_part.withColumn("inside", F.coalesce(inside, F.lit(0))).join(before, "part").withColumn("below", F.col("before") + F.col("inside"))
    return right.agg((F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))


def average_precision(rows: DataFrame, label: str, score: str, bins: int = 64) -> DataFrame:
    """One row (average_precision): precision at each distinct score, highest first, weighed by the recall it adds; null without a positive.

    Rows are counted by distinct score first. Scores are added up from the top in ``bins`` ranges of about as many rows,
    on top of the counts of the ranges above, so no task goes through all of them. Rows without a label or a score don't count.
    """
    own = rows.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.sum((F.col(label) == 1).cast("long")).alias("hits"), F.count("*").alias("n"))
    own = stored(own)
    found = own.agg(F.percentile_approx("s", [k / bins for k in range(1, bins)]).alias("b"), F.sum("hits").alias("positives")).first()
    edges = F.array(*(F.lit(x) for x in found["b"] or [])).cast("array<double>")
    placed = own.withColumn("bin", F.size(F.filter(edges, lambda x: x < F.col("s"))))
    sums = placed.groupBy("bin").agg(F.sum("hits").alias("bin_hits"), F.sum("n").alias("bin_n"))
    top = Window.orderBy(F.desc("bin"))
    above = sums.select("bin", (F.sum("bin_hits").over(top) - F.col("bin_hits")).alias("hits_above"), (F.sum("bin_n").over(top) - F.col("bin_n")).alias("n_above"))
    down = Window.partitionBy("bin").orderBy(F.desc("s"))
    each = placed.join(F.broadcast(above), "bin").withColumn("precision", (F.col("hits_above") + F.sum("hits").over(down)) / (F.col("n_above") + F.sum("n").over(down)))
    return each.agg((F.sum(F.col("precision") * F.col("hits")) / F.lit(found["positives"] or None).cast("double")).alias("average_precision"))


def rescued_outcome(found: Column, golds: Column, proof: Column, query: Column, answer: Column) -> Column:
    """(outcome, reference_size, missing_units, additional_units, rescued) of a support.

    As :func:`sets.outcome` has it, but a support that isn't complete is measured against its own minimal ``proof`` where
    the question asks for yes or no and the answer is yes: exact if all of it is needed, else complete_nonminimal. Of several
    complete alternatives the one with the fewest units too many counts, then the smallest, then the first.
    """
    known = S.outcome(found, golds)
    true = F.lower(F.trim(F.coalesce(answer, F.lit("")))).isin("true", "yes", "1")
    rescued = F.coalesce(~known.isin("exact", "complete_nonminimal") & F.upper(query).contains("ASK") & true & proof.isNotNull(), F.lit(False))
    over = F.size(F.array_except(found, proof))
    near = S.reference(found, golds)
    return F.struct(
        F.when(rescued & (over == 0), "exact").when(rescued, "complete_nonminimal").otherwise(known).alias("outcome"),
        F.when(rescued, F.size(proof)).otherwise(near["size"]).alias("reference_size"), F.when(rescued, 0).otherwise(near["missing"]).alias("missing_units"),
        F.when(rescued, over).otherwise(near["extra"]).alias("additional_units"), rescued.alias("rescued"),
    )
