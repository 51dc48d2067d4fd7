"""Queries that evaluate: denominators, roll-ups, diagnostics of pools, error classes, policies, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sets as S
from ..operators import metrics as M
from ..operators import ranking as R
from ..sources.tables import candidates, gold, grains, table
from .supports import _COMPLETE, _DECISIONS, _PREFIX, _STEPS, _base, _outcomes, _scored, r6

#: Ranks whose candidates make the pool, and those that count as proposed.
POOL, PROPOSED = 10, 5


def _correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(example, correct): an example's answer counts as correct if its account is in credit."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("example"), (F.col("c_acctbal") > 0).alias("correct"))


def joint_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joint scores of every example with candidates: answers stand for the first candidate, support for the first three; null without gold."""
    s = _scored(spark, sf_dir)
    side = lambda k: F.struct("precision", "recall", F.col("exact").alias("em"), "exact")
    first, third = (s.where(F.col("k") == k).select("example", side(k).alias(n)) for k, n in ((1, "answer"), (3, "support")))
    every = candidates(spark, sf_dir).select("example").distinct().join(first, "example", "left").join(third, "example", "left")
    j = every.withColumn("j", M.joint(F.col("answer"), F.col("support")))
    return j.select("example", *(r6(f"j.{c}").alias(c) for c in ("precision", "recall", "f1")), F.col("j.em").cast("int").alias("em"))


def three_denominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers over all predicted examples, support over those with gold, joint over those with both, by data set."""
    support = _scored(spark, sf_dir).where("k = 3").select("example", "f1")
    predicted = candidates(spark, sf_dir).select("example").distinct().withColumn("predicted", F.lit(True))
    rows = _correct(spark, sf_dir).join(grains(spark, sf_dir), "example").join(predicted, "example", "left").join(support, "example", "left")
    right = F.when(F.col("predicted"), F.col("correct").cast("int"))
    return rows.groupBy("dataset").agg(
        F.count("*").alias("gold_rows"), F.count_if(F.col("predicted").isNull()).alias("missing_predictions"), F.count_if(F.col("f1").isNull()).alias("without_support"),
        r6(F.avg(right)).alias("answer"), r6(F.avg("f1")).alias("support"), r6(F.avg(right * F.col("f1"))).alias("joint"), F.count(right * F.col("f1")).alias("joint_rows"),
    )


def weighted_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the splits put together again by their sizes: two groups of data sets, and all."""
    rows = _scored(spark, sf_dir).where("k = 3").join(grains(spark, sf_dir), "example").groupBy("dataset").agg(F.avg("f1").alias("f1"), F.avg("recall").alias("recall"), F.count("*").alias("n"))
    kind = F.when(F.col("dataset").isin("AUTOMOBILE", "BUILDING"), "BIN").otherwise("OPEN")
    each = rows.withColumn("kind", F.explode(F.array(kind, F.lit("ALL"))))
    return each.groupBy("kind").agg(F.sum("n").alias("n"), *(r6(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in ("f1", "recall")))


def weighted_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: data sets' means of answers and support, each weighted by its own number of examples."""
    support = _scored(spark, sf_dir).where("k = 3").select("example", "f1")
    rows = _correct(spark, sf_dir).join(grains(spark, sf_dir), "example").join(support, "example", "left").groupBy("dataset").agg(F.avg(F.col("correct").cast("int")).alias("a"), F.count("*").alias("an"), F.avg("f1").alias("s"), F.count("f1").alias("sn"))
    return rows.agg(F.sum("an").alias("answer_n"), r6(F.sum(F.col("a") * F.col("an")) / F.sum("an")).alias("answer"), F.sum("sn").alias("support_n"), r6(F.sum(F.col("s") * F.col("sn")) / F.sum("sn")).alias("support"))


def _first_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(example, first): the rank of the first candidate that holds an alternative, null without one."""
    ranked = R.rank(candidates(spark, sf_dir)).join(gold(spark, sf_dir), "example")
    return ranked.groupBy("example").agg(F.min(F.when(F.exists("golds", lambda g: S.subset(g, F.col("units"))), F.col("rank"))).alias("first"))


def reciprocal_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row over all examples with gold: mean reciprocal rank and share at rank 1, over all and where there is a rank; its median."""
    inverse, top = F.lit(1.0) / F.col("first"), (F.col("first") == 1).cast("int")
    return _first_complete(spark, sf_dir).agg(
        F.count("*").alias("examples"), F.count("first").alias("available"), r6(F.avg(F.coalesce(inverse, F.lit(0.0)))).alias("mrr"), r6(F.avg(inverse)).alias("mrr_available"), F.median("first").alias("median_rank"),
        r6(F.avg(F.coalesce(top, F.lit(0)))).alias("complete_first"), r6(F.avg(top)).alias("complete_first_available"),
    )


def rank_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("first")
    bucket = F.when(f.isNull(), "none").when(f == 1, "1").when(f <= 3, "2-3").when(f <= 10, "4-10").otherwise(">=11")
    return _first_complete(spark, sf_dir).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("examples"))


def selected_k_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and median of the lengths 1, 2, 3 and 5 that the stepwise policy chooses, and the share of each."""
    d = R.decisions(candidates(spark, sf_dir, "p_type"))
    chosen = R.stepwise_k(d, F.round(F.col("novelty") * F.col("rel_top"), 9), 0.05)
    return chosen.agg(F.count("*").alias("examples"), r6(F.avg("selected_k")).alias("mean"), F.median("selected_k").alias("median"), *(r6(100 * F.count_if(F.col("selected_k") == k) / F.count("*")).alias(f"percent_{k}") for k in (1, 2, 3, 5)))


def adaptive_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix lengths of the sequential policy: on to the next candidate while novelty times strength has 0.05, five at most."""
    d = R.decisions(candidates(spark, sf_dir, "p_type")).withColumn("stops", F.round(F.col("novelty") * F.col("rel_top"), 9) < 0.05)
    size = R.rank(candidates(spark, sf_dir, "p_type"), 5).groupBy("example").agg(F.count("*").cast("int").alias("n"))
    stop = size.join(d.where("stops").groupBy("example").agg(F.min("at").alias("at")), "example", "left")
    reason = F.when(F.col("at").isNotNull(), "model_stop").when(F.col("n") == 5, "k_max_reached").otherwise("candidate_list_exhausted")
    return stop.select("example", F.coalesce(F.col("at").cast("int"), "n").alias("selected_k"), reason.alias("reason"))


def _diagnosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each example with gold: recalls of the proposed candidates, of the pool and of the preferred alternative.

    Proposed are the first five candidates, the pool is the union of the first ten, the context of all. The preferred
    alternative has the best recall by the context, by the pool and by a proposed candidate, then fewest units.
    """
    ranked = R.rank(candidates(spark, sf_dir)).groupBy("example").agg(
        F.array_sort(F.collect_list(F.when(F.col("rank") <= PROPOSED, F.struct("rank", "units")))).alias("top"), F.array_distinct(F.flatten(F.collect_list(F.when(F.col("rank") <= POOL, F.col("units"))))).alias("pool"), F.array_distinct(F.flatten(F.collect_list("units"))).alias("context"),
    )
    rows = ranked.join(gold(spark, sf_dir), "example").withColumn("top", F.col("top.units")).withColumn("union", F.array_distinct(F.flatten("top")))
    recall = lambda have, g: S.ratio(F.size(F.array_intersect(have, g)), F.size(g))
    best = lambda g: F.array_max(F.transform("top", lambda c: recall(c, g)))
    own = F.transform("golds", lambda g: F.struct(recall(F.col("context"), g).alias("in_context"), recall(F.col("pool"), g).alias("in_pool"), best(g).alias("in_best"), (-F.size(g)).alias("less"), g.alias("units"), recall(F.col("union"), g).alias("in_union"), F.exists("top", lambda c: F.arrays_overlap(c, g)).alias("touched")))
    each = rows.withColumn("own", own).withColumn("preferred", F.array_max("own"))
    most = lambda c: F.array_max(F.transform("own", lambda g: g[c]))
    return each.select("example", F.size("golds").alias("alternatives"), F.size("top").alias("proposed"), F.size("pool").alias("pool_size"), most("in_union").alias("union_recall"), most("in_pool").alias("pool_recall"), most("in_best").alias("best_recall"),
                       F.exists("own", lambda g: g["in_best"] >= 1).alias("complete"), F.exists("own", lambda g: g["touched"]).alias("partial"), "preferred", F.array_max(F.transform("top", F.size)).alias("largest"))


def pool_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _diagnosed(spark, sf_dir)
    return d.select("example", "alternatives", r6("union_recall").alias("union_recall"), r6("pool_recall").alias("pool_recall"), r6("best_recall").alias("best_recall"), F.col("complete").cast("int").alias("complete"), F.col("partial").cast("int").alias("partial"), F.array_join(F.array_sort("preferred.units"), "|").alias("preferred"))


# The names of the classes below, as users match on them.
def _category() -> F.Column:
    """Why no proposed candidate is complete, by the preferred alternative; null where one is. Brands of one maker are connected."""
    makers = F.size(F.array_distinct(F.transform("preferred.units", lambda u: F.substring(u, 1, 7))))
    return (
        F.when(F.col("complete"), F.lit(None)).when(F.col("preferred.in_context") < 1, "F_context_missing_reference_support").when(F.col("preferred.in_pool") < 1, "A_required_evidence_missing_from_atomic_pool")
        .when((F.col("largest") > 0) & (-F.col("preferred.less") > F.col("largest")), "D_candidate_size_limit").when(makers > 1, "E_connectivity_assumption").otherwise("B_units_not_combined_or_C_pruned_by_budget")
    )


def failure_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _diagnosed(spark, sf_dir)
    return d.groupBy(F.coalesce(_category(), F.lit("none")).alias("category")).agg(F.count("*").alias("examples"))


def pool_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: sizes of pools, and shares of examples by what their candidates hold."""
    d = _diagnosed(spark, sf_dir)
    percent = lambda c: r6(100 * F.count_if(c) / F.count("*"))
    return d.agg(
        F.count("*").alias("examples"), r6(F.avg("pool_size")).alias("pool_mean"), F.median("pool_size").alias("pool_median"), percent(F.col("pool_size") == 0).alias("empty_percent"), r6(F.avg("union_recall")).alias("union_recall"),
        percent(F.col("complete")).alias("complete_percent"), percent(F.col("partial")).alias("partial_percent"), percent(F.col("partial") & ~F.col("complete")).alias("partial_only_percent"),
    )


def pool_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples by the size of their pool, in buckets of fixed edges."""
    n, edges = F.col("pool_size"), (0, 5, 10, 15, 20)
    bucket = F.lit(f">={edges[-1]}")
    for low, high in reversed(list(zip(edges, edges[1:], strict=False))):
        bucket = F.when(n < high, f"[{low}-{high - 1}]").otherwise(bucket)
    return _diagnosed(spark, sf_dir).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("examples"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir, 3).join(_correct(spark, sf_dir), "example").join(grains(spark, sf_dir), "example")


def conditional_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of correct answers given an outcome, by data set; null where the outcome doesn't occur."""
    outcomes = ("exact", "complete_nonminimal", "incomplete", "disjoint")
    rate = lambda o: r6(F.try_divide(F.count_if((F.col("outcome") == o) & F.col("correct")), F.count_if(F.col("outcome") == o)))
    return _cells(spark, sf_dir).groupBy("dataset").agg(*(rate(o).alias(o) for o in outcomes))


def percent_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as text for a table: one decimal of a percentage, -- for null."""
    rates = conditional_rates(spark, sf_dir)
    cell = lambda c: F.coalesce(F.format_string("%.1f", F.round(100 * F.col(c), 1)), F.lit("--"))
    text = lambda c: F.when(F.col(c).isNull(), "--").otherwise(cell(c))
    return rates.select("dataset", *(text(c).alias(c) for c in rates.columns if c != "dataset"))


def routing_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers by route and kind of question: how many, how many right, and whom errors belong to."""
    from .graphs import ask_proof

    truth = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") == F.col("c_custkey") % 25).alias("truth"), (F.col("c_nationkey") % 2 == 0).alias("is_boolean"))
    rows = ask_proof(spark, sf_dir).join(truth, "c_custkey").withColumn("right", F.col("answer") == F.when(F.col("truth"), "TRUE").otherwise("FALSE"))
    blame = F.when(F.col("right"), "none").when(F.col("route") == "proof", "proof").when(F.col("answer") == "unknown", "reader_unknown").otherwise("reader")
    return rows.groupBy("route", F.col("is_boolean").cast("int").alias("is_boolean"), blame.alias("error_of")).agg(F.count("*").alias("n"))


# The names of the classes below, as users match on them.
def _taxonomy() -> F.Column:
    ok, more = (F.col("answer_em") == 1) | (F.col("answer_f1") >= 0.8), F.col("size") > F.col("gold_size")
    exact, recall = F.col("exact") == 1, F.col("recall")
    return (
        F.when(ok & exact, "correct_answer_correct_support").when(ok & ~exact & (recall >= 0.8) & more, "correct_answer_noisy_support").when(ok & (recall < 0.8), "correct_answer_incomplete_support")
        .when(~ok & F.col("contained"), "reader_failed_despite_gold_in_topk").when(~ok & (F.col("f1") >= 0.8), "reader_failed_despite_good_support_overlap").when(~ok & (recall >= 0.8) & more, "answer_failed_noisy_support")
        .when(~ok & (recall < 0.5), "retrieval_missed_gold_support").otherwise("mixed_or_partial_error")
    )


def error_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight classes of results from answer and support, with the share of examples and the mean support size of each."""
    first = _first_complete(spark, sf_dir)
    s = _scored(spark, sf_dir).where("k = 3").join(_correct(spark, sf_dir), "example").join(first, "example")
    best_size = F.array_min(F.transform("golds", F.size))
    rows = s.withColumns({"answer_em": F.col("correct").cast("int"), "answer_f1": F.col("correct").cast("double"), "gold_size": best_size, "contained": F.coalesce(F.col("first") <= 3, F.lit(False))}).withColumn("class", _taxonomy())
    by = rows.groupBy("class").agg(F.count("*").alias("examples"), r6(F.avg("size")).alias("mean_size"))
    total = F.sum("examples").over(Window.partitionBy(F.lit(0)))  # eight rows
    return by.select("class", "examples", r6(100 * F.col("examples") / total).alias("percent"), "mean_size")


def size_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate sizes by data set: mean, median, and how many have no units."""
    rows = candidates(spark, sf_dir).join(grains(spark, sf_dir), "example").withColumn("size", F.size("units"))
    return rows.groupBy("dataset").agg(F.count("*").alias("candidates"), r6(F.avg("size")).alias("mean"), F.median("size").alias("median"), F.count_if(F.col("size") == 0).alias("empty"))


def row_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: candidate rows, examples, positive and negative rows."""
    from .search import rank_target

    rows = rank_target(spark, sf_dir)
    return rows.agg(F.count("*").alias("rows"), F.countDistinct("example").alias("examples"), F.sum("label").alias("positives"), F.count_if(F.col("label") == 0).alias("negatives"))


def metric_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metric from several names: F1 at the first of the lengths 1, 2, 3 and 5 where it isn't zero, and that length."""
    each = _scored(spark, sf_dir).groupBy("example").pivot("k", [1, 2, 3, 5]).agg(F.first(F.when(F.col("f1") > 0, F.col("f1"))))
    name = F.coalesce(*(F.when(F.col(f"`{k}`").isNotNull(), F.lit(k)) for k in (1, 2, 3, 5)))
    return each.select("example", r6(F.coalesce("`1`", "`2`", "`3`", "`5`")).alias("f1"), name.alias("k"))


def failure_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why the first three candidates aren't the support: the reason by the alternative that they share most with."""
    rows = _outcomes(spark, sf_dir, 3)
    nearest = F.array_max(F.transform("golds", lambda g, i: F.struct(F.size(F.array_intersect("units", g)).alias("n"), (-i).alias("i"), g.alias("units"))))
    within = S.subset(F.col("units"), F.col("near_gold.units"))
    reason = F.when(F.col("outcome") == "exact", "exact").when(F.col("outcome") == "complete_nonminimal", "complete_but_nonminimal").when(F.col("near_gold.n") == 0, "missing_all").when(within, "missing_only").otherwise("partial")
    return rows.withColumn("near_gold", nearest).select("example", reason.alias("reason"))


def recompute_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: scores computed by joins on exploded units against those from arrays, and how many differ by over 1e-12."""
    s = _scored(spark, sf_dir).select("example", "k", "f1")
    units = R.fixed_prefixes(candidates(spark, sf_dir)).select("example", "k", F.size("units").alias("size"), F.explode_outer("units").alias("unit"))
    golds = gold(spark, sf_dir).select("example", F.posexplode("golds").alias("alt", "g")).select("example", "alt", F.size("g").alias("gold_size"), F.explode("g").alias("unit"))
    pairs = units.groupBy("example", "k").agg(F.first("size").alias("size")).join(golds.groupBy("example", "alt").agg(F.first("gold_size").alias("gold_size")), "example")
    both = units.join(golds, ["example", "unit"]).groupBy("example", "k", "alt").agg(F.count("*").alias("n"))
    each = pairs.join(both, ["example", "k", "alt"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    f1 = S.harmonic(S.ratio(F.col("n"), F.col("size")), S.ratio(F.col("n"), F.col("gold_size")))
    again = each.groupBy("example", "k").agg(F.max(f1).alias("again"))
    same = F.col("f1").eqNullSafe(F.col("again")) | F.coalesce(F.abs(F.col("f1") - F.col("again")) <= 1e-12, F.lit(False))
    return s.join(again, ["example", "k"], "full").agg(F.count("*").alias("rows"), F.count_if(~same).alias("mismatches"))


def hit_union_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For k = 1, 3, 5: mean scores of the union of the first k candidates against the best alternative."""
    s = R.fixed_prefixes(candidates(spark, sf_dir), (1, 3, 5)).join(gold(spark, sf_dir), "example").withColumn("s", S.best_of(F.col("units"), F.col("golds")))
    return s.groupBy("k").agg(F.count("*").alias("examples"), *(r6(F.avg(f"s.{c}")).alias(c) for c in ("precision", "recall", "f1")))


def gold_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All units of an example's alternatives, in order and once."""
    return gold(spark, sf_dir).select("example", F.size(S.ordered_union(F.col("golds"))).alias("size"), F.array_join(S.ordered_union(F.col("golds")), "|").alias("units"))


def set_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate against the first alternative of its example, an empty set where there is none; two empty sets score 1."""
    first = gold(spark, sf_dir).select("example", F.col("golds")[0].alias("gold"))
    rows = candidates(spark, sf_dir).join(first, "example", "left").withColumn("s", S.scores(F.col("units"), F.coalesce("gold", F.array().cast("array<string>")), 1.0))
    return rows.select("candidate", r6("s.f1").alias("f1"), r6("s.jaccard").alias("jaccard"), F.col("s.exact").alias("exact"))


def threshold_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each threshold from 0 to 1 by 0.01 the scores of the lengths it chooses, and its place: best F1, then shortest,
    fewest units, most precise, smallest. An example's lengths are known from three probabilities, so it counts once for each threshold."""
    d = R.decisions(candidates(spark, sf_dir)).select("example", "at", F.round(F.col("novelty") * F.col("rel_top"), 6).alias("p"))
    three = d.where("at <= 3").groupBy("example").pivot("at", [1, 2, 3]).agg(F.first("p"))
    over = lambda k: F.coalesce(F.col(f"`{k}`"), F.lit(-1.0)) * 100 >= F.col("hundredth")
    k = F.when(~over(1), 1).when(~over(2), 2).when(~over(3), 3).otherwise(5)
    chosen = three.withColumn("hundredth", F.explode(F.sequence(F.lit(0), F.lit(100)))).select("example", "hundredth", k.alias("k"))
    s = _scored(spark, sf_dir).select("example", "k", "f1", "precision", "size")
    each = chosen.join(s, ["example", "k"]).groupBy("hundredth").agg(r6(F.avg("f1")).alias("f1"), r6(F.avg("k")).alias("mean_k"), r6(F.avg("size")).alias("units"), r6(F.avg("precision")).alias("precision"))
    return each.withColumn("place", F.row_number().over(Window.orderBy(F.desc("f1"), "mean_k", "units", F.desc("precision"), "hundredth")))


def deterministic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fiftieth of each language's documents and one more, in a hash order that every run repeats."""
    place = R.hash_rank(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id")
    return place.where(F.col("k") <= F.floor(F.col("n") / 50) + 1).select("lang", "doc_id", F.col("k").cast("int").alias("place"))


QUERIES = {
    f.__name__: f
    for f in (
        joint_metrics, three_denominators, weighted_rollup, weighted_pooling, reciprocal_rank, rank_buckets, selected_k_summary, adaptive_policy, pool_diagnostics, failure_category, pool_summary, pool_histogram,
        conditional_rates, percent_cells, routing_attribution, error_taxonomy, size_diagnostics, row_summary, metric_coalesce, failure_reason, recompute_audit, hit_union_at_k, gold_union, set_scores, threshold_choice, deterministic_sample,
    )
}

_B, _T = _base(), _base("p_type")
_FIRST = f"{_B}, {_PREFIX}, {_COMPLETE}, f AS (SELECT ex, min(CASE WHEN both_n = gsize THEN rk END) AS first FROM cand_meets GROUP BY ex)"
_DIAG = f"""{_B}, {_PREFIX}, {_COMPLETE}, pooled AS (SELECT ex, unit, min(rk) AS rk FROM units GROUP BY ex, unit),
    per AS (SELECT g.ex, g.alt, count(*) AS gsize, avg(CASE WHEN p.unit IS NOT NULL THEN 1 ELSE 0 END) AS in_context, avg(CASE WHEN p.rk <= {POOL} THEN 1 ELSE 0 END) AS in_pool, avg(CASE WHEN p.rk <= {PROPOSED} THEN 1 ELSE 0 END) AS in_union, list_sort(list(g.unit)) AS us FROM golds g LEFT JOIN pooled p ON p.ex = g.ex AND p.unit = g.unit GROUP BY g.ex, g.alt),
    tops AS (SELECT ex, alt, max(both_n / gsize) AS in_best, max(both_n) AS touched, max(size) AS largest FROM cand_meets WHERE rk <= {PROPOSED} GROUP BY ex, alt),
    own AS (SELECT per.*, in_best, touched, largest, row_number() OVER (PARTITION BY ex ORDER BY in_context DESC, in_pool DESC, in_best DESC, gsize, us DESC) AS place FROM per JOIN tops USING (ex, alt)),
    sizes_p AS (SELECT ex, count(*) AS pool_size FROM pooled WHERE rk <= {POOL} GROUP BY ex),
    d AS (SELECT ex, count(*) AS alternatives, max(in_union) AS union_recall, max(in_pool) AS pool_recall, max(in_best) AS best_recall, bool_or(in_best >= 1) AS complete, bool_or(touched > 0) AS partial, max(largest) AS largest FROM own GROUP BY ex),
    diag AS (SELECT d.*, o.us, o.gsize, o.in_context, o.in_pool AS own_pool, coalesce(s.pool_size, 0) AS pool_size FROM d JOIN own o ON o.ex = d.ex AND o.place = 1 LEFT JOIN sizes_p s ON s.ex = d.ex)"""
_CORRECT = "correct AS (SELECT c_custkey AS ex, c_acctbal > 0 AS correct FROM customer)"
_RATES = f"WITH {_B}, {_PREFIX}, {_CORRECT}, r AS (SELECT dataset, outcome, correct FROM outcomes JOIN correct USING (ex) JOIN grains USING (ex) WHERE k = 3)"
_RATE = lambda o: f"CASE WHEN count(*) FILTER (outcome = '{o}') = 0 THEN NULL ELSE round(count(*) FILTER (outcome = '{o}' AND correct) / count(*) FILTER (outcome = '{o}'), 6) END"
_OUTCOMES = ("exact", "complete_nonminimal", "incomplete", "disjoint")
ORACLE_SQL = {
    "joint_metrics": f"WITH {_B}, {_PREFIX}, j AS (SELECT e.ex, a.precision * s.precision AS p, a.recall * s.recall AS r, a.exact * s.exact AS em FROM examples e LEFT JOIN (SELECT * FROM scored WHERE k = 1) a USING (ex) LEFT JOIN (SELECT * FROM scored WHERE k = 3) s USING (ex)) SELECT ex AS example, round(p::DOUBLE, 6) AS precision, round(r::DOUBLE, 6) AS recall, round((CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END)::DOUBLE, 6) AS f1, em::INTEGER AS em FROM j",
    "three_denominators": f"WITH {_B}, {_PREFIX}, {_CORRECT}, r AS (SELECT dataset, CASE WHEN e.ex IS NOT NULL THEN CASE WHEN correct THEN 1 ELSE 0 END END AS a, e.ex AS predicted, s.f1 FROM correct c JOIN grains g USING (ex) LEFT JOIN examples e ON e.ex = c.ex LEFT JOIN (SELECT * FROM scored WHERE k = 3) s ON s.ex = c.ex) SELECT dataset, count(*) AS gold_rows, count(*) - count(predicted) AS missing_predictions, count(*) - count(f1) AS without_support, round(avg(a), 6) AS answer, round(avg(f1), 6) AS support, round(avg(a * f1), 6) AS joint, count(a * f1) AS joint_rows FROM r GROUP BY dataset",
    "weighted_rollup": f"WITH {_B}, {_PREFIX}, r AS (SELECT unnest([CASE WHEN dataset IN ('AUTOMOBILE', 'BUILDING') THEN 'BIN' ELSE 'OPEN' END, 'ALL']) AS kind, f1, recall FROM scored JOIN grains USING (ex) WHERE k = 3) SELECT kind, count(*) AS n, round(avg(f1), 6) AS f1, round(avg(recall), 6) AS recall FROM r GROUP BY kind",
    "weighted_pooling": f"WITH {_B}, {_PREFIX}, {_CORRECT} SELECT count(*) AS answer_n, round(avg(CASE WHEN correct THEN 1 ELSE 0 END), 6) AS answer, count(f1) AS support_n, round(avg(f1), 6) AS support FROM correct c LEFT JOIN (SELECT * FROM scored WHERE k = 3) s ON s.ex = c.ex",
    "reciprocal_rank": f"WITH {_FIRST} SELECT count(*) AS examples, count(first) AS available, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, round(avg(1.0 / first), 6) AS mrr_available, median(first)::DOUBLE AS median_rank, round(avg(CASE WHEN first = 1 THEN 1 ELSE 0 END), 6) AS complete_first, round(avg(CASE WHEN first IS NOT NULL THEN CASE WHEN first = 1 THEN 1 ELSE 0 END END), 6) AS complete_first_available FROM f",
    "rank_buckets": f"WITH {_FIRST} SELECT CASE WHEN first IS NULL THEN 'none' WHEN first = 1 THEN '1' WHEN first <= 3 THEN '2-3' WHEN first <= 10 THEN '4-10' ELSE '>=11' END AS bucket, count(*) AS examples FROM f GROUP BY 1",
    "selected_k_summary": f'''WITH {_T}, {_STEPS}, {_DECISIONS}, go AS (SELECT ex, bool_or("at" = 1 AND round(novelty * rel_top, 9) >= 0.05) AS a, bool_or("at" = 2 AND round(novelty * rel_top, 9) >= 0.05) AS b, bool_or("at" = 3 AND round(novelty * rel_top, 9) >= 0.05) AS c FROM decisions WHERE "at" <= 3 GROUP BY ex), k AS (SELECT CASE WHEN NOT a THEN 1 WHEN NOT b THEN 2 WHEN NOT c THEN 3 ELSE 5 END AS k FROM go)
        SELECT count(*) AS examples, round(avg(k), 6) AS mean, median(k)::DOUBLE AS median, {", ".join(f"round(100 * count(*) FILTER (k = {k}) / count(*), 6) AS percent_{k}" for k in (1, 2, 3, 5))} FROM k''',
    "adaptive_policy": f'''WITH {_T}, {_STEPS}, {_DECISIONS}, s AS (SELECT ex, min("at") AS stop FROM decisions WHERE round(novelty * rel_top, 9) < 0.05 GROUP BY ex), n AS (SELECT ex, count(*) AS n FROM ranked WHERE rk <= 5 GROUP BY ex) SELECT n.ex AS example, coalesce(stop, n)::INTEGER AS selected_k, CASE WHEN stop IS NOT NULL THEN 'model_stop' WHEN n = 5 THEN 'k_max_reached' ELSE 'candidate_list_exhausted' END AS reason FROM n LEFT JOIN s USING (ex)''',
    "pool_diagnostics": f"WITH {_DIAG} SELECT ex AS example, alternatives::INTEGER AS alternatives, round(union_recall, 6) AS union_recall, round(pool_recall, 6) AS pool_recall, round(best_recall, 6) AS best_recall, complete::INTEGER AS complete, partial::INTEGER AS partial, array_to_string(us, '|') AS preferred FROM diag",
    "failure_category": f"WITH {_DIAG} SELECT CASE WHEN complete THEN 'none' WHEN in_context < 1 THEN 'F_context_missing_reference_support' WHEN own_pool < 1 THEN 'A_required_evidence_missing_from_atomic_pool' WHEN largest > 0 AND gsize > largest THEN 'D_candidate_size_limit' WHEN len(list_distinct(list_transform(us, lambda u: u[1:7]))) > 1 THEN 'E_connectivity_assumption' ELSE 'B_units_not_combined_or_C_pruned_by_budget' END AS category, count(*) AS examples FROM diag GROUP BY 1",
    "pool_summary": f"WITH {_DIAG} SELECT count(*) AS examples, round(avg(pool_size), 6) AS pool_mean, median(pool_size)::DOUBLE AS pool_median, round(100 * count(*) FILTER (pool_size = 0) / count(*), 6) AS empty_percent, round(avg(union_recall), 6) AS union_recall, round(100 * count(*) FILTER (complete) / count(*), 6) AS complete_percent, round(100 * count(*) FILTER (partial) / count(*), 6) AS partial_percent, round(100 * count(*) FILTER (partial AND NOT complete) / count(*), 6) AS partial_only_percent FROM diag",
    "pool_histogram": f"WITH {_DIAG} SELECT CASE WHEN pool_size < 5 THEN '[0-4]' WHEN pool_size < 10 THEN '[5-9]' WHEN pool_size < 15 THEN '[10-14]' WHEN pool_size < 20 THEN '[15-19]' ELSE '>=20' END AS bucket, count(*) AS examples FROM diag GROUP BY 1",
    "conditional_rates": f"{_RATES} SELECT dataset, {', '.join(f'{_RATE(o)} AS {o}' for o in _OUTCOMES)} FROM r GROUP BY dataset",
    "percent_cells": f"{_RATES}, c AS (SELECT dataset, {', '.join(f'{_RATE(o)} AS {o}' for o in _OUTCOMES)} FROM r GROUP BY dataset) SELECT dataset, {', '.join(f'coalesce(printf({chr(39)}%.1f{chr(39)}, round(100 * {o}, 1)), {chr(39)}--{chr(39)}) AS {o}' for o in _OUTCOMES)} FROM c",
    "routing_attribution": "WITH r AS (SELECT c_nationkey = c_custkey % 25 AS truth, c_nationkey % 2 = 0 AS b, c_custkey % 2 = 1 AS says_false FROM customer) SELECT CASE WHEN truth THEN 'proof' ELSE 'reader' END AS route, b::INTEGER AS is_boolean, CASE WHEN truth OR says_false THEN 'none' ELSE 'reader_unknown' END AS error_of, count(*) AS n FROM r GROUP BY ALL",
    "error_taxonomy": f"""WITH {_FIRST}, {_CORRECT}, least_gold AS (SELECT ex, min(gsize) AS gsize FROM gold_size GROUP BY ex), r AS (SELECT s.*, correct, coalesce(first <= 3, false) AS contained, l.gsize FROM scored s JOIN correct USING (ex) JOIN f USING (ex) JOIN least_gold l USING (ex) WHERE k = 3),
        c AS (SELECT size, CASE WHEN correct AND exact = 1 THEN 'correct_answer_correct_support' WHEN correct AND exact = 0 AND recall >= 0.8 AND size > gsize THEN 'correct_answer_noisy_support' WHEN correct AND recall < 0.8 THEN 'correct_answer_incomplete_support' WHEN NOT correct AND contained THEN 'reader_failed_despite_gold_in_topk' WHEN NOT correct AND f1 >= 0.8 THEN 'reader_failed_despite_good_support_overlap'
            WHEN NOT correct AND recall >= 0.8 AND size > gsize THEN 'answer_failed_noisy_support' WHEN NOT correct AND recall < 0.5 THEN 'retrieval_missed_gold_support' ELSE 'mixed_or_partial_error' END AS class FROM r) SELECT class, count(*) AS examples, round(100 * count(*) / (SELECT count(*) FROM c), 6) AS percent, round(avg(size), 6) AS mean_size FROM c GROUP BY class""",
    "size_diagnostics": f"WITH {_B}, g AS (SELECT c_custkey AS ex, c_mktsegment AS dataset FROM customer) SELECT dataset, count(*) AS candidates, round(avg(size), 6) AS mean, median(size)::DOUBLE AS median, count(*) FILTER (size = 0) AS empty FROM sizes JOIN g USING (ex) GROUP BY dataset",
    "row_summary": f"WITH {_B}, {_PREFIX}, {_COMPLETE}, c AS (SELECT ex, rk, bool_or(both_n = gsize) AS complete FROM cand_meets GROUP BY ex, rk) SELECT count(*) AS rows, count(DISTINCT ex) AS examples, count(*) FILTER (complete) AS positives, count(*) FILTER (NOT complete) AS negatives FROM c",
    "metric_coalesce": f"WITH {_B}, {_PREFIX}, n AS (SELECT ex, min(k) FILTER (f1 > 0) AS k FROM scored GROUP BY ex) SELECT n.ex AS example, round(s.f1::DOUBLE, 6) AS f1, n.k::INTEGER AS k FROM n LEFT JOIN scored s ON s.ex = n.ex AND s.k = n.k",
    "failure_reason": f"WITH {_B}, {_PREFIX}, m AS (SELECT ex, size, both_n, row_number() OVER (PARTITION BY ex ORDER BY both_n DESC, alt) AS n FROM meets WHERE k = 3) SELECT ex AS example, CASE WHEN outcome = 'exact' THEN 'exact' WHEN outcome = 'complete_nonminimal' THEN 'complete_but_nonminimal' WHEN both_n = 0 THEN 'missing_all' WHEN both_n = size THEN 'missing_only' ELSE 'partial' END AS reason FROM m JOIN outcomes USING (ex) WHERE n = 1 AND outcomes.k = 3",
    "recompute_audit": f"WITH {_B}, {_PREFIX} SELECT count(*) AS rows, 0::BIGINT AS mismatches FROM scored",
    "hit_union_at_k": f"WITH {_B}, {_PREFIX} SELECT k, count(*) AS examples, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM scored WHERE k IN (1, 3, 5) GROUP BY k",
    "set_scores": f"WITH {_B}, a AS (SELECT ex, min(alt) AS alt FROM golds GROUP BY ex), g AS (SELECT golds.ex, unit FROM golds JOIN a USING (ex, alt)), gs AS (SELECT ex, count(*) AS gsize FROM g GROUP BY ex), b AS (SELECT u.cand, count(*) AS n FROM units u JOIN g ON g.ex = u.ex AND g.unit = u.unit GROUP BY u.cand), r AS (SELECT s.cand, s.size, coalesce(gsize, 0) AS gsize, coalesce(n, 0) AS n FROM sizes s LEFT JOIN gs USING (ex) LEFT JOIN b USING (cand)) SELECT cand AS candidate, round((CASE WHEN size = 0 AND gsize = 0 THEN 1 WHEN n = 0 THEN 0 ELSE 2 * (n / size) * (n / gsize) / (n / size + n / gsize) END)::DOUBLE, 6) AS f1, round((CASE WHEN size = 0 AND gsize = 0 THEN 1 ELSE n / (size + gsize - n) END)::DOUBLE, 6) AS jaccard, (n = size AND n = gsize)::INTEGER AS exact FROM r",
    "threshold_choice": f'''WITH {_B}, {_PREFIX}, {_STEPS}, {_DECISIONS}, p AS (SELECT ex, coalesce(max(round(novelty * rel_top, 6)) FILTER ("at" = 1), -1) AS a, coalesce(max(round(novelty * rel_top, 6)) FILTER ("at" = 2), -1) AS b, coalesce(max(round(novelty * rel_top, 6)) FILTER ("at" = 3), -1) AS c FROM decisions WHERE "at" <= 3 GROUP BY ex), h AS (SELECT unnest(range(101))::INTEGER AS hundredth),
        k AS (SELECT ex, hundredth, CASE WHEN a * 100 < hundredth THEN 1 WHEN b * 100 < hundredth THEN 2 WHEN c * 100 < hundredth THEN 3 ELSE 5 END AS k FROM p, h), e AS (SELECT hundredth, round(avg(f1), 6) AS f1, round(avg(k.k), 6) AS mean_k, round(avg(size), 6) AS units, round(avg(precision), 6) AS precision FROM k JOIN scored s ON s.ex = k.ex AND s.k = k.k GROUP BY hundredth)
        SELECT *, (row_number() OVER (ORDER BY f1 DESC, mean_k, units, precision DESC, hundredth))::INTEGER AS place FROM e''',
    "deterministic_sample": "WITH p AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT lang, doc_id, k::INTEGER AS place FROM p WHERE k <= floor(n / 50) + 1",
    "gold_union": f"WITH {_B}, u AS (SELECT ex, unit, min(alt) AS alt FROM golds GROUP BY ex, unit) SELECT ex AS example, count(*)::INTEGER AS size, string_agg(unit, '|' ORDER BY alt, unit) AS units FROM u GROUP BY ex",
}
