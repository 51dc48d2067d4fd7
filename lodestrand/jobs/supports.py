"""Queries on ranked candidates: prefixes, adaptive choices, set scores, outcomes, aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sets as S
from ..functions import text as X
from ..operators import metrics as M
from ..operators import ranking as R
from ..sources.tables import candidates, gold, grains, table

THRESHOLD = 0.1


def r6(x) -> F.Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6)


def rank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rank(candidates(spark, sf_dir)).select("example", "candidate", "rank", F.size("units").alias("size"))


def candidate_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).select("candidate", X.identity(F.col("units")).alias("identity"))


def candidate_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 8 candidates of an example that come first without supervision: by score, size, units."""
    order = Window.partitionBy("example").orderBy(F.desc("score"), F.size("units"), "units", "candidate")
    return candidates(spark, sf_dir, "p_type").withColumn("place", F.row_number().over(order)).where(F.col("place") <= 8).select("example", "candidate", "place")


def fixed_k_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fixed_prefixes(candidates(spark, sf_dir)).select("example", "k", F.size("units").alias("size"), F.array_join("units", "|").alias("units"))


def adaptive_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.adaptive(candidates(spark, sf_dir, "p_type"), THRESHOLD)
    return found.select("example", "selected_k", "reason", F.size("units").alias("size"))


def decision_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.decisions(candidates(spark, sf_dir, "p_type"))
    return d.select("example", "at", *(r6(c).alias(c) for c in ("cur", "nxt", "rel_top", "gap", "novelty", "overlap")), "cum_size", "next_size", "new_units")


def stepwise_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix lengths by the transitions 1, 2, 3, 5, with the novelty times the strength of the next as its probability."""
    d = R.decisions(candidates(spark, sf_dir, "p_type"))
    return R.stepwise_k(d, F.round(F.col("novelty") * F.col("rel_top"), 9), 0.05).groupBy("selected_k").agg(F.count("*").alias("examples"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = R.fixed_prefixes(candidates(spark, sf_dir)).join(gold(spark, sf_dir), "example")
    return each.withColumn("s", S.best_of(F.col("units"), F.col("golds"))).select("example", "k", "units", "golds", F.size("units").alias("size"), "s.*")


def best_alternative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("example", "k", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"))


def best_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).select("example", "k", r6("f1").alias("f1"), "size")
    return R.best_prefix(rows)


def pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _scored(spark, sf_dir).select("example", "k", r6("precision").alias("precision"), r6("recall").alias("recall"), "size")
    return R.pareto(points).groupBy("k").agg(F.count("*").alias("undominated"))


def saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples whose F1 moves by 0.01 at most from k = 2 on."""
    rows = _scored(spark, sf_dir).where("k >= 2").groupBy("example").agg(F.round(F.max("f1") - F.min("f1"), 6).alias("spread"))
    return rows.agg(F.count("*").alias("examples"), F.count_if(F.col("spread") <= 0.01).alias("saturated"))


def macro_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).where("k = 1").join(grains(spark, sf_dir), "example")
    means = M.macro_and_pooled(rows, "dataset", "precision", "recall", "f1")
    return means.select(*(r6(c).alias(c) for c in means.columns))


def split_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean scores by data set, by domain, by both, and over all."""
    rows = _scored(spark, sf_dir).join(grains(spark, sf_dir), "example").withColumn("domain", F.col("domain").cast("string"))
    sets = rows.groupingSets([["k"], ["k", "dataset"], ["k", "domain"], ["k", "dataset", "domain"]], "k", "dataset", "domain")
    return sets.agg(F.count("*").alias("n"), F.round(F.avg("f1"), 6).alias("f1"), F.round(F.avg("recall"), 6).alias("recall"), F.sum("exact").alias("exact")).select("k", F.coalesce("dataset", F.lit("all")).alias("dataset"), F.coalesce("domain", F.lit("all")).alias("domain"), "n", "f1", "recall", "exact")


def hit_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For k = 1, 3, 5: share of examples with an exact, a complete, and any hit among the first k candidates; best F1."""
    ranked = R.rank(candidates(spark, sf_dir), 5).join(gold(spark, sf_dir), "example")
    own = ranked.withColumn("s", S.best_of(F.col("units"), F.col("golds"))).withColumn("complete", F.exists("golds", lambda g: S.subset(g, F.col("units"))).cast("int"))
    each = own.withColumn("k", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5)))).where("rank <= k")
    best = each.groupBy("k", "example").agg(F.max("s.exact").alias("exact"), F.max("complete").alias("complete"), F.max(F.col("s.f1")).alias("f1"))
    return best.groupBy("k").agg(F.count("*").alias("examples"), r6(F.avg("exact")).alias("exact"), r6(F.avg("complete")).alias("complete"), r6(F.avg((F.col("f1") > 0).cast("int"))).alias("hit"), r6(F.avg("f1")).alias("best_f1"))


def selected_k_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and shares of the adaptive lengths over 1 to 5, absent ones as 0."""
    found = R.adaptive(candidates(spark, sf_dir, "p_type"), THRESHOLD).groupBy("selected_k").agg(F.count("*").alias("n"))
    domain = spark.range(1, 6).select(F.col("id").cast("int").alias("selected_k"))
    every = domain.join(found, "selected_k", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # five rows
    return every.select("selected_k", "n", r6(100 * F.col("n") / total).alias("percent"))


def size_score_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates(spark, sf_dir).select("example", F.size("units").cast("double").alias("size"), (F.col("score") / 1000).alias("score"))
    return rows.groupBy("example").agg(F.round(M.pearson(F.col("size"), F.col("score")), 4).alias("pearson"))


def score_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.lists(candidates(spark, sf_dir)).select("example", F.round(F.greatest("spread", F.lit(R.EPSILON)), 4).alias("scale"))


def _outcomes(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    rows = R.fixed_prefixes(candidates(spark, sf_dir), (k,)).join(gold(spark, sf_dir), "example")
    return rows.withColumn("outcome", S.outcome(F.col("units"), F.col("golds"))).withColumn("near", S.reference(F.col("units"), F.col("golds")))


def stagewise_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir, 3).select("example", "outcome", F.col("near.missing").alias("missing"), F.col("near.extra").alias("extra"), F.col("near.size").alias("reference_size"))


def stagewise_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome by correctness, overall and by grain; an example counts as correct if its account is in credit."""
    correct = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("example"), (F.col("c_acctbal") > 0).alias("correct"))
    rows = _outcomes(spark, sf_dir, 3).join(correct, "example").join(grains(spark, sf_dir), "example")
    return M.outcome_cells(rows.select("outcome", "correct", "dataset", "domain"), "dataset", "domain")


def outcome_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.transitions(_outcomes(spark, sf_dir, 1), _outcomes(spark, sf_dir, 3))


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean length and novelty that each threshold from 0 to 1 by 0.01 lets through, and which threshold is best.

    Decisions are counted by the hundredth their probability falls in before they meet the 101 thresholds, so the sweep
    is over at most 101 rows at any input.
    """
    d = R.decisions(candidates(spark, sf_dir, "p_type")).select(F.floor(F.round(F.col("novelty") * F.col("rel_top"), 6) * 100).cast("int").alias("cell"), "new_units", "next_size")
    cells = d.groupBy("cell").agg(F.count("*").alias("n"), F.sum("new_units").alias("new"), F.sum("next_size").alias("size"))
    swept = spark.range(0, 101).select(F.col("id").cast("int").alias("hundredth")).join(F.broadcast(cells), F.col("cell") >= F.col("hundredth"), "left")
    each = swept.groupBy("hundredth").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("taken"), r6(S.ratio(F.coalesce(F.sum("new"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0)))).alias("novel_share"))
    return each.withColumn("place", F.row_number().over(Window.orderBy(F.desc("novel_share"), F.desc("taken"), "hundredth")))


def benchmark_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support scores averaged over all examples with gold, a missing prediction counting as 0."""
    scored = _scored(spark, sf_dir).where("k = 1").select("example", "precision", "recall", "f1", "exact")
    every = gold(spark, sf_dir).select("example").join(scored, "example", "left")
    return every.agg(F.count("*").alias("gold_rows"), F.count_if(F.col("f1").isNull()).alias("missing"), *(r6(F.sum(F.coalesce(c, F.lit(0))) / F.count("*")).alias(c) for c in ("precision", "recall", "f1", "exact")))


QUERIES = {
    f.__name__: f
    for f in (
        rank_candidates, candidate_identity, candidate_cap, fixed_k_union, adaptive_prefix, decision_features, stepwise_selection, best_alternative, best_prefix, pareto_front,
        saturation, macro_pooled, split_metrics, hit_at_k, selected_k_distribution, size_score_pearson, score_scale, stagewise_outcome, stagewise_cells,
        outcome_transitions, threshold_sweep, benchmark_eval,
    )
}


def _base(unit: str = "p_brand") -> str:
    """Relations: ranked(ex, cand, score, rk), units(ex, cand, rk, unit, pos) with distinct units, golds(ex, alt, unit)."""
    return f"""
    ranked AS (SELECT o_custkey AS ex, o_orderkey AS cand, o_totalprice AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM orders),
    line_units AS (SELECT l_orderkey, {unit} AS unit, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos FROM lineitem JOIN part ON p_partkey = l_partkey),
    units AS (SELECT ex, cand, rk, unit, min(pos) AS pos FROM ranked JOIN line_units ON l_orderkey = cand GROUP BY ex, cand, rk, unit),
    sizes AS (SELECT r.ex, r.cand, r.rk, r.score, count(u.unit) AS size FROM ranked r LEFT JOIN units u USING (cand) GROUP BY r.ex, r.cand, r.rk, r.score),
    first_seen AS (SELECT ex, unit, rk, pos FROM (SELECT *, row_number() OVER (PARTITION BY ex, unit ORDER BY rk, pos) AS n FROM units) WHERE n = 1),
    golds AS (SELECT DISTINCT o_custkey AS ex, CASE l_returnflag WHEN 'R' THEN 0 ELSE 1 END AS alt, p_brand AS unit FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE l_discount >= 0.08 AND l_returnflag IN ('R', 'A'))"""


_PREFIX = """
    ks AS (SELECT unnest([1, 2, 3, 5])::INTEGER AS k),
    examples AS (SELECT DISTINCT ex FROM ranked),
    prefix AS (SELECT e.ex, k, f.unit, f.rk, f.pos FROM examples e CROSS JOIN ks LEFT JOIN first_seen f ON f.ex = e.ex AND f.rk <= k),
    prefix_size AS (SELECT ex, k, count(unit) AS size FROM prefix GROUP BY ex, k),
    gold_size AS (SELECT ex, alt, count(*) AS gsize FROM golds GROUP BY ex, alt),
    meets AS (SELECT s.ex, s.k, s.size, g.alt, g.gsize, count(x.unit) AS both_n FROM prefix_size s JOIN gold_size g USING (ex) LEFT JOIN (SELECT p.ex, p.k, p.unit, g.alt FROM prefix p JOIN golds g ON g.ex = p.ex AND g.unit = p.unit) x ON x.ex = s.ex AND x.k = s.k AND x.alt = g.alt GROUP BY ALL),
    alts AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE both_n / size END AS p, CASE WHEN gsize = 0 THEN 0 ELSE both_n / gsize END AS r FROM meets),
    alt_f1 AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f FROM alts),
    scored AS (SELECT ex, k, size, CASE WHEN f > 0 THEN p ELSE 0 END AS precision, CASE WHEN f > 0 THEN r ELSE 0 END AS recall, f AS f1, CASE WHEN both_n = size AND both_n = gsize THEN 1 ELSE 0 END AS exact FROM (SELECT *, row_number() OVER (PARTITION BY ex, k ORDER BY f DESC, alt) AS n FROM alt_f1) WHERE n = 1),
    grains AS (SELECT c_custkey AS ex, c_mktsegment AS dataset, n_regionkey AS domain FROM customer JOIN nation ON n_nationkey = c_nationkey),
    outcomes AS (SELECT ex, k, CASE WHEN bool_or(both_n = size AND both_n = gsize) THEN 'exact' WHEN bool_or(both_n = gsize) THEN 'complete_nonminimal' WHEN bool_or(both_n > 0) THEN 'incomplete' ELSE 'disjoint' END AS outcome FROM meets GROUP BY ex, k)"""
_STEPS = """
    top5 AS (SELECT s.*, first_value(score) OVER (PARTITION BY ex ORDER BY rk) AS top, (SELECT count(*) FROM first_seen f WHERE f.ex = s.ex AND f.rk = s.rk) AS fresh FROM sizes s WHERE rk <= 5),
    spreads AS (SELECT ex, stddev_pop(score) AS sd, count(*) AS n FROM top5 GROUP BY ex)"""
_DECISIONS = """
    steps AS (SELECT ex, rk AS "at", score AS cur, lead(score) OVER w AS nxt, top, lead(size) OVER w AS next_size, lead(fresh) OVER w AS new_units, sum(fresh) OVER (PARTITION BY ex ORDER BY rk) AS cum_size, greatest(sd, 1e-12) AS scale FROM top5 JOIN spreads USING (ex) WINDOW w AS (PARTITION BY ex ORDER BY rk)),
    decisions AS (SELECT ex, "at", cur, nxt, exp((nxt - top) / scale) AS rel_top, (cur - nxt) / scale AS gap, cum_size, next_size, new_units, CASE WHEN next_size = 0 THEN 0 ELSE new_units / next_size END AS novelty, CASE WHEN next_size = 0 THEN 0 ELSE (next_size - new_units) / next_size END AS overlap FROM steps WHERE nxt IS NOT NULL)"""
_ADAPTIVE = f"""
    utility AS (SELECT ex, rk, CASE WHEN sd <= 1e-12 THEN 1 ELSE exp((score - top) / greatest(sd, 1e-12)) END * CASE WHEN size = 0 THEN 0 ELSE fresh / size END AS u, n FROM top5 JOIN spreads USING (ex)),
    fails AS (SELECT ex, n, min(CASE WHEN rk > 1 AND u < {THRESHOLD} THEN rk END) AS failed FROM utility GROUP BY ex, n),
    adaptive AS (SELECT ex, coalesce(failed - 1, n)::INTEGER AS selected_k, CASE WHEN failed IS NOT NULL THEN 'utility_below_tau' WHEN n < 5 THEN 'candidate_list_exhausted' ELSE 'k_max_reached' END AS reason FROM fails)"""
_COMPLETE = """
    cand_meets AS (SELECT s.ex, s.rk, s.size, g.alt, g.gsize, count(x.unit) AS both_n FROM sizes s JOIN gold_size g USING (ex) LEFT JOIN (SELECT u.ex, u.rk, u.unit, g.alt FROM units u JOIN golds g ON g.ex = u.ex AND g.unit = u.unit) x ON x.ex = s.ex AND x.rk = s.rk AND x.alt = g.alt GROUP BY ALL)"""
_B, _T = _base(), _base("p_type")
_CELLS = "unnest(['exact', 'complete_nonminimal', 'incomplete', 'disjoint'])"
ORACLE_SQL = {
    "rank_candidates": f"WITH {_B} SELECT ex AS example, cand AS candidate, rk::INTEGER AS rank, size::INTEGER AS size FROM sizes",
    "candidate_identity": f"WITH {_B} SELECT s.cand AS candidate, sha256(coalesce((SELECT to_json(list(unit ORDER BY pos))::VARCHAR FROM units u WHERE u.cand = s.cand), '[]')) AS identity FROM sizes s",
    "candidate_cap": f"WITH {_T}, l AS (SELECT s.ex, s.cand, s.score, s.size, coalesce(list(u.unit ORDER BY u.pos) FILTER (u.unit IS NOT NULL), []) AS us FROM sizes s LEFT JOIN units u USING (cand) GROUP BY ALL) SELECT example, candidate, place FROM (SELECT ex AS example, cand AS candidate, (row_number() OVER (PARTITION BY ex ORDER BY score DESC, size, us, cand))::INTEGER AS place FROM l) WHERE place <= 8",
    "fixed_k_union": f"WITH {_B}, {_PREFIX} SELECT ex AS example, k, count(unit)::INTEGER AS size, coalesce(string_agg(unit, '|' ORDER BY rk, pos), '') AS units FROM prefix GROUP BY ex, k",
    "adaptive_prefix": f"WITH {_T}, {_STEPS}, {_ADAPTIVE} SELECT ex AS example, selected_k, reason, (SELECT count(*) FROM first_seen f WHERE f.ex = a.ex AND f.rk <= selected_k)::INTEGER AS size FROM adaptive a",
    "decision_features": f'''WITH {_T}, {_STEPS}, {_DECISIONS} SELECT ex AS example, "at"::INTEGER AS "at", round(cur, 6) AS cur, round(nxt, 6) AS nxt, round(rel_top, 6) AS rel_top, round(gap, 6) AS gap, round(novelty::DOUBLE, 6) AS novelty, round(overlap::DOUBLE, 6) AS overlap, cum_size::INTEGER AS cum_size, next_size::INTEGER AS next_size, new_units::INTEGER AS new_units FROM decisions''',
    "stepwise_selection": f'''WITH {_T}, {_STEPS}, {_DECISIONS}, go AS (SELECT ex, bool_or("at" = 1 AND round(novelty * rel_top, 9) >= 0.05) AS a, bool_or("at" = 2 AND round(novelty * rel_top, 9) >= 0.05) AS b, bool_or("at" = 3 AND round(novelty * rel_top, 9) >= 0.05) AS c FROM decisions WHERE "at" <= 3 GROUP BY ex) SELECT (CASE WHEN NOT a THEN 1 WHEN NOT b THEN 2 WHEN NOT c THEN 3 ELSE 5 END)::INTEGER AS selected_k, count(*) AS examples FROM go GROUP BY 1''',
    "best_alternative": f"WITH {_B}, {_PREFIX} SELECT ex AS example, k, round(precision::DOUBLE, 6) AS precision, round(recall::DOUBLE, 6) AS recall, round(f1::DOUBLE, 6) AS f1 FROM scored",
    "best_prefix": f"WITH {_B}, {_PREFIX} SELECT ex AS example, k, f1 FROM (SELECT ex, k, round(f1::DOUBLE, 6) AS f1, row_number() OVER (PARTITION BY ex ORDER BY round(f1::DOUBLE, 6) DESC, size, k) AS n FROM scored) WHERE n = 1",
    "pareto_front": f"WITH {_B}, {_PREFIX}, pt AS (SELECT ex, k, round(precision::DOUBLE, 6) AS p, round(recall::DOUBLE, 6) AS r, size FROM scored) SELECT k, count(*) AS undominated FROM pt a WHERE NOT EXISTS (SELECT 1 FROM pt b WHERE b.ex = a.ex AND b.p >= a.p AND b.r >= a.r AND b.size <= a.size AND (b.p > a.p OR b.r > a.r OR b.size < a.size)) GROUP BY k",
    "saturation": f"WITH {_B}, {_PREFIX}, d AS (SELECT ex, round((max(f1) - min(f1))::DOUBLE, 6) AS spread FROM scored WHERE k >= 2 GROUP BY ex) SELECT count(*) AS examples, count(*) FILTER (spread <= 0.01) AS saturated FROM d",
    "macro_pooled": f"WITH {_B}, {_PREFIX}, d AS (SELECT dataset, avg(precision) AS p, avg(recall) AS r, avg(f1) AS f, sum(precision) AS sp, sum(recall) AS sr, sum(f1) AS sf, count(*) AS n FROM scored JOIN grains USING (ex) WHERE k = 1 GROUP BY dataset) SELECT round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(f), 6) AS macro_f1, round(sum(sp) / sum(n), 6) AS pooled_precision, round(sum(sr) / sum(n), 6) AS pooled_recall, round(sum(sf) / sum(n), 6) AS pooled_f1 FROM d",
    "split_metrics": f"WITH {_B}, {_PREFIX} SELECT k, coalesce(dataset, 'all') AS dataset, coalesce(domain::VARCHAR, 'all') AS domain, count(*) AS n, round(avg(f1), 6) AS f1, round(avg(recall), 6) AS recall, sum(exact)::BIGINT AS exact FROM scored JOIN grains USING (ex) GROUP BY GROUPING SETS ((k), (k, dataset), (k, domain), (k, dataset, domain))",
    "hit_at_k": f"WITH {_B}, {_PREFIX}, {_COMPLETE}, c AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE both_n / size END AS p, both_n / gsize AS r FROM cand_meets), f AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f FROM c), best AS (SELECT ex, rk, max(CASE WHEN n = 1 AND both_n = size AND both_n = gsize THEN 1 ELSE 0 END) AS exact, max(CASE WHEN both_n = gsize THEN 1 ELSE 0 END) AS complete, max(f) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY ex, rk ORDER BY f DESC, alt) AS n FROM f) GROUP BY ex, rk), e AS (SELECT k, ex, max(exact) AS exact, max(complete) AS complete, max(f1) AS f1 FROM best JOIN (SELECT unnest([1, 3, 5])::INTEGER AS k) ON rk <= k GROUP BY k, ex) SELECT k, count(*) AS examples, round(avg(exact), 6) AS exact, round(avg(complete), 6) AS complete, round(avg(CASE WHEN f1 > 0 THEN 1 ELSE 0 END), 6) AS hit, round(avg(f1), 6) AS best_f1 FROM e GROUP BY k",
    "selected_k_distribution": f"WITH {_T}, {_STEPS}, {_ADAPTIVE}, d AS (SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS selected_k) SELECT d.selected_k, count(a.ex) AS n, round(100 * count(a.ex) / (SELECT count(*) FROM adaptive), 6) AS percent FROM d LEFT JOIN adaptive a USING (selected_k) GROUP BY d.selected_k",
    "size_score_pearson": f"WITH {_B}, m AS (SELECT ex, count(*) AS n, avg(size) AS mx, avg(score / 1000) AS my, avg(size * (score / 1000)) AS mxy, avg(size * size) AS mxx, avg((score / 1000) * (score / 1000)) AS myy FROM sizes GROUP BY ex) SELECT ex AS example, CASE WHEN n < 2 OR mxx - mx * mx <= 1e-9 OR myy - my * my <= 1e-9 THEN 0.0 ELSE round((mxy - mx * my) / sqrt((mxx - mx * mx) * (myy - my * my)), 4) END AS pearson FROM m",
    "score_scale": f"WITH {_B} SELECT ex AS example, round(greatest(stddev_pop(score), 1e-12), 4) AS scale FROM ranked WHERE rk <= 5 GROUP BY ex",
    "stagewise_outcome": f"WITH {_B}, {_PREFIX}, near AS (SELECT ex, gsize - both_n AS missing, size - both_n AS extra, gsize FROM (SELECT *, row_number() OVER (PARTITION BY ex ORDER BY gsize - both_n, size - both_n, gsize, alt) AS n FROM meets WHERE k = 3) WHERE n = 1) SELECT ex AS example, outcome, missing::INTEGER AS missing, extra::INTEGER AS extra, gsize::INTEGER AS reference_size FROM outcomes JOIN near USING (ex) WHERE k = 3",
    "stagewise_cells": f"WITH {_B}, {_PREFIX}, rows AS (SELECT outcome, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS correct, dataset, domain::VARCHAR AS domain FROM outcomes JOIN customer ON c_custkey = ex JOIN grains USING (ex) WHERE k = 3), each AS (SELECT 'overall' AS grain, 'all' AS value, outcome, correct FROM rows UNION ALL SELECT 'dataset', dataset, outcome, correct FROM rows UNION ALL SELECT 'domain', domain, outcome, correct FROM rows), frame AS (SELECT g.grain, g.value, o.outcome, c.correct FROM (SELECT DISTINCT grain, value FROM each) g CROSS JOIN (SELECT {_CELLS} AS outcome) o CROSS JOIN (SELECT unnest([0, 1]) AS correct) c) SELECT f.grain, f.value, f.outcome, f.correct::INTEGER AS correct, count(e.outcome) AS n FROM frame f LEFT JOIN each e ON e.grain = f.grain AND e.value = f.value AND e.outcome = f.outcome AND e.correct = f.correct GROUP BY ALL",
    "outcome_transitions": f"WITH {_B}, {_PREFIX} SELECT a.outcome AS was, b.outcome AS now, count(*) AS n FROM outcomes a JOIN outcomes b USING (ex) WHERE a.k = 1 AND b.k = 3 GROUP BY 1, 2",
    "threshold_sweep": f"WITH {_T}, {_STEPS}, {_DECISIONS}, c AS (SELECT floor(round(novelty * rel_top, 6) * 100)::INTEGER AS cell, new_units, next_size FROM decisions), s AS (SELECT h.hundredth, count(c.cell) AS taken, CASE WHEN coalesce(sum(next_size), 0) = 0 THEN 0.0 ELSE round(sum(new_units) / sum(next_size), 6) END AS novel_share FROM (SELECT unnest(range(101))::INTEGER AS hundredth) h LEFT JOIN c ON cell >= hundredth GROUP BY 1) SELECT *, (row_number() OVER (ORDER BY novel_share DESC, taken DESC, hundredth))::INTEGER AS place FROM s",
    "benchmark_eval": f"WITH {_B}, {_PREFIX}, e AS (SELECT g.ex, s.* EXCLUDE (ex) FROM (SELECT DISTINCT ex FROM golds) g LEFT JOIN (SELECT * FROM scored WHERE k = 1) s USING (ex)) SELECT count(*) AS gold_rows, count(*) FILTER (f1 IS NULL) AS missing, round(sum(coalesce(precision, 0)) / count(*), 6) AS precision, round(sum(coalesce(recall, 0)) / count(*), 6) AS recall, round(sum(coalesce(f1, 0)) / count(*), 6) AS f1, round(sum(coalesce(exact, 0)) / count(*), 6) AS exact FROM e",
}
