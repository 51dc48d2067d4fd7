"""Operators on small fixtures with known results."""

import pytest
from pyspark.sql import functions as F

from lodestrand.functions import sets as S
from lodestrand.functions import text as X
from lodestrand.operators import contracts as C
from lodestrand.operators import graph as G
from lodestrand.operators import metrics as M
from lodestrand.operators import ranking as R

CANDIDATES = "example int, candidate int, score double, units array<string>"


def ranked(spark, *candidates):
    return spark.createDataFrame([(1, k, float(s), list(u)) for k, (s, u) in enumerate(candidates)], CANDIDATES)


@pytest.mark.parametrize(
    ("candidates", "threshold", "selected", "reason"),
    [
        ([(1.0, ["a", "b"]), (0.9, ["b", "a"])], 0.01, 1, "utility_below_tau"),
        ([(1.0, ["a"]), (0.9, ["b", "c"])], 0.0, 2, "candidate_list_exhausted"),
        ([(5, "1"), (4, "2"), (3, "3"), (2, "4"), (1, "5"), (0, "6")], 0.0, 5, "k_max_reached"),
        ([(1.0, ["a"]), (0.9, ["a"]), (0.8, ["new"])], 0.01, 1, "utility_below_tau"),
        ([(1.0, ["a"]), (1.0, ["b"])], 1.0, 2, "candidate_list_exhausted"),
    ],
)
def test_adaptive(spark, candidates, threshold, selected, reason):
    row = R.adaptive(ranked(spark, *candidates), threshold).first()
    assert (row["selected_k"], row["reason"]) == (selected, reason)


def test_fixed_prefix_keeps_first_order(spark):
    row = R.fixed_prefixes(ranked(spark, (2, ["a", "a", "b"]), (1, ["b", "c"])), (2,)).first()
    assert row["units"] == ["a", "b", "c"]


def test_stepwise_skips_four(spark):
    d = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.9), (1, 3, 0.9), (1, 4, 0.0), (2, 1, 0.9), (3, 1, 0.1)], "example int, at int, p double")
    assert {r["example"]: r["selected_k"] for r in R.stepwise_k(d, F.col("p"), 0.5).collect()} == {1: 5, 2: 2, 3: 1}


@pytest.mark.parametrize(
    ("found", "golds", "outcome", "reference"),
    [
        ("ab", ["ab"], "exact", (0, 0, 2)), ("abc", ["ab"], "complete_nonminimal", (0, 1, 2)), ("a", ["ab"], "incomplete", (1, 0, 2)), ("z", ["ab"], "disjoint", (2, 1, 2)),
        ("x", ["ab", "x"], "exact", (0, 0, 1)), ("xz", ["ab", "x"], "complete_nonminimal", (0, 1, 1)), ("ax", ["abc", "xy"], "incomplete", (1, 1, 2)), ("a", [], None, None),
    ],
)
def test_outcome(spark, found, golds, outcome, reference):
    df = spark.createDataFrame([(list(found), [list(g) for g in golds])], "u array<string>, g array<array<string>>")
    row = df.select(S.outcome(F.col("u"), F.col("g")).alias("o"), S.reference(F.col("u"), F.col("g")).alias("r")).first()
    assert row["o"] == outcome
    if reference:
        assert (row["r"]["missing"], row["r"]["extra"], row["r"]["size"]) == reference


def test_set_scores_of_empty_sets(spark):
    df = spark.createDataFrame([([], ["a"]), (["a"], []), ([], [])], "u array<string>, g array<string>")
    assert [r["s"]["f1"] for r in df.select(S.scores(F.col("u"), F.col("g")).alias("s")).collect()] == [0.0, 0.0, 0.0]


def test_unit_round_trip(spark):
    df = spark.createDataFrame([("T", 3, "a::b"), ("U", 0, "")], "t string, i int, s string")
    rows = df.select(X.parse_unit(X.sentence_unit(F.col("t"), F.col("i"), F.col("s"))).alias("u")).collect()
    assert [tuple(r["u"]) for r in rows] == [("SENT", "T", 3, "a::b"), ("SENT", "U", 0, "")]
    odd = spark.createDataFrame([("SENT::T::x::s",)], "u string").select(X.parse_unit(F.col("u")).alias("u")).first()["u"]
    assert odd["sent_idx"] is None


def test_token_scores_guard(spark):
    df = spark.createDataFrame([("Yes", "true"), ("yes", "maybe yes"), ("The cat!", "a cat"), ("a b b", "b b b c")], "p string, g string")
    rows = [r["s"] for r in df.select(M.token_scores(F.col("p"), F.col("g")).alias("s")).collect()]
    assert [r["em"] for r in rows] == [1, 0, 1, 0]
    assert [round(r["f1"], 3) for r in rows] == [1.0, 0.0, 1.0, 0.667]


def test_closures_around_one_anchor(spark):
    """A star of 5 with a ray that goes on: 5-1, 5-2, 5-3, 3-4; the anchor is 3."""
    edges = spark.createDataFrame([(7, 1, 5), (7, 2, 5), (7, 3, 5), (7, 3, 4)], "example int, src int, dst int")
    nodes = spark.createDataFrame([(7, k, k == 3) for k in range(1, 6)], "example int, node int, is_anchor boolean")
    assert {(r["a"], r["b"]) for r in G.closure_pairs(nodes, edges).collect()} == {(3, 5), (3, 4)}
    assert {(r["a"], r["b"], r["c"]) for r in G.closure_triples(nodes, edges).collect()} == {(3, 4, 5), (1, 3, 5), (2, 3, 5)}


def test_group_caps_come_before_the_join(spark):
    terms = spark.createDataFrame([(0, k, "many") for k in range(20)] + [(0, 1, "few"), (0, 2, "few"), (0, 3, "one")], "example int, node int, term string")
    assert [(r["src"], r["dst"]) for r in G.shared_term_edges(terms, 2, 12).collect()] == [(1, 2)]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(100, 101)], "src long, dst long")
    found = {r["node"]: r["component"] for r in G.components(edges).collect()}
    assert set(found.values()) == {0, 100} and len(found) == 33


def test_closure_with_a_cycle(spark):
    found = G.closure(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string"))
    assert {(r["src"], r["dst"]) for r in found.collect()} == {(x, y) for x in "abc" for y in "abcd"} | {("d", "d")}


def test_gold_columns_are_refused(spark):
    df = spark.createDataFrame([(1, 2, 3)], "id int, label int, question int")
    with pytest.raises(ValueError, match="label"):
        C.assert_gold_free(df)
    C.assert_gold_free(C.gold_free(df, ("id", "question", "label")))


def test_digest_ignores_order_and_sees_changes(spark):
    df = spark.createDataFrame([(k, str(k)) for k in range(50)], "a int, b string")
    assert C.digest(df).first() == C.digest(df.orderBy(F.desc("a")).repartition(3)).first()
    assert C.digest(df).first() != C.digest(df.withColumn("b", F.when(F.col("a") == 7, "x").otherwise(F.col("b")))).first()
    assert C.same_rows(df, df.repartition(2)).count() == 0


def test_auc(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "y int, s double")
    assert M.roc_auc(df, "y", "s").first()["auc"] == 0.875


@pytest.mark.parametrize("leak", ["ranking", "generation"])
def test_gold_mutation_finds_a_leak(spark, sf_dir, leak):
    from lodestrand.jobs.graphs import gold_mutation_invariance
    from lodestrand.sources.tables import candidates, gold, mutated_gold, table

    lines = table(spark, sf_dir, "lineitem")
    assert C.same_rows(gold(spark, sf_dir), gold(spark, sf_dir, mutated_gold(lines))).count() > 0
    asks_gold = lambda pool: R.rank(pool.withColumn("score", F.col("score") + 1e6 * F.coalesce(F.size(F.array_intersect("units", F.col("golds")[0])), F.lit(0))))
    returned = lambda spark, sf_dir, lineitem: candidates(spark, sf_dir, lineitem=lineitem.where("l_returnflag <> 'N'"))
    found = gold_mutation_invariance(spark, sf_dir, **({"ranking": asks_gold} if leak == "ranking" else {"generate": returned})).first()
    assert found["differences"] > 0
