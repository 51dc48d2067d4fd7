"""Candidate generation, context selection, training pairs and paths against plain versions; contracts on fixtures."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lodestrand.operators import candidates as K
from lodestrand.operators import contracts as C
from lodestrand.operators import graph as G


def random_graph(seed, n):
    rng = random.Random(seed)
    score = {k: round(rng.random(), 3) for k in range(n)}
    edges = [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.25]
    anchors = {k for k in range(n) if rng.random() < 0.5}
    near = {k: {b for a, b in edges if a == k} | {a for a, b in edges if b == k} for k in range(n)}
    return score, edges, anchors, near


def plain_components(anchors, near):
    out = {}
    for a in sorted(anchors):
        if a not in out:
            todo = [a]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = a
                    todo += near[x] & anchors
    return out


def plain_closure(score, near, anchors, capacity):
    def value(members, seed):
        inner = sum(b in near[a] for a, b in itertools.combinations(members, 2))
        around = len(set().union(*(near[a] for a in members)) - set(members))
        return round(sum(score[m] for m in members) / len(members) + 0.025 * inner + 0.002 * min(around, 10) + 0.0001 * score[seed], 9)

    parts = plain_components(anchors, near)
    turn = {a: sorted(x for x in parts if parts[x] == parts[a]).index(a) for a in parts}
    order = sorted(parts, key=lambda a: (turn[a], parts[a]))
    lanes = {}
    for a in order:
        states = [{(a,)}, {tuple(sorted((a, n))) for n in near[a]}, {tuple(sorted((a, n, x))) for n in near[a] for x in near[a] | near[n] if x not in (a, n)}]
        for size, own in enumerate(states, 1):
            lanes[a, size] = sorted(own, key=lambda m: (-value(m, a), m))
    given, more = [], True
    while more and len(given) < capacity:
        more = False
        for a in order:
            for size in (1, 2, 3):
                fresh = [m for m in lanes[a, size] if m not in given]
                if fresh and len(given) < capacity:
                    given.append(fresh[0])
                    more = True
    return given


@pytest.mark.parametrize("capacity", [7, 40, 512])
def test_capped_closure(spark, capacity):
    graphs = {e: random_graph(e, 9) for e in range(3)}
    nodes = spark.createDataFrame([(e, k, float(s), k in anchors) for e, (score, _, anchors, _) in graphs.items() for k, s in score.items()], "example int, node int, score double, is_anchor boolean")
    edges = spark.createDataFrame([(e, a, b) for e, (_, es, _, _) in graphs.items() for a, b in es], "example int, src int, dst int")
    parts = K.anchor_components(nodes, edges)
    found = {}
    for r in K.local_closure(nodes, edges, parts, capacity).collect():
        found.setdefault(r["example"], []).append((r["place"], tuple(r["members"])))
    labels = {(r["example"], r["node"]): r["component"] for r in parts.collect()}
    for e, (score, _, anchors, near) in graphs.items():
        assert {n: c for (x, n), c in labels.items() if x == e} == plain_components(anchors, near)
        assert [m for _, m in sorted(found[e])] == plain_closure(score, near, anchors, capacity)


def test_context_selection(spark):
    rng = random.Random(3)
    units = [(0, f"u{k:02}", [f"e{rng.randrange(8)}", f"e{rng.randrange(8)}"], [f"p{rng.randrange(5)}"]) for k in range(25)]
    units = [(x, u, sorted(set(es)), ps) for x, u, es, ps in units]
    asked = ({"e1"}, {"p2"})
    terms = {u: set(es) | set(ps) for _, u, es, ps in units}
    hit = {u: 2 * len(set(es) & asked[0]) + len(set(ps) & asked[1]) for _, u, es, ps in units}
    taken = sorted((u for u in hit if hit[u]), key=lambda u: (-hit[u], u))[:12]
    frontier = list(taken)
    while frontier and len(taken) < 12:
        n = {}
        for f in frontier:
            for t in terms[f]:
                for u in terms:
                    if t in terms[u] and u not in taken:
                        n[u] = n.get(u, 0) + 1
        frontier = sorted(n, key=lambda u: (-n[u], -len(terms[u] & (asked[0] | asked[1])), u))[: 12 - len(taken)]
        taken += frontier
    found = G.select_context(spark.createDataFrame(units, "example int, unit string, entities array<string>, properties array<string>"), spark.createDataFrame([(0, ["e1"], ["p2"])], "example int, query_entities array<string>, query_properties array<string>"), 12)
    assert [r["unit"] for r in found.orderBy("place").collect()] == taken


def test_training_pairs_take_neighbouring_targets_first(spark):
    rows = [(0, k, t, f"{k}", f"i{k}") for k, t in enumerate([1.0, 0.3, 0.3, 0.0])] + [(1, 9, 0.2, "9", "i9")]
    found = K.training_pairs(spark.createDataFrame(rows, "example int, candidate int, target double, order string, identity string"), 4)
    assert [(r["better"], r["worse"]) for r in found.orderBy("step").collect()] == [(0, 1), (1, 3), (0, 3), (2, 3)]


def test_shortest_paths_on_a_square_with_a_tail(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("c", "e"), ("e", "a")], "src string, dst string")
    found = {r["node"]: (r["depth"], r["paths"]) for r in G.shortest_paths(spark.createDataFrame([("a",)], "root string"), links).collect()}
    assert found == {"a": (0, 1), "b": (1, 1), "d": (1, 1), "e": (1, 1), "c": (2, 3)}


def test_a_frozen_selection_refuses_another(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "example int, units string")
    frozen = C.Frozen.of(df)
    assert frozen.open(df.orderBy(F.desc("example"))).count() == 2
    with pytest.raises(ValueError, match="frozen"):
        frozen.open(df.where("example = 1"))


def test_splits_and_manifests(spark):
    rows = spark.createDataFrame([("train", 1), ("dev", 1), ("test", 2), ("train", 2), ("train", 3)], "split string, id int")
    assert {(r["a"], r["b"], r["shared"]) for r in C.split_overlaps(rows, "split", "id").collect()} == {("dev", "train", 1), ("test", "train", 1)}
    with pytest.raises(ValueError, match="empty"):
        C.split_overlaps(rows.union(spark.createDataFrame([("dev", None)], "split string, id int")), "split", "id")
    a, b = (spark.createDataFrame(x, "name string, size long, sha256 string") for x in ([("x", 1, "h"), ("y", 2, "g")], [("x", 1, "h"), ("y", 2, "k"), ("z", 1, "h")]))
    assert {r["name"] for r in C.manifest_differences(a, b).collect()} == {"y", "z"}


def test_margin_pairs_of_four_strata(spark, sf_dir):
    from lodestrand.jobs import search

    t = {r["candidate"]: r["target"] for r in search.rank_target(spark, sf_dir).collect()}
    level = lambda c: 3 if t[c] >= 0.999 else 2 if t[c] >= 0.899 else 1 if t[c] > 0 else 0
    weights = {(3, 2): 2.0, (3, 1): 3.0, (2, 1): 3.0, (3, 0): 2.0, (2, 0): 2.0, (1, 0): 0.5}
    rows = search.margin_pairs(spark, sf_dir).collect()
    assert len(rows) > 1000 and all(weights[level(r["better"]), level(r["worse"])] == r["weight"] for r in rows)
