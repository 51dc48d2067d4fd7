"""Composed and enumerated supports, paths, coefficients, runs, pairs and rescued outcomes against plain versions."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from lodestrand.functions import axioms as A
from lodestrand.jobs import search
from lodestrand.operators import candidates as K
from lodestrand.operators import compose as P
from lodestrand.operators import contracts as C
from lodestrand.operators import graph as G
from lodestrand.operators import metrics as M
from lodestrand.operators import tuning as T


def context(seed, n):
    r = random.Random(seed)
    e, p = (lambda: r.choice(["a", "b", "c", "d"])), (lambda: r.choice(["p", "q", "s"]))
    units = [r.choice([f"{e()}{k} {p()} {e()}", f"{e()} {p()} {e()}{k}", f"SubObjectPropertyOf({p()},{p()}{k})", f"SymmetricObjectProperty({p()})", f"odd words number {k}"]) for k in range(n)]
    return [(k, u, r.randrange(9) / 10) for k, u in enumerate(dict.fromkeys(units))]


def parts(unit):
    if "(" in unit:
        names = unit.partition("(")[2].rstrip(")").split(",")
        return "rule", set(), set(names)
    a = unit.split()
    return ("fact", {a[0], a[2]}, {a[1]}) if len(a) == 3 else ("unknown", set(), set())


def links_of(units):
    p = [parts(u) for _, u, _ in units]
    near = [set() for _ in units]
    for i, j in itertools.combinations(range(len(units)), 2):
        both = p[i][1] & p[j][1] if p[i][0] == p[j][0] == "fact" else p[i][2] & p[j][2]
        if both:
            near[i].add(j)
            near[j].add(i)
    return p, near


def whole(m, near):
    seen, new = set(), {m[0]}
    while new:
        seen |= new
        new = {y for x in new for y in near[x] if y in m} - seen
    return len(seen) == len(m)


def plain_score(m, units, p, near, qe, qp):
    hits = sum(bool(p[i][1] & qe) + bool(p[i][2] & qp) for i in m)
    bag = [x for i in m for x in p[i][2]]
    touch = {p[i][0] for i in m if p[i][1] & qe or p[i][2] & qp}
    bridge = (len(set().union(*(p[i][1] for i in m)) & qe) / len(qe) if qe else 0) + (len(set(bag) & qp) / len(qp) if qp else 0) + (0.5 if {"fact", "rule"} <= touch else 0)
    kinds = {p[i][0] for i in m}
    again = 1 - len(set(bag)) / len(bag) if bag else 0
    return round(sum(units[i][2] for i in m) + 0.3 * whole(m, near) + 0.2 * ({"fact", "rule"} <= kinds) + 0.18 * hits / len(m) + 0.22 * bridge / 2.5 - 0.05 * again, 6)


def plain_beam(n, near, score, width, first, most):
    level = [(i,) for i in first]
    out = list(level)
    for _ in range(1, most):
        grown = {tuple(sorted((*m, x))) for m in level for i in m for x in near[i] if x not in m}
        level = sorted(grown, key=lambda m: (-score(m), m))[:width]
        out += level
    return out


CONTEXTS = {0: context(1, 8), 1: context(2, 12), 2: context(3, 30), 3: context(4, 1)}
ASKED = {0: ({"a", "b"}, {"p"}), 1: ({"c"}, {"q", "s"}), 2: (set(), {"p"}), 3: ({"a"}, set())}


def infos(spark):
    units = spark.createDataFrame([(e, *u) for e, us in CONTEXTS.items() for u in us], "example int, place int, unit string, score double")
    asked = spark.createDataFrame([(e, sorted(a), sorted(b)) for e, (a, b) in ASKED.items()], "example int, entities array<string>, properties array<string>")
    return G.stored(P.contexts(units).join(asked, "example"))


def test_contexts_link_units(spark):
    for r in infos(spark).collect():
        p, near = links_of(CONTEXTS[r["example"]])
        assert [set(n["near"]) for n in r["nodes"]] == near and [n["kind"] for n in r["nodes"]] == [k for k, _, _ in p]


@pytest.mark.parametrize("limit", [5000, 200])
def test_composed_supports(spark, limit):
    w = P.Weights(beam=12, most_subsets=limit)
    got = {r["example"]: r for r in P.compose(infos(spark), 4, w).collect()}
    for e, units in CONTEXTS.items():
        p, near = links_of(units)
        score = lambda m: plain_score(m, units, p, near, *ASKED[e])  # noqa: B023, E731
        n = len(units)
        every = sum(math.comb(n, k) for k in range(1, 5)) <= limit
        sets = [m for k in range(1, 5) for m in itertools.combinations(range(n), k)] if every else plain_beam(n, near, score, 12, sorted(range(n), key=lambda i: (-units[i][2], i))[:12], 4)
        best = min(sets, key=lambda m: (-score(m), len(m), m))
        assert (tuple(got[e]["members"]), got[e]["score"], got[e]["exhaustive"]) == (best, score(best), every)


def test_axiom_beam(spark):
    got = {}
    for r in P.axiom_beam(infos(spark), 2, 4, 10, 25).orderBy("example", "place").collect():
        got.setdefault(r["example"], []).append(tuple(r["members"]))
    for e, units in CONTEXTS.items():
        p, near = links_of(units)

        def score(m):
            kinds = {p[i][0] for i in m}  # noqa: B023
            return round(sum(units[i][2] for i in m) / len(m) + 0.05 * sum(j in near[i] for i, j in itertools.combinations(m, 2)) + 0.2 * ({"fact", "rule"} <= kinds) - 0.015 * max(0, len(m) - 3), 9)  # noqa: B023

        n = len(units)
        found = [m for m in plain_beam(n, near, score, 10, sorted(range(n), key=lambda i: (-units[i][2], units[i][1]))[:25], 4) if len(m) >= 2]
        assert got.get(e, []) == sorted(found, key=lambda m: (-score(m), m))[:25]


def test_unranking_lists_all_subsets_in_order(spark):
    for n, k in ((1, 1), (5, 2), (7, 7), (9, 4), (60, 2)):
        every = list(itertools.combinations(range(n), k))
        got = spark.range(len(every)).select("id", P.unrank(F.col("id"), F.lit(n), F.lit(k)).alias("m")).collect()
        assert [tuple(r["m"]) for r in sorted(got)] == every


def test_a_keyed_permutation_is_one(spark):
    for n in (1, 2, 3, 10, 257, 5000):
        got = [spark.range(n).select(P.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(key)).alias("x")).orderBy("id").collect() for key in (1, 2)]
        rows = [[r["x"] for r in g] for g in got]
        assert all(sorted(r) == list(range(n)) for r in rows)
        assert n < 10 or rows[0] != rows[1] != list(range(n))


def test_enumerated_supports(spark):
    pools = {0: list("abc"), 1: [f"u{k:02}" for k in range(12)], 2: [f"u{k:02}" for k in range(60)], 3: []}
    df = spark.createDataFrame(list(pools.items()), "example int, units array<string>")
    rows = P.enumerated(df, 3, 50, 7).collect()
    got = {e: [tuple(r["units"]) for r in sorted(rows, key=lambda r: r["place"]) if r["example"] == e] for e in pools}
    assert got[0] == [m for k in (1, 2, 3) for m in itertools.combinations("abc", k)] and got[3] == []
    every = [m for k in (1, 2, 3) for m in itertools.combinations(pools[1], k)]
    assert got[1][:50] == every[:12] + [m for m in every if len(m) == 2][:38]
    assert len(got[2]) == 50 and got[2] == [(u,) for u in pools[2]][:50]
    many = P.enumerated(df, 3, 100, 7).where("example = 2").orderBy("place").collect()
    pairs = [tuple(r["units"]) for r in many][60:]
    assert len(many) == len({tuple(r["units"]) for r in many}) == 100 and all(len(p) == 2 and p[0] < p[1] for p in pairs) and pairs != list(itertools.combinations(pools[2], 2))[:40]
    assert [tuple(r["units"]) for r in P.enumerated(df, 3, 100, 7).where("example = 2").orderBy("place").collect()][60:] == pairs


def test_all_shortest_paths(spark):
    r = random.Random(3)
    links = [(f"n{r.randrange(14)}", r.choice("xyz"), f"n{r.randrange(14)}") for _ in range(34)] + [("a", "x", "b")]
    near = {}
    for s, rel, o in links:
        if s != o:
            for u, v in ((s, o), (o, s)):
                near.setdefault(u, {})[v] = max(rel, near.get(u, {}).get(v, ""))
    goals = [(s, o) for s in ("n0", "n1", "a") for o in ("n2", "n3", "n5", "n0", "b")]

    def paths(s, o):
        level = [(s,)]
        while level:
            if done := [p for p in level if p[-1] == o]:
                return done
            seen = {x for p in level for x in p}
            level = [(*p, x) for p in level for x in near.get(p[-1], {}) if x not in p]
            if len(level) > 100_000 or not seen:
                break
        return []

    want = sorted((s, o, " -> ".join([p[0]] + [x for a, b in itertools.pairwise(p) for x in (near[a][b], b)]) if len(p) > 1 else "") for s, o in goals for p in paths(s, o))
    df = spark.createDataFrame(links, "src string, rel string, dst string")
    found = G.all_shortest_paths(spark.createDataFrame(goals, "root string, goal string"), df)
    assert sorted(tuple(x) for x in found.select("root", "goal", G.path_string(F.col("nodes"), F.col("relations"))).collect()) == want
    with pytest.raises(ValueError, match="paths"):
        G.all_shortest_paths(spark.createDataFrame(goals, "root string, goal string"), df, most_paths=2)


def test_coordinate_search_equals_a_plain_one(spark):
    r = random.Random(8)
    rows = [(f"d{e % 3}", e, f"i{k}", r.randrange(20) / 20, r.randrange(5) / 4, float(r.randrange(3)), -float(r.randrange(3))) for e in range(40) for k in range(6)]
    grids, originals = {"x": [0.0, 0.1, 0.2, 0.4], "y": [0.0, 0.05, 0.3]}, {"x": 0.1, "y": 0.05}

    def measure(values):
        by = {}
        for e in range(40):
            own = [row for row in rows if row[1] == e]
            best = min(own, key=lambda row: (-(row[3] + values["x"] * row[5] + values["y"] * row[6]), row[2]))
            by.setdefault(own[0][0], []).append(best[4])
        return {d: round(sum(v) / len(v), 12) for d, v in by.items()}

    base = measure(originals)

    def key(values):
        by = measure(values)
        gains = [by[d] - base[d] for d in sorted(base)]
        return -sum(by.values()) / 3, sum(g < -1e-12 for g in gains), -min(gains), sum(abs(values[n] - o) / o for n, o in originals.items()), tuple(values.values())

    ends = []
    for start in (originals, {"x": 0.0, "y": 0.0}, {"x": 0.2, "y": 0.05}):
        values = dict(start)
        for _ in range(10):
            before = dict(values)
            for n in grids:
                values = min(({**values, n: v} for v in grids[n]), key=key)
            if values == before:
                break
        ends.append(values)
    best = min(ends, key=key)
    df = spark.createDataFrame(rows, "dataset string, example int, identity string, base double, f1 double, x double, y double")
    found = T.coordinate_search(df, grids, originals)
    assert found.improved == (-key(best)[0] > -key(originals)[0] + 1e-12)
    assert found.values == (best if found.improved else originals) and found.by_dataset == measure(found.values)
    with pytest.raises(ValueError, match="no row"):
        T.coordinate_search(df.limit(0), grids, originals)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_runs_cross_the_ends_of_parts(spark, parts):
    r = random.Random(1)
    keys = [k for _ in range(12) for k in [r.choice(["a", "b", None])] * r.choice([1, 2, 9, 30])]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = C.in_order(spark.createDataFrame(list(enumerate(keys)), "at int, key string"), "at")
        got = sorted((x["first"], x["key"], x["rows"]) for x in C.runs(rows, "key", "at").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    at, want = 0, []
    for k, own in itertools.groupby(keys):
        n = len(list(own))
        want.append((at, k, n))
        at += n
    assert got == want


def test_groups_that_come_again_raise(spark):
    rows = lambda keys: C.in_order(spark.createDataFrame(list(enumerate(keys)), "at int, key string"), "at")
    assert sorted(tuple(x) for x in C.contiguous(rows("aabccc"), "key", "at").collect()) == [("a", 0, 2), ("b", 2, 1), ("c", 3, 3)]
    for keys in ("aabca", ["a", None]):
        with pytest.raises(Exception, match="isn't one run"):
            C.contiguous(rows(keys), "key", "at").collect()


def test_contaminated_backends_raise(spark):
    df = spark.createDataFrame([("fresh",), (None,)], "b string")
    assert [x[0] for x in C.refuse_backends(df, "b").collect()] == ["fresh", None]
    with pytest.raises(Exception, match="contaminated"):
        C.refuse_backends(df.union(spark.createDataFrame([("LLM_with_Provided",)], "b string")), "b").collect()


def plain_pairs(rows, most):
    by = {}
    for c, t, o, i in sorted(rows, key=lambda x: (x[2], x[0])):
        by.setdefault(t, []).append((c, i))
    levels = [by[t] for t in sorted(by, reverse=True)]
    ends = sorted(itertools.combinations(range(len(levels)), 2), key=lambda p: (0, p) if p[1] == p[0] + 1 else (1, p) if p == (0, len(levels) - 1) else (2, p))
    out, seen = [], set()
    for turn in range(4 * most):
        n = len(out)
        for a, b in ends:
            if len(out) == most:
                return out
            x, y = levels[a][turn % len(levels[a])], levels[b][(3 * turn + len(out)) % len(levels[b])]
            if (x[1], y[1]) not in seen:
                seen.add((x[1], y[1]))
                out.append((x[0], y[0]))
        if len(out) == n and turn >= max(map(len, levels)):
            break
    return out


def test_training_pairs_equal_plain_ones(spark):
    r = random.Random(6)
    rows = {e: [(k, r.choice([1.0, 0.9, 0.3, 0.2, 0.0][: 1 + e % 5]), f"{r.randrange(99):02}", f"i{r.randrange(12)}") for k in range(r.choice([1, 3, 20]))] for e in range(25)}
    df = spark.createDataFrame([(e, *x) for e, own in rows.items() for x in own], "example int, candidate int, target double, order string, identity string")
    got = {}
    for x in K.training_pairs(df, 8).orderBy("example", "step").collect():
        got.setdefault(x["example"], []).append((x["better"], x["worse"]))
    for e, own in rows.items():
        assert got.get(e, []) == plain_pairs(own, 8), e


def test_a_subsample_keeps_the_reserved_pair(spark):
    targets = [(1, k, 100.0 - k, t) for k, t in enumerate([1.0] * 5 + [0.2] * 6 + [0.0] * 4)]
    df = spark.createDataFrame(targets, "example int, candidate int, score double, target double")
    kept = lambda better, worse: {(r["candidate"], r["stratum"]) for r in search._subsample(df, spark.createDataFrame([(1, better, worse, "partial")], "example int, better int, worse int, stratum string"), {"positive": 3, "hard_negative": 2, "easy_negative": 2}).collect()}
    easy = {c for c, s in kept(0, 5) if s == "easy_negative"}
    assert kept(0, 5) == {(0, "positive"), (1, "positive"), (2, "positive"), (5, "hard_negative"), (6, "hard_negative")} | {(c, "easy_negative") for c in easy} and len(easy) == 2
    assert {c for c, s in kept(4, 9) if s != "easy_negative"} == {0, 1, 4, 5, 9}


def test_average_precision(spark):
    r = random.Random(2)
    rows = [(r.choice([0, 1, 1, None]), r.choice([None, *[float(x) for x in range(30)]])) for _ in range(500)]
    own = sorted(((s, y) for y, s in rows if s is not None and y is not None), reverse=True)
    want, hits, seen = 0.0, 0, 0
    for _, group in itertools.groupby(own, key=lambda x: x[0]):
        ys = [y for _, y in group]
        hits, seen = hits + sum(ys), seen + len(ys)
        want += sum(ys) * hits / seen
    df = spark.createDataFrame(rows, "y int, s double")
    for bins in (2, 64):
        assert abs(M.average_precision(df, "y", "s", bins).first()[0] - want / hits) < 1e-12
    assert M.average_precision(df.where("y = 0"), "y", "s").first()[0] is None and M.average_precision(df.limit(0), "y", "s").first()[0] is None


def test_rescued_outcomes(spark):
    ask = "ASK WHERE { <a> <b> <c> }"
    rows = [
        (["f"], [["g"]], ["f"], ask, "TRUE", ("exact", 1, 0, 0, True)), (["f", "n"], [["g"]], ["f"], ask, " yes", ("complete_nonminimal", 1, 0, 1, True)),
        (["f"], [["g"]], ["f"], ask, "FALSE", ("disjoint", 1, 1, 1, False)), (["f"], [["g"]], ["f"], "SELECT ?x", "TRUE", ("disjoint", 1, 1, 1, False)),
        (["f", "g"], [["g"]], ["f"], ask, "TRUE", ("complete_nonminimal", 1, 0, 1, False)), (["f", "g"], [["g", "h"]], None, ask, "TRUE", ("incomplete", 2, 1, 1, False)),
    ]
    df = spark.createDataFrame([x[:5] for x in rows], "found array<string>, golds array<array<string>>, proof array<string>, query string, answer string")
    got = df.select(M.rescued_outcome(*(F.col(c) for c in ("found", "golds", "proof", "query", "answer"))).alias("o")).collect()
    assert [tuple(x["o"]) for x in got] == [x[5] for x in rows]


def test_notations(spark):
    units = {
        "p owl:inverseOf q": "InverseObjectProperties(p,q)", "q owl:inverseOf p": "InverseObjectProperties(p,q)", "a rdfs:subPropertyOf b": "SubObjectPropertyOf(a,b)", "PropertyChain(a ∘ b) ⊑ c": "ObjectPropertyChain(a,b->c)",
        "PropertyChain(a âˆ˜ b) âŠ‘ c": "ObjectPropertyChain(a,b->c)", "Symmetric:  knows": "SymmetricObjectProperty(knows)", "Transitive: x y": "TransitiveObjectProperty(x y)", "Functional:f": "FunctionalObjectProperty(f)",
        "domain(p) = C": "p domain C", "range( p )=C D": "p range C D", "a SubPropertyOf b": "SubObjectPropertyOf(a,b)", "a Domain B": "a domain B", "a Range B": "a range B", "TAG: z": "", "  ": "", "a  type\tB": "a type B",
        "SubObjectPropertyOf(ObjectPropertyChain(<x#a> <x/b> d) <x#c>)": "ObjectPropertyChain(a,b,d->c)", "cafÃ© â€“ x": "café – x", "â alone": "â alone", "InverseObjectProperties(q,p)": "InverseObjectProperties(q,p)", None: "",
    }
    got = spark.createDataFrame([(u,) for u in units], "u string").select("u", A.canonical(F.col("u")).alias("c")).collect()
    assert {r["u"]: r["c"] for r in got} == units
