"""Proofs from parsed units against plain Python, and outcomes with proof rescue."""

import itertools
import random

from pyspark.sql import functions as F

from lodestrand.functions import entail as T

Q = "ASK WHERE { <http://e.org/a#%s> <%s> <http://e.org/a#%s> . }"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def plain_entails(st, s, p, o):
    """Everything that follows, by adding until nothing is new."""
    pairs = lambda kind: {(a, b) for k, a, _, b in st if k == kind}

    def up(names, links):
        names = set(names)
        while more := {b for a, b in links if a in names} - names:
            names |= more
        return names

    sub, inv = pairs("subproperty"), pairs("inverse") | {(b, a) for a, b in pairs("inverse")}
    symmetric = {a for k, a, _, _ in st if k == "symmetric"}
    facts, types = set(), pairs("type")
    for k, a, rel, b in st:
        if k != "triple":
            continue
        raised = up({rel}, sub)
        turned = up({y for x, y in inv if x in raised}, sub)
        facts |= {(a, x, b) for x in raised} | {(b, x, a) for x in raised & symmetric} | {(b, x, a) for x in turned}
        types |= {(a, c) for x, c in pairs("domain") if x in raised} | {(b, c) for x, c in pairs("range") if x in raised}
        types |= {(b, c) for x, c in pairs("domain") if x in turned} | {(a, c) for x, c in pairs("range") if x in turned}
    if p == "type":
        return o in up({c for e, c in types if e == s}, pairs("subclass"))
    return (s, p, o) in facts


def says(unit):
    """The statement of the few notations that the made units use."""
    name, _, rest = unit.partition("(")
    if rest:
        a, *b = rest.rstrip(")").split(",")
        kind = {"InverseObjectProperties": "inverse", "SubObjectPropertyOf": "subproperty", "SymmetricObjectProperty": "symmetric"}[name]
        return kind, a, None, b[0] if b else ""
    a, rel, b = unit.split()
    return {"rdf:type": "type", "SubClassOf": "subclass", "domain": "domain", "range": "range"}.get(rel, "triple"), a, rel, b


def made(seed):
    r = random.Random(seed)
    p, c, e = (lambda k=k: r.choice([f"{k}{i}" for i in range(2)]) for k in "pce")
    shapes = [
        lambda: f"{e()} {p()} {e()}", lambda: f"{e()} {p()} {e()}", lambda: f"{e()} rdf:type {c()}", lambda: f"{c()} SubClassOf {c()}", lambda: f"{p()} domain {c()}", lambda: f"{p()} range {c()}",
        lambda: f"InverseObjectProperties({p()},{p()})", lambda: f"SubObjectPropertyOf({p()},{p()})", lambda: f"SymmetricObjectProperty({p()})",
    ]
    units = list(dict.fromkeys(r.choice(shapes)() for _ in range(r.randrange(2, 11))))
    return units, (e(), "type", c()) if r.random() < 0.5 else (e(), p(), e())


def test_proofs_and_minimal_proofs_equal_plain_ones(spark):
    cases = [made(k) for k in range(400)]
    rows = [(k, units, Q % (s, TYPE if p == "type" else f"http://e.org/a#{p}", o)) for k, (units, (s, p, o)) in enumerate(cases)]
    df = spark.createDataFrame(rows, "k int, units array<string>, query string").withColumn("st", T.statements(F.col("units")))
    question = F.lit("Is it so?")
    got = df.select("k", "st", T.proved(question, F.col("query"), F.col("st")).alias("proved"), T.minimal_proof(question, F.col("query"), F.col("units")).alias("proof")).collect()
    n = 0
    for r in got:
        units, target = cases[r["k"]]
        st = [says(u) for u in units]
        assert [(x["kind"], x["a"], x["b"]) for x in r["st"]] == [(k, a, b) for k, a, _, b in st]
        assert r["proved"] == plain_entails(st, *target), cases[r["k"]]
        if not r["proved"]:
            assert r["proof"] is None
            continue
        n += 1
        kept = list(units)
        for u in units:
            rest = [v for v in kept if v != u]
            kept = rest if plain_entails([says(v) for v in rest], *target) else kept
        assert r["proof"] == kept
        assert not any(plain_entails([says(v) for v in some], *target) for some in itertools.combinations(kept, len(kept) - 1))
    assert 40 < n < 360


def test_statements_of_odd_units(spark):
    units = ["<http://x#a>  <http://x#p>\n<http://x#b c>", "owl:InverseObjectProperties(p)", "p rdf:type owl:SymmetricProperty", "q rdf:type TransitiveObjectProperty", "Domain", "", None, "Unknown(a,b) c d", "http://x/y/a rdfs:subClassOf http://x/y/b/", "a likes b c"]
    got = spark.createDataFrame([(units,)], "u array<string>").select(T.statements(F.col("u")).alias("s")).first()["s"]
    assert [(x["kind"], x["a"], x["b"]) for x in got][2:] == [("type", "p", "owl:SymmetricProperty"), ("transitive", "q", "TransitiveObjectProperty"), (None, "Domain", ""), (None, "", ""), (None, "", ""), (None, "a", "b"), ("subclass", "a", "b"), ("triple", "a", "b c")]
    assert got[0]["kind"] == "triple" and got[0]["a"] == "a" and got[0]["rel"] == "p"
    assert got[1]["kind"] is None


def test_only_questions_for_yes_or_no_are_proved(spark):
    rows = [("Is a one?", Q % ("a", TYPE, "C")), ("Which are?", Q % ("a", TYPE, "C")), ("Is a one?", "SELECT ?x { ?x <p> <b> }"), (None, None)]
    df = spark.createDataFrame(rows, "question string, query string").withColumn("st", T.statements(F.array(F.lit("a rdf:type C"))))
    assert [r[0] for r in df.select(T.proved(F.col("question"), F.col("query"), F.col("st"))).collect()] == [True, False, False, False]
    assert df.select(T.type_target(F.col("query")).alias("t")).first()["t"].asDict() == {"subject": "a", "class": "C"}
