"""Queries on ontology units: their graph and scores, selection of context, proofs, and score adjustments that use them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import axioms as A
from ..functions import features as T
from ..operators import graph as G
from ..operators import rules as U
from ..sources.tables import table
from .graphs import _UP, _facts, _pairs
from .supports import r6

RULES = ("SubObjectPropertyOf(inNation,locatedIn)", "SubObjectPropertyOf(inRegion,locatedIn)")
#: Units of an example's context at most.
BUDGET = 12


def _nation_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(example, unit, entities, properties): the facts of a nation, and two rules, as the context of a question on it."""
    facts = _facts(spark, sf_dir).where("p <> 'placedBy'")
    own = facts.select(F.when(F.col("p") == "inRegion", F.col("s")).otherwise(F.col("o")).alias("example"), F.concat_ws(" ", "s", "p", "o").alias("unit"))
    rules = own.select("example").distinct().select("example", F.explode(F.array(*map(F.lit, RULES))).alias("unit"))
    return own.union(rules).distinct().withColumn("s", A.signature(F.col("unit"))).select("example", "unit", "s.entities", "s.properties")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(example, query_entities, query_properties): a nation's question names its first customer, its region, and inRegion."""
    first = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.min("c_custkey").alias("c"))
    n = table(spark, sf_dir, "nation").join(first, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    entities = F.array_compact(F.array(F.concat(F.lit("c"), F.col("c").cast("string")), F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))))
    return n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("example"), entities.alias("query_entities"), F.array(F.lit("inRegion")).alias("query_properties"))


def _terms(units: DataFrame) -> DataFrame:
    return units.select("example", F.col("unit").alias("node"), F.explode(F.array_distinct(F.transform(F.array_union("entities", "properties"), F.lower))).alias("term"))


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Units with degree, score and is_anchor, and their edges: units that share a term which 64 of them have at most."""
    units = G.stored(_nation_units(spark, sf_dir))
    edges = G.stored(G.shared_term_edges(_terms(units), 2, 64))
    degree = G.both_ways(edges).groupBy("example", F.col("src").alias("unit")).agg(F.count("*").alias("degree"))
    own = units.join(_asked(spark, sf_dir), "example").join(degree, ["example", "unit"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    both = lambda a, b: F.size(F.array_intersect(a, b))
    kind = A.parse(F.col("unit"))["kind"]
    score = 2.0 * both("entities", "query_entities") + 1.5 * both("properties", "query_properties") + F.when(kind == "fact", 0.15).when(kind == "rule", 0.10).otherwise(0.0) + 0.01 * F.least("degree", F.lit(8))
    anchor = F.arrays_overlap("entities", "query_entities") | F.arrays_overlap("properties", "query_properties")
    return own.select("example", "unit", kind.alias("kind"), F.col("degree").cast("int").alias("degree"), r6(score).alias("score"), anchor.alias("is_anchor")), edges


def ontology_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = _graph(spark, sf_dir)
    return nodes.select("example", "unit", "kind", "degree", "score", F.col("is_anchor").cast("int").alias("is_anchor"))


def ontology_pre_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of an anchor and a neighbour: mean score, 0.05 for the edge, 0.2 where a fact meets a rule."""
    nodes, edges = _graph(spark, sf_dir)
    nodes = G.stored(nodes)
    side = lambda end: nodes.select("example", F.col("unit").alias(end), F.col("score").alias(f"{end}_score"), F.col("kind").alias(f"{end}_kind"), F.col("is_anchor").alias(f"{end}_anchor"))
    pairs = edges.join(side("src"), ["example", "src"]).join(side("dst"), ["example", "dst"]).where("src_anchor or dst_anchor")
    mix = F.when(F.array_sort(F.array("src_kind", "dst_kind")) == F.array(F.lit("fact"), F.lit("rule")), 0.2).otherwise(0.0)
    return pairs.select("example", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), r6((F.col("src_score") + F.col("dst_score")) / 2 + 0.05 + mix).alias("pre_rank"))


def axiom_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units of an example's context, in the order they were taken; no SQL: a search in rounds."""
    return G.select_context(_nation_units(spark, sf_dir), _asked(spark, sf_dir), BUDGET)


def typed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between units by what they share: an entity 0.6, a property 0.55, a rule's property and a fact's 0.85."""
    units = G.stored(_nation_units(spark, sf_dir).withColumn("kind", A.parse(F.col("unit"))["kind"]))
    each = lambda c, name: units.select("example", "unit", "kind", F.explode(c).alias("term"), F.lit(name).alias("as"))
    terms = each("entities", "entity").union(each("properties", "property"))
    sizes = terms.groupBy("example", "term", "as").agg(F.count("*").alias("n")).where(F.col("n") <= 64)
    own = terms.join(sizes.select("example", "term", "as"), ["example", "term", "as"])
    other = own.select("example", "term", "as", F.col("unit").alias("dst"), F.col("kind").alias("dst_kind"))
    weight = F.when(F.col("as") == "entity", 0.6).when(F.col("kind") != F.col("dst_kind"), 0.85).otherwise(0.55)
    pairs = own.withColumnRenamed("unit", "src").join(other, ["example", "term", "as"]).where("src < dst")
    return pairs.groupBy("example", "src", "dst").agg(F.max(weight).alias("weight")).groupBy("example", "weight").agg(F.count("*").alias("edges"))


def type_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is a customer of the class that its key asks for? TRUE where its inferred types hold the class, else unknown."""
    range_ = _pairs(spark, [("placedBy", "Customer"), ("inNation", "Nation")], "p", "c")
    classes = _pairs(spark, [("Customer", "Party"), ("Nation", "Area"), ("Party", "Thing"), ("Area", "Thing")], "src", "dst")
    nothing = spark.createDataFrame([], "s string, c string")
    found = U.inferred_types(nothing, _facts(spark, sf_dir), spark.createDataFrame([], "p string, c string"), range_, _pairs(spark, _UP, "src", "dst"), classes)
    k = F.col("c_custkey") % 4
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("s"), F.when(k == 0, "Customer").when(k == 1, "Party").when(k == 2, "Thing").otherwise("Nation").alias("c"))
    return asked.join(found.select("s", "c", F.lit("TRUE").alias("proof")).distinct(), ["s", "c"], "left").select("c_custkey", F.col("c").alias("asked"), F.coalesce("proof", F.lit("unknown")).alias("answer"))


def inverse_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of classes by domain and range of a property and, one step, of its inverse: what is placed by is placed."""
    domain, range_ = _pairs(spark, [("placedBy", "Order")], "p", "c"), _pairs(spark, [("placedBy", "Customer")], "p", "c")
    inverse = _pairs(spark, [("placed", "placedBy")], "p", "q")
    facts = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("s"), F.lit("placed").alias("p"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("o"))
    return U.inverse_types(facts, domain, range_, inverse).groupBy("c").agg(F.count("*").alias("members"))


def _support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, c, n, query, units): support of the question whether a customer is in its nation."""
    t = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("c"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("n"))
    k, m = F.col("c_custkey") % 2 == 0, F.col("c_custkey") % 3 != 0
    units = F.array_compact(F.array(F.concat_ws(" ", "n", F.lit("inRegion r0")), F.when(m, F.lit("SubObjectPropertyOf(inNation,isIn)")), F.concat_ws(" ", "c", F.lit("inNation"), "n"), F.when(k, F.concat_ws(" ", "c", F.lit("isIn"), "n"))))
    query = F.concat(F.lit("ASK WHERE { <http://e.org/a#"), F.col("c"), F.lit("> <http://e.org/a#isIn> <http://e.org/a#"), F.col("n"), F.lit("> }"))
    return t.select("c_custkey", "c", "n", query.alias("query"), units.alias("units"))


def minimal_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units left when one after another goes that isn't needed for a proof: empty where nothing is proved.

    A proof is one fact, or a fact and a rule. Deleting in order leaves the proof whose first unit stands last, so it is
    the greatest list of places; no example is gone through unit by unit.
    """
    s = _support(spark, sf_dir)
    at = lambda unit: F.array_position("units", unit)
    direct, fact, rule = at(F.concat_ws(" ", "c", F.lit("isIn"), "n")), at(F.concat_ws(" ", "c", F.lit("inNation"), "n")), at(F.lit("SubObjectPropertyOf(inNation,isIn)"))
    proofs = F.array_compact(F.array(F.when(direct > 0, F.array(direct)), F.when((fact > 0) & (rule > 0), F.array_sort(F.array(fact, rule)))))
    kept = F.transform(F.coalesce(F.array_max(proofs), F.array().cast("array<bigint>")), lambda i: F.get("units", (i - 1).cast("int")))
    return s.select("c_custkey", F.size("units").alias("given"), F.array_join(kept, "|").alias("proof"))


def reader_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support in the order a reader gets it: most terms of the question first, facts before rules, else as it was."""
    s = _support(spark, sf_dir).withColumn("t", A.ask_target(F.col("query")))
    terms = F.array_distinct(F.transform(F.array("t.subject", "t.predicate", "t.object"), F.lower))
    scored = F.transform("units", lambda u, i: F.struct((-F.size(F.filter(terms, lambda t: F.lower(u).contains(t)))).alias("n"), F.when(A.unit_class(u) == "Fact", 0).otherwise(1).alias("rule"), i.alias("i"), u.alias("unit")))
    return s.select("c_custkey", F.array_join(F.transform(F.array_sort(scored), lambda x: x["unit"]), "|").alias("units"))


def _adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _support(spark, sf_dir)
    text, size = F.array_join("units", " "), F.size("units")
    schema = F.size(F.filter("units", A.is_schema))
    fact = F.exists("units", lambda u: ~A.is_schema(u) & (A.parse(u)["kind"] == "fact"))
    names = F.regexp_extract_all("query", F.lit("#([^>]+)>"), F.lit(1))
    properties, entities = F.filter(names, lambda x: x.rlike("^(has|is)")), F.filter(names, lambda x: ~x.rlike("^(has|is)"))
    words = F.array_distinct(F.filter(F.transform(F.regexp_extract_all("query", F.lit("([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)), F.lower), lambda w: (F.length(w) > 2) & ~w.startswith("http")))
    return s.withColumns({
        "property": F.exists(properties, lambda p: text.contains(p)).cast("double"), "entity": T.coverage_in(F.array_distinct(entities), text), "mix": (fact & (schema > 0)).cast("double"), "size": size, "schema": schema,
        "coverage": T.coverage_in(words, F.lower(text)), "proof": ((F.col("c_custkey") % 2 == 0) | (F.col("c_custkey") % 3 != 0)).cast("double"),
    })


def compact_adjustment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _adjusted(spark, sf_dir)
    return a.select("c_custkey", r6("entity").alias("entity"), F.col("property").alias("property"), "mix", r6(T.compact(a)).alias("adjustment"))


def proof_adjustment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _adjusted(spark, sf_dir)
    return a.select("c_custkey", r6("coverage").alias("coverage"), "proof", r6(T.proof(a)).alias("adjustment"))


def score_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate's score in each mode: the model's alone, less its size, with its mix and match, compact, with proof."""
    a = _adjusted(spark, sf_dir).withColumn("neural", F.col("c_custkey") % 7 / 7)
    return a.select("c_custkey", *(r6(T.by_mode(a, mode)).alias(mode) for mode in T.MODES))


QUERIES = {
    f.__name__: f
    for f in (ontology_graph, ontology_pre_rank, axiom_selection, typed_edges, type_proof, inverse_types, minimal_proof, reader_order, compact_adjustment, proof_adjustment, score_modes)
}

_UNITS = """
    f AS (SELECT 'n' || n_nationkey AS ex, 'n' || n_nationkey AS s, 'inRegion' AS p, 'r' || n_regionkey AS o FROM nation UNION SELECT 'n' || c_nationkey, 'c' || c_custkey, 'inNation', 'n' || c_nationkey FROM customer UNION SELECT 'n' || s_nationkey, 's' || s_suppkey, 'inNation', 'n' || s_nationkey FROM supplier),
    u AS (SELECT ex, s || ' ' || p || ' ' || o AS unit, 'fact' AS kind, [s, o] AS es, [p] AS ps FROM f UNION SELECT DISTINCT ex, r.unit, 'rule', []::VARCHAR[], [r.a, 'locatedIn'] FROM f, (SELECT 'SubObjectPropertyOf(inNation,locatedIn)' AS unit, 'inNation' AS a UNION SELECT 'SubObjectPropertyOf(inRegion,locatedIn)', 'inRegion') r),
    q AS (SELECT 'n' || n_nationkey AS ex, list_filter(['c' || min(c_custkey), 'r' || n_regionkey], lambda x: x IS NOT NULL) AS qe FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_regionkey)"""
_GRAPH = f"""{_UNITS},
    t AS (SELECT DISTINCT ex, unit, lower(unnest(list_concat(es, ps))) AS term FROM u), ok AS (SELECT ex, term FROM t GROUP BY ALL HAVING count(*) BETWEEN 2 AND 64),
    e AS (SELECT DISTINCT a.ex, a.unit AS a, b.unit AS b FROM t a JOIN ok USING (ex, term) JOIN t b USING (ex, term) WHERE a.unit < b.unit), d AS (SELECT ex, unit, count(*) AS degree FROM (SELECT ex, a AS unit FROM e UNION ALL SELECT ex, b FROM e) GROUP BY ALL),
    n AS (SELECT u.*, coalesce(degree, 0) AS degree, len(list_intersect(es, qe)) AS ne, CASE WHEN list_contains(ps, 'inRegion') THEN 1 ELSE 0 END AS np FROM u JOIN q USING (ex) LEFT JOIN d USING (ex, unit)),
    nodes AS (SELECT ex, unit, kind, degree, 2.0 * ne + 1.5 * np + CASE kind WHEN 'fact' THEN 0.15 ELSE 0.1 END + 0.01 * least(degree, 8) AS score, ne + np > 0 AS is_anchor FROM n)"""
_SUPPORT = """
    s AS (SELECT c_custkey, 'c' || c_custkey AS c, 'n' || c_nationkey AS n, c_custkey % 2 = 0 AS direct, c_custkey % 3 <> 0 AS ruled FROM customer),
    x AS (SELECT *, n || ' inRegion r0' AS u0, 'SubObjectPropertyOf(inNation,isIn)' AS u1, c || ' inNation ' || n AS u2, c || ' isIn ' || n AS u3, 2 + direct::INTEGER + ruled::INTEGER AS size FROM s),
    w AS (SELECT *, u0 || CASE WHEN ruled THEN ' ' || u1 ELSE '' END || ' ' || u2 || CASE WHEN direct THEN ' ' || u3 ELSE '' END AS text, list_filter(['ask', 'where', 'org', c, 'isin', n], lambda t: length(t) > 2) AS tokens FROM x),
    a AS (SELECT *, CASE WHEN direct OR ruled THEN 1.0 ELSE 0.0 END AS has, CASE WHEN ruled THEN 1.0 ELSE 0.0 END AS mix, len(list_filter(tokens, lambda t: contains(lower(text), t))) / len(tokens) AS coverage, CASE WHEN direct OR ruled THEN 1.0 ELSE 0.0 END AS proof, greatest(0, size - 2) AS over FROM w),
    c AS (SELECT *, 0.025 * has + 0.015 + 0.02 * mix - 0.006 * over AS compact FROM a)"""
ORACLE_SQL = {
    "ontology_graph": f"WITH {_GRAPH} SELECT ex AS example, unit, kind, degree::INTEGER AS degree, round(score::DOUBLE, 6) AS score, is_anchor::INTEGER AS is_anchor FROM nodes",
    "ontology_pre_rank": f"WITH {_GRAPH} SELECT e.ex AS example, e.a, e.b, round((round(x.score::DOUBLE, 6) + round(y.score::DOUBLE, 6)) / 2 + 0.05::DOUBLE + CASE WHEN x.kind <> y.kind THEN 0.2::DOUBLE ELSE 0 END, 6) AS pre_rank FROM e JOIN nodes x ON x.ex = e.ex AND x.unit = e.a JOIN nodes y ON y.ex = e.ex AND y.unit = e.b WHERE x.is_anchor OR y.is_anchor",
    "typed_edges": f"WITH {_UNITS}, t AS (SELECT ex, unit, kind, unnest(es) AS term, 'e' AS k FROM u UNION ALL SELECT ex, unit, kind, unnest(ps), 'p' FROM u), ok AS (SELECT ex, term, k FROM t GROUP BY ALL HAVING count(*) <= 64), e AS (SELECT a.ex, a.unit AS a, b.unit AS b, max(CASE WHEN a.k = 'e' THEN 0.6 WHEN a.kind <> b.kind THEN 0.85 ELSE 0.55 END) AS weight FROM t a JOIN ok USING (ex, term, k) JOIN t b USING (ex, term, k) WHERE a.unit < b.unit GROUP BY ALL) SELECT ex AS example, weight::DOUBLE AS weight, count(*) AS edges FROM e GROUP BY ALL",
    "type_proof": "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Customer' WHEN 1 THEN 'Party' WHEN 2 THEN 'Thing' ELSE 'Nation' END AS asked, CASE WHEN c_custkey % 4 < 3 AND c_custkey IN (SELECT o_custkey FROM orders) THEN 'TRUE' ELSE 'unknown' END AS answer FROM customer",
    "inverse_types": "SELECT 'Order' AS c, count(DISTINCT o_orderkey) AS members FROM orders UNION ALL SELECT 'Customer', count(DISTINCT o_custkey) FROM orders",
    "minimal_proof": f"WITH {_SUPPORT} SELECT c_custkey, size::INTEGER AS given, CASE WHEN direct THEN u3 WHEN ruled THEN u1 || '|' || u2 ELSE '' END AS proof FROM x",
    "reader_order": f"WITH {_SUPPORT}, l AS (SELECT c_custkey, unnest([u0, CASE WHEN ruled THEN u1 END, u2, CASE WHEN direct THEN u3 END]) AS unit, unnest([0, 1, 2, 3]) AS i, list_distinct([c, 'isin', n]) AS terms FROM x) SELECT c_custkey, string_agg(unit, '|' ORDER BY len(list_filter(terms, lambda t: contains(lower(unit), t))) DESC, starts_with(unit, 'Sub'), i) AS units FROM l WHERE unit IS NOT NULL GROUP BY c_custkey",
    "compact_adjustment": f"WITH {_SUPPORT} SELECT c_custkey, 1.0::DOUBLE AS entity, has::DOUBLE AS property, mix::DOUBLE AS mix, round(compact::DOUBLE, 6) AS adjustment FROM c",
    "proof_adjustment": f"WITH {_SUPPORT} SELECT c_custkey, round(coverage, 6) AS coverage, proof::DOUBLE AS proof, round((0.18 * proof + 0.03 * coverage + 0.02 * mix + 0.35 * compact - 0.01 * over)::DOUBLE, 6) AS adjustment FROM c",
    "score_modes": f"WITH {_SUPPORT}, m AS (SELECT *, c_custkey % 7 / 7 AS neural FROM c) SELECT c_custkey, round(neural, 6) AS neural, round((neural - 0.01 * size)::DOUBLE, 6) AS minimality, round((neural + 0.02 * mix + 0.02 * has - 0.005 * over)::DOUBLE, 6) AS completeness, round((neural + compact)::DOUBLE, 6) AS compact, round((neural + 0.18 * proof + 0.03 * coverage + 0.02 * mix + 0.35 * compact - 0.01 * over)::DOUBLE, 6) AS proof FROM m",
}
