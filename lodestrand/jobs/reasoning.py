"""Queries on ontology files, statements and proofs of supports, composed supports, paths, and coefficients."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import axioms as A
from ..functions import entail as E
from ..functions import features as V
from ..functions import sets as S
from ..functions import text as X
from ..operators import beam as B
from ..operators import compose as P
from ..operators import graph as G
from ..operators import metrics as M
from ..operators import tuning as U
from ..sources import rdf
from ..sources.tables import candidates, gold, grains, sentences, table
from . import graphs, ontology
from .graphs import _ENT
from .texts import _OVERLAP_SQL, SENTENCES_SQL, question_overlap

_HEAD = "@prefix e: <http://e.org/a#> .\n@prefix owl: <http://www.w3.org/2002/07/owl#> .\n@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n"
_OPEN = '<?xml version="1.0"?>\n<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:e="http://e.org/a#">\n'


def _ontology_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, text): what is known of a customer, as Turtle for even keys and as RDF/XML for odd ones."""
    t = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("c"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("n"), "c_mktsegment", F.sequence(F.lit(0), (F.col("c_custkey") % 6).cast("int")).alias("steps"))
    text = lambda *x: F.concat(*(v if isinstance(v, F.Column) else F.lit(v) for v in x))
    chain = F.array_join(F.transform("steps", lambda i: F.concat(F.lit("e:s"), i.cast("string"))), " ")
    turtle = text(
        _HEAD, "e:", F.col("c"), " a e:Customer , owl:NamedIndividual ;\n  e:inNation e:", F.col("n"), ' ; rdfs:comment "of ', F.col("c_mktsegment"), '; \\"so\\"."@en .\n',
        "e:inNation rdfs:subPropertyOf e:locatedIn ; rdfs:domain e:Customer . # says where\ne:placed owl:inverseOf e:placedBy .\n",
        "e:Customer rdfs:subClassOf [ a owl:Restriction ; owl:onProperty e:inNation ] .\ne:far", F.col("c"), " owl:propertyChainAxiom ( ", chain, " ) .\n",
    )
    members = F.array_join(F.transform("steps", lambda i: F.concat(F.lit('<rdf:Description rdf:about="http://e.org/a#s'), i.cast("string"), F.lit('"/>'))), "")
    xml = text(
        _OPEN, '<e:Customer rdf:about="http://e.org/a#', F.col("c"), '"><e:inNation rdf:resource="http://e.org/a#', F.col("n"), '"/><rdfs:comment>of ', F.col("c_mktsegment"), "</rdfs:comment></e:Customer>\n",
        '<owl:ObjectProperty rdf:about="http://e.org/a#inNation"><rdfs:subPropertyOf rdf:resource="http://e.org/a#locatedIn"/><rdfs:domain rdf:resource="http://e.org/a#Customer"/></owl:ObjectProperty>\n',
        '<rdf:Description rdf:about="http://e.org/a#placed"><owl:inverseOf rdf:resource="http://e.org/a#placedBy"/></rdf:Description>\n',
        '<rdf:Description rdf:about="http://e.org/a#far', F.col("c"), '"><owl:propertyChainAxiom rdf:parseType="Collection">', members, "</owl:propertyChainAxiom></rdf:Description>\n</rdf:RDF>",
    )
    return t.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, turtle).otherwise(xml).alias("text"))


def ontology_axioms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axioms of ontology texts, Turtle and RDF/XML: read as triples, chains folded from their lists."""
    facts = G.stored(rdf.triples(_ontology_texts(spark, sf_dir), "c_custkey", "text"))
    return rdf.axioms(facts, "c_custkey")


def ontology_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of group files: a nation is a file, its customers are groups of one or two questions, read back from JSON."""
    t = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("c"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("n"))
    known = F.concat_ws(" ", "c", F.lit("inNation"), "n")
    qa = lambda k, golds: F.struct(F.concat(F.lit("t"), F.col("c_custkey").cast("string"), F.lit(f"-{k}")).alias("Task ID"), F.concat(F.lit("Is "), "c", F.lit(" in "), "n", F.lit("?")).alias("NL Question"), F.lit("TRUE").alias("Answer"), golds.alias("Explanations"), F.array(F.lit("Symmetric: near"), F.lit("TAG: x")).alias("Minimum Explanation"))
    two = F.array(F.array(known, F.lit("inNation rdfs:subPropertyOf locatedIn"), known), F.array(F.lit("TAG: y")))
    none = F.array().cast("array<array<string>>")
    body = F.to_json(F.struct(F.lit("ASK").alias("Task Type"), F.lit("").alias("OWL Context"), F.when(F.col("c_custkey") % 3 == 0, F.array(qa(0, two))).otherwise(F.array(qa(0, two), qa(1, none))).alias("QAs")))
    groups = t.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("source_name"), F.col("c_custkey").alias("at"), F.from_json(body, rdf.GROUP).alias("g")).select("source_name", "at", "g.*")
    found = rdf.group_questions(groups)
    return found.select("source_name", "group_index", "qa_index", "task_type", "task_id", "question", "answer", F.to_json("golds").alias("golds"))


def _supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, question, query, units, shape): supports of five shapes, with what isn't needed among them; of a seventh of them a needed unit is gone."""
    t = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 5).alias("shape"), (F.col("c_custkey") % 7 == 0).alias("broken"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("c"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("n"))
    fact = F.concat_ws(" ", "c", F.lit("inNation"), "n")
    up, inverse, noise = F.lit("SubObjectPropertyOf(inNation,locatedIn)"), F.lit("InverseObjectProperties(locatedIn,locates)"), F.concat_ws(" ", "n", F.lit("likes"), "c")
    rules = {
        0: (up, noise), 1: (noise, inverse, up), 2: (F.lit("SymmetricObjectProperty(locatedIn)"), up, noise), 3: (F.lit("inNation domain Customer"), F.lit("Customer SubClassOf Party"), noise), 4: (up, F.lit("Place SubClassOf Thing"), inverse, F.lit("locates domain Place")),
    }
    units = F.lit(None).cast("array<string>")
    for k, more in rules.items():
        units = F.when(F.col("shape") == k, F.array(more[0], fact, *more[1:], noise)).otherwise(units)
    units = F.array_distinct(F.when(F.col("broken"), F.filter(units, lambda u: u != fact)).otherwise(units))
    name = lambda x: F.concat(F.lit("<http://e.org/a#"), x if isinstance(x, F.Column) else F.lit(x), F.lit(">"))
    kind = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
    ask = lambda s, p, o: F.concat(F.lit("ASK WHERE { "), s, F.lit(" "), p, F.lit(" "), o, F.lit(" . }"))
    c, n, k = name(F.col("c")), name(F.col("n")), F.col("shape")
    query = F.when(k == 0, ask(c, name("locatedIn"), n)).when(k == 1, ask(n, name("locates"), c)).when(k == 2, ask(n, name("locatedIn"), c)).when(k == 3, ask(c, F.lit(kind), name("Party"))).otherwise(ask(n, F.lit(kind), name("Thing")))
    question = F.when(F.col("c_custkey") % 11 == 0, "Where is it?").otherwise("Is it so?")
    return t.select("c_custkey", question.alias("question"), query.alias("query"), units.alias("units"), "shape", fact.alias("fact"))


def unit_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the units of supports say, by kind: how many say it, of how many subjects and objects."""
    each = _supports(spark, sf_dir).select(F.explode(E.statements(F.col("units"))).alias("s"))
    return each.groupBy("s.kind").agg(F.count("*").alias("units"), F.count_distinct("s.a").alias("subjects"), F.count_distinct("s.b").alias("objects"))


def support_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a support proves its question, and what is left of it when all that can go has gone."""
    s = _supports(spark, sf_dir)
    proof = E.minimal_proof(F.col("question"), F.col("query"), F.col("units"))
    return s.select("c_custkey", F.size("units").alias("given"), F.array_join(proof, "|").alias("proof"))


def rescued_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of supports against a gold that has other units: a support that proves a true question is right all the same."""
    s = _supports(spark, sf_dir).withColumn("proof", E.minimal_proof(F.col("question"), F.col("query"), F.col("units")))
    golds = F.array(F.when(F.col("c_custkey") % 4 == 0, F.array("fact", F.lit("x y z"))).when(F.col("c_custkey") % 4 == 1, F.array("fact")).otherwise(F.array(F.lit("x y z"))))
    answer = F.when(F.col("c_custkey") % 13 == 0, "FALSE").otherwise("Yes ")
    found = M.rescued_outcome(F.col("units"), golds, F.col("proof"), F.col("query"), answer)
    return s.select("c_custkey", found.alias("o")).select("c_custkey", "o.*")


def _nation_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(example, place, unit, score): the ten best units of a nation's question, and its rules."""
    nodes, _ = ontology._graph(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("example", F.col("kind") == "rule").orderBy(F.desc("score"), "unit"))
    top = nodes.withColumn("k", place).where((F.col("kind") == "rule") | (F.col("k") <= 10))
    return top.select("example", F.row_number().over(Window.partitionBy("example").orderBy(F.desc("score"), "unit")).alias("place"), "unit", "score")


def composed_supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best subset of three units or fewer of a nation's context, all subsets scored."""
    info = P.contexts(G.stored(_nation_context(spark, sf_dir))).join(ontology._asked(spark, sf_dir).select("example", F.col("query_entities").alias("entities"), F.col("query_properties").alias("properties")), "example")
    best = P.compose(info, 3)
    return best.select("example", F.array_join(F.transform("members", lambda m: m.cast("string")), "|").alias("members"), "score", F.col("exhaustive").cast("int").alias("exhaustive"))


def composed_beam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best subset of four units of a nation's whole ontology, by a beam where there are too many; no SQL: a beam."""
    units = ontology._graph(spark, sf_dir)[0].select("example", F.row_number().over(Window.partitionBy("example").orderBy("unit")).alias("place"), "unit", "score")
    asked = ontology._asked(spark, sf_dir).select("example", F.col("query_entities").alias("entities"), F.col("query_properties").alias("properties"))
    best = P.compose_rows(G.stored(units), asked, 4)
    return best.select("example", F.array_join(F.transform("members", lambda m: m.cast("string")), "|").alias("members"), "score", F.col("exhaustive").cast("int").alias("exhaustive"))


def axiom_beam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked sets of one to four units of a nation's ontology, a hundred at most; no SQL: a beam."""
    units = ontology._graph(spark, sf_dir)[0].select("example", F.row_number().over(Window.partitionBy("example").orderBy("unit")).alias("place"), "unit", "score")
    found = P.axiom_beam_rows(G.stored(units), 1, 4, 64, 100)
    return found.select("example", "place", F.array_join(F.transform("members", lambda m: m.cast("string")), "|").alias("members"), "score")


#: Units of a pool, and candidates of a question, where supports are enumerated.
POOL, ENUMERATED = 24, 512


def enumerated_supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supports of up to three of a customer's brands: single ones, pairs, and triples in a keyed order where there are too many."""
    units = candidates(spark, sf_dir).select("example", F.explode("units").alias("unit")).distinct()
    pool = units.withColumn("k", F.row_number().over(Window.partitionBy("example").orderBy("unit"))).where(F.col("k") <= POOL)
    pools = pool.groupBy("example").agg(F.array_sort(F.collect_list("unit")).alias("units"))
    found = P.enumerated_lists(pools, 3, ENUMERATED, 42)
    # what is sampled depends on the hash: how many there are of each size, and that none comes twice, doesn't
    text = F.transform("members", lambda m: F.array_join(F.sort_array(F.transform(m, lambda i: F.get("units", i))), "\0"))
    each = found.select("example", "size", "before", text.alias("supports"))
    return each.select("example", "size", F.size("supports").cast("long").alias("supports"), F.size(F.array_distinct("supports")).cast("long").alias("different"), (F.col("before") + 1).alias("first_place"))


def generator_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each document's graph at the frozen setting: surroundings of anchors, then the search; no SQL: lanes take turns."""
    nodes, edges = graphs._graph(spark, sf_dir)
    found = B.generate(nodes.select("example", "node", F.round("score", 6).alias("score"), "is_anchor"), edges)
    return found.select("example", "place", F.array_join(F.transform("members", lambda m: m.cast("string")), "|").alias("members"), F.col("local").cast("int").alias("local"))


def _values(vector: F.Column) -> list[F.Column]:
    return [F.round(F.get(vector, k), 6).alias(f"f{k}") for k in range(8)]


def support_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight values of each customer's support."""
    s = _supports(spark, sf_dir).withColumn("q", A.query_signature(F.col("query")))
    names = lambda c: F.transform(F.col(f"q.{c}"), E.local)
    return s.select("c_custkey", V.support_vector(F.col("units"), names("entities"), names("properties")).alias("v")).select("c_custkey", *_values(F.col("v")))


def node_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight values of the units of a nation's ontology, and of its facts as they stand in a knowledge graph."""
    nodes = G.stored(ontology._graph(spark, sf_dir)[0].select("example", "unit", "kind", "degree"))
    largest = nodes.groupBy("example").agg(F.greatest(F.max("degree"), F.lit(1)).alias("most"))
    own = nodes.join(largest, "example").withColumn("share", F.col("degree") / F.col("most"))
    kg = own.where("kind = 'fact'").select("example", F.concat(F.lit("KG::"), F.regexp_replace("unit", " ", "::")).alias("unit"), F.lit(0.0).alias("share"))
    asked = ontology._asked(spark, sf_dir).withColumn("question", F.concat(F.lit("Is the "), F.array_join("query_entities", " or "), F.lit(" inRegion?")))
    every = own.select("example", "unit", "share").union(kg).join(asked, "example")
    vector = V.node_vector(F.col("unit"), F.col("question"), F.col("query_entities"), F.col("query_properties"), F.col("share"))
    return every.select("example", "unit", vector.alias("v")).select("example", "unit", *_values(F.col("v")))


def path_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shortest path from a region to the parts that its suppliers have sold, as text."""
    name = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    nation = table(spark, sf_dir, "nation").select(name("n", "n_nationkey").alias("n"), name("r", "n_regionkey").alias("r"))
    supplier = table(spark, sf_dir, "supplier").select(name("s", "s_suppkey").alias("s"), name("n", "s_nationkey").alias("n"))
    sold = table(spark, sf_dir, "lineitem").select(name("s", "l_suppkey").alias("s"), name("p", "l_partkey").alias("p")).distinct()
    links = nation.select(F.col("n").alias("src"), F.lit("inRegion").alias("rel"), F.col("r").alias("dst")).union(supplier.select("s", F.lit("inNation"), "n")).union(sold.select("s", F.lit("sells"), "p"))
    goals = sold.join(supplier, "s").join(nation, "n").select(F.col("r").alias("root"), F.col("p").alias("goal")).distinct()
    found = G.all_shortest_paths(goals, links, most_paths=max(10_000_000, 4 * table(spark, sf_dir, "lineitem").count()))
    return found.select("root", "goal", G.path_string(F.col("nodes"), F.col("relations")).alias("path"))


def coefficient_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of a re-ranking of customers' orders by price, size and shared brands; no SQL: a search in rounds."""
    c = candidates(spark, sf_dir).join(gold(spark, sf_dir), "example").join(grains(spark, sf_dir).select("example", "dataset"), "example")
    n = F.size("units")
    rows = c.select(
        "dataset", "example", X.identity(F.col("units")).alias("identity"), F.round(F.col("score") / 500000, 6).alias("base"), F.round(S.best_of(F.col("units"), F.col("golds"))["f1"], 6).alias("f1"),
        F.round(F.least(n, F.lit(6)) / 6, 6).alias("size"), (-F.greatest(n - 4, F.lit(0))).cast("double").alias("beyond"), F.exists("units", lambda u: u.endswith("1")).cast("double").alias("first_line"),
    )
    found = U.coordinate_search(rows, {"size": [k / 20 for k in range(9)], "beyond": [k / 50 for k in range(6)], "first_line": [k / 20 for k in range(5)]}, {"size": 0.1, "beyond": 0.02, "first_line": 0.05})
    values = [(n, float(v), round(found.objective, 9), found.start, found.passes, int(found.improved)) for n, v in found.values.items()]
    return spark.createDataFrame(values, "coefficient string, value double, objective double, start string, passes int, improved int")


def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a document's length tells its quality, as area under precision and recall."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return M.average_precision(rows, "quality", "n_chars").select(F.round("average_precision", 6).alias("average_precision"))


def question_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs as a question answerer reads them, a row for each edge, nodes numbered within the question.

    A question mentions the pages of its three best documents and retrieves their sentences; pages hold sentences; sentences
    and the entities that they name point at each other. Numbers go by the nodes' text.
    """
    near = Window.partitionBy("item_id").orderBy(F.desc("shared"), "doc_id")
    top = question_overlap(spark, sf_dir).withColumn("k", F.row_number().over(near)).where("k <= 3").select("item_id", "doc_id")
    own = sentences(table(spark, sf_dir, "documents")).join(top, "doc_id")
    q, page = F.concat(F.lit("QUESTION::"), F.col("item_id").cast("string")), F.concat(F.lit("TITLE::"), "title")
    at = F.concat(F.lit("EV::"), "title", F.lit("::"), F.col("sent_idx").cast("string"))
    base = G.stored(own.select("item_id", q.alias("q"), page.alias("page"), at.alias("at"), X.entities(F.regexp_replace("sentence", r"[^\x00-\x7F]", ".")).alias("names")))
    named = base.select("item_id", "at", F.explode("names").alias("n")).select("item_id", "at", F.concat(F.lit("ENT::"), "n").alias("e"))
    edges = base.select("item_id", F.col("q").alias("s"), F.lit("mentions_page").alias("relation"), F.col("page").alias("o"))
    for s, relation, o in (("page", "contains_sentence", "at"), ("q", "retrieved_evidence", "at")):
        edges = edges.union(base.select("item_id", s, F.lit(relation), o))
    edges = G.stored(edges.union(named.select("item_id", "at", F.lit("mentions_kg_entity"), "e")).union(named.select("item_id", "e", F.lit("mentioned_in_sentence"), "at")).distinct())
    nodes = edges.select("item_id", F.col("s").alias("node")).union(edges.select("item_id", "o")).distinct().withColumn("number", F.row_number().over(Window.partitionBy("item_id").orderBy("node")) - 1)
    side = lambda c: nodes.select("item_id", F.col("node").alias(c), F.col("number").alias(f"{c}_number"))
    return edges.join(side("s"), ["item_id", "s"]).join(side("o"), ["item_id", "o"]).select("item_id", "s", "relation", "o", "s_number", "o_number")


QUERIES = {
    f.__name__: f
    for f in (
        ontology_axioms, ontology_groups, unit_statements, support_proofs, rescued_outcomes, composed_supports, composed_beam, axiom_beam, enumerated_supports, generator_candidates, path_strings,
        coefficient_search, average_precision, question_graphs, support_vectors, node_vectors,
    )
}

_CONTEXT = """
    facts AS (SELECT 'n' || n_nationkey AS example, 'n' || n_nationkey AS s, 'inRegion' AS p, 'r' || n_regionkey AS o FROM nation UNION SELECT 'n' || c_nationkey, 'c' || c_custkey, 'inNation', 'n' || c_nationkey FROM customer UNION SELECT 'n' || s_nationkey, 's' || s_suppkey, 'inNation', 'n' || s_nationkey FROM supplier),
    units AS (SELECT example, s || ' ' || p || ' ' || o AS unit, 'fact' AS kind, list_distinct([s, o]) AS es, [p] AS ps FROM facts UNION ALL SELECT DISTINCT example, u, 'rule', []::VARCHAR[], CASE u WHEN 'SubObjectPropertyOf(inNation,locatedIn)' THEN ['inNation', 'locatedIn'] ELSE ['inRegion', 'locatedIn'] END FROM facts, (VALUES ('SubObjectPropertyOf(inNation,locatedIn)'), ('SubObjectPropertyOf(inRegion,locatedIn)')) v(u)),
    terms AS (SELECT example, unit, unnest(list_distinct(list_transform(list_concat(es, ps), lambda x: lower(x)))) AS term FROM units),
    ok AS (SELECT example, term FROM terms GROUP BY ALL HAVING count(*) BETWEEN 2 AND 64),
    deg AS (SELECT a.example, a.unit, count(DISTINCT b.unit) AS degree FROM terms a JOIN ok USING (example, term) JOIN terms b USING (example, term) WHERE a.unit <> b.unit GROUP BY ALL),
    asked AS (SELECT 'n' || n_nationkey AS example, list_filter(['c' || (SELECT min(c_custkey) FROM customer WHERE c_nationkey = n_nationkey), 'r' || n_regionkey], lambda x: x IS NOT NULL) AS qe, ['inRegion'] AS qp FROM nation),
    scored AS (SELECT u.*, qe, qp, round((2.0 * len(list_intersect(es, qe)) + 1.5 * len(list_intersect(ps, qp)) + CASE kind WHEN 'fact' THEN 0.15 ELSE 0.10 END + 0.01 * least(coalesce(degree, 0), 8))::DOUBLE, 6) AS score FROM units u JOIN asked USING (example) LEFT JOIN deg USING (example, unit)),
    best AS (SELECT *, row_number() OVER (PARTITION BY example, kind ORDER BY score DESC, unit) AS k FROM scored),
    ctx AS (SELECT *, row_number() OVER (PARTITION BY example ORDER BY score DESC, unit) - 1 AS i FROM best WHERE kind = 'rule' OR k <= 10)"""
_SHAPES = """
    t AS (SELECT c_custkey, c_custkey % 5 AS shape, c_custkey % 7 = 0 AS broken, c_custkey % 11 <> 0 AS asks, 'c' || c_custkey AS c, 'n' || c_nationkey AS n, 'c' || c_custkey || ' inNation n' || c_nationkey AS fact, 'n' || c_nationkey || ' likes c' || c_custkey AS noise FROM customer),
    u AS (SELECT *, list_filter(CASE shape WHEN 0 THEN ['SubObjectPropertyOf(inNation,locatedIn)', fact, noise] WHEN 1 THEN [noise, fact, 'InverseObjectProperties(locatedIn,locates)', 'SubObjectPropertyOf(inNation,locatedIn)'] WHEN 2 THEN ['SymmetricObjectProperty(locatedIn)', fact, 'SubObjectPropertyOf(inNation,locatedIn)', noise] WHEN 3 THEN ['inNation domain Customer', fact, 'Customer SubClassOf Party', noise]
        ELSE ['SubObjectPropertyOf(inNation,locatedIn)', fact, 'Place SubClassOf Thing', 'InverseObjectProperties(locatedIn,locates)', 'locates domain Place', noise] END, lambda x: NOT (broken AND x = fact)) AS units FROM t),
    pr AS (SELECT *, CASE WHEN asks AND NOT broken THEN list_filter(units, lambda x: x <> noise) END AS proof FROM u)"""
_EIGHT = ", ".join(f"round(f{k}::DOUBLE, 6) AS f{k}" for k in range(8))
ORACLE_SQL = {
    "support_vectors": f"""WITH {_SHAPES}, q AS (SELECT *, CASE shape WHEN 3 THEN [c, 'Party'] WHEN 4 THEN [n, 'Thing'] ELSE [c, n] END AS qe, CASE shape WHEN 0 THEN 'locatedIn' WHEN 1 THEN 'locates' WHEN 2 THEN 'locatedIn' ELSE 'type' END AS qp FROM u),
        e AS (SELECT c_custkey, len(units) AS n, qe, qp, unnest(units) AS x FROM q), k AS (SELECT *, contains(x, '(') AS rule, string_split(x, ' ') AS w, string_split(regexp_extract(x, '\\(([^)]+)\\)', 1), ',') AS args FROM e),
        p AS (SELECT *, NOT rule AND (list_contains(qe, w[1]) OR list_contains(qe, w[3])) AS ent, rule AND list_contains(args, qp) AS rp, CASE WHEN rule THEN list_contains(args, qp) ELSE w[2] = qp END AS pr FROM k),
        v AS (SELECT c_custkey, count(*) FILTER (ent) / max(n) AS f0, count(*) FILTER (pr) / max(n) AS f1, bool_or(rp)::INTEGER AS f2, bool_or(ent)::INTEGER AS f3, (bool_or(rule) AND bool_or(NOT rule))::INTEGER AS f4, least(max(n), 5) / 5 AS f5, 0 AS f6, 0 AS f7 FROM p GROUP BY c_custkey) SELECT c_custkey, {_EIGHT} FROM v""",
    "node_vectors": f"""WITH {_CONTEXT}, s AS (SELECT u.*, qe, qp, coalesce(degree, 0) AS degree FROM units u JOIN asked USING (example) LEFT JOIN deg USING (example, unit)),
        v AS (SELECT example, unit, (kind = 'fact')::INTEGER AS f0, (kind = 'rule')::INTEGER AS f1, (len(list_intersect(es, qe)) > 0)::INTEGER AS f2, (len(list_intersect(ps, qp)) > 0)::INTEGER AS f3, (kind = 'rule' AND len(list_intersect(ps, qp)) > 0)::INTEGER AS f4, (len(list_intersect(es, qe)) > 0)::INTEGER AS f5, degree / greatest(max(degree) OVER (PARTITION BY example), 1) AS f6, 1 AS f7 FROM s
        UNION ALL SELECT example, 'KG::' || replace(unit, ' ', '::'), 1, 0, (len(list_intersect(es, qe)) > 0)::INTEGER, (ps = ['inRegion'])::INTEGER, 0, (len(list_intersect(es, qe)) > 0)::INTEGER, 0, 1 FROM s WHERE kind = 'fact') SELECT example, unit, {_EIGHT} FROM v""",
    "ontology_axioms": "SELECT c_custkey, unnest(['c' || c_custkey || ' rdf:type Customer', 'c' || c_custkey || ' inNation n' || c_nationkey, 'SubObjectPropertyOf(inNation,locatedIn)', 'inNation domain Customer', 'InverseObjectProperties(placed,placedBy)', 'ObjectPropertyChain(' || array_to_string(list_transform(range(0, 1 + c_custkey % 6), lambda i: 's' || i), ',') || '->farc' || c_custkey || ')']) AS axiom FROM customer",
    "ontology_groups": """WITH g AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS gi FROM customer), q AS (SELECT *, unnest(CASE WHEN c_custkey % 3 = 0 THEN [0] ELSE [0, 1] END) AS qi FROM g)
        SELECT 'n' || c_nationkey AS source_name, gi::INTEGER AS group_index, qi::INTEGER AS qa_index, 'ASK' AS task_type, 't' || c_custkey || '-' || qi AS task_id, 'Is c' || c_custkey || ' in n' || c_nationkey || '?' AS question, 'TRUE' AS answer, CASE qi WHEN 0 THEN '[["c' || c_custkey || ' inNation n' || c_nationkey || '","SubObjectPropertyOf(inNation,locatedIn)"]]' ELSE '[["SymmetricObjectProperty(near)"]]' END AS golds FROM q""",
    "unit_statements": f"WITH {_SHAPES}, e AS (SELECT c, n, unnest(units) AS x FROM u), s AS (SELECT CASE WHEN x LIKE 'SubObject%' THEN 'subproperty' WHEN x LIKE 'Inverse%' THEN 'inverse' WHEN x LIKE 'Symmetric%' THEN 'symmetric' WHEN x LIKE '% domain %' THEN 'domain' WHEN x LIKE '% SubClassOf %' THEN 'subclass' ELSE 'triple' END AS kind, CASE WHEN x LIKE '%(%' THEN regexp_extract(x, '\\(([^,)]+)', 1) ELSE string_split(x, ' ')[1] END AS a, CASE WHEN x LIKE 'Symmetric%' THEN '' WHEN x LIKE '%(%' THEN regexp_extract(x, ',([^)]+)', 1) ELSE string_split(x, ' ')[3] END AS b FROM e) SELECT kind, count(*) AS units, count(DISTINCT a) AS subjects, count(DISTINCT b) AS objects FROM s GROUP BY kind",
    "support_proofs": f"WITH {_SHAPES} SELECT c_custkey, len(units)::INTEGER AS given, array_to_string(proof, '|') AS proof FROM pr",
    "rescued_outcomes": f"""WITH {_SHAPES}, g AS (SELECT *, CASE c_custkey % 4 WHEN 0 THEN [fact, 'x y z'] WHEN 1 THEN [fact] ELSE ['x y z'] END AS gold, c_custkey % 13 <> 0 AS true_ FROM pr),
        o AS (SELECT *, len(list_filter(gold, lambda x: NOT list_contains(units, x))) AS miss, len(list_filter(units, lambda x: NOT list_contains(gold, x))) AS extra, len(list_intersect(units, gold)) AS both_n FROM g),
        r AS (SELECT *, miss > 0 AND true_ AND proof IS NOT NULL AS rescued FROM o)
        SELECT c_custkey, CASE WHEN miss = 0 AND extra = 0 THEN 'exact' WHEN miss = 0 THEN 'complete_nonminimal' WHEN rescued AND len(proof) = len(units) THEN 'exact' WHEN rescued THEN 'complete_nonminimal' WHEN both_n > 0 THEN 'incomplete' ELSE 'disjoint' END AS outcome,
            CASE WHEN rescued THEN len(proof) ELSE len(gold) END::INTEGER AS reference_size, CASE WHEN rescued THEN 0 ELSE miss END::INTEGER AS missing_units, CASE WHEN rescued THEN len(units) - len(proof) ELSE extra END::INTEGER AS additional_units, rescued FROM r""",
    "composed_supports": f"""WITH {_CONTEXT}, w AS (SELECT *, len(list_intersect(es, qe)) > 0 AS he, len(list_intersect(ps, qp)) > 0 AS hp FROM ctx),
        l AS (SELECT a.example, a.i AS x, b.i AS y FROM w a JOIN w b ON b.example = a.example AND a.i < b.i WHERE CASE WHEN a.kind = 'fact' AND b.kind = 'fact' THEN len(list_intersect(a.es, b.es)) > 0 ELSE len(list_intersect(a.ps, b.ps)) > 0 END),
        sets AS (SELECT example, [i] AS m FROM w UNION ALL SELECT a.example, [a.i, b.i] FROM w a JOIN w b ON b.example = a.example AND a.i < b.i UNION ALL SELECT a.example, [a.i, b.i, c.i] FROM w a JOIN w b ON b.example = a.example AND a.i < b.i JOIN w c ON c.example = a.example AND b.i < c.i),
        each AS (SELECT s.example, s.m, count(*) AS size, sum(score) AS base, count(DISTINCT kind) AS kinds, sum(he::INTEGER + hp::INTEGER) AS hits, bool_or(kind = 'fact' AND (he OR hp)) AND bool_or(kind = 'rule' AND (he OR hp)) AS both_hit, list_distinct(flatten(list(es))) AS es, flatten(list(ps)) AS ps, any_value(qe) AS qe, any_value(qp) AS qp, (SELECT count(*) FROM l WHERE l.example = s.example AND list_contains(s.m, l.x) AND list_contains(s.m, l.y)) AS links FROM sets s JOIN w ON w.example = s.example AND list_contains(s.m, w.i) GROUP BY s.example, s.m),
        v AS (SELECT *, round((base + CASE WHEN links >= size - 1 THEN 0.30 ELSE 0 END + CASE WHEN kinds = 2 THEN 0.20 ELSE 0 END + 0.18 * hits / size + 0.22 * ((len(list_intersect(es, qe)) / len(qe) + len(list_intersect(list_distinct(ps), qp)) / len(qp) + CASE WHEN both_hit THEN 0.5 ELSE 0 END) / 2.5) - 0.05 * (1 - len(list_distinct(ps)) / len(ps)))::DOUBLE, 6) AS score FROM each),
        k AS (SELECT *, row_number() OVER (PARTITION BY example ORDER BY score DESC, size, m) AS k FROM v) SELECT example, array_to_string(m, '|') AS members, score, 1 AS exhaustive FROM k WHERE k = 1""",
    "enumerated_supports": f"""WITH u AS (SELECT DISTINCT o_custkey AS example, p_brand FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey), n AS (SELECT example, least(count(*), {POOL}) AS n FROM u GROUP BY example),
        c AS (SELECT example, unnest([1, 2, 3]) AS size, unnest([n, least(n * (n - 1) // 2, {4 * ENUMERATED}), least(n * (n - 1) * (n - 2) // 6, {4 * ENUMERATED})]) AS cnt FROM n),
        b AS (SELECT *, coalesce(sum(cnt) OVER (PARTITION BY example ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
        SELECT example, size::INTEGER AS size, least(cnt, {ENUMERATED} - before)::BIGINT AS supports, least(cnt, {ENUMERATED} - before)::BIGINT AS different, (before + 1)::BIGINT AS first_place FROM b WHERE cnt > 0 AND before < {ENUMERATED}""",
    "path_strings": "SELECT DISTINCT 'r' || n_regionkey AS root, 'p' || l_partkey AS goal, 'r' || n_regionkey || ' -> inRegion -> n' || n_nationkey || ' -> inNation -> s' || s_suppkey || ' -> sells -> p' || l_partkey AS path FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey",
    "average_precision": "WITH r AS (SELECT quality, n_chars FROM labels JOIN documents USING (doc_id)), s AS (SELECT n_chars, count(*) FILTER (quality = 1) AS hits, count(*) AS n FROM r WHERE quality IS NOT NULL AND n_chars IS NOT NULL GROUP BY n_chars), c AS (SELECT hits, sum(hits) OVER w / sum(n) OVER w AS p FROM s WINDOW w AS (ORDER BY n_chars DESC)) SELECT round(sum(hits * p) / sum(hits), 6) AS average_precision FROM c",
    "question_graphs": f"""WITH {_OVERLAP_SQL}, {SENTENCES_SQL}, top AS (SELECT item_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id) AS k FROM overlap) WHERE k <= 3),
        b AS (SELECT item_id, 'QUESTION::' || item_id AS q, 'TITLE::' || title AS page, 'EV::' || title || '::' || sent_idx AS spot, {_ENT} AS names FROM sentences JOIN top USING (doc_id)),
        n AS (SELECT item_id, spot, 'ENT::' || unnest(names) AS e FROM b),
        e AS (SELECT item_id, q AS s, 'mentions_page' AS relation, page AS o FROM b UNION SELECT item_id, page, 'contains_sentence', spot FROM b UNION SELECT item_id, q, 'retrieved_evidence', spot FROM b UNION SELECT item_id, spot, 'mentions_kg_entity', e FROM n UNION SELECT item_id, e, 'mentioned_in_sentence', spot FROM n),
        x AS (SELECT item_id, node, (row_number() OVER (PARTITION BY item_id ORDER BY node) - 1)::INTEGER AS number FROM (SELECT item_id, s AS node FROM e UNION SELECT item_id, o FROM e))
        SELECT e.item_id, s, relation, o, a.number AS s_number, c.number AS o_number FROM e JOIN x a ON a.item_id = e.item_id AND a.node = s JOIN x c ON c.item_id = e.item_id AND c.node = o""",
}
