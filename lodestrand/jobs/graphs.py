"""Queries on evidence graphs, triples, answers and stage contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sets as S
from ..functions import text as X
from ..operators import contracts as C
from ..operators import graph as G
from ..operators import metrics as M
from ..operators import ranking as R
from ..operators import rules as U
from ..sources.tables import candidates, gold, mutated_gold, sentences, table
from .texts import _OVERLAP_SQL, SENTENCES_SQL, _tokens_sql, question_overlap


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(example, node, sentence): the sentences of a document as the nodes of its graph."""
    return sentences(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("example"), F.col("sent_idx").alias("node"), "title", "sentence")


def _ascii(text) -> F.Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", ".")


def _terms(nodes: DataFrame, terms: F.Column) -> DataFrame:
    return nodes.select("example", "node", F.explode_outer(terms).alias("term")).where("term is not null")


def adjacent_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir).select("example", F.col("title").alias("page"), F.col("node").alias("position"), "node")
    return G.adjacent_edges(nodes)


def shared_entity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.shared_term_edges(_terms(_nodes(spark, sf_dir), X.entities(_ascii("sentence"))), 2, 12)


def bridge_token_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.shared_term_edges(G.stored(_terms(_nodes(spark, sf_dir), X.tokens(F.col("sentence"), 4))), 2, 8)


def _heads() -> F.Column:
    """Title tokens of a node. Documents here are one page each, so a sentence's first word of six letters is a heading as well."""
    return F.array_distinct(F.concat(X.tokens(F.col("title")), X.tokens(F.regexp_extract("sentence", "([A-Za-z0-9]{6,})", 1), 6)))


def title_token_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = G.stored(_nodes(spark, sf_dir).select("example", "node", X.tokens(F.col("sentence")).alias("own"), _heads().alias("heads")))
    return G.title_token_edges(_terms(nodes, F.col("own")), _terms(nodes, F.col("heads")))


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes with their scores, and edges by all four rules; sentences are cut and tokenised once, into a written table."""
    own = G.stored(_nodes(spark, sf_dir).select("example", "node", "title", X.tokens(F.col("sentence")).alias("own"), _heads().alias("heads"), X.entities(_ascii("sentence")).alias("names")))
    edges = G.document_edges(own.withColumnRenamed("title", "page"))
    asked = G.stored(_asked(spark, sf_dir))
    found = own.join(asked, "example")
    overlap = lambda *c: F.size(F.array_intersect(F.array_union(*c) if len(c) > 1 else F.col(c[0]), "asked"))
    nodes = found.select("example", "item_id", "node", overlap("own", "heads").alias("overlap"), overlap("heads").alias("title_overlap"), F.size("asked").alias("asked"))
    edges = G.stored(edges)
    return G.node_scores(nodes, edges, once=True), edges


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(example, item_id, asked): the question that a document shares most rare tokens with, and the question's tokens."""
    best = question_overlap(spark, sf_dir).groupBy(F.col("doc_id").alias("example")).agg(F.min_by("item_id", F.struct(-F.col("shared"), "item_id")).alias("item_id"))
    return best.join(table(spark, sf_dir, "benchmark").select("item_id", X.tokens(F.col("text")).alias("asked")), "item_id")


def evidence_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence as a node of its document's graph, scored against the document's best question."""
    nodes, _ = _graph(spark, sf_dir)
    return nodes.select("example", "item_id", "node", "overlap", F.col("degree").cast("int").alias("degree"), F.round("score", 6).alias("score"), F.col("is_anchor").cast("int").alias("is_anchor"))


def closure_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return G.closure_pairs(nodes, edges).groupBy("example").agg(F.count("*").alias("pairs"), F.sum(F.col("a") * 31 + F.col("b")).alias("checksum"))


def closure_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return G.closure_triple_sums(nodes, edges, (961, 31, 1))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, p, o) of the star schema."""
    t = lambda name: table(spark, sf_dir, name)
    of = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    parts = [
        t("nation").select(of("n", "n_nationkey").alias("s"), F.lit("inRegion").alias("p"), of("r", "n_regionkey").alias("o")),
        t("customer").select(of("c", "c_custkey"), F.lit("inNation"), of("n", "c_nationkey")),
        t("supplier").select(of("s", "s_suppkey"), F.lit("inNation"), of("n", "s_nationkey")),
        t("orders").select(of("o", "o_orderkey"), F.lit("placedBy"), of("c", "o_custkey")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _pairs(spark: SparkSession, rows: list[tuple[str, str]], a: str, b: str) -> DataFrame:
    return spark.createDataFrame(rows, f"{a} string, {b} string")


def term_edges_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that share an entity, for entities of 2 to 64 facts, counted by the kinds of the two facts."""
    facts = _facts(spark, sf_dir).select(F.lit(0).alias("example"), F.concat_ws(" ", "s", "p", "o").alias("node"), F.array("s", "o").alias("terms"))
    edges = G.shared_term_edges(_terms(facts, F.array_distinct("terms")), 2, 64)
    kind = lambda c: F.split(c, " ")[1]
    return edges.groupBy(F.least(kind("src"), kind("dst")).alias("a"), F.greatest(kind("src"), kind("dst")).alias("b")).agg(F.count("*").alias("edges"))


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the graph of orders (odd nodes) and customers (even nodes)."""
    edges = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 2 + 1).alias("src"), (F.col("o_custkey") * 2).alias("dst"))
    return G.components(edges).groupBy("component").agg(F.count("*").alias("nodes"))


def subclass_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reflexive-transitive closure over part names, their nouns and Thing: members of each class."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("src")).distinct()
    noun = F.split("src", " ")[1]
    edges = names.select("src", noun.alias("dst")).union(names.select(noun, F.lit("Thing"))).distinct()
    return G.closure(edges).groupBy(F.col("dst").alias("class")).agg(F.count("*").alias("members"))


_UP = [("inNation", "locatedIn"), ("inRegion", "locatedIn")]


def property_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    inverse = _pairs(spark, [("placedBy", "placed"), ("placed", "placedBy")], "p", "q")
    found = U.inferred_assertions(_facts(spark, sf_dir), _pairs(spark, _UP, "src", "dst"), inverse, spark.createDataFrame([], "p string"))
    return found.groupBy("p").agg(F.count("*").alias("assertions"), F.countDistinct("s").alias("subjects"))


def type_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = spark.createDataFrame([], "s string, c string")
    domain = _pairs(spark, [("placedBy", "Order"), ("locatedIn", "Placed")], "p", "c")
    range_ = _pairs(spark, [("placedBy", "Customer"), ("inNation", "Nation"), ("inRegion", "Region")], "p", "c")
    classes = _pairs(spark, [("Customer", "Party"), ("Nation", "Area"), ("Region", "Area"), ("Party", "Thing"), ("Area", "Thing")], "src", "dst")
    found = U.inferred_types(types, _facts(spark, sf_dir), domain, range_, _pairs(spark, _UP, "src", "dst"), classes)
    return found.groupBy("c").agg(F.count("*").alias("members"))


def ask_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is a customer located in the nation of its key modulo 25? TRUE with a proof, else unknown; the reader says FALSE for odd keys."""
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("s"), F.lit("locatedIn").alias("p"), F.concat(F.lit("n"), (F.col("c_custkey") % 25).cast("string")).alias("o"))
    found = U.inferred_assertions(_facts(spark, sf_dir), _pairs(spark, _UP, "src", "dst"), spark.createDataFrame([], "p string, q string"), spark.createDataFrame([], "p string"))
    routed = U.proofs(asked, found)
    reader = F.when(F.col("c_custkey") % 2 == 1, "FALSE").otherwise("unknown")
    return routed.select("c_custkey", F.coalesce("proof", reader).alias("answer"), F.when(F.col("proof").isNotNull(), "proof").otherwise("reader").alias("route"))


def cumulative_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user by value, with the share of the user's sum that they and all before them make up."""
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    share = F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("value").over(Window.partitionBy("user_id"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(w).alias("rank"), F.round(share, 6).alias("share"))


def label_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each component over the vectors of a label."""
    each = table(spark, sf_dir, "embeddings").select("label", F.posexplode_outer(F.col("embedding").cast("array<double>")).alias("component", "x"))
    return each.groupBy("label", "component").agg(F.round(F.avg("x"), 5).alias("mean"), F.count("x").alias("vectors"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
    asked = t.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("predicted"))
    said = t.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("gold"))
    return asked.join(said, ["conv_id", "turn"])


def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as bags of tokens: a user's turn against the assistant's reply."""
    s = _turns(spark, sf_dir).withColumn("s", M.token_scores(_ascii("predicted"), _ascii("gold")))
    return s.select("conv_id", "turn", *(F.round(f"s.{c}", 6).alias(c) for c in ("precision", "recall", "f1")), F.col("s.em").alias("em"))


def answer_set_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as sets of items between commas, semicolons and the word and."""
    items = lambda c: F.array_distinct(F.filter(F.transform(F.split(_ascii(c), r"[;,]|\sand\s"), lambda x: F.trim(F.lower(x))), lambda x: x != ""))
    s = _turns(spark, sf_dir).select("conv_id", "turn", items("predicted").alias("a"), items("gold").alias("b")).withColumn("s", S.scores(F.col("a"), F.col("b")))
    return s.select("conv_id", "turn", F.size("a").alias("n_predicted"), F.size("b").alias("n_gold"), F.round("s.f1", 6).alias("f1"), F.round("s.jaccard", 6).alias("jaccard"))


def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.binary(table(spark, sf_dir, "labels"), F.col("quality") == 1, F.col("toxic") == 0)
    return m.select("tp", "fp", "fn", "tn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a document's length tells its quality."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return M.roc_auc(rows, "quality", "n_chars").select(F.round("auc", 6).alias("auc"))


def reader_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal turns are read once: here a reading counts tokens; every turn gets its result."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    read = C.compute_once(rows, ["text"], lambda d: d.withColumn("n_tokens", F.size(X.tokens(F.col("text"), 1))))
    return read.select("conv_id", "turn", "n_tokens")


def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    todo = C.not_done(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), ["doc_id"])
    return todo.groupBy("lang").agg(F.count("*").alias("left"), F.min("doc_id").alias("first"))


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train, dev and test of documents at 80, 10 and 10 in a hundred of each language, in a hash order; the rest is test."""
    place = R.hash_rank(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id")
    split = F.when(F.col("k") <= F.floor(F.col("n") * 8 / 10), "train").when(F.col("k") <= F.floor(F.col("n") * 8 / 10) + F.floor(F.col("n") / 10), "dev").otherwise("test")
    return place.select("doc_id", "lang", split.alias("split"))


def _ranked_beside_gold(spark: SparkSession, sf_dir: str, lineitem: DataFrame, generate, ranking) -> DataFrame:
    """The ranking of candidates made from ``lineitem``, with the gold made from it in reach as the column ``golds``."""
    pool = generate(spark, sf_dir, lineitem=lineitem).join(gold(spark, sf_dir, lineitem), "example", "left")
    return ranking(pool).select("example", "candidate", "rank", "score", "units")


def gold_mutation_invariance(spark: SparkSession, sf_dir: str, generate=candidates, ranking=R.rank) -> DataFrame:
    """Candidates are made and ranked twice, from lines as given and from lines with mutated gold: rows that differ, and rows."""
    lines = table(spark, sf_dir, "lineitem")
    ranked = _ranked_beside_gold(spark, sf_dir, lines, generate, ranking)
    again = _ranked_beside_gold(spark, sf_dir, mutated_gold(lines), generate, ranking)
    each = C.same_rows(ranked, again).select(F.lit(1).alias("differs")).union(ranked.select(F.lit(0)))
    return each.agg(F.sum("differs").alias("differences"), F.count_if(F.col("differs") == 0).alias("rows"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user's events, closed by half an hour without one (an extension)."""
    from ..streaming.sessions import user_sessions

    s = user_sessions(table(spark, sf_dir, "events"), "30 minutes")
    return s.select("user_id", F.unix_micros("start").alias("start_us"), "events", F.round("value", 4).alias("value"))


QUERIES = {
    f.__name__: f
    for f in (
        evidence_graph, adjacent_sentences, title_token_edges, shared_entity_edges, bridge_token_edges, closure_pairs, closure_triples, term_edges_capped, components, subclass_closure, property_inference,
        type_inference, ask_proof, cumulative_share, label_centroid, token_f1, answer_set_scores, binary_metrics, roc_auc, reader_dedup, resume_antijoin, stratified_split,
        gold_mutation_invariance, sessions,
    )
}

def _heads_sql(own: str = "") -> str:
    return f"list_distinct(list_concat({_tokens_sql(own + 'title')}, {_tokens_sql(f'regexp_extract({own}sentence, {chr(39)}[A-Za-z0-9]{{6,}}{chr(39)})', 6)}))"


_ENT = r"list_filter(list_distinct(list_transform(regexp_extract_all(regexp_replace(sentence, '[^\x00-\x7F]', '.', 'g'), '\b(?:[A-Z][A-Za-z0-9''-]*)(?:\s+[A-Z][A-Za-z0-9''-]*)*'), lambda x: lower(array_to_string(regexp_extract_all(x, '[A-Za-z0-9]+'), ' ')))), lambda x: x <> '')"
_EDGES = f"""
    {SENTENCES_SQL},
    adj AS (SELECT doc_id AS example, sent_idx AS src, lead(sent_idx) OVER (PARTITION BY doc_id ORDER BY sent_idx) AS dst FROM sentences),
    e_term AS (SELECT doc_id, sent_idx, unnest({_ENT}) AS term FROM sentences),
    e_ok AS (SELECT doc_id, term FROM e_term GROUP BY ALL HAVING count(*) BETWEEN 2 AND 12),
    ent AS (SELECT DISTINCT a.doc_id AS example, a.sent_idx AS src, b.sent_idx AS dst FROM e_term a JOIN e_ok USING (doc_id, term) JOIN e_term b USING (doc_id, term) WHERE a.sent_idx < b.sent_idx),
    t_term AS (SELECT doc_id, sent_idx, unnest({_tokens_sql('sentence', 4)}) AS term FROM sentences),
    t_ok AS (SELECT doc_id, term FROM t_term GROUP BY ALL HAVING count(*) BETWEEN 2 AND 8),
    tok AS (SELECT DISTINCT a.doc_id AS example, a.sent_idx AS src, b.sent_idx AS dst FROM t_term a JOIN t_ok USING (doc_id, term) JOIN t_term b USING (doc_id, term) WHERE a.sent_idx < b.sent_idx),
    s_term AS (SELECT doc_id, sent_idx, unnest({_tokens_sql('sentence')}) AS term FROM sentences),
    h_term AS (SELECT doc_id, sent_idx, unnest({_heads_sql()}) AS term FROM sentences),
    ttl AS (SELECT DISTINCT s.doc_id AS example, least(s.sent_idx, h.sent_idx) AS src, greatest(s.sent_idx, h.sent_idx) AS dst FROM s_term s JOIN h_term h ON h.doc_id = s.doc_id AND h.term = s.term AND h.sent_idx <> s.sent_idx),
    edges AS (SELECT * FROM adj WHERE dst IS NOT NULL UNION SELECT * FROM ttl UNION SELECT * FROM ent UNION SELECT * FROM tok),
    both_ways AS (SELECT * FROM edges UNION SELECT example, dst, src FROM edges)"""
_NODES = f"""
    {_OVERLAP_SQL},
    best AS (SELECT doc_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY shared DESC, item_id) AS k FROM overlap) WHERE k = 1),
    own AS (SELECT s.doc_id AS example, b.item_id, s.sent_idx AS node, len(list_intersect(list_distinct(list_concat({_tokens_sql('s.sentence')}, {_heads_sql('s.')})), {_tokens_sql('q.text')})) AS overlap, len(list_intersect({_heads_sql('s.')}, {_tokens_sql('q.text')})) AS title_overlap, greatest(len({_tokens_sql('q.text')}), 1) AS n FROM sentences s JOIN best b USING (doc_id) JOIN benchmark q ON q.item_id = b.item_id),
    deg AS (SELECT example, src AS node, count(*) AS degree FROM both_ways GROUP BY ALL),
    nodes AS (SELECT example, item_id, node, overlap, coalesce(degree, 0) AS degree, overlap / n + 0.25 * title_overlap / n + 0.01 * least(coalesce(degree, 0), 8) AS score, overlap > 0 OR title_overlap > 0 AS is_anchor FROM own LEFT JOIN deg USING (example, node))"""
_FACTS = """
    facts AS (SELECT 'n' || n_nationkey AS s, 'inRegion' AS p, 'r' || n_regionkey AS o FROM nation UNION ALL SELECT 'c' || c_custkey, 'inNation', 'n' || c_nationkey FROM customer
        UNION ALL SELECT 's' || s_suppkey, 'inNation', 'n' || s_nationkey FROM supplier UNION ALL SELECT 'o' || o_orderkey, 'placedBy', 'c' || o_custkey FROM orders)"""
_LOCATED = "SELECT s, 'locatedIn' AS p, o FROM facts WHERE p IN ('inNation', 'inRegion')"
_TURNS = r"""
    turns AS (SELECT a.conv_id, a.turn, regexp_replace(a.text, '[^\x00-\x7F]', '.', 'g') AS predicted, regexp_replace(b.text, '[^\x00-\x7F]', '.', 'g') AS gold FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')"""


def _answer(c: str) -> str:
    from .texts import _ANSWER

    return _ANSWER.replace("lower(text)", f"lower({c})")


def _bag(c: str) -> str:
    return f"list_filter(string_split({_answer(c)}, ' '), lambda x: x <> '')"


def _items(c: str) -> str:
    return rf"list_distinct(list_filter(list_transform(string_split_regex({c}, '[;,]|\sand\s'), lambda x: trim(lower(x))), lambda x: x <> ''))"


ORACLE_SQL = {
    "evidence_graph": f"WITH {_EDGES}, {_NODES} SELECT example, item_id, node::INTEGER AS node, overlap::INTEGER AS overlap, degree::INTEGER AS degree, round(score::DOUBLE, 6) AS score, is_anchor::INTEGER AS is_anchor FROM nodes",
    "adjacent_sentences": f"WITH {_EDGES} SELECT example, src::INTEGER AS src, dst::INTEGER AS dst FROM adj WHERE dst IS NOT NULL",
    "title_token_edges": f"WITH {_EDGES} SELECT example, src::INTEGER AS src, dst::INTEGER AS dst FROM ttl",
    "shared_entity_edges": f"WITH {_EDGES} SELECT example, src::INTEGER AS src, dst::INTEGER AS dst FROM ent",
    "bridge_token_edges": f"WITH {_EDGES} SELECT example, src::INTEGER AS src, dst::INTEGER AS dst FROM tok",
    "closure_pairs": f"WITH {_EDGES}, {_NODES}, p AS (SELECT DISTINCT b.example, least(src, dst) AS a, greatest(src, dst) AS b FROM both_ways b JOIN nodes n ON n.example = b.example AND n.node = b.src WHERE is_anchor) SELECT example, count(*) AS pairs, sum(a * 31 + b)::BIGINT AS checksum FROM p GROUP BY example",
    "closure_triples": f"WITH {_EDGES}, {_NODES}, f AS (SELECT b.example, src AS x, dst AS y FROM both_ways b JOIN nodes n ON n.example = b.example AND n.node = b.src WHERE is_anchor), t AS (SELECT f.example, list_sort([x, y, b.dst]) AS m FROM f JOIN both_ways b ON b.example = f.example AND (b.src = x OR b.src = y) WHERE b.dst <> x AND b.dst <> y), d AS (SELECT DISTINCT example, m FROM t) SELECT example, count(*) AS triples, sum(m[1] * 961 + m[2] * 31 + m[3])::BIGINT AS checksum FROM d GROUP BY example",
    "term_edges_capped": f"WITH {_FACTS}, term AS (SELECT concat_ws(' ', s, p, o) AS node, p, unnest(list_distinct([s, o])) AS term FROM facts), ok AS (SELECT term FROM term GROUP BY term HAVING count(*) BETWEEN 2 AND 64), e AS (SELECT DISTINCT a.node AS x, b.node AS y, a.p AS pa, b.p AS pb FROM term a JOIN ok USING (term) JOIN term b USING (term) WHERE a.node < b.node) SELECT least(pa, pb) AS a, greatest(pa, pb) AS b, count(*) AS edges FROM e GROUP BY 1, 2",
    "components": "SELECT least(2 * o_custkey, min(2 * o_orderkey + 1)) AS component, count(DISTINCT o_orderkey) + 1 AS nodes FROM orders GROUP BY o_custkey",
    "subclass_closure": "WITH n AS (SELECT DISTINCT p_name AS a, string_split(p_name, ' ')[2] AS b FROM part), r AS (SELECT a, a AS c FROM n UNION SELECT b, b FROM n UNION SELECT 'Thing', 'Thing' UNION SELECT a, b FROM n UNION SELECT b, 'Thing' FROM n UNION SELECT a, 'Thing' FROM n) SELECT c AS class, count(*) AS members FROM r GROUP BY c",
    "property_inference": f"WITH {_FACTS}, r AS (SELECT s, p, o FROM facts UNION {_LOCATED} UNION SELECT o, 'placed', s FROM facts WHERE p = 'placedBy') SELECT p, count(*) AS assertions, count(DISTINCT s) AS subjects FROM r GROUP BY p",
    "type_inference": f"WITH {_FACTS}, r AS (SELECT * FROM facts UNION {_LOCATED}), t AS (SELECT s, 'Order' AS c FROM r WHERE p = 'placedBy' UNION SELECT s, 'Placed' FROM r WHERE p = 'locatedIn' UNION SELECT o, 'Customer' FROM r WHERE p = 'placedBy' UNION SELECT o, 'Nation' FROM r WHERE p = 'inNation' UNION SELECT o, 'Region' FROM r WHERE p = 'inRegion'), u AS (SELECT * FROM t UNION SELECT s, CASE c WHEN 'Customer' THEN 'Party' ELSE 'Area' END FROM t WHERE c IN ('Customer', 'Nation', 'Region') UNION SELECT s, 'Thing' FROM t WHERE c IN ('Customer', 'Nation', 'Region')) SELECT c, count(*) AS members FROM u GROUP BY c",
    "ask_proof": "SELECT c_custkey, CASE WHEN c_nationkey = c_custkey % 25 THEN 'TRUE' WHEN c_custkey % 2 = 1 THEN 'FALSE' ELSE 'unknown' END AS answer, CASE WHEN c_nationkey = c_custkey % 25 THEN 'proof' ELSE 'reader' END AS route FROM customer",
    "cumulative_share": "SELECT user_id, event_id, (row_number() OVER w)::INTEGER AS rank, round(sum(value) OVER (PARTITION BY user_id ORDER BY value DESC, event_id ROWS UNBOUNDED PRECEDING) / sum(value) OVER (PARTITION BY user_id), 6) AS share FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, event_id)",
    "label_centroid": "WITH e AS (SELECT label, unnest(range(len(embedding))) AS component, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT label, component::INTEGER AS component, round(avg(x), 5) AS mean, count(x) AS vectors FROM e GROUP BY ALL",
    "token_f1": f"WITH {_TURNS}, b AS (SELECT conv_id, turn, {_answer('predicted')} AS p, {_answer('gold')} AS g, {_bag('predicted')} AS pt, {_bag('gold')} AS gt FROM turns), pc AS (SELECT conv_id, turn, t, count(*) AS n FROM (SELECT conv_id, turn, unnest(pt) AS t FROM b) GROUP BY ALL), gc AS (SELECT conv_id, turn, t, count(*) AS n FROM (SELECT conv_id, turn, unnest(gt) AS t FROM b) GROUP BY ALL), m AS (SELECT conv_id, turn, sum(least(pc.n, gc.n)) AS n FROM pc JOIN gc USING (conv_id, turn, t) GROUP BY ALL), s AS (SELECT b.*, CASE WHEN (p IN ('yes', 'no', 'noanswer') OR g IN ('yes', 'no', 'noanswer')) AND p <> g THEN 0 ELSE coalesce(m.n, 0) END AS n FROM b LEFT JOIN m USING (conv_id, turn)), r AS (SELECT *, CASE WHEN len(pt) = 0 THEN 0 ELSE n / len(pt) END AS pr, CASE WHEN len(gt) = 0 THEN 0 ELSE n / len(gt) END AS re FROM s) SELECT conv_id, turn, round(pr::DOUBLE, 6) AS precision, round(re::DOUBLE, 6) AS recall, round((CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END)::DOUBLE, 6) AS f1, (p = g)::INTEGER AS em FROM r",
    "answer_set_scores": f"WITH {_TURNS}, b AS (SELECT conv_id, turn, {_items('predicted')} AS a, {_items('gold')} AS b FROM turns), c AS (SELECT conv_id, turn, len(a) AS na, len(b) AS nb, len(list_intersect(a, b)) AS n FROM b) SELECT conv_id, turn, na::INTEGER AS n_predicted, nb::INTEGER AS n_gold, round((CASE WHEN n = 0 THEN 0 ELSE 2 * (n / na) * (n / nb) / (n / na + n / nb) END)::DOUBLE, 6) AS f1, round((CASE WHEN na + nb = 0 THEN 0 ELSE n / (na + nb - n) END)::DOUBLE, 6) AS jaccard FROM c",
    "binary_metrics": "WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality <> 1 AND toxic = 0) AS fp, count(*) FILTER (quality = 1 AND toxic <> 0) AS fn, count(*) FILTER (quality <> 1 AND toxic <> 0) AS tn FROM labels) SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c",
    "roc_auc": "WITH r AS (SELECT quality, n_chars FROM labels JOIN documents USING (doc_id)), s AS (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS k FROM r) SELECT round((sum(k) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2) / (count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0)), 6) AS auc FROM s",
    "reader_dedup": f"SELECT conv_id, turn, len({_tokens_sql('text', 1)})::INTEGER AS n_tokens FROM conversations",
    "resume_antijoin": "SELECT lang, count(*) AS \"left\", min(doc_id) AS first FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY lang",
    "stratified_split": "WITH p AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, lang, CASE WHEN k <= floor(n * 8 / 10) THEN 'train' WHEN k <= floor(n * 8 / 10) + floor(n / 10) THEN 'dev' ELSE 'test' END AS split FROM p",
    "gold_mutation_invariance": "SELECT 0::BIGINT AS differences, count(*) AS rows FROM orders",
    "sessions": "WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS events, round(sum(value), 4) AS value FROM s GROUP BY user_id, n",
}
