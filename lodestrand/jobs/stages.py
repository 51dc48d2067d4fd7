"""Queries on what holds between stages: splits, order of files, completeness, snapshots, exports, first and last rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import contracts as C
from ..operators import ranking as R
from ..sources.tables import candidates, gold, sentences, table
from .supports import _PREFIX, _base
from .texts import SENTENCES_SQL


def split_disjointness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of splits and the ids that are in both: sources as splits, texts as ids; an empty id is refused."""
    rows = table(spark, sf_dir, "documents").where("length(text) > 0").select(F.coalesce("source", F.lit("none")).alias("split"), F.xxhash64("text").alias("id"))
    return C.split_overlaps(rows, "split", "id")


def contiguous_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many runs of neighbouring events each user's events fall into, over the whole file in the order of its ids."""
    runs = C.runs(C.in_order(table(spark, sf_dir, "events"), "event_id"), "user_id", "event_id")
    return runs.groupBy("user_id").agg(F.count("*").alias("starts")).groupBy("starts").agg(F.count("*").alias("groups"))


def conversation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a stream of groups: each conversation must be one run, or this raises."""
    turns = C.in_order(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return C.contiguous(turns, "conv_id", "turn").select("conv_id", F.col("first").alias("first_turn"), "rows")


def last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each key wins: the last event of a user and a type."""
    e = table(spark, sf_dir, "events")
    last = e.groupBy("user_id", "event_type").agg(F.max_by(F.struct("event_id", "value"), "event_id").alias("e"), F.count("*").alias("writes"))
    return last.select("user_id", "event_type", "e.event_id", F.round("e.value", 4).alias("value"), "writes")


def first_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each id: what the first turn of a conversation says of it."""
    first = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by(F.struct("turn", "role", F.length("text").alias("chars")), "turn").alias("f"))
    return first.select("conv_id", "f.turn", "f.role", "f.chars")


def unit_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node to unit, the first mapping wins: of sentences that normalise alike in a document, the first stands for all."""
    own = sentences(table(spark, sf_dir, "documents")).withColumn("node", X.normalize_text(F.regexp_replace("sentence", r"[^\x00-\x7F]", "x"))).where("node <> ''")
    first = own.groupBy("doc_id", F.xxhash64("node").alias("key"), "node").agg(F.min_by("unit", "sent_idx").alias("unit"), F.count("*").alias("n")).where("n > 1")
    return first.select("doc_id", "unit", "n")


def identity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: candidates joined by identity to what the lines of later ship dates alone make: identities, and those that the two sides hold unlike often."""
    of = lambda lines, n: candidates(spark, sf_dir, lineitem=lines).groupBy("example", X.identity(F.col("units")).alias("identity")).agg(F.count("*").alias(n))
    lines = table(spark, sf_dir, "lineitem")
    both = of(lines, "n").join(of(lines.where(F.year("l_shipdate") > 1992), "m"), ["example", "identity"], "full")
    return both.agg(F.count("*").alias("identities"), F.count_if(~F.col("n").eqNullSafe(F.col("m"))).alias("unequal"), F.sum(F.least(F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0)))).cast("bigint").alias("shared"))


def gold_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples without gold, and gold without an example: both must be none before scores count; here the first are some."""
    frozen = candidates(spark, sf_dir).select("example").distinct()
    g = gold(spark, sf_dir).select("example")
    return C.unmatched(frozen, g, "example")


def gold_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the examples that have gold, with their candidates: a semi-join export."""
    kept = candidates(spark, sf_dir).join(gold(spark, sf_dir).select("example"), "example", "left_semi")
    return kept.select("example", "candidate", F.to_json("units").alias("units"))


def frozen_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selections are frozen with a digest before gold is opened; scores are refused for any other selection."""
    chosen = R.fixed_prefixes(candidates(spark, sf_dir), (3,)).select("example", F.array_join("units", "|").alias("units"))
    frozen = C.Frozen.of(chosen)
    return frozen.open(chosen).select("example", "units")


def snapshot_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of given tables taken twice, and of one that was changed between: which are the same."""
    each = None
    for name in ("region", "nation", "supplier"):
        before = table(spark, sf_dir, name)
        for side, rows in ((0, before), (1, before if name != "supplier" else before.where("s_suppkey <> 1"))):
            part = C.digest(rows).select(F.lit(name).alias("name"), F.lit(side).alias("side"), "rows", "digest")
            each = part if each is None else each.union(part)
    return each.groupBy("name").agg(F.min_by("rows", "side").alias("rows"), F.max_by("rows", "side").alias("rows_after"), (F.count_distinct("digest") == 1).cast("int").alias("same"))


def benchmark_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions as a benchmark wants them: for a document the distinct [title, index] pairs of its units, of three notations.

    Notations are SENT::title::index::text, EVIDENCE::title::index and title#index; units of no notation and negative
    indices are dropped.
    """
    own = sentences(table(spark, sf_dir, "documents"))
    k = F.col("sent_idx") % 4
    index = F.col("sent_idx").cast("string")
    unit = F.when(k == 0, F.col("unit")).when(k == 1, F.concat_ws("::", F.lit("EVIDENCE"), "title", index)).when(k == 2, F.concat("title", F.lit("#"), index)).otherwise(F.concat_ws("::", F.lit("EVIDENCE"), "title", F.lit("-1")))
    parsed = own.select("doc_id", X.parse_support(unit).alias("p")).where("p.sent_idx >= 0").select("doc_id", "p.title", "p.sent_idx").distinct()
    return parsed.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("title", "sent_idx"))), lambda x: F.concat(F.lit("["), x["title"], F.lit(","), x["sent_idx"].cast("string"), F.lit("]"))), "").alias("support"))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities, relations and words of the facts and axioms, each once."""
    from .graphs import _facts

    f = _facts(spark, sf_dir)
    words = f.select(F.explode(F.regexp_extract_all(F.concat_ws(" ", "s", "p", "o"), F.lit("([A-Za-z]+)"), F.lit(1))).alias("name"))
    every = f.select(F.lit("entity").alias("kind"), F.col("s").alias("name")).union(f.select(F.lit("entity"), "o")).union(f.select(F.lit("relation"), "p")).union(words.select(F.lit("word"), F.lower("name")))
    return every.distinct()


def triple_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples cleaned: relations by a map of synonyms, loops gone, of those that differ in case alone the first."""
    from .graphs import _facts

    f = _facts(spark, sf_dir).where("p <> 'placedBy'")
    shouted = f.select(F.upper("s").alias("s"), F.concat(F.lit(" "), F.upper("p"), F.lit("  ")).alias("p"), "o", F.lit(1).alias("at"))
    loops = f.select("s", F.lit("is in").alias("p"), F.initcap("s").alias("o"), F.lit(2).alias("at"))
    return C.clean_triples(f.withColumn("at", F.lit(0)).union(shouted).union(loops), {"innation": "located in", "inregion": "located in", "is in": "located in"})


def file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, size class and hash length of two table files; names with a path in them are refused."""
    return C.manifest(spark, [f"{sf_dir}/{n}.parquet" for n in ("labels", "customer")]).select("name", F.length("sha256").alias("hash_chars"), (F.col("size") > 0).cast("int").alias("has_bytes"))


QUERIES = {
    f.__name__: f
    for f in (
        split_disjointness, contiguous_groups, conversation_groups, last_write, first_row, unit_map, identity_join, gold_completeness, gold_subset, frozen_selection, snapshot_compare, benchmark_export, vocabulary, triple_dedupe, file_manifest,
    )
}

_B = _base()
ORACLE_SQL = {
    "split_disjointness": "WITH r AS (SELECT DISTINCT coalesce(source, 'none') AS split, text FROM documents WHERE length(text) > 0) SELECT a.split AS a, b.split AS b, count(*) AS shared FROM r a JOIN r b USING (text) WHERE a.split < b.split GROUP BY ALL",
    "contiguous_groups": "WITH e AS (SELECT event_id, user_id, lag(user_id) OVER (ORDER BY event_id) AS before FROM events), s AS (SELECT user_id, count(*) FILTER (before IS DISTINCT FROM user_id) AS starts FROM e GROUP BY ALL) SELECT starts, count(*) AS groups FROM s GROUP BY starts",
    "conversation_groups": "SELECT conv_id, min(turn) AS first_turn, count(*) AS rows FROM conversations GROUP BY conv_id",
    "last_write": "SELECT user_id, event_type, max(event_id) AS event_id, round(arg_max(value, event_id), 4) AS value, count(*) AS writes FROM events GROUP BY user_id, event_type",
    "first_row": "SELECT conv_id, turn, role, length(text)::INTEGER AS chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k = 1",
    "unit_map": rf"WITH {SENTENCES_SQL}, n AS (SELECT doc_id, sent_idx, concat_ws('::', 'SENT', title, sent_idx::VARCHAR, sentence) AS unit, trim(regexp_replace(regexp_replace(lower(regexp_replace(sentence, '[^\x00-\x7F]', 'x', 'g')), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+', ' ', 'g')) AS node FROM sentences) SELECT doc_id, arg_min(unit, sent_idx) AS unit, count(*) AS n FROM n WHERE node <> '' GROUP BY doc_id, node HAVING count(*) > 1",
    "identity_join": """WITH l AS (SELECT l_orderkey, p_brand AS unit, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate FROM lineitem JOIN part ON p_partkey = l_partkey),
        one AS (SELECT l_orderkey, unit, min((l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS pos FROM l GROUP BY ALL), two AS (SELECT l_orderkey, unit, min((l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS pos FROM l WHERE year(l_shipdate) > 1992 GROUP BY ALL),
        a AS (SELECT ex, us, count(*) AS n FROM (SELECT o_custkey AS ex, o_orderkey, coalesce(string_agg(unit, '|' ORDER BY pos), '') AS us FROM orders LEFT JOIN one ON l_orderkey = o_orderkey GROUP BY ALL) GROUP BY ALL),
        b AS (SELECT ex, us, count(*) AS m FROM (SELECT o_custkey AS ex, o_orderkey, coalesce(string_agg(unit, '|' ORDER BY pos), '') AS us FROM orders LEFT JOIN two ON l_orderkey = o_orderkey GROUP BY ALL) GROUP BY ALL)
        SELECT count(*) AS identities, count(*) FILTER (n IS DISTINCT FROM m) AS unequal, sum(least(coalesce(n, 0), coalesce(m, 0)))::BIGINT AS shared FROM a FULL JOIN b USING (ex, us)""",
    "gold_completeness": f"WITH {_B}, c AS (SELECT DISTINCT ex FROM ranked), g AS (SELECT DISTINCT ex FROM golds) SELECT 'left' AS side, count(*) AS missing FROM c WHERE ex NOT IN (SELECT ex FROM g) UNION ALL SELECT 'right', count(*) FROM g WHERE ex NOT IN (SELECT ex FROM c)",
    "gold_subset": f"WITH {_B} SELECT s.ex AS example, s.cand AS candidate, coalesce((SELECT to_json(list(unit ORDER BY pos))::VARCHAR FROM units x WHERE x.cand = s.cand), '[]') AS units FROM sizes s WHERE s.ex IN (SELECT ex FROM golds)",
    "frozen_selection": f"WITH {_B}, {_PREFIX} SELECT ex AS example, coalesce(string_agg(unit, '|' ORDER BY rk, pos), '') AS units FROM prefix WHERE k = 3 GROUP BY ex",
    "snapshot_compare": "SELECT 'region' AS name, count(*) AS rows, count(*) AS rows_after, 1 AS same FROM region UNION ALL SELECT 'nation', count(*), count(*), 1 FROM nation UNION ALL SELECT 'supplier', count(*), count(*) FILTER (s_suppkey <> 1), 0 FROM supplier",
    "benchmark_export": rf"WITH {SENTENCES_SQL}, p AS (SELECT DISTINCT doc_id, title, sent_idx FROM sentences WHERE sent_idx % 4 <> 3) SELECT doc_id, string_agg('[' || title || ',' || sent_idx || ']', '' ORDER BY title, sent_idx) AS support FROM p GROUP BY doc_id",
    "vocabulary": r"WITH facts AS (SELECT 'n' || n_nationkey AS s, 'inRegion' AS p, 'r' || n_regionkey AS o FROM nation UNION ALL SELECT 'c' || c_custkey, 'inNation', 'n' || c_nationkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'inNation', 'n' || s_nationkey FROM supplier UNION ALL SELECT 'o' || o_orderkey, 'placedBy', 'c' || o_custkey FROM orders) SELECT 'entity' AS kind, s AS name FROM facts UNION SELECT 'entity', o FROM facts UNION SELECT 'relation', p FROM facts UNION SELECT 'word', lower(unnest(regexp_extract_all(s || ' ' || p || ' ' || o, '[A-Za-z]+'))) FROM facts",
    "triple_dedupe": "WITH f AS (SELECT 'n' || n_nationkey AS s, 'r' || n_regionkey AS o FROM nation UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier) SELECT s, 'located in' AS p, o FROM f",
    "file_manifest": "SELECT 'labels.parquet' AS name, 64 AS hash_chars, 1 AS has_bytes UNION ALL SELECT 'customer.parquet', 64, 1",
}
