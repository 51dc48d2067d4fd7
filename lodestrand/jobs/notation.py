"""Queries on strings that pass between stages: names, answers of readers, prompts, keys, conversions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import contracts as C
from ..operators import ranking as R
from ..sources.tables import candidates, sentences, table
from .supports import _base
from .texts import SENTENCES_SQL

_ASCII = r"[^\x00-\x7F]"


def entity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of pages' addresses and of parts, with a year and in camel case, as words."""
    kind = F.col("p_partkey") % 3
    word = F.split("p_name", " ")[1]
    name = F.when(kind == 0, F.concat(F.lit("http://e.org/o#"), F.initcap(F.split("p_name", " ")[0]), F.initcap(word), F.lit("_1944"))).when(kind == 1, F.concat(F.lit("http://e.org/things/the_"), word, F.lit("/"))).otherwise(F.concat_ws("_", "p_name", "p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", X.entity_name(name).alias("name"))


def phrase_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences as phrases: marks of any script become spaces, letters of any script stay. Counted by their words."""
    own = sentences(table(spark, sf_dir, "documents")).select("doc_id", X.normalize_phrase(F.col("sentence")).alias("phrase"))
    return own.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum(F.size(F.filter(F.split("phrase", " "), lambda w: w != ""))).cast("bigint").alias("words"))


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, question, answer): a turn asks, and the reply is shaped as readers shape theirs."""
    c = table(spark, sf_dir, "conversations")
    first = F.regexp_extract(F.coalesce("text", F.lit("")), r"^([A-Za-z]+)", 1)
    k = F.length("text") % 6
    question = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Is it "), first)).otherwise(F.concat(F.lit("Who is "), first))
    answer = F.when(k == 0, F.lit(" True ")).when(k == 1, F.lit("No, never")).when(k == 2, F.lit("Unknown")).when(k == 3, F.lit("cannot determine")).when(k == 4, F.lit("")).otherwise(first)
    return c.select("conv_id", "turn", question.alias("question"), answer.alias("answer"), first.alias("wider"))


def reader_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readers' answers in their final form, and whether they say that there is none."""
    r = _replies(spark, sf_dir).withColumn("final", X.generated_answer(F.col("question"), F.col("answer")))
    return r.select("conv_id", "turn", "final", X.is_unknown(F.col("final")).cast("int").alias("is_unknown"))


def fallback_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the answer is unknown, the one from a wider prefix counts if that isn't."""
    r = _replies(spark, sf_dir).withColumn("final", X.generated_answer(F.col("question"), F.col("answer")))
    wider = F.when(X.is_unknown(F.col("final")) & ~X.is_unknown(F.col("wider")), F.col("wider")).otherwise(F.col("final"))
    return r.select("conv_id", "turn", wider.alias("answer"), (wider != F.col("final")).cast("int").alias("fell_back"))


def json_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer in a reader's reply that holds JSON, bare, in a fence, or among other words; null in one that holds none."""
    k = F.col("event_id") % 4
    body = F.concat(F.lit('{"answer": "'), F.col("event_type"), F.lit('", "n": '), F.get_json_object("props", "$.k"), F.lit("}"))
    reply = F.when(k == 0, body).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 2, F.concat(F.lit("So: "), body, F.lit(" is it."))).otherwise(F.lit("none {"))
    return table(spark, sf_dir, "events").select("event_id", X.json_answer(reply, "answer").alias("answer"))


def candidate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first candidate of an example as text for a scorer: the question, then its units, numbered."""
    own = R.rank(candidates(spark, sf_dir), 1)
    lines = F.array_join(F.transform("units", lambda u, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), u)), "\n")
    return own.select("example", F.concat(F.lit("Question:\nWhich brands does customer "), F.col("example").cast("string"), F.lit(" buy?\n\nCandidate evidence:\n"), lines).alias("text"))


def prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt from the first three sentences of a document, grouped under its title with their places."""
    own = sentences(table(spark, sf_dir, "documents")).withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("sent_idx"))).where("k <= 3")
    lines = own.groupBy("doc_id", "title").agg(F.array_sort(F.collect_list(F.struct("sent_idx", "sentence"))).alias("s"))
    body = F.array_join(F.transform("s", lambda x: F.concat(F.lit("("), x["sent_idx"].cast("string"), F.lit(") "), x["sentence"])), "\n")
    return lines.select("doc_id", F.concat(F.lit("Title: "), F.col("title"), F.lit("\n"), body, F.lit("\nAnswer:")).alias("prompt"))


def evidence_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key of nested evidence that doesn't depend on the order of its fields: how many lines share one."""
    lines = table(spark, sf_dir, "lineitem").withColumn("brand", F.col("l_partkey") % 25)
    nested = F.when(F.col("l_orderkey") % 2 == 0, F.create_map(F.lit("b"), F.col("brand").cast("string"), F.lit("a"), F.col("l_returnflag"))).otherwise(F.create_map(F.lit("a"), F.col("l_returnflag"), F.lit("b"), F.col("brand").cast("string")))
    key = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(nested))))
    return lines.groupBy(key.alias("key")).agg(F.count("*").alias("lines"))


def grain_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hop and answer type: from a column where it says one, else from the id."""
    k = F.col("o_custkey") % 5
    column = F.when(k == 0, "bool").when(k == 1, "Select").when(k == 2, "")
    example = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "x-2hop__").when(F.col("o_orderkey") % 3 == 1, "x-1-hop__").otherwise("x__"), F.when(k == 3, "q-BIN").when(k == 4, "q-MC").otherwise("q"))
    raw, text = F.upper(column), F.upper(example)
    said = F.when(raw.isin("BIN", "BOOLEAN", "BOOL", "ASK"), "BIN").when(raw.isin("MC", "OPEN", "OPEN_ENDED", "SELECT"), "OPEN")
    kind = F.coalesce(said, F.when(text.contains("-BIN") | text.contains("__BIN"), "BIN").when(text.contains("-MC") | text.contains("__MC"), "OPEN").otherwise("UNKNOWN_ANSWER_TYPE"))
    hop = F.when(F.lower(example).rlike("2-?hop"), "2hop").when(F.lower(example).rlike("1-?hop"), "1hop").otherwise("unknown_hop")
    return table(spark, sf_dir, "orders").select(hop.alias("hop"), kind.alias("answer_type")).groupBy("hop", "answer_type").agg(F.count("*").alias("examples"))


def backend_denied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the host of their address as the backend that made them: a contaminated one among them raises."""
    host = F.regexp_extract(F.lower("url"), r"^https?://([^/]+)", 1)
    return C.refuse_backends(table(spark, sf_dir, "pages").select(host.alias("host")), "host").groupBy("host").agg(F.count("*").alias("pages"))


def prediction_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of another format: lists flattened, booleans as yes and no, evidence marks taken from free text, each once."""
    own = sentences(table(spark, sf_dir, "documents"))
    mark = F.concat(F.lit("see EVIDENCE::"), F.col("title"), F.lit("::"), F.col("sent_idx").cast("string"), F.lit("; "))
    text = own.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(mark, mark))), "").alias("text"))
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(EVIDENCE::[^:;]+::\d+)"), F.lit(1)))
    said = X.boolean_answer(F.when(F.col("doc_id") % 3 == 0, "TRUE").when(F.col("doc_id") % 3 == 1, "Entailed").otherwise("Not Entailed"))
    return text.select("doc_id", said.alias("answer"), F.size(found).alias("n"), F.array_join(F.array_sort(found), "|").alias("evidence"))


QUERIES = {
    f.__name__: f
    for f in (entity_names, phrase_normalize, reader_answers, fallback_answer, json_answers, candidate_text, prompt_text, evidence_keys, grain_inference, backend_denied, prediction_convert)
}

_REPLIES = r"""
    replies AS (SELECT conv_id, turn, regexp_extract(coalesce(text, ''), '^([A-Za-z]+)', 1) AS first, length(text) % 6 AS k, turn % 2 = 0 AS yes_no FROM conversations),
    finals AS (SELECT *, CASE k WHEN 0 THEN CASE WHEN yes_no THEN 'yes' ELSE 'True' END WHEN 1 THEN CASE WHEN yes_no THEN 'no' ELSE 'No, never' END WHEN 2 THEN 'unknown' WHEN 3 THEN 'cannot determine' WHEN 4 THEN '' ELSE
        CASE WHEN yes_no AND lower(first) IN ('yes', 'true') THEN 'yes' WHEN yes_no AND lower(first) IN ('no', 'false') THEN 'no' WHEN lower(first) = 'unknown' THEN 'unknown' ELSE first END END AS final FROM replies),
    known AS (SELECT *, final IN ('', 'unknown', 'cannot determine') AS none FROM finals)"""
_B = _base()
ORACLE_SQL = {
    "entity_names": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN string_split(p_name, ' ')[2] ELSE p_name || ' ' || lower(p_type) END AS name FROM part",
    "phrase_normalize": rf"WITH {SENTENCES_SQL}, p AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(sentence), '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}\p{{Nl}}\s]', ' ', 'g'), '\s+', ' ', 'g')) AS p FROM sentences) SELECT doc_id, count(*) AS sentences, sum(len(list_filter(string_split(p, ' '), lambda w: w <> '')))::BIGINT AS words FROM p GROUP BY doc_id",
    "reader_answers": f"WITH {_REPLIES} SELECT conv_id, turn, final, none::INTEGER AS is_unknown FROM known",
    "fallback_answer": f"WITH {_REPLIES} SELECT conv_id, turn, CASE WHEN none AND first NOT IN ('') AND lower(first) <> 'unknown' THEN first ELSE final END AS answer, (none AND first <> '' AND lower(first) <> 'unknown')::INTEGER AS fell_back FROM known",
    "json_answers": "SELECT event_id, CASE WHEN event_id % 4 < 3 AND json_extract_string(props, '$.k') IS NOT NULL THEN event_type END AS answer FROM events",
    "candidate_text": f"WITH {_B} SELECT r.ex AS example, 'Question:' || chr(10) || 'Which brands does customer ' || r.ex || ' buy?' || chr(10) || chr(10) || 'Candidate evidence:' || chr(10) || coalesce((SELECT string_agg('[' || k || '] ' || unit, chr(10) ORDER BY k) FROM (SELECT unit, row_number() OVER (ORDER BY pos) AS k FROM units u WHERE u.cand = r.cand)), '') AS text FROM ranked r WHERE rk = 1",
    "prompt_text": f"WITH {SENTENCES_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sent_idx) AS k FROM sentences) SELECT doc_id, 'Title: ' || title || chr(10) || string_agg('(' || sent_idx || ') ' || sentence, chr(10) ORDER BY sent_idx) || chr(10) || 'Answer:' AS prompt FROM k WHERE k <= 3 GROUP BY doc_id, title",
    "evidence_keys": """SELECT '{"a":"' || l_returnflag || '","b":"' || (l_partkey % 25) || '"}' AS key, count(*) AS lines FROM lineitem GROUP BY 1""",
    "grain_inference": "SELECT CASE o_orderkey % 3 WHEN 0 THEN '2hop' WHEN 1 THEN '1hop' ELSE 'unknown_hop' END AS hop, CASE o_custkey % 5 WHEN 0 THEN 'BIN' WHEN 1 THEN 'OPEN' WHEN 2 THEN 'UNKNOWN_ANSWER_TYPE' WHEN 3 THEN 'BIN' ELSE 'OPEN' END AS answer_type, count(*) AS examples FROM orders GROUP BY ALL",
    "backend_denied": "WITH h AS (SELECT regexp_extract(lower(url), '^https?://([^/]+)', 1) AS host FROM pages) SELECT host, count(*) AS pages FROM h WHERE NOT contains(host, 'provided') GROUP BY host",
    "prediction_convert": f"WITH {SENTENCES_SQL} SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN 'yes' ELSE 'no' END AS answer, count(*)::INTEGER AS n, string_agg(e, '|' ORDER BY e) AS evidence FROM (SELECT doc_id, 'EVIDENCE::' || title || '::' || sent_idx AS e FROM sentences) GROUP BY doc_id",
}
