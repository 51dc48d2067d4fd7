"""Queries on texts: normalisers, tokens, evidence units, question kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.tables import sentences, table

_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_PUNCT = r"[!-/:-@\[-`{-~]"
_NORM = rf"trim(regexp_replace(regexp_replace(lower(text), '{_PUNCT}', '', 'g'), '\s+', ' ', 'g'))"
_BOOL = f"CASE WHEN trim(lower(text)) IN ({', '.join(repr(x) for x in X.YES)}) THEN 'yes' WHEN trim(lower(text)) IN ({', '.join(repr(x) for x in X.NO)}) THEN 'no' ELSE trim(lower(text)) END"
# articles by words, as this engine's \b knows ASCII letters alone
_ANSWER = rf"array_to_string(list_filter(string_split_regex(regexp_replace({_BOOL}, '{_PUNCT}', '', 'g'), '\s+'), lambda w: w NOT IN ('a', 'an', 'the', '')), ' ')"
#: Sentences as in ``sources.tables.sentences``.
SENTENCES_SQL = r"""
    raw AS (SELECT doc_id, concat(coalesce(source, ''), '/', doc_id::VARCHAR) AS title, lang, string_split_regex(text, '[\n.]') AS parts FROM documents WHERE text IS NOT NULL),
    cut AS (SELECT doc_id, title, lang, unnest(range(len(parts))) AS sent_idx, unnest(parts) AS part FROM raw),
    sentences AS (SELECT doc_id, title, lang, sent_idx, trim(regexp_replace(part, '\s+', ' ', 'g')) AS sentence FROM cut WHERE length(trim(regexp_replace(part, '\s+', ' ', 'g'))) > 0)
"""


def _tokens_sql(text: str, least: int = 3) -> str:
    return f"list_filter(list_distinct(list_transform(list_filter(regexp_extract_all(coalesce({text}, ''), '[A-Za-z0-9]+'), lambda x: length(x) >= {least}), lambda x: lower(x))), lambda x: x NOT IN ({_STOP}))"


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.normalize_text(F.col("text")).alias("normal"))


def normalize_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.normalize_answer(F.col("text")).alias("answer"))


def tokenize_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "documents").select("doc_id", F.explode_outer(X.tokens(F.col("text"))).alias("token"))
    return tokens.where("token is not null").groupBy("token").agg(F.count("*").alias("documents"))


def capitalized_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode_outer(X.entities(F.regexp_replace("text", r"[^\x00-\x7F]", "."))).alias("entity"))
    return found.where("entity is not null").groupBy("entity").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))


def sentence_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(table(spark, sf_dir, "documents")).select("doc_id", "sent_idx", "unit")


def unit_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = sentences(table(spark, sf_dir, "documents")).withColumn("parsed", X.parse_unit(F.col("unit")))
    return parsed.groupBy("parsed.kind", "parsed.title").agg(F.count("*").alias("units"), F.max("parsed.sent_idx").alias("last_idx"), F.sum(F.length("parsed.text")).alias("chars"))


def uri_local_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.local_name(F.col("url")).alias("local_name"))


def boolean_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", X.is_boolean_question(F.col("text")).cast("int").alias("is_boolean"))


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and the size of the visible text of HTML pages."""
    bare = F.trim(F.regexp_replace(F.regexp_replace("html", r"<[^>]*>", " "), r"\s+", " "))
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"), F.length(bare).alias("visible_chars"))


def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of JSON event properties, null where they don't parse."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.count(k).alias("with_k"), F.sum(k).cast("bigint").alias("sum_k"))


def gold_free_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inference sees allowed columns alone: a table with a gold column is refused, and its projection isn't."""
    from ..operators.contracts import assert_gold_free, gold_free

    allowed = gold_free(table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id", "left"), ("doc_id", "text", "lang"))
    assert_gold_free(allowed)
    return allowed.groupBy("lang").agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars"))


#: A token that more than one document in so many holds says nothing about a question.
RARE = 5


def question_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every question, each document that shares rare tokens of 4 characters or more: how many. An inverted-index join.

    Tokens that over a fifth of the documents hold are left out, as stop words are.
    """
    own = table(spark, sf_dir, "documents")
    docs = own.select("doc_id", F.explode_outer(X.tokens(F.col("text"), 4)).alias("token")).where("token is not null")
    items = table(spark, sf_dir, "benchmark").select("item_id", F.explode_outer(X.tokens(F.col("text"), 4)).alias("token")).where("token is not null")
    asked = docs.join(items.select("token").distinct(), "token", "left_semi")
    rare = asked.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") * RARE <= own.count()).select("token")
    return asked.join(rare, "token").join(items, "token").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"))


def sentence_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 24 sentences of a document that share most tokens with its best question; ties go to the earlier one."""
    best = question_overlap(spark, sf_dir).groupBy("doc_id").agg(F.min_by("item_id", F.struct(-F.col("shared"), "item_id")).alias("item_id"))
    asked = best.join(table(spark, sf_dir, "benchmark").select("item_id", X.tokens(F.col("text")).alias("asked")), "item_id")
    pool = sentences(table(spark, sf_dir, "documents")).select("doc_id", "sent_idx", X.tokens(F.col("sentence")).alias("own")).join(asked, "doc_id")
    scored = pool.select("doc_id", "item_id", "sent_idx", F.size(F.array_intersect("own", "asked")).alias("overlap"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("overlap"), "sent_idx"))
    return scored.withColumn("place", place).where(F.col("place") <= 24)


QUERIES = {f.__name__: f for f in (normalize_text, normalize_answer, tokenize_stop, capitalized_entities, sentence_units, unit_parse, uri_local_name, boolean_questions, page_titles, json_extract, gold_free_projection, question_overlap, sentence_pool)}

_OVERLAP_SQL = f"""
    dt AS (SELECT doc_id, unnest({_tokens_sql('text', 4)}) AS token FROM documents),
    it AS (SELECT item_id, unnest({_tokens_sql('text', 4)}) AS token FROM benchmark),
    rare AS (SELECT token FROM dt GROUP BY token HAVING count(*) * {RARE} <= (SELECT count(*) FROM documents)),
    overlap AS (SELECT item_id, doc_id, count(*) AS shared FROM dt JOIN rare USING (token) JOIN it USING (token) GROUP BY ALL)
"""
ORACLE_SQL = {
    "normalize_text": f"SELECT conv_id, turn, {_NORM} AS normal FROM conversations",
    "normalize_answer": f"SELECT conv_id, turn, {_ANSWER} AS answer FROM conversations",
    "tokenize_stop": f"SELECT token, count(*) AS documents FROM (SELECT doc_id, unnest({_tokens_sql('text')}) AS token FROM documents) GROUP BY token",
    "capitalized_entities": r"""
        WITH found AS (SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', '.', 'g'), '\b(?:[A-Z][A-Za-z0-9''-]*)(?:\s+[A-Z][A-Za-z0-9''-]*)*'), lambda x: lower(array_to_string(regexp_extract_all(x, '[A-Za-z0-9]+'), ' '))))) AS entity FROM documents WHERE text IS NOT NULL)
        SELECT entity, count(*) AS documents, min(doc_id) AS first_doc FROM found WHERE entity <> '' GROUP BY entity""",
    "sentence_units": f"WITH {SENTENCES_SQL} SELECT doc_id, sent_idx::INTEGER AS sent_idx, concat_ws('::', 'SENT', title, sent_idx::VARCHAR, sentence) AS unit FROM sentences",
    "unit_parse": f"WITH {SENTENCES_SQL} SELECT 'SENT' AS kind, title, count(*) AS units, max(sent_idx)::INTEGER AS last_idx, sum(length(sentence))::BIGINT AS chars FROM sentences GROUP BY title",
    "uri_local_name": r"SELECT page_id, regexp_extract(url, '([^#/]*)/*$', 1) AS local_name FROM pages",
    "boolean_questions": rf"SELECT conv_id, turn, role, regexp_matches(lower(trim(coalesce(text, ''))), '^({'|'.join(X.AUXILIARIES)})\b')::INTEGER AS is_boolean FROM conversations",
    "page_titles": r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, length(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')))::INTEGER AS visible_chars FROM pages",
    "json_extract": "SELECT event_type, count(*) AS events, count(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS with_k, sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS sum_k FROM events GROUP BY event_type",
    "gold_free_projection": "SELECT lang, count(*) AS rows, sum(length(text))::BIGINT AS chars FROM documents GROUP BY lang",
    "question_overlap": f"WITH {_OVERLAP_SQL} SELECT item_id, doc_id, shared FROM overlap",
    "sentence_pool": f"""
        WITH {_OVERLAP_SQL}, {SENTENCES_SQL},
        best AS (SELECT doc_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY shared DESC, item_id) AS k FROM overlap) WHERE k = 1),
        scored AS (SELECT s.doc_id, b.item_id, s.sent_idx::INTEGER AS sent_idx, len(list_intersect({_tokens_sql('s.sentence')}, {_tokens_sql('q.text')}))::INTEGER AS overlap FROM sentences s JOIN best b USING (doc_id) JOIN benchmark q ON q.item_id = b.item_id)
        SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY overlap DESC, sent_idx))::INTEGER AS place FROM scored) WHERE place <= 24""",
}
