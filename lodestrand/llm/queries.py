"""The thirteen queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, embed_dedup, langid, lexical_search, license_scan, packing, quality, sharding, simhash, stock_packing, substring, token_count, whitening
from .common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = embed_dedup.embedding_groups(table(spark, sf_dir, "embeddings"))
    return groups.select("vec_id", "n_links", F.col("component").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("component")).alias("kept"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.interleave(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_field(spark: SparkSession, sf_dir: str) -> langid.Field:
    """The language field fitted on the documents that aren't held out."""
    return langid.fit_on(table(spark, sf_dir, "documents").where(~held_out()))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = langid.label_documents(docs, language_field(spark, sf_dir))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return license_scan.scan(docs, license_scan.fit_on(docs))


def op11_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stock_packing.pack(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_quality_classifier, op3_embedding_near_dedup, op4_substring_dedup, op5_best_fit_packing,
        op6_simhash_near_dedup, op7_sharding, op8_language_id, op9_token_counts, op10_license_scan,
        op11_stock_packing, op12_embedding_whitening, op13_lexical_search,
    )
}
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
#: The other queries hash with functions that DuckDB lacks (XXH64, CRC-32), use a tokenizer, or learn: they have brute-force tests.
ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": f"""
        WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOW}, {_WORD}), []) AS w FROM documents),
        b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOW}, {_WORD}) AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
        marks AS (SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(list_slice(w, i + 1, i + 10), ' ') AS win FROM (SELECT item, w, unnest(range(greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT size FROM marks),
        spans AS (SELECT doc_id, w, size, unnest(range(len(w) - size + 1)) AS i FROM d, sizes WHERE len(w) >= size),
        hits AS (SELECT doc_id, i, m.size, item FROM spans s JOIN marks m ON m.size = s.size AND m.win = array_to_string(list_slice(w, i + 1, i + s.size), ' ')),
        words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
        found AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op3_embedding_near_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_aggregate(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END), 'sum') = 0),
        n AS (SELECT *, sqrt(list_dot_product(v, v)) AS size FROM v),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND a.size > 0 AND b.size > 0 WHERE list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.98),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
        SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, min(r.b) AS component_id, e.vec_id = min(r.b) AS kept FROM embeddings e JOIN reach r ON r.a = e.vec_id GROUP BY e.vec_id""",
    "op4_substring_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
        spans AS (SELECT doc_id, i, array_to_string(list_slice(w, i + 1, i + 20), ' ') AS win FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 19, 0))) AS i FROM d)),
        again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM spans) WHERE k > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM again),
        words AS (SELECT doc_id, unnest(range(len(w))) AS p, unnest(w) AS word FROM d),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op13_lexical_search": rf"""
        WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOW}, {_TERM}), []) AS t FROM documents),
        c AS (SELECT count(*) FILTER (len(t) > 0) AS docs, sum(len(t))::BIGINT AS length FROM d),
        q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all({_LOW}, {_TERM})) AS term FROM benchmark) GROUP BY ALL),
        p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
        w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, c GROUP BY term, docs),
        s AS (SELECT item_id, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // length))))::BIGINT AS score FROM p JOIN w USING (term) JOIN q USING (term), c GROUP BY item_id, doc_id),
        r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT * FROM r WHERE rank <= 10""",
}
