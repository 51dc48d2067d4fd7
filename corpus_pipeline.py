"""A training corpus from raw documents, in stages that each read what the one before has written."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm import decontam, langid, packing, simhash, substring
from lodestrand.llm.common import table, written
from lodestrand.llm.queries import language_field

#: A text is rejected below this share of its best language; one in two languages keeps half or more in one of them.
LEAST_SHARE = 0.3
#: Bytes of text that go to Python at once. A batch stands in an executor several times, beside its heap.
BATCH_BYTES = 8 << 20


def _apart(docs: DataFrame) -> DataFrame:
    """``docs`` as doc_id, text and one column with all others, so that no name of theirs meets an operator's."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*(others or [F.lit(0).alias("none")])).alias("rest"))


def _together(found: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of ``docs`` again, in their order, with ``new`` in place of some."""
    own = {c: F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c) for c in docs.columns}
    return found.select(*(new.get(c, own[c]).alias(c) for c in docs.columns))


def _in_small_batches(stage):
    """Sets the session's Arrow batches to ``BATCH_BYTES`` (Spark's are 64 MB) and leaves it so, as what a stage returns is run later."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


@_in_small_batches
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or with no language of share ``LEAST_SHARE``, go."""
    found = langid.label_documents(_apart(docs), language_field(spark, sf_dir))
    return _together(found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)), docs)


@_in_small_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays."""
    return _together(simhash.keep_one(_apart(docs)), docs)


@_in_small_batches
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has leave the text; every document stays, n_chars follows."""
    cut = substring.remove_repeats(_apart(docs))
    new = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    return _together(cut, docs, **new)


@_in_small_batches
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window occurs go."""
    return _together(decontam.drop_contaminated(_apart(docs), table(spark, sf_dir, "benchmark")), docs)


@_in_small_batches
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents, with the sequence and the place of each."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("simhash_near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("best_fit_packing", packing_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result but the last is a written table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
