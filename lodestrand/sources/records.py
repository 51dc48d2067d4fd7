"""Question records in their two layouts, read as one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTEXT = "array<struct<title: string, sentences: array<string>>>"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, a JSON array, or JSON lines, by the ending of the path; folders of Parquet are read with all below them."""
    if path.endswith(".jsonl"):
        return spark.read.json(path)
    if path.endswith(".json"):
        return spark.read.option("multiLine", True).json(path)
    if path.endswith(".parquet") or "." not in path.rsplit("/", 1)[-1]:
        return spark.read.option("recursiveFileLookup", True).parquet(path)
    raise ValueError(f"no reader for {path}")


def _zipped(df: DataFrame, column: str, first: str, second: str, names: tuple[str, str], kinds: tuple[str, str]) -> F.Column:
    """A column of pairs: from a struct of two lists, or as it is from a list of structs."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.StructType):
        a, b = F.col(f"{column}.{first}"), F.col(f"{column}.{second}")
        pairs = F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: F.struct(p["x"].try_cast(kinds[0]).alias(names[0]), p["y"].try_cast(kinds[1]).alias(names[1])))
    else:
        pairs = F.transform(F.col(column), lambda p: F.struct(p[first if first in kind.elementType.names else names[0]].try_cast(kinds[0]).alias(names[0]), p[second if second in kind.elementType.names else names[1]].try_cast(kinds[1]).alias(names[1])))
    return F.coalesce(pairs, F.array().cast(f"array<struct<{names[0]}: {kinds[0]}, {names[1]}: {kinds[1]}>>"))


def normalize_records(df: DataFrame) -> DataFrame:
    """(id, question, context[, answer, supporting_facts]): both layouts of context and facts as lists of pairs.

    ids come from ``id`` or ``_id``; missing texts are empty; facts whose index isn't a number go; other columns go.
    """
    ids = [c for c in ("id", "_id") if c in df.columns]
    if not ids or "question" not in df.columns or "context" not in df.columns:
        raise ValueError(f"records need an id, a question and a context; the columns are {df.columns}")
    out = [
        F.coalesce(*(F.col(c).cast("string") for c in ids), F.lit("")).alias("id"), F.coalesce("question", F.lit("")).alias("question"),
        _zipped(df, "context", "title", "sentences", ("title", "sentences"), ("string", "array<string>")).alias("context"),
    ]
    if "answer" in df.columns:
        out.append(F.coalesce("answer", F.lit("")).alias("answer"))
    if "supporting_facts" in df.columns:
        facts = _zipped(df, "supporting_facts", "title", "sent_id", ("title", "sent_idx"), ("string", "int"))
        out.append(F.filter(facts, lambda p: p["sent_idx"].isNotNull()).alias("supporting_facts"))
    return df.select(*out)


def evidence_units(records: DataFrame) -> DataFrame:
    """(example_id, title, sent_idx, sentence, unit) of normalised records; blank sentences are left out, but count."""
    from ..functions.text import sentence_unit

    pages = records.select(F.col("id").alias("example_id"), F.explode_outer("context").alias("page")).select("example_id", F.trim("page.title").alias("title"), F.posexplode_outer("page.sentences").alias("sent_idx", "raw"))
    clean = pages.withColumn("sentence", F.trim(F.regexp_replace("raw", r"\s+", " "))).where(F.length("sentence") > 0).drop("raw")
    return clean.withColumn("unit", sentence_unit(F.col("title"), F.col("sent_idx"), F.col("sentence"))).dropDuplicates(["example_id", "unit"])


def gold_units(records: DataFrame, units: DataFrame) -> DataFrame:
    """(example_id, units): the evidence units that the supporting facts of a record name; those that aren't there are left out."""
    facts = records.select(F.col("id").alias("example_id"), F.posexplode_outer("supporting_facts").alias("at", "fact")).select("example_id", "at", F.trim("fact.title").alias("title"), F.col("fact.sent_idx").alias("sent_idx"))
    found = facts.join(units, ["example_id", "title", "sent_idx"]).groupBy("example_id").agg(F.array_sort(F.collect_list(F.struct("at", "unit"))).alias("pairs"))
    return found.select("example_id", F.array_distinct(F.col("pairs.unit")).alias("units"))
