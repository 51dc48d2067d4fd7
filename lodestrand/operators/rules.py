"""Entailment over triples: class and property closures, inferred types and assertions, proofs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import closure


def inferred_assertions(facts: DataFrame, sub_property: DataFrame, inverse: DataFrame, symmetric: DataFrame) -> DataFrame:
    """(s, p, o): facts, under each super-property, turned under symmetric properties and under inverses.

    ``sub_property`` (src, dst) is closed here; ``inverse`` (p, q) holds both directions; ``symmetric`` (p). One pass:
    derived assertions aren't fed back.
    """
    up = closure(sub_property)
    raised = facts.join(up, F.col("p") == F.col("src"), "left").select("s", F.coalesce("dst", "p").alias("p"), "o")
    turned = raised.join(symmetric, "p", "left_semi").select(F.col("o").alias("s"), "p", F.col("s").alias("o"))
    swapped = facts.join(inverse.select("p", "q"), "p").select(F.col("o").alias("s"), F.col("q").alias("p"), F.col("s").alias("o"))
    swapped = swapped.join(up, F.col("p") == F.col("src"), "left").select("s", F.coalesce("dst", "p").alias("p"), "o")
    return raised.union(turned).union(swapped).distinct()


def inferred_types(types: DataFrame, facts: DataFrame, domain: DataFrame, range_: DataFrame, sub_property: DataFrame, sub_class: DataFrame) -> DataFrame:
    """(s, c): asserted types, domains of subjects and ranges of objects over super-properties, and all their super-classes."""
    up = closure(sub_property)
    raised = facts.join(up, F.col("p") == F.col("src"), "left").select("s", F.coalesce("dst", "p").alias("p"), "o")
    by_domain = raised.join(domain, "p").select("s", "c")
    by_range = raised.join(range_, "p").select(F.col("o").alias("s"), "c")
    own = types.union(by_domain).union(by_range).distinct()
    classes = closure(sub_class)
    return own.join(classes, F.col("c") == F.col("src"), "left").select("s", F.coalesce("dst", "c").alias("c")).distinct()


def inverse_types(facts: DataFrame, domain: DataFrame, range_: DataFrame, inverse: DataFrame) -> DataFrame:
    """(s, c): by the inverse (p, q) of a fact's property p, whose domain holds of the fact's object and whose range of its subject."""
    turned = facts.join(inverse, "p").select(F.col("o").alias("s"), F.col("q").alias("p"), F.col("s").alias("o"))
    return turned.join(domain, "p").select("s", "c").union(turned.join(range_, "p").select(F.col("o").alias("s"), "c")).distinct()


def proofs(questions: DataFrame, assertions: DataFrame) -> DataFrame:
    """``questions`` (s, p, o, ...) with proof: TRUE where the triple is among ``assertions``, else null, never FALSE."""
    true = assertions.select("s", "p", "o").distinct().withColumn("proof", F.lit("TRUE"))
    return questions.join(true, ["s", "p", "o"], "left")
