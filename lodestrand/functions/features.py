"""Column functions: features of candidate supports and the score adjustments built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import axioms as A
from . import text as X

from .entail import let
from .sets import ratio

#: Weights of the text-chain adjustment.
TEXT_CHAIN = {"question_title": 0.030, "overlap": 0.020, "cross_page": 0.020, "bridge": 0.025, "knowledge": 0.030, "comparison": 0.020}
#: Weights of the proof adjustment.
PROOF = {"proof": 0.18, "coverage": 0.03, "mix": 0.02, "compact": 0.35, "oversize": -0.01}
DUPLICATE_PAGE = 0.01


def coverage(asked: Column, had: Column) -> Column:
    """Share of the asked tokens that are had; 0 when nothing is asked."""
    return ratio(F.size(F.array_intersect(asked, had)), F.size(asked))


def lexical_score(overlap: Column, size: Column) -> Column:
    return overlap + ratio(F.lit(0.02), size)


def rank_target(exact: Column, complete: Column, f1: Column) -> Column:
    """1 for exact, 0.9 for complete, else half of F1 up to 0.3."""
    return F.when(exact, 1.0).when(complete, 0.9).otherwise(F.least(F.lit(0.3), 0.5 * f1))


def size_penalty(n: Column) -> Column:
    return F.when(n <= 2, 0.0).when(n == 3, 0.002).when(n == 4, 0.004).otherwise(0.01 * (n - 4))


def cross_page(titles: Column) -> Column:
    """By the number of distinct titles."""
    return F.when(titles <= 0, 0.0).when(titles == 1, 0.2).when(titles == 2, 0.8).otherwise(1.0)


def comparison(titles: Column, asks: Column) -> Column:
    """By the number of distinct titles, if the question compares."""
    return F.when(~asks | (titles <= 1), 0.0).when(titles == 2, 0.65).when(titles == 3, 0.85).otherwise(1.0)


def bridge(titles: Column, sentences: Column) -> Column:
    """Share of ordered pairs (title i, sentence j, i not j) that share a token; titles without tokens are left out.

    Both are arrays of token arrays, one for each unit.
    """
    each = F.flatten(F.transform(titles, lambda t, i: F.filter(F.transform(sentences, lambda s, j: F.when((i != j) & (F.size(t) > 0), F.arrays_overlap(t, s).cast("int"))), lambda x: x.isNotNull())))
    return ratio(F.aggregate(each, F.lit(0), lambda a, x: a + x), F.size(each))


def adjustment(weights: dict[str, float], values: dict[str, Column]) -> Column:
    total = F.lit(0.0)
    for name, weight in weights.items():
        if name in values:
            total = total + weight * values[name]
    return total


#: Weights of the compact adjustment.
COMPACT = {"property": 0.025, "entity": 0.015, "mix": 0.020, "oversize": -0.006, "extra_schema": -0.004}
MODES = ("neural", "minimality", "completeness", "compact", "proof")


def coverage_in(words: Column, text: Column) -> Column:
    """Share of words that a text holds; 0 without words."""
    return ratio(F.size(F.filter(words, lambda w: text.contains(w))).cast("double"), F.size(words))


def _over(rows: DataFrame) -> Column:
    return F.greatest(rows["size"] - 2, F.lit(0))


def compact(rows: DataFrame) -> Column:
    """From property, entity, mix, size and schema (units of schema): matches are rewarded, size and more than one rule are not."""
    extra = F.greatest(rows["schema"] - 1, F.lit(0))
    return COMPACT["property"] * rows["property"] + COMPACT["entity"] * rows["entity"] + COMPACT["mix"] * rows["mix"] + COMPACT["oversize"] * _over(rows) + COMPACT["extra_schema"] * extra


def proof(rows: DataFrame) -> Column:
    """The compact adjustment, and a large bonus where the question is proved."""
    return PROOF["proof"] * rows["proof"] + PROOF["coverage"] * rows["coverage"] + PROOF["mix"] * rows["mix"] + PROOF["compact"] * compact(rows) + PROOF["oversize"] * _over(rows)


def by_mode(rows: DataFrame, mode: str) -> Column:
    """The score ``neural`` adjusted by a mode; an unknown mode is an error when the plan is built."""
    n = rows["neural"]
    if mode == "neural":
        return n
    if mode == "minimality":
        return n - 0.01 * rows["size"]
    if mode == "completeness":
        return n + 0.02 * rows["mix"] + 0.02 * rows["property"] - 0.005 * _over(rows)
    if mode in ("compact", "proof"):
        return n + {"compact": compact, "proof": proof}[mode](rows)
    raise ValueError(f"no score mode {mode}")


def _plain_property(name: Column) -> Column:
    return F.when(F.trim(name) == "rdf:type", "type").otherwise(F.trim(name))


def _rule_properties(parsed: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.when(parsed["kind"] == "rule", F.transform(F.array_compact(F.array(parsed["subject"], parsed["object"])), _plain_property)).otherwise(none)


def support_vector(units: Column, entities: Column, properties: Column) -> Column:
    """The eight values of an ontology support: shares of units with an entity and with a property of the question, whether
    a rule has such a property and a fact such an entity, whether facts stand beside rules, size up to five; the last two,
    which gold would tell, stay 0. All are 0 for an empty support.
    """
    none = F.array().cast("array<string>")

    def each(unit: Column, asked: Column) -> Column:
        p, s = unit["p"], unit["s"]
        known = p["kind"] != "unknown"
        own = F.transform(F.when(known, s["properties"]).otherwise(none), _plain_property)
        has_entity = known & (p["kind"] == "fact") & F.arrays_overlap(s["entities"], asked["entities"])
        has_rule = F.arrays_overlap(_rule_properties(p), asked["properties"])
        return F.struct(has_entity.alias("entity"), (F.arrays_overlap(own, asked["properties"]) | has_rule).alias("property"), has_rule.alias("rule_property"), p["kind"].alias("kind"))

    def values(found: Column) -> Column:
        n = F.size(found)
        share = lambda part: F.coalesce(F.size(F.filter(found, lambda x: x[part])) / F.nullif(n, F.lit(0)), F.lit(0.0))
        some = lambda test: F.exists(found, test).cast("double")
        mix = some(lambda x: x["kind"] == "fact") * some(lambda x: x["kind"] == "rule")
        return F.array(share("entity"), share("property"), some(lambda x: x["rule_property"]), some(lambda x: x["entity"]), mix, F.least(n, F.lit(5)) / 5.0, F.lit(0.0), F.lit(0.0))

    # the question and the parsed units are worked out once for a row, not once for each use
    asked = F.struct(entities.alias("entities"), F.transform(properties, _plain_property).alias("properties"))
    return let(asked, lambda q: let(F.transform(A.each_parsed(units), lambda u: each(u, q)), values))


def match_tokens(text: Column) -> Column:
    """Words of a normalised text of two letters or more, without articles."""
    return F.array_distinct(F.filter(F.split(X.normalize_text(F.coalesce(text, F.lit(""))), " "), lambda w: (F.length(w) > 1) & ~w.isin("a", "an", "the")))


def node_vector(unit: Column, question: Column, entities: Column, properties: Column, degree: Column) -> Column:
    """The eight values of a node: fact, rule, entity of the question, property of it, rule with such a property, fact with such
    an entity, its ``degree`` as a share of the graph's largest, and 1. Facts of a knowledge graph and sentences are matched
    by words of the question, a sentence's title standing for its entities.
    """
    parts, asked = F.split(unit, "::", 4), match_tokens(question)
    one = lambda test: F.coalesce(test, F.lit(False)).cast("double")
    part = lambda k: F.trim(F.get(parts, k))
    meets = lambda *texts: one(F.arrays_overlap(F.flatten(F.array(*map(match_tokens, texts))), asked))
    kg, sentence = unit.startswith("KG::") & (F.size(parts) == 4), unit.startswith("SENT::") & (F.size(parts) == 4)
    p, s = A.parse(unit), A.signature(unit)
    known = p["kind"] != "unknown"
    fact, rule = p["kind"] == "fact", p["kind"] == "rule"
    wanted = F.transform(properties, _plain_property)
    entity = one(fact & F.arrays_overlap(s["entities"], entities))
    of_rule = one(rule & F.arrays_overlap(_rule_properties(p), wanted))
    property_ = one(known & (F.arrays_overlap(F.transform(s["properties"], _plain_property), wanted) | (of_rule > 0)))
    end = (degree.cast("double"), F.lit(1.0))
    named, zero = meets(part(1), part(3)), F.lit(0.0)
    as_kg = F.array(F.lit(1.0), zero, named, meets(part(2)), zero, named, *end)
    as_sentence = F.array(zero, zero, meets(part(1)), meets(part(1), part(3)), zero, meets(part(1)), *end)
    return F.when(kg, as_kg).when(sentence, as_sentence).otherwise(F.array(one(fact), one(rule), entity, property_, of_rule, entity, *end))
