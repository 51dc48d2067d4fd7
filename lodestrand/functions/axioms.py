"""Column functions on axioms and query patterns: canonical form, parsing, signatures, rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Constructors with one argument and with two.
UNARY = ("SymmetricObjectProperty", "TransitiveObjectProperty", "FunctionalObjectProperty")
BINARY = ("InverseObjectProperties", "SubObjectPropertyOf", "EquivalentObjectProperties")
#: What marks a unit as schema.
SCHEMA = (*UNARY, "SubObjectPropertyOf", "InverseObjectProperties", "PropertyChain", "domain", "range", "subPropertyOf", "inverseOf")
_ONE, _TWO = rf"^({'|'.join(UNARY)})\(([^)]+)\)$", rf"^({'|'.join(BINARY)})\(([^,]+),([^)]+)\)$"
_WORD = r"([A-Za-z_][A-Za-z0-9_:-]*)"


def flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def _parsed(a: Column, words: Column, one: Column, two: Column) -> Column:
    fact = (one == "") & (two == "") & (F.size(words) == 3)
    none = F.lit(None).cast("string")
    name = F.when(one != "", one).when(two != "", two).otherwise(none)
    return F.struct(
        F.when(name.isNotNull(), "rule").when(fact, "fact").otherwise("unknown").alias("kind"), name.alias("name"),
        F.when(one != "", F.regexp_extract(a, _ONE, 2)).when(two != "", F.trim(F.regexp_extract(a, _TWO, 2))).when(fact, F.get(words, 0)).alias("subject"),
        F.when(name.isNotNull(), name).when(fact, F.get(words, 1)).alias("predicate"),
        F.when(two != "", F.trim(F.regexp_extract(a, _TWO, 3))).when(fact, F.get(words, 2)).alias("object"),
    )


def _signed(unit: Column, p: Column) -> Column:
    words = F.array_distinct(F.regexp_extract_all(unit, F.lit(_WORD), F.lit(1)))
    parts = F.split(unit, "::", 4)
    kg = unit.startswith("KG::") & (F.size(parts) == 4)
    none = F.array().cast("array<string>")
    entities = F.when(kg, F.array(F.get(parts, 1), F.get(parts, 3))).when(p["kind"] == "fact", F.array(p["subject"], p["object"])).when(p["kind"] == "rule", none).otherwise(F.filter(words, lambda w: w.rlike("^[a-z]")))
    properties = F.when(kg, F.array(F.get(parts, 2))).when(p["kind"] == "fact", F.array(p["predicate"])).when(p["kind"] == "rule", F.array_compact(F.array(p["subject"], p["object"]))).otherwise(words)
    return F.struct(F.array_distinct(entities).alias("entities"), F.array_distinct(properties).alias("properties"))


def parse(axiom: Column) -> Column:
    """(kind, name, subject, predicate, object): rule for a known constructor, fact for three words, else unknown.

    A rule's arguments are subject and object, its constructor is the predicate.
    """
    a = flat(axiom)
    return _parsed(a, F.split(a, " "), F.regexp_extract(a, _ONE, 1), F.regexp_extract(a, _TWO, 1))


def signature(unit: Column) -> Column:
    """(entities, properties): of a fact its ends and its predicate, of a rule its arguments, of a KG unit its parts, else words."""
    return _signed(unit, parse(unit))


def each_parsed(units: Column) -> Column:
    """The units of an array as (p, s): ``parse`` and ``signature`` of each, no pattern tried twice."""
    plain = F.transform(units, lambda u: F.struct(u.alias("unit"), flat(u).alias("a")))
    tried = F.transform(plain, lambda x: F.struct(x["unit"].alias("unit"), x["a"].alias("a"), F.split(x["a"], " ").alias("words"), F.regexp_extract(x["a"], _ONE, 1).alias("one"), F.regexp_extract(x["a"], _TWO, 1).alias("two")))
    parsed = F.transform(tried, lambda x: F.struct(x["unit"].alias("unit"), _parsed(x["a"], x["words"], x["one"], x["two"]).alias("p")))
    return F.transform(parsed, lambda x: F.struct(x["p"].alias("p"), _signed(x["unit"], x["p"]).alias("s")))


def is_schema(unit: Column) -> Column:
    found = F.lit(False)
    for mark in SCHEMA:
        found = found | unit.contains(mark)
    return found


#: Notations of explanations as patterns, and what each becomes.
NOTATIONS = (
    (r"^(\S+) owl:inverseOf (\S+)$", "InverseObjectProperties($1,$2)"),
    (r"^(\S+) rdfs:subPropertyOf (\S+)$", "SubObjectPropertyOf($1,$2)"),
    (r"^PropertyChain\((\S+) ∘ (\S+)\) ⊑ (\S+)$", "ObjectPropertyChain($1,$2->$3)"),
    (r"^(Symmetric|Transitive|Functional): ?(.+)$", "$1ObjectProperty($2)"),
    (r"^(domain|range)\( ?(.+?) ?\) ?= ?(.+)$", "$2 $1 $3"),
    (r"^(\S+) SubPropertyOf (\S+)$", "SubObjectPropertyOf($1,$2)"),
    (r"^(\S+) Domain (\S+)$", "$1 domain $2"),
    (r"^(\S+) Range (\S+)$", "$1 range $2"),
)
_CHAIN = r"^SubObjectPropertyOf\(ObjectPropertyChain\((.+)\)\s+(<[^>]+>|\S+)\)$"
#: The signs of the Windows code page 1252 at 80 to 9F, in order; a place that it leaves empty is a blank.
CP1252 = "€ ‚ƒ„…†‡ˆ‰Š‹Œ Ž  ‘’“”•–—˜™š›œ žŸ"


def mended(text: Column) -> Column:
    """UTF-8 that was read in the code page 1252, read again; any other text as it is."""
    given = [(c, chr(0x80 + k)) for k, c in enumerate(CP1252) if c != " "]
    narrow = F.translate(text, "".join(c for c, _ in given), "".join(c for _, c in given))
    again = F.when(narrow.rlike(r"^[\x{00}-\x{FF}]*$"), F.encode(narrow, "ISO-8859-1")).cast("string")
    return F.when(text.contains("â") & F.is_valid_utf8(again), again).otherwise(text)


def canonical(unit: Column) -> Column:
    """An explanation's unit in one form; empty for tags. Notations that aren't known only lose spare spaces."""
    u = flat(mended(flat(unit)))
    local = lambda t: F.regexp_extract(F.regexp_replace(F.regexp_replace(t, "[<>]", ""), "/+$", ""), r"([^#/]*)$", 1)
    steps = F.transform(F.regexp_extract_all(F.regexp_extract(u, _CHAIN, 1), F.lit(r"(<[^>]+>|\S+)"), F.lit(1)), local)
    chain = F.concat(F.lit("ObjectPropertyChain("), F.array_join(steps, ","), F.lit("->"), local(F.regexp_extract(u, _CHAIN, 2)), F.lit(")"))
    out = F.when(u.startswith("TAG:"), "").when(u.rlike(_CHAIN), chain)
    for pattern, form in NOTATIONS:
        out = out.when(u.rlike(pattern), F.regexp_replace(u, pattern, form))
    out = out.otherwise(u)
    pair = r"^InverseObjectProperties\((\S+),(\S+)\)$"
    a, b = F.regexp_extract(out, pair, 1), F.regexp_extract(out, pair, 2)
    turned = F.concat(F.lit("InverseObjectProperties("), b, F.lit(","), a, F.lit(")"))
    return F.when(u.rlike(NOTATIONS[0][0]) & (a > b), turned).otherwise(out)


def render(axiom: Column) -> Column:
    """An axiom as a sentence."""
    p = parse(axiom)
    says = F.when(p["name"] == "SubObjectPropertyOf", " implies ").when(p["name"] == "InverseObjectProperties", " is the inverse of ").when(p["name"] == "EquivalentObjectProperties", " is the same as ")
    alone = F.when(p["name"] == "SymmetricObjectProperty", " is symmetric").when(p["name"] == "TransitiveObjectProperty", " is transitive").when(p["name"] == "FunctionalObjectProperty", " is functional")
    both = F.when(p["kind"] == "rule", F.concat(p["subject"], F.coalesce(alone, F.concat(says, p["object"]))))
    return both.when(p["kind"] == "fact", F.concat_ws(" ", p["subject"], p["predicate"], p["object"])).otherwise(axiom)


def unit_class(unit: Column) -> Column:
    """Fact or Axiom."""
    return F.when(parse(unit)["kind"] == "fact", "Fact").otherwise("Axiom")


def reasoning_line(unit: Column) -> Column:
    """A unit as a line for a reader: class, and head -> relation -> tail where it has three words or more."""
    u = flat(unit)
    words = F.split(u, " ")
    spread = F.concat_ws(" -> ", F.get(words, 0), F.get(words, 1), F.array_join(F.slice(words, 3, F.greatest(F.size(words) - 2, F.lit(1))), " "))
    return F.concat(unit_class(u), F.lit(": "), F.when((F.size(words) >= 3) & ~F.get(words, 0).contains("("), spread).otherwise(u))


def query_terms(query: Column) -> Column:
    """Terms of a query's pattern in order: what stands in <> and variables."""
    body = F.regexp_extract(query, r"(?s)\{(.*)\}", 1)
    return F.transform(F.regexp_extract_all(body, F.lit(r"(<[^>]+>|\?\w+)"), F.lit(1)), lambda t: F.regexp_replace(t, "[<>]", ""))


def query_signature(query: Column) -> Column:
    """(entities, properties) of the triples of a query; variables are neither."""
    terms = query_terms(query)
    at = lambda r: F.filter(terms, lambda t, i: (i % 3).isin(*r) & ~t.startswith("?"))
    return F.struct(F.array_distinct(at((0, 2))).alias("entities"), F.array_distinct(at((1,))).alias("properties"))


def query_form(query: Column) -> Column:
    return F.when(F.upper(query).contains("ASK"), "ASK").when(F.upper(query).contains("SELECT"), "SELECT").otherwise("OTHER")


def ask_target(query: Column) -> Column:
    """(subject, predicate, object): local names of the first three things in <>, null where there are fewer."""
    found = F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(r"<([^>]+)>"), F.lit(1))
    local = lambda k: F.regexp_extract(F.get(found, k), r"([^#/]*)$", 1)
    return F.when(F.size(found) >= 3, F.struct(local(0).alias("subject"), local(1).alias("predicate"), local(2).alias("object")))
