"""Column functions on whole supports: statements of units, what they entail, and proofs from which nothing can go.

A support is one array of a row, as selection cuts it: all of this is evaluated row by row inside the engine, without a
shuffle. Work grows with the cube of a support's units, for minimal proofs with the fourth power.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The first words that make a question one for yes or no.
ASKING = ("is", "are", "was", "were", "do", "does", "did", "has", "have", "had", "can", "could", "should", "would")
#: Relations and constructors that say something of classes and properties, as they are compared, and the statement they make.
CONSTRUCTORS = {"inverseobjectproperties": "inverse", "subobjectpropertyof": "subproperty", "symmetricobjectproperty": "symmetric", "transitiveobjectproperty": "transitive"}
RELATIONS = {"type": "type", "domain": "domain", "range": "range", "subclassof": "subclass", "subpropertyof": "subproperty", "subobjectpropertyof": "subproperty", "inverseof": "inverse"}
#: Classes that say something of a property.
OF_PROPERTIES = {"SymmetricProperty": "symmetric", "SymmetricObjectProperty": "symmetric", "TransitiveProperty": "transitive", "TransitiveObjectProperty": "transitive"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def clean(unit: Column) -> Column:
    """Single spaces; <http://x#name> is its name."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(unit, F.lit("")), r"\s+", " ")), r"<[^#>\s]+#([^>]+)>", "$1")


def local(name: Column) -> Column:
    """What stands behind the last # of a name, and in web addresses behind the last /; without <>."""
    after = F.regexp_extract(clean(name), r"([^#]*)$", 1)
    path = F.regexp_extract(F.regexp_replace(after, "/+$", ""), r"([^/]*)$", 1)
    return F.regexp_replace(F.when(after.startswith("http") & after.contains("/"), path).otherwise(after), r"^[<>]+|[<>]+$", "")


def relation(name: Column) -> Column:
    """A local name to compare: behind its first colon, in lower case."""
    return F.lower(F.regexp_replace(local(name), "^[^:]*:", ""))


def _look(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def statement(unit: Column) -> Column:
    """(kind, a, rel, b): what a unit says; kind is null for what proofs don't use, triple for a plain fact."""
    u = clean(unit)
    call = r"^([A-Za-z0-9_:]+)\(([^)]*)\)"
    args = F.filter(F.transform(F.split(F.regexp_extract(u, call, 2), ","), lambda x: F.trim(x)), lambda x: x != "")
    made = _look(relation(F.regexp_extract(u, call, 1)), CONSTRUCTORS)
    enough = F.size(args) >= F.when(made.isin("inverse", "subproperty"), 2).otherwise(1)
    words = F.split(u, " ")
    head, rel, tail = local(F.get(words, 0)), local(F.get(words, 1)), local(F.array_join(F.slice(words, 3, F.greatest(F.size(words) - 2, F.lit(1))), " "))
    says = F.coalesce(_look(relation(rel), RELATIONS), F.lit("triple"))
    says = F.when(says == "type", F.coalesce(_look(tail, OF_PROPERTIES), F.lit("type"))).otherwise(says)
    none = F.lit(None).cast("string")
    of_call = F.struct(F.when(enough, made).alias("kind"), local(F.get(args, 0)).alias("a"), none.alias("rel"), local(F.get(args, 1)).alias("b"))
    of_words = F.struct(F.when(F.size(words) >= 3, says).alias("kind"), head.alias("a"), rel.alias("rel"), tail.alias("b"))
    return F.when(u.rlike(call), of_call).otherwise(of_words)


def statements(units: Column) -> Column:
    """Statements of a support's units, one for each."""
    return F.transform(F.coalesce(units, F.array().cast("array<string>")), statement)


def _of(st: Column, kind: str) -> Column:
    return F.filter(st, lambda x: x["kind"] == kind)


def above(start: Column, links: Column) -> Column:
    """``start`` and everything that ``links`` (a, b) lead to from it."""
    step = lambda seen, _: F.array_union(seen, F.transform(F.filter(links, lambda e: F.array_contains(seen, e["a"])), lambda e: e["b"]))
    return F.aggregate(links, F.array_distinct(start), step)


def _both_ways(inverse: Column) -> Column:
    return F.concat(F.transform(inverse, lambda e: F.struct(e["a"].alias("a"), e["b"].alias("b"))), F.transform(inverse, lambda e: F.struct(e["b"].alias("a"), e["a"].alias("b"))))


def _turned(raised: Column, inverse: Column, sub: Column) -> Column:
    """Properties that hold the other way round: inverses of any of ``raised``, and what is above them."""
    return above(F.transform(F.filter(_both_ways(inverse), lambda e: F.array_contains(raised, e["a"])), lambda e: e["b"]), sub)


def types_of(st: Column, entity: Column) -> Column:
    """Classes of an entity: asserted, by domain and range of its facts' properties or their inverses, and all above them."""
    sub, inverse, domain, range_ = (_of(st, k) for k in ("subproperty", "inverse", "domain", "range"))
    of = lambda rules, held: F.transform(F.filter(rules, lambda r: F.array_contains(held, r["a"])), lambda r: r["b"])
    none = F.array().cast("array<string>")

    def by_fact(t: Column) -> Column:
        def classes(raised: Column) -> Column:
            def with_turned(turned: Column) -> Column:
                as_head = F.when(t["a"] == entity, F.concat(of(domain, raised), of(range_, turned))).otherwise(none)
                as_tail = F.when(t["b"] == entity, F.concat(of(range_, raised), of(domain, turned))).otherwise(none)
                return F.concat(as_head, as_tail)

            return let(_turned(raised, inverse, sub), with_turned)

        return let(above(F.array(t["rel"]), sub), classes)

    own = F.transform(F.filter(_of(st, "type"), lambda x: x["a"] == entity), lambda x: x["b"])
    near = F.filter(_of(st, "triple"), lambda t: (t["a"] == entity) | (t["b"] == entity))
    return above(F.concat(own, F.flatten(F.transform(near, by_fact))), _of(st, "subclass"))


def asserts(st: Column, s: Column, p: Column, o: Column) -> Column:
    """Whether s p o follows: a fact, raised to a property above, turned under a symmetric property, or under an inverse."""
    sub, inverse = _of(st, "subproperty"), _of(st, "inverse")
    symmetric = F.exists(_of(st, "symmetric"), lambda x: x["a"] == p)

    def holds(t: Column) -> Column:
        forward, back = (t["a"] == s) & (t["b"] == o), (t["a"] == o) & (t["b"] == s)
        found = lambda raised: (F.array_contains(raised, p) & (forward | (back & symmetric))) | (back & F.array_contains(_turned(raised, inverse, sub), p))
        return (forward | back) & let(above(F.array(t["rel"]), sub), found)

    return F.exists(_of(st, "triple"), holds)


def entails(st: Column, target: Column) -> Column:
    """Whether statements prove a target (subject, predicate, object); false where there is none."""
    s, p, o = target["subject"], target["predicate"], target["object"]
    return F.coalesce(F.when(relation(p) == "type", F.array_contains(types_of(st, s), o)).otherwise(asserts(st, s, p, o)), F.lit(False))


def is_boolean(question: Column) -> Column:
    return F.coalesce(F.lower(F.trim(question)).rlike(rf"^({'|'.join(ASKING)})\b"), F.lit(False))


def ask_triple(query: Column) -> Column:
    """(subject, predicate, object): local names of the first three names in <>, null where there are fewer."""
    found = F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(r"<([^>]+)>"), F.lit(1))
    return F.when(F.size(found) >= 3, F.struct(*(local(F.get(found, k)).alias(n) for k, n in enumerate(("subject", "predicate", "object")))))


def type_target(query: Column) -> Column:
    """(subject, class) of a query on a type, else null."""
    t = ask_triple(query)
    return F.when(relation(t["predicate"]) == "type", F.struct(t["subject"].alias("subject"), t["object"].alias("class")))


def proved(question: Column, query: Column, st: Column) -> Column:
    """Whether a question for yes or no has its answer, yes, in the statements. False says nothing."""
    return is_boolean(question) & let(ask_triple(query), lambda t: t.isNotNull() & entails(st, t))


def minimal_proof(question: Column, query: Column, units: Column) -> Column:
    """Units that are left when one after another, in order, goes if the rest still proves; null where nothing is proved.

    ``units`` without repeats. The place of a unit that stays is passed, so each is tried once: a fold over places.
    """
    none = F.lit(None).cast("array<string>")

    def search(st: Column) -> Column:
        def without(kept: Column, k: Column) -> Column:
            rest = F.filter(kept, lambda i: i != k)
            return F.when(proved(question, query, F.transform(rest, lambda i: F.get(st, i))), rest).otherwise(kept)

        every = F.when(F.size(units) > 0, F.sequence(F.lit(0), F.size(units) - 1)).otherwise(F.array().cast("array<int>"))
        return F.when(proved(question, query, st), F.transform(F.aggregate(every, every, without), lambda i: F.get(units, i))).otherwise(none)

    return let(statements(units), search)
