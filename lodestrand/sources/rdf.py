"""Ontology files: groups of questions with their ontology as JSON, ontologies as Turtle or RDF/XML, triples, and axioms from triples."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.entail import local
from ..operators.graph import stored

#: The names of the RDF and OWL vocabularies that axioms are read from.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
#: What types of a property become, and objects and predicates that say nothing.
OF_TYPE = {"SymmetricProperty": "SymmetricObjectProperty", "SymmetricObjectProperty": "SymmetricObjectProperty", "TransitiveProperty": "TransitiveObjectProperty", "TransitiveObjectProperty": "TransitiveObjectProperty", "FunctionalProperty": "FunctionalObjectProperty", "FunctionalObjectProperty": "FunctionalObjectProperty"}
SILENT_TYPES = ("NamedIndividual", "ObjectProperty", "Ontology", "Class")
SILENT_PREDICATES = ("comment", "first", "rest", "propertyChainAxiom")
#: The columns of a group file.
GROUP = "`Task Type` string, `Answer Type` string, `OWL Context` string, QAs array<struct<`Task ID`: string, `NL Question`: string, `ABS Question`: string, `SPARQL Query`: string, `Answer Type`: string, Answer: string, Explanations: array<array<string>>, `Minimum Explanation`: array<string>>>"

_TOKEN = re.compile(r"""\s+|\#[^\n]*|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<text>\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<word>@?[^\s<>"'()\[\];,#^]*[^\s<>"'()\[\];,.#^])|(?P<sign>\^\^|[()\[\];,.])""", re.S)
Triple = tuple[str, str, str, str, str]


def _tokens(text: str) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"no Turtle at {text[at : at + 40]!r}")
        at = m.end()
        if m.lastgroup:
            yield m.lastgroup, m.group(m.lastgroup)


class _Turtle:
    """Triples (subject, its kind, predicate, object, its kind) of a Turtle text; kinds are iri, blank and text."""

    def __init__(self, text: str):
        self.todo, self.names, self.base, self.out, self.blanks = list(_tokens(text))[::-1], {}, "", [], 0

    def take(self, sign: str | None = None) -> tuple[str, str]:
        if not self.todo or (sign and self.todo[-1][1] != sign):
            raise ValueError(f"Turtle lacks {sign or 'an end'} before {self.todo[-1][1] if self.todo else 'its end'!r}")
        return self.todo.pop()

    def at(self, sign: str) -> bool:
        return bool(self.todo) and self.todo[-1] == ("sign", sign)

    def blank(self) -> tuple[str, str]:
        self.blanks += 1
        return f"_:b{self.blanks}", "blank"

    def add(self, s: tuple[str, str], p: str, o: tuple[str, str]) -> None:
        self.out.append((*s, p, *o))

    def term(self) -> tuple[str, str]:
        kind, value = self.take()
        if kind == "iri":
            return (self.base + value[1:-1] if self.base and ":" not in value else value[1:-1]), "iri"
        if kind == "text":
            quote = 3 if value[:3] in ('"""', "'''") else 1
            if self.todo and self.todo[-1][1] == "^^":
                self.take()
                self.term()
            elif self.todo and self.todo[-1][0] == "word" and self.todo[-1][1].startswith("@"):
                self.take()
            return value[quote:-quote], "text"
        if value == "[":
            node = self.blank()
            if not self.at("]"):
                self.facts(node)
            self.take("]")
            return node
        if value == "(":
            members = []
            while not self.at(")"):
                members.append(self.term())
            self.take(")")
            cells = [self.blank() for _ in members] + [(RDF + "nil", "iri")]
            for k, member in enumerate(members):
                self.add(cells[k], RDF + "first", member)
                self.add(cells[k], RDF + "rest", cells[k + 1])
            return cells[0]
        if kind == "sign":
            raise ValueError(f"Turtle has {value!r} in place of a term")
        if value.startswith("_:"):
            return "_:n" + value[2:], "blank"
        if ":" in value and value.split(":", 1)[0] in self.names:
            prefix, name = value.split(":", 1)
            return self.names[prefix] + name.replace("\\", ""), "iri"
        if re.fullmatch(r"true|false|[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", value):
            return value, "text"
        raise ValueError(f"Turtle has no prefix for {value!r}")

    def facts(self, s: tuple[str, str]) -> None:
        while True:
            p = RDF + "type" if self.todo and self.todo[-1] == ("word", "a") else None
            p = self.term()[0] if p is None else (self.take(), p)[1]
            self.add(s, p, self.term())
            while self.at(","):
                self.take()
                self.add(s, p, self.term())
            while self.at(";"):
                self.take()
            if not self.todo or self.todo[-1][1] in (".", "]"):
                return

    def triples(self) -> list[Triple]:
        while self.todo:
            kind, value = self.todo[-1]
            if kind == "word" and value.lower().lstrip("@") in ("prefix", "base"):
                self.take()
                if value.lower().endswith("prefix"):
                    name = self.take()[1].rstrip(":")
                    self.names[name] = self.take()[1][1:-1]
                else:
                    self.base = self.take()[1][1:-1]
                if value.startswith("@"):
                    self.take(".")
                continue
            s = self.term()
            if not (s[1] == "blank" and self.at(".")):
                self.facts(s)
            self.take(".")
        return self.out


def _xml(text: str) -> list[Triple]:
    """Triples of an RDF/XML text: descriptions, typed nodes, references, nested nodes, collections."""
    out: list[Triple] = []
    name = lambda tag: tag[1:].replace("}", "") if tag.startswith("{") else tag
    at = lambda e, key: e.get(f"{{{RDF}}}{key}")
    root = ET.fromstring(text.encode())
    base = root.get("{http://www.w3.org/XML/1998/namespace}base", "")
    full = lambda ref: base + ref if ref.startswith("#") or not ref else ref
    n = 0

    def blank() -> tuple[str, str]:
        nonlocal n
        n += 1
        return f"_:x{n}", "blank"

    def node(e: ET.Element) -> tuple[str, str]:
        about, own, label = at(e, "about"), at(e, "ID"), at(e, "nodeID")
        s = (full(about), "iri") if about is not None else (f"{base}#{own}", "iri") if own is not None else (f"_:n{label}", "blank") if label else blank()
        if name(e.tag) != RDF + "Description":
            out.append((*s, RDF + "type", name(e.tag), "iri"))
        out.extend((*s, name(k), v, "iri" if name(k) == RDF + "type" else "text") for k, v in e.attrib.items() if not k.startswith((f"{{{RDF}}}about", f"{{{RDF}}}ID", f"{{{RDF}}}nodeID", "{http://www.w3.org/XML/1998/namespace}")))
        for fact in e:
            p, resource, label = name(fact.tag), at(fact, "resource"), at(fact, "nodeID")
            if resource is not None:
                out.append((*s, p, full(resource), "iri"))
            elif label is not None:
                out.append((*s, p, f"_:n{label}", "blank"))
            elif at(fact, "parseType") == "Collection":
                members = [node(x) for x in fact]
                cells = [blank() for _ in members] + [(RDF + "nil", "iri")]
                out.append((*s, p, *cells[0]))
                for k, member in enumerate(members):
                    out.extend(((*cells[k], RDF + "first", *member), (*cells[k], RDF + "rest", *cells[k + 1])))
            elif at(fact, "parseType") == "Resource":
                o = blank()
                out.append((*s, p, *o))
                out.extend((*o, name(x.tag), x.text or "", "text") for x in fact)
            elif len(fact):
                out.append((*s, p, *node(fact[0])))
            else:
                out.append((*s, p, fact.text or "", "text"))
        return s

    for e in root if name(root.tag) == RDF + "RDF" else [root]:
        node(e)
    return out


def parse(text: str | None) -> list[Triple]:
    """Triples of a text: RDF/XML if it looks so, else Turtle; if that fails, the other. Empty texts have none."""
    text = (text or "").lstrip("﻿").strip()
    if not text:
        return []
    looks = text.startswith("<?xml") or "<rdf:RDF" in text[:500]
    first, second = (_xml, lambda t: _Turtle(t).triples()) if looks else (lambda t: _Turtle(t).triples(), _xml)
    try:
        return first(text)
    except (ValueError, ET.ParseError) as error:
        try:
            return second(text)
        except (ValueError, ET.ParseError) as other:
            raise ValueError(f"neither Turtle nor RDF/XML: {error}; {other}") from None


def triples(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, s, s_kind, p, o, o_kind): the distinct triples of every ontology text; a text that can't be read raises.

    Blank nodes are named by text and order, so they are told apart together with the key. A text is read whole by one task.
    """
    kind = texts.schema[key].dataType.simpleString()

    def run(frames):
        for frame in frames:
            rows = [(k, *t) for k, own in zip(frame["key"], frame["text"], strict=True) for t in dict.fromkeys(parse(own))]
            yield pd.DataFrame(rows, columns=["key", "s", "s_kind", "p", "o", "o_kind"])

    found = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, s string, s_kind string, p string, o string, o_kind string")
    return found.withColumnRenamed("key", key)


def list_members(facts: DataFrame, key: str, most: int = 32) -> DataFrame:
    """(key, head, at, member, member_kind): the members of all lists, in order, by the list's first cell.

    Every cell points at the one before it. Pointers are doubled, all lists together: a round is one join of the pointers
    with themselves, so a list of n members takes as many rounds as n has binary digits. A list that leads back to itself
    never ends: after ``most`` rounds this raises.
    """
    rest = facts.where(F.col("p") == RDF + "rest").select(key, F.col("s").alias("before"), F.col("o").alias("cell")).where(F.col("cell") != RDF + "nil")
    cells = facts.where(F.col("p") == RDF + "first").select(key, F.col("s").alias("cell"), F.col("o").alias("member"), F.col("o_kind").alias("member_kind"))
    state = stored(cells.select(key, "cell").distinct().join(rest, [key, "cell"], "left").select(key, "cell", F.col("before").alias("to"), F.when(F.col("before").isNull(), 0).otherwise(1).alias("steps")))
    for _ in range(most):
        if state.where("to is not null").isEmpty():
            break
        on = state.select(F.col(key).alias("k2"), F.col("cell").alias("c2"), F.col("to").alias("to2"), F.col("steps").alias("more"), F.lit(True).alias("known"))
        # a cell whose pointer leads to a first cell has arrived: the first cell points nowhere
        joined = state.join(on, (F.col(key) == F.col("k2")) & (F.col("to") == F.col("c2")), "left")
        arrived = F.col("to").isNull() | F.coalesce(F.col("known") & F.col("to2").isNull(), F.lit(True))
        if joined.where(~arrived).isEmpty():
            heads = joined.select(key, "cell", F.coalesce("to", "cell").alias("head"), F.col("steps").alias("at"))
            return heads.join(cells, [key, "cell"]).select(key, "head", "at", "member", "member_kind")
        state = stored(joined.select(key, "cell", F.when(arrived, F.col("to")).otherwise(F.col("to2")).alias("to"), F.when(arrived, F.col("steps")).otherwise(F.col("steps") + F.col("more")).alias("steps")))
    else:
        raise ValueError(f"a list goes on after 2^{most} cells")
    return state.select(key, "cell", F.col("cell").alias("head"), F.col("steps").alias("at")).join(cells, [key, "cell"]).select(key, "head", "at", "member", "member_kind")


def _call(name: str, *arguments: Column) -> Column:
    return F.concat(F.lit(f"{name}("), F.concat_ws(",", *arguments), F.lit(")"))


def axioms(facts: DataFrame, key: str) -> DataFrame:
    """(key, axiom): the distinct axioms that triples say, in canonical notation.

    Only triples between named things count; a property chain counts by the named members of its list, in order.
    ``facts``: (key, s, s_kind, p, o, o_kind). Keys without axioms have no row.
    """
    named = facts.where((F.col("s_kind") == "iri") & (F.col("o_kind") == "iri")).select(key, local(F.col("s")).alias("s"), "p", local(F.col("p")).alias("name"), local(F.col("o")).alias("o"))
    p, s, o = F.col("p"), F.col("s"), F.col("o")
    of_type = F.create_map(*(F.lit(x) for pair in OF_TYPE.items() for x in pair))[o]
    as_type = F.when(of_type.isNotNull(), F.concat(of_type, F.lit("("), s, F.lit(")"))).when(~o.isin(*SILENT_TYPES), F.concat_ws(" ", s, F.lit("rdf:type"), o))
    axiom = F.when(p == RDF + "type", as_type)
    for name, made in (("subPropertyOf", "SubObjectPropertyOf"), ("inverseOf", "InverseObjectProperties"), ("equivalentProperty", "EquivalentObjectProperties")):
        axiom = axiom.when(p == (RDFS if name == "subPropertyOf" else OWL) + name, _call(made, s, o))
    for name, word in (("subClassOf", "SubClassOf"), ("domain", "domain"), ("range", "range")):
        axiom = axiom.when(p == RDFS + name, F.concat_ws(" ", s, F.lit(word), o))
    axiom = axiom.when(~F.col("name").isin(*SILENT_PREDICATES), F.concat_ws(" ", s, "name", o))
    plain = named.select(key, axiom.alias("axiom"))
    heads = facts.where((F.col("p") == OWL + "propertyChainAxiom") & (F.col("s_kind") == "iri")).select(key, F.col("s").alias("above"), F.col("o").alias("head"))
    steps = list_members(facts, key).where("member_kind = 'iri'").join(heads, [key, "head"]).groupBy(key, "above", "head").agg(F.array_sort(F.collect_list(F.struct("at", local(F.col("member")).alias("m")))).alias("c"))
    chains = steps.select(key, F.concat(F.lit("ObjectPropertyChain("), F.array_join("c.m", ","), F.lit("->"), local(F.col("above")), F.lit(")")).alias("axiom"))
    flat = F.trim(F.regexp_replace("axiom", r"\s+", " "))
    return plain.union(chains).select(key, flat.alias("axiom")).where("axiom <> ''").distinct()


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file or a folder of them, each a group or a list of groups: the columns of ``GROUP`` and source_name."""
    return spark.read.schema(GROUP).option("multiLine", True).json(path).withColumn("source_name", F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.json)?$", 1))


def group_questions(groups: DataFrame) -> DataFrame:
    """(source_name, group_index, qa_index, task_type, context, ...): one row for each question of each group of a source.

    Groups are numbered within their source in the order in which they are given (``at``, or the order of reading).
    Explanations come in canonical notation, without repeats and empty ones; where there are none, the minimum explanation
    stands in. A group without questions has no row.
    """
    from ..functions.axioms import canonical

    at = F.col("at") if "at" in groups.columns else F.monotonically_increasing_id()
    numbered = groups.withColumn("group_index", F.row_number().over(Window.partitionBy("source_name").orderBy(at)) - 1)
    each = numbered.select("source_name", "group_index", F.col("`Task Type`").alias("task_type"), F.col("`OWL Context`").alias("context"), F.posexplode("QAs").alias("qa_index", "qa"))
    none = F.array().cast("array<string>")
    clean = lambda units: F.filter(F.array_distinct(F.transform(F.coalesce(units, none), canonical)), lambda u: u != "")
    golds = F.filter(F.transform(F.coalesce(F.col("qa.Explanations"), F.array().cast("array<array<string>>")), clean), lambda g: F.size(g) > 0)
    least = clean(F.col("qa.`Minimum Explanation`"))
    text = lambda c: F.coalesce(F.col(f"qa.`{c}`"), F.lit(""))
    return each.select(
        "source_name", "group_index", "qa_index", "task_type", "context", text("Task ID").alias("task_id"), F.coalesce(F.col("qa.`NL Question`"), text("ABS Question")).alias("question"), text("SPARQL Query").alias("query"),
        text("Answer Type").alias("answer_type"), text("Answer").alias("answer"), F.when(F.size(golds) > 0, golds).when(F.size(least) > 0, F.array(least)).otherwise(F.array().cast("array<array<string>>")).alias("golds"),
    )
