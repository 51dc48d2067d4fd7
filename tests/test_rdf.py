"""Turtle and RDF/XML, list folding, axioms, and group files."""

import json

import pytest

from lodestrand.sources import rdf

HEAD = "@prefix e: <http://e.org/a#> .\n@prefix owl: <http://www.w3.org/2002/07/owl#> .\nPREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#>\n"
TURTLE = HEAD + """
# a comment with <signs> ; and .
e:ann a e:Person , owl:NamedIndividual ; e:likes e:bob , <http://e.org/b/carl> ; rdfs:comment "says \\"hi\\"; all."@en .
e:likes a owl:SymmetricProperty ; rdfs:domain e:Person ; rdfs:range e:Person ; rdfs:subPropertyOf e:knows .
e:hates owl:inverseOf e:hatedBy . e:hates owl:equivalentProperty e:loathes .
e:Person rdfs:subClassOf e:Agent ; rdfs:subClassOf [ a owl:Restriction ; owl:onProperty e:likes ; owl:minCardinality 1 ] .
e:aunt owl:propertyChainAxiom ( e:parent e:sister ) .
e:far owl:propertyChainAxiom ( e:p1 e:p2 [ owl:inverseOf e:p3 ] e:p4 e:p5 ) .
"""
AXIOMS = {
    "ann rdf:type Person", "ann likes bob", "ann likes carl", "SymmetricObjectProperty(likes)", "likes domain Person", "likes range Person", "SubObjectPropertyOf(likes,knows)",
    "InverseObjectProperties(hates,hatedBy)", "EquivalentObjectProperties(hates,loathes)", "Person SubClassOf Agent", "ObjectPropertyChain(parent,sister->aunt)", "ObjectPropertyChain(p1,p2,p4,p5->far)",
}
XML = """<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:e="http://e.org/a#">
<e:Person rdf:about="http://e.org/a#ann"><e:likes rdf:resource="http://e.org/a#bob"/><rdfs:comment>text</rdfs:comment></e:Person>
<owl:TransitiveProperty rdf:about="http://e.org/a#partOf"/>
<rdf:Description rdf:about="http://e.org/a#aunt"><owl:propertyChainAxiom rdf:parseType="Collection"><rdf:Description rdf:about="http://e.org/a#parent"/><rdf:Description rdf:about="http://e.org/a#sister"/></owl:propertyChainAxiom></rdf:Description>
</rdf:RDF>"""


def axioms(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    out = {k: set() for k in range(len(texts))}
    for r in rdf.axioms(rdf.stored(rdf.triples(df, "k", "text")), "k").collect():
        assert r["axiom"] not in out[r["k"]]
        out[r["k"]].add(r["axiom"])
    return out


def test_axioms_of_turtle_and_xml(spark):
    got = axioms(spark, TURTLE, XML, None, " ", "﻿" + HEAD)
    assert got[0] == AXIOMS
    assert got[1] == {"ann rdf:type Person", "ann likes bob", "TransitiveObjectProperty(partOf)", "ObjectPropertyChain(parent,sister->aunt)"}
    assert not got[2] and not got[3] and not got[4]


def test_long_lists_keep_their_order(spark):
    names = [[f"p{k}" for k in range(n)] for n in (1, 2, 3, 17, 100)]
    text = HEAD + "\n".join(f"e:s{len(n)} owl:propertyChainAxiom ( {' '.join('e:' + x for x in n)} ) ." for n in names)
    assert axioms(spark, text)[0] == {f"ObjectPropertyChain({','.join(n)}->s{len(n)})" for n in names}


def test_a_list_in_a_circle_raises(spark):
    n = lambda k: f"_:c{k}"
    facts = [(0, n(k), "blank", rdf.RDF + p, o, "blank") for k in range(3) for p, o in (("first", "x"), ("rest", n((k + 1) % 3)))]
    df = spark.createDataFrame(facts, "k int, s string, s_kind string, p string, o string, o_kind string")
    with pytest.raises(ValueError, match="list"):
        rdf.list_members(df, "k", 3).collect()


@pytest.mark.parametrize("text", ["e:a e:b e:c .", HEAD + "e:a e:b", HEAD + "e:a e:b ; .", HEAD + "e:a ( e:b .", "<?xml version='1.0'?><a>"])
def test_other_texts_raise(text):
    with pytest.raises(ValueError, match="neither"):
        rdf.parse(text)


def test_group_files(spark, tmp_path):
    qa = {"Task ID": "t1", "NL Question": "Is it?", "SPARQL Query": "ASK {}", "Answer Type": "BIN", "Answer": "TRUE", "Explanations": [["a rdfs:subPropertyOf b", "TAG: x"], []], "Minimum Explanation": ["Symmetric: p"]}
    groups = [{"Task Type": "T", "OWL Context": TURTLE, "QAs": [qa, {**qa, "Task ID": "t2", "Explanations": None}]}, {"Task Type": "U", "OWL Context": XML, "QAs": []}, {"Task Type": "V", "OWL Context": "", "QAs": [{"ABS Question": "What?"}]}]
    (tmp_path / "one.json").write_text(json.dumps(groups))
    rows = sorted(rdf.group_questions(rdf.read_groups(spark, str(tmp_path))).collect(), key=lambda r: (r["group_index"], r["qa_index"]))
    assert [(r["source_name"], r["group_index"], r["qa_index"], r["task_type"], r["question"]) for r in rows] == [("one", 0, 0, "T", "Is it?"), ("one", 0, 1, "T", "Is it?"), ("one", 2, 0, "V", "What?")]
    assert [r["golds"] for r in rows] == [[["SubObjectPropertyOf(a,b)"]], [["SymmetricObjectProperty(p)"]], []]
