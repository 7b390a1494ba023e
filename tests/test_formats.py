import json

import pytest

from stratalog.errors import ParseError, RDFInputError
from stratalog.sources.graph import Graph, merge_graphs, parse_data
from stratalog.sources.isomorphism import isomorphic
from stratalog.terms import IRI, BNode, Literal, TripleTerm

INT = "http://www.w3.org/2001/XMLSchema#integer"
ONE = (IRI("http://x/s"), IRI("http://x/p"), Literal("01", datatype=INT))


@pytest.mark.parametrize("format, text", [
    ("turtle", f'<http://x/s> <http://x/p> "01"^^<{INT}> .'), ("nt", f'<http://x/s> <http://x/p> "01"^^<{INT}> .\n'), ("nquads", f'<http://x/s> <http://x/p> "01"^^<{INT}> .'), ("trig", f'PREFIX : <http://x/> {{ :s :p "01"^^<{INT}> }}'),
    ("rdfxml", f'<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://x/"><rdf:Description rdf:about="http://x/s"><e:p rdf:datatype="{INT}">01</e:p></rdf:Description></rdf:RDF>'),
    ("jsonld", json.dumps({"@context": {"p": {"@id": "http://x/p", "@type": INT}}, "@id": "http://x/s", "p": "01"})),
])
def test_same_triple(format, text):
    g = parse_data(text, format)
    assert list(g) == [ONE]
    for out in ("turtle", "nt", "rdfxml", "jsonld"):
        assert parse_data(g.serialize(out), out) == g


def test_turtle():
    g = parse_data('@prefix : <http://x/> . :a :b [ :c "x"@en--rtl, 1.5, true ], ( :d ) . << :a :b :c >> :e <<( :f :g :h )>> .', base_iri="http://b/")
    assert len(g) == 9 and any(isinstance(o, TripleTerm) for _, _, o in g) and parse_data(g.serialize()) == g
    assert list(parse_data("<s> <p> <../o> .", base_iri="http://b/c/d"))[0][2] == IRI("http://b/o")


@pytest.mark.parametrize("format, text", [
    ("turtle", "<http://a> <http://b> ."), ("turtle", "<http://a> <http://b> <c> ."), ("turtle", '"s" <http://b> <http://c> .'), ("turtle", ":a :b :c ."), ("turtle", "<http://a> <http://b> 'x\\z' ."), ("turtle", "<http://a b> <http://b> 1 ."),
    ("nt", "<http://a> <http://b> 1 ."), ("nt", "<http://a> <http://b> <c> ."), ("nt", "<http://a> <http://b>\n<http://c> ."), ("nt", "<http://a> <http://b> <http://c> . <http://a> <http://b> <http://d> ."), ("turtle", "<http://a> <http://b> TRUE ."),
])
def test_rejected(format, text):
    with pytest.raises(ParseError):
        parse_data(text, format)


def test_datasets():
    text = "<http://g> { <http://a> <http://b> <http://c> }"
    with pytest.raises(RDFInputError):
        parse_data(text, "trig")
    assert len(parse_data(text, "trig", dataset_policy="union")) == 1
    with pytest.raises(ValueError):
        parse_data("", "other")
    for bad in ('<!DOCTYPE x><a/>', "<a"):
        with pytest.raises(RDFInputError):
            parse_data(bad, "rdfxml")
    with pytest.raises(RDFInputError):
        parse_data('{"@context": "http://remote", "a": 1}', "jsonld")


def test_jsonld():
    g = parse_data(json.dumps({"@context": {"@vocab": "http://v/", "n": {"@type": "@id"}, "l": {"@container": "@list"}, "t": {"@container": "@language"}}, "@graph": [{"@id": "http://s", "@type": "T", "a": [1, 2.5, True, {"@value": "x", "@language": "fr"}], "n": "http://o", "l": [1], "t": {"en": "hi"}, "k": {"b": "y"}}]}), "jsonld")
    assert len(g) == 12 and (IRI("http://s"), IRI("http://v/a"), Literal("x", "fr")) in g and (IRI("http://s"), IRI("http://v/n"), IRI("http://o")) in g


def test_merge_and_isomorphism():
    a = parse_data("_:x <http://p> _:y . _:y <http://p> _:x .")
    b = parse_data("_:q <http://p> _:r . _:r <http://p> _:q .")
    assert isomorphic(a, b) and len(merge_graphs([a, b])) == 4 and not isomorphic(a, parse_data("_:q <http://p> _:r . _:q <http://p> _:q ."))
    with pytest.raises(RDFInputError):
        Graph([(Literal("x"), IRI("p"), BNode("o"))])


def test_large_ntriples(spark, tmp_path):
    from stratalog.sources.graph import read_ntriples
    from stratalog.sources.results import write_ntriples

    f = tmp_path / "in.nt"
    lines = [f'<http://a{i}> <http://p> "x\\n{i}"@en .' for i in range(20)] + ["<http://a> <http://p> <<( <http://b> <http://c> _:d )>> ."]
    f.write_text("\n".join(lines) + "\n")
    df = read_ntriples(spark, str(f))
    write_ntriples(df, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == sorted(lines)


def test_jsonld_scoped_contexts():
    doc = """{"@context": {"@vocab": "http://v/", "Person": {"@id": "http://t/Person", "@context": {"name": "http://p/name", "boss": {"@id": "http://p/boss", "@type": "@id"}}},
      "meta": {"@id": "http://p/meta", "@context": {"name": "http://m/name"}}},
      "@id": "http://x/a", "@type": "Person", "name": "A", "boss": "http://x/b", "friend": {"@id": "http://x/c", "name": "C"},
      "meta": {"@id": "http://x/m", "name": "M", "deep": {"@id": "http://x/d", "name": "D", "@context": {"name": "http://n/name"}}}}"""
    found = {(s.value[9:], p.value, getattr(o, "value", None)) for s, p, o in parse_data(doc, "jsonld")}
    assert found == {
        ("a", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://t/Person"), ("a", "http://p/name", "A"), ("a", "http://p/boss", "http://x/b"), ("a", "http://v/friend", "http://x/c"),
        ("c", "http://v/name", "C"), ("a", "http://p/meta", "http://x/m"), ("m", "http://m/name", "M"), ("m", "http://v/deep", "http://x/d"), ("d", "http://n/name", "D"),
    }
