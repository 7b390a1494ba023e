"""Graphs: parsed documents on the driver, mapped tables and triple tables as DataFrames."""
from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from stratalog.errors import ParseError, RDFInputError
from stratalog.sources.turtle import LineParser, TrigParser, TurtleParser
from stratalog.terms import BNode, IRI, Literal, Term, Triple, TripleTerm, is_triple, nt

FORMATS = {"turtle": "turtle", "ttl": "turtle", "nt": "nt", "ntriples": "nt", "rdfxml": "rdfxml", "xml": "rdfxml", "jsonld": "jsonld", "json-ld": "jsonld", "trig": "trig", "nquads": "nquads", "nq": "nquads"}


def scoped(t: Term, scope: str) -> Term:
    if isinstance(t, BNode):
        return BNode(scope + t.label)
    if isinstance(t, TripleTerm):
        return TripleTerm(scoped(t.subject, scope), t.predicate, scoped(t.object, scope))
    return t


def standardized(triples: Iterable[Triple], scope: str | None = None) -> tuple[Triple, ...]:
    """Triples with blank nodes renamed apart from all others."""
    scope = f"{scope or 'm'}x{uuid.uuid4().hex[:12]}x"
    return tuple((scoped(s, scope), p, scoped(o, scope)) for s, p, o in triples)


class Graph:
    """A set of triples on the driver, in order of arrival."""

    def __init__(self, triples: Iterable[Triple] = ()):
        self._triples: dict[Triple, None] = {}
        self.update(triples)

    def add(self, triple: Triple) -> bool:
        if len(triple) != 3 or not is_triple(*triple):
            raise RDFInputError("not an RDF triple: " + " ".join(map(str, triple)))
        new = triple not in self._triples
        self._triples[triple] = None
        return new

    def update(self, triples: Iterable[Triple]) -> None:
        for t in triples:
            self.add(t)

    def triples(self, pattern: tuple = (None, None, None)):
        return (t for t in self._triples if all(p is None or p == x for p, x in zip(pattern, t, strict=True)))

    def __iter__(self):
        return iter(self._triples)

    def __len__(self) -> int:
        return len(self._triples)

    def __contains__(self, t: object) -> bool:
        return t in self._triples

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Graph) and set(self._triples) == set(other._triples)

    __hash__ = None

    def serialize(self, format: str = "turtle") -> str:
        kind = FORMATS.get(format)
        if kind in ("turtle", "nt"):
            return "".join(f"{nt(s)} {nt(p)} {nt(o)} .\n" for s, p, o in self)
        if kind in ("rdfxml", "jsonld"):
            from stratalog.sources import jsonld, rdfxml

            return (rdfxml if kind == "rdfxml" else jsonld).write(self)
        raise ValueError(f"unsupported output format {format!r}")


def quads(text: str, format: str, base: str | None, source: str) -> list[tuple]:
    kind = FORMATS.get(format)
    if kind == "turtle":
        return [(*t, None) for t in TurtleParser(text, base, source).document()]
    if kind == "trig":
        return TrigParser(text, base, source).document()
    if kind in ("nt", "nquads"):
        return LineParser(text, base, source).quads(kind == "nquads")
    if kind in ("rdfxml", "jsonld"):
        from stratalog.sources import jsonld, rdfxml

        return (rdfxml if kind == "rdfxml" else jsonld).read(text, base)
    raise ValueError(f"unsupported format {format!r}")


def parse_data(text: str, format: str = "turtle", base_iri: str | None = None, source_name: str = "<data>", dataset_policy: str = "error") -> Graph:
    """Parse a document. dataset_policy: 'error' refuses named graphs with triples, 'union' merges them."""
    if dataset_policy not in ("error", "union"):
        raise ValueError("dataset_policy is 'error' or 'union'")
    found = quads(text, format, base_iri, source_name)
    if dataset_policy == "error" and any(g is not None for *_, g in found):
        raise RDFInputError("the document has named graphs; choose the union policy to merge them")
    return Graph((s, p, o) for s, p, o, _ in found)


def merge_graphs(graphs: Iterable[Graph]) -> Graph:
    """Union with blank nodes standardised apart."""
    graphs = list(graphs)
    return graphs[0] if len(graphs) == 1 else Graph(t for k, g in enumerate(graphs) for t in standardized(g, f"g{k}"))


def read_ntriples(spark: SparkSession, path: str, four: bool = False) -> DataFrame:
    """A large N-Triples or N-Quads file as keys (s, p, o[, g]), parsed where its lines lie."""
    from stratalog.terms import key

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = LineParser("\n".join(b["value"]), None, path).quads(four)
            yield pd.DataFrame([[key(x) if x is not None else None for x in (r if four else r[:3])] for r in rows], columns=list("spog")[: 3 + four], dtype=object)

    return spark.read.text(path).mapInPandas(run, "s string, p string, o string" + (", g string" if four else "")).distinct()


__all__ = ["FORMATS", "Graph", "IRI", "Literal", "ParseError", "merge_graphs", "parse_data", "read_ntriples", "standardized"]
