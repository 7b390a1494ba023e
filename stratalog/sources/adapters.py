"""Terms and triples of other RDF libraries, known by the names of their classes: nothing is imported."""
from __future__ import annotations

from collections.abc import Iterable, Iterator

from stratalog.terms import BNode, IRI, Literal, Term, Triple, TripleTerm


def as_term(x: object) -> Term:
    """A term from one of another library: URIRef, IRI or NamedNode, BNode or BlankNode, Literal, or three terms for a triple term."""
    if isinstance(x, (IRI, BNode, Literal, TripleTerm)):
        return x
    names = {c.__name__ for c in type(x).__mro__}
    text = str(getattr(x, "value", x))
    if names & {"URIRef", "IRI", "NamedNode"}:
        return IRI(text)
    if names & {"BNode", "BlankNode"}:
        return BNode(text.removeprefix("_:"))
    if "Literal" in names:
        lang, datatype = getattr(x, "language", None) or getattr(x, "lang", None), getattr(x, "datatype", None)
        lexical = str(x) if isinstance(x, str) else text
        return Literal(lexical, str(lang) if lang else None, getattr(x, "direction", None), str(getattr(datatype, "value", datatype)) if datatype and not lang else None)
    parts = (x.subject, x.predicate, x.object) if all(hasattr(x, k) for k in ("subject", "predicate", "object")) else x
    if isinstance(parts, tuple) and len(parts) == 3:
        return TripleTerm(*map(as_term, parts))
    raise TypeError(f"no RDF term: {x!r}")


def as_triples(rows: Iterable) -> Iterator[Triple]:
    return (tuple(map(as_term, row)) for row in rows)
