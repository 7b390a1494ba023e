"""RDF terms, and the one-string form in which DataFrames hold them.

A term's key is injective, so joins on keys are joins on terms:

    I<iri>    B<label>    L<datatype>\\x01<language>\\x01<direction>\\x01<lexical form>
    T<length of s>:<s><length of p>:<p><o>      (s, p, o are keys)
"""
from __future__ import annotations

import re
from dataclasses import dataclass

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
LANG_STRING, DIR_LANG_STRING = RDF + "langString", RDF + "dirLangString"
STRING = XSD + "string"


@dataclass(frozen=True)
class IRI:
    value: str


@dataclass(frozen=True)
class BNode:
    label: str


@dataclass(frozen=True)
class Literal:
    value: str
    lang: str | None = None
    direction: str | None = None
    datatype: str | None = None

    def __post_init__(self) -> None:
        put = lambda k, v: object.__setattr__(self, k, v)
        if self.lang is not None:
            if not self.lang:
                raise ValueError("a language tag may not be empty")
            put("lang", self.lang.lower())
            put("datatype", None)
            if self.direction not in (None, "ltr", "rtl"):
                raise ValueError("a direction is ltr or rtl")
        elif self.direction is not None:
            raise ValueError("a direction needs a language tag")
        elif self.datatype in (LANG_STRING, DIR_LANG_STRING):
            raise ValueError("this datatype needs a language tag")
        elif self.datatype == STRING:
            put("datatype", None)


@dataclass(frozen=True)
class TripleTerm:
    subject: Term
    predicate: Term
    object: Term


@dataclass(frozen=True)
class Variable:
    """A query variable; names that begin with '@' are internal."""

    value: str


Term = IRI | BNode | Literal | TripleTerm | Variable
Triple = tuple[Term, Term, Term]


def key(t: Term) -> str:
    if isinstance(t, IRI):
        return "I" + t.value
    if isinstance(t, BNode):
        return "B" + t.label
    if isinstance(t, Literal):
        return "L" + "\x01".join((t.datatype or "", t.lang or "", t.direction or "", t.value))
    if isinstance(t, TripleTerm):
        s, p = key(t.subject), key(t.predicate)
        return f"T{len(s)}:{s}{len(p)}:{p}{key(t.object)}"
    raise TypeError(f"no ground term: {t!r}")


def term(k: str) -> Term:
    kind, rest = k[0], k[1:]
    if kind == "I":
        return IRI(rest)
    if kind == "B":
        return BNode(rest)
    if kind == "L":
        dt, lang, direction, lex = rest.split("\x01", 3)
        return Literal(lex, lang or None, direction or None, dt or None)
    parts = []
    for _ in range(2):
        n, rest = rest.split(":", 1)
        parts.append(rest[: int(n)])
        rest = rest[int(n) :]
    return TripleTerm(term(parts[0]), term(parts[1]), term(rest))


def is_object(t: Term) -> bool:
    return is_triple(t.subject, t.predicate, t.object) if isinstance(t, TripleTerm) else isinstance(t, (IRI, BNode, Literal))


def is_triple(s: Term, p: Term, o: Term) -> bool:
    """Whether these terms may form an RDF triple; triple terms stand in object position only."""
    return isinstance(s, (IRI, BNode)) and isinstance(p, IRI) and is_object(o)


def variables(t: object) -> set[Variable]:
    """Variables of a term; blank nodes of patterns are variables by now."""
    if isinstance(t, Variable):
        return {t}
    if isinstance(t, TripleTerm):
        return variables(t.subject) | variables(t.predicate) | variables(t.object)
    return set()


_ESCAPE = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
_TO_ESCAPE = re.compile('[\\\\"\x00-\x1f\x7f]')
_IN_IRI = re.compile('[\x00-\x20<>"{}|^`\\\\]')


def nt(t: Term) -> str:
    """N-Triples form."""
    if isinstance(t, IRI):
        return "<" + _IN_IRI.sub(lambda m: f"\\u{ord(m[0]):04X}", t.value) + ">"
    if isinstance(t, BNode):
        return "_:" + t.label
    if isinstance(t, TripleTerm):
        return f"<<( {nt(t.subject)} {nt(t.predicate)} {nt(t.object)} )>>"
    if isinstance(t, Variable):
        return "?" + t.value
    text = '"' + _TO_ESCAPE.sub(lambda m: _ESCAPE.get(m[0]) or f"\\u{ord(m[0]):04X}", t.value) + '"'
    if t.lang:
        return f"{text}@{t.lang}" + (f"--{t.direction}" if t.direction else "")
    return text + (f"^^{nt(IRI(t.datatype))}" if t.datatype else "")
