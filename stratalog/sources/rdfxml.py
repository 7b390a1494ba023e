"""RDF/XML, read with the standard library's parser and written for plain graphs."""
from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

from stratalog.errors import RDFInputError
from stratalog.sources.iri import ABSOLUTE, resolve
from stratalog.terms import RDF, BNode, IRI, Literal, TripleTerm

XML = "{http://www.w3.org/XML/1998/namespace}"
R = "{" + RDF + "}"
# Names that are syntax, and so are neither nodes nor properties.
SYNTAX = frozenset(R + n for n in ("RDF", "ID", "about", "parseType", "resource", "nodeID", "datatype", "li", "aboutEach", "aboutEachPrefix", "bagID"))


def name(tag: str) -> str:
    return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag


class _Reader:
    def __init__(self, base: str | None):
        self.out: list[tuple] = []
        self.base, self.count, self.ids = base, 0, set()

    def fresh(self) -> BNode:
        self.count += 1
        return BNode(f"x{self.count}")

    def iri(self, ref: str, base: str | None) -> IRI:
        full = resolve(ref, base)
        if not ABSOLUTE.match(full):
            raise RDFInputError(f"a relative IRI without a base: {ref}")
        return IRI(full)

    def emit(self, s, p: IRI, o, reify: str | None, base: str | None) -> None:
        self.out.append((s, p, o, None))
        if reify is not None:
            r = self.by_id(reify, base)
            for q, x in (("type", IRI(RDF + "Statement")), ("subject", s), ("predicate", p), ("object", o)):
                self.out.append((r, IRI(RDF + q), x, None))

    def by_id(self, i: str, base: str | None) -> IRI:
        full = self.iri("#" + i, base)
        if full in self.ids:
            raise RDFInputError(f"rdf:ID {i!r} twice")
        self.ids.add(full)
        return full

    def node(self, e: ET.Element, lang: str | None, base: str | None):
        lang, base = e.get(XML + "lang", lang), e.get(XML + "base", base)
        if e.get(R + "about") is not None:
            s = self.iri(e.get(R + "about"), base)
        elif e.get(R + "ID") is not None:
            s = self.by_id(e.get(R + "ID"), base)
        elif e.get(R + "nodeID") is not None:
            s = BNode("n" + e.get(R + "nodeID"))
        else:
            s = self.fresh()
        if e.tag in SYNTAX:
            raise RDFInputError(f"{name(e.tag)} is no node")
        if e.tag != R + "Description":
            self.out.append((s, IRI(RDF + "type"), IRI(name(e.tag)), None))
        self.attributes(s, e, lang, base)
        li = 0
        for c in e:
            if c.tag == R + "li":
                li += 1
                self.property(s, IRI(f"{RDF}_{li}"), c, lang, base)
            else:
                if c.tag in SYNTAX or not c.tag.startswith("{"):
                    raise RDFInputError(f"{name(c.tag)} is no property")
                self.property(s, IRI(name(c.tag)), c, lang, base)
        return s

    def attributes(self, s, e: ET.Element, lang: str | None, base: str | None) -> None:
        for a, v in e.attrib.items():
            if a in SYNTAX or a.startswith(XML) or not a.startswith("{"):
                continue
            self.out.append((s, IRI(name(a)), self.iri(v, base) if a == R + "type" else Literal(v, lang or None), None))

    def property(self, s, p: IRI, e: ET.Element, lang: str | None, base: str | None) -> None:
        lang, base = e.get(XML + "lang", lang), e.get(XML + "base", base)
        how, reify = e.get(R + "parseType"), e.get(R + "ID")
        if how == "Resource":
            o = self.fresh()
            self.emit(s, p, o, reify, base)
            inner = ET.Element(R + "Description")
            inner.extend(list(e))
            for c in inner:
                self.property(o, IRI(name(c.tag)), c, lang, base)
        elif how == "Collection":
            items = [self.node(c, lang, base) for c in e]
            cells = [self.fresh() for _ in items]
            self.emit(s, p, cells[0] if cells else IRI(RDF + "nil"), reify, base)
            for k, (cell, item) in enumerate(zip(cells, items, strict=True)):
                self.out.append((cell, IRI(RDF + "first"), item, None))
                self.out.append((cell, IRI(RDF + "rest"), cells[k + 1] if k + 1 < len(cells) else IRI(RDF + "nil"), None))
        elif how is not None:
            inner = (e.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in e)
            self.emit(s, p, Literal(inner, datatype=RDF + "XMLLiteral"), reify, base)
        elif len(e):
            if len(e) > 1:
                raise RDFInputError("a property holds one node")
            self.emit(s, p, self.node(e[0], lang, base), reify, base)
        elif e.get(R + "resource") is not None or e.get(R + "nodeID") is not None or any(a not in SYNTAX and not a.startswith(XML) and a.startswith("{") for a in e.attrib):
            o = self.iri(e.get(R + "resource"), base) if e.get(R + "resource") is not None else BNode("n" + e.get(R + "nodeID")) if e.get(R + "nodeID") else self.fresh()
            self.emit(s, p, o, reify, base)
            self.attributes(o, e, lang, base)
        else:
            dt = e.get(R + "datatype")
            self.emit(s, p, Literal(e.text or "", datatype=self.iri(dt, base).value) if dt else Literal(e.text or "", lang or None), reify, base)


def read(text: str, base: str | None) -> list[tuple]:
    if re.search(r"<!(?:DOCTYPE|ENTITY)", text):
        raise RDFInputError("document types and entities are refused")
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        raise RDFInputError(f"no XML: {e}") from None
    r = _Reader(base)
    lang, base = root.get(XML + "lang"), root.get(XML + "base", base)
    for e in root if root.tag == R + "RDF" else [root]:
        r.node(e, lang, base)
    return r.out


def write(graph) -> str:
    """One description for each triple. Triple terms and directions have no form here."""
    lines = ['<?xml version="1.0" encoding="utf-8"?>', f'<rdf:RDF xmlns:rdf="{RDF}">']
    for s, p, o in graph:
        if isinstance(o, TripleTerm) or (isinstance(o, Literal) and o.direction):
            raise ValueError("RDF/XML has no triple terms or directions")
        m = re.fullmatch(r"(.*?)([A-Za-z_][A-Za-z0-9_.-]*)", p.value, re.S)
        if not m:
            raise ValueError(f"RDF/XML has no form for the predicate {p.value}")
        about = f"rdf:about={quoteattr(s.value)}" if isinstance(s, IRI) else f"rdf:nodeID={quoteattr(s.label)}"
        tag = f"p:{m[2]} xmlns:p={quoteattr(m[1])}"
        if isinstance(o, IRI):
            prop = f"<{tag} rdf:resource={quoteattr(o.value)}/>"
        elif isinstance(o, BNode):
            prop = f"<{tag} rdf:nodeID={quoteattr(o.label)}/>"
        else:
            extra = f" xml:lang={quoteattr(o.lang)}" if o.lang else f" rdf:datatype={quoteattr(o.datatype)}" if o.datatype else ""
            prop = f"<{tag}{extra}>{escape(o.value, {chr(13): '&#13;'})}</p:{m[2]}>"
        lines.append(f"  <rdf:Description {about}>{prop}</rdf:Description>")
    return "\n".join([*lines, "</rdf:RDF>"]) + "\n"
