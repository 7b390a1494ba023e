"""JSON-LD with inline contexts: expansion of the common keywords to quads, and a flat writer."""
from __future__ import annotations

import json
import math

from stratalog.errors import RDFInputError
from stratalog.functions.values import float_text
from stratalog.sources.iri import ABSOLUTE, resolve
from stratalog.terms import RDF, XSD, BNode, IRI, Literal, TripleTerm

JSON = RDF + "JSON"


class _Number(str):
    """A JSON number by its own digits."""


class _Context:
    def __init__(self, base: str | None):
        self.base, self.vocab, self.lang, self.direction, self.terms = base, None, None, None, {}
        #: What nodes inside go back to, under a type's context.
        self.previous: _Context | None = None

    def for_types(self, types: list[str]) -> _Context:
        """With the contexts of the node's types, in the order of their names; they hold for this node alone."""
        out = self
        for t in sorted(t for t in types if isinstance(t, str)):
            if "@context" in self.terms.get(t, ()):
                out = out.extended(self.terms[t]["@context"])
        if out is not self:
            out.previous = self
        return out

    def for_property(self, definition: dict) -> _Context:
        """With a property's own context, which holds for all below it."""
        return (self.previous or self).extended(definition["@context"]) if "@context" in definition else self

    def extended(self, c) -> _Context:
        out = _Context(self.base)
        out.__dict__.update({**self.__dict__, "terms": dict(self.terms)})
        for part in c if isinstance(c, list) else [c]:
            if part is None:
                out = _Context(self.base)
                continue
            if isinstance(part, str):
                raise RDFInputError(f"remote contexts are refused: {part}")
            if "@import" in part:
                raise RDFInputError("@import is refused")
            for k, v in part.items():
                if k == "@base":
                    out.base = resolve(v, out.base) if v is not None else None
                elif k == "@vocab":
                    out.vocab = v
                elif k == "@language":
                    out.lang = v
                elif k == "@direction":
                    out.direction = v
                elif not k.startswith("@"):
                    out.terms[k] = {"@id": v} if isinstance(v, str) or v is None else dict(v)
        return out

    def iri(self, x: str, vocab: bool) -> str | None:
        if x.startswith("@"):
            return x
        if vocab and x in self.terms:
            i = self.terms[x].get("@id", x)
            if i is None:
                return None
            return i if i.startswith("@") else self.iri(i, True) if i != x else self.prefixed(x) or ((self.vocab or "") + x)
        full = self.prefixed(x)
        if full:
            return full
        if vocab and self.vocab is not None:
            return self.vocab + x
        return resolve(x, self.base)

    def prefixed(self, x: str) -> str | None:
        if x.startswith("_:"):
            return x
        p, colon, rest = x.partition(":")
        if not colon:
            return None
        if not rest.startswith("//") and p in self.terms and self.terms[p].get("@id"):
            return self.iri(p, True) + rest
        return x if ABSOLUTE.match(x) else None


class _Reader:
    def __init__(self):
        self.out, self.count = [], 0

    def fresh(self) -> BNode:
        self.count += 1
        return BNode(f"j{self.count}")

    def node_term(self, x: str | None):
        if x is None:
            return None
        if x.startswith("_:"):
            return BNode("l" + x[2:])
        return IRI(x) if ABSOLUTE.match(x) else None

    def node(self, obj: dict, ctx: _Context, graph):
        ctx = ctx.previous or ctx
        if "@context" in obj:
            ctx = ctx.extended(obj["@context"])
        kinds = next((v for k, v in obj.items() if ctx.iri(k, True) == "@type"), [])
        plain_ctx, ctx = ctx, ctx.for_types(kinds if isinstance(kinds, list) else [kinds])
        names = {k: ctx.iri(k, True) for k in obj}
        at = lambda w: next((obj[k] for k, n in names.items() if n == w), None)
        ident = at("@id")
        s = self.node_term(ctx.iri(ident, False)) if ident is not None else self.fresh()
        if s is None:
            return None
        if (inner := at("@graph")) is not None:
            for x in inner if isinstance(inner, list) else [inner]:
                self.node(x, ctx, s)
        for t in (lambda v: v if isinstance(v, list) else [v])(at("@type") or []):
            if (o := self.node_term(plain_ctx.iri(t, True))) is not None:
                self.out.append((s, IRI(RDF + "type"), o, graph))
        for back, values in (at("@reverse") or {}).items():
            p = self.node_term(ctx.iri(back, True))
            for v in values if isinstance(values, list) else [values]:
                o = self.node(v if isinstance(v, dict) else {"@id": v}, ctx, graph)
                if isinstance(p, IRI) and o is not None:
                    self.out.append((o, p, s, graph))
        for k, v in obj.items():
            p = self.node_term(names[k]) if names[k] and not names[k].startswith("@") else None
            if isinstance(p, IRI):
                definition = ctx.terms.get(k, {})
                if definition.get("@reverse"):
                    continue
                for o in self.values(v, definition, ctx.for_property(definition), graph):
                    self.out.append((s, p, o, graph))
        return s

    def values(self, v, definition: dict, ctx: _Context, graph) -> list:
        box = definition.get("@container")
        if definition.get("@type") == "@json":
            return [Literal(json.dumps(plain(v), ensure_ascii=False, separators=(",", ":"), sort_keys=True), datatype=JSON)]
        if box == "@language" and isinstance(v, dict):
            return [Literal(x, None if lang == "@none" else lang) for lang, xs in v.items() for x in (xs if isinstance(xs, list) else [xs]) if x is not None]
        if box == "@list" and not (isinstance(v, dict) and "@list" in v):
            return [self.list(v if isinstance(v, list) else [v], definition, ctx, graph)]
        out = []
        for x in v if isinstance(v, list) else [v]:
            out += self.value(x, definition, ctx, graph)
        return out

    def list(self, items: list, definition: dict, ctx: _Context, graph):
        found = [o for x in items for o in self.value(x, {k: v for k, v in definition.items() if k != "@container"}, ctx, graph)]
        head = IRI(RDF + "nil")
        for o in reversed(found):
            cell = self.fresh()
            self.out += [(cell, IRI(RDF + "first"), o, graph), (cell, IRI(RDF + "rest"), head, graph)]
            head = cell
        return head

    def value(self, x, definition: dict, ctx: _Context, graph) -> list:
        kind = definition.get("@type")
        if x is None:
            return []
        if isinstance(x, dict):
            names = {ctx.iri(k, True): k for k in x}
            if "@list" in names:
                items = x[names["@list"]]
                return [self.list(items if isinstance(items, list) else [items], definition, ctx, graph)]
            if "@set" in names:
                return self.values(x[names["@set"]], {k: v for k, v in definition.items() if k != "@container"}, ctx, graph)
            if "@value" in names:
                raw, dt = x[names["@value"]], x.get(names.get("@type"))
                if dt == "@json":
                    return [Literal(json.dumps(plain(raw), ensure_ascii=False, separators=(",", ":"), sort_keys=True), datatype=JSON)]
                if raw is None:
                    return []
                return [self.literal(raw, ctx.iri(dt, True) if dt else None, x.get(names.get("@language")), x.get(names.get("@direction")))]
            s = self.node(x, ctx, graph)
            return [s] if s is not None else []
        if kind in ("@id", "@vocab") and isinstance(x, str) and not isinstance(x, _Number):
            t = self.node_term(ctx.iri(x, kind == "@vocab"))
            return [t] if t is not None else []
        dt = ctx.iri(kind, True) if kind and not kind.startswith("@") else None
        string = isinstance(x, str) and not isinstance(x, _Number)
        lang = definition.get("@language", ctx.lang) if string and not dt else None
        return [self.literal(x, dt, lang, definition.get("@direction", ctx.direction) if lang else None)]

    def literal(self, x, dt: str | None, lang: str | None, direction: str | None) -> Literal:
        if isinstance(x, bool):
            return Literal("true" if x else "false", datatype=dt or XSD + "boolean")
        if isinstance(x, _Number):
            f = float(x)
            whole = f == math.floor(f) and abs(f) < 1e21 and dt != XSD + "double"
            return Literal(str(int(f)) if whole and not x.lstrip("-").isdigit() else str(x) if whole else float_text(f).replace("e+", "E").replace("e", "E"), datatype=dt or XSD + ("integer" if whole else "double"))
        return Literal(str(x), lang, direction if lang else None, None if lang else dt)


def plain(v):
    if isinstance(v, _Number):
        return json.loads(v)
    if isinstance(v, list):
        return [plain(x) for x in v]
    return {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else v


def read(text: str, base: str | None) -> list[tuple]:
    try:
        doc = json.loads(text, parse_int=_Number, parse_float=_Number)
    except ValueError as e:
        raise RDFInputError(f"no JSON: {e}") from None
    r, ctx = _Reader(), _Context(base)
    for x in doc if isinstance(doc, list) else [doc]:
        if not isinstance(x, dict):
            raise RDFInputError("a document is an object or an array of objects")
        names = {ctx.extended(x.get("@context", {})).iri(k, True) for k in x}
        if names <= {"@context", "@graph"} and "@graph" in names:
            inner = ctx.extended(x.get("@context", {}))
            for y in (lambda v: v if isinstance(v, list) else [v])(next(v for k, v in x.items() if inner.iri(k, True) == "@graph")):
                r.node(y, inner, None)
        else:
            r.node(x, ctx, None)
    return r.out


def write(graph) -> str:
    """A flat array of node objects with lexical forms kept. Triple terms and directions have no form here."""
    nodes: dict[str, dict] = {}
    ident = lambda t: t.value if isinstance(t, IRI) else "_:" + t.label
    for s, p, o in graph:
        if isinstance(o, TripleTerm) or (isinstance(o, Literal) and o.direction):
            raise ValueError("JSON-LD has no triple terms here, and no directions")
        n = nodes.setdefault(ident(s), {"@id": ident(s)})
        if isinstance(o, Literal):
            v = {"@value": o.value} | ({"@language": o.lang} if o.lang else {"@type": o.datatype} if o.datatype else {})
        else:
            v = {"@id": ident(o)}
        if p.value == RDF + "type" and not isinstance(o, Literal):
            n.setdefault("@type", []).append(ident(o))
        else:
            n.setdefault(p.value, []).append(v)
    return json.dumps(list(nodes.values()), ensure_ascii=False, indent=2) + "\n"
