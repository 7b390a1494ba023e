"""Turtle 1.2, TriG, N-Triples and N-Quads: one recursive-descent parser with a hook for verbs."""
from __future__ import annotations

import re

from stratalog.errors import ParseError
from stratalog.sources.iri import ABSOLUTE, BAD, resolve
from stratalog.sources.lexer import Token, position, tokens, unescape
from stratalog.terms import RDF, XSD, BNode, IRI, Literal, Term, Triple, TripleTerm, Variable

FIRST, REST, NIL, TYPE, REIFIES = (IRI(RDF + x) for x in ("first", "rest", "nil", "type", "reifies"))


class TermParser:
    """Cursor, prefixes, and the terms and triples that data and rule documents share."""

    variables_allowed = False

    def __init__(self, text: str, base: str | None = None, source: str = "<text>"):
        self.text, self.source, self.base = text, source, base
        self.toks = tokens(text, source)
        self.i = 0
        self.prefixes: dict[str, str] = {}
        self.out: list[Triple] = []
        self.used = {t.text[2:] for t in self.toks if t.kind == "blank"}
        self.count = 0
        self.in_term = False

    # cursor

    @property
    def tok(self) -> Token:
        return self.toks[self.i]

    def fail(self, message: str, tok: Token | None = None) -> ParseError:
        return ParseError(message, self.source, *position(self.text, (tok or self.tok).at))

    def at(self, *marks: str) -> bool:
        return self.tok.kind == "mark" and self.tok.text in marks

    def word(self, *names: str) -> bool:
        return self.tok.kind == "word" and self.tok.text.upper() in names

    def take(self) -> Token:
        t = self.tok
        self.i += 1
        return t

    def accept(self, *marks: str) -> bool:
        if self.at(*marks):
            self.i += 1
            return True
        return False

    def expect(self, mark: str) -> None:
        if not self.accept(mark):
            raise self.fail(f"expected {mark!r}, found {self.tok.text or 'the end'!r}")

    def fresh(self) -> BNode:
        while True:
            self.count += 1
            label = f"genid{self.count}"
            if label not in self.used:
                self.used.add(label)
                return BNode(label)

    # prologue

    def directive(self, at_form: bool, version: str | None = None) -> bool:
        """PREFIX, BASE or VERSION, and their @ forms if allowed."""
        t = self.tok
        dotted = at_form and t.kind == "lang" and t.text in ("@prefix", "@base", "@version")
        if not dotted and not self.word("PREFIX", "BASE", "VERSION"):
            return False
        # A bare word may also be a prefix-less name; only these three begin a directive.
        self.i += 1
        what = t.text.lstrip("@").upper()
        if what == "PREFIX":
            n = self.take()
            if n.kind != "name" or not n.text.endswith(":"):
                raise self.fail("expected a prefix", n)
            self.prefixes[n.text[:-1]] = self.iri_ref()
        elif what == "BASE":
            self.base = self.iri_ref()
        else:
            s = self.take()
            if s.kind != "string" or s.text[:3] in ('"""', "'''"):
                raise self.fail("expected a version string", s)
            if version is not None and s.text[1:-1] != version:
                raise self.fail(f"unsupported version {s.text}", s)
        if dotted:
            self.expect(".")
        return True

    def iri_ref(self) -> str:
        t = self.take()
        if t.kind != "iri":
            raise self.fail("expected an IRI", t)
        return self.full_iri(t)

    def full_iri(self, t: Token) -> str:
        try:
            raw = unescape(t.text[1:-1], full=False)
        except ValueError as e:
            raise self.fail(str(e), t) from None
        if BAD.search(raw):
            raise self.fail("a character that IRIs may not hold", t)
        out = resolve(raw, self.base)
        if not ABSOLUTE.match(out):
            raise self.fail("a relative IRI without a base", t)
        return out

    def pname(self, t: Token) -> IRI:
        prefix, _, local = t.text.partition(":")
        if prefix not in self.prefixes:
            raise self.fail(f"unknown prefix {prefix}:", t)
        return IRI(self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local))

    # terms

    def iri(self) -> IRI | None:
        if self.tok.kind == "iri":
            return IRI(self.full_iri(self.take()))
        if self.tok.kind == "name":
            return self.pname(self.take())
        return None

    def string_body(self, t: Token) -> str:
        n = 3 if t.text[:3] in ('"""', "'''") else 1
        try:
            return unescape(t.text[n:-n])
        except ValueError as e:
            raise self.fail(str(e), t) from None

    def literal(self) -> Literal | None:
        t = self.tok
        if t.kind == "string":
            self.i += 1
            body = self.string_body(t)
            if self.tok.kind == "lang" and self.tok.at == self.toks[self.i - 1].end:
                lang, _, direction = self.take().text[1:].partition("--")
                try:
                    return Literal(body, lang, direction or None)
                except ValueError as e:
                    raise self.fail(str(e), t) from None
            if self.accept("^^"):
                dt = self.iri()
                if dt is None:
                    raise self.fail("expected a datatype")
                try:
                    return Literal(body, datatype=dt.value)
                except ValueError as e:
                    raise self.fail(str(e), t) from None
            return Literal(body)
        sign = ""
        if self.at("+", "-") and self.toks[self.i + 1].kind == "number" and self.toks[self.i + 1].at == t.end:
            sign = self.take().text
            t = self.tok
        if t.kind == "number":
            self.i += 1
            kind = "double" if "e" in t.text.lower() else "decimal" if "." in t.text else "integer"
            return Literal(sign + t.text, datatype=XSD + kind)
        if t.kind == "word" and self.boolean(t.text):
            self.i += 1
            return Literal(t.text.lower(), datatype=XSD + "boolean")
        return None

    def boolean(self, text: str) -> bool:
        return text in ("true", "false")

    def variable(self) -> Variable | None:
        if self.tok.kind != "var":
            return None
        if not self.variables_allowed:
            raise self.fail("a variable is not allowed here")
        return Variable(self.take().text[1:])

    def blank(self) -> BNode | None:
        return BNode(self.take().text[2:]) if self.tok.kind == "blank" else None

    def emit(self, s: Term, p: object, o: Term) -> None:
        self.out.append((s, p, o))

    def triple_term(self) -> TripleTerm:
        self.expect("<<(")
        was, self.in_term = self.in_term, True
        s = self.term_part(subject=True)
        p = self.verb()
        o = self.term_part(subject=False)
        self.in_term = was
        self.expect(")>>")
        return TripleTerm(s, p, o)

    def term_part(self, subject: bool) -> Term:
        for f in (self.iri, self.blank, self.variable):
            if (x := f()) is not None:
                return x
        if not subject or self.variables_allowed:
            if self.at("<<("):
                return self.triple_term()
            if (x := self.literal()) is not None:
                return x
        raise self.fail(f"unexpected {self.tok.text or 'end'!r} in a triple term")

    def subject(self) -> tuple[Term, bool]:
        """The subject, and whether it may stand without predicates."""
        if self.at("["):
            return self.property_list()
        if self.at("("):
            return self.collection(), False
        if self.at("<<"):
            return self.reified(), True
        for f in (self.iri, self.blank, self.variable):
            if (x := f()) is not None:
                return x, False
        if self.variables_allowed:
            if self.at("<<("):
                return self.triple_term(), False
            if (x := self.literal()) is not None:
                return x, False
        raise self.fail(f"expected a subject, found {self.tok.text or 'the end'!r}")

    def object(self) -> Term:
        if self.at("["):
            return self.property_list()[0]
        if self.at("("):
            return self.collection()
        if self.at("<<("):
            return self.triple_term()
        if self.at("<<"):
            return self.reified()
        for f in (self.iri, self.blank, self.variable, self.literal):
            if (x := f()) is not None:
                return x
        raise self.fail(f"expected an object, found {self.tok.text or 'the end'!r}")

    def property_list(self) -> tuple[BNode, bool]:
        self.expect("[")
        node = self.fresh()
        full = not self.at("]")
        if full:
            self.predicates(node)
        self.expect("]")
        return node, full

    def collection(self) -> Term:
        self.expect("(")
        head: Term = NIL
        last = None
        while not self.accept(")"):
            item = self.object()
            cell = self.fresh()
            if last is None:
                head = cell
            else:
                self.emit(last, REST, cell)
            self.emit(cell, FIRST, item)
            last = cell
        if last is not None:
            self.emit(last, REST, NIL)
        return head

    def reified(self) -> Term:
        self.expect("<<")
        was, self.in_term = self.in_term, True
        s = self.reified() if self.at("<<") else self.term_part(subject=True)
        p = self.verb()
        o = self.reified() if self.at("<<") else self.term_part(subject=False)
        self.in_term = was
        r: Term | None = None
        if self.accept("~"):
            r = self.iri() or self.blank() or self.variable()
        self.expect(">>")
        r = r if r is not None else self.fresh()
        self.emit(r, REIFIES, TripleTerm(s, p, o))
        return r

    def verb(self) -> object:
        if self.tok.kind == "word" and self.tok.text == "a":
            self.i += 1
            return TYPE
        x = self.iri() or self.variable()
        if x is None:
            raise self.fail(f"expected a predicate, found {self.tok.text or 'the end'!r}")
        return x

    def predicates(self, s: Term) -> None:
        while True:
            p = self.verb()
            while True:
                o = self.object()
                self.emit(s, p, o)
                self.annotations(s, p, o)
                if not self.accept(","):
                    break
            if not self.accept(";"):
                return
            while self.accept(";"):
                pass
            if self.tok.kind == "end" or self.at(".", "]", "}", "|}"):
                return

    def annotations(self, s: Term, p: object, o: Term) -> None:
        r: Term | None = None
        while self.at("~", "{|"):
            if not isinstance(p, (IRI, Variable)):
                raise self.fail("a path can't be annotated")
            if self.accept("~"):
                r = self.iri() or self.blank() or self.variable() or self.fresh()
                self.emit(r, REIFIES, TripleTerm(s, p, o))
            else:
                self.expect("{|")
                if r is None:
                    r = self.fresh()
                    self.emit(r, REIFIES, TripleTerm(s, p, o))
                self.predicates(r)
                self.expect("|}")
                r = None

    def statement(self) -> None:
        s, alone = self.subject()
        if alone and (self.tok.kind == "end" or self.at(".", "}")):
            return
        self.predicates(s)


class TurtleParser(TermParser):
    def document(self) -> list[Triple]:
        while self.tok.kind != "end":
            if self.directive(at_form=True):
                continue
            self.statement()
            self.expect(".")
        return self.out


class TrigParser(TermParser):
    """Quads as (s, p, o, graph or None)."""

    def document(self) -> list[tuple]:
        quads: list[tuple] = []
        while self.tok.kind != "end":
            if self.directive(at_form=True):
                continue
            graph: Term | None = None
            block = self.at("{")
            if self.word("GRAPH"):
                self.i += 1
                graph, block = self.iri() or self.blank(), True
                if graph is None:
                    raise self.fail("expected a graph name")
            elif not block:
                mark = self.i
                name = self.iri() or self.blank()
                if name is None and self.at("[") and self.toks[self.i + 1].text == "]":
                    self.i += 2
                    name = self.fresh()
                if name is not None and self.at("{"):
                    graph, block = name, True
                else:
                    self.i = mark
            if block:
                self.expect("{")
                while not self.accept("}"):
                    self.statement()
                    if not self.accept(".") and not self.at("}"):
                        raise self.fail("expected '.' or '}'")
            else:
                self.statement()
                self.expect(".")
            quads += [(*t, graph) for t in self.out]
            self.out = []
        return quads


class LineParser(TermParser):
    """N-Triples, or N-Quads with a fourth term. No prefixes, short forms or relative IRIs."""

    def full_iri(self, t: Token) -> str:
        base, self.base = self.base, None
        try:
            return super().full_iri(t)
        finally:
            self.base = base

    def plain(self, *kinds: str) -> Term:
        t = self.tok
        if t.kind == "iri" and "iri" in kinds:
            return IRI(self.full_iri(self.take()))
        if t.kind == "blank" and "blank" in kinds:
            return BNode(self.take().text[2:])
        if t.kind == "string" and "literal" in kinds and t.text[0] == '"' and t.text[:3] != '"""':
            return self.literal()
        if self.at("<<(") and "term" in kinds:
            self.i += 1
            x = TripleTerm(self.plain("iri", "blank"), self.plain("iri"), self.plain("iri", "blank", "literal", "term"))
            self.expect(")>>")
            return x
        raise self.fail(f"unexpected {t.text or 'end'!r}")

    def iri(self) -> IRI | None:
        return IRI(self.full_iri(self.take())) if self.tok.kind == "iri" else None

    def quads(self, four: bool) -> list[tuple]:
        out = []
        while self.tok.kind != "end":
            if self.tok.kind == "word" and self.tok.text == "VERSION":
                self.i += 1
                if self.take().kind != "string":
                    raise self.fail("expected a version string")
                continue
            first = self.tok
            s, p, o = self.plain("iri", "blank"), self.plain("iri"), self.plain("iri", "blank", "literal", "term")
            g = self.plain("iri", "blank") if four and not self.at(".") else None
            self.expect(".")
            if "\n" in self.text[first.at : self.toks[self.i - 1].at]:
                raise self.fail("a statement may not span lines", first)
            if self.tok.kind != "end" and "\n" not in self.text[self.toks[self.i - 1].end : self.tok.at] and "\r" not in self.text[self.toks[self.i - 1].end : self.tok.at]:
                raise self.fail("expected a line end")
            out.append((s, p, o, g))
        return out
