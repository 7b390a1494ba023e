"""Tokens of the Turtle family and of rule documents."""
from __future__ import annotations

import re
from dataclasses import dataclass

from stratalog.errors import ParseError

_START = r"A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u02FF\u0370-\u037D\u037F-\u1FFF\u200C-\u200D\u2070-\u218F\u2C00-\u2FEF\u3001-\uD7FF\uF900-\uFDCF\uFDF0-\uFFFD\U00010000-\U000EFFFF"
_CHAR = _START + r"_0-9\-\u00B7\u0300-\u036F\u203F-\u2040"
_ESC = r"\\[_~.\-!$&'()*+,;=/?#@%]"
_PREFIX = rf"(?:[{_START}](?:[{_CHAR}.]*[{_CHAR}])?)?"
_LOCAL = rf"(?:[{_START}_:0-9]|%[0-9A-Fa-f]{{2}}|{_ESC})(?:(?:[{_CHAR}.:]|%[0-9A-Fa-f]{{2}}|{_ESC})*(?:[{_CHAR}:]|%[0-9A-Fa-f]{{2}}|{_ESC}))?"
VARIABLE = rf"[{_START}_0-9][{_START}_0-9\u00B7\u0300-\u036F\u203F-\u2040]*"
_TOKENS = [
    ("space", r"[ \t\r\n]+|#[^\n\r]*"),
    ("string", r'"""(?:"{0,2}(?:[^"\\]|\\.))*"""|\'\'\'(?:\'{0,2}(?:[^\'\\]|\\.))*\'\'\'|"(?:[^"\\\n\r]|\\.)*"|\'(?:[^\'\\\n\r]|\\.)*\''),
    ("iri", r"<(?:[^\x00-\x20<>\"{}|^`\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>"),
    ("mark", r"<<\(|\)>>|<<|>>|\{\||\|\}|\^\^|:=|&&|\|\||!=|<=|>="),
    ("blank", rf"_:[{_START}_0-9](?:[{_CHAR}.]*[{_CHAR}])?"),
    ("var", rf"[?$]{VARIABLE}"),
    ("lang", r"@[A-Za-z]+(?:-[A-Za-z0-9]+)*(?:--[A-Za-z]+)?"),
    ("number", r"(?:[0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)[eE][+-]?[0-9]+|[0-9]*\.[0-9]+|[0-9]+"),
    ("name", rf"{_PREFIX}:(?:{_LOCAL})?"),
    ("word", r"[A-Za-z][A-Za-z0-9_]*"),
    ("mark1", r"[{}()\[\].,;~^/!=<>+*|-]"),
]
_LEX = re.compile("|".join(f"(?P<{n}>{p})" for n, p in _TOKENS), re.S)


@dataclass(frozen=True)
class Token:
    kind: str  # string iri mark blank var lang number name word end
    text: str
    at: int
    end: int


def position(text: str, at: int) -> tuple[int, int]:
    line = text.count("\n", 0, at) + 1
    return line, at - (text.rfind("\n", 0, at) + 1) + 1


def tokens(text: str, source: str) -> list[Token]:
    out, at = [], 0
    surrogate = re.search("[\ud800-\udfff]", text)
    if surrogate:
        raise ParseError("a surrogate is no character", source, *position(text, surrogate.start()))
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise ParseError(f"unexpected {text[at]!r}", source, *position(text, at))
        kind = m.lastgroup
        if kind != "space":
            out.append(Token("mark" if kind == "mark1" else kind, m.group(), at, m.end()))
        at = m.end()
    out.append(Token("end", "", len(text), len(text)))
    return out


_STRING_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescape(body: str, full: bool = True) -> str:
    """Character escapes of strings (full) or of IRIs. ValueError for one that isn't allowed."""

    def one(m: re.Match) -> str:
        e = m.group(1)
        if e[0] in "uU" and len(e) > 1:
            n = int(e[1:], 16)
            if 0xD800 <= n <= 0xDFFF or n > 0x10FFFF:
                raise ValueError("an escape gives no character")
            return chr(n)
        if full and e in _STRING_ESCAPES:
            return _STRING_ESCAPES[e]
        raise ValueError(f"unknown escape \\{e}")

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, body, flags=re.S)
