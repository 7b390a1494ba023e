"""XPath regular expressions: translation to the `regex` library, and replacement templates."""
from __future__ import annotations

import re
from functools import lru_cache

import regex

from stratalog.errors import ExpressionError

TIMEOUT = 0.1
_NAME_START = r":A-Z_a-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u02FF\u0370-\u037D\u037F-\u1FFF\u200C-\u200D\u2070-\u218F\u2C00-\u2FEF\u3001-\uD7FF\uF900-\uFDCF\uFDF0-\uFFFD\U00010000-\U000EFFFF"
_NAME = _NAME_START + r"\-.0-9\u00B7\u0300-\u036F\u203F-\u2040"
_CLASSES = {"i": f"[{_NAME_START}]", "I": f"[^{_NAME_START}]", "c": f"[{_NAME}]", "C": f"[^{_NAME}]", "d": r"\p{Nd}", "D": r"\P{Nd}", "s": r"[\t\n\r ]", "S": r"[^\t\n\r ]", "w": r"[^\p{P}\p{Z}\p{C}]", "W": r"[\p{P}\p{Z}\p{C}]"}


class _Translator:
    def __init__(self, pattern: str, flags: str):
        self.p, self.i, self.flags, self.groups, self.open = pattern, 0, flags, 0, []
        self.closed: set[int] = set()

    def fail(self, why: str) -> ExpressionError:
        return ExpressionError(f"invalid pattern {self.p!r}: {why}")

    def run(self) -> str:
        out = []
        while self.i < len(self.p):
            c = self.p[self.i]
            self.i += 1
            if c == "\\":
                out.append(self.escape(in_class=False))
            elif c == "[":
                out.append(self.char_class())
            elif c == "(":
                if self.p.startswith("?:", self.i):
                    self.i += 2
                    self.open.append(0)
                    out.append("(?:")
                elif self.p.startswith("?", self.i):
                    raise self.fail("unsupported group")
                else:
                    self.groups += 1
                    self.open.append(self.groups)
                    out.append("(")
            elif c == ")":
                if not self.open:
                    raise self.fail("unbalanced )")
                self.closed.add(self.open.pop())
                out.append(")")
            elif c in "]}":
                raise self.fail(f"unescaped {c}")
            elif c == "{":
                m = re.compile(r"[0-9]+(?:,[0-9]*)?\}").match(self.p, self.i)
                if not m:
                    raise self.fail("bad quantifier")
                self.i = m.end()
                out.append("{" + m[0])
            elif c == ".":
                out.append("(?s:.)" if "s" in self.flags else r"[^\n\r]")
            elif c == "^":
                out.append("^" if "m" in self.flags else r"\A")
            elif c == "$":
                out.append("$" if "m" in self.flags else r"\Z")
            elif c in "*+?|":
                out.append(c)
            else:
                out.append(re.escape(c))
        if self.open:
            raise self.fail("unbalanced (")
        return "".join(out)

    def escape(self, in_class: bool) -> str:
        if self.i >= len(self.p):
            raise self.fail("a lone backslash")
        c = self.p[self.i]
        self.i += 1
        if c in "nrt":
            return "\\" + c
        if c in "\\|.?*+(){}-[]^$":
            return re.escape(c) if c != "-" else r"\-"
        if c in _CLASSES:
            return _CLASSES[c]
        if c in "pP":
            m = re.compile(r"\{([A-Za-z0-9-]+)\}").match(self.p, self.i)
            if not m:
                raise self.fail("bad category")
            self.i = m.end()
            name = m[1]
            if name.startswith("Is"):
                name = "InBlock=" + name[2:] if False else "Block=" + name[2:]
            return f"\\{c}{{{name}}}"
        if c.isdigit() and c != "0" and not in_class:
            n = int(c)
            if n > self.groups or n not in self.closed:
                raise self.fail("a back reference to an open group")
            while self.i < len(self.p) and self.p[self.i].isdigit() and n * 10 + int(self.p[self.i]) in self.closed:
                n = n * 10 + int(self.p[self.i])
                self.i += 1
            return f"(?:\\{n})"
        raise self.fail(f"unknown escape \\{c}")

    def char_class(self) -> str:
        """A class with ranges and subtraction, as a set of the library's version 1 syntax."""
        negated = self.p.startswith("^", self.i)
        self.i += negated
        parts: list[str] = []
        minus = ""
        first = True
        while True:
            if self.i >= len(self.p):
                raise self.fail("unbalanced [")
            c = self.p[self.i]
            if c == "]" and not first:
                self.i += 1
                break
            if c == "-" and self.p.startswith("-[", self.i) and not first:
                self.i += 2
                minus = self.char_class()
                if not self.p.startswith("]", self.i):
                    raise self.fail("text after a subtraction")
                self.i += 1
                break
            self.i += 1
            if c == "[" or (c == "]" and first):
                raise self.fail("unescaped bracket")
            low = self.escape(in_class=True) if c == "\\" else re.escape(c)
            if self.p.startswith("-", self.i) and not self.p.startswith("-]", self.i) and not self.p.startswith("-[", self.i):
                self.i += 1
                d = self.p[self.i : self.i + 1]
                self.i += 1
                high = self.escape(in_class=True) if d == "\\" else re.escape(d)
                if len(low) > 2 or len(high) > 2 or low.lstrip("\\") > high.lstrip("\\"):
                    raise self.fail("bad range")
                parts.append(f"{low}-{high}")
            else:
                parts.append(low)
            first = False
        body = "[" + ("^" if negated else "") + "".join(parts) + "]"
        return f"[{body}--{minus}]" if minus else body


def without_space(pattern: str) -> str:
    out, depth, i = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append(pattern[i : i + 2])
            i += 2
            continue
        depth += (c == "[") - (c == "]")
        if depth > 0 or c not in " \t\r\n":
            out.append(c)
        i += 1
    return "".join(out)


@lru_cache(maxsize=512)
def compiled(pattern: str, flags: str):
    if set(flags) - set("smixq"):
        raise ExpressionError("unknown regular-expression flag")
    if "q" in flags:
        text = re.escape(pattern)
    else:
        text = _Translator(without_space(pattern) if "x" in flags else pattern, flags).run()
    try:
        return regex.compile(text, regex.V1 | (regex.M if "m" in flags else 0) | (regex.I if "i" in flags else 0))
    except regex.error as e:
        raise ExpressionError(f"invalid pattern {pattern!r}: {e}") from None


def matches(text: str, pattern: str, flags: str = "") -> bool:
    try:
        return compiled(pattern, flags).search(text, timeout=TIMEOUT) is not None
    except TimeoutError:
        raise ExpressionError("the pattern takes too long") from None


def template(text: str, groups: int) -> list[str | int]:
    out: list[str | int] = []
    at = 0
    for m in re.finditer(r"\\(.?)|\$([0-9]*)", text, re.S):
        out.append(text[at : m.start()])
        at = m.end()
        if m[0][0] == "\\":
            if m[1] not in ("\\", "$") or not m[1]:
                raise ExpressionError("invalid escape in a replacement")
            out.append(m[1])
        else:
            if not m[2]:
                raise ExpressionError("a $ without a group in a replacement")
            # As many digits as name a group; at least one.
            k = len(m[2])
            while k > 1 and int(m[2][:k]) > groups:
                k -= 1
            out.append(int(m[2][:k]) if int(m[2][:k]) <= groups else "")
            out.append(m[2][k:])
    return [*out, text[at:]]


def replace(text: str, pattern: str, by: str, flags: str = "") -> str:
    p = compiled(pattern, flags)
    try:
        if p.search("", timeout=TIMEOUT):
            raise ExpressionError("the pattern matches nothing at all")
        parts = [by] if "q" in flags else template(by, p.groups)
        return p.sub(lambda m: "".join((m[x] or "") if isinstance(x, int) else x for x in parts), text, timeout=TIMEOUT)
    except TimeoutError:
        raise ExpressionError("the pattern takes too long") from None
