"""Expressions as Spark columns over typed slots. NULL stands for an expression error.

Three-valued logic then is the rule language's own. Terms whose datatype varies stay keys, which mixed.py compares and
takes apart in columns. What has no exact native form (arithmetic over such terms, division of integers, some casts,
unusual regular expressions) is left to the exact evaluator, in Arrow batches over the keys of the variables it reads.
"""
from __future__ import annotations

import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalog.errors import ExpressionError
from stratalog.functions import exact, mixed
from stratalog.functions.values import CONSTRUCTED, FLOAT, ebv, float_text, short
from stratalog.operators.slots import Slot, key_of, let, timestamp, typed_prefix
from stratalog.plans.model import Expression, expression_variables
from stratalog.sources.iri import ABSOLUTE, BAD
from stratalog.terms import DIR_LANG_STRING, LANG_STRING, STRING, XSD, IRI, BNode, Literal, TripleTerm, Variable, key, term, variables

Typed = tuple[str, Column]
Env = Mapping[Variable, Slot]
NUMBERS = ("integer", "double")
#: Regular expressions that mean the same here and in Java: plain characters, classes, quantifiers.
SAFE_REGEX = re.compile(r"\^?(?:[A-Za-z0-9 _@:/,;#%&=<>~'\"-]|\\[.\\+*?()\[\]{}|^$-]|\.|\[\^?(?:[A-Za-z0-9]-[A-Za-z0-9]|[A-Za-z0-9 _.])+\]|[()|])(?:[A-Za-z0-9 _@:/,;#%&=<>~'\"-]|\\[.\\+*?()\[\]{}|^$-]|\.|\[\^?(?:[A-Za-z0-9]-[A-Za-z0-9]|[A-Za-z0-9 _.])+\]|[()|](?!\?)|[*+?](?![*+?]))*\$?")


def null(kind: str) -> Column:
    return F.lit(None).cast({"integer": "decimal(38,0)", "double": "double", "boolean": "boolean", "dateTime": "timestamp_ntz"}.get(kind, "string"))


def constant(t) -> Typed | None:
    """A ground term: native where its datatype has a slot kind and its lexical form is the canonical one, else its key."""
    x = native_constant(t)
    if x is None and (isinstance(t, (IRI, BNode, Literal)) or (isinstance(t, TripleTerm) and not variables(t))):
        return "key", F.lit(key(t))
    return x


def native_constant(t) -> Typed | None:
    if isinstance(t, Literal) and t.lang is None:
        name = short(t.datatype)
        try:
            if t.datatype is None:
                return "string", F.lit(t.value)
            if name == "integer" and len(t.value) < 30 and str(int(t.value)) == t.value:
                return "integer", F.lit(int(t.value)).cast("decimal(38,0)") if abs(int(t.value)) >= 2**63 else F.lit(int(t.value)).cast("bigint")
            if name == "double" and FLOAT.fullmatch(t.value) and "N" not in t.value:
                return "double", F.lit(float(t.value))
            if name == "boolean" and t.value in ("true", "false"):
                return "boolean", F.lit(t.value == "true")
            if name == "dateTime" and (c := timestamp(t.value)) is not None:
                return "dateTime", c
        except ValueError:
            return None
    return None


def as_ebv(x: Typed | None) -> Column | None:
    if x is None:
        return None
    kind, c = x
    if kind == "boolean":
        return c
    if kind == "integer":
        return c != 0
    if kind == "double":
        return (c != 0) & ~F.isnan(c)
    if kind == "string":
        return F.length(c) > 0
    return mixed.ebv(c) if kind == "key" else F.lit(None).cast("boolean")


def whole(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def java_regex(p: str, flags: str) -> str | None:
    """The pattern for Java where it means the same there; flags: none or i."""
    if flags not in ("", "i") or not (p.isascii() and SAFE_REGEX.fullmatch(p) and balanced(p)):
        return None
    ends = p.endswith("$") and not p.endswith(r"\$")
    if "|" in p and (p.startswith("^") or ends):
        return None
    body = re.sub(r"\\.|\[[^\]]*\]|\.", lambda m: r"[^\n\r]" if m[0] == "." else m[0], p[:-1] if ends else p)
    return ("(?iu)" if flags else "") + body + (r"\z" if ends else "")


class Compiler:
    def __init__(self, env: Env, context: exact.Context):
        self.env, self.context = env, context
        #: Whether a column of this compiler calls Python.
        self.python = False

    def native(self, e: object) -> Typed | None:
        """(kind, column), or None where only the exact evaluator will do."""
        if isinstance(e, Variable):
            s = self.env[e]
            return s.kind, s.column
        if not isinstance(e, Expression):
            return constant(e)
        op = e.operator
        if op == "NOW":
            return None
        if op in ("&&", "||"):
            cols = [as_ebv(self.native(a)) for a in e.arguments]
            if any(c is None for c in cols):
                return None
            return "boolean", cols[0] & cols[1] if op == "&&" else cols[0] | cols[1]
        if op == "!":
            c = as_ebv(self.native(e.arguments[0]))
            return None if c is None else ("boolean", ~c)
        if op == "IF":
            return self.choice(*e.arguments)
        if op in ("IN", "NOT IN"):
            found = [self.equal(e.arguments[0], a) for a in e.arguments[1:]]
            if any(f is None for f in found):
                return None
            any_ = F.lit(False)
            for f in found:
                any_ = any_ | f
            return "boolean", any_ if op == "IN" else ~any_
        if op in ("=", "!="):
            c = self.equal(*e.arguments)
            return None if c is None else ("boolean", c if op == "=" else ~c)
        if op in self.context.columns:
            args = [self.native(a) for a in e.arguments]
            return None if any(a is None for a in args) else self.context.columns[op](*args)
        if op in self.context.functions:
            return None
        args = [self.native(a) for a in e.arguments]
        if any(a is None for a in args):
            return None
        if op == "SAMETERM":
            return "boolean", self.lexical_key(e.arguments[0], args[0]) == self.lexical_key(e.arguments[1], args[1])
        keyed = any(k == "key" for k, _ in args)
        if op in ("<", ">", "<=", ">="):
            return ("boolean", mixed.order(*args, swap=op[0] == ">", strict=len(op) == 1)) if keyed else self.order(op, *args)
        if op in ("+", "-", "*", "/"):
            return self.arithmetic(op, *args) if not keyed and ("double" in (args[0][0], args[1][0]) or self.digits(e) <= 38) else None
        found = self.of_terms(op, args, e.arguments)
        if found is not None and keyed:
            return found[0], mixed.bind(args, lambda xs: self.of_terms(op, xs, e.arguments)[1])
        return found if found is not None or keyed else self.call(op, args, e.arguments)

    @staticmethod
    def lexical_key(source: object, x: Typed) -> Column:
        """The key of an argument; a constant keeps the lexical form it was written in."""
        return F.lit(key(source)) if isinstance(source, (IRI, BNode, Literal)) else key_of(*x)

    def of_terms(self, op: str, args: list[Typed], source: tuple) -> Typed | None:
        """Functions that take terms of any kind, or whose result's datatype varies."""
        if not args:
            return None
        x = args[0]
        kind, c = x
        keyed = kind == "key"
        if keyed and op in ("ISIRI", "ISBLANK", "ISLITERAL", "ISTRIPLE"):
            return "boolean", mixed.first(c) == {"ISIRI": "I", "ISBLANK": "B", "ISLITERAL": "L", "ISTRIPLE": "T"}[op]
        if keyed and op == "ISNUMERIC":
            return "boolean", F.when(c.isNotNull(), mixed.number(x).isNotNull())
        if keyed and op in ("STR", STRING):
            return "string", F.when(mixed.first(c) == "I", F.substr(c, F.lit(2))).otherwise(mixed.lexical(c))
        if keyed and op in ("LANG", "LANGDIR", "HASLANG", "HASLANGDIR"):
            part = F.get(F.split(mixed.tags(c), "\x01"), F.lit(2 if op.endswith("DIR") else 1))
            literal = mixed.first(c) == "L"
            return ("boolean", F.when(c.isNotNull(), literal & (part != ""))) if op.startswith("HAS") else ("string", F.when(literal, part))
        if op == "DATATYPE":
            return "key", mixed.datatype_iri(x)
        if op in ("SUBJECT", "PREDICATE", "OBJECT"):
            parts = mixed.unpacked(c) if keyed else [F.lit(None).cast("string")] * 3
            return "key", parts[("SUBJECT", "PREDICATE", "OBJECT").index(op)]
        if op == "TRIPLE":
            s, p, o = (key_of(*a) for a in args)
            return "key", F.when(mixed.first(s).isin("I", "B") & (mixed.first(p) == "I"), mixed.packed(s, p, o))
        if op == "IRI" and not self.context.base:
            text = mixed.plain(x)
            made = F.when(text.rlike("^" + ABSOLUTE.pattern) & ~text.rlike(r"[\x00-\x20<>\"{}|^`\\]"), F.concat(F.lit("I"), text))
            return "key", F.when(mixed.first(c) == "I", c).otherwise(made) if keyed else key_of(kind, c) if kind.startswith("ref:") else made
        if op == "LANGMATCHES":
            tag, wanted = (F.lower(mixed.plain(a)) for a in args)
            return "boolean", F.when(wanted == "*", F.length(tag) > 0).otherwise((tag == wanted) | F.startswith(tag, F.concat(wanted, F.lit("-"))))
        if op == "STRDT" and isinstance(source[1], IRI):
            if source[1].value in (LANG_STRING, DIR_LANG_STRING):
                return "key", null("string")
            return ("string", mixed.plain(x)) if source[1].value == STRING else ("key", F.concat(F.lit(f"L{source[1].value}\x01\x01\x01"), mixed.plain(x)))
        if op in ("STRLANG", "STRLANGDIR"):
            tag = F.lower(F.nullif(mixed.plain(args[1]), F.lit("")))
            direction = F.lit("")
            if op == "STRLANGDIR":
                direction = mixed.plain(args[2])
                direction = F.when(direction.isin("ltr", "rtl"), direction)
            return "key", F.concat(F.lit("L\x01"), tag, F.lit("\x01"), direction, F.lit("\x01"), mixed.plain(x))
        if op == "SECONDS" and kind == "dateTime":
            text = c.cast("string")
            return "key", F.concat(F.lit(typed_prefix("decimal")), F.second(c).cast("string"), F.regexp_extract(text, r"\.[0-9]+", 0))
        if keyed and op in ("YEAR", "MONTH", "DAY", "HOURS", "MINUTES"):
            return "integer", mixed.date_part(c, op)
        if keyed and op in ("TZ", "TIMEZONE"):
            return "string" if op == "TZ" else "key", mixed.zone_part(c, op)
        return self.of_strings(op, args, source) or self.cast(short(op), x) if len(args) == 1 else self.of_strings(op, args, source)

    def of_strings(self, op: str, args: list[Typed], source: tuple) -> Typed | None:
        """String functions where an argument may have a language."""
        if op == "REPLACE":
            return self.replaced(args, source)
        if all(k != "key" for k, _ in args):
            return None
        x = args[0]
        text = mixed.text_of(x)
        if op == "STRLEN":
            return "integer", F.length(text).cast("bigint")
        if op in ("UCASE", "LCASE"):
            return mixed.like(x, (F.upper if op == "UCASE" else F.lower)(text))
        if op == "ENCODE_FOR_URI":
            return self.call(op, [("string", text)], source)
        if op == "CONCAT":
            return mixed.joined(args)
        if op == "SUBSTR" and all(k == "integer" for k, _ in args[1:]):
            return mixed.like(x, self.call(op, [("string", text), *args[1:]], source)[1])
        if op == "REGEX":
            return self.call(op, [("string", text), *args[1:]], source) if all(k == "string" for k, _ in args[1:]) else None
        if op in ("CONTAINS", "STRSTARTS", "STRENDS", "STRBEFORE", "STRAFTER"):
            y = args[1]
            if x[0] not in ("string", "key") or y[0] not in ("string", "key"):
                return "boolean", null("boolean")
            pair = [("string", text), ("string", mixed.text_of(y))]
            fits = mixed.compatible(x, y)
            kind, c = self.call(op, pair, source)
            if op in ("STRBEFORE", "STRAFTER"):
                whole = F.when(F.position(pair[1][1], text) > 0, key_of(*mixed.like(x, c))).otherwise(key_of("string", c))
                return "key", F.when(fits, whole)
            return kind, F.when(fits, c)
        return None

    def replaced(self, args: list[Typed], source: tuple) -> Typed | None:
        """REPLACE with a constant pattern and replacement that mean the same in Java."""
        if not all(isinstance(a, Literal) and a.lang is None and a.datatype is None for a in source[1:]):
            return None
        pattern = java_regex(source[1].value, source[3].value if len(source) > 3 else "")
        if pattern is None or re.search(source[1].value.removesuffix("$"), ""):
            return None
        groups = re.compile(source[1].value).groups
        out = []
        for part in re.findall(r"\\.|\$[0-9]+|[^\\$]+|.", source[2].value, re.S):
            if part in ("\\$", "\\\\"):
                out.append(part)
            elif re.fullmatch(r"\$[0-9]", part) and int(part[1]) <= groups:
                out.append(part)
            elif part[0] in "\\$":
                return None
            else:
                out.append(part)
        return mixed.like(args[0], F.regexp_replace(mixed.text_of(args[0]), pattern, "".join(out)))

    def cast(self, name: str | None, x: Typed) -> Typed | None:
        """Constructors with an exact column; integers of more than 38 digits have none."""
        kind, c = x
        if name == "boolean" and kind in ("string", "key"):
            text = F.trim(mixed.plain(x), F.lit(mixed.BLANK))
            from_text = F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False)
            if kind == "string":
                return "boolean", from_text
            return "boolean", F.when(mixed.is_plain(c), from_text).when(mixed.datatype(c) == "boolean", mixed.boolean(x, True)).when(mixed.datatype(c).isin(*mixed.NUMBERS), mixed.ebv(c))
        if name == "integer" and kind == "boolean":
            return "integer", c.cast("bigint")
        if name == "integer" and kind == "double":
            # Whole doubles are exact in three limbs of 50 bits.
            limb = 2.0**50
            t = F.when(F.abs(c) < 1e38, F.abs(c))
            top = F.floor(t / (limb * limb)).cast("double")
            rest = t - top * (limb * limb)
            mid = F.floor(rest / limb).cast("double")
            low = F.floor(rest - mid * limb)
            big = lambda v: v.cast("bigint").cast("decimal(38,0)")
            whole_ = (big(top) * F.lit(2**50).cast("decimal(38,0)")).cast("decimal(38,0)") + big(mid)
            value = (whole(whole_) * F.lit(2**50).cast("decimal(38,0)")).cast("decimal(38,0)") + big(low)
            return "integer", F.when(c < 0, -whole(value)).otherwise(whole(value))
        if name == "integer" and kind == "string":
            text = F.trim(c, F.lit(mixed.BLANK))
            return "integer", F.when(text.rlike(r"^[+-]?[0-9]+\z"), text.try_cast("decimal(38,0)"))
        if name == "double" and kind == "string":
            text = F.trim(c, F.lit(mixed.BLANK))
            return "key", F.when(text.rlike(mixed.java(FLOAT)), F.concat(F.lit(typed_prefix("double")), text))
        if name == "decimal" and kind == "integer":
            return "key", F.concat(F.lit(typed_prefix("decimal")), c.cast("string"))
        if name in CONSTRUCTED and kind == "string":
            return "key", let(F.trim(c, F.lit(mixed.BLANK)), lambda text: F.when(mixed.constructed(name, text), F.concat(F.lit(typed_prefix(name)), text)))
        return None

    def choice(self, cond: object, yes: object, no: object) -> Typed | None:
        c, a, b = as_ebv(self.native(cond)), self.native(yes), self.native(no)
        if c is None or a is None or b is None:
            return None
        if a[0] != b[0]:
            return "key", F.when(c, self.lexical_key(yes, a)).when(~c, self.lexical_key(no, b))
        x, y = (whole(a[1]), whole(b[1])) if a[0] == "integer" else (a[1], b[1])
        return a[0], F.when(c, x).when(~c, y)

    def equal(self, x: object, y: object) -> Column | None:
        # An IRI against references of a table.
        for p, q in ((x, y), (y, x)):
            if isinstance(p, IRI) and isinstance(q, Variable) and self.env[q].kind.startswith("ref:"):
                prefix = self.env[q].kind[4:]
                return self.env[q].column.cast("string") == p.value[len(prefix) :] if p.value.startswith(prefix) else F.lit(False)
            if isinstance(p, IRI) and isinstance(q, Variable) and self.env[q].kind == "key":
                return self.env[q].column == key(p)  # an IRI equals itself alone
        a, b = self.native(x), self.native(y)
        if a is None or b is None:
            return None
        (ka, ca), (kb, cb) = a, b
        if "key" in (ka, kb):
            return mixed.equal(a, b)
        if ka in NUMBERS and kb in NUMBERS:
            if ka == kb == "integer":
                return ca == cb
            ca, cb = ca.cast("double"), cb.cast("double")
            return (ca == cb) & ~F.isnan(ca)
        if ka == kb:
            return ca == cb
        if ka.startswith("ref:") and kb.startswith("ref:"):
            return key_of(ka, ca) == key_of(kb, cb)
        return F.when(ca.isNotNull() & cb.isNotNull(), F.lit(False))

    def order(self, op: str, a: Typed, b: Typed) -> Typed | None:
        (ka, x), (kb, y) = a, b
        guard = None
        if ka in NUMBERS and kb in NUMBERS:
            if "double" in (ka, kb):
                x, y = x.cast("double"), y.cast("double")
                guard = ~F.isnan(x) & ~F.isnan(y)
        elif ka != kb or ka not in ("string", "boolean", "dateTime"):
            return "boolean", null("boolean")
        c = {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]
        return "boolean", c if guard is None else c & guard

    def arithmetic(self, op: str, a: Typed, b: Typed) -> Typed | None:
        (ka, x), (kb, y) = a, b
        if ka not in NUMBERS or kb not in NUMBERS:
            return "integer", null("integer")
        if ka == kb == "integer":
            if op == "/":
                return None
            return "integer", whole({"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](whole(x), whole(y)))
        x, y = x.cast("double"), y.cast("double")
        if op == "/":
            # Signed zero decides the sign of infinity.
            nan, inf = F.lit(float("nan")), F.lit(float("inf"))
            negative = (x < 0) != y.cast("string").startswith("-")
            return "double", F.when(y != 0, x / F.when(y != 0, y)).when((x == 0) | F.isnan(x), nan).when(negative, -inf).otherwise(inf)
        return "double", x + y if op == "+" else x - y if op == "-" else x * y

    def digits(self, e: object) -> int:
        """How many digits an integer expression can have; beyond 38 Spark's decimals end."""
        if isinstance(e, Variable):
            return self.env[e].digits
        if isinstance(e, Literal):
            return len(e.value)
        if isinstance(e, Expression) and e.operator in ("+", "-", "*", "unary-", "unary+", "ABS", "CEIL", "FLOOR", "ROUND", "IF"):
            n = [self.digits(a) for a in e.arguments[e.operator == "IF" :]]
            return sum(n) if e.operator == "*" else max(n) + (e.operator in "+-")
        return 19

    def call(self, op: str, args: list[Typed], source: tuple) -> Typed | None:
        kinds, cols = [k for k, _ in args], [c for _, c in args]
        k, c = (kinds[0], cols[0]) if args else ("", None)
        strings = all(x == "string" for x in kinds)
        if op == "unary-" and k in NUMBERS:
            return k, -c if k == "double" else whole(-whole(c))
        if op == "unary+" and k in NUMBERS:
            return k, c
        if op == "STR" and not k.startswith("ref:"):
            return "string", F.substr(key_of(k, c), F.lit(len("L" + ("" if k == "string" else XSD + k)) + 4))
        if op == "STR":
            return "string", F.concat(F.lit(k[4:]), c.cast("string"))
        if op in ("ISIRI", "ISLITERAL", "ISBLANK", "ISTRIPLE", "ISNUMERIC", "HASLANG", "HASLANGDIR"):
            ref = k.startswith("ref:")
            yes = {"ISIRI": ref, "ISLITERAL": not ref, "ISNUMERIC": k in NUMBERS}.get(op, False)
            return "boolean", F.when(c.isNotNull(), F.lit(yes))
        if op in ("LANG", "LANGDIR") and not k.startswith("ref:"):
            return "string", F.when(c.isNotNull(), F.lit(""))
        if op in ("ABS", "CEIL", "FLOOR", "ROUND") and k == "integer":
            return k, F.abs(whole(c)) if op == "ABS" else c
        if op == "ABS" and k == "double":
            return k, F.abs(c)
        if op in ("CEIL", "FLOOR", "ROUND") and k == "double":
            # Through bigint only where that is exact; larger ones are whole already. Zero keeps its sign.
            down = F.floor(c).cast("double")
            up = {"FLOOR": down, "CEIL": F.ceil(c).cast("double"), "ROUND": down + F.when(c - down >= 0.5, 1.0).otherwise(0.0)}[op]
            return k, F.when(F.isnan(c) | (c == 0) | (F.abs(c) >= 2.0**52), c).when((up == 0) & (c < 0), F.lit(-0.0)).otherwise(up)
        if op in ("YEAR", "MONTH", "DAY", "HOURS", "MINUTES") and k == "dateTime":
            return "integer", {"YEAR": F.year, "MONTH": F.month, "DAY": F.day, "HOURS": F.hour, "MINUTES": F.minute}[op](c)
        if op == "TZ" and k == "dateTime":
            return "string", F.when(c.isNotNull(), F.lit(""))
        name = short(op)
        if name == "string" and len(args) == 1:
            return self.call("STR", args, source)
        if name == "double" and k in NUMBERS:
            return "double", c.cast("double")
        if name == "integer" and k == "integer":
            return k, c
        if name == "boolean" and k in (*NUMBERS, "boolean"):
            return "boolean", as_ebv((k, c))
        if not strings:
            if op == "SUBSTR" and k == "string" and all(x == "integer" for x in kinds[1:]):
                # Positions clip to the string before they become machine integers.
                start = whole(cols[1]) - 1
                end = start + whole(cols[2]) if len(cols) == 3 else whole(F.length(c))
                clip = lambda x: F.least(F.greatest(x, F.lit(0)), F.length(c)).cast("int")
                return "string", F.when(start.isNotNull() & end.isNotNull() & c.isNotNull(), F.substr(c, clip(start) + 1, F.greatest(clip(end) - clip(start), F.lit(0))))
            return None
        if op == "STRLEN":
            return "integer", F.length(c).cast("bigint")
        if op == "UCASE":
            return "string", F.upper(c)
        if op == "LCASE":
            return "string", F.lower(c)
        if op == "CONCAT":
            return "string", F.concat(*cols) if cols else F.lit("")
        if op == "ENCODE_FOR_URI":
            return "string", F.regexp_replace(F.regexp_replace(F.regexp_replace(F.url_encode(c), r"\+", "%20"), r"\*", "%2A"), "%7E", "~")
        if op in ("CONTAINS", "STRSTARTS", "STRENDS"):
            return "boolean", {"CONTAINS": F.contains, "STRSTARTS": F.startswith, "STRENDS": F.endswith}[op](cols[0], cols[1])
        if op in ("STRBEFORE", "STRAFTER"):
            at = F.position(cols[1], cols[0])
            hit = F.substr(c, F.lit(1), at - 1) if op == "STRBEFORE" else F.substr(c, at + F.length(cols[1]))
            return "string", F.when(F.length(cols[1]) == 0, null("string")).when(at > 0, hit).when(at == 0, F.lit(""))
        if op == "REGEX" and isinstance(source[1], Literal):
            flags = source[2].value if len(source) > 2 and isinstance(source[2], Literal) else "" if len(source) == 2 else "?"
            pattern = java_regex(source[1].value, flags)
            return None if pattern is None else ("boolean", F.rlike(c, F.lit(pattern)))
        return None

    # whole expressions

    def value(self, e: object, site: str) -> Typed:
        """The expression's slot kind and column; NULL where it has no value."""
        if isinstance(e, Variable):
            return self.env[e].kind, self.env[e].column
        x = self.native(e)
        if isinstance(e, Literal) and x is not None and x[0] == "double" and float_text(float(e.value)) != e.value:
            return "key", F.lit(key(e))  # a constant keeps the form it was written in
        if x is not None and x[1] is not None:
            return x
        return "key", self.by_batches(e, site, False)

    def condition(self, e: object, site: str) -> list[Column]:
        """Columns that must all be true; a conjunction falls apart, each part by its best way."""
        if isinstance(e, Expression) and e.operator == "&&":
            return [c for k, a in enumerate(e.arguments) for c in self.condition(a, f"{site}&{k}")]
        c = self.truth(e)
        return [c if c is not None else self.by_batches(e, site, True)]

    def truth(self, e: object) -> Column | None:
        """A column that is true where e is; where e isn't, false or NULL, since both fail a condition."""
        op = e.operator if isinstance(e, Expression) else None
        if op in ("&&", "||"):
            a, b = (self.truth(x) for x in e.arguments)
            return None if a is None or b is None else a & b if op == "&&" else a | b
        if op == "=":
            pair = [self.native(x) for x in e.arguments]
            if None not in pair and sorted(k for k, _ in pair) == ["key", "string"]:
                return key_of(*pair[0]) == key_of(*pair[1])  # a plain string equals itself alone
        x = self.native(e)
        return as_ebv(x) if x is not None and x[1] is not None else None

    def by_batches(self, e: object, site: str, as_boolean: bool) -> Column:
        names = sorted(expression_variables(e) if not mints(e) else self.env, key=lambda v: v.value)
        context, kinds = self.context, [self.env[n].kind for n in names] if names else []

        def one(ks: tuple) -> object:
            if any(k is None for k in ks):  # Spark may run this before the filter that drops such a row
                return None
            try:
                t = exact.evaluate(e, {n: from_text(kind, k) for n, kind, k in zip(names, kinds, ks, strict=True)}, context, site)
                return ebv(t) if as_boolean else key(t)
            except ExpressionError:
                return None

        if not names:
            # Nothing varies, so the driver evaluates it once.
            out = one(())
            return F.lit(out).cast("boolean" if as_boolean else "string")

        self.python = True

        @F.pandas_udf("boolean" if as_boolean else "string")
        def run(*cols: pd.Series) -> pd.Series:
            return pd.Series([one(ks) for ks in zip(*cols, strict=True)], dtype=object)

        # Native values go as plain text: cheaper than keys, and Spark can't lift a Python call out of a plan if it holds lambdas.
        return run(*[self.env[n].column if kind == "key" else self.env[n].column.cast("string") for n, kind in zip(names, kinds, strict=True)])


def from_text(kind: str, text: str):
    """The term of a native value, given as Spark prints it."""
    if kind == "key":
        return term(text)
    if kind.startswith("ref:"):
        return IRI(kind[4:] + text)
    if kind == "double":
        text = float_text(float(text))
    elif kind == "dateTime":
        text = text.replace(" ", "T")
    return Literal(text, datatype=None if kind == "string" else XSD + kind)


def balanced(p: str) -> bool:
    try:
        re.compile(p)
        return True
    except re.error:
        return False


def mints(e: object) -> bool:
    if isinstance(e, Expression):
        return e.operator in ("BNODE", "UUID", "STRUUID") or any(mints(a) for a in e.arguments)
    return False


__all__ = ["Compiler", "TripleTerm"]
