"""Slots: how a DataFrame column holds the terms of one variable.

A slot of kind 'key' holds the keys of terms.py. Others hold native values whose datatype is known for
all rows, so joins, filters and arithmetic need no decoding:

    ref:<prefix>   IRIs <prefix><id>, by id        integer, double, string, boolean, dateTime
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalog.functions.values import DATETIME
from stratalog.terms import XSD, IRI, Literal, Term, key


@dataclass(frozen=True)
class Slot:
    kind: str
    name: str
    #: Most digits of an integer.
    digits: int = 19

    @property
    def column(self) -> Column:
        return F.col(f"`{self.name}`")


def typed_prefix(kind: str) -> str:
    return "L" + ("" if kind == "string" else XSD + kind) + "\x01\x01\x01"


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def double_text(c: Column) -> Column:
    """The shortest form that reads back as the number: plain from 0.0001 up to 10^16, with an exponent beyond.

    The exact evaluator writes doubles alike, so a number has one key whichever way it was computed. Java's own form agrees
    between 0.001 and 10^7; elsewhere it is laid out anew, and cut where it has more digits than the number needs.
    """
    own = c.cast("string")
    body = F.regexp_replace(own, "^-", "")
    mantissa = F.substring_index(body, "E", 1)
    exponent = F.when(body.contains("E"), F.substring_index(body, "E", -1).cast("int")).otherwise(0)
    # m * 10^k, m whole. Java adds digits to whole numbers from 2^53; up to 2^63 all their digits are known.
    whole = (F.abs(c) >= 2.0**53) & (F.abs(c) < 2.0**63)
    digits = F.when(whole, F.abs(c).try_cast("bigint").cast("string")).otherwise(F.regexp_replace(mantissa, r"\.", ""))
    m = F.coalesce(F.nullif(F.ltrim(digits, F.lit("0")), F.lit("")), F.lit("0"))
    k = F.when(whole, 0).otherwise(exponent - F.length(F.substring_index(mantissa, ".", -1)))

    def cut(a: Column, j: Column) -> Column:
        # j last digits rounded away, if what is left still reads back as the number.
        head, rest = F.substr(a["all"], F.lit(1), F.length(a["all"]) - j), F.substr(a["all"], F.length(a["all"]) - j + 1)
        up = F.try_add(head.try_cast("bigint"), F.lit(1)).cast("string")
        half = F.rpad(F.lit("5"), j, F.lit("0"))
        below = (rest < half) | ((rest == half) & (F.substr(head, F.lit(-1)).try_cast("int") % 2 == 0))
        scale = a["from"] + j
        reads = lambda x: F.coalesce(F.concat(x, F.lit("E"), scale.cast("string")).try_cast("double") == F.abs(c), F.lit(False))
        near, far = F.when(below, head).otherwise(up), F.when(below, up).otherwise(head)
        pick = F.when(F.length(a["all"]) <= j, None).when(reads(near), near).when(reads(far), far)
        return F.when(pick.isNull(), a).otherwise(F.struct(pick.alias("m"), scale.alias("k"), a["all"].alias("all"), a["from"].alias("from")))

    def layout(a: Column) -> Column:
        d = F.rtrim(a["m"], F.lit("0"))
        e = F.length(a["m"]) - 1 + a["k"]
        rest = F.when(F.length(d) > 1, F.concat(F.lit("."), F.substr(d, F.lit(2)))).otherwise("")
        scientific = F.concat(F.substr(d, F.lit(1), F.lit(1)), rest, F.when(e < 0, "e-").otherwise("e+"), F.lpad(F.abs(e).cast("string"), F.greatest(F.length(F.abs(e).cast("string")), F.lit(2)), F.lit("0")))
        plain = F.when(F.length(d) <= e + 1, F.concat(F.rpad(d, e + 1, F.lit("0")), F.lit(".0"))).otherwise(F.concat(F.substr(d, F.lit(1), e + 1), F.lit("."), F.substr(d, e + 2)))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), d)
        return F.when((e >= 16) | (e < -4), scientific).when(e >= 0, plain).otherwise(small)

    # One aggregate without inner lambdas: Spark can't lift a Python call out of a plan that holds nested ones.
    known = F.struct(m.alias("m"), k.cast("int").alias("k"), m.alias("all"), k.cast("int").alias("from"))
    long = (F.length(m) >= 17) | ((F.length(m) == 16) & m.rlike("[19]$")) | (F.abs(c) < 1e-300)
    steps = F.when(long, F.sequence(F.lit(1), F.lit(4))).otherwise(F.array().cast("array<int>"))
    laid = F.concat(F.when(own.startswith("-"), "-").otherwise(""), F.aggregate(steps, known, cut, layout))
    return F.when(F.isnan(c), "NaN").when(c == float("inf"), "INF").when(c == float("-inf"), "-INF").when(c.isNull() | (~own.contains("E") & (F.length(own) < 17)), own).otherwise(laid)


def key_of(kind: str, c: Column) -> Column:
    """The term key of a native value."""
    if kind == "key":
        return c
    if kind.startswith("ref:"):
        return F.concat(F.lit("I" + kind[4:]), c.cast("string"))
    if kind == "double":
        text = double_text(c)
    elif kind == "dateTime":
        text = F.regexp_replace(c.cast("string"), " ", "T")
    else:
        text = c.cast("string")
    return F.concat(F.lit(typed_prefix(kind)), text)


def native(kind: str, t: Term) -> Column | None:
    """A constant as a slot's native value; None if no row of that kind can be this term."""
    if kind == "key":
        return F.lit(key(t))
    if kind.startswith("ref:"):
        prefix = kind[4:]
        if isinstance(t, IRI) and t.value.startswith(prefix) and len(t.value) > len(prefix):
            return F.lit(t.value[len(prefix) :])
        return None
    if not isinstance(t, Literal) or t.lang or t.datatype != (None if kind == "string" else XSD + kind):
        return None
    if kind == "string":
        return F.lit(t.value)
    if kind == "integer":
        return F.lit(int(t.value)).cast("decimal(38,0)") if t.value.lstrip("-").isascii() and t.value.lstrip("-").isdigit() and str(int(t.value)) == t.value else None
    if kind == "boolean":
        return F.lit(t.value == "true") if t.value in ("true", "false") else None
    return F.lit(key(t))  # doubles and dateTimes compare by key: their lexical forms vary


def equals_constant(kind: str, c: Column, t: Term) -> Column | None:
    n = native(kind, t)
    if n is None:
        return None
    if kind.startswith("ref:"):
        return c.cast("string") == n
    return (key_of(kind, c) if kind in ("double", "dateTime") else c) == n


def timestamp(text: str) -> Column | None:
    """A dateTime constant without zone and within microseconds, as Spark's type."""
    m = DATETIME.fullmatch(text.strip())
    if not m or m[8] or m[9] or len(m[1]) != 4 or int(m[1]) == 0 or len(m[7] or "") > 7:
        return None
    return F.lit(text.strip().replace("T", " ")).cast("timestamp_ntz")
