"""Columns over terms whose datatype varies from row to row, as held by their keys.

Each function takes (kind, column) pairs of any slot kind and gives a column that is NULL where the
expression has no value. A literal is taken apart once (`let` binds the parts), then a ladder of cases by
datatype decides. Integers and decimals of any length compare exactly, by sign, length and digits;
times by whole seconds and their fraction.

Bounds, beyond which a term has no value here though the exact evaluator gives it one: years of more than 12 digits,
durations of more than 18 decimals, triple terms nested more than DEPTH deep compare by identity.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalog.functions.values import DATE, DATETIME, DECIMAL, DURATION, FLOAT, INTEGERS, NUMERIC, TEMPORAL, TIME
from stratalog.operators.slots import key_of, let, typed_prefix
from stratalog.terms import DIR_LANG_STRING, LANG_STRING, STRING, XSD

Typed = tuple[str, Column]
DEPTH = 16
#: White space around the lexical forms of numbers, booleans and times.
BLANK = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
NUMBERS, DURATIONS = sorted(NUMERIC), [d for d in sorted(TEMPORAL) if d.endswith("uration")]


def java(pattern) -> str:
    """A pattern of values.py for Java, over the whole text; those use nothing that the two read differently."""
    return rf"^(?:{pattern.pattern})\z"


def lit(x) -> Column:
    return F.lit(x)


def first(k: Column) -> Column:
    return F.substr(k, lit(1), lit(1))


def tags(k: Column) -> Column:
    """L<datatype>\\x01<language>\\x01<direction> of a literal's key."""
    return F.substring_index(k, "\x01", 3)


def lexical(k: Column) -> Column:
    return F.when(first(k) == "L", F.substr(k, F.length(tags(k)) + 2))


def datatype(k: Column) -> Column:
    """The short name of an XSD datatype, "" for other literals; NULL for other terms."""
    whole = F.substr(F.substring_index(k, "\x01", 1), lit(2))
    return F.when(first(k) == "L", F.when(whole.startswith(XSD), F.substr(whole, lit(len(XSD) + 1))).otherwise(""))


def trimmed(k: Column) -> Column:
    return F.trim(lexical(k), lit(BLANK))


def is_plain(k: Column) -> Column:
    return k.startswith(typed_prefix("string"))


def is_string(k: Column) -> Column:
    """Plain, or with a language."""
    return k.startswith("L\x01")


def plain(x: Typed) -> Column:
    kind, c = x
    if kind == "string":
        return c
    return F.when(is_plain(c), F.substr(c, lit(5))) if kind == "key" else lit(None).cast("string")


# numbers: struct(rank, dbl, sign, ints, frac); rank 0 for exact ones, 1 for float, 2 for double


def digits(text: Column) -> tuple[Column, Column, Column]:
    """Sign (-1, 0, 1), whole digits without leading and decimals without trailing zeros, of a decimal's text."""
    body = F.regexp_replace(text, r"^[+-]", "")
    ints = F.ltrim(F.substring_index(body, ".", 1), lit("0"))
    frac = F.when(body.contains("."), F.rtrim(F.substring_index(body, ".", -1), lit("0"))).otherwise("")
    sign = F.when((ints == "") & (frac == ""), 0).when(text.startswith("-"), -1).otherwise(1)
    return sign, ints, frac


def number_struct(rank, dbl, sign, ints, frac) -> Column:
    return F.struct(F.lit(rank).cast("int").alias("rank"), dbl.cast("double").alias("dbl"), F.lit(sign).cast("int").alias("sign"), ints.alias("ints"), frac.alias("frac"))


def in_range(name: Column, text: Column) -> Column:
    """Whether an integer's text lies within its type's range."""
    value = F.regexp_replace(F.regexp_replace(text, r"^\+", ""), r"^(-?)0+(?=[0-9])", "$1").try_cast("decimal(38,0)")
    negative = text.startswith("-")
    out = name.isin("integer")
    for kind, (low, high) in INTEGERS.items():
        if kind != "integer":
            # A number too long for 38 digits fails each bound on its side.
            above = lit(True) if low is None else F.coalesce(value >= lit(str(low)).cast("decimal(38,0)"), ~negative)
            below = lit(True) if high is None else F.coalesce(value <= lit(str(high)).cast("decimal(38,0)"), negative)
            out = out | ((name == kind) & above & below)
    return out


def real(text: Column) -> Column:
    """A number's text as a double; the language's INF is Java's Infinity."""
    return F.regexp_replace(text, "INF", "Infinity").try_cast("double")


def number(x: Typed) -> Column:
    """The number struct of a valid numeric literal, else NULL."""
    kind, c = x
    none = lit("")
    if kind == "integer":
        sign, ints, frac = digits(c.cast("string"))
        return F.when(c.isNotNull(), number_struct(0, c, sign, ints, frac))
    if kind == "double":
        return F.when(c.isNotNull(), number_struct(2, c, 0, none, none))
    if kind != "key":
        return lit(None).cast("struct<rank:int,dbl:double,sign:int,ints:string,frac:string>")

    def of(p: Column) -> Column:
        name, text = p["name"], p["text"]
        exact = number_struct(0, text.try_cast("double"), *digits(text))
        whole = name.isin(*INTEGERS) & text.rlike(r"^[+-]?[0-9]+\z") & in_range(name, text)
        decimal = (name == "decimal") & text.rlike(java(DECIMAL))
        floating = text.rlike(java(FLOAT))
        dbl = real(text)
        return (
            F.when(whole | decimal, exact)
            .when((name == "float") & floating, number_struct(1, dbl.cast("float"), 0, none, none))
            .when((name == "double") & floating, number_struct(2, dbl, 0, none, none))
        )

    return F.when(datatype(c).isin(*NUMBERS), let(F.struct(datatype(c).alias("name"), trimmed(c).alias("text")), of))


def magnitude(n: Column) -> Column:
    return F.struct(F.length(n["ints"]), n["ints"], n["frac"])


def compare_numbers(p: Column) -> Column:
    """struct(less, same) of the numbers p.a and p.b, in the wider of their types."""
    a, b = p["a"], p["b"]
    both = (a["rank"] == 0) & (b["rank"] == 0)
    less = F.when(a["sign"] != b["sign"], a["sign"] < b["sign"]).when(a["sign"] >= 0, magnitude(a) < magnitude(b)).otherwise(magnitude(b) < magnitude(a))
    same = (a["sign"] == b["sign"]) & (a["ints"] == b["ints"]) & (a["frac"] == b["frac"])
    wide = (a["rank"] == 2) | (b["rank"] == 2)
    x = F.when(wide, a["dbl"]).otherwise(a["dbl"].cast("float").cast("double"))
    y = F.when(wide, b["dbl"]).otherwise(b["dbl"].cast("float").cast("double"))
    fine = ~F.isnan(x) & ~F.isnan(y)
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(F.when(both, less).otherwise(fine & (x < y)).alias("less"), F.when(both, same).otherwise(fine & (x == y)).alias("same")))


# booleans and times


def boolean(x: Typed, strip: bool = False) -> Column:
    kind, c = x
    if kind == "boolean":
        return c
    if kind != "key":
        return lit(None).cast("boolean")
    text = trimmed(c) if strip else lexical(c)
    return F.when(datatype(c) == "boolean", F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False))


def parts(text: Column, pattern, body) -> Column:
    """body(g) with g(k) a group of the pattern over the whole text, "" if it took no part; NULL where it doesn't match.

    The text is matched once: its groups come back marked off, and a text with the mark in it matches nothing.
    """
    n = pattern.groups
    marked = F.regexp_replace(F.translate(text, "\x01", "?"), java(pattern), "".join(f"\x01${k}" for k in range(1, n + 1)))
    return let(F.split(marked, "\x01"), lambda a: F.when(F.size(a) == n + 1, body(lambda k: F.get(a, lit(k)))))


def zone(z: Column) -> Column:
    """Minutes east of a zone's text; none counts as UTC."""
    minutes = F.substr(z, lit(2), lit(2)).try_cast("int") * 60 + F.substr(z, lit(5), lit(2)).try_cast("int")
    return F.when(z.isin("", "Z"), 0).when(z.startswith("-"), -minutes).otherwise(minutes)


def has_day(y: Column, m: Column, d: Column) -> Column:
    """Whether a month has the day; y: the year, or its last four digits."""
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return (d >= 1) & (d <= F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31))


def day_number(y: Column, m: Column, d: Column) -> Column:
    """Days of the proleptic calendar (any fixed start); NULL for days that a month doesn't have."""
    s = F.when(m <= 2, y - 1).otherwise(y)  # years begin in March
    month = F.when(m > 2, m - 3).otherwise(m + 9)
    before = s * 365 + F.floor(s / 4) - F.floor(s / 100) + F.floor(s / 400) + F.floor((month * 153 + 2) / 5)
    return F.when((y != 0) & has_day(y, m, d), (before + d).cast("bigint"))


def whole_number(text: Column) -> Column:
    return F.when(F.length(text) <= 13, text.try_cast("bigint"))


def fraction(text: Column) -> Column:
    return F.rtrim(F.regexp_replace(text, r"^\.", ""), lit("0"))


def moment(seconds: Column, frac: Column) -> Column:
    """Times order by whole seconds, then by fraction; durations by months and seconds instead."""
    none = lit(None)
    return F.when(seconds.isNotNull(), F.struct(seconds.cast("bigint").alias("at"), frac.alias("frac"), none.cast("bigint").alias("months"), none.cast("decimal(38,18)").alias("secs")))


def clock(g, k: int) -> Column:
    """Seconds of the day; k is the group of the hour, k + 4 that of 24:00."""
    n = lambda i: g(i).try_cast("int")
    return F.when(g(k + 4) != "", 86400).otherwise(n(k) * 3600 + n(k + 1) * 60 + n(k + 2))


def date_of(g) -> Column:
    ymd = F.struct(whole_number(g(1)).alias("y"), g(2).try_cast("int").alias("m"), g(3).try_cast("int").alias("d"))
    return let(ymd, lambda p: day_number(p["y"], p["m"], p["d"]))


def instant(g) -> Column:
    """The moment of a dateTime's groups."""
    return moment(date_of(g) * 86400 + clock(g, 4) - zone(g(9)) * 60, fraction(g(7)))


def date_time(text: Column) -> Column:
    return parts(text, DATETIME, instant)


def date(text: Column) -> Column:
    return parts(text, DATE, lambda g: moment(date_of(g) * 86400 - zone(g(4)) * 60, lit("")))


def time(text: Column) -> Column:
    def of(g) -> Column:
        at = clock(g, 1)
        return moment(F.when(at == 86400, 0).otherwise(at) - zone(g(6)) * 60, fraction(g(4)))

    return parts(text, TIME, of)


def well_formed(name: Column, g) -> Column:
    """Whether the groups of a duration are one of that datatype."""
    some = F.concat(g(2), g(3), g(4), g(6), g(7), g(8)) != ""
    allowed = F.when(name == "dayTimeDuration", (g(2) == "") & (g(3) == "")).when(name == "yearMonthDuration", (g(4) == "") & (g(5) == "")).otherwise(True)
    return some & (g(5) != "T") & allowed


def duration(name: Column, text: Column) -> Column:
    def of(g) -> Column:
        n = lambda i: F.coalesce(F.nullif(g(i), lit("")), lit("0")).try_cast("decimal(20,0)")
        months = (n(2) * 12 + n(3)).cast("bigint")
        seconds = F.coalesce(F.nullif(g(8), lit("")), lit("0")).try_cast("decimal(38,18)")
        secs = ((n(4) * 24 + n(6)) * 3600 + n(7) * 60).try_cast("decimal(38,18)") + seconds
        sign = F.when(g(1) == "-", -1).otherwise(1)
        value = F.struct(lit(None).cast("bigint").alias("at"), lit(None).cast("string").alias("frac"), (sign * months).cast("bigint").alias("months"), (sign * secs).cast("decimal(38,18)").alias("secs"))
        return F.when(well_formed(name, g) & months.isNotNull() & secs.isNotNull(), value)

    return parts(text, DURATION, of)


def constructed(name: str, text: Column) -> Column:
    """Whether a dateTime, date, time or duration can be made of a text; those other than dateTimes of any length."""
    if name == "dateTime":
        return date_time(text).isNotNull()
    if name == "date":
        year = lambda g: F.substr(g(1), lit(-4)).try_cast("int")
        valid = parts(text, DATE, lambda g: ~g(1).isin("0000", "-0000") & has_day(year(g), g(2).try_cast("int"), g(3).try_cast("int")))
    elif name == "time":
        return text.rlike(java(TIME))
    else:
        valid = parts(text, DURATION, lambda g: well_formed(lit(name), g))
    return F.coalesce(valid, lit(False))


def temporal(x: Typed) -> Column:
    """The comparable value of a valid dateTime, date, time or duration, else NULL."""
    kind, c = x
    if kind == "dateTime":
        c = key_of(kind, c)
    elif kind != "key":
        return moment(lit(None).cast("bigint"), lit(""))

    def of(p: Column) -> Column:
        name, text = p["name"], p["text"]
        return F.when(name == "dateTime", date_time(text)).when(name == "date", date(text)).when(name == "time", time(text)).when(name.isin(*DURATIONS), duration(name, text))

    return F.when(datatype(c).isin(*TEMPORAL), let(F.struct(datatype(c).alias("name"), trimmed(c).alias("text")), of))


def compare_times(p: Column) -> Column:
    """struct(less, same); less is NULL for durations without an order."""
    a, b = p["a"], p["b"]
    spans = a["months"].isNotNull()
    same = F.when(spans, (a["months"] == b["months"]) & (a["secs"] == b["secs"])).otherwise((a["at"] == b["at"]) & (a["frac"] == b["frac"]))
    mixed = ((a["months"] != 0) | (b["months"] != 0)) & ((a["secs"] != 0) | (b["secs"] != 0))
    less = F.when(spans, F.when(same, False).when(~mixed, (a["months"] < b["months"]) | ((a["months"] == b["months"]) & (a["secs"] < b["secs"])))).otherwise((a["at"] < b["at"]) | ((a["at"] == b["at"]) & (a["frac"] < b["frac"])))
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(less.alias("less"), same.alias("same")))


# the ladders


def name_of(x: Typed) -> Column:
    kind, c = x
    return datatype(c) if kind == "key" else lit(kind if kind in ("integer", "double", "boolean", "dateTime") else "" if kind == "string" else None)


def may(x: Typed, *kinds: str) -> bool:
    """Whether a value of this slot kind can have one of the datatypes."""
    return x[0] == "key" or x[0] in kinds


def both(x: Typed, y: Typed, of, compare) -> Column:
    return let(F.struct(of(x).alias("a"), of(y).alias("b")), compare)


def bind(xs: list[Typed], body) -> Column:
    """body(xs) with each key evaluated once. Without it a function of a function of a term names that term many times over,
    at each step: Spark works that out for all rows, and copies the expression when it moves a filter."""
    keyed = {f"k{i}": c for i, (k, c) in enumerate(xs) if k == "key"}
    if not keyed:
        return body(xs)
    return let(F.struct(*[c.alias(n) for n, c in keyed.items()]), lambda z: body([(k, z[f"k{i}"] if k == "key" else c) for i, (k, c) in enumerate(xs)]))


def order(x: Typed, y: Typed, swap: bool, strict: bool) -> Column:
    """x < y (strict) or x <= y; with swap, y before x. NULL where the two have no order."""
    return bind([y, x] if swap else [x, y], lambda xs: ordered(*xs, strict))


def ordered(a: Typed, b: Typed, strict: bool) -> Column:
    out = lit(None).cast("boolean")
    hit = lambda r: r["less"] if strict else r["less"] | r["same"]
    if may(a, "string") and may(b, "string"):
        s, t = plain(a), plain(b)
        out = F.when(s.isNotNull() & t.isNotNull(), s < t if strict else s <= t).otherwise(out)
    if may(a, "dateTime") and may(b, "dateTime"):
        out = F.when(name_of(a).isin(*TEMPORAL) & (name_of(a) == name_of(b)), hit(both(a, b, temporal, compare_times))).otherwise(out)
    if may(a, "boolean") and may(b, "boolean"):
        p, q = boolean(a), boolean(b)
        out = F.when((name_of(a) == "boolean") & (name_of(b) == "boolean"), F.when(p.isNotNull() & q.isNotNull(), (~p & q) if strict else ~p | q)).otherwise(out)
    if may(a, "integer", "double") and may(b, "integer", "double"):
        out = F.when(name_of(a).isin(*NUMBERS) & name_of(b).isin(*NUMBERS), hit(both(a, b, number, compare_numbers))).otherwise(out)
    return out


def unpacked(k: Column) -> tuple[Column, Column, Column]:
    """Keys of a triple term's parts: T<n>:<s><m>:<p><o>. NULL for other terms."""
    body = F.when(first(k) == "T", F.substr(k, lit(2)))
    n = F.substring_index(body, ":", 1).try_cast("int")
    rest = F.substr(body, F.position(lit(":"), body) + 1)
    after = F.substr(rest, n + 1)
    m = F.substring_index(after, ":", 1).try_cast("int")
    tail = F.substr(after, F.position(lit(":"), after) + 1)
    return F.substr(rest, lit(1), n), F.substr(tail, lit(1), m), F.substr(tail, m + 1)


def packed(s: Column, p: Column, o: Column) -> Column:
    """The key of a triple term from its parts'."""
    return F.concat(lit("T"), F.length(s).cast("string"), lit(":"), s, F.length(p).cast("string"), lit(":"), p, o)


def opened(a: Column, b: Column) -> Column:
    """struct(a, b, alike, nested): two triple terms down to their innermost objects, and whether all above agrees.

    Subjects and predicates are no literals, so they are equal or not as keys.
    """
    def step(z: Column, _: Column) -> Column:
        (s, p, o), (t, q, r) = unpacked(z["a"]), unpacked(z["b"])
        inner = F.struct(o.alias("a"), r.alias("b"), (z["alike"] & (s == t) & (p == q)).alias("alike"), lit(True).alias("nested"))
        return F.when((first(z["a"]) == "T") & (first(z["b"]) == "T"), inner).otherwise(z)

    start = F.struct(a.alias("a"), b.alias("b"), lit(True).alias("alike"), lit(False).alias("nested"))
    return F.when((first(a) == "T") & (first(b) == "T"), F.aggregate(F.sequence(lit(1), lit(DEPTH)), start, step)).otherwise(start)


def facts(x: Typed) -> Column:
    """What equality asks of a term, each part worked out once."""
    kind, c = x
    literal = first(c) == "L" if kind == "key" else lit(True)
    parts = {"k": c if kind == "key" else key_of(kind, c), "literal": literal, "name": name_of(x), "num": number(x), "tim": temporal(x), "truth": boolean(x), "bool": boolean(x, True)}
    return F.struct(*[v.alias(n) for n, v in parts.items()])


def category(f: Column) -> Column:
    """What a literal's value is: a comparable kind, NULL if it is ill-formed or of an unknown datatype."""
    return (
        F.when(f["name"].isin(*NUMBERS), F.when(f["num"].isNotNull(), "numeric"))
        .when(f["name"] == "boolean", F.when(f["bool"].isNotNull(), "boolean"))
        .when(f["name"].isin(*TEMPORAL), F.when(f["tim"].isNotNull(), f["name"]))
        .when(is_plain(f["k"]), "string")
        .when(is_string(f["k"]), "language")
    )


def judged(z: Column) -> Column:
    """Equality of the terms z.a and z.b (facts), which are the innermost objects of triple terms if z.nested."""
    a, b = z["a"], z["b"]
    numbers = compare_numbers(F.struct(a["num"].alias("a"), b["num"].alias("b")))["same"]
    times = compare_times(F.struct(a["tim"].alias("a"), b["tim"].alias("b")))["same"]
    p, q = category(a), category(b)
    value = F.when(p == "numeric", numbers | (F.isnan(a["num"]["dbl"]) & F.isnan(b["num"]["dbl"]))).when(p == "boolean", a["bool"] == b["bool"]).when(p.isin(*TEMPORAL), times).otherwise(False)
    literals = F.when(p.isNotNull() & q.isNotNull(), F.when(p == q, value).otherwise(False))
    inner = F.when(a["k"] == b["k"], True).when(a["literal"] & b["literal"], literals).otherwise(False)
    return (
        F.when(z["nested"], F.when(inner.isNotNull(), z["alike"] & inner))
        .when(a["name"].isin(*NUMBERS) & b["name"].isin(*NUMBERS), numbers)
        .when((a["name"] == "boolean") & (b["name"] == "boolean"), a["truth"] == b["truth"])
        .otherwise(inner)
    )


def equal(x: Typed, y: Typed) -> Column:
    """The operator =."""
    known = x[1].isNotNull() & y[1].isNotNull()
    if x[0].startswith("ref:") or y[0].startswith("ref:"):
        return F.when(known, key_of(*x) == key_of(*y))
    if x[0] == y[0] == "key":
        terms = lambda z: F.struct(facts(("key", z["a"])).alias("a"), facts(("key", z["b"])).alias("b"), z["alike"].alias("alike"), z["nested"].alias("nested"))
        return F.when(known, let(let(opened(x[1], y[1]), terms), judged))
    whole = lambda xs: let(F.struct(facts(xs[0]).alias("a"), facts(xs[1]).alias("b"), lit(True).alias("alike"), lit(False).alias("nested")), judged)
    return F.when(known, bind([x, y], whole))


def ebv(k: Column) -> Column:
    n = number(("key", k))
    truth = let(n, lambda z: F.when(z["rank"] == 0, z["sign"] != 0).otherwise(~F.isnan(z["dbl"]) & (z["dbl"] != 0)))
    return F.when(is_plain(k), F.length(k) > 4).when(datatype(k) == "boolean", boolean(("key", k))).when(datatype(k).isin(*NUMBERS), truth)


# strings


def text_of(x: Typed) -> Column:
    """The text of a string with or without a language, else NULL."""
    kind, c = x
    if kind == "string":
        return c
    return F.when(is_string(c), lexical(c)) if kind == "key" else lit(None).cast("string")


def like(x: Typed, text: Column) -> Typed:
    """A string with x's language and direction."""
    kind, c = x
    return ("string", text) if kind == "string" else ("key", F.concat(tags(c), lit("\x01"), text))


def compatible(x: Typed, y: Typed) -> Column:
    """Whether y is plain, or has x's language and direction."""
    if y[0] == "string":
        return lit(True)
    return is_plain(y[1]) | (tags(key_of(*x)) == tags(y[1]))


def joined(xs: list[Typed]) -> Typed:
    """CONCAT: the language and direction that all share, else a plain string."""
    if all(k == "string" for k, _ in xs):
        return "string", F.concat(*[c for _, c in xs]) if xs else lit("")
    text = F.concat(*[text_of(x) for x in xs])
    heads = [tags(key_of(*x)) for x in xs]
    alike = lit(True)
    for h in heads[1:]:
        alike = alike & (h == heads[0])
    return "key", F.concat(F.when(alike, heads[0]).otherwise(lit("L\x01\x01")), lit("\x01"), text)


def datatype_iri(x: Typed) -> Column:
    """DATATYPE as a key."""
    kind, c = x
    if kind.startswith("ref:"):
        return lit(None).cast("string")
    if kind != "key":
        return F.when(c.isNotNull(), lit("I" + (STRING if kind == "string" else XSD + kind)))
    whole = F.substr(F.substring_index(c, "\x01", 1), lit(2))
    direction = F.substring_index(tags(c), "\x01", -1)
    return F.when(first(c) == "L", F.concat(lit("I"), F.when(whole != "", whole).when(direction != "", DIR_LANG_STRING).when(is_plain(c), STRING).otherwise(LANG_STRING)))


def date_part(k: Column, part: str) -> Column:
    """YEAR, MONTH, DAY, HOURS or MINUTES of dateTimes; 24:00 is the next day (of years up to 9999)."""
    at = {"YEAR": 1, "MONTH": 2, "DAY": 3, "HOURS": 4, "MINUTES": 5}[part]

    def of(g) -> Column:
        after = F.date_add(F.substr(F.concat_ws("-", g(1), g(2), g(3)), lit(1), lit(10)).try_cast("date"), 1)
        late = {"YEAR": F.year(after), "MONTH": F.month(after), "DAY": F.day(after), "HOURS": lit(0), "MINUTES": lit(0)}[part]
        return F.when(instant(g).isNotNull(), F.when(g(8) != "", late.cast("bigint")).otherwise(whole_number(g(at))))

    return F.when(datatype(k) == "dateTime", parts(trimmed(k), DATETIME, of))


def zone_part(k: Column, part: str) -> Column:
    """TZ of dateTimes as text, or TIMEZONE as a key; NULL for a TIMEZONE that isn't given."""
    def of(g) -> Column:
        z, n = g(9), zone(g(9))
        if part == "TZ":
            out = F.when((n == 0) & (z != ""), "Z").otherwise(z)
        else:
            span = F.concat(lit(typed_prefix("dayTimeDuration")), F.when(n < 0, "-").otherwise(""), lit("PT"), F.floor(F.abs(n) / 60).cast("string"), lit("H"), (F.abs(n) % 60).cast("string"), lit("M"))
            out = F.when(z != "", span)
        return F.when(instant(g).isNotNull(), out)

    return F.when(datatype(k) == "dateTime", parts(trimmed(k), DATETIME, of))


__all__ = ["bind", "compatible", "constructed", "date_part", "datatype_iri", "ebv", "equal", "joined", "like", "number", "order", "packed", "plain", "text_of", "unpacked", "zone_part"]
