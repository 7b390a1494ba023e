"""Results of goals as JSON, tables and text; on the driver, or column by column in Spark."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.terms import BNode, IRI, Literal, Term, TripleTerm, nt


def binding(t: Term) -> dict:
    if isinstance(t, IRI):
        return {"type": "uri", "value": t.value}
    if isinstance(t, BNode):
        return {"type": "bnode", "value": t.label}
    if isinstance(t, TripleTerm):
        return {"type": "triple", "value": {k: binding(x) for k, x in (("subject", t.subject), ("predicate", t.predicate), ("object", t.object))}}
    assert isinstance(t, Literal)
    extra = {"xml:lang": t.lang, "its:dir": t.direction, "datatype": t.datatype}
    return {"type": "literal", "value": t.value, **{k: x for k, x in extra.items() if x}}


def as_json(result) -> dict:
    return {
        "head": {"vars": [v.value for v in result.variables]},
        "results": {"bindings": [{v.value: binding(t) for v, t in row.items()} for row in result.bindings]},
        "boolean": result.boolean,
    }


def as_tsv(result) -> str:
    rows = ["\t".join("?" + v.value for v in result.variables)]
    rows += ["\t".join(nt(row[v]) for v in result.variables) for row in result.bindings]
    return "\n".join(rows)


def nt_column(c):
    """N-Triples form of a key column, for IRIs, blank nodes, literals and one level of triple terms."""
    from stratalog.plans.bodies import unpacked

    def simple(k):
        first = F.substr(k, F.lit(1), F.lit(1))
        parts = F.split(F.substr(k, F.lit(2)), "\x01", 4)
        text = F.get(parts, F.lit(3))
        for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
            text = F.replace(text, F.lit(a), F.lit(b))
        dt, lang, direction = (F.get(parts, F.lit(i)) for i in range(3))
        tail = F.when(lang != "", F.concat(F.lit("@"), lang, F.when(direction != "", F.concat(F.lit("--"), direction)).otherwise(""))).when(dt != "", F.concat(F.lit("^^<"), dt, F.lit(">"))).otherwise("")
        return F.when(first == "I", F.concat(F.lit("<"), F.substr(k, F.lit(2)), F.lit(">"))).when(first == "B", F.concat(F.lit("_:"), F.substr(k, F.lit(2)))).when(first == "L", F.concat(F.lit('"'), text, F.lit('"'), tail))

    s, p, o = (simple(x) for x in unpacked(c))
    return F.coalesce(simple(c), F.concat(F.lit("<<( "), s, F.lit(" "), p, F.lit(" "), o, F.lit(" )>>")))


def write_ntriples(triples: DataFrame, path: str) -> None:
    """A table of keys (s, p, o) as N-Triples text, written where its rows lie."""
    line = F.concat(nt_column(F.col("s")), F.lit(" "), nt_column(F.col("p")), F.lit(" "), nt_column(F.col("o")), F.lit(" ."))
    triples.select(line.alias("value")).write.text(path)


def write_tsv(result, path: str) -> None:
    cols = [nt_column(F.col(v.value)) for v in result.variables]
    result.keys.select(F.concat_ws("\t", *cols).alias("value")).write.text(path)
