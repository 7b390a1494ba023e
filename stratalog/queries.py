"""Registered queries: goals over mapped tables, each with equivalent SQL."""
from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.api import infer_frame, query, text
from stratalog.bridge import handle_request_json
from stratalog.functions.exact import FunctionRegistry
from stratalog.operators.materialize import shared_dir
from stratalog.sources.graph import Graph, parse_data, read_ntriples
from stratalog.sources.imports import MappingImportResolver
from stratalog.sources.relations import Mapping, Source
from stratalog.sources.results import write_ntriples
from stratalog.terms import XSD, Literal, term

TABLES: dict[str, tuple[str, dict[str, str]]] = {
    "region": ("r_regionkey", {}),
    "nation": ("n_nationkey", {"n_regionkey": "region"}),
    "customer": ("c_custkey", {"c_nationkey": "nation"}),
    "supplier": ("s_suppkey", {"s_nationkey": "nation"}),
    "part": ("p_partkey", {}),
    "orders": ("o_orderkey", {"o_custkey": "customer"}),
    "lineitem": ("row_id", {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}),
    "events": ("event_id", {"user_id": "customer"}),
    "documents": ("doc_id", {}),
    "labels": ("doc_id", {"doc_id": "documents"}),
    "benchmark": ("item_id", {}),
    "pages": ("page_id", {}),
    "conversations": ("turn_id", {}),
}
PREFIXES = "PREFIX c: <urn:c:> PREFIX fk: <urn:fk:> PREFIX t: <urn:t:> PREFIX : <urn:x:> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> "


def tables(spark: SparkSession, sf_dir: str, *names: str) -> Source:
    """A source of the named tables, mapped; nothing is read yet."""
    out = Source(spark)
    for name in names:
        k, links = TABLES[name]
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if name == "lineitem":
            # Line numbers repeat, so the whole row is the key.
            df = df.withColumn(k, F.coalesce(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in df.columns]), 256), F.lit("")))
        elif name == "conversations":
            df = df.withColumn(k, F.concat_ws("/", "conv_id", "turn")).withColumn("next_id", F.concat_ws("/", "conv_id", F.col("turn") + 1))
            links = {"next_id": name}
        out.add_mapping(Mapping(name, df, k, {c: f"urn:t:{t}:" for c, t in links.items()}, unique=name != "lineitem"))
    return out


@dataclass(frozen=True)
class Query:
    """tables, rules and a goal; project turns the goal's frame into the result."""

    tables: tuple[str, ...]
    goal: str
    sql: str | None = None
    rules: str = ""
    project: Callable[[DataFrame], DataFrame] | None = None
    options: Callable[[], dict] | None = None
    #: More data, added to the mapped tables.
    data: Callable[[SparkSession, str, Source], None] | None = None
    #: Another way to run than query().
    how: Callable[[SparkSession, str, Source, str, str], DataFrame] | None = None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        source = tables(spark, sf_dir, *self.tables)
        if self.data:
            self.data(spark, sf_dir, source)
        rules, goal = PREFIXES + self.rules, PREFIXES + self.goal
        if self.how:
            return self.how(spark, sf_dir, source, rules, goal)
        r = query(rules, source, goal, spark=spark, **(self.options() if self.options else {}))
        return self.project(r.frame) if self.project else r.frame


def shout(t: Literal) -> Literal:
    return Literal(t.value.upper() + "!", datatype=t.datatype)


def registry() -> dict:
    reg = FunctionRegistry()
    reg.register("urn:x:shout", shout)
    return {"function_registry": reg}


def shout_columns(x):
    """shout() over columns; other kinds are left to the function of terms."""
    kind, c = x
    return ("string", F.concat(F.upper(c), F.lit("!"))) if kind == "string" else None


def column_registry() -> dict:
    reg = FunctionRegistry()
    reg.register("urn:x:shout", shout, shout_columns)
    return {"function_registry": reg}


#: Three facts about nations, in every format that documents come in.
DOCUMENTS = {
    "turtle": "@prefix n: <urn:t:nation:> . @prefix : <urn:x:> . :a :about n:1 , n:2 ; :note \"x\"@en . :b :about n:3 .",
    "nt": "<urn:x:a> <urn:x:about> <urn:t:nation:1> .\n<urn:x:a> <urn:x:about> <urn:t:nation:2> .\n<urn:x:b> <urn:x:about> <urn:t:nation:3> .\n",
    "trig": "@prefix n: <urn:t:nation:> . @prefix : <urn:x:> . { :a :about n:1 } :g { :a :about n:2 . :b :about n:3 }",
    "nquads": "<urn:x:a> <urn:x:about> <urn:t:nation:1> .\n<urn:x:a> <urn:x:about> <urn:t:nation:2> <urn:x:g> .\n<urn:x:b> <urn:x:about> <urn:t:nation:3> <urn:x:g> .\n",
    "rdfxml": '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:x="urn:x:"><rdf:Description rdf:about="urn:x:a"><x:about rdf:resource="urn:t:nation:1"/><x:about rdf:resource="urn:t:nation:2"/></rdf:Description><rdf:Description rdf:about="urn:x:b"><x:about rdf:resource="urn:t:nation:3"/></rdf:Description></rdf:RDF>',
    "jsonld": '{"@context": {"about": {"@id": "urn:x:about", "@type": "@id"}}, "@graph": [{"@id": "urn:x:a", "about": ["urn:t:nation:1", "urn:t:nation:2"]}, {"@id": "urn:x:b", "about": "urn:t:nation:3"}]}',
}
DOCUMENT_SQL = "SELECT 'urn:x:' || d AS d, n_name AS name FROM (VALUES ('a', 1), ('a', 2), ('b', 3)) AS x(d, k) JOIN nation ON n_nationkey = k"


def document(format: str) -> Query:
    """A document of one format, joined with a mapped table."""
    def add(spark: SparkSession, sf_dir: str, source: Source) -> None:
        source.add_triples(parse_data(DOCUMENTS[format], format, dataset_policy="union"))

    return Query(("nation",), "{ ?d :about ?n . ?n c:n_name ?name }", DOCUMENT_SQL, project=KEEP("d", "name"), data=add)


def through_files(spark: SparkSession, sf_dir: str, source: Source) -> None:
    """Nations as an N-Triples file, written and parsed on the executors."""
    path = f"{shared_dir(spark)}/stratalog-nt-{uuid.uuid4().hex}"
    write_ntriples(tables(spark, sf_dir, "nation").everything(), path)
    source.add_table(read_ntriples(spark, path))


def inferred(spark: SparkSession, sf_dir: str, source: Source, rules: str, goal: str) -> DataFrame:
    """All that infer_frame derives, as text."""
    df = infer_frame(rules, source, spark=spark)
    return df.select(*[text("key", F.col(c)).alias(c) for c in "spo"])


def bridged(spark: SparkSession, sf_dir: str, source: Source, rules: str, goal: str) -> DataFrame:
    """A request of the JSON bridge over the regions, which are few."""
    data = Graph(tuple(map(term, r)) for r in source.everything().collect()).serialize("nt")
    out = json.loads(handle_request_json(json.dumps({"id": 1, "action": "query", "rules": rules, "data": data, "goal": goal, "options": {"dataFormat": "nt"}})))
    rows = [(b["x"]["value"], b["name"]["value"]) for b in out["result"]["results"]["bindings"]]
    return spark.createDataFrame(rows, "x string, name string")


IMPORTED = PREFIXES + "IMPORTS <urn:doc:b> RULE { ?n :named ?x } WHERE { ?n c:n_name ?x }"
IMPORTED_B = PREFIXES + "RULE { ?r :named ?x } WHERE { ?r c:r_name ?x }"
# Integer types that hold the key of every nation but 0.
INTEGER_CASTS = ("integer", "long", "int", "short", "byte", "nonNegativeInteger", "positiveInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte")
KEEP = lambda *names: lambda df: df.select(*names)
TURNS = "RULE { ?a :next ?b } WHERE { ?a fk:next_id ?b . ?b c:conv_id ?k } "
ID = lambda *names: lambda df: df.select(*[F.regexp_extract(n, r"[^:]*$", 0).alias(n) for n in names])
CYCLE = "RULE { ?n :link ?r } WHERE { ?n fk:n_regionkey ?r } RULE { ?r :link ?n } WHERE { ?n fk:n_regionkey ?r } "
CYCLE_SQL = """WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS a, 'r' || n_regionkey AS b FROM nation UNION SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation),
t AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a) """
REACH_SQL = """WITH RECURSIVE e AS (SELECT x.conv_id || '/' || x.turn AS a, y.conv_id || '/' || y.turn AS b FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1),
t AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a) """

QUERIES: dict[str, Query] = {
    "scan_pattern": Query(("customer",), '{ ?c c:c_mktsegment "BUILDING" ; c:c_custkey ?k ; c:c_name ?name }',
        "SELECT 'urn:t:customer:' || c_custkey AS c, c_custkey AS k, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "join_chain": Query(("customer", "nation", "region"), "{ ?c :inRegion ?r . ?c c:c_custkey ?k . ?r c:r_name ?region }",
        "SELECT c_custkey AS k, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
        "RULE { ?c :inRegion ?r } WHERE { ?c fk:c_nationkey ?n . ?n fk:n_regionkey ?r }", KEEP("k", "region")),
    "seq_path": Query(("orders", "customer", "nation"), "{ ?o c:o_orderkey ?k ; fk:o_custkey/fk:c_nationkey/c:n_name ?nation }",
        "SELECT o_orderkey AS k, n_name AS nation FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey", project=KEEP("k", "nation")),
    "inverse_path": Query(("orders", "customer", "nation"), "{ ?n c:n_name ?nation ; ^fk:c_nationkey/^fk:o_custkey/c:o_orderstatus ?status }",
        "SELECT n_name AS nation, o_orderstatus AS status FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey", project=KEEP("nation", "status")),
    "repeated_var": Query(("orders", "lineitem"), "{ ?x :same ?x . ?x c:o_orderkey ?k }",
        "SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 200000 OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)",
        "RULE { ?o :same ?o } WHERE { ?o c:o_totalprice ?t FILTER(?t > 200000) } RULE { ?o :same ?o } WHERE { ?l fk:l_orderkey ?o ; c:l_quantity ?q FILTER(?q > 49) }", KEEP("k")),
    "var_predicate": Query(("region",), "{ <urn:t:region:1> ?p ?v }",
        "SELECT 'urn:c:r_regionkey' AS p, r_regionkey::VARCHAR AS v FROM region WHERE r_regionkey = 1 UNION ALL SELECT 'urn:c:r_name', r_name FROM region WHERE r_regionkey = 1"),
    "cross_product": Query(("region",), "{ ?a c:r_name ?x . ?b c:r_name ?y }", "SELECT a.r_name AS x, b.r_name AS y FROM region a CROSS JOIN region b", project=KEEP("x", "y")),
    "filter_numeric": Query(("lineitem",), "{ ?l c:l_orderkey ?k ; c:l_quantity ?q ; c:l_discount ?d FILTER(?q >= 45 && (?d < 0.02e0 || ?d > 0.08e0) && ?q != 47) }",
        "SELECT l_orderkey AS k, l_quantity AS q, l_discount AS d FROM (SELECT DISTINCT * FROM lineitem) WHERE l_quantity >= 45 AND (l_discount < 0.02 OR l_discount > 0.08) AND l_quantity <> 47", project=KEEP("k", "q", "d")),
    "filter_string": Query(("part",), '{ ?p c:p_partkey ?k ; c:p_type ?t ; c:p_brand ?b FILTER(CONTAINS(?t, "STEEL") || STRSTARTS(?b, "Brand#1") || STRENDS(?t, "BRASS")) }',
        "SELECT p_partkey AS k, p_type AS t, p_brand AS b FROM part WHERE contains(p_type, 'STEEL') OR starts_with(p_brand, 'Brand#1') OR ends_with(p_type, 'BRASS')", project=KEEP("k", "t", "b")),
    "filter_regex": Query(("customer",), '{ ?c c:c_custkey ?k ; c:c_name ?n FILTER(REGEX(?n, "^customer#0*[1-9]00$", "i")) }',
        "SELECT c_custkey AS k, c_name AS n FROM customer WHERE regexp_matches(c_name, '^customer#0*[1-9]00$', 'i')", project=KEEP("k", "n")),
    "filter_date": Query(("orders",), '{ ?o c:o_orderkey ?k ; c:o_orderdate ?d FILTER(?d >= "1995-03-01T00:00:00"^^xsd:dateTime && ?d < "1995-06-01T00:00:00"^^xsd:dateTime) }',
        "SELECT o_orderkey AS k, o_orderdate AS d FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate < TIMESTAMP '1995-06-01'", project=KEEP("k", "d")),
    "in_not_in": Query(("orders",), '{ ?o c:o_orderkey ?k ; c:o_orderpriority ?p ; c:o_orderstatus ?s FILTER(?p IN ("1-URGENT", "2-HIGH") && ?s NOT IN ("F", "P")) }',
        "SELECT o_orderkey AS k, o_orderpriority AS p, o_orderstatus AS s FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('F', 'P')", project=KEEP("k", "p", "s")),
    "if_set": Query(("customer",), '{ ?c c:c_custkey ?k ; c:c_acctbal ?b SET(?grade := IF(?b < 0, "debt", IF(?b > 5000, "high", "mid"))) }',
        "SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal > 5000 THEN 'high' ELSE 'mid' END AS grade FROM customer", project=KEEP("k", "grade")),
    "arithmetic": Query(("lineitem",), "{ ?l c:l_orderkey ?k ; c:l_extendedprice ?e ; c:l_discount ?d ; c:l_linenumber ?n SET(?net := ?e * (1 - ?d)) SET(?m := ?n * 1000 + -?k) SET(?ratio := ?e / ?n) }",
        "SELECT l_extendedprice * (1 - l_discount) AS net, (l_linenumber * 1000 - l_orderkey)::DECIMAL(38, 0) AS m, l_extendedprice / l_linenumber AS ratio FROM (SELECT DISTINCT * FROM lineitem)", project=KEEP("net", "m", "ratio")),
    "string_functions": Query(("part",), '{ ?p c:p_partkey ?k ; c:p_name ?n SET(?u := UCASE(?n)) SET(?l := STRLEN(?n)) SET(?s := SUBSTR(?n, 2, 4)) SET(?a := STRAFTER(?n, " ")) SET(?b := STRBEFORE(?n, " ")) SET(?j := CONCAT(?b, "/", STR(?k))) SET(?x := ENCODE_FOR_URI(?n)) }',
        "SELECT p_partkey AS k, upper(p_name) AS u, length(p_name) AS l, substr(p_name, 2, 4) AS s, CASE WHEN instr(p_name, ' ') > 0 THEN substr(p_name, instr(p_name, ' ') + 1) ELSE '' END AS a, CASE WHEN instr(p_name, ' ') > 0 THEN substr(p_name, 1, instr(p_name, ' ') - 1) ELSE '' END AS b, (CASE WHEN instr(p_name, ' ') > 0 THEN substr(p_name, 1, instr(p_name, ' ') - 1) ELSE '' END) || '/' || p_partkey AS j, url_encode(p_name) AS x FROM part",
        project=KEEP("k", "u", "l", "s", "a", "b", "j", "x")),
    "date_parts": Query(("events",), "{ ?e c:event_id ?k ; c:ts ?t SET(?y := YEAR(?t)) SET(?m := MONTH(?t)) SET(?d := DAY(?t)) SET(?h := HOURS(?t)) SET(?i := MINUTES(?t)) }",
        "SELECT event_id AS k, year(ts)::INT AS y, month(ts)::INT AS m, day(ts)::INT AS d, hour(ts)::INT AS h, minute(ts)::INT AS i FROM events", project=KEEP("k", "y", "m", "d", "h", "i")),
    "numeric_functions": Query(("customer",), "{ ?c c:c_custkey ?k ; c:c_acctbal ?b SET(?a := ABS(?b)) SET(?f := FLOOR(?b)) SET(?t := CEIL(?b)) SET(?r := ROUND(?b)) }",
        "SELECT c_custkey AS k, abs(c_acctbal) AS a, floor(c_acctbal) AS f, ceil(c_acctbal) AS t, floor(c_acctbal) + CASE WHEN c_acctbal - floor(c_acctbal) >= 0.5 THEN 1 ELSE 0 END AS r FROM customer", project=KEEP("k", "a", "f", "t", "r")),
    "casts": Query(("customer",), "{ ?c c:c_custkey ?k ; c:c_acctbal ?b SET(?d := xsd:double(?k)) SET(?s := xsd:string(?k)) SET(?z := xsd:boolean(?k)) SET(?i := STR(xsd:integer(?b))) }",
        "SELECT c_custkey AS k, c_custkey::DOUBLE AS d, c_custkey::VARCHAR AS s, c_custkey <> 0 AS z, trunc(c_acctbal)::BIGINT::VARCHAR AS i FROM customer", project=KEEP("k", "d", "s", "z", "i")),
    "negation": Query(("customer", "orders"), "{ ?c c:c_custkey ?k NOT { ?o fk:o_custkey ?c ; c:o_totalprice ?p FILTER(?p > 300000) } }",
        "SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)", project=KEEP("k")),
    "negation_correlated": Query(("orders",), "{ ?o fk:o_custkey ?c ; c:o_orderkey ?k ; c:o_totalprice ?p NOT { ?o2 fk:o_custkey ?c ; c:o_totalprice ?p2 FILTER(?p2 > ?p) } }",
        "SELECT o_orderkey AS k FROM orders a WHERE NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_totalprice > a.o_totalprice)", project=KEEP("k")),
    "negation_data": Query(("nation", "region"), "{ ?n c:n_nationkey ?k NOT DATA { ?n :mark ?x } }", "SELECT n_nationkey::BIGINT AS k FROM nation", "RULE { ?n :mark 1 } WHERE { ?n c:n_nationkey ?k }", KEEP("k")),
    "where_data": Query(("nation", "region"), "{ ?n :b ?k }", "SELECT n_nationkey::VARCHAR AS k FROM nation WHERE n_regionkey = 1",
        "RULE { ?n c:extra 5 } WHERE { ?n c:n_nationkey ?k } RULE { ?n :b ?e } WHERE DATA { ?n c:extra ?e } RULE { ?n :b ?k } WHERE DATA { ?n c:n_nationkey ?k ; c:n_regionkey 1 }", KEEP("k")),
    "union_rules": Query(("customer", "supplier", "nation"), "{ ?n :hasParty ?p . ?n c:n_name ?name }",
        "SELECT n_name AS name, p FROM (SELECT c_nationkey AS k, 'urn:t:customer:' || c_custkey AS p FROM customer UNION SELECT s_nationkey, 'urn:t:supplier:' || s_suppkey FROM supplier) JOIN nation ON k = n_nationkey",
        "RULE { ?n :hasParty ?p } WHERE { ?p fk:c_nationkey ?n } RULE { ?n :hasParty ?p } WHERE { ?p fk:s_nationkey ?n }", KEEP("name", "p")),
    "intersect_rules": Query(("orders", "events"), "{ ?c :active 1 }",
        "SELECT 'urn:t:customer:' || o_custkey AS c FROM orders INTERSECT SELECT 'urn:t:customer:' || user_id FROM events WHERE event_type = 'purchase'",
        'RULE { ?c :active 1 } WHERE { ?o fk:o_custkey ?c . ?e fk:user_id ?c ; c:event_type "purchase" }', KEEP("c")),
    "except_rules": Query(("orders", "events"), "{ ?c :quiet 1 }",
        "SELECT 'urn:t:customer:' || o_custkey AS c FROM orders EXCEPT SELECT 'urn:t:customer:' || user_id FROM events",
        "RULE { ?c :buys 1 } WHERE { ?o fk:o_custkey ?c } RULE { ?c :seen 1 } WHERE { ?e fk:user_id ?c } RULE { ?c :quiet 1 } WHERE { ?c :buys 1 NOT { ?c :seen 1 } }", KEEP("c")),
    "recursion_linear": Query(("conversations",), "{ ?a :later ?b }", REACH_SQL + "SELECT a, b FROM t",
        TURNS + "RULE { ?a :later ?b } WHERE { ?a :next ?b } RULE { ?a :later ?c } WHERE { ?a :later ?b . ?b :next ?c }", ID("a", "b")),
    "recursion_nonlinear": Query(("conversations",), "{ ?a :next ?b }", REACH_SQL + "SELECT a, b FROM t", TURNS + "RULE { ?a :next ?c } WHERE { ?a :next ?b . ?b :next ?c }", ID("a", "b")),
    "recursion_cyclic": Query(("nation", "region"), "{ ?a :link ?b }", CYCLE_SQL + "SELECT CASE WHEN a[1] = 'n' THEN 'urn:t:nation:' ELSE 'urn:t:region:' END || a[2:] AS a, CASE WHEN b[1] = 'n' THEN 'urn:t:nation:' ELSE 'urn:t:region:' END || b[2:] AS b FROM t",
        CYCLE + "RULE { ?a :link ?c } WHERE { ?a :link ?b . ?b :link ?c }"),
    "strat_recursion_negation": Query(("nation", "region"), "{ ?a :apart ?b }",
        CYCLE_SQL + "SELECT 'urn:t:nation:' || x.n_nationkey AS a, 'urn:t:nation:' || y.n_nationkey AS b FROM nation x, nation y WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.a = 'n' || x.n_nationkey AND t.b = 'n' || y.n_nationkey)",
        CYCLE + "RULE { ?a :link ?c } WHERE { ?a :link ?b . ?b :link ?c } RULE { ?a :apart ?b } WHERE { ?a c:n_nationkey ?x . ?b c:n_nationkey ?y NOT { ?a :link ?b } }"),
    "head_bnode_count": Query(("customer", "nation"), "{ ?v :of ?c ; :at ?n . ?c c:c_custkey ?k . ?n c:n_nationkey ?m }",
        "SELECT c_custkey AS k, n_nationkey::BIGINT AS m FROM customer JOIN nation ON c_nationkey = n_nationkey", "RULE { [ :of ?c ; :at ?n ] :kind \"visit\" } WHERE { ?c fk:c_nationkey ?n }",
        lambda df: df.select("k", "m")),
    "triple_terms": Query(("nation", "region"), "{ ?x :says <<( ?n fk:n_regionkey ?r )>> . ?x :says ?t SET(?s := SUBJECT(?t)) FILTER(ISTRIPLE(?t) && ?s = ?n) . ?n c:n_name ?name . ?r c:r_name ?region }",
        "SELECT n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey", "RULE { ?n :says <<( ?n fk:n_regionkey ?r )>> } WHERE { ?n fk:n_regionkey ?r }", KEEP("name", "region")),
    "collections": Query(("region",), "{ :list :member ?m }", "SELECT 'urn:t:region:' || v AS m FROM (VALUES (0), (2), (4)) AS x(v)",
        "PREFIX rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> PREFIX r: <urn:t:region:> DATA { :list :items (r:0 r:2 r:4) } RULE { :list :cell ?c } WHERE { :list :items ?c } RULE { :list :cell ?d } WHERE { :list :cell ?c . ?c rdf:rest ?d } RULE { :list :member ?m } WHERE { :list :cell ?c . ?c rdf:first ?m }"),
    "udf_registry": Query(("nation",), "{ ?n c:n_nationkey ?k ; c:n_name ?x SET(?y := :shout(?x)) }", "SELECT n_nationkey::BIGINT AS k, upper(n_name) || '!' AS y FROM nation", project=KEEP("k", "y"), options=registry),
    "data_block": Query(("region",), "{ ?r :rank ?v ; c:r_name ?name }", "SELECT r_name AS name, v::VARCHAR AS v FROM region JOIN (VALUES (0, 10), (1, 20)) AS x(k, v) ON k = r_regionkey",
        "DATA { <urn:t:region:0> :rank 10 . <urn:t:region:1> :rank 20 }", KEEP("name", "v")),
    "imports_mapping": Query(("nation", "region"), "{ ?x :named ?name }", "SELECT 'urn:t:nation:' || n_nationkey AS x, n_name AS name FROM nation UNION SELECT 'urn:t:region:' || r_regionkey, r_name FROM region",
        "IMPORTS <urn:doc:a>", options=lambda: {"import_resolver": MappingImportResolver({"urn:doc:a": IMPORTED, "urn:doc:b": IMPORTED_B})}),
    "term_functions": Query(("nation",), '{ ?n c:n_nationkey ?k ; c:n_name ?x SET(?i := STR(DATATYPE(?k))) SET(?l := LANG(STRLANG(?x, "en"))) SET(?u := STR(IRI(CONCAT("urn:n:", STR(?k))))) FILTER(ISIRI(?n) && ISNUMERIC(?k) && ISLITERAL(?x) && SAMETERM(?k, ?k)) }',
        f"SELECT n_nationkey::BIGINT AS k, '{XSD}integer' AS i, 'en' AS l, 'urn:n:' || n_nationkey AS u FROM nation", project=KEEP("k", "i", "l", "u")),
    "replace_function": Query(("part",), '{ ?p c:p_partkey ?k ; c:p_brand ?b SET(?r := REPLACE(?b, "Brand#([0-9])([0-9])", "B$2-$1")) }', "SELECT p_partkey AS k, regexp_replace(p_brand, 'Brand#([0-9])([0-9])', 'B\\2-\\1', 'g') AS r FROM part", project=KEEP("k", "r")),
    "star_scan": Query(("orders", "customer"), '{ ?o c:o_orderkey ?k ; c:o_totalprice ?p ; c:o_orderdate ?d ; fk:o_custkey ?c . ?c c:c_mktsegment "MACHINERY" ; c:c_name ?name FILTER(?p > 100000) }',
        "SELECT o_orderkey AS k, o_totalprice AS p, o_orderdate AS d, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY' AND o_totalprice > 100000", project=KEEP("k", "p", "d", "name")),
    "derived_join": Query(("lineitem", "orders", "customer", "part"), "{ ?c :wants ?p . ?p c:p_size ?z FILTER(?z > 45) }",
        "SELECT DISTINCT 'urn:t:customer:' || o_custkey AS c, 'urn:t:part:' || l_partkey AS p, p_size::BIGINT AS z FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_size > 45",
        "RULE { ?c :wants ?p } WHERE { ?l fk:l_partkey ?p ; fk:l_orderkey ?o . ?o fk:o_custkey ?c }"),
    "theta_join": Query(("nation",), "{ ?a c:n_nationkey ?x ; c:n_regionkey ?r . ?b c:n_nationkey ?y ; c:n_regionkey ?r FILTER(?x < ?y) }",
        "SELECT a.n_nationkey::BIGINT AS x, b.n_nationkey::BIGINT AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", project=KEEP("x", "y")),
    "negation_uncorrelated": Query(("region", "nation"), "{ ?r c:r_name ?name NOT { ?x :nothing ?y } }", "SELECT r_name AS name FROM region", project=KEEP("name")),
    "negation_empty": Query(("region",), "{ ?r c:r_name ?name NOT { } }", "SELECT r_name AS name FROM region WHERE false", project=KEEP("name")),
    "blank_in_body": Query(("orders", "customer"), "{ _:o fk:o_custkey ?c ; c:o_orderstatus ?s . ?c c:c_name ?name }",
        "SELECT o_orderstatus AS s, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey", project=KEEP("s", "name")),
    "anonymous_objects": Query(("nation", "region"), "{ ?n fk:n_regionkey [ c:r_name ?region ] ; c:n_name ?name }", "SELECT n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey", project=KEEP("name", "region")),
    "reifiers": Query(("nation", "region"), "{ ?n fk:n_regionkey ?r ~ ?x {| :by ?who |} . ?n c:n_name ?name }", "SELECT n_name AS name, r_name AS who FROM nation JOIN region ON n_regionkey = r_regionkey",
        "PREFIX rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> RULE { ?n rdf:reifies <<( ?n fk:n_regionkey ?r )>> . ?n :by ?w } WHERE { ?n fk:n_regionkey ?r . ?r c:r_name ?w }", KEEP("name", "who")),
    "logic": Query(("customer",), '{ ?c c:c_custkey ?k ; c:c_acctbal ?b ; c:c_mktsegment ?m FILTER(!(?b > 0 && ?m = "BUILDING") && (?m IN ("BUILDING", "MACHINERY") || +?b >= -?b)) }',
        "SELECT c_custkey AS k FROM customer WHERE NOT (c_acctbal > 0 AND c_mktsegment = 'BUILDING') AND (c_mktsegment IN ('BUILDING', 'MACHINERY') OR c_acctbal >= -c_acctbal)", project=KEEP("k")),
    "equal_triple_terms": Query(("nation", "region"), "{ ?n :says ?t . ?n c:n_name ?name FILTER(?t = <<( <urn:x:s> <urn:x:p> 1.0 )>>) }", "SELECT n_name AS name FROM nation WHERE n_regionkey = 1",
        "RULE { ?n :says <<( :s :p ?k )>> } WHERE { ?n c:n_regionkey ?k }", KEEP("name")),
    "language_functions": Query(("nation",), '{ ?n c:n_nationkey ?k ; c:n_name ?x SET(?t := STRLANGDIR(?x, "en-GB", "rtl")) SET(?d := LANGDIR(?t)) SET(?l := LANG(?t)) SET(?low := STR(LCASE(?t))) FILTER(HASLANG(?t) && HASLANGDIR(?t) && !HASLANG(?x) && LANGMATCHES(?l, "EN") && LANGMATCHES(?l, "*")) }',
        "SELECT n_nationkey::BIGINT AS k, 'rtl' AS d, 'en-gb' AS l, lower(n_name) AS low FROM nation", project=KEEP("k", "d", "l", "low")),
    "triple_functions": Query(("nation", "region"), '{ ?n fk:n_regionkey ?r ; c:n_nationkey ?k ; c:n_name ?name SET(?t := TRIPLE(?n, URI("urn:x:in"), ?r)) SET(?s := STR(SUBJECT(?t))) SET(?p := STR(PREDICATE(?t))) SET(?o := STR(OBJECT(?t))) SET(?v := STRDT(STR(?k), xsd:integer)) FILTER(ISTRIPLE(?t) && ISURI(OBJECT(?t)) && !ISBLANK(?n) && ?v = ?k) }',
        "SELECT 'urn:t:nation:' || n_nationkey AS s, 'urn:x:in' AS p, 'urn:t:region:' || n_regionkey AS o FROM nation", project=KEEP("s", "p", "o")),
    "minting_functions": Query(("nation",), '{ ?n c:n_name ?name SET(?u := UUID()) SET(?s := STRUUID()) SET(?b := BNODE()) SET(?now := NOW()) FILTER(ISBLANK(?b) && STRSTARTS(STR(?u), "urn:uuid:") && STRLEN(?s) = 36 && YEAR(?now) > 2000) }',
        "SELECT n_name AS name FROM nation", project=KEEP("name")),
    "time_functions": Query(("events",), '{ ?e c:event_id ?k ; c:ts ?t SET(?z := xsd:dateTime(CONCAT(STR(?t), "-05:30"))) SET(?sec := STR(SECONDS(?t))) SET(?off := STR(TIMEZONE(?z))) SET(?tz := TZ(?z)) SET(?none := TZ(?t)) SET(?h := HOURS(?z)) FILTER(?z > ?t) }',
        "SELECT event_id AS k, CASE WHEN date_part('microsecond', ts) % 1000000 = 0 THEN date_part('second', ts)::VARCHAR ELSE rtrim(date_part('second', ts)::VARCHAR || '.' || lpad((date_part('microsecond', ts) % 1000000)::VARCHAR, 6, '0'), '0') END AS sec, '-PT5H30M' AS off, '-05:30' AS tz, '' AS none, hour(ts)::BIGINT AS h FROM events", project=KEEP("k", "sec", "off", "tz", "none", "h")),
    "integer_division": Query(("nation",), "{ ?n c:n_nationkey ?k SET(?q := STR(?k / 4)) SET(?w := STR(DATATYPE(?k / 4))) }",
        f"SELECT n_nationkey::BIGINT AS k, (n_nationkey // 4)::VARCHAR || ['', '.25', '.5', '.75'][n_nationkey % 4 + 1] AS q, '{XSD}decimal' AS w FROM nation", project=KEEP("k", "q", "w")),
    "casts_integers": Query(("nation",), "{ ?n c:n_nationkey ?k " + " ".join(f"SET(?{t} := STR(xsd:{t}(STR(?k))))" for t in INTEGER_CASTS) + " }",
        "SELECT " + ", ".join(f"n_nationkey::VARCHAR AS {t}" for t in INTEGER_CASTS) + " FROM nation WHERE n_nationkey > 0", project=lambda df: df.select(*INTEGER_CASTS)),
    "casts_signed": Query(("nation",), "{ ?n c:n_nationkey ?k SET(?m := STR(xsd:negativeInteger(-?k))) SET(?p := STR(xsd:nonPositiveInteger(-?k))) }", "SELECT (-n_nationkey)::VARCHAR AS m, (-n_nationkey)::VARCHAR AS p FROM nation WHERE n_nationkey > 0", project=KEEP("m", "p")),
    "casts_decimals": Query(("customer",), "{ ?c c:c_custkey ?k ; c:c_acctbal ?b SET(?d := STR(xsd:decimal(?k))) SET(?f := STR(xsd:float(?k))) SET(?e := STR(xsd:double(CONCAT(STR(?k), \"e2\")))) SET(?x := STR(xsd:decimal(?b))) }",
        "SELECT c_custkey AS k, c_custkey::VARCHAR AS d, c_custkey::VARCHAR || '.0' AS f, c_custkey || 'e2' AS e, c_acctbal::VARCHAR AS x FROM customer", project=KEEP("k", "d", "f", "e", "x")),
    "casts_temporal": Query(("events",), '{ ?e c:event_id ?k ; c:ts ?t SET(?s := STR(?t)) SET(?a := STR(xsd:dateTime(?s))) SET(?d := STR(xsd:date(SUBSTR(?s, 1, 10)))) SET(?h := STR(xsd:time(SUBSTR(?s, 12)))) SET(?p := STR(xsd:duration(CONCAT("P", STR(DAY(?t)), "D")))) SET(?q := STR(xsd:dayTimeDuration(CONCAT("PT", STR(MINUTES(?t)), "M")))) FILTER(xsd:dateTime(?s) = ?t) }',
        "SELECT event_id AS k, strftime(ts, '%Y-%m-%d') AS d, 'P' || day(ts) || 'D' AS p, 'PT' || minute(ts) || 'M' AS q FROM events", project=KEEP("k", "d", "p", "q")),
    "double_forms": Query(("orders",), "{ ?o c:o_orderkey ?k ; c:o_totalprice ?p SET(?s := STR(?p * 1048576.0e0)) }", "SELECT o_orderkey AS k, (o_totalprice * 1048576)::VARCHAR AS s FROM orders", project=KEEP("k", "s")),
    # One value by a column and by the exact evaluator (arithmetic over terms of several datatypes): both have one key.
    "double_paths_join": Query(("orders",), "{ ?o :a ?x ; :b ?x ; c:o_orderkey ?k }", "SELECT o_orderkey AS k FROM orders",
        "RULE { ?o :raw ?p } WHERE { ?o c:o_totalprice ?p } RULE { ?o :raw ?s } WHERE { ?o c:o_orderstatus ?s } RULE { ?o :a ?x } WHERE { ?o c:o_totalprice ?p SET(?x := ?p * 1000.0e0) } RULE { ?o :b ?x } WHERE { ?o :raw ?p SET(?x := ?p * 1000.0e0) }", KEEP("k")),
    "mixed_filter": Query(("orders",), '{ ?o :raw ?v ; c:o_orderkey ?k FILTER(?v > 300000 || ?v = "P" || ?v < "1992-02-01T00:00:00"^^xsd:dateTime) }',
        "SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1992-02-01'",
        "RULE { ?o :raw ?p } WHERE { ?o c:o_totalprice ?p } RULE { ?o :raw ?s } WHERE { ?o c:o_orderstatus ?s } RULE { ?o :raw ?d } WHERE { ?o c:o_orderdate ?d }", KEEP("k")),
    "mixed_functions": Query(("part",), '{ ?p :label ?v ; c:p_partkey ?k SET(?u := STR(UCASE(?v))) SET(?n := STRLEN(?v)) SET(?l := LANG(?v)) FILTER(CONTAINS(?v, "e")) }',
        "SELECT p_partkey AS k, upper(p_name) AS u, length(p_name) AS n, 'en' AS l FROM part WHERE contains(p_name, 'e') UNION ALL SELECT p_partkey, upper(p_type), length(p_type), '' FROM part WHERE contains(p_type, 'e')",
        'RULE { ?p :label ?v } WHERE { ?p c:p_name ?x SET(?v := STRLANG(?x, "en")) } RULE { ?p :label ?x } WHERE { ?p c:p_type ?x }', KEEP("k", "u", "n", "l")),
    "column_function": Query(("nation",), "{ ?n c:n_nationkey ?k ; c:n_name ?x SET(?y := :shout(?x)) }", "SELECT n_nationkey::BIGINT AS k, upper(n_name) || '!' AS y FROM nation", project=KEEP("k", "y"), options=column_registry),
    **{f"parse_{format}": document(format) for format in DOCUMENTS},
    "ntriples_files": Query((), "{ ?n c:n_nationkey ?k ; c:n_name ?name FILTER(?k < 20) }", "SELECT n_nationkey::VARCHAR AS k, n_name AS name FROM nation WHERE n_nationkey < 20", project=KEEP("k", "name"), data=through_files),
    "infer_all": Query(("nation", "region"), "", "SELECT 'urn:t:nation:' || n_nationkey AS s, 'urn:x:in' AS p, 'urn:t:region:' || n_regionkey AS o FROM nation UNION ALL SELECT 'urn:t:region:' || r_regionkey, 'urn:x:label', r_name FROM region UNION ALL SELECT 'urn:x:a', 'urn:x:b', '1'",
        "DATA { :a :b 1 } RULE { ?n :in ?r . ?r :label ?x } WHERE { ?n fk:n_regionkey ?r . ?r c:r_name ?x }", how=inferred),
    "bridge_request": Query(("region",), "{ ?x :named ?name }", "SELECT 'urn:t:region:' || r_regionkey AS x, r_name AS name FROM region", "RULE { ?x :named ?n } WHERE { ?x c:r_name ?n }", how=bridged),
}
