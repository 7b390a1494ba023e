"""infer, query, and the pieces they take."""
from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions.exact import Context, FunctionRegistry
from stratalog.operators.slots import key_of
from stratalog.plans import analysis
from stratalog.plans.bodies import Solutions
from stratalog.plans.fixpoint import Evaluator
from stratalog.plans.model import PreparedRuleSet, RuleSet
from stratalog.plans.rules import parse_goal, parse_rules
from stratalog.sources.adapters import as_triples
from stratalog.sources.graph import Graph, parse_data
from stratalog.sources.imports import ImportResolver
from stratalog.sources.relations import Source
from stratalog.terms import Term, Variable, term

Rules = str | RuleSet | PreparedRuleSet
#: Text, a graph, a table of keys, a source, or triples of another library's terms.
Data = None | str | Graph | DataFrame | Source | Iterable


def session(spark: SparkSession | None = None) -> SparkSession:
    return spark or SparkSession.getActiveSession() or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def validate_rules(rule_set: RuleSet) -> None:
    analysis.validate_rules(rule_set)


def prepare_rules(rule_set: Rules, rule_base_iri: str | None = None, import_resolver: ImportResolver | None = None) -> PreparedRuleSet:
    """Imports, well-formedness, dependencies, strata. The result can be used again and again."""
    if isinstance(rule_set, PreparedRuleSet):
        return rule_set
    if isinstance(rule_set, str):
        rule_set = parse_rules(rule_set, rule_base_iri)
    if rule_set.imports:
        rule_set = (import_resolver or ImportResolver()).resolve(rule_set)
    return analysis.prepare(rule_set)


def as_source(spark: SparkSession, data: Data, format: str = "turtle", base_iri: str | None = None) -> Source:
    if isinstance(data, Source):
        return data
    out = Source(spark)
    if isinstance(data, str):
        data = parse_data(data, format, base_iri)
    if isinstance(data, Graph):
        out.add_triples(data)
    elif isinstance(data, DataFrame):
        out.add_table(data)
    elif data is not None:
        out.add_triples(Graph(as_triples(data)))
    return out


@dataclass
class QueryResult:
    """Solutions of a goal. frame: one typed column for each public variable, sorted by name."""

    variables: list[Variable]
    solutions: Solutions
    _rows: list[dict[Variable, Term]] | None = field(default=None, repr=False)

    @property
    def frame(self) -> DataFrame:
        """Native values where a variable's datatype is known, IRIs and other terms as text (see text())."""
        return self.solutions.df.select(*[text(*self.slot(v)).alias(v.value) for v in self.variables])

    @property
    def keys(self) -> DataFrame:
        return self.solutions.df.select(*[key_of(*self.slot(v)).alias(v.value) for v in self.variables])

    def slot(self, v: Variable):
        s = self.solutions.env[v]
        return s.kind, s.column

    @property
    def bindings(self) -> list[dict[Variable, Term]]:
        """Collected on the driver: for results of a size that fits."""
        if self._rows is None:
            if self.variables:
                self._rows = [{v: term(r[v.value]) for v in self.variables} for r in self.keys.collect()]
            else:
                self._rows = [{} for _ in range(self.solutions.df.count())]
        return self._rows

    @property
    def boolean(self) -> bool:
        return bool(self._rows) if self._rows is not None else not self.solutions.df.isEmpty()

    def __bool__(self) -> bool:
        return self.boolean


def text(kind: str, c):
    """IRIs as themselves, literals by lexical form, blank nodes as _:label, triple terms by key."""
    if kind.startswith("ref:"):
        return F.concat(F.lit(kind[4:]), c.cast("string"))
    if kind != "key":
        return c
    first = F.substr(c, F.lit(1), F.lit(1))
    return F.when(first == "I", F.substr(c, F.lit(2))).when(first == "L", F.get(F.split(c, "\x01", 4), F.lit(3))).when(first == "B", F.concat(F.lit("_:"), F.substr(c, F.lit(2)))).otherwise(c)


def _context(registry: FunctionRegistry | None) -> Context:
    return Context(functions=dict(registry.functions), columns=dict(registry.columns)) if registry else Context()


def infer_frame(rule_set: Rules, data: Data = None, *, rule_base_iri: str | None = None, data_format: str = "turtle", data_base_iri: str | None = None, include_base: bool = False, function_registry: FunctionRegistry | None = None, import_resolver: ImportResolver | None = None, spark: SparkSession | None = None, max_rounds: int = 1000) -> DataFrame:
    """Derived triples as keys (s, p, o); nothing is collected."""
    spark = session(spark)
    base = as_source(spark, data, data_format, data_base_iri)
    run = Evaluator(spark, prepare_rules(rule_set, rule_base_iri, import_resolver), base, _context(function_registry), max_rounds)
    run.run()
    return run.everything().unionByName(base.everything()) if include_base else run.everything()


def infer(rule_set: Rules, data: Data = None, **options) -> Graph:
    """Derived triples (with include_base, all triples) as a graph on the driver."""
    return Graph(tuple(map(term, r)) for r in infer_frame(rule_set, data, **options).collect())


def query(rule_set: Rules, data: Data, goal: str | tuple, *, rule_base_iri: str | None = None, data_format: str = "turtle", data_base_iri: str | None = None, goal_base_iri: str | None = None, function_registry: FunctionRegistry | None = None, import_resolver: ImportResolver | None = None, spark: SparkSession | None = None, max_rounds: int = 1000) -> QueryResult:
    """Solutions of a goal over base and derived triples. Only rules that the goal can see run."""
    spark = session(spark)
    base = as_source(spark, data, data_format, data_base_iri)
    prepared = prepare_rules(rule_set, rule_base_iri, import_resolver)
    body, goal_base = parse_goal(goal, goal_base_iri) if isinstance(goal, str) else (tuple(goal), goal_base_iri)
    known = analysis.validate_body(body)
    used = analysis.relevant(prepared, body)
    run = Evaluator(spark, prepared, base, _context(function_registry), max_rounds, used, analysis.kept_ends(prepared, body, used))
    run.run()
    sols = run.goal(body, goal_base)
    return QueryResult(sorted((v for v in known if not v.value.startswith("@")), key=lambda v: v.value), sols)
