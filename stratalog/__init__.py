"""Stratalog: rule inference and goal queries over RDF graphs and tables, planned as Spark DataFrames."""
import sys

from pyspark import cloudpickle

# Worker processes then need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from stratalog.api import QueryResult, infer, infer_frame, prepare_rules, query, validate_rules  # noqa: E402
from stratalog.functions.exact import FunctionRegistry  # noqa: E402
from stratalog.plans.model import PreparedRuleSet, Rule, RuleSet  # noqa: E402
from stratalog.plans.rules import parse_rules  # noqa: E402
from stratalog.sources.graph import Graph, merge_graphs, parse_data  # noqa: E402
from stratalog.sources.imports import ImportResolver, MappingImportResolver  # noqa: E402
from stratalog.sources.relations import Mapping, Source  # noqa: E402
from stratalog.terms import IRI, BNode, Literal, TripleTerm, Variable  # noqa: E402

__all__ = [
    "IRI", "BNode", "FunctionRegistry", "Graph", "ImportResolver", "Literal", "Mapping", "MappingImportResolver", "PreparedRuleSet", "QueryResult",
    "Rule", "RuleSet", "Source", "TripleTerm", "Variable", "infer", "infer_frame", "merge_graphs", "parse_data", "parse_rules", "prepare_rules", "query", "validate_rules",
]
