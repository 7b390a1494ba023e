"""Rules as the parser lowers them."""
from __future__ import annotations

from dataclasses import dataclass, field

from stratalog.terms import BNode, IRI, Term, Triple, TripleTerm, Variable


@dataclass(frozen=True)
class Expression:
    """operator: a builtin's upper-case name, an operator sign, or a function's IRI."""

    operator: str
    arguments: tuple = ()


@dataclass(frozen=True)
class Pattern:
    subject: Term
    predicate: Term
    object: Term

    @property
    def terms(self) -> Triple:
        return self.subject, self.predicate, self.object


@dataclass(frozen=True)
class Filter:
    expression: Expression | Term


@dataclass(frozen=True)
class Assign:
    variable: Variable
    expression: Expression | Term


@dataclass(frozen=True)
class Negation:
    body: tuple
    data_only: bool = False


@dataclass(frozen=True)
class Rule:
    head: tuple[Triple, ...]
    body: tuple
    data_only: bool = False
    identifier: IRI | None = None
    source: str | None = None
    base_iri: str | None = None

    @property
    def run_once(self) -> bool:
        """Rules that mint nodes or assign run once in their stratum, before the others."""
        return any(isinstance(e, Assign) for e in self.body) or any(mints(t) for triple in self.head for t in triple)


@dataclass(frozen=True)
class RuleSet:
    rules: tuple[Rule, ...] = ()
    data: tuple[Triple, ...] = ()
    imports: tuple[str, ...] = ()
    source: str | None = None
    source_iris: tuple[str, ...] = ()


@dataclass(frozen=True)
class Stratum:
    once: tuple[int, ...]
    general: tuple[int, ...]


@dataclass(frozen=True)
class PreparedRuleSet:
    """Rules, the edges (consumer, producer, closed) between them, and their strata, by index."""

    rule_set: RuleSet
    edges: tuple[tuple[int, int, bool], ...] = ()
    strata: tuple[Stratum, ...] = field(default=())


def mints(t: Term) -> bool:
    if isinstance(t, TripleTerm):
        return mints(t.subject) or mints(t.predicate) or mints(t.object)
    return isinstance(t, BNode)


def as_pattern_term(t: Term) -> Term:
    """Blank nodes of a body are variables with reserved names, shared over the body."""
    if isinstance(t, BNode):
        return Variable("@blank:" + t.label)
    if isinstance(t, TripleTerm):
        return TripleTerm(as_pattern_term(t.subject), as_pattern_term(t.predicate), as_pattern_term(t.object))
    return t


def expression_variables(e: object) -> set[Variable]:
    if isinstance(e, Expression):
        return set().union(*map(expression_variables, e.arguments)) if e.arguments else set()
    if isinstance(e, Variable):
        return {e}
    if isinstance(e, TripleTerm):
        return expression_variables(e.subject) | expression_variables(e.predicate) | expression_variables(e.object)
    return set()
