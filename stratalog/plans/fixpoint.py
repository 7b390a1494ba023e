"""Strata of rules to their fixpoint, with deltas: derived facts by predicate, in typed tables."""
from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.errors import FixpointError
from stratalog.functions.exact import Context
from stratalog.operators.materialize import materialize, stored
from stratalog.operators.slots import equals_constant, key_of
from stratalog.plans.analysis import feeds, relevant
from stratalog.plans.bodies import BodyPlanner, Solutions, View, packed
from stratalog.plans.model import Negation, Pattern, PreparedRuleSet, Rule
from stratalog.sources.graph import standardized
from stratalog.sources.relations import KEYS, Relation, Source
from stratalog.terms import BNode, IRI, Term, Triple, TripleTerm, Variable, key

#: Rounds after which a relation's increments are written as one table.
COMPACT = 8


@dataclass
class Facts:
    """Derived triples: typed (s, o) tables by predicate IRI, and (s, p, o) key tables under None."""

    tables: dict[str | None, list[Relation]] = field(default_factory=lambda: defaultdict(list))

    def of(self, p: IRI | None) -> list[Relation]:
        if p is not None:
            generic = [Relation(r.df.where(F.col("p") == key(p)).select("s", "o"), "key", "key") for r in self.tables.get(None, ())]
            return [*self.tables.get(p.value, ()), *generic]
        out = list(self.tables.get(None, ()))
        for name, rels in self.tables.items():
            if name is not None:
                out += [Relation(r.keyed().select("s", F.lit("I" + name).alias("p"), "o"), "key", "key") for r in rels]
        return out

    def add(self, p: str | None, r: Relation) -> None:
        self.tables[p].append(r)

    def compact(self, p: str | None) -> None:
        by_kind = defaultdict(list)
        for r in self.tables[p]:
            by_kind[r.s_kind, r.o_kind].append(r.df)
        self.tables[p] = [Relation(materialize(_union(dfs)) if len(dfs) >= COMPACT else _union(dfs), *kinds, stored=True) for kinds, dfs in by_kind.items()]

    def store(self, patterns: list[Pattern]) -> None:
        """Write what patterns read of facts that are still computed on demand: rounds read them again and again."""
        wanted = {p.predicate.value if isinstance(p.predicate, IRI) else None for p in patterns}
        for name in [n for n in self.tables if None in wanted or n is None or n in wanted]:
            self.tables[name] = [r if r.stored else replace(r, frame=materialize(r.df), stored=True) for r in self.tables[name]]


def _union(dfs: list[DataFrame]) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def head_relations(rule: Rule, number: int, sols: Solutions, salt: str) -> list[tuple[str | None, Relation]]:
    """Relations of the rule's head templates; templates and rows that give no RDF triple are left out."""
    cols = [key_of(s.kind, s.column) for _, s in sorted(sols.env.items(), key=lambda i: i[0].value)]

    def value(t: Term) -> tuple[str, Column]:
        if isinstance(t, Variable):
            return sols.env[t].kind, sols.env[t].column
        if isinstance(t, BNode):
            # The same node for one label over a solution, another for every other solution, rule and run.
            return "key", F.concat(F.lit("Bn"), F.substring(F.sha2(F.concat_ws("\x1f", F.lit(salt), F.lit(f"{number}:{t.label}"), *cols), 256), 1, 32))
        if isinstance(t, TripleTerm):
            return "key", packed(*[key_of(*value(x)) for x in (t.subject, t.predicate, t.object)])
        return "key", F.lit(key(t))

    def starts(t: Term, letters: str) -> list[Column] | None:
        """Conditions for t's key to begin with one of letters; None if it never does."""
        if isinstance(t, Variable):
            kind = sols.env[t].kind
            if kind != "key":
                return [] if kind.startswith("ref:") else None
            return [F.substr(sols.env[t].column, F.lit(1), F.lit(1)).isin(*letters)]
        return [] if key(t)[0] in letters else None if not isinstance(t, TripleTerm) else None

    def valid(s: Term, p: Term, o: Term) -> list[Column] | None:
        found: list[Column] = []
        for conds in (starts(s, "IB"), starts(p, "I"), valid(o.subject, o.predicate, o.object) if isinstance(o, TripleTerm) else []):
            if conds is None:
                return None
            found += conds
        return found

    out = []
    for s, p, o in rule.head:
        conds = valid(s, p, o) if not isinstance(s, TripleTerm) else None
        if conds is None:
            continue
        df = sols.df
        for c in conds:
            df = df.where(c)
        (sk, sc), (ok, oc) = value(s), value(o)
        if isinstance(p, IRI):
            out.append((p.value, Relation(df.select(sc.alias("s"), oc.alias("o")), sk, ok)))
        else:
            out.append((None, Relation(df.select(key_of(sk, sc).alias("s"), key_of(*value(p)).alias("p"), key_of(ok, oc).alias("o")), "key", "key")))
    return out


class Evaluator:
    def __init__(self, spark: SparkSession, prepared: PreparedRuleSet, base: Source, context: Context, max_rounds: int = 1000, only: set[int] | None = None, ends: dict[str, dict[str, Term]] | None = None):
        self.spark, self.prepared, self.base, self.context = spark, prepared, base, context
        self.max_rounds, self.only = max_rounds, only
        #: Ends of predicates that the goal fixes (see analysis.kept_ends): other triples of theirs aren't derived.
        self.ends = ends or {}
        self.facts = Facts()
        self.rounds = 0

    @property
    def rules(self) -> tuple[Rule, ...]:
        return self.prepared.rule_set.rules

    def full(self) -> View:
        return View(self.base, self.facts.of)

    def run(self) -> Facts:
        data = standardized(self.prepared.rule_set.data, "data")
        by_p: dict[str, list[Triple]] = defaultdict(list)
        for t in dict.fromkeys(data):
            by_p[t[1].value].append(t)
        for p, ts in by_p.items():
            df = self.spark.createDataFrame([(key(s), key(o)) for s, _, o in ts], "s string, o string")
            self.keep(self.new([(p, Relation(df, "key", "key"))]), lazy=True)
        for stratum in self.prepared.strata:
            self.stratum(stratum)
        return self.facts

    def planner(self, i: int) -> BodyPlanner:
        rule = self.rules[i]
        base = View(self.base)
        return BodyPlanner(self.spark, base if rule.data_only else self.full(), base, replace(self.context, base=rule.base_iri), f"r{i}")

    def derive(self, i: int, delta: tuple[int, View] | None = None) -> list[tuple[str | None, Relation]]:
        planner = self.planner(i)
        if delta is not None:
            planner.other[delta[0]] = delta[1]
        body = self.rules[i].body
        if delta is not None and not any(not isinstance(e, (Pattern, Negation)) for e in body):
            # The delta is the small side: it leads, and the rest is joined to it.
            at = delta[0]
            order = [at, *[k for k in range(len(body)) if k != at]]
            body = tuple(body[k] for k in order if isinstance(body[k], Pattern)) + tuple(e for e in body if isinstance(e, Negation))
            planner.other = {0: delta[1]}
        return head_relations(self.rules[i], i, planner.plan(body), self.context.salt)

    def new(self, found: list[tuple[str | None, Relation]]) -> dict[str | None, list[Relation]]:
        """Distinct triples that neither base nor facts hold, one table for each predicate and pair of kinds."""
        groups: dict[str | None, dict[tuple[str, str], list[DataFrame]]] = defaultdict(lambda: defaultdict(list))
        for p, r in found:
            for end, t in self.ends.get(p, {}).items():
                cond = equals_constant(r.s_kind if end == "s" else r.o_kind, F.col(end), t)
                r = replace(r, frame=r.df.where(F.lit(False) if cond is None else cond))
            groups[p][r.s_kind, r.o_kind].append(r.df)
        # A predicate with facts of unknown predicates beside it, or of several kinds, compares by key.
        any_p = None in groups or self.facts.tables.get(None)
        out: dict[str | None, list[Relation]] = defaultdict(list)
        if any_p:
            dfs = [r.df.select("s", "p", "o") for r in (Relation(_union(d), "key", "key") for d in groups.pop(None, {}).values())]
            for p, kinds in groups.items():
                dfs += [Relation(_union(d), *k).keyed().select("s", F.lit("I" + p).alias("p"), "o") for k, d in kinds.items()]
            had = [self.base.everything(), *[r.df.select("s", "p", "o") for r in self.facts.of(None)]]
            df = _union(dfs).distinct().join(_union(had), ["s", "p", "o"], "left_anti")
            out[None].append(Relation(df, "key", "key"))
            return out
        for p, kinds in groups.items():
            had = [*self.base.of(IRI(p)), *self.facts.of(IRI(p))]
            alike = {(r.s_kind, r.o_kind) for r in had} | set(kinds)
            if len(alike) == 1:
                (k,) = alike
                df = _union(kinds[k]).distinct()
                if had:
                    df = df.join(_union([r.df.select("s", "o") for r in had]), ["s", "o"], "left_anti")
                out[p].append(Relation(df, *k))
            else:
                df = _union([Relation(_union(d), *k).keyed() for k, d in kinds.items()]).distinct()
                if had:
                    df = df.join(_union([r.keyed() for r in had]), ["s", "o"], "left_anti")
                out[p].append(Relation(df, "key", "key"))
        return out

    def keep(self, new: dict[str | None, list[Relation]], lazy: bool) -> dict[str | None, list[Relation]]:
        """Add to the facts; written first unless lazy. Returns what isn't empty."""
        kept: dict[str | None, list[Relation]] = defaultdict(list)
        for p, rels in new.items():
            for r in rels:
                if not lazy:
                    frame, rows = stored(r.df)
                    if not rows:
                        continue
                    r = replace(r, frame=frame, stored=True)
                self.facts.add(p, r)
                kept[p].append(r)
            if len(self.facts.tables[p]) >= COMPACT and not lazy:
                self.facts.compact(p)
        return kept

    def stratum(self, stratum) -> None:
        wanted = lambda i: self.only is None or i in self.only
        once = [i for i in stratum.once if wanted(i)]
        general = [i for i in stratum.general if wanted(i)]
        if once:
            self.keep(self.new([x for i in once for x in self.derive(i)]), lazy=True)
        # Patterns that a general rule of this stratum feeds: they take deltas.
        inner = {i: [k for k, e in enumerate(self.rules[i].body) if isinstance(e, Pattern) and not self.rules[i].data_only and any(feeds(h, e) for j in general for h in self.rules[j].head)] for i in general}
        recursive = [i for i in general if inner[i]]
        if not general:
            return
        if not recursive:
            self.keep(self.new([x for i in general for x in self.derive(i)]), lazy=True)
            return
        self.facts.store([e for i in recursive for e in self.rules[i].body if isinstance(e, Pattern)])
        delta = self.keep(self.new([x for i in general for x in self.derive(i)]), lazy=False)
        for _ in range(self.max_rounds):
            self.rounds += 1
            if not delta:
                return
            part = Facts(defaultdict(list, delta))
            view = View(None, part.of)
            found = []
            for i in recursive:
                for k in inner[i]:
                    p = self.rules[i].body[k].predicate
                    if not isinstance(p, IRI) or p.value in delta or None in delta:
                        found += self.derive(i, (k, view))
            if not found:
                return
            delta = self.keep(self.new(found), lazy=False)
        raise FixpointError(f"still deriving after {self.max_rounds} rounds")

    def everything(self) -> DataFrame:
        """All derived triples as keys (s, p, o)."""
        parts = [r.df.select("s", "p", "o") for r in self.facts.of(None)]
        return _union(parts) if parts else self.spark.createDataFrame([], KEYS)

    def goal(self, body: tuple, base_iri: str | None) -> Solutions:
        return BodyPlanner(self.spark, self.full(), View(self.base), replace(self.context, base=base_iri), "g").plan(body)


__all__ = ["Evaluator", "Facts", "relevant"]
