"""Bodies as DataFrames: patterns to scans and joins, NOT to anti-joins, FILTER and SET to columns."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.functions.compiler import Compiler, as_ebv
from stratalog.functions.exact import Context
from stratalog.functions.mixed import packed, unpacked
from stratalog.operators.materialize import materialize
from stratalog.operators.slots import Slot, equals_constant, key_of
from stratalog.plans.model import Assign, Expression, Filter, Negation, Pattern, as_pattern_term, expression_variables
from stratalog.sources.relations import Relation, Source
from stratalog.terms import IRI, Term, TripleTerm, Variable, variables

Facts = Callable[[IRI | None], list[Relation]]


ORDERED = ("integer", "double", "string", "boolean", "dateTime")


def parted(sols: Solutions, compiler: Compiler) -> Solutions:
    """sols, written first if a Python call would meet nested lambdas in its arguments: Spark can't lift it out of those."""
    if compiler.python and "transform(" in sols.df._jdf.queryExecution().analyzed().toString():
        return Solutions(materialize(sols.df), sols.env)
    return sols


@dataclass
class Solutions:
    """A bag of solutions: a DataFrame and the slot of each variable."""

    df: DataFrame
    env: dict[Variable, Slot]


class View:
    """The graph that a body sees: base and derived relations, or a delta alone."""

    def __init__(self, base: Source | None, derived: Facts | None = None):
        self.base, self.derived = base, derived

    def of(self, p: IRI | None) -> tuple[list[Relation], bool]:
        """Relations of a predicate (None: (s, p, o) tables of all), and whether they may share triples."""
        base = self.base.of(p) if self.base and p is not None else []
        derived = self.derived(p) if self.derived else []
        return base + derived, len({(r.table is None) for r in base}) > 1 or sum(r.table is None for r in base) > 1


_ids = [0]


def fresh(prefix: str) -> str:
    _ids[0] += 1
    return f"{prefix}{_ids[0]}"


class BodyPlanner:
    def __init__(self, spark: SparkSession, view: View, base: View, context: Context, site: str):
        self.spark, self.view, self.base, self.context, self.site = spark, view, base, context, site
        #: Patterns (by place in the body) that read another view: the deltas of semi-naive rounds.
        self.other: dict[int, View] = {}
        #: Conditions of the body at hand, which narrow scans before they meet derived relations.
        self.filters: list = []

    def one_row(self) -> Solutions:
        return Solutions(self.spark.range(1).select(), {})

    # scans

    def scan(self, pattern: Pattern, view: View) -> Solutions:
        s, p, o = (as_pattern_term(t) for t in pattern.terms)
        if isinstance(p, IRI):
            rels, overlap = view.of(p)
            return self.bound(self.united(rels, s, o, overlap), [("s", s), ("o", o)])
        df = self.spark.createDataFrame([], "s string, p string, o string")
        if view.base is not None:
            df = view.base.everything()
        for r in view.derived(None) if view.derived else []:
            df = df.unionByName(r.df.select("s", "p", "o"))
        return self.bound((df, {"s": Slot("key", "s"), "p": Slot("key", "p"), "o": Slot("key", "o")}), [("s", s), ("p", p), ("o", o)])

    def united(self, rels: list[Relation], s: Term, o: Term, overlap: bool) -> tuple[DataFrame, dict[str, Slot]]:
        """Relations in one DataFrame: typed if their kinds agree, else by key."""
        fit = []
        for r in rels:
            df = r.df
            ok = True
            for c, t, kind in (("s", s, r.s_kind), ("o", o, r.o_kind)):
                if not isinstance(t, (Variable, TripleTerm)) or (isinstance(t, TripleTerm) and not variables(t)):
                    cond = equals_constant(kind, F.col(c), t)
                    if cond is None:
                        ok = False
                        break
                    df = df.where(cond)
            if ok:
                fit.append(replace(r, frame=df))
        if not fit:
            return self.spark.createDataFrame([], "s string, o string"), {"s": Slot("key", "s"), "o": Slot("key", "o")}
        typed = len({(r.s_kind, r.o_kind) for r in fit}) == 1
        frames = [r.df.select("s", "o") if typed else r.keyed() for r in fit]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        if overlap and len(fit) > 1:
            out = out.distinct()
        kinds = (fit[0].s_kind, fit[0].o_kind) if typed else ("key", "key")
        return out, {c: Slot(k, c, 38 if isinstance(out.schema[c].dataType, T.DecimalType) else 19) for c, k in zip("so", kinds, strict=True)}

    def bound(self, scanned: tuple[DataFrame, dict[str, Slot]], terms: list[tuple[str, Term]]) -> Solutions:
        """Constants filtered, variables named, repeated ones compared, triple terms taken apart."""
        df, slots = scanned
        env: dict[Variable, Slot] = {}
        found: dict[Variable, Column] = {}
        conds: list[Column] = []
        todo = [(slots[c], t, F.col(c)) for c, t in terms]
        while todo:
            slot, t, c = todo.pop(0)
            if isinstance(t, Variable):
                if t in env:
                    had, hc = env[t], found[t]
                    conds.append(hc == c if had.kind == slot.kind else key_of(had.kind, hc) == key_of(slot.kind, c))
                else:
                    env[t] = replace(slot, name=fresh("v"))
                    found[t] = c
            elif isinstance(t, TripleTerm) and variables(t):
                k = key_of(slot.kind, c)
                conds.append(F.substr(k, F.lit(1), F.lit(1)) == "T")
                parts = unpacked(k)
                todo += [(Slot("key", ""), x, part) for x, part in zip((t.subject, t.predicate, t.object), parts, strict=True)]
            else:
                cond = equals_constant(slot.kind, c, t)
                conds.append(F.lit(False) if cond is None else cond)
        for c in conds:
            df = df.where(c)
        return Solutions(df.select(*[found[v].alias(s.name) for v, s in env.items()]), env)

    def fused(self, group: list[Pattern], view: View) -> Solutions | None:
        """Patterns of one subject variable over one mapped table: a single scan. Rows of a table without unique keys
        are equal where their keys are, so they count once."""
        rels = []
        for p in group:
            found, _ = view.of(p.predicate) if isinstance(p.predicate, IRI) else ([], False)
            if len(found) != 1 or found[0].table is None:
                return None
            rels.append(found[0])
        if len({r.table for r in rels}) != 1:
            return None
        subject = as_pattern_term(group[0].subject)
        df = rels[0].rows.where(rels[0].subject.isNotNull())
        for r in rels:
            df = df.where(r.object.isNotNull())
        cols = [rels[0].subject.alias("s"), *[r.object.alias(f"o{k}") for k, r in enumerate(rels)]]
        slots = {"s": Slot(rels[0].s_kind, "s"), **{f"o{k}": Slot(r.o_kind, f"o{k}") for k, r in enumerate(rels)}}
        scanned = df.select(*cols)
        if not rels[0].unique:
            scanned = scanned.distinct()
        return self.bound((scanned, slots), [("s", subject), *[(f"o{k}", as_pattern_term(p.object)) for k, p in enumerate(group)]])

    # joins

    def joined(self, a: Solutions, b: Solutions, how: str = "inner", extra: Column | None = None) -> Solutions:
        shared = [v for v in a.env if v in b.env]
        conds = []
        for v in shared:
            x, y = a.env[v], b.env[v]
            conds.append(x.column == y.column if x.kind == y.kind else key_of(x.kind, x.column) == key_of(y.kind, y.column))
        if extra is not None:
            conds.append(extra)
        if not conds:
            if how == "left_anti":
                return Solutions(a.df.join(b.df.limit(1).select(F.lit(1).alias(fresh("x"))), F.lit(True), how), a.env)
            return Solutions(a.df.crossJoin(b.df), {**a.env, **b.env})
        cond = conds[0]
        for c in conds[1:]:
            cond = cond & c
        out = a.df.join(b.df, cond, how)
        if how == "left_anti":
            return Solutions(out, a.env)
        for v in shared:
            out = out.drop(b.env[v].name)
        return Solutions(out, {**b.env, **a.env})

    def match(self, sols: Solutions | None, patterns: list[tuple[int, Pattern]], view: View) -> Solutions | None:
        """Patterns joined in: written order, except that one sharing variables goes before one that doesn't."""
        scans: list[tuple[Solutions, set[Variable]]] = []
        groups: list[list[Pattern]] = []
        rest = list(patterns)
        while rest:
            i, first = rest.pop(0)
            v = self.other.get(i, view)
            group = [first]
            if isinstance(as_pattern_term(first.subject), Variable) and i not in self.other:
                group += [p for j, p in rest if p.subject == first.subject and j not in self.other]
            one = self.fused(group, v) if len(group) > 1 else None
            if one is None:
                one = self.scan(first, v)
            else:
                rest = [(j, p) for j, p in rest if p not in group[1:] or j in self.other]
            scans.append((one, set(one.env)))
            groups.append(group)
        self.narrow(scans, groups, view)
        while scans:
            if sols is None or not sols.env:
                k = 0
            else:
                k = next((k for k, (_, vs) in enumerate(scans) if vs & set(sols.env)), 0)
            one, _ = scans.pop(k)
            sols = one if sols is None else self.joined(sols, one)
        return sols

    def narrow(self, scans: list[tuple[Solutions, set[Variable]]], groups: list[list[Pattern]], view: View) -> None:
        """Semi-join what rules derive on demand with the base scans that a constant or condition makes small.

        The optimizer moves a semi-join below the distinct and the joins of the rules, so that they derive less;
        the joins that follow find the same solutions.
        """
        derived = lambda p: not isinstance(p.predicate, IRI) or bool(view.derived and view.derived(p.predicate))
        on_demand = lambda p: isinstance(p.predicate, IRI) and view.derived and any(not r.stored for r in view.derived(p.predicate))
        small: list[Solutions] = []
        for (one, vs), group in zip(scans, groups, strict=True):
            if any(derived(p) for p in group):
                continue
            conds = [c for f in self.filters if expression_variables(f) and expression_variables(f) <= vs for c in [as_ebv(Compiler(one.env, self.context).native(f))] if c is not None]
            if conds or any(not isinstance(as_pattern_term(t), Variable) for p in group for t in (p.subject, p.object)):
                df = one.df
                for c in conds:
                    df = df.where(c)
                small.append(Solutions(df, one.env))
        for k, ((one, vs), group) in enumerate(zip(scans, groups, strict=True)):
            if not any(on_demand(p) for p in group):
                continue
            df = one.df
            for s in small:
                shared = [v for v in one.env if v in s.env and one.env[v].kind == s.env[v].kind]
                if shared:
                    keys = s.df.select(*[s.env[v].column.alias(fresh("k")) for v in shared])
                    cond = [one.env[v].column == F.col(c) for v, c in zip(shared, keys.columns, strict=True)]
                    df = df.join(keys, cond, "left_semi")
            scans[k] = (Solutions(df, one.env), vs)

    # bodies

    def plan(self, body: tuple, view: View | None = None, sols: Solutions | None = None) -> Solutions:
        view = view or self.view
        self.filters = [e.expression for e in body if isinstance(e, Filter)]
        run: list[tuple[int, Pattern]] = []

        def settle() -> None:
            nonlocal sols, run
            if run:
                sols = self.match(sols, run, view)
                run = []

        for i, e in enumerate(body):
            if isinstance(e, Pattern):
                run.append((i, e))
                continue
            settle()
            if sols is None:
                sols = self.one_row()
            if isinstance(e, Filter):
                compiler = Compiler(sols.env, self.context)
                conds = compiler.condition(e.expression, f"{self.site}f{i}")
                sols = parted(sols, compiler)
                for c in conds:
                    sols = Solutions(sols.df.where(c), sols.env)
            elif isinstance(e, Assign):
                compiler = Compiler(sols.env, self.context)
                kind, c = compiler.value(e.expression, f"{self.site}s{i}")
                sols = parted(sols, compiler)
                name = fresh("v")
                df = sols.df.withColumn(name, c)
                sols = Solutions(df.where(F.col(name).isNotNull()), {**sols.env, e.variable: Slot(kind, name, 38)})
            elif isinstance(e, Negation):
                sols = self.without(sols, e, self.base if e.data_only else view, f"{self.site}n{i}")
        settle()
        return sols if sols is not None else self.one_row()

    def without(self, sols: Solutions, e: Negation, view: View, site: str) -> Solutions:
        patterns = [(k, p) for k, p in enumerate(e.body) if isinstance(p, Pattern)]
        inner_planner = BodyPlanner(self.spark, view, self.base, self.context, site)
        inner = inner_planner.match(None, patterns, view) or self.one_row()
        own, mixed = [], []
        for k, f in enumerate(e.body):
            if isinstance(f, Filter):
                (own if expression_variables(f.expression) <= set(inner.env) else mixed).append((k, f))
        for k, f in own:
            compiler = Compiler(inner.env, self.context)
            conds = compiler.condition(f.expression, f"{site}f{k}")
            inner = parted(inner, compiler)
            for c in conds:
                inner = Solutions(inner.df.where(c), inner.env)
        if not mixed:
            return self.joined(sols, inner, "left_anti")
        bounded = self.bounded(sols, inner, [f.expression for _, f in mixed])
        if bounded is not None:
            return bounded
        env = {**inner.env, **sols.env}
        natives = [Compiler(env, self.context).native(f.expression) for _, f in mixed]
        cols = [as_ebv(x) if x is not None and x[1] is not None else None for x in natives]
        if all(c is not None for c in cols):
            extra = cols[0]
            for c in cols[1:]:
                extra = extra & c
            return self.joined(sols, inner, "left_anti", extra)
        # Python can't run inside a join condition: number the solutions, find those to drop, drop them.
        mark = fresh("id")
        outer = Solutions(materialize(sols.df.withColumn(mark, F.monotonically_increasing_id())), sols.env)
        hit = self.joined(outer, inner)
        for k, f in mixed:
            compiler = Compiler(hit.env, self.context)
            conds = compiler.condition(f.expression, f"{site}f{k}")
            hit = parted(hit, compiler)
            for c in conds:
                hit = Solutions(hit.df.where(c), hit.env)
        drop = hit.df.select(mark).distinct()
        return Solutions(outer.df.join(drop, mark, "left_anti").drop(mark), sols.env)

    def bounded(self, sols: Solutions, inner: Solutions, conditions: list) -> Solutions | None:
        """NOT with one comparison of an inner with an outer value: the largest or smallest inner value of a key decides.

        A key then costs its rows, not the pairs of them. None where the condition is of another form.
        """
        shared = [v for v in sols.env if v in inner.env]
        if len(conditions) != 1 or not shared or not isinstance(conditions[0], Expression) or conditions[0].operator not in ("<", ">", "<=", ">="):
            return None
        if any(sols.env[v].kind != inner.env[v].kind for v in shared):
            return None
        op, sides = conditions[0].operator, conditions[0].arguments
        within = [k for k, a in enumerate(sides) if expression_variables(a) and expression_variables(a) <= set(inner.env) - set(shared)]
        if len(within) != 1 or not expression_variables(sides[1 - within[0]]) <= set(sols.env):
            return None
        at = within[0]
        mine, theirs = Compiler(inner.env, self.context).native(sides[at]), Compiler(sols.env, self.context).native(sides[1 - at])
        if mine is None or theirs is None or mine[0] not in ORDERED or theirs[0] not in ORDERED:
            return None
        value = F.when(~F.isnan(mine[1]), mine[1]) if mine[0] == "double" else mine[1]
        extreme = F.max if (op[0] == ">") == (at == 0) else F.min
        name = fresh("m")
        keys = [inner.env[v].name for v in shared]
        per_key = inner.df.select(*[F.col(k) for k in keys], value.alias(name)).where(F.col(name).isNotNull()).groupBy(*keys).agg(extreme(name).alias(name))
        bound = (mine[0], F.col(name))
        hit = Compiler(sols.env, self.context).order(op, *((bound, theirs) if at == 0 else (theirs, bound)))[1]
        return self.joined(sols, Solutions(per_key, {v: inner.env[v] for v in shared}), "left_anti", F.coalesce(hit, F.lit(False)))


__all__ = ["BodyPlanner", "Solutions", "View", "packed"]
