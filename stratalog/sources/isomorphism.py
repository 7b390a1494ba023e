"""Whether two graphs are equal but for the names of blank nodes; for tests and small graphs."""
from __future__ import annotations

import hashlib

from stratalog.terms import BNode, Term, TripleTerm, key


def blanks(t: Term) -> set[BNode]:
    if isinstance(t, TripleTerm):
        return blanks(t.subject) | blanks(t.object)
    return {t} if isinstance(t, BNode) else set()


def colored(t: Term, colors: dict[BNode, str]) -> str:
    if isinstance(t, BNode):
        return "B" + colors[t]
    if isinstance(t, TripleTerm):
        return f"T({colored(t.subject, colors)} {key(t.predicate)} {colored(t.object, colors)})"
    return key(t)


def refine(triples: list, colors: dict[BNode, str]) -> dict[BNode, str]:
    for _ in range(len(colors) + 1):
        seen: dict[BNode, list[str]] = {b: [] for b in colors}
        for s, p, o in triples:
            line = f"{colored(s, colors)} {key(p)} {colored(o, colors)}"
            for b in blanks(s) | blanks(o):
                place = f"{b == s}{colored(o, {**colors, b: '*'}) if b in blanks(o) else ''}"
                seen[b].append(line + place)
        new = {b: hashlib.sha256("\n".join([colors[b], *sorted(xs)]).encode()).hexdigest() for b, xs in seen.items()}
        if len(set(new.values())) == len(set(colors.values())):
            return new
        colors = new
    return colors


def canonical(triples: list, colors: dict[BNode, str] | None = None) -> str:
    """The least text over all ways to tell alike nodes apart."""
    if colors is None:
        colors = {b: "" for t in triples for x in t for b in blanks(x)}
    colors = refine(triples, colors)
    groups: dict[str, list[BNode]] = {}
    for b, c in colors.items():
        groups.setdefault(c, []).append(b)
    alike = next((groups[c] for c in sorted(groups) if len(groups[c]) > 1), None)
    if alike is None:
        return "\n".join(sorted(f"{colored(s, colors)} {key(p)} {colored(o, colors)}" for s, p, o in triples))
    return min(canonical(triples, {**colors, b: colors[b] + "!"}) for b in alike)


def isomorphic(a, b) -> bool:
    return len(set(a)) == len(set(b)) and canonical(list(a)) == canonical(list(b))
