"""Toxicity: a weighted lexicon, matched by Aho-Corasick on folded text.

Folding undoes common disguises: compatibility forms and accents, Cyrillic and Greek look-alikes,
digits inside words (1d10t), and signs between letters (st@pid). The lexicon is learned: whole words
and word beginnings of folded training texts whose document counts differ most between labels,
each with its log odds as weight. Matching is anchored at word starts. A match inside an exception
phrase does not count. Evidence is the weight per square root of length, and a logistic curve of it
and of the plain weight, fitted on the same rows, gives the score.

Edge cases: null and empty texts have no matches and score by the intercept alone (they get the
lowest score); without labelled rows of both kinds the score is 0 everywhere; repeated rows are
scored alike; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""
from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import documents, hash_sample, labels

# Look-alike letters (Cyrillic, then Greek) and the Latin letters they imitate.
LOOKALIKE_FROM = "аеорсухіјѕԁһкмтвнɡαερουιντκ"
LOOKALIKE_TO = "aeopcyxijsdhkmtbhgaepouivtk"
# Digits and signs used for letters.
DIGIT_FROM, DIGIT_TO = "013457", "oieast"
SIGN_FROM, SIGN_TO = "@$!|", "asil"
#: Phrases in which a lexicon word is harmless; matches inside them do not count.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "pond scum", "sore loser")
PREFIXES = range(4, 9)

_LOOK = str.maketrans(LOOKALIKE_FROM, LOOKALIKE_TO)
_DIGIT = str.maketrans(DIGIT_FROM, DIGIT_TO)
_SIGNS = re.compile(r"(?<=[^\W\d_])[@$!|]+(?=[^\W\d_])")
_MIXED = re.compile(r"[^\W\d_]+[0-9]+\w*|[0-9]+[^\W\d_]+\w*")
_WORD = re.compile(r"\w+")


def fold(text: str) -> str:
    """Lower-case text with disguises undone, its words parted by single blanks, blank at both ends."""
    t = text.lower()
    if not t.isascii():
        t = unicodedata.normalize("NFKD", t).translate(_LOOK)
        t = "".join([c for c in t if not unicodedata.combining(c)]) if not t.isascii() else t
    if any(c in t for c in SIGN_FROM):
        t = _SIGNS.sub(lambda m: m.group().translate(str.maketrans(SIGN_FROM, SIGN_TO)), t)
    if _HAS_DIGIT.search(t):
        t = _MIXED.sub(lambda m: m.group().translate(_DIGIT), t)
    return " " + " ".join(_WORD.findall(t)) + " "


_HAS_DIGIT = re.compile(r"[0-9]")


@dataclass
class Lexicon:
    """weight: anchored pattern (' word ' or ' beginn') -> log odds; curve: bias and two slopes."""

    weight: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] | None = None

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for p, w in self.weight.items():
            a.add_word(p, (len(p), w))
        for p in self.exceptions:
            a.add_word(f" {p} ", (len(p) + 2, None))
        a.make_automaton()
        return a

    def total(self, folded: str, automaton) -> float:
        """Weights of the matched words; a word counts once, by its heaviest pattern."""
        best: dict[int, float] = {}
        spare: list[tuple[int, int]] = []
        for end, (n, w) in automaton.iter(folded):
            at = end - n + 1
            if w is None:
                spare.append((at, end))
            elif w > best.get(at, -math.inf):
                best[at] = w
        if spare:
            best = {k: w for k, w in best.items() if not any(a <= k < b for a, b in spare)}
        return sum(best.values())

    def evidence(self, text: str, automaton) -> tuple[float, float]:
        f = fold(text)
        w = self.total(f, automaton)
        return w / math.sqrt(f.count(" ")), w

    def score(self, x: tuple[float, float]) -> float:
        if self.curve is None:
            return 0.0
        b, u, v = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, b + u * math.log1p(max(0.0, x[0])) + v * math.log1p(max(0.0, x[1]))))))


def terms(text: str) -> set[str]:
    out = set()
    for w in set(fold(text).split()):
        if len(w) >= 3 and not w.isdigit():
            out.add(f" {w} ")
            out.update(" " + w[:k] for k in PREFIXES if len(w) > k)
    return out


def training_rows(docs: DataFrame, lab: DataFrame, rows: int) -> DataFrame:
    """At most `rows` labelled documents outside the held-out quarter: (doc_id, text, toxic)."""
    ok = lab.select("doc_id", "toxic").where(F.col("toxic").isin(0, 1) & (held_out("doc_id") == F.lit(False))).dropDuplicates(["doc_id"])
    some = hash_sample(ok, "doc_id", rows)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")


def held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, lab: DataFrame, rows: int = 12000, size: int = 2000, least: int = 5) -> Lexicon:
    """Fit on a sample of at most `rows` labelled rows; at most `size` lexicon entries."""
    import pyarrow as pa

    train = training_rows(docs, lab, rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Counts of a task are merged before the shuffle.
        n: dict[str, list[int]] = {}
        for batch in batches:
            for t, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                for w in terms(t):
                    n.setdefault(w, [0, 0])[y] += 1
                n.setdefault("", [0, 0])[y] += 1
        yield pa.RecordBatch.from_pydict({"term": pa.array(list(n), pa.string()), "clean": pa.array([v[0] for v in n.values()], pa.int64()), "toxic": pa.array([v[1] for v in n.values()], pa.int64())})

    counts = train.select("text", "toxic").mapInArrow(count, "term string, clean bigint, toxic bigint").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    whole = counts.where("term = ''").collect()
    if not whole or not whole[0]["clean"] or not whole[0]["toxic"]:
        return Lexicon()
    nc, nt = whole[0]["clean"], whole[0]["toxic"]
    c, t = F.col("clean"), F.col("toxic")
    odds = F.log((t + 0.5) / (nt - t + 0.5)) - F.log((c + 0.5) / (nc - c + 0.5))
    z = odds / F.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
    best = counts.where((F.col("term") != "") & (t >= least)).select("term", "clean", "toxic", odds.alias("w"), z.alias("z")).where("w > 2.5 and z > 3").orderBy(F.desc("z"), "term").limit(size).collect()
    lex = Lexicon({r.term: round(r.w, 6) for r in best})
    if not best:
        return lex

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lex.automaton()
        for batch in batches:
            x = [lex.evidence(s, a) for s in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"a": pa.array([v[0] for v in x], pa.float64()), "b": pa.array([v[1] for v in x], pa.float64()), "y": batch.column("toxic").cast(pa.int32())})

    rows_ = train.select("text", "toxic").mapInArrow(measure, "a double, b double, y int").collect()
    lex.curve = logistic(np.array([[1, math.log1p(r.a), math.log1p(r.b)] for r in rows_]), np.array([r.y for r in rows_], float))
    return lex


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> tuple[float, ...]:
    """Newton steps; slopes kept from below zero, so more evidence never lowers a score."""
    w = np.zeros(x.shape[1])
    pen = np.diag([1e-6] + [ridge * len(y)] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + pen
        step = np.linalg.solve(h, x.T @ (y - p) - pen @ w)
        w = w + np.clip(step, -2, 2)
        w[1:] = np.maximum(w[1:], 0)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(round(float(v), 8) for v in w)


def score_toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score, n_words-normalised evidence and plain weight per document."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lexicon.automaton()
        for batch in batches:
            x = [lexicon.evidence(s or "", a) for s in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([lexicon.score(v) for v in x], pa.float64()), pa.array([v[0] for v in x], pa.float64()), pa.array([v[1] for v in x], pa.float64())], ["doc_id", "score", "density", "weight"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double, density double, weight double")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score_toxicity(docs, learn(docs, labels(spark, sf_dir)))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
