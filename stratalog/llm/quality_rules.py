"""Quality rules: a decision list learned by sequential covering, in DataFrame functions alone.

Statistics of each text are Spark expressions. From those of a bounded, hash-chosen sample of labelled
rows the list is learned: a rule grows by the threshold condition of the largest information gain until
it covers no good document, is pruned from its end while precision on rows held aside doesn't fall, and
is kept if precise enough; its rows go, and the next rule is sought. Rules become one ordered
conditional expression. No Python touches the rows on the executors.

Edge cases: null and empty texts have no words and fail the base rule; repeated rows are judged alike;
with labels of one kind only the list is empty and the base rule alone decides; an empty table gives an
empty result; extra columns are ignored.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import WS, documents, hash_sample, labels, words

#: Ratios that rules may test, by name, from the columns of `statistics`.
NAMES = (
    "n_words", "symbol_ratio", "upper_ratio", "mark_ratio", "dup_line_ratio", "repeat_ratio", "word_length",
)


def repeated_words(hashes_sorted: str) -> Column:
    """Positions covered by 3-word windows that occur more than once, given sorted (hash, position) pairs."""
    s = F.col(hashes_sorted)
    beside = F.arrays_zip(s.alias("own"), F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), s).alias("prev"), F.slice(s, 2, F.greatest(F.size(s), F.lit(1))).alias("next"))
    same = lambda z, k: F.coalesce(z["own"]["h"] == z[k]["h"], F.lit(False))
    hit = F.filter(F.slice(beside, 1, F.size(s)), lambda z: same(z, "prev") | same(z, "next"))
    return F.sort_array(F.transform(hit, lambda z: z["own"]["i"]))


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """keep..., then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and two more counts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    without = lambda pattern: F.length("__t") - F.length(F.regexp_replace("__t", pattern, ""))
    a = docs.select(*keep, text.alias("__t"), words(text).alias("__w"), F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{WS}]")).alias("__l"))
    n = F.size("__w")
    three = F.slice(F.arrays_zip(F.col("__w"), F.slice("__w", 2, F.greatest(n, F.lit(1))), F.slice("__w", 3, F.greatest(n, F.lit(1)))), 1, F.greatest(n - 2, F.lit(0)))
    windows = F.sort_array(F.transform(three, lambda z, i: F.struct(F.xxhash64(z["__w"], z["1"], z["2"]).alias("h"), i.alias("i"))))
    b = a.select(*keep, n.cast("long").alias("n_words"), (F.length("__t") - without(f"[{WS}]+")).cast("long").alias("word_chars"), without(r"[#*$%&|<>]+").cast("long").alias("n_symbols"), (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"), F.size("__l").alias("n_lines"), without("[A-Z]+").alias("n_upper"), without("[!?]+").alias("n_marks"), windows.alias("__s"))
    c = b.withColumn("__p", repeated_words("__s")).drop("__s")
    steps = F.arrays_zip(F.col("__p"), F.slice("__p", 2, F.greatest(F.size("__p"), F.lit(1))))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda t, z: t + F.least(F.lit(3), F.coalesce(z["1"] - z["__p"], F.lit(3))))
    return c.withColumn("n_repeat_words", covered).drop("__p")


def ratio(name: str) -> Column:
    chars, n = F.greatest(F.col("word_chars"), F.lit(1)), F.greatest(F.col("n_words"), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "symbol_ratio": F.col("n_symbols") / chars,
        "upper_ratio": F.col("n_upper") / chars,
        "mark_ratio": F.col("n_marks") / chars,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_ratio": F.col("n_repeat_words") / n,
        "word_length": F.col("word_chars") / n,
    }[name]


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, NAMES.index(self.name)]
        return v > self.threshold if self.above else v <= self.threshold

    def column(self) -> Column:
        return ratio(self.name) > self.threshold if self.above else ratio(self.name) <= self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:g}"


def covers(rule: list[Condition], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def grow(x: np.ndarray, bad: np.ndarray, most: int) -> list[Condition]:
    rule: list[Condition] = []
    on = np.ones(len(x), bool)
    while len(rule) < most and (on & ~bad).any() and (on & bad).any():
        p0, n0 = (on & bad).sum(), (on & ~bad).sum()
        best, gain = None, 1e-9
        for k, name in enumerate(NAMES):
            cuts = np.unique(np.quantile(x[on, k], np.linspace(0.01, 0.99, 50)))
            v = x[:, k]
            for c in cuts.tolist():
                for above in (True, False):
                    hit = on & (v > c if above else v <= c)
                    p = (hit & bad).sum()
                    if p:
                        g = p * (math.log2(p / hit.sum()) - math.log2(p0 / (p0 + n0)))
                        if g > gain:
                            # Halfway to the next value seen, so that a threshold keeps its distance from either side.
                            far = v[on & (v > c)]
                            best, gain = Condition(name, above, float(f"{(c + far.min()) / 2 if len(far) else c:.6g}")), g
        if best is None:
            break
        rule.append(best)
        on &= best.holds(x)
    return rule


def prune(rule: list[Condition], x: np.ndarray, bad: np.ndarray) -> list[Condition]:
    def worth(r: list[Condition]) -> float:
        on = covers(r, x)
        p, n = (on & bad).sum(), (on & ~bad).sum()
        return (p - n) / max(1, p + n)

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn_list(x: np.ndarray, bad: np.ndarray, most_rules: int = 12, most_conditions: int = 4, precision: float = 0.95, least: int = 5) -> list[list[Condition]]:
    """Ordered rules for bad rows, by sequential covering; two thirds of the rows grow, one third prunes."""
    rules: list[list[Condition]] = []
    aside = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), bool)
    while len(rules) < most_rules and (left & bad & ~aside).sum() >= least:
        rule = grow(x[left & ~aside], bad[left & ~aside], most_conditions)
        if not rule:
            break
        rule = prune(rule, x[left & aside], bad[left & aside])
        on = covers(rule, x) & left
        if (on & bad).sum() < least or (on & bad).sum() < precision * on.sum():
            break
        rules.append(rule)
        left &= ~on
    return rules


def learn(docs: DataFrame, lab: DataFrame, rows: int = 4000) -> list[list[Condition]]:
    """Learn from at most `rows` labelled rows; only their ratios reach the driver."""
    some = hash_sample(lab.select("doc_id", "quality").where(F.col("quality").isin(0, 1)).dropDuplicates(["doc_id"]), "doc_id", rows)
    train = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    got = statistics(train, "doc_id", "quality").select("doc_id", "quality", *[ratio(k).alias(k) for k in NAMES]).collect()
    got.sort(key=lambda r: r.doc_id)
    if len({r.quality for r in got}) < 2:
        return []
    return learn_list(np.array([[r[k] for k in NAMES] for r in got], float), np.array([r.quality == 0 for r in got]))


def verdict(rules: list[list[Condition]]) -> Column:
    """True where no rule rejects: an ordered conditional expression."""
    out = None
    for rule in rules:
        cond = rule[0].column()
        for c in rule[1:]:
            cond &= c.column()
        out = F.when(cond, False) if out is None else out.when(cond, False)
    return F.lit(True) if out is None else out.otherwise(True)


def judge(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    s = statistics(docs, "doc_id")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return s.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return judge(docs, learn(docs, labels(spark, sf_dir)))
