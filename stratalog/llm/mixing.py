"""Mixing sources to target weights by Poisson replication, in DataFrame functions alone.

A source's target share of the output divided by its share of the input is the mean repetition rate
of its documents. Each document's count is the inverse of the Poisson distribution with that mean at
a uniform number hashed from (seed, doc_id): the smallest c with F(c) >= u. The document is exploded
by its count, and the hash of (seed, doc_id, copy) shuffles the result globally: it deals the copies to
partitions and orders each of them. That is one exchange, which needs no sample of the keys beforehand.

Rows of a hot source are counted with partial sums, and only the small table of sources is broadcast
if the planner finds it small; sizes of sources never decide which task works on a document.

Edge cases: a null source is a source of its own; null and empty texts weigh like others; repeated
rows draw alike, being the same document; sources without a weight in a given table are left out; an
empty table gives an empty result; extra columns are kept.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import documents

SEED = "mix-1"
#: Shares follow the power of the source's size: 1 keeps them, 0 makes all sources equal.
POWER = 0.5
#: Counts that the distribution is tabulated to, as mean + 12 roots of it + this.
SLACK = 30
#: Rates above this are summed from 12 roots below the mean on: exp(-rate) is no double there.
LARGE = 700


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5 over the parts."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(4503599627370496.0)


def poisson_count(rate: Column, u: Column) -> Column:
    """Smallest c with P(X <= c) >= u. Terms follow one another: p(c) = p(c - 1) rate / c.

    For large rates the first term is the one 12 roots below the mean, in Stirling's form; what lies before it is below 1e-30.
    """
    large = rate > LARGE
    low = F.floor(rate - 12 * F.sqrt(rate) - SLACK).cast("double")
    # log p(low) = low - rate - low log(low / rate) - log(2 pi low) / 2 - 1 / (12 low) + 1 / (360 low^3) - ...
    log_p = (low - rate) - low * F.log1p((low - rate) / rate) - F.log(2 * math.pi * low) / 2 - 1 / (12 * low) + 1 / (360 * low * low * low)
    p0 = F.when(large, F.exp(log_p)).otherwise(F.exp(-rate))
    first = F.when(large, low.cast("int")).otherwise(0)
    steps = F.sequence(first + 1, F.ceil(rate + 12 * F.sqrt(rate) + SLACK).cast("int"))
    start = F.struct(p0.alias("p"), p0.alias("cdf"), F.when(p0 >= u, first).otherwise(first + 1).alias("c"))
    def step(a: Column, i: Column) -> Column:
        p = a["p"] * rate / i
        cdf = a["cdf"] + p
        return F.struct(p.alias("p"), cdf.alias("cdf"), F.when(cdf >= u, a["c"]).otherwise(a["c"] + 1).alias("c"))
    return F.aggregate(steps, start, step, lambda a: a["c"])


def rates(docs: DataFrame, source: str = "source", power: float = POWER, weights: DataFrame | None = None) -> DataFrame:
    """source_key, rate. weights: optional table (source, weight); without it weights follow sizes to `power`."""
    sizes = docs.groupBy(F.col(source).alias("source_key")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        sizes = sizes.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(power)))
    else:
        sizes = sizes.join(weights.select(F.col("source").alias("s"), F.col("weight").cast("double").alias("w")), F.col("source_key").eqNullSafe(F.col("s")), "inner").drop("s")
    total = sizes.agg(F.sum("n").alias("n"), F.sum("w").alias("w")).collect()[0]
    return sizes.select("source_key", (F.col("w") / F.lit(total.w or 1.0) * F.lit(total.n or 0) / F.col("n")).alias("rate"))


def mix(docs: DataFrame, source: str = "source", key: str = "doc_id", power: float = POWER, weights: DataFrame | None = None, seed: str = SEED, keep_copy: bool = False) -> DataFrame:
    """docs with each row repeated by its count, in hashed order; copy (from 1) if keep_copy."""
    table = rates(docs, source, power, weights)
    # A third of all rows may share a source: the join must not deal documents by it.
    with_rate = docs.alias("d").join((F.broadcast(table) if _few(table) else table).alias("r"), F.col(f"d.{source}").eqNullSafe(F.col("r.source_key")), "inner")
    ident = F.col(f"d.{key}").cast("string")
    n = poisson_count(F.col("r.rate"), uniform(F.lit(seed), ident))
    copies = with_rate.select("d.*", n.alias("__n")).where("__n > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("__copy"))
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"), F.col("__copy")).cast("binary"))
    out = copies.withColumn("__order", order).repartition("__order").sortWithinPartitions("__order", F.col(key))
    return out.select(*docs.columns, *([F.col("__copy").alias("copy")] if keep_copy else []))


#: Sources up to which their table of rates is broadcast; beyond it the planner deals the join and splits hot sources.
MOST_SOURCES = 100_000


def _few(table: DataFrame) -> bool:
    return table.limit(MOST_SOURCES + 1).count() <= MOST_SOURCES


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir), keep_copy=True)


#: The distribution from its logarithms, term by term, not by the recurrence above.
ORACLE = f"""
WITH s AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, {POWER}) AS w FROM documents GROUP BY source),
t AS (SELECT sum(n) AS all_n, sum(w) AS all_w FROM s),
r AS (SELECT source, w / all_w * all_n / n AS rate FROM s, t),
k AS (SELECT source, rate, unnest(range(greatest(0, floor(rate - 14 * sqrt(rate) - 40))::BIGINT, ceil(rate + 14 * sqrt(rate) + 40)::BIGINT)) AS c FROM r),
p AS (SELECT source, c, sum(exp(c * ln(rate) - rate - lgamma(c + 1))) OVER (PARTITION BY source ORDER BY c) AS cdf, min(c) OVER (PARTITION BY source) AS low FROM k),
u AS (SELECT *, (('0x' || substr(md5('{SEED}|' || doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
f AS (SELECT source, list(cdf ORDER BY c) AS cdfs, any_value(low) AS low FROM p GROUP BY source),
n AS (SELECT u.*, f.low + len(list_filter(f.cdfs, lambda x: x < u.u)) AS copies FROM u JOIN f ON u.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, copies + 1))::INT AS copy FROM n WHERE copies > 0
"""
