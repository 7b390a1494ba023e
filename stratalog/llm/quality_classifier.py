"""Quality by hierarchical empirical Bayes.

A logistic model over cheap document statistics gives each document's own evidence. Probabilities
are summed per host and per path of a host by grouped aggregation. Two Beta priors are fitted by moments: one
to the spread of host means about the whole, one to the spread of path means about their hosts, each beyond
the noise that samples of that size have anyway. A host's posterior is the global mean, weighted by the first
prior's strength, plus its documents; a path's is its host's mean, weighted by the second's, plus its own. A sparse
site thus falls back on its host, a sparse host on the whole. A document's log odds are shifted by how far its
path lies from the average, and documents below a threshold go.

Host and path are any columns; `site_columns` takes them from a URL. The classifier is fitted on a bounded,
hash-chosen sample of labelled rows; sums are over all rows.

Edge cases: null text counts as empty; documents without words have the evidence of zero statistics;
null hosts and paths are sites of their own; without labels of both kinds the evidence is 0.5 and all
documents stay; repeated rows count as often as they occur; empty tables give empty results; extra
columns are kept, except that the operator's own replace those of the same name.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import beside, byte_slices, documents, hash_sample, labels, materialize, tidy

NAMES = ("length", "upper", "digit", "symbol", "mark", "space", "word_length", "distinct", "repeat", "line_repeat", "bar")


def statistics(text: str) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = raw.split(), raw.split(b"\n")
    k = max(1, len(words))
    pairs = len(set(zip(words, words[1:], strict=False))) if len(words) > 1 else k
    return [
        np.log1p(n), h[65:91].sum() / n, h[48:58].sum() / n, h[[35, 36, 37, 38, 42, 60, 62, 64, 94, 95, 126]].sum() / n,
        h[[33, 63]].sum() / n, h[[9, 10, 13, 32]].sum() / n, min(30, n / k), len(set(words)) / k, 1 - pairs / k,
        1 - len(set(lines)) / max(1, len(lines)), h[124] / n,
    ]


def expand(x: np.ndarray) -> np.ndarray:
    """Bias, statistics, and their roots, which bend where ratios are small."""
    return np.column_stack([np.ones(len(x)), x, np.sqrt(np.maximum(x[:, 1:], 0))])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = expand(x)
        z[:, 1:] = (z[:, 1:] - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(z @ self.weight, -30, 30)))


def fit_rows(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> Model:
    z = expand(x)
    mean, scale = z[:, 1:].mean(0), z[:, 1:].std(0) + 1e-9
    z[:, 1:] = (z[:, 1:] - mean) / scale
    w, pen = np.zeros(z.shape[1]), np.eye(z.shape[1]) * ridge * len(y)
    pen[0, 0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + pen, z.T @ (y - p) - pen @ w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-7:
            break
    return Model(mean, scale, w)


def fit(docs: DataFrame, lab: DataFrame, rows: int = 6000) -> Model | None:
    """Fit on at most `rows` labelled rows; only their statistics reach the driver."""
    import pyarrow as pa

    some = hash_sample(lab.select("doc_id", "quality").where(F.col("quality").isin(0, 1)).dropDuplicates(["doc_id"]), "doc_id", rows)
    train = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "quality")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"x": pa.array([statistics(t or "") for t in b.column("text").to_pylist()], pa.list_(pa.float64())), "y": b.column("quality").cast(pa.int32())})

    got = train.mapInArrow(tidy(measure), "x array<double>, y int").collect()
    y = np.array([r.y for r in got], float)
    if len(set(y.tolist())) < 2:
        return None
    return fit_rows(np.array([r.x for r in got]), y)


def site_columns(url: Column) -> tuple[Column, Column]:
    """Host and first path segment of a URL, lower-cased; null where it has no host."""
    host = F.nullif(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))
    return host, F.when(host.isNotNull(), F.regexp_extract(url, r"^[^:]+://[^/?#]*(/[^/?#]*)", 1))


def evidence(docs: DataFrame, model: Model | None, host: Column, path: Column) -> DataFrame:
    """docs with __p, the document's own probability, and __host, __path."""
    import pyarrow as pa
    from pyspark.sql import types as T

    base = docs.select("*", host.alias("__host"), path.alias("__path"))
    if model is None:
        return base.withColumn("__p", F.lit(0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in byte_slices(batch):
                p = model.probability(np.array([statistics(t or "") for t in b.column("text").to_pylist()]))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], [*b.schema.names, "__p"])

    return base.mapInArrow(tidy(run), T.StructType([*base.schema.fields, T.StructField("__p", T.DoubleType())]))


#: Bounds of a prior's strength, in documents.
WEAKEST, STRONGEST = 2.0, 1e4


def strength(spread: float | None, noise: float | None, scale: float) -> float:
    """Documents that a Beta prior is worth: scale is m (1 - m), of which the means' spread beyond noise is 1 / (k + 1)."""
    between = max((spread or 0.0) - (noise or 0.0), 1e-6)
    return min(max(scale / between - 1, WEAKEST), STRONGEST)


def posteriors(scored: DataFrame) -> DataFrame:
    """__host, __path, host_mean, path_mean, all_mean: one row per path. Both priors are fitted to the data."""
    # Written once, one row per path: the sums below don't measure the texts again.
    paths = materialize(scored.groupBy("__host", "__path").agg(F.sum("__p").alias("ps"), F.count(F.lit(1)).alias("pn")), "paths")
    hosts = paths.groupBy("__host").agg(F.sum("ps").alias("hs"), F.sum("pn").alias("hn"), F.count(F.lit(1)).alias("sites"))
    whole = hosts.agg((F.sum("hs") / F.sum("hn")).alias("mean"), F.var_pop(F.col("hs") / F.col("hn")).alias("v"), F.avg(1 / F.col("hn")).alias("inv")).collect()[0]
    mean = whole["mean"] if whole["mean"] is not None else 0.5
    k = strength(whole.v, mean * (1 - mean) * (whole.inv or 0.0), mean * (1 - mean))
    hosts = hosts.select(F.col("__host").alias("__h"), "sites", (F.col("hs") / F.col("hn")).alias("own"), ((F.col("hs") + k * mean) / (F.col("hn") + k)).alias("host_mean"))
    joined = paths.join(hosts, F.col("__host").eqNullSafe(F.col("__h")))
    # Only hosts of several paths tell how paths differ; a path's weight is its size. One row reaches the driver.
    m = F.col("own")
    several = F.col("sites") > 1
    within = joined.where(several).agg(F.sum(F.col("pn") * F.pow(F.col("ps") / F.col("pn") - m, 2)).alias("v"), F.sum(m * (1 - m)).alias("noise"), F.sum(F.col("pn") * m * (1 - m)).alias("scale"), F.sum("pn").alias("n")).collect()[0]
    n = within.n or 1
    kp = strength((within.v or 0.0) / n, (within.noise or 0.0) / n, (within.scale or 0.0) / n)
    return joined.select("__host", "__path", "host_mean", ((F.col("ps") + kp * F.col("host_mean")) / (F.col("pn") + kp)).alias("path_mean"), F.lit(mean).alias("all_mean"))


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(q / (1 - q))


def judged(docs: DataFrame, lab: DataFrame, host: Column | None = None, path: Column | None = None, weight: float = 0.5, threshold: float = 0.35) -> DataFrame:
    """docs with p_doc, host_mean, path_mean, quality (posterior probability) and kept.

    Texts are measured once for the sites' sums and once where they are judged; they are never shuffled.
    """
    scored = evidence(docs, fit(docs, lab), F.col("source") if host is None else host, F.col("lang") if path is None else path)
    sites = materialize(posteriors(scored), "sites").toDF("__h", "__q", "__host_mean", "__path_mean", "__all_mean")
    site = F.broadcast(sites) if sites.count() <= MOST_SITES else sites
    joined = scored.join(site, F.col("__host").eqNullSafe(F.col("__h")) & F.col("__path").eqNullSafe(F.col("__q")))
    odds = logit(F.col("__p")) + weight * (logit(F.col("__path_mean")) - logit(F.col("__all_mean")))
    out = joined.withColumn("__quality", 1 / (1 + F.exp(-odds)))
    kept = beside(docs, "p_doc", "host_mean", "path_mean", "quality", "kept")
    return out.select(*[F.col(f"`{c}`") for c in kept], F.col("__p").alias("p_doc"), F.col("__host_mean").alias("host_mean"), F.col("__path_mean").alias("path_mean"), F.col("__quality").alias("quality"), (F.col("__quality") >= threshold).alias("kept"))


#: Sites up to which their table is broadcast.
MOST_SITES = 100_000


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source", "lang")
    return judged(docs, labels(spark, sf_dir)).select("doc_id", "p_doc", "host_mean", "path_mean", "quality", "kept")
