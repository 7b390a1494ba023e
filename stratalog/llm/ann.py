"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-random rotation (three rounds of random signs and a fast Hadamard transform) maps a unit
vector; its hash in a table is the nearest signed axis. A query probes the axes with the largest
signed coordinates, in every table. Largest inner product is turned into largest cosine by one more
coordinate, sqrt(M^2 - |x|^2), with M the largest norm; queries get 0 there.

Every row is indexed. Equal vectors share one entry that keeps the smallest ids, as many as a result
can hold, so a hot vector costs one row and nothing is lost: ties go to the smaller id. A bucket of
more than `block` entries is split into blocks by hash; a query visits each of them. A task ranks one
block's candidates exactly, in double precision, and passes on the best k of each query, so no pairs
are emitted and the union of blocks gives exactly the best k of all candidates.

Edge cases: vectors that are null, empty, zero or hold a null or a number that is not finite take no
part, and neither do vectors of another length than the most common one; with fewer candidates than k
all are returned; an empty table gives an empty result; a repeated id counts as one entry per row;
extra columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalog.llm.common import materialize

K = 20
TABLES = 2
#: Share of a table's signed axes that a query probes; recall on the test tables is in the README.
PROBED = 0.52
BLOCK = 4096
#: Queries that one task ranks at most, about.
ASKED = 8192


def hadamard(x: np.ndarray) -> np.ndarray:
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotate(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    """x padded to a power of two, then three rounds of signs and transform."""
    d = 1 << max(0, int(x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), d))
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng([seed, table])
    for _ in range(3):
        y = hadamard(y * rng.choice([-1.0, 1.0], d))
    return y


def axes(y: np.ndarray) -> np.ndarray:
    """Nearest signed axis: 2 i for +i, 2 i + 1 for -i."""
    i = np.abs(y).argmax(1)
    return 2 * i + (y[np.arange(len(y)), i] < 0)


def probes(y: np.ndarray, n: int) -> np.ndarray:
    both = np.stack([y, -y], 2).reshape(len(y), -1)
    return np.argsort(-both, 1, kind="stable")[:, :n]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col)
    ok = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.coalesce(ok, F.lit(False)))


def smallest_ids(rows: DataFrame, n: int) -> DataFrame:
    """v, ids: each different vector with its n smallest ids, ascending. Hot groups are cut per salt before they meet."""
    salted = rows.select("id", "v", F.xxhash64("v").alias("h"), F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt"))
    own = Window.partitionBy("h", "v", "salt").orderBy("id")
    some = salted.withColumn("r", F.row_number().over(own)).where(F.col("r") <= n)
    return some.groupBy("h", "v").agg(F.slice(F.sort_array(F.collect_list("id")), 1, n).alias("ids")).select("v", "ids")


def nearest(vectors: DataFrame, query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, tables: int = TABLES, probed: float = PROBED, block: int = BLOCK, seed: int = 3) -> DataFrame:
    """query_id, rank, id, score: the k nearest found of each row for which `query` (a Column of `id`) holds."""
    import pandas as pd

    rows = usable(vectors, id_col, vec_col)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    shapes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("most"), F.min(square).alias("least"), F.sum(F.when(query, 1).otherwise(0)).alias("asked")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not shapes:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, id bigint, score double")
    dim, most, asked_n = shapes[0].d, float(shapes[0].most), shapes[0].asked
    uneven = shapes[0].least < (1 - 1e-4) * most
    n_probe = max(1, round(probed * 2 * (1 << (dim + uneven - 1).bit_length())))
    slices = max(1, -(-asked_n // ASKED))
    kind = rows.schema["v"].dataType.simpleString()
    rows = rows.where(F.size("v") == dim)
    stack = lambda col: np.stack(col.to_numpy()).astype(np.float64)

    def lifted(x: np.ndarray, of_query: bool) -> np.ndarray:
        return np.column_stack([x, np.zeros(len(x)) if of_query else np.sqrt(np.maximum(0.0, most - (x * x).sum(1)))]) if uneven else x

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            y = lifted(stack(b["v"]), False) if len(b) else None
            for t in range(tables if len(b) else 0):
                yield pd.DataFrame({"tab": np.int32(t), "axis": axes(rotate(y, t, seed)).astype(np.int32), "ids": b["ids"].to_numpy(), "v": b["v"].to_numpy()})

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            y = lifted(stack(b["v"]), True) if len(b) else None
            for t in range(tables if len(b) else 0):
                p = probes(rotate(y, t, seed), n_probe)
                i = np.repeat(np.arange(len(b)), p.shape[1])
                yield pd.DataFrame({"tab": np.int32(t), "axis": p.ravel().astype(np.int32), "query": b["query"].to_numpy()[i], "qv": b["v"].to_numpy()[i]})

    hashed = materialize(smallest_ids(rows, k + 1).mapInPandas(index, f"tab int, axis int, ids array<bigint>, v {kind}"), "index")
    # At most tables * 2 * (padded dimension) rows, whatever the input.
    sizes = F.broadcast(hashed.groupBy("tab", "axis").count().select("tab", "axis", F.ceil(F.col("count") / F.lit(block)).cast("int").alias("blocks")))
    # A query vector is searched once, however many query rows hold it.
    asked = rows.where(query).select("id", "v", F.xxhash64("v").alias("h"))
    different = materialize(asked.groupBy("h", "v").agg(F.min("id").alias("query")), "queries")
    cut = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("cut")
    have = hashed.join(sizes, ["tab", "axis"]).select("tab", "axis", F.pmod(F.xxhash64(F.element_at("ids", 1)), F.col("blocks")).cast("int").alias("part"), cut, "ids", "v")
    ask = different.mapInPandas(probe, f"tab int, axis int, query bigint, qv {kind}").join(sizes, ["tab", "axis"]).select("tab", "axis", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), F.pmod(F.xxhash64("query"), F.lit(slices)).cast("int").alias("cut"), "query", "qv")
    keep = k + 1

    def rank(have: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if len(have) and len(ask):
            x, ids = stack(have["v"]), have["ids"].to_numpy()
            first, n_ids = np.array([i[0] for i in ids], np.int64), np.array([len(i) for i in ids])
            flat, begin = np.concatenate(ids), np.cumsum(n_ids) - n_ids
            for lo in range(0, len(ask), 512):
                q, qid = stack(ask["qv"].iloc[lo : lo + 512]), ask["query"].to_numpy()[lo : lo + 512]
                s = q @ x.T
                m = min(keep, s.shape[1])
                low = np.partition(s, s.shape[1] - m, 1)[:, s.shape[1] - m]
                # A product of matrices may round otherwise than a product of vectors: keep a margin, then score again.
                i, j = np.nonzero(s >= (low - 1e-9 * np.maximum(1.0, np.abs(low)))[:, None])
                exact = (q[i] * x[j]).sum(1)
                order = np.lexsort((first[j], -exact, i))
                i, j, exact = i[order], j[order], exact[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                i, j, exact = i[place < keep], j[place < keep], exact[place < keep]
                n = n_ids[j]
                out[0].append(np.repeat(qid[i], n))
                out[1].append(flat[np.arange(n.sum()) + np.repeat(begin[j] - (np.cumsum(n) - n), n)])
                out[2].append(np.repeat(exact, n))
        return pd.DataFrame({"query": np.concatenate(out[0]), "id": np.concatenate(out[1]), "score": np.concatenate(out[2])})

    key = ["tab", "axis", "part", "cut"]
    found = have.groupBy(*key).cogroup(ask.groupBy(*key)).applyInPandas(rank, "query bigint, id bigint, score double")
    by_score = lambda of: F.row_number().over(Window.partitionBy(of).orderBy(F.desc("score"), "id"))
    best = found.groupBy("query", "id").agg(F.max("score").alias("score")).withColumn("r", by_score("query")).where(F.col("r") <= keep).drop("r")
    members = asked.join(different.withColumnRenamed("v", "qv"), "h").where(F.col("v") == F.col("qv")).select(F.col("id").alias("query_id"), "query")
    out = members.join(best, "query").where(F.col("id") != F.col("query_id")).withColumn("rank", by_score("query_id").cast("int"))
    return out.select("query_id", "rank", "id", "score").where(F.col("rank") <= k)


def op5_ann(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, F.col("id") % 20 == 0).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
