"""A corpus pipeline: quality classifier, line dedup, near-duplicate removal, mixing, packing.

Every stage takes what its predecessor kept, whole, and all but the last return its columns: an extra column keeps its
values even if an operator makes one of that name.

Edge cases, for all stages: an empty table gives an empty result; null texts count as empty for measures, shingles and
tokens, and are handed on as null; repeated rows are judged alike; very long texts are worked on whole.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import line_dedup, mixing, ngram_join, packing, quality_classifier
from stratalog.llm.common import discard, documents, labels, materialize, words

OWN = "__own_"


def set_aside(docs: DataFrame) -> DataFrame:
    """docs with every column but those that the operators work on renamed, so that no name clashes."""
    used = ("doc_id", "text", "lang", "source")
    return docs.withColumnsRenamed({c: OWN + c for c in docs.columns if c not in used})


def restored(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({OWN + c: c for c in docs.columns}).select(*[F.col(f"`{c}`") for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Without labels of both kinds all stay; a null text is judged as an empty one."""
    kept = quality_classifier.judged(set_aside(docs), labels(spark, sf_dir)).where("kept").drop("p_doc", "host_mean", "path_mean", "quality", "kept")
    return restored(kept, docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents of which no word is left; n_chars follows the text.

    Documents that had no word before stay, as do null texts. Of equal rows (one doc_id, one text) all stay alike.
    """
    out = line_dedup.dedup_lines(set_aside(docs), min_words=line_dedup.ALL_WORDS, near_chars=line_dedup.NEAR_CHARS)
    bare = F.col("text").isNull() | (F.size(words(F.col("text"))) > 0) | (F.col("n_exact") + F.col("n_near") == 0)
    back = restored(out.where(bare).drop("n_lines", "n_exact", "n_near"), docs)
    return back.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays; of rows with equal ids one. Texts without words stay, and rows without an id."""
    named = docs.where(F.col("doc_id").isNotNull())
    keep = ngram_join.link(named).where("id = component").select(F.col("id").alias("__keep")).distinct()
    return named.join(keep, F.col("doc_id") == F.col("__keep"), "left_semi").dropDuplicates(["doc_id"]).unionByName(docs.where(F.col("doc_id").isNull()))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their source's rate, in hashed order; a null source is one of its own."""
    return restored(mixing.mix(set_aside(docs)), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces' places in sequences; a null or empty text is one piece, its end mark. Rows of one id are packed each."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("ngram_join", near_duplicates),
    ("mixing", mixing_stage),
    ("packing", pack),
]

#: Stages 2, 3 and 5 have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
