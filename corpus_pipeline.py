"""Corpus pipeline: documents to packed training sequences in five stages, each by one operator of weftline.llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontaminate, language, neardup, packing, repeats
from weftline.llm.common import gathered, materialise

#: Posterior under which a language is taken for unknown.
LEAST_SCORE = 0.5
_TABLE = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised; lang becomes the prediction. Null and letterless texts go.

    The model is learned from documents that aren't held out, as in the operator's query.
    """
    model = language.trained_on(docs)
    found = language.identify(docs.select(*_TABLE, F.col("text").alias("whole")), model)
    kept = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.select("doc_id", F.col("whole").alias("text"), F.col("lang_pred").alias("lang"), "source", "n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group, that of the least id; of repeated rows one."""
    kept = neardup.near_duplicates(docs).filter("kept").select("doc_id", "text_hash").distinct()
    keyed = docs.select(*_TABLE).withColumn("text_hash", F.xxhash64("text"))
    same = (F.col("k.text_hash") == keyed["text_hash"]) & F.col("k.doc_id").eqNullSafe(keyed["doc_id"])
    return gathered(keyed.join(kept.alias("k"), same, "left_semi").dropDuplicates(["doc_id", "text_hash"]).select(*_TABLE), docs.rdd.getNumPartitions())


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that an earlier document has out of each text; documents of which nothing is left go."""
    cut = repeats.remove_repeats(docs).filter("n_removed > 0").select("doc_id", "text_hash", "kept_text").dropDuplicates(["doc_id", "text_hash"])
    keyed = docs.select(*_TABLE).withColumn("text_hash", F.xxhash64("text")).join(cut, ["doc_id", "text_hash"], "left")
    text = F.coalesce("kept_text", "text")
    rest = keyed.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars")).filter("length(trim(text)) > 0")
    return gathered(rest, docs.rdd.getNumPartitions())


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a benchmark item is found."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits = decontaminate.contaminated(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), benchmark)
    hits = hits.select("doc_id", "text_hash").distinct()
    keyed = docs.select(*_TABLE).withColumn("text_hash", F.xxhash64("text"))
    same = (hits["text_hash"] == keyed["text_hash"]) & hits["doc_id"].eqNullSafe(keyed["doc_id"])
    return gathered(keyed.join(hits, same, "left_anti").select(*_TABLE), docs.rdd.getNumPartitions())


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 4096 tokens."""
    return gathered(packing.pack(docs, packing.tokenizer_file()), docs.rdd.getNumPartitions())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("minhash_neardup", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]

#: The stages can't be expressed in SQL; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written as Parquet to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
