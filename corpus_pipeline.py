"""A corpus pipeline of five operators: what is toxic, repeated, a near copy or a benchmark leak goes, the rest is encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.llm import byte_bpe, decontamination, jaccard_join, line_dedup, toxicity
from cinelake.llm.common import drop_path, materialize


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labels, scores below 0.5."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    toxic = toxicity.score(docs, model).filter("predicted = 1").select("doc_id").distinct()
    return docs.join(toxic, "doc_id", "left_anti").select(docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat earlier ones; those of which nothing but blank lines is left go, those that never had a word stay."""
    # columns of docs that have the names of dedup_lines' own step aside
    own = {c: f"__docs_{c}" for c in ("n_lines", "n_dropped", "dropped") if c in docs.columns}
    kept = line_dedup.dedup_lines(docs.withColumnsRenamed(own))
    left = kept.filter((F.col("n_dropped") == 0) | F.col("text").rlike(r"[\p{L}\p{N}]"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return left.select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that 4-word shingle Jaccard links of 0.85 connect, the document with the smallest id."""
    groups = jaccard_join.jaccard_components(docs)
    later = groups.filter("doc_id != component_id").select("doc_id").distinct()
    return docs.join(later, "doc_id", "left_anti").select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than 0.8 of the five-word shingles of every benchmark item."""
    return decontamination.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and digests of them and of the bytes that they decode to."""
    import public_tokenizers

    return byte_bpe.encoded_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("line_dedup", without_repeated_lines),
    ("ngram_jaccard_join", one_of_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("byte_bpe", encoded),
]

#: SQL has no toxicity model: tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the documents of sf_dir, each stage's rows written and reread, and deleted when the next one's are written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, path = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            drop_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
