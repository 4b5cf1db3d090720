"""A corpus from raw documents to token files: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldwright.llm import decontaminate, exchange, jaccard, language_id, mixing, tokens


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence; those rejected go."""
    return language_id.keep_identified(docs, language_id.learn(docs))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.75 or more."""
    return jaccard.keep_one(docs)


def clean_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources; a document that it takes twice comes twice."""
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, and their index: doc_id, start, n_tokens, ids_crc32."""
    path = exchange.new_path(spark, "tokens")
    tokens.write_token_files(docs, path, tokens.tokenizer_path())
    return tokens.token_index(spark, path)


STAGES = [
    ("language_id", identify),
    ("jaccard_join", deduplicate),
    ("decontamination", clean_benchmark),
    ("mixing", mix),
    ("token_files", write_tokens),
]

#: Language identification and tokens can't be written in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        with exchange.small_batches(spark):
            docs = exchange.keep(out, f"stage-{name}")
    return docs
