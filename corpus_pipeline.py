"""The corpus pipeline: quality rules, line dedup, MinHash near-dedup, benchmark decontamination, best-fit packing.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before has kept, and returns a DataFrame; all but the last
return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from mosaica.llm import common, decontaminate, line_dedup, near_dedup, packing, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand on ten sites or more; n_chars is that of the new text."""
    return line_dedup.without_boilerplate(docs, min_sites=10, chars_col="n_chars")


def near_dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_dedup.first_of_class(docs, shingle=5, percent=80)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents' pieces, in sequences of at most 2048 tokens."""
    return packing.pack(docs, path=public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", near_dedup_documents),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("best_fit_packing", pack_sequences),
]

#: Tokenizing and packing have no SQL form; of the stages, tests hold near-dedup alone against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over all documents; what a stage kept is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
