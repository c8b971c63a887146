"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_substrings, html_extract, line_dedup, near_dedup, packing, quality, sharding, substrings, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate passages of 50 words or more in all documents: how much of each, where, and the class that shares them."""
    return substrings.near_passages(_table(spark, sf_dir, "documents"), least=50, shingle=5, percent=80)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that stand on ten sites or more: counts, and a digest of the text that is left."""
    found = line_dedup.dedup(_table(spark, sf_dir, "documents"), min_sites=10)
    return found.select("doc_id", "lines.n_lines", "lines.n_removed", "lines.copied", F.sha2("text", 256).alias("kept_sha256"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents on 4-word shingles at 0.8."""
    return near_dedup.classes(_table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 200-byte strings that start elsewhere too."""
    return exact_substrings.digest(_table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes."""
    return sharding.shard(_table(spark, sf_dir, "documents"), shards=24)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = html_extract.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and the weak-supervision verdict of all documents."""
    found = quality.judged(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), path=public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of all documents, over the pieces and scores of a public vocabulary."""
    import public_tokenizers

    found = token_counts.token_counts(_table(spark, sf_dir, "documents").select("doc_id", "text"), path=public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of 10-word windows of the benchmark in all documents."""
    return decontaminate.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_sharding": op5_sharding,
    "op6_html_extraction": op6_html_extraction,
    "op7_quality_rules": op7_quality_rules,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_token_counts": op9_token_counts,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
}
ORACLES: dict[str, str] = {
    "op2_line_dedup": """
        with lines as (
          select doc_id, source, text, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> '') as worded,
            string_split(coalesce(text, ''), chr(10)) as every
          from documents),
        spread as (select l from (select source, unnest(worded) as l from lines) where source is not null group by l having count(distinct source) >= 10),
        cut as (select d.doc_id, d.l from (select distinct doc_id, unnest(worded) as l from lines) d join spread using (l)),
        met as (select doc_id, list(l) as ls from cut group by doc_id),
        sized as (
          select lines.*, coalesce(ls, []) as ls, list_filter(worded, lambda x: list_contains(coalesce(ls, []), x)) as hit
          from lines left join met using (doc_id)),
        judged as (
          select *, coalesce(list_sum(list_transform(hit, lambda x: length(x))), 0) as cut_chars, coalesce(list_sum(list_transform(worded, lambda x: length(x))), 0) as all_chars from sized)
        select doc_id, len(worded)::bigint as n_lines, (case when 2 * cut_chars < all_chars then len(hit) else 0 end)::bigint as n_removed,
          cut_chars > 0 and 2 * cut_chars >= all_chars as copied,
          sha256(case when cut_chars > 0 and 2 * cut_chars < all_chars then array_to_string(list_filter(every, lambda x: not list_contains(ls, x)), chr(10)) else text end) as kept_sha256
        from judged""",
}
