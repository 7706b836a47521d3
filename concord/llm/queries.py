"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, importance, ivfpq, licenses, partenum, pii, spm, suffixes, warc, wavelet

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_wavelet_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = wavelet.encode_corpus(table(spark, sf_dir, "documents"), tokenizer_file(BYTE_BPE))
    return wavelet.read_corpus(spark, path)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.mark(docs, table(spark, sf_dir, "benchmark")))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents"), keep=["doc_id"]))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.remove_repeats(table(spark, sf_dir, "documents")))


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.derivatives(table(spark, sf_dir, "pages"))
    text = F.when(F.col("record_type") == "conversion", F.decode("block", "UTF-8"))
    return records.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "block_digest", F.octet_length("block").cast("long").alias("n_bytes"), F.size("headers").cast("long").alias("n_headers"), F.length(text).cast("long").alias("n_chars"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spm.encode_digest(docs, tokenizer_file(PIECE_BPE), keep=["doc_id"]).select("doc_id", "spm.*")


def op7_pii_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivfpq.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance.draw(importance.score(docs, table(spark, sf_dir, "labels")))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.jaccard_components(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_wavelet_matrix": op1_wavelet_matrix,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_license_scan": op3_license_scan,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_warc_derivatives": op5_warc_derivatives,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_pii_candidates": op7_pii_candidates,
    "op8_ivf_pq": op8_ivf_pq,
    "op9_importance_resampling": op9_importance_resampling,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
}

ORACLE_SQL: dict[str, str] = {}
