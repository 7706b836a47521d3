"""A corpus from raw documents to token ids: each stage calls one operator and keeps its decisions.

A stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of
documents.  ``run`` writes each stage's table to the shared folder and reads it back, so a
later stage never recomputes an earlier one.

Edge cases, for every stage: an empty table gives an empty table; columns beyond doc_id and text
are kept as they are, whatever their names; repeated rows are judged alike.  A null doc_id is
an ordinary id.  Null and empty texts, and very long ones, are told with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import common, decontaminate, importance, partenum, pii, spm
from concord.llm.queries import PIECE_BPE, table, tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Texts without a word, null ones among them, are rejected; repeated rows stay or go together; a
    long text is judged whole.
    """
    return importance.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the smallest doc_id, null last (of such rows, the one with the least text).

    Null and empty texts are near to nothing and all stay; of repeated rows one stays.
    """
    row = common.free_name(docs, "_row")
    numbered = common.cut(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = partenum.rooted_rows(numbered, row)
    ids = found.where("root is not null").groupBy("root", "doc_id").agg(F.min("row").alias("row"), F.count("*").alias("n"))
    least = ids.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row", "n")).alias("x")).select("root", "x.*")
    least = common.cut(least, "least")
    tied = least.where("n > 1").select(F.col("root").alias("r"), F.col("doc_id").alias("i"))
    tied = found.join(tied, F.col("root").eqNullSafe(F.col("r")) & F.col("doc_id").eqNullSafe(F.col("i"))).select("root", "row")
    texts = numbered.select(F.col(f"`{row}`").alias("row"), F.col("text").cast("string").alias("text"))
    tied = tied.join(texts, "row").groupBy("root").agg(F.min(F.struct("text", "row")).alias("x")).select("x.row")
    kept = found.where("root is null").select("row").unionByName(least.where("n = 1").select("row")).unionByName(tied)
    return numbered.join(kept.withColumnRenamed("row", row), row, "left_semi").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more of the benchmark than the contract's rule allows.

    A text without words holds nothing of it and stays.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind; n_chars follows where the table has it.

    All rows stay; a null text stays null.
    """
    clean = pii.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the SentencePiece ids of each document; a null or empty text has none."""
    name = common.free_name(docs, "spm")
    return spm.encode(docs.select("doc_id", "text"), tokenizer_file(PIECE_BPE), name, keep=["doc_id"]).select("doc_id", F.col(f"{name}.ids").alias("ids"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", redaction),
    ("SentencePiece encoding and decoding", tokens),
]

#: the classifier and the tokenizer are beyond SQL; tests/llm/test_pipeline.py compares every stage with plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
