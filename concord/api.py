"""The operations by name, for records of one kind: a table of JSON texts, or plain dictionaries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions.convert import Target, targets
from concord.operators import alignment, batch, profile, retrieval
from concord.plans.storage import cut
from concord.sources import files

REC, RECORD = "rec", "record"


def records(spark: SparkSession, data: DataFrame | list[dict]) -> DataFrame:
    """(rec, record): the table as it is, or one made of dictionaries."""
    if isinstance(data, DataFrame):
        return data.select(REC, RECORD)
    return spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(data)], f"{REC} int, {RECORD} string")


def _fields(schema: dict | list[Target]) -> list[Target]:
    return targets(schema) if isinstance(schema, dict) else schema


def profile_source(spark: SparkSession, data: DataFrame | list[dict], descriptions: dict[str, str] | None = None) -> DataFrame:
    """A row a path: types, examples, presence, tokens."""
    docs = records(spark, data)
    long = cut(profile.cells(docs, [REC], RECORD), "cells")
    return profile.profile(long, [REC], None, profile.totals(docs, RECORD), descriptions)


def signature_of(spark: SparkSession, data: DataFrame | list[dict]) -> DataFrame:
    """One row: the paths, their types and the hash of all records together."""
    docs = records(spark, data)
    long = cut(profile.cells(docs, [REC], RECORD), "cells").withColumn("one", F.lit(0))
    return profile.signatures(long, "one").drop("one")


def infer_mapping(spark: SparkSession, data: DataFrame | list[dict], schema: dict | list[Target], descriptions: dict[str, str] | None = None) -> DataFrame:
    return alignment.infer_mapping(profile_source(spark, data, descriptions), alignment.target_table(spark, _fields(schema)))


def relevance_of(spark: SparkSession, data: DataFrame | list[dict], schema: dict | list[Target], dial: float = 0.5, descriptions: dict[str, str] | None = None) -> DataFrame:
    """One row: coverage, required coverage, and whether the records are convertible, to be reviewed or unrelated."""
    share = alignment.coverage(infer_mapping(spark, data, schema, descriptions))
    return share.withColumn("verdict", alignment.relevance(F.col("required_coverage"), F.col("coverage"), F.col("required_mapped"), dial))


def run_alignment(spark: SparkSession, data: DataFrame | list[dict], schema: dict | list[Target], descriptions: dict[str, str] | None = None, mapping: DataFrame | None = None) -> DataFrame:
    """Golden records with provenance, issues and whether they conform; by a mapping that is given or by one that is inferred."""
    docs, fields = records(spark, data), _fields(schema)
    if mapping is None:
        mapping = cut(infer_mapping(spark, docs, fields, descriptions), "mapping")
    return alignment.align(docs, [REC], RECORD, fields, mapping=mapping)


def search(documents: DataFrame, queries: DataFrame, top: int = 10) -> DataFrame:
    """``documents(doc_id, text)`` by ``queries(query_id, text)``: chunked, ranked by words and by hashed vectors, fused."""
    from concord.functions import text

    chunks = retrieval.chunks(files.blocks(documents, "doc_id", "text"), "doc_id").withColumn("chunk_id", F.concat_ws("#", "doc_id", "chunk"))
    chunks = cut(chunks, "chunks")
    q = queries.select("query_id", F.array_distinct(text.tokens(F.col("text"))).alias("q")).select("query_id", F.size("q").alias("n"), F.explode("q").alias("t"))
    d = chunks.select("chunk_id", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("t"))
    lexical = d.join(q, "t").groupBy("query_id", "chunk_id").agg(F.round(F.count("*") / F.first("n"), 6).alias("overlap"))
    vector = retrieval.cosine(retrieval.hashed(chunks, "chunk_id", "text"), retrieval.hashed(queries, "query_id", "text"), "chunk_id", "query_id")
    found = retrieval.fuse(lexical, vector, ["query_id"], "chunk_id", "overlap", "cosine", top)
    return found.join(chunks.select("chunk_id", "doc_id", "text"), "chunk_id").select("query_id", "rank", "doc_id", "chunk_id", "score", "text")


plan_batch = batch.plan_batch
run_batch = batch.run_batch
