"""Chunks, hashed embeddings, and fused lexical and vector rankings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.functions import text

CHUNK = 800
FUSION = 60
QUERY_BLOCK = 8192  # queries that are broadcast at a time: 4 MB of 64 dimensions
ROWS = 256  # candidates that are compared at a time


def chunks(blocks: DataFrame, doc: str) -> DataFrame:
    """``blocks(doc, ord, text, heading)`` to chunks: a fold over each document's blocks in order, a step a block."""
    listed = blocks.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("ord", "text", "heading"))).alias("b"))
    schema = f"{doc} {dict(blocks.dtypes)[doc]}, chunk int, text string, n_blocks long"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, items in zip(batch.column(doc), batch.column("b"), strict=True):
                texts, headings = (items.values.field(k).to_pylist() for k in ("text", "heading"))
                groups: list[list[str]] = []
                size = 0
                for t, heading in zip(texts, headings, strict=True):
                    if not groups or size > 0 and (heading or size >= CHUNK):
                        groups.append([])
                        size = 0
                    groups[-1].append(t)
                    size += len(t)
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(groups), batch.column(doc).type), pa.array(range(len(groups)), pa.int32()), pa.array(["\n".join(g) for g in groups], pa.string()), pa.array(map(len, groups), pa.int64())], [doc, "chunk", "text", "n_blocks"])

    return listed.mapInArrow(fold, schema)


def hashed(docs: DataFrame, key: str, column: str) -> DataFrame:
    """Sparse unit vectors: key, slot, value.  Counts are pre-aggregated by token."""
    words = docs.select(key, F.explode(text.tokens(F.col(column))).alias("w"))
    slots = words.groupBy(key, text.hash_slot(F.col("w")).alias("slot")).agg(F.sum(text.hash_sign(F.col("w"))).alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(key)))
    return slots.select(key, "slot", F.col("v"), norm.alias("norm")).where("norm > 0 AND v <> 0").select(key, "slot", (F.col("v") / F.col("norm")).alias("value"))


def cosine(docs: DataFrame, queries: DataFrame, doc: str, query: str) -> DataFrame:
    """Cosine of sparse vectors, joined on slots; Spark broadcasts the queries' if they are small."""
    q = queries.withColumnRenamed("value", "qv")
    return docs.join(q, "slot").groupBy(query, doc).agg(F.round(F.sum(F.col("value") * F.col("qv")), 9).alias("cosine"))


def fuse(lexical: DataFrame, vector: DataFrame, keys: list[str], item: str, score_l: str, score_v: str, top: int = 10) -> DataFrame:
    """Reciprocal rank fusion: 1 / (60 + rank) from each ranking, lexical scores above 0 only."""
    l = lexical.where(F.col(score_l) > 0).select(*keys, item, F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score_l), item)).alias("rl"))  # noqa: E741
    v = vector.select(*keys, item, F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score_v), item)).alias("rv"))
    both = l.join(v, [*keys, item], "full").select(*keys, item, F.round(F.coalesce(1 / (FUSION + F.col("rl")), F.lit(0.0)) + F.coalesce(1 / (FUSION + F.col("rv")), F.lit(0.0)), 9).alias("score"))
    return both.select("*", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), item)).alias("rank")).where(F.col("rank") <= top)


def _best(held: list[np.ndarray], k: int, least: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Of (query, id, score) the k best of each query, of equals the smaller ids; and each query's k-th score."""
    order = np.lexsort((held[1], -held[2], held[0]))
    q, i, d = (x[order] for x in held)
    begin = np.searchsorted(q, np.arange(len(least) + 1))
    place = np.arange(len(q)) - begin[q]
    full = np.flatnonzero(np.diff(begin) >= k)
    least = least.copy()
    least[full] = d[begin[full] + k - 1]
    return [x[place < k] for x in (q, i, d)], least


def vector_topk(vectors: DataFrame, every: int, k: int = 10) -> DataFrame:
    """The k most similar (dot product) of every ``every``-th vector, exact; queries are broadcast in bounded blocks."""
    spark = vectors.sparkSession
    ids = vectors.where(F.col("vec_id") % every == 0).select("vec_id")
    blocks = max(1, -(-ids.count() // QUERY_BLOCK))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    out = None
    for b in range(blocks):
        mine = rows.where((F.col("vec_id") % every == 0) & (F.pmod(F.floor(F.col("vec_id") / every), F.lit(blocks)) == b)).toArrow()
        if not len(mine):
            continue
        names = mine.column("vec_id").to_numpy()
        matrix = np.stack([np.array(x, float) for x in mine.column("embedding").to_pylist()])
        sent = spark.sparkContext.broadcast((names, matrix))

        def local(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            """A task's best of each query: what does not reach the k-th so far is never kept."""
            queries, m = sent.value
            least = np.full(len(queries), -np.inf)
            held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]  # query, vec_id, score
            for batch in batches:
                own = batch.column("vec_id").to_numpy()
                x = batch.column("embedding").flatten().to_numpy().reshape(len(own), m.shape[1])
                for low in range(0, len(own), ROWS):
                    mine = own[low : low + ROWS]
                    dots = np.round(m @ x[low : low + ROWS].T, 9)
                    dots[queries[:, None] == mine[None, :]] = -np.inf
                    q, c = np.nonzero((dots >= least[:, None]) & (dots > -np.inf))
                    held = [np.concatenate(p) for p in zip(held, (q, mine[c], dots[q, c]), strict=True)]
                    if len(held[0]) > 4 * k * len(queries):
                        held, least = _best(held, k, least)
            (q, i, d), _ = _best(held, k, least)
            yield pa.RecordBatch.from_arrays([pa.array(queries[q]), pa.array(i), pa.array(d)], ["query_id", "vec_id", "score"])

        part = rows.mapInArrow(local, "query_id long, vec_id long, score double").where("score > double('-infinity')")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def ranking_metrics(ranked: DataFrame, query: str, k: int) -> DataFrame:
    """Of ``ranked(query, rank, relevant, total)``: recall@k, MRR, nDCG@k over queries with something relevant.

    The ideal order is that of the gains returned.
    """
    top = ranked.where((F.col("rank") <= k) & (F.col("total") > 0))
    ideal = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("relevant"), "rank"))
    gains = top.select("*", (F.col("relevant") / F.log2(F.col("rank") + 1)).alias("dcg"), (F.col("relevant") / F.log2(ideal + 1)).alias("idcg"))
    per = gains.groupBy(query).agg((F.sum("relevant") / F.least(F.first("total"), F.lit(k))).alias("recall"), F.coalesce(F.max(F.when(F.col("relevant") > 0, 1 / F.col("rank"))), F.lit(0.0)).alias("rr"), F.when(F.sum("idcg") > 0, F.sum("dcg") / F.sum("idcg")).otherwise(0.0).alias("ndcg"))
    return per.agg(F.count("*").alias("n_queries"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg"))
