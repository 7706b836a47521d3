"""Nearest neighbours by an inverted file of coarse centroids with product-quantised residuals.

``train`` fits coarse centroids and sub-quantisers by k-means on a bounded sample
(``SAMPLE`` vectors, those with the smallest hash of vec_id); ``build`` indexes every vector:
its list, its code, and the vector itself for reranking.  A list longer than ``BLOCK`` is split
by a hash of vec_id into blocks, and queries meet blocks, so a list that holds a third of all
vectors is many tasks' work.  ``search`` probes each query's nearest lists, ranks a block's codes by asymmetric
distance tables, reranks the best exactly in double precision, and merges the blocks' bests.
Equal vectors are one entry with many ids, of which the k + 1 smallest can matter to a query;
so copies never crowd out others.

Edge cases: vectors that are null, zero, of another length than most, or that hold null or
non-finite components take no part; ties go to the smaller vec_id; fewer candidates than k give
fewer rows; a vec_id in several rows is near by the nearest of them, as a query and as a candidate,
and is never its own neighbour; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .hashing import U, mix
from .packing import first_of_runs

SAMPLE = 40_000
BLOCK = 8192
WITHIN = 0.97  # of the sample's true neighbours, so many must lie in the lists probed
RERANK = 128  # distinct vectors of a block that are reranked, at the least


@dataclass
class Quantiser:
    coarse: np.ndarray  # lists x dims
    fine: np.ndarray  # parts x 256 x dims of a part
    probes: int = 8  # lists that a query looks into

    @property
    def parts(self) -> int:
        return len(self.fine)

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each vector, nearest first."""
        d = (self.coarse**2).sum(1) - 2 * x @ self.coarse.T
        n = min(n, len(self.coarse))
        some = np.argpartition(d, n - 1, axis=1)[:, :n]
        return np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), axis=1, kind="stable"), 1)

    def encode(self, residuals: np.ndarray) -> np.ndarray:
        out = np.empty((len(residuals), self.parts), np.uint8)
        for k, (book, part) in enumerate(zip(self.fine, np.split(residuals, self.parts, 1), strict=True)):
            out[:, k] = ((book**2).sum(1) - 2 * part @ book.T).argmin(1)
        return out

    def tables(self, residual: np.ndarray) -> np.ndarray:
        """Squared distances of a query's residual to the centroids of each part."""
        return np.stack([((book - part) ** 2).sum(1) for book, part in zip(self.fine, np.split(residual, self.parts), strict=True)])


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = np.concatenate([((centres**2).sum(1) - 2 * x[i : i + 4096] @ centres.T).argmin(1) for i in range(0, len(x), 4096)])
        count = np.bincount(at, minlength=len(centres))
        order = np.argsort(at, kind="stable")
        full = np.flatnonzero(count)
        centres[full] = np.add.reduceat(x[order], np.cumsum(count)[full] - count[full]) / count[full, None]
        gone = np.flatnonzero(count == 0)
        if len(gone):
            centres[gone] = x[rng.integers(0, len(x), len(gone))]
    return centres


def clean(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and embedding (array<double>) of the vectors that take part."""
    common.small_batches(vectors.sparkSession)
    v = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("embedding"))
    v = v.where("vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    usual = v.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
    return v.where(F.size("embedding") == (usual["n"] if usual else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def train(vectors: DataFrame, lists: int | None = None, parts: int = 16, seed: int = 5) -> Quantiser | None:
    rows = common.smallest(vectors, "vec_id", SAMPLE).select("embedding").toArrow().column("embedding").combine_chunks()
    if not len(rows):
        return None
    x = np.unique(_matrix(rows), axis=0)
    rng = np.random.default_rng(seed)
    dims = x.shape[1]
    parts = math.gcd(parts, dims)
    coarse = kmeans(x, min(lists or max(1, min(1024, round(2 * math.sqrt(len(x))))), len(x)), rng)
    got = Quantiser(coarse, np.zeros((parts, 0, 0)))
    residuals = x - coarse[got.nearest(x, 1)[:, 0]]
    some = residuals[rng.permutation(len(x))[:20_000]]
    got.fine = np.stack([kmeans(p, 256, rng) if len(p) >= 256 else np.resize(p, (256, p.shape[1])) for p in np.split(some, parts, 1)])
    got.probes = _calibrated(got, x[rng.permutation(len(x))[:10_000]])
    return got


def _calibrated(q: Quantiser, x: np.ndarray, queries: int = 200, k: int = 10) -> int:
    """The number of lists that hold the wanted share of a sample's true neighbours."""
    lists = len(q.coarse)
    home = q.nearest(x, 1)[:, 0]
    needed = []
    for v, order in zip(x[:queries], q.nearest(x[:queries], lists), strict=True):
        near = np.argsort(((x - v) ** 2).sum(1), kind="stable")[1 : k + 1]
        place = np.empty(lists, np.int64)
        place[order] = np.arange(lists)
        needed += place[home[near]].tolist()
    return int(np.quantile(needed, WITHIN)) + 1 if needed else lists


def distinct(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each distinct vector, and the place among these of every row."""
    places = np.arange(1, vectors.shape[1] + 1, dtype=U) * U(0x9E3779B97F4A7C15)
    _, first, entry = np.unique(mix(vectors.view(U) ^ places).sum(1), return_index=True, return_inverse=True)
    if not (vectors[first[entry]].view(U) == vectors.view(U)).all():  # two vectors of one hash
        _, first, entry = np.unique(vectors.view(U), axis=0, return_index=True, return_inverse=True)
    return first, entry.ravel()


INDEX = "list int, block int, ids binary, codes binary, vectors binary"


def build(vectors: DataFrame, quantiser: Quantiser) -> DataFrame:
    """The index: a row for each block of a list."""
    sent = vectors.sparkSession.sparkContext.broadcast(quantiser)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column("embedding"))
                at = q.nearest(x, 1)[:, 0]
                codes = q.encode(x - q.coarse[at])
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column("vec_id"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([v.tobytes() for v in x], pa.binary())], ["list", "vec_id", "code", "vector"])

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        ids = table.column("vec_id").to_numpy().astype("<i8").tobytes()
        return pa.table({"list": table.column("list")[:1], "block": table.column("block")[:1], "ids": [ids], "codes": [b"".join(table.column("code").to_pylist())], "vectors": [b"".join(table.column("vector").to_pylist())]})

    rows = common.cut(vectors.mapInArrow(common.lean(assigned), "list int, vec_id long, code binary, vector binary"), "codes")
    sizes = rows.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))  # a row a list
    blocks = rows.join(F.broadcast(sizes), "list").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).drop("blocks")
    return common.cut(blocks.groupBy("list", "block").applyInArrow(packed, INDEX), "index")


def search(queries: DataFrame, index: DataFrame, quantiser: Quantiser, k: int = 10, probes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found."""
    spark = queries.sparkSession
    sent = spark.sparkContext.broadcast(quantiser)
    probes = probes or quantiser.probes

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        for batch in batches:
            if len(batch):
                x, ids = _matrix(batch.column("embedding")), batch.column("vec_id").to_numpy()
                near = q.nearest(x, probes)
                rows = [(int(c), ids[hit].astype("<i8").tobytes(), x[hit].tobytes()) for c in np.unique(near) for hit in [np.flatnonzero((near == c).any(1))]]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["list", "query_ids", "queries"])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        dims = q.coarse.shape[1]
        for batch in batches:
            for row in batch.to_pylist():
                ids, codes = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["codes"], np.uint8).reshape(-1, q.parts)
                vectors = np.frombuffer(row["vectors"], float).reshape(-1, dims)
                first, entry = distinct(vectors)  # ids are sorted: first has the smallest
                order = np.argsort(entry, kind="stable")
                order = order[first_of_runs(entry[order], ids[order])]
                begin = np.searchsorted(entry[order], np.arange(len(first) + 1))
                out: list[tuple[int, int, float]] = []
                for query, v in zip(np.frombuffer(row["query_ids"], "<i8").tolist(), np.frombuffer(row["queries"], float).reshape(-1, dims), strict=True):
                    tables = q.tables(v - q.coarse[row["list"]])
                    rough = tables[np.arange(q.parts), codes[first]].sum(1)
                    best = np.argpartition(rough, RERANK)[:RERANK] if len(rough) > RERANK else np.arange(len(rough))
                    exact = np.sqrt(((vectors[first[best]] - v) ** 2).sum(1))
                    near: dict[int, float] = {}
                    for e, d in zip(best.tolist(), exact.tolist(), strict=True):
                        for i in ids[order[begin[e] : min(begin[e + 1], begin[e] + k + 1)]].tolist():
                            near[i] = min(d, near.get(i, d))
                    near.pop(query, None)
                    out += [(query, i, d) for d, i in sorted((d, i) for i, d in near.items())[:k]]
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.float64())], ["query_id", "vec_id", "score"])

    wanted = queries.mapInArrow(common.lean(probed), "list int, query_ids binary, queries binary")
    sizes = index.groupBy("list").agg(F.collect_list("block").alias("blocks"))  # a row a list
    wanted = wanted.join(F.broadcast(sizes), "list").select("list", "query_ids", "queries", F.explode("blocks").alias("block"))
    found = wanted.join(index, ["list", "block"]).mapInArrow(common.lean(scanned), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """The k nearest of each vector whose id is divisible by ``every``, against all others."""
    valid = clean(vectors)
    quantiser = train(valid)
    if quantiser is None:
        return valid.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    return search(valid.where(F.col("vec_id") % every == 0), build(valid, quantiser), quantiser, k)
