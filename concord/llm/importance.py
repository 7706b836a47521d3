"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Two bag models over hashed words, word pairs and stems: the target's from labelled good documents
(quality 1, not toxic), the raw one's from all documents.  A text's log importance weight is
the mean log ratio of its n-grams.  The floor below which a document has no weight at all, and
is rejected, is calibrated on labelled documents that the target model has not seen: a logistic
curve over the weight, over how much of the text, and how strongly, the raw model prefers, and
over what words a third model, of the labelled documents that are not good, prefers to the target's.
Of the rest, ``fraction`` is drawn without replacement by Gumbel top-k; the noise is a hash of
the document, so a lost task draws the same.

Labels are used up to ``max_labels`` rows, those with the smallest hash of doc_id.  Counts,
weights and the draw's threshold cover all documents; the model's size is that of its buckets.

Edge cases: a null or empty text has weight 0, is never drawn and is rejected; without labels
of both kinds the target is the raw text, and nothing but empty texts is rejected; repeated
rows get equal keys and are drawn together at the threshold; an empty table gives an empty
result; other columns are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .hashing import Prefix, U, mix
from .packing import first_of_runs, pack, unpack

WORDS, PAIRS, STEMS = 1 << 20, 1 << 18, 1 << 16  # buckets
SIZE = WORDS + PAIRS + STEMS
STEM = 6  # bytes
SEGMENT = 1 << 15
PRIOR = 5.0
MAX_LABELS = 200_000
FRACTION = 0.1
#: share of good documents the floor may reject on the held-out labels
FALSE_REJECTS = 0.004
SEED = 20_231


def _breaks() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[:33] = 32
    table[[ord(c) for c in ".,;:"]] = 32
    return table


BREAKS = _breaks()


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words, pairs and stems (first bytes of longer words) of each text, and the text of each."""
    low = BREAKS[data]
    blank = low == 32
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    starts = ~blank
    starts[1:] &= blank[:-1] | edge[1:-1]
    ends = ~blank
    ends[:-1] &= blank[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    prefix = Prefix(low)
    words = prefix.of(starts, ends)
    doc = np.searchsorted(offsets, starts, "right") - 1
    inner = ~first_of_runs(doc)
    pairs = mix(words[:-1] * U(3) + words[1:])[inner[1:]]
    long = ends - starts >= STEM
    stems = prefix.of(starts[long], starts[long] + STEM)
    buckets = np.concatenate((words % U(WORDS), pairs % U(PAIRS) + U(WORDS), stems % U(STEMS) + U(WORDS + PAIRS))).astype(np.int64)
    return buckets, np.concatenate((doc, doc[inner], doc[long]))


def _labels(labels: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted ids, whether good, and whether held out; a document labelled twice is good only if always."""
    rows = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    good = rows.agg(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    got = common.smallest(good, "doc_id", limit).collect()
    got.sort()
    ids = np.array([r[0] for r in got], np.int64)
    return ids, np.array([bool(r[1]) for r in got], bool), mix(ids.view(U)) % U(2) == 1


def _find(ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the wanted ids, or -1."""
    if not len(ids):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
    return np.where(ids[at] == wanted, at, -1)


COUNTS = "k int, part int, blob binary"


def log_ratios(docs: DataFrame, labels: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each bucket, log of its share in the target over its share in the raw text; and of its share in the labelled rest over that in the target."""
    sent = docs.sparkSession.sparkContext.broadcast(labels)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, good, held = sent.value
        raw, target, bad = (np.zeros(SIZE, np.uint32) for _ in range(3))

        def sums() -> pa.RecordBatch:
            """The counts so far, of the buckets met."""
            keys, blobs = [], []
            for k in range(SIZE // SEGMENT):
                met = np.flatnonzero(raw[k * SEGMENT : (k + 1) * SEGMENT])
                if len(met):
                    counts = [x[k * SEGMENT + met] for x in (raw, target, bad)]
                    keys.append(k)
                    blobs.append(pack((met, 2), *((c, max(1, (int(c.max()).bit_length() + 7) // 8)) for c in counts)))
            part = TaskContext.get().partitionId()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([part] * len(keys), pa.int32()), pa.array(blobs, pa.binary())], ["k", "part", "blob"])

        most = 0
        for batch in batches:
            data, offsets = common.text_buffer(batch.column("text"))
            names = batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)
            for i, j in common.pieces(offsets):
                buckets, doc = ngrams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                at = _find(ids, names[i:j])
                np.add.at(raw, buckets, 1)
                if len(ids):
                    ours = (at >= 0) & ~held[at]
                    for counts, mine in ((target, ours & good[at]), (bad, ours & ~good[at])):
                        if mine.any():
                            np.add.at(counts, buckets[mine[doc]], 1)
                most += len(buckets)
            if most > 1 << 31:  # before a count can overflow
                yield sums()
                for counts in (raw, target, bad):
                    counts[:] = 0
                most = 0
        yield sums()

    def added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, SEGMENT), U)
        for batch in batches:
            for blob in batch.column("blob"):
                met, *counts = unpack(blob.as_py())
                met = met.astype(np.int64)
                for sums, more in zip(total, counts, strict=True):
                    sums[met] += more
        met = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([pack((met, 2), *((x[met], 8) for x in total))], pa.binary())], ["k", "part", "blob"])

    # two levels, so that no group gets a row from every task
    spread = math.isqrt(common.partitions(docs)) + 1
    rows = docs.mapInArrow(common.lean(counted), COUNTS)
    for key in (F.pmod("part", F.lit(spread)), F.lit(0)):
        rows = rows.groupBy("k", key.alias("some")).applyInArrow(added, COUNTS)
    raw, target, bad = np.zeros((3, SIZE))
    for k, _, blob in rows.collect():
        met, *counts = unpack(blob)
        at = k * SEGMENT + met.astype(np.int64)
        raw[at], target[at], bad[at] = counts

    def against_raw(own: np.ndarray) -> np.ndarray:
        share = own.sum() / max(raw.sum(), 1)
        return np.log((own + PRIOR * share) / (raw + PRIOR) / share) if share else np.zeros(SIZE)

    good_ratio = against_raw(target)
    return good_ratio, against_raw(bad) - good_ratio if bad.any() and target.any() else np.zeros(SIZE)


FEATURES = ["weight", "against", "density", "strong", "strongest", "blame", "worst"]
BLAME = 2.5  # of a word's log ratio to the labelled rest, what lies above counts


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps, and the floor of its score."""
    a = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(a.shape[1])
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(len(w))
        w = w + np.linalg.solve(h, a.T @ (weight * (y - p)) - 0.1 * w)
    score = a @ w
    return w, float(min(0.0, np.quantile(score[y > 0], FALSE_REJECTS)))


def score(docs: DataFrame, labels: DataFrame, name: str = "quality", max_labels: int = MAX_LABELS) -> DataFrame:
    """``docs`` with a struct column: log_weight, gumbel_key, kept (not rejected)."""
    known = _labels(labels, max_labels)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast([x.astype(np.float32) for x in log_ratios(common.documents(docs), known)])

    def features(ids: pa.Array, texts: pa.Array) -> pa.StructArray:
        own, rest = sent.value
        data, offsets = common.text_buffer(texts)
        out: list[np.ndarray] = [np.zeros((0, len(FEATURES)))]
        for i, j in common.pieces(offsets):
            buckets, doc = ngrams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            r, n = own[buckets].astype(float), j - i
            count = np.bincount(doc, minlength=n)
            per = np.maximum(count, 1)
            single = buckets < WORDS
            against = np.bincount(doc, np.minimum(r + 1, 0), n)
            strong = np.bincount(doc[single], np.minimum(r[single] + 2, 0), n)
            alone = (buckets < WORDS) | (buckets >= WORDS + PAIRS)
            blamed = rest[buckets[alone]].astype(float)
            blame = np.bincount(doc[alone], np.maximum(blamed - BLAME, 0), n)
            least, most = np.zeros(n), np.zeros(n)
            firsts = np.flatnonzero(first_of_runs(doc[single]))
            if len(firsts):
                least[doc[firsts]] = np.minimum.reduceat(r[single], firsts)
            np.maximum.at(most, doc[alone], blamed)
            out.append(np.column_stack((np.bincount(doc, r, n) / per, np.log1p(-against), -against / per, np.log1p(-strong), least, np.log1p(blame), most)))
            out[-1][count == 0] = np.nan
        x = np.concatenate(out)
        gone = np.isnan(x[:, 0])
        x[gone] = 0
        parts = [pa.array(x[:, k]) for k in range(len(FEATURES))]
        return pa.StructArray.from_arrays([*parts, pa.array(~gone)], [*FEATURES, "words"])

    raw = common.free_name(docs, "_features")
    plain = docs.withColumns({"text": F.col("text").cast("string")})
    scored = common.append(plain, ["doc_id", "text"], features, ", ".join(f"{f}: double" for f in FEATURES) + ", words: boolean", raw)
    ids, good, held = known
    coefficients, floor = np.zeros(len(FEATURES) + 1), -1.0
    if held.any() and 0 < good[held].sum() < held.sum():
        wanted = spark.createDataFrame([(int(i), bool(g)) for i, g in zip(ids[held].tolist(), good[held].tolist(), strict=True)], "d long, g boolean")
        few = common.append(common.documents(docs).join(F.broadcast(wanted), F.col("doc_id") == F.col("d")), ["doc_id", "text"], features, ", ".join(f"{f}: double" for f in FEATURES) + ", words: boolean", "x")
        rows = few.select("g", "x.*").where("words").drop("words").limit(max_labels).toPandas()
        if rows["g"].nunique() == 2:
            coefficients, floor = _fit(rows[FEATURES].to_numpy(), rows["g"].to_numpy().astype(float))
    logit = F.expr(" + ".join([repr(float(coefficients[-1])) + "D", *[f"{float(c)!r}D * {raw}.{f}" for c, f in zip(coefficients, FEATURES, strict=False)]]))
    uniform = (F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id"), F.col("text")), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    kept = F.col(f"{raw}.words") & (logit >= floor)
    weight = F.round(F.col(f"{raw}.weight"), 9)
    key = F.when(kept, F.round(weight - F.log(-F.log(uniform)), 9))
    result = F.struct(weight.alias("log_weight"), key.alias("gumbel_key"), kept.alias("kept"))
    return scored.select(*[F.col(f"`{c}`") for c in docs.columns], result.alias(name))


def threshold(keys: DataFrame, k: int, column: str = "key") -> float:
    """The k-th largest key: histograms of 4,096 bars, each time of the bar that holds it."""
    low, high = keys.agg(F.min(column), F.max(column)).first()
    if low is None or k <= 0:
        return math.inf
    if keys.where(f"{column} is not null").count() <= k:
        return low
    bars = 4096
    for _ in range(8):
        step = (high - low) / bars
        if step <= 1e-12:
            break
        at = F.least(F.floor((F.col(column) - low) / step), F.lit(bars - 1)).alias("bar")
        seen = 0
        for r in sorted(keys.where((F.col(column) >= low) & (F.col(column) <= high)).groupBy(at).agg(F.count("*").alias("n"), F.min(column).alias("a"), F.max(column).alias("b")).collect(), key=lambda r: -r["bar"]):
            if seen + r["n"] >= k:
                low, high, k = r["a"], r["b"], k - seen
                break
            seen += r["n"]
        if low == high:
            break
    return low


def draw(scored: DataFrame, fraction: float = FRACTION, name: str = "quality") -> DataFrame:
    """doc_id, log_weight, gumbel_key, sampled (among the Gumbel top-k, k a fraction of all rows), kept."""
    table = common.cut(scored.select(F.col("doc_id").cast("long").alias("doc_id"), f"{name}.*"), "drawn")
    limit = threshold(table.select(F.col("gumbel_key").alias("key")), round(fraction * table.count()))
    return table.select("doc_id", "log_weight", "gumbel_key", F.coalesce(F.col("gumbel_key") >= limit, F.lit(False)).alias("sampled"), "kept")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, with their columns."""
    name = common.free_name(docs, "quality")
    return score(docs, labels, name).where(f"{name}.kept").select(docs.columns)

