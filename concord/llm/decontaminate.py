"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams.

``mark`` lower-cases A-Z, takes words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` (letters, digits and
everything beyond ASCII) and looks up each window of 13 training words in the set of the
benchmark's windows; an item of fewer words is one window.  Words become integers by the
benchmark's vocabulary, so that only runs of known words are looked at, and the set's keys are
the windows themselves: a hit is verified, not assumed.

The set is broadcast if what it takes in a worker, some ``SET_BYTES`` a window, is within
``max_broadcast_bytes``.  Beyond, the corpus is still read once: a bit filter of the windows'
hashes, at most ``FILTER_BITS`` bits however large the benchmark, is broadcast in place of the
set; the windows that pass it are joined with the benchmark's by hash and by their words.

Edge cases: a null or empty text has no words and no hits; benchmark rows with a null item_id
or text are left out; repeated items count once; an empty table gives an empty result, an
empty benchmark no hits; other columns are kept as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .hashing import Prefix, U

WINDOW = 13
MAX_BROADCAST = 64 << 20
SET_BYTES = 250  # of a window in a worker's set
FILTER_BITS = 1 << 29
SEGMENT = 1 << 19  # bits that one group makes
#: Of every 20 words, so many must be hit.
HIT_SHARE = (1, 20)


def _separators() -> bytes:
    keep = {*range(48, 58), *range(97, 123), *range(128, 256)}
    return bytes(c + 32 if 65 <= c <= 90 else c if c in keep else 32 for c in range(256))


WORD_BYTES = _separators()


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class WindowSet:
    """The windows of benchmark items, by length."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.by_length: dict[int, dict[bytes, tuple[int, ...]]] = {}
        for item, text in sorted(items):
            own = words(text.encode())
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in own], np.int32)
            size = min(window, len(own))
            if size:
                found = self.by_length.setdefault(size, {})
                for i in range(len(own) - size + 1):
                    key = ids[i : i + size].tobytes()
                    if item not in found.get(key, ()):
                        found[key] = (*found.get(key, ()), item)

    def scan(self, own: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """The positions of hit words, and the items with windows that occur."""
        n = len(own)
        ids = np.fromiter(map(self.vocabulary.get, own, repeat(0)), np.int32, n)
        unknown = np.zeros(n + 1, np.int32)
        np.cumsum(ids == 0, out=unknown[1:])
        cover, items = np.zeros(n + 1, np.int32), set()
        for size, found in self.by_length.items():
            if size <= n:
                for p in np.flatnonzero(unknown[size:] == unknown[:-size]).tolist():
                    got = found.get(ids[p : p + size].tobytes())
                    if got:
                        items.update(got)
                        cover[p] += 1
                        cover[p + size] -= 1
        return np.flatnonzero(np.cumsum(cover[:-1]) > 0), sorted(items)


RESULT = "n_words: long, hit: array<int>, items: array<long>"


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_broadcast_bytes: int = MAX_BROADCAST, name: str = "decon") -> DataFrame:
    """``docs`` with a struct column: n_words, the positions of hit words, and the items found."""
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text")).dropna()
    n = F.size(F.regexp_extract_all("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0)))
    windows = items.select(F.when(n > 0, F.greatest(n - window + 1, F.lit(1)).cast("long")).alias("n")).agg(F.sum("n")).first()[0] or 0
    return _by_set(docs, items, window, name) if windows * SET_BYTES <= max_broadcast_bytes else _by_join(docs, items, windows, window, name)


def _by_set(docs: DataFrame, items: DataFrame, window: int, name: str) -> DataFrame:
    """Every text against the whole set, in each worker."""
    sent = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in items.collect()])  # its size was looked at
    held: list[WindowSet] = []

    def make(texts: pa.Array) -> pa.StructArray:
        if not held:
            held.append(WindowSet(sent.value, window))
        counts, hits, found = [], [], []
        for t in texts:
            own = words((t.as_py() or "").encode())
            hit, ids = held[0].scan(own)
            counts.append(len(own))
            hits.append(hit)
            found.append(ids)
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.int64()))], ["n_words", "hit", "items"])

    return common.append(docs, ["text"], make, RESULT, name)


def _windows(text: str | None, sizes: list[int]) -> tuple[int, bytes, np.ndarray, np.ndarray, list[np.ndarray]]:
    """A text's number of words, its words written with single blanks, where each begins and ends, and the hashes of its windows of each size."""
    own = words((text or "").encode())
    flat = b" ".join(own)
    lengths = np.fromiter(map(len, own), np.int64, len(own))
    end = np.cumsum(lengths + 1) - 1
    begin = end - lengths
    prefix = Prefix(np.frombuffer(flat, np.uint8))
    hashes = [prefix.of(begin[: len(own) - n + 1], end[n - 1 :]) if len(own) >= n else np.zeros(0, U) for n in sizes]
    return len(own), flat, begin, end, hashes


def _by_join(docs: DataFrame, items: DataFrame, windows: int, window: int, name: str) -> DataFrame:
    spark = docs.sparkSession
    bits = min(FILTER_BITS, 1 << max(19, (16 * windows).bit_length()))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                n = min(window, len(words(text.encode())))
                if n:
                    _, flat, begin, end, (hashes,) = _windows(text, [n])
                    rows += [(h, n, flat[b:e], item) for h, b, e in zip(hashes.view(np.int64).tolist(), begin.tolist(), end[n - 1 :].tolist(), strict=False)]
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.int64()), strict=True)], ["h", "n", "key", "item"])

    def filtered(table: pa.Table) -> pa.Table:
        at = table.column("h").to_numpy().view(U) % U(bits)
        part = np.zeros(SEGMENT, bool)
        part[(at % U(SEGMENT)).astype(np.int64)] = True
        return pa.table({"k": pa.array([int(at[0]) // SEGMENT], pa.int32()), "blob": pa.array([np.packbits(part, bitorder="little").tobytes()], pa.binary())})

    known = common.cut(items.mapInArrow(common.lean(listed), "h long, n int, key binary, item long").distinct(), "windows")
    sizes = sorted(r[0] for r in known.select("n").distinct().collect())  # window or less: at most so many
    part = F.floor(F.pmod("h", F.lit(bits)) / SEGMENT).cast("int")  # bits is a power of two: the sign does not matter
    segments = known.select("h").distinct().groupBy(part.alias("part")).applyInArrow(filtered, "k int, blob binary").collect()
    table = np.zeros(bits // 8, np.uint8)
    for k, blob in segments:
        table[k * SEGMENT // 8 : (k + 1) * SEGMENT // 8] = np.frombuffer(blob, np.uint8)
    sent = spark.sparkContext.broadcast(table)  # at most FILTER_BITS bits

    row = common.free_name(docs, "_row")
    numbered = common.cut(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = sent.value
        for batch in batches:
            rows = []
            for r, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, flat, begin, end, hashes = _windows(text, sizes)
                for n, h in zip(sizes, hashes, strict=True):
                    at = (h % U(bits)).astype(np.int64)
                    for p in np.flatnonzero(have[at >> 3] >> (at & 7).astype(np.uint8) & 1).tolist():
                        rows.append((r, p, n, int(h[p].view(np.int64)), flat[begin[p] : end[p + n - 1]]))
            columns = list(zip(*rows, strict=True)) or [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["r", "p", "n", "h", "key"])

    open_ = numbered.select(row, F.col("text").cast("string").alias("text")).mapInArrow(common.lean(passing), "r long, p int, n int, h long, key binary")
    met = open_.join(known, ["h", "n", "key"]).groupBy("r", "p", "n").agg(F.collect_set("item").alias("items"))
    found = met.groupBy("r").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.expr("sequence(p, p + n - 1)"))))).alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def counted(texts: pa.Array) -> pa.StructArray:
        return pa.StructArray.from_arrays([pa.array([len(words((t.as_py() or "").encode())) for t in texts], pa.int64())], ["n"])

    size, key = common.free_name(numbered, "_n"), common.free_name(numbered, "_r")
    whole = common.append(numbered, ["text"], counted, "n: long", size)
    joined = whole.join(found.select(F.col("r").alias(key), F.col("hit").alias(f"{key}_hit"), F.col("items").alias(f"{key}_items")), F.col(row) == F.col(key), "left")
    result = F.struct(F.col(f"{size}.n").alias("n_words"), F.coalesce(f"{key}_hit", F.array().cast("array<int>")).alias("hit"), F.coalesce(f"{key}_items", F.array().cast("array<long>")).alias("items"))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], result.alias(name))


def contaminated(result: str) -> F.Column:
    n_hit = F.size(f"{result}.hit")
    return (n_hit > 0) & (HIT_SHARE[1] * n_hit >= HIT_SHARE[0] * F.col(f"{result}.n_words"))


def digest(marked: DataFrame, name: str = "decon") -> DataFrame:
    """The columns of the contract."""
    ids = F.array_join(F.array_sort(F.transform(f"{name}.items", lambda x: x.cast("string"))), ",")
    return marked.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(f"{name}.n_words").alias("n_words"),
        F.size(f"{name}.hit").cast("long").alias("n_hit"),
        F.size(f"{name}.items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        contaminated(name).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with their columns."""
    name = common.free_name(docs, "decon")
    return mark(docs, benchmark, window, name=name).where(~contaminated(name)).select(docs.columns)


def cut_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """All documents; from the texts the spans of hit words are removed, with what stands between two of them."""
    import re

    name, word = common.free_name(docs, "decon"), re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

    def make(texts: pa.Array, results: pa.Array) -> pa.StructArray:
        out = []
        for t, r in zip(texts.to_pylist(), results.to_pylist(), strict=True):
            if r["hit"]:
                at = [m.span() for m in word.finditer(t)]
                kept, last, before = [], 0, None
                for k in r["hit"]:
                    if before is None or k != before + 1:
                        kept.append(t[last : at[k][0]])
                    last, before = at[k][1], k
                t = "".join([*kept, t[last:]])
            out.append(t)
        return pa.StructArray.from_arrays([pa.array(out, pa.string())], ["text"])

    marked = mark(docs, benchmark, window, name=name)
    cleaned = common.free_name(marked, "cleaned")
    done = common.append(marked, ["text", name], make, "text: string", cleaned)
    return done.select(*[F.col(f"{cleaned}.text").alias("text") if c == "text" else F.col(c) for c in docs.columns])
