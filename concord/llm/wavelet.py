"""Token-id output as wavelet matrices: one compressed, self-contained file per shard.

``encode_corpus`` puts documents in ascending doc_id order (ties by text), encodes whole texts,
ends each document with id 0, and writes a dataset with one shard a row; each shard is a
complete file image (``WaveletShard.to_bytes``) that can be stored alone.  Parquet is only the
envelope, so that Spark's committer makes the output atomic on any store and a lost executor's
shard is rewritten whole.  ``read_corpus`` decodes the images.

Edge cases: a null text is the empty text (one id, the end id); equal doc_ids stand side by
side, ordered by text; a null doc_id sorts first; an empty table gives an empty dataset; a text
longer than a shard makes one longer shard.  Other columns of the input are not read.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .piececache import PieceCache, per_row

MAGIC = b"WMX1"
BLOCK = 1 << 15  # bytes of a bit plane that are compressed together
SHARD_TOKENS = 1 << 21
END_ID = 0


class WaveletShard:
    """Bit planes, most significant bit first; after each plane zeros go left, ones right, in order.

    A plane is stored in blocks of BLOCK bytes, each compressed alone, with the ones before each
    block.  ``access``, ``rank``, ``count`` and ``select`` decompress only the blocks they touch.
    """

    def __init__(self, doc_ids: np.ndarray, lengths: np.ndarray, n: int, zeros: list[int], planes: list[tuple[np.ndarray, list[bytes]]]):
        self.doc_ids, self.lengths, self.n, self.zeros, self.planes = doc_ids, lengths, n, zeros, planes
        self._open: dict[tuple[int, int], np.ndarray] = {}

    @classmethod
    def build(cls, ids: np.ndarray, doc_ids: Iterable[int], lengths: Iterable[int]) -> WaveletShard:
        bits = max(1, int(ids.max(initial=0)).bit_length())
        packer = zstandard.ZstdCompressor(level=1)
        zeros, planes, row = [], [], ids
        for level in range(bits):
            ones = (row >> np.array(bits - 1 - level, row.dtype)) & np.array(1, row.dtype) != 0
            packed = np.packbits(ones, bitorder="little")
            cuts = range(0, len(packed), BLOCK)
            counts = np.zeros(len(cuts) + 1, np.int64)
            counts[1:] = np.cumsum([int(np.bitwise_count(packed[c : c + BLOCK]).sum()) for c in cuts])
            planes.append((counts, [packer.compress(packed[c : c + BLOCK].tobytes()) for c in cuts]))
            left = row[~ones]
            zeros.append(len(left))
            row = np.concatenate((left, row[ones]))
        return cls(np.fromiter(doc_ids, np.int64), np.fromiter(lengths, np.int64), len(ids), zeros, planes)

    def to_bytes(self) -> bytes:
        docs = zlib.compress(np.diff(self.doc_ids, prepend=np.int64(0)).astype("<i8").tobytes() + self.lengths.astype("<i8").tobytes(), 1)
        out = [MAGIC, struct.pack("<QQHQ", self.n, len(self.doc_ids), len(self.planes), len(docs)), docs]
        for zeros, (counts, blocks) in zip(self.zeros, self.planes, strict=True):
            out.append(struct.pack("<QQ", zeros, len(blocks)))
            out.append(counts.astype("<i8").tobytes())
            out.append(np.array([len(b) for b in blocks], "<u4").tobytes())
            out += blocks
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletShard:
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet shard")
        n, docs, bits, size = struct.unpack_from("<QQHQ", data, 4)
        at = 4 + struct.calcsize("<QQHQ")
        table = np.frombuffer(zlib.decompress(data[at : at + size]), "<i8")
        at += size
        zeros, planes = [], []
        for _ in range(bits):
            z, k = struct.unpack_from("<QQ", data, at)
            counts = np.frombuffer(data, "<i8", k + 1, at + 16)
            sizes = np.frombuffer(data, "<u4", k, at + 16 + 8 * (k + 1))
            at += 16 + 8 * (k + 1) + 4 * k
            blocks = []
            for s in sizes.tolist():
                blocks.append(data[at : at + s])
                at += s
            zeros.append(z)
            planes.append((counts, blocks))
        return cls(np.cumsum(table[:docs]), table[docs:], n, zeros, planes)

    def _block(self, level: int, k: int) -> np.ndarray:
        if (level, k) not in self._open:
            self._open[level, k] = np.frombuffer(zstandard.decompress(self.planes[level][1][k], BLOCK), np.uint8)
        return self._open[level, k]

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        k, rest = divmod(i, BLOCK * 8)
        ones = int(self.planes[level][0][k])
        if rest:
            block = self._block(level, k)
            whole, odd = divmod(rest, 8)
            ones += int(np.bitwise_count(block[:whole]).sum())
            if odd:
                ones += (int(block[whole]) & ((1 << odd) - 1)).bit_count()
        return ones

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, zeros in enumerate(self.zeros):
            ones = self._ones(level, i)
            bit = self._ones(level, i + 1) - ones
            value = value << 1 | bit
            i = zeros + ones if bit else i - ones
        return value

    def _narrow(self, symbol: int, left: int, right: int) -> tuple[int, int]:
        if symbol >> len(self.planes):
            return 0, 0
        for level, zeros in enumerate(self.zeros):
            a, b = self._ones(level, left), self._ones(level, right)
            left, right = (zeros + a, zeros + b) if symbol >> (len(self.zeros) - 1 - level) & 1 else (left - a, right - b)
        return left, right

    def count(self, symbol: int, left: int = 0, right: int | None = None) -> int:
        """How often the id stands in [left, right)."""
        a, b = self._narrow(symbol, left, self.n if right is None else right)
        return b - a

    def rank(self, symbol: int, i: int) -> int:
        """How often the id stands before position i."""
        return self.count(symbol, 0, i)

    def select(self, symbol: int, j: int) -> int:
        """The position of the j-th occurrence (from 0) of the id."""
        a, b = self._narrow(symbol, 0, self.n)
        if not 0 <= j < b - a:
            raise IndexError(j)
        i = a + j
        for level in range(len(self.zeros) - 1, -1, -1):
            one = symbol >> (len(self.zeros) - 1 - level) & 1
            want = i - self.zeros[level] if one else i
            low, high = 0, self.n  # the smallest prefix that holds want + 1 such bits
            while low < high:
                mid = (low + high) // 2
                have = self._ones(level, mid)
                if (have if one else mid - have) > want:
                    high = mid
                else:
                    low = mid + 1
            i = low - 1
        return i

    def decode(self) -> np.ndarray:
        """All ids, from the last plane up: each step undoes one stable split."""
        wide = np.uint16 if len(self.planes) <= 16 else np.uint32
        row = np.zeros(self.n, wide)
        for level in range(len(self.planes) - 1, -1, -1):
            packed = np.frombuffer(b"".join(zstandard.decompress(b, BLOCK) for b in self.planes[level][1]), np.uint8)
            ones = np.unpackbits(packed, count=self.n, bitorder="little").view(bool)
            up = np.empty(self.n, wide)
            up[~ones] = row[: self.zeros[level]]
            up[ones] = row[self.zeros[level] :] | wide(1 << (len(self.planes) - 1 - level))
            row = up
        return row


SPACE, LINE, LETTER, DIGIT, MARK, OTHER = range(6)
APOSTROPHE = ord("'")


def _kinds() -> np.ndarray:
    kind = np.full(256, OTHER, np.uint8)
    kind[33:127] = MARK
    kind[48:58] = DIGIT
    kind[65:91] = kind[97:123] = LETTER
    kind[0xC3:0xCA] = LETTER  # leads of U+00C0 to U+027F, all letters but two
    kind[32], kind[10] = SPACE, LINE
    return kind


KINDS = _kinds()


def _byte_letters() -> np.ndarray:
    """The letters by which byte-level vocabularies spell bytes: printable Latin-1 as itself, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = np.zeros(256, "<u4")
    letters[shown] = shown
    hidden = sorted(set(range(256)) - set(shown))
    letters[hidden] = 256 + np.arange(len(hidden))
    return letters


BYTE_LETTERS = _byte_letters()


class BatchEncoder:
    """Whole texts to ids with the tokenizers library, each distinct piece encoded once.

    The split pattern of a byte-level tokenizer begins a new pre-token at a single space or line
    feed between other characters, after a line feed, and where letters, digits and marks meet,
    but for an apostrophe before letters; it looks at nothing before that place, and no merge
    crosses it.  So a text's ids are those of the pieces cut there.  A text with other white
    space or with letters beyond U+027F, one that holds an added token's content, and any
    tokenizer of another kind, is encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.wide = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        kind = json.loads(self.tokenizer.to_str())
        self.added = [t["content"].encode() for t in kind.get("added_tokens") or [] if t["content"]]
        pre = kind.get("pre_tokenizer") or {}
        self.by_piece = kind.get("normalizer") is None and kind["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
        self.cache = PieceCache(self._pieces, self.wide)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        return [np.array(e.ids, self.wide) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A piece is one pre-token, so the library's model takes it; one with an apostrophe may be several."""
        letters = BYTE_LETTERS[data].tobytes().decode("utf-32-le")
        tokenize, ids, sizes = self.tokenizer.model.tokenize, [], []
        for b, e in zip(begin.tolist(), end.tolist(), strict=True):
            piece = letters[b:e]
            if "'" in piece:
                got = self.tokenizer.encode(data[b:e].tobytes().decode(), add_special_tokens=False).ids
            else:
                got = [t.id for t in tokenize(piece)]
            ids += got
            sizes.append(len(got))
        return np.array(ids, self.wide), np.array(sizes, np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each text of a buffer, each followed by END_ID, and their numbers."""
        n = len(offsets) - 1
        kind = KINDS[data]
        lead = (data[:-1] >= 0xC3) & (data[:-1] < 0xCA) & (data[1:] >= 0x80) & (data[1:] < 0xC0)
        lead &= ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
        kind[1:][lead] = LETTER
        blank = kind <= LINE
        bad = kind == OTHER
        bad[1:] |= blank[1:] & blank[:-1]
        full = offsets[1:] > offsets[:-1]
        bad[offsets[:-1][full]] |= blank[offsets[:-1][full]]
        bad[offsets[1:][full] - 1] |= blank[offsets[1:][full] - 1]
        row = np.repeat(np.arange(n), np.diff(offsets))
        odd = np.zeros(n, bool)
        odd[row[bad]] = True
        raw = data.tobytes()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                odd[row[at]] = True
                at = raw.find(token, int(offsets[row[at] + 1]))
        if not self.by_piece:
            odd = full.copy()
        cut = blank.copy()
        cut[1:] |= kind[:-1] == LINE
        cut[1:] |= (kind[1:] != kind[:-1]) & ~blank[1:] & ~blank[:-1] & (data[:-1] != APOSTROPHE)
        cut[offsets[:-1][full]] = True
        begin = np.flatnonzero(cut)
        end = np.append(begin[1:], len(data))
        if odd.any():
            keep = ~odd[row[begin]]
            begin, end = begin[keep], end[keep]
        ids, sizes, _ = self.cache.lookup(data, begin, end)
        counts = per_row(begin, offsets, sizes)
        texts = [data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace") for k in np.flatnonzero(odd).tolist()]
        special = dict(zip(np.flatnonzero(odd).tolist(), self.whole(texts), strict=True))
        plain = np.cumsum(counts) - counts
        for k, x in special.items():
            counts[k] = len(x)
        counts += 1
        at = np.cumsum(counts) - counts
        out = np.full(int(counts.sum()), END_ID, self.wide)
        usual = np.where(odd, 0, counts - 1)
        out[np.repeat(at - plain, usual) + np.arange(len(ids))] = ids
        for k, x in special.items():
            out[at[k] : at[k] + len(x)] = x
        return out, counts


_ENCODERS: dict[str, BatchEncoder] = {}


def encoder(path: str) -> BatchEncoder:
    """One encoder a worker process, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = BatchEncoder(path)
    return _ENCODERS[path]


SHARDS = "part int, shard int, n_docs long, n_tokens long, local_start long, image binary"


def encode_corpus(docs: DataFrame, tokenizer_path: str, out: str | None = None, shard_tokens: int = SHARD_TOKENS) -> str:
    """Write the shards of ``docs(doc_id, text)`` under ``out`` (default: the shared folder); returns the path."""
    spark = docs.sparkSession
    out = out or f"{common.shared_dir(spark)}/wavelet-{uuid.uuid4().hex}"

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        ids: list[int] = []
        sizes: list[int] = []
        count = shard = start = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, ids, sizes, count, shard, start
            image = WaveletShard.build(np.concatenate(held), ids, sizes).to_bytes()
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([count], pa.int64()), pa.array([start], pa.int64()), pa.array([image], pa.binary())], ["part", "shard", "n_docs", "n_tokens", "local_start", "image"])
            start, shard, held, ids, sizes, count = start + count, shard + 1, [], [], [], 0
            return row

        for batch in batches:
            data, offsets = common.text_buffer(batch.column("text"))
            keys = batch.column("doc_id").fill_null(NULL_ID).to_pylist()
            for i, j in common.pieces(offsets, 4 << 20):
                got, counts = enc.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                held.append(got)
                ids += keys[i:j]
                sizes += counts.tolist()
                count += len(got)
                if count >= shard_tokens:
                    yield flush()
        if ids:
            yield flush()

    docs = common.documents(docs)
    ordered = docs.repartitionByRange(common.partitions(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(common.lean(shards), SHARDS).write.option("parquet.block.size", 8 << 20).option("compression", "uncompressed").parquet(out)
    return out


NULL_ID = -(1 << 63)  # stands for a null doc_id inside a shard


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One row a document: doc_id, start, n_tokens, ids_crc32, decoded from the shards."""
    shards = spark.read.schema(SHARDS).parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))  # a row a partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("part_start"))
    placed = shards.join(F.broadcast(parts), "part").select((F.col("part_start") + F.col("local_start")).alias("start"), "image")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                shard = WaveletShard.from_bytes(batch.column("image")[k].as_py())
                flat = shard.decode().astype("<u4").tobytes()
                ends = np.cumsum(shard.lengths)
                starts = ends - shard.lengths
                view = memoryview(flat)
                crcs = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                keys = pa.array(shard.doc_ids, mask=shard.doc_ids == NULL_ID)
                yield pa.RecordBatch.from_arrays([keys, pa.array(starts + batch.column("start")[k].as_py()), pa.array(shard.lengths), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(common.lean(rows), "doc_id long, start long, n_tokens long, ids_crc32 long")
