"""SentencePiece models on the tokenizers library.

``SpModel`` parses the model protobuf; ``build_tokenizer`` rebuilds it: the normaliser (its
precompiled map and white-space rules), the metaspace marker, unigram scores or the merges that
the scores of a BPE model stand for, and byte fallback.  ``Codec`` encodes batches, decodes them
and verifies parity with the sentencepiece library.

A text is cut where a run of spaces begins, and around characters that no vocabulary piece
holds beside others (line feeds, for one): no merge or unigram piece crosses such a place.  So
each distinct piece is encoded once a worker, in multithreaded batches, and compared with
sentencepiece's own ids; what differs is kept with the piece, so a text's parity is that of all
its pieces.  A text that holds the marker itself is encoded and compared whole, and so are all
texts under a model whose vocabulary crosses such places or whose normaliser changes text.  The
ids are always the tokenizers library's; parity says whether sentencepiece gives the same.

Edge cases: a null or empty text has no ids; characters outside the vocabulary become bytes;
an empty table gives an empty table; other columns are kept.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .piececache import PieceCache, per_row

MARK = "▁"
THREADS = 2  # of sentencepiece; the tokenizers library takes as many as RAYON_NUM_THREADS allows
os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
# piece types of the protobuf
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of one protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


@dataclass
class SpModel:
    pieces: list[tuple[str, float, int]]
    bpe: bool
    byte_fallback: bool
    unk_id: int
    charsmap: bytes
    dummy_prefix: bool
    trim_spaces: bool
    escape_spaces: bool

    @classmethod
    def parse(cls, data: bytes) -> SpModel:
        pieces, trainer, normal = [], {}, {}
        for field, value in _fields(data):
            if field == 1:
                own = dict(_fields(value))
                pieces.append((own[1].decode(), float(np.frombuffer(own.get(2, bytes(4)), "<f4")[0]), own.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normal = dict(_fields(value))
        return cls(pieces, trainer.get(3, 1) == 2, bool(trainer.get(35, 0)), trainer.get(40, 0), normal.get(2, b""), bool(normal.get(3, 1)), bool(normal.get(4, 1)), bool(normal.get(5, 1)))

    def merges(self) -> list[tuple[str, str]]:
        """Pairs that make a piece, in the order of that piece's score."""
        rank = {p: (-score, k) for k, (p, score, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        pairs = [(rank[p], i, p) for p in rank for i in range(1, len(p)) if p[:i] in rank and p[i:] in rank]
        return [(p[:i], p[i:]) for _, i, p in sorted(pairs)]


def build_tokenizer(model: SpModel, normalise: bool = True):
    """A tokenizers.Tokenizer for the model; without its normaliser if the caller has applied it."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    if model.bpe:
        core = models.BPE(vocab={p: k for k, (p, _, _) in enumerate(model.pieces)}, merges=model.merges(), unk_token=model.pieces[model.unk_id][0], byte_fallback=model.byte_fallback, fuse_unk=True)
    else:
        low = min(score for _, score, kind in model.pieces if kind == NORMAL) - 100
        core = models.Unigram([(p, score if kind in (NORMAL, USER) else low) for p, score, kind in model.pieces], model.unk_id, model.byte_fallback)
    out = Tokenizer(core)
    if normalise:
        steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
        if model.trim_spaces:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if model.escape_spaces:
            steps.append(normalizers.Replace(" ", MARK))
        if model.dummy_prefix:
            steps.append(normalizers.Prepend(MARK))
        out.normalizer = normalizers.Sequence(steps)
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    user = [AddedToken(p, normalized=False, special=False) for p, _, kind in model.pieces if kind == USER]
    if user:
        out.add_tokens(user)
    return out


class Codec:
    """Encodes, decodes and compares, for one worker process."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            self.model = SpModel.parse(f.read())
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.wide = np.dtype("<u2") if len(self.model.pieces) <= 1 << 16 else np.dtype("<u4")
        usual = [p for p, _, kind in self.model.pieces if kind == NORMAL]
        shared = set("".join(p for p in usual if len(p) > 1))
        self.by_piece = self.model.dummy_prefix and self.model.escape_spaces and not self.model.trim_spaces and not self.model.charsmap and not any(MARK in p.lstrip(MARK) for p in usual) and not any(kind == USER for _, _, kind in self.model.pieces)
        self.cut_lines = "\n" not in shared
        self.plain = build_tokenizer(self.model, normalise=False)
        self.cache = PieceCache(self._pieces, self.wide, limit=400_000)
        self.line_ids = len(self.library.encode("\n"))
        parts = [bytes([int(p[1:-1], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in self.model.pieces]
        self.part_sizes = np.array([len(p) for p in parts], np.int64)
        self.part_starts = np.cumsum(self.part_sizes) - self.part_sizes
        self.part_bytes = np.frombuffer(b"".join(parts), np.uint8)

    @cached_property
    def full(self):
        """For whole texts; only models that cannot be encoded by pieces need it."""
        return build_tokenizer(self.model)

    def _pieces(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        raw = data.tobytes()
        texts = [raw[b:e].decode("utf-8", "replace") for b, e in zip(begin.tolist(), end.tolist(), strict=True)]
        ours = [e.ids for e in self.plain.encode_batch_fast([t.replace(" ", MARK) for t in texts], add_special_tokens=False)]
        # the library puts a marker before each text: let it be the first space, or cut it off behind a line feed
        theirs = self.library.encode([t[1:] if t[0] == " " and len(t) > 1 else "\n" + t for t in texts], num_threads=THREADS)
        theirs = [x if t[0] == " " and len(t) > 1 else x[self.line_ids :] for t, x in zip(texts, theirs, strict=True)]
        differs = [a != b for a, b in zip(ours, theirs, strict=True)]
        return np.array([i for x in ours for i in x], self.wide), np.array([len(x) for x in ours], np.int64), np.array(differs, bool)

    def _whole(self, texts: list[str]) -> tuple[list[list[int]], list[bool]]:
        """Ids of whole texts, and whether sentencepiece gives them too."""
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        ours = [e.ids if t else [] for t, e in zip(texts, self.full.encode_batch_fast(texts, add_special_tokens=False), strict=True)]
        return ours, [a == b for a, b in zip(ours, self.library.encode(texts, num_threads=THREADS), strict=True)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of each text of a buffer, their numbers, and the text's parity."""
        full = offsets[1:] > offsets[:-1]
        odd = full.copy()
        if self.by_piece:
            odd[:] = False
            raw, mark = data.tobytes(), MARK.encode()
            at = raw.find(mark)
            while at >= 0:
                k = int(np.searchsorted(offsets, at, "right")) - 1
                odd[k] = True
                at = raw.find(mark, int(offsets[k + 1]))
        n = len(full)
        counts, parity, ids = np.zeros(n, np.int64), np.ones(n, bool), np.zeros(0, self.wide)
        if not odd.all():
            spaced, places = self.marked(data, offsets, full)
            space = spaced == 32
            cut = space.copy()
            cut[1:] &= ~space[:-1]
            if self.cut_lines:
                line = spaced == 10
                cut |= line
                cut[1:] |= line[:-1]
            cut[places[:-1][full]] = True
            begin = np.flatnonzero(cut)
            end = np.append(begin[1:], len(spaced))
            if odd.any():
                keep = ~odd[np.searchsorted(places, begin, "right") - 1]
                begin, end = begin[keep], end[keep]
            ids, sizes, differs = self.cache.lookup(spaced, begin, end)
            counts, parity = per_row(begin, places, sizes), per_row(begin, places, differs) == 0
        if odd.any():
            which = np.flatnonzero(odd).tolist()
            own, same = self._whole([data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace") for k in which])
            parts = np.split(ids, np.cumsum(counts)[:-1]) if n else []
            for k, x, ok in zip(which, own, same, strict=True):
                parts[k], counts[k], parity[k] = np.array(x, self.wide), len(x), ok
            ids = np.concatenate([*parts, ids[:0]])
        return ids, counts, parity

    @staticmethod
    def marked(data: np.ndarray, offsets: np.ndarray, full: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The buffer with a space before each text that isn't empty."""
        shift = np.zeros(len(offsets), np.int64)
        np.cumsum(full, out=shift[1:])
        return np.insert(data, offsets[:-1][full], 32), offsets + shift

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts, each still with the marker's space, and their offsets."""
        sizes = self.part_sizes[ids]
        total = np.cumsum(sizes)
        where = np.repeat(self.part_starts[ids] - (total - sizes), sizes) + np.arange(total[-1] if len(total) else 0)
        offsets = np.zeros(len(counts) + 1, np.int64)
        ends = np.append(0, total)
        offsets[1:] = ends[np.cumsum(counts)]
        return self.part_bytes[where], offsets


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


RESULT = "ids: array<int>, n_bytes: long, round_trip: boolean, parity: boolean"
DIGEST = "n_ids: long, ids_crc32: long, n_bytes: long, round_trip: boolean, parity: boolean"


def _encoded(docs: DataFrame, path: str, name: str, digest: bool, keep: list[str] | None) -> DataFrame:
    def make(texts: pa.Array) -> pa.StructArray:
        own = codec(path)
        data, offsets = common.text_buffer(texts)
        ids, counts, same, parity = [], [], [], []
        for i, j in common.pieces(offsets):
            part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            got, n, equal = own.encode(part, at)
            parity.append(equal)
            want, places = own.marked(part, at, (at[1:] > at[:-1]) & own.model.dummy_prefix)
            back, ends = own.decode(got, n)
            ok = np.diff(ends) == np.diff(places)
            if ok.all():
                wrong = np.flatnonzero(back != want)
                ok[np.searchsorted(places, wrong, "right") - 1] = False
            else:
                ok = np.array([back[ends[k] : ends[k + 1]].tobytes() == want[places[k] : places[k + 1]].tobytes() for k in range(j - i)])
            ids.append(got)
            counts.append(n)
            same.append(ok)
        flat = np.concatenate([*ids, np.zeros(0, own.wide)])
        n = np.concatenate([*counts, np.zeros(0, np.int64)])
        sizes, ok, par = pa.array(np.diff(offsets)), pa.array(np.concatenate([*same, np.zeros(0, bool)])), pa.array(np.concatenate([*parity, np.zeros(0, bool)]))
        ends = np.append(0, np.cumsum(n))
        if digest:
            raw = memoryview(flat.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            return pa.StructArray.from_arrays([pa.array(n), pa.array(crc, pa.int64()), sizes, ok, par], ["n_ids", "ids_crc32", "n_bytes", "round_trip", "parity"])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32)))
        return pa.StructArray.from_arrays([lists, sizes, ok, par], ["ids", "n_bytes", "round_trip", "parity"])

    return common.append(docs, ["text"], make, DIGEST if digest else RESULT, name, keep)


def encode(docs: DataFrame, model_path: str, name: str = "spm", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or only its columns ``keep``) with a struct column: ids, UTF-8 size, whether decoding gives the text, and parity with sentencepiece."""
    return _encoded(docs, model_path, name, digest=False, keep=keep)


def encode_digest(docs: DataFrame, model_path: str, name: str = "spm", keep: list[str] | None = None) -> DataFrame:
    """The same work; of the ids their number and crc32 (as little-endian 32-bit integers)."""
    return _encoded(docs, model_path, name, digest=True, keep=keep)


def decode(table: DataFrame, model_path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``table`` with the text of its array<int> column of ids, in a struct column."""

    def make(column: pa.Array) -> pa.StructArray:
        own = codec(model_path)
        lists = [np.array(x or [], np.int64) for x in column.to_pylist()]
        raw, ends = own.decode(np.concatenate([*lists, np.zeros(0, np.int64)]), np.array([len(x) for x in lists], np.int64))
        skip = int(own.model.dummy_prefix)
        texts = [raw[a:b].tobytes()[skip:].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array(texts, pa.string())], ["text"])

    return common.append(table, [ids], make, "text: string", name)
