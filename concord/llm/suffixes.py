"""Exact removal of repeated substrings by a distributed merge sort of suffixes.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller doc_id.

1. Anchors.  Each 50-byte window owns the position of its least 24-gram hash (the rightmost of
   equals), so equal windows own equal places.  Windows with one anchor stand in a row; that
   row's text is its block.  Only hashes of anchor and block are exchanged, by anchor: a block
   that stands in a smaller document is repeated whole, an anchor met once is unique, and only
   anchors with differing blocks go on.
2. Suffixes that begin at those anchors are sorted in each task, cut into ranges of the
   alphabet, front-coded (common prefix length and tail) and exchanged.
3. A loser tree merges the runs of a range.  It keeps the common prefix of each run's head with
   the last winner: heads with different prefixes are ordered by these alone, heads with equal
   ones are compared beyond them.  What comes out is the suffix order with its LCP array.  From
   that array and the bytes left of the anchors, each window's smallest document follows.

Anchor and block hashes are compared as 48 and 56 bits within a hash bucket; bytes to the
right of an anchor are compared exactly, those to the left by a 64-bit hash within equal
suffixes.  Everything that is exchanged is packed: a row is one blob of one task.

Edge cases: a null text is empty; texts under 50 bytes keep all; rows with one doc_id never
remove from one another; a row with a null doc_id takes no part and keeps its text; an empty
table gives an empty result; equal rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .hashing import Prefix, U, mix
from .packing import first_of_runs, pack, stacked

LENGTH = 50
GRAM = 24
SPLITTER_TEXTS = 512  # texts that the range limits of the exchange are taken from; balance only
FLUSH = 3_000_000


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Rows of windows with one anchor: first and last window, anchor, document, hashes of anchor and block."""
    span = length - gram + 1
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.astype(U), none.astype(U)
    prefix = Prefix(data)
    least = prefix.all_of(gram)
    shift = np.zeros(len(least), np.uint8)
    step = 1
    while step < span:  # least of a doubling number of grams, then of the rest
        by = min(step, span - step)
        a, b = least[:-by], least[by:]
        later = b <= a
        shift = np.where(later, shift[by:] + np.uint8(by), shift[:-by])
        least = np.minimum(a, b)
        step += by
    n = len(least)
    owner = np.arange(n) + shift
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    inside = np.arange(n) + length <= offsets[1:][doc]
    begin = np.flatnonzero(first_of_runs(owner, doc, inside))
    last = np.append(begin[1:], n) - 1
    keep = inside[begin]
    begin, last = begin[keep], last[keep]
    block = mix(prefix.of(begin, last + length) + (owner[begin] - begin).astype(U))
    return begin, last, owner[begin], doc[begin], least[begin], block


def _keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return Prefix(data).of(offsets[:-1], offsets[1:])


def _home(doc_id: np.ndarray, text: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(doc_id.astype(np.int64).view(U) ^ mix(text)) % U(buckets)).astype(np.int64)


class _Outbox:
    """Anchors of a task until they are sent, without what the task can settle itself."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.docs: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_docs = self.size = 0

    def add(self, doc_ids: np.ndarray, texts: np.ndarray, doc: np.ndarray, place: np.ndarray, anchor: np.ndarray, block: np.ndarray) -> None:
        self.parts.append((doc + self.n_docs, place, anchor, block))
        self.docs.append((doc_ids, texts))
        self.n_docs += len(doc_ids)
        self.size += len(doc)

    def blobs(self, buckets: int) -> Iterator[tuple[int, bytes]]:
        doc, place, anchor, block = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        ids, texts = (np.concatenate(c) for c in zip(*self.docs, strict=True))
        own = ids[doc]
        order = np.lexsort((own, block, anchor))
        new = first_of_runs(anchor[order], block[order])
        smallest = own[order][new][np.cumsum(new) - 1]
        settled = np.zeros(len(doc), bool)
        settled[order] = own[order] > smallest
        home = (anchor % U(buckets)).astype(np.int64)
        for part in np.split(np.argsort(home, kind="stable"), np.cumsum(np.bincount(home, minlength=buckets))[:-1]):
            if len(part):
                part = part[np.argsort(doc[part], kind="stable")]
                used, at = np.unique(doc[part], return_inverse=True)
                open_, done = ~settled[part], settled[part]
                yield int(home[part[0]]), pack(
                    (ids[used].view(U), 8), (texts[used], 8),
                    (at[open_], 4), (place[part][open_], 4), (anchor[part][open_] >> U(16), 6), (block[part][open_] >> U(8), 7),
                    (at[done], 4), (place[part][done], 4),
                )
        self.__init__()


def _settle(buckets: int):
    """Of the anchors of one bucket: which blocks are repeated (kind 1), and which windows must be compared (kind 2)."""

    def run(table: pa.Table) -> pa.Table:
        ids, texts, at, place, anchor, block, done, done_place = stacked(table.column("blob").to_pylist())
        base = np.cumsum([0, *map(len, ids)])
        at, done = (np.concatenate([x.astype(np.int64) + b for x, b in zip(c, base, strict=False)]) for c in (at, done))
        ids, texts, place, anchor, block, done_place = map(np.concatenate, (ids, texts, place, anchor, block, done_place))
        ids = ids.view(np.int64)
        own = ids[at]
        order = np.lexsort((own, block, anchor))
        anchor, block, own = anchor[order], block[order], own[order]
        new_anchor, new_block = first_of_runs(anchor), first_of_runs(anchor, block)
        if len(order):
            group = np.cumsum(new_anchor) - 1
            repeated = own > own[new_block][np.cumsum(new_block) - 1]
            several = np.bincount(group[new_block])[group] > 1
            kind = np.where(repeated, 1, np.where(several, 2, 0))
        else:
            kind = np.zeros(0, np.int64)
        sent = kind > 0
        doc = np.concatenate((at[order][sent], done))
        where = np.concatenate((place[order][sent], done_place))
        what = np.concatenate((kind[sent], np.ones(len(done), np.int64)))
        return _replies(ids, texts, doc, buckets, (where, 4), (what, 1))

    return run


def _replies(ids: np.ndarray, texts: np.ndarray, doc: np.ndarray, buckets: int, *columns: tuple[np.ndarray, int]) -> pa.Table:
    """Blobs of (doc_id, text hash, columns) for the buckets of documents."""
    home = _home(ids[doc], texts[doc], buckets)
    order = np.argsort(home, kind="stable")
    keys, blobs = [], []
    for part in np.split(order, np.cumsum(np.bincount(home, minlength=buckets))[:-1]):
        if len(part):
            used, at = np.unique(doc[part], return_inverse=True)
            keys.append(int(home[part[0]]))
            blobs.append(pack((ids[used].view(U), 8), (texts[used], 8), (at, 4), *[(c[part], w) for c, w in columns]))
    return pa.table({"k": pa.array(keys, pa.int32()), "blob": pa.array(blobs, pa.binary())})


class _Mail:
    """Replies by document."""

    def __init__(self, table: pa.Table):
        blobs = table.column("blob").to_pylist()
        self.ids = self.columns = None
        if blobs:
            ids, texts, at, *rest = stacked(blobs)
            base = np.cumsum([0, *map(len, ids)])
            doc = np.concatenate([x.astype(np.int64) + b for x, b in zip(at, base, strict=False)])
            ids, texts = np.concatenate(ids)[doc], np.concatenate(texts)[doc]
            order = np.lexsort((texts, ids))
            ids, texts = ids[order], texts[order]
            self.columns = [np.concatenate(c)[order].astype(np.int64) for c in rest]
            starts = np.flatnonzero(first_of_runs(ids, texts))
            ends = np.append(starts[1:], len(ids))
            self.at = dict(zip(zip(ids[starts].tolist(), texts[starts].tolist(), strict=True), zip(starts.tolist(), ends.tolist(), strict=True), strict=True))

    def of(self, doc_id: int, text: int) -> list[np.ndarray] | None:
        span = self.at.get((doc_id & (1 << 64) - 1, text)) if self.columns else None
        return [c[span[0] : span[1]] for c in self.columns] if span else None


def front_code(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Of sorted strings: common prefix with the one before, length, and all tails."""
    common_, sizes, tails, last = [], [], [], b""
    for s in strings:
        k = shared(last, s, 0)
        common_.append(k)
        sizes.append(len(s))
        tails.append(s[k:])
        last = s
    return np.array(common_, np.int64), np.array(sizes, np.int64), b"".join(tails)


def shared(a: bytes, b: bytes, known: int) -> int:
    """The common prefix of two strings of which ``known`` bytes are equal."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n]) ^ int.from_bytes(b[known:n])
    return n - (x.bit_length() + 7) // 8


class Run:
    """A front-coded sorted run, read from its start."""

    def __init__(self, common_: np.ndarray, sizes: np.ndarray, tails: bytes):
        self.common, self.sizes, self.tails = common_.tolist(), sizes.tolist(), tails
        self.k, self.at, self.head = -1, 0, b""

    def next(self) -> int:
        """Step on; the common prefix with the string before, or -1 at the end."""
        self.k += 1
        if self.k == len(self.common):
            return -1
        c = self.common[self.k]
        more = self.sizes[self.k] - c
        self.head = self.head[:c] + self.tails[self.at : self.at + more]
        self.at += more
        return c


def merge(runs: list[Run]) -> Iterator[tuple[int, int, int, bytes]]:
    """A loser tree: (run, place in the run, common prefix with the string before, string), in order.

    ``lcp[r]`` is the common prefix of run r's head with the last winner on its path; the head
    with the longer one is smaller, and only equal ones are compared, from there on.
    """
    n = len(runs)
    size = 1 << max(0, (n - 1).bit_length())
    lcp = [0] * n
    alive = [r.next() >= 0 for r in runs]
    heads = [r.head for r in runs]
    alive += [False] * (size - n)
    lcp += [0] * (size - n)
    heads += [b""] * (size - n)
    tree = [-1] * size  # losers

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's common prefix is then with the winner."""
        if not alive[b]:
            return a, b
        if not alive[a]:
            return b, a
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        x, y, k = heads[a], heads[b], lcp[a]
        k = shared(x, y, k)
        if k == len(x) or k < len(y) and x[k] < y[k]:
            lcp[b] = k
            return a, b
        lcp[a] = k
        return b, a

    def build(node: int) -> int:
        if node >= size:
            return node - size
        winner, tree[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if size > 1 else 0
    while alive[winner]:
        run = runs[winner]
        yield winner, run.k, lcp[winner], heads[winner]
        c = run.next()
        alive[winner] = c >= 0
        lcp[winner], heads[winner] = c, run.head
        node = (winner + size) // 2
        while node:
            winner, tree[node] = play(winner, tree[node])
            node //= 2


def _merge_range(buckets: int, length: int):
    """Of one range: the windows that stand in a smaller document, as a bit for each offset from the anchor."""

    def run(table: pa.Table) -> pa.Table:
        columns = stacked(table.column("blob").to_pylist())
        ids, texts, at, anchor, low, high, common_, sizes, tails, left = columns
        runs = [Run(c.astype(np.int64), s.astype(np.int64), t.astype(np.uint8).tobytes()) for c, s, t in zip(common_, sizes, tails, strict=True)]
        first = np.cumsum([0, *map(len, common_)])
        base = np.cumsum([0, *map(len, ids)])
        doc = np.concatenate([x.astype(np.int64) + b for x, b in zip(at, base, strict=False)])
        ids, texts, anchor, low, high = map(np.concatenate, (ids, texts, anchor, low, high))
        ids, low, high = ids.view(np.int64), low.astype(np.int64), high.astype(np.int64)
        left = np.concatenate(left).astype(np.uint8)
        left_end = np.cumsum(high)
        order, lcp = [], []
        for r, k, c, _ in merge(runs):
            order.append(int(first[r]) + k)
            lcp.append(c)
        order, lcp = np.array(order, np.int64), np.array(lcp, np.int64)
        bits = np.zeros(len(order), np.int64)  # by place in the suffix order
        own, low, high, left_end = ids[doc][order], low[order], high[order], left_end[order]
        before = np.zeros(len(order), U)
        for offset in range(int(high.max(initial=-1)) + 1):
            if offset:
                longer = high >= offset
                before[longer] = mix(before[longer] + left[left_end[longer] - offset].astype(U) + U(1))
            pick = np.flatnonzero((low <= offset) & (offset <= high))
            same = np.cumsum(lcp < length - offset)[pick]  # equal to the right
            rank = np.lexsort((own[pick], before[pick], same))
            pick, same = pick[rank], same[rank]
            if len(pick):
                new = first_of_runs(same, before[pick])
                smallest = own[pick][new][np.cumsum(new) - 1]
                bits[pick[own[pick] > smallest]] |= 1 << offset
        hit = bits > 0
        return _replies(ids, texts, doc[order][hit], buckets, (anchor[order][hit], 5), (bits[hit], 8))

    return run


BLOBS = "k int, blob binary"
PASS = "kind int, k int, doc_id long, kept binary, spans array<long>, blob binary"


def _row(kind: int, k: int | None, doc_id: int | None, kept: bytes | None, spans: list[int] | None, blob: bytes | None) -> tuple:
    return kind, k, doc_id, kept, spans, blob


def _table(rows: list[tuple]) -> pa.Table:
    types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["kind", "k", "doc_id", "kept", "spans", "blob"])


def _cut(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[bytes, list[int]]:
    """The bytes no start covers, and the removed runs as start, end, start, end ..."""
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    gone = np.cumsum(edge[:-1]) > 0
    turns = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
    return text[~gone].tobytes(), turns.tolist()


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, kept (the remaining bytes) and spans (removed byte runs: start, end, ...), a row for each row."""
    docs = common.documents(docs)
    buckets = common.partitions(docs, 16 << 20)

    def outgoing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = _Outbox()

        def send() -> pa.RecordBatch:
            rows = list(box.blobs(buckets))
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], ["k", "blob"])

        for batch in batches:
            batch = batch.filter(batch.column("doc_id").is_valid())
            data, offsets = common.text_buffer(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for i, j in common.pieces(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                _, _, _, doc, anchor, block = anchors(part, at, length, gram)
                place = np.arange(len(doc)) - np.searchsorted(doc, doc)
                box.add(ids[i:j], _keys(part, at), doc, place, anchor, block)
                if box.size >= FLUSH:
                    yield send()
        if box.size:
            yield send()

    def homed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zipped = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data, offsets = common.text_buffer(batch.column("text"))
            for i, j in common.pieces(offsets, 4 << 20):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                column = batch.column("doc_id").slice(i, j - i)
                ids, keys = column.fill_null(0).to_numpy(zero_copy_only=False), _keys(part, at)
                texts = [zipped.compress(part[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(_home(ids, keys, buckets), pa.int32()), column, pa.array(keys.view(np.int64)), pa.array(texts, pa.binary())], ["k", "doc_id", "key", "z"])

    limits = _limits(docs, length, gram, buckets)

    def compared(left: pa.Table, right: pa.Table) -> pa.Table:
        mail, rows, unzip = _Mail(right), [], zstandard.ZstdDecompressor()
        found: list[tuple] = []  # suffix, left bytes, document, anchor, offsets
        owners: list[tuple[int, int]] = []
        for doc_id, key, z in zip(left.column("doc_id").to_pylist(), left.column("key").to_pylist(), left.column("z").to_pylist(), strict=True):
            raw = unzip.decompress(z)
            got = None if doc_id is None else mail.of(doc_id, key & (1 << 64) - 1)
            if got is None:
                rows.append(_row(0, None, doc_id, raw, [], None))
                continue
            text = np.frombuffer(raw, np.uint8)
            begin, last, anchor, _, _, _ = anchors(text, np.array([0, len(text)]), length, gram)
            place, kind = got
            whole = place[kind == 1]
            starts = np.unique(np.concatenate([np.zeros(0, np.int64), *[np.arange(b, e + 1) for b, e in zip(begin[whole].tolist(), last[whole].tolist(), strict=True)]]))
            open_ = np.unique(place[kind == 2])
            if not len(open_):
                rows.append(_row(0, None, doc_id, *_cut(text, starts, length), None))
                continue
            rows.append(_row(2, left.column("k")[0].as_py(), doc_id, z, [key], pack((np.diff(starts, prepend=0), 4))))
            for b, e, a in zip(begin[open_].tolist(), last[open_].tolist(), anchor[open_].tolist(), strict=True):
                found.append((raw[a : e + length], raw[b:a], len(owners), a, a - e, a - b))
            owners.append((doc_id, key))
        found.sort(key=lambda x: x[0])
        ids, keys = (np.array([o[c] for o in owners], np.int64).view(U) for c in (0, 1))
        cuts = np.searchsorted(np.array([x[0][:gram] for x in found], f"S{gram}"), np.array(limits, f"S{gram}"), "left").tolist() if found else []
        for k, (i, j) in enumerate(zip([0, *cuts], [*cuts, len(found)], strict=True)):
            if i < j:
                part = found[i:j]
                doc, anchor, low, high = (np.array([x[c] for x in part], np.int64) for c in (2, 3, 4, 5))
                used, at = np.unique(doc, return_inverse=True)
                common_, sizes, tails = front_code([x[0] for x in part])
                before = np.frombuffer(b"".join(x[1] for x in part), np.uint8)
                blob = pack((ids[used], 8), (keys[used], 8), (at, 4), (anchor, 5), (low, 1), (high, 1), (common_, 1), (sizes, 1), (np.frombuffer(tails, np.uint8), 1), (before, 1))
                rows.append(_row(1, k, None, None, None, blob))
        return _table(rows)

    def finished(left: pa.Table, right: pa.Table) -> pa.Table:
        mail, rows, unzip = _Mail(right), [], zstandard.ZstdDecompressor()
        for doc_id, z, key, blob in zip(*[left.column(c).to_pylist() for c in ("doc_id", "kept", "spans", "blob")], strict=True):
            text = np.frombuffer(unzip.decompress(z), np.uint8)
            starts = [np.cumsum(stacked([blob])[0][0].astype(np.int64))]
            got = mail.of(doc_id, key[0] & (1 << 64) - 1)
            if got is not None:
                anchor, bits = got
                for offset in range(int(bits.max()).bit_length()):
                    starts.append(anchor[bits >> offset & 1 > 0] - offset)
            rows.append(_row(0, None, doc_id, *_cut(text, np.concatenate(starts), length), None))
        return _table(rows)

    replies = docs.mapInArrow(common.lean(outgoing), BLOBS).groupBy("k").applyInArrow(_settle(buckets), BLOBS)
    homes = docs.mapInArrow(common.lean(homed), "k int, doc_id long, key long, z binary")
    first = common.cut(homes.groupBy("k").cogroup(replies.groupBy("k")).applyInArrow(compared, PASS), "suffixes")
    runs = first.where("kind = 1").select("k", "blob")
    later = runs.groupBy("k").applyInArrow(_merge_range(buckets, length), BLOBS)
    rest = first.where("kind = 2").groupBy("k").cogroup(later.groupBy("k")).applyInArrow(finished, PASS)
    done = first.where("kind = 0").unionByName(rest)
    removed = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return done.select("doc_id", (F.octet_length("kept") + removed).cast("long").alias("n_bytes"), "kept", "spans")


def _limits(docs: DataFrame, length: int, gram: int, ranges: int) -> list[bytes]:
    """Limits of the ranges, from the anchors of a few texts; a range holds whole grams."""
    texts = [r[0].encode()[:65536] for r in docs.select("text").where("text is not null").limit(SPLITTER_TEXTS).collect()]
    grams = []
    for t in texts:
        data = np.frombuffer(t, np.uint8)
        grams += [t[a : a + gram] for a in anchors(data, np.array([0, len(data)]), length, gram)[2].tolist()]
    grams.sort()
    return sorted({grams[len(grams) * k // ranges] for k in range(1, ranges)}) if grams else []


def digest(kept: DataFrame) -> DataFrame:
    """The columns of the contract."""
    return kept.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        (F.size("spans") / 2).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
