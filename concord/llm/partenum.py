"""N-gram Jaccard join by PartEnum signatures.

Sizes are cut into bands [l, l / t]; sets of similarity t or more lie in one band or in
neighbours, so each set signs for its own band and the next.  Within a band they differ in at
most k elements.  The elements' domain is hashed into n1 parts of n2 cells; in one part at
least they differ in k2 elements at most, and so agree on some n2 - k2 cells of it.  A
signature is the hash of the elements in such a choice of cells.

An empty choice says nothing and is not sent.  The bands have more parts than k needs, so a
set with few empty choices still shares a full one; a set with too many (short ones, as a
rule) also sends its rarest-hash prefix, as prefix filtering does, which two such sets share.
So no link is lost, and nothing is capped.

Links are then found in rounds, each exact: within a group of equal signatures all are
compared with its first; connected components are formed; in groups that still hold several
components, pairs across components are compared, unless a sketch proves them too far apart:
the parity of the elements in each of 2 to 4 cells an element (at most 32,768).  Every cell in
which two sketches differ holds an element that only one of the sets has.  Components, not pairs, are the result, so pairs inside one
component need no look.  Equal sets are one node from the start: copies never meet in pairs.

Edge cases: null and empty texts have size 0 and are their own component; fewer than five
words make one shingle; rows with one doc_id and differing texts are separate nodes that
carry that doc_id; a null doc_id belongs to its component but never names it; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .hashing import U, mix
from .packing import first_of_runs, pack, stacked
from .shingles import set_ids, shingle_sets, sums

SHINGLE = 5
PERCENT = 80
MIN_BITS, MAX_BITS = 256, 32768
FLUSH = 2_000_000
BLOCK = 4096  # members of a group that meet in one task
LEAST = 16  # names of groups that a member carries


@dataclass(frozen=True)
class Band:
    low: int
    high: int
    differ: int  # k
    parts: int  # n1
    cells: int  # n2
    spare: int  # k2


def bands(percent: int, largest: int) -> list[Band]:
    """The bands up to a size, and one more."""
    out: list[Band] = []
    low = 1
    while not out or out[-1].low <= largest:
        high = low * 100 // percent
        k = 2 * high * (100 - percent) // (100 + percent)
        if k == 0:
            out.append(Band(low, high, 0, 1, 1, 0))
        elif k < 5:
            out.append(Band(low, high, k, 1, k + 3, k))
        elif k < 24:
            out.append(Band(low, high, k, k // 3 + 1 + (k > 11), 5, 2))
        else:
            need = k // 2 + 1
            out.append(Band(low, high, k, need + 2 + need // 20, 3, 1))
        low = high + 1
    return out


def signatures(hashes: np.ndarray, doc: np.ndarray, size: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the sets, and the set of each."""
    table = bands(percent, int(size.max(initial=0)))
    lows = np.array([b.low for b in table])
    shape = np.array([(b.parts, b.cells, b.spare, b.parts * b.cells, b.differ // (b.spare + 1)) for b in table])
    full = np.flatnonzero(size > 0)
    own = np.searchsorted(lows, size[full], "right") - 1
    signed, sets = [], []
    wrong = np.zeros(len(size), bool)
    spread = mix(hashes ^ U(0x5BD1E995))
    value = mix(hashes + U(0x632BE59BD9B4E019))
    starts = np.searchsorted(doc, np.arange(len(size)))
    for step in (0, 1):
        band = np.zeros(len(size), np.int64)
        band[full] = own + step
        total = np.where(size > 0, shape[band, 3], 0)
        base = np.cumsum(total) - total
        cell = base[doc] + (spread % shape[band, 3].astype(U)[doc]).astype(np.int64)
        n = int(total.sum())
        mass, count = sums(value, cell, n), np.bincount(cell, minlength=n)
        for cells, spare in {(b.cells, b.spare) for b in table}:
            mine = np.flatnonzero((size > 0) & (shape[band, 1] == cells) & (shape[band, 2] == spare))
            if not len(mine):
                continue
            parts = shape[band[mine], 0]
            owner = np.repeat(mine, parts)
            part = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
            at = (base[owner] + part * cells)[:, None] + np.arange(cells)
            m, c = mass[at], count[at]
            empty = np.zeros(len(owner), bool)
            for which, chosen in enumerate(combinations(range(cells), cells - spare)):
                s, k = m[:, chosen].sum(1), c[:, chosen].sum(1)
                tag = band[owner].astype(U) << U(40) | part.astype(U) << U(8) | U(which)
                some = k > 0
                empty |= ~some
                signed.append(mix(s ^ mix(tag + U(1)))[some])
                sets.append(owner[some])
            left = parts - np.bincount(np.searchsorted(mine, owner), empty, len(mine))
            wrong[mine] |= left <= shape[band[mine], 4]
    for d in np.flatnonzero(wrong).tolist():
        n = int(size[d])
        prefix = n - -(-n * percent // 100) + 1
        signed.append(mix(hashes[starts[d] : starts[d] + prefix] ^ U(0x2545F4914F6CDD1D)))
        sets.append(np.full(prefix, d))
    return np.concatenate([np.zeros(0, U), *signed]), np.concatenate([np.zeros(0, np.int64), *sets])


def sketches(hashes: np.ndarray, doc: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Of each set, the parity of its elements by cell, a bit each; the cells are a power of two."""
    bits = np.clip(1 << np.ceil(np.log2(np.maximum(2 * size, 1))).astype(np.int64), MIN_BITS, MAX_BITS)
    end = np.cumsum(bits)
    cell = (end - bits)[doc] + (mix(hashes) & (bits - 1)[doc].astype(U)).astype(np.int64)
    raw = np.packbits((np.bincount(cell, minlength=int(end[-1])) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [raw[(e - n) // 8 : e // 8] for e, n in zip(end.tolist(), bits.tolist(), strict=True)]


def _matrix(blobs: list[bytes], words: int) -> np.ndarray:
    """Sketches of one length, a row each, folded to so many 64-bit words."""
    out = np.frombuffer(b"".join(blobs), "<u8").reshape(len(blobs), -1)
    while out.shape[1] > words:
        half = out.shape[1] // 2
        out = out[:, :half] ^ out[:, half:]
    return out


def far_apart(least: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, percent: int) -> np.ndarray:
    """Where two sets that differ in so many elements at least, or as their sizes do, are too far apart."""
    return np.maximum(least, np.abs(size_a - size_b)) * (100 + percent) > (size_a + size_b) * (100 - percent)


def least_difference(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """In so many elements the sets of these sketches differ at least, row by row."""
    words = np.array([[len(x) // 8, len(y) // 8] for x, y in zip(a, b, strict=True)], np.int64).reshape(-1, 2)
    out = np.zeros(len(a), np.int64)
    for pair in np.unique(words, axis=0):
        rows = np.flatnonzero((words == pair).all(1))
        for part in np.array_split(rows, 1 + len(rows) * int(pair.max()) // (1 << 20)):
            sides = (_matrix([x[k] for k in part.tolist()], int(pair.min())) for x in (a, b))
            out[part] = np.bitwise_count(np.bitwise_xor(*sides)).sum(1, dtype=np.int64)
    return out


PAIRS = "a long, b long"
BLOBS = "k int, blob binary"
GROUPS = "kind int, blob binary"


def _unpacked(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                a, b = (c[0].view(np.int64) for c in stacked([blob]))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return df.mapInArrow(common.lean(run), PAIRS)


def _pairs(a: np.ndarray, b: np.ndarray) -> bytes:
    return pack((a.view(U), 8), (b.view(U), 8))


def _groups(table: pa.Table) -> pa.Table:
    """Of one bucket of signatures: pairs with the first of each group (kind 0), and the groups of three or more (kind 1)."""
    ids, at, signature = stacked(table.column("blob").to_pylist())
    base = np.cumsum([0, *map(len, ids)])
    node = np.concatenate(ids).view(np.int64)[np.concatenate([x.astype(np.int64) + b for x, b in zip(at, base, strict=False)])]
    signature = np.concatenate(signature)
    order = np.lexsort((node, signature))
    node, signature = node[order], signature[order]
    keep = first_of_runs(signature, node)
    node, signature = node[keep], signature[keep]
    new = first_of_runs(signature)
    group = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(node)))
    several = count[group] > 1
    other = several & ~new
    a, b = node[start][group[other]], node[other]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = first_of_runs(a, b)
    rows = [(0, _pairs(a[keep], b[keep]))] if len(a) else []
    # a list of members that several signatures share is kept once
    name = sums(mix(node.view(U) + U(7)), group, len(start)) + count.astype(U)
    large = np.flatnonzero(count > 2)
    _, pick = np.unique(name[large], return_index=True)
    chosen = np.zeros(len(start), bool)
    chosen[large[pick]] = True
    if chosen.any():
        member = chosen[group]
        rows.append((1, _pairs((name[group[member]] >> U(1)).view(np.int64), node[member])))
    return pa.table({"kind": pa.array([r[0] for r in rows], pa.int32()), "blob": pa.array([r[1] for r in rows], pa.binary())})


def components(links: DataFrame) -> DataFrame:
    """(node, root) of undirected links (a, b); the root is the smallest node.  Least labels spread, and jump along themselves."""
    both = common.cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links", small=True)
    now = common.cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "labels", small=True)
    while True:
        near = both.join(now.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        least = now.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("via"))
        jump = now.select(F.col("node").alias("via"), F.col("root").alias("far"))
        stepped = common.cut(least.join(jump, "via").select("node", "old", F.least("via", "far").alias("root")), "labels", small=True)
        changed = stepped.where("old <> root").limit(1).count()
        now = stepped.select("node", "root")
        if not changed:
            return now


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, a row for each row of ``docs(doc_id, text)``."""
    rooted = rooted_rows(docs, shingle=shingle, percent=percent)
    return rooted.select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def rooted_rows(docs: DataFrame, key: str | None = None, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, size, root, least, a row for each row of ``docs``, and ``key``, a column of whole numbers, as ``row``; rows of a component share a root and its least doc_id, empty sets have neither."""
    row = docs[key].cast("long").alias("row") if key else F.lit(None).cast("long").alias("row")
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), row)
    buckets = common.partitions(docs, 8 << 20)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.text_buffer(batch.column("text"))
            for i, j in common.pieces(offsets):
                n = j - i
                hashes, doc = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle)
                ids, size = set_ids(hashes, doc, n)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, n), batch.column("row").slice(i, n), pa.array(ids), pa.array(size), pa.array(sketches(hashes, doc, size), pa.binary())], ["doc_id", "row", "node", "size", "sketch"])

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0

        def send() -> pa.RecordBatch:
            nonlocal held, count
            nodes = np.fromiter(seen, np.int64, len(seen))
            signature, at = (np.concatenate(c) for c in zip(*held, strict=True))
            home = (signature % U(buckets)).astype(np.int64)
            keys, blobs = [], []
            for part in np.split(np.argsort(home, kind="stable"), np.cumsum(np.bincount(home, minlength=buckets))[:-1]):
                if len(part):
                    part = part[np.argsort(at[part], kind="stable")]
                    used, place = np.unique(at[part], return_inverse=True)
                    keys.append(int(home[part[0]]))
                    blobs.append(pack((nodes[used].view(U), 8), (place, 4), (signature[part] >> U(16), 6)))
            seen.clear()
            held, count = [], 0
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["k", "blob"])

        for batch in batches:
            data, offsets = common.text_buffer(batch.column("text"))
            for i, j in common.pieces(offsets):
                hashes, doc = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle)
                ids, size = set_ids(hashes, doc, j - i)
                fresh = np.zeros(j - i, bool)  # a set that the task has signed for is not signed again
                for d, node in enumerate(ids.tolist()):
                    if size[d] and node not in seen:
                        seen[node] = len(seen)
                        fresh[d] = True
                if fresh.any():
                    place = np.array([seen[x] if f else -1 for x, f in zip(ids.tolist(), fresh.tolist(), strict=True)], np.int64)
                    use = fresh[doc]
                    signature, at = signatures(hashes[use], doc[use], np.where(fresh, size, 0), percent)
                    held.append((signature, place[at]))
                    count += len(signature)
                    if count >= FLUSH:
                        yield send()
        if count:
            yield send()

    table = common.cut(docs.mapInArrow(common.lean(described), "doc_id long, row long, node long, size long, sketch binary"), "sets")
    sets = table.where("size > 0")
    nodes = sets.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    met = common.cut(docs.select("doc_id", "text").mapInArrow(common.lean(signed), BLOBS).groupBy("k").applyInArrow(_groups, GROUPS), "groups")

    def near(pairs: DataFrame) -> DataFrame:
        """Pairs that the sketches leave open."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                least = least_difference(batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist())
                apart = far_apart(least, batch.column("size_a").to_numpy(), batch.column("size_b").to_numpy(), percent)
                yield batch.select(["a", "b"]).filter(pa.array(~apart))

        def side(x: str) -> DataFrame:
            return nodes.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("sketch").alias(f"sketch_{x}"))

        return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(common.lean(run), PAIRS)

    def linked(pairs: DataFrame) -> DataFrame:
        """Those pairs whose texts are similar enough, exactly."""
        pairs = common.cut(pairs, "pairs")
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        wanted = nodes.join(ends, "node").select("node", "doc_id")

        def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                zipped = zstandard.ZstdCompressor(level=3)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([zipped.compress((t or "").encode()) for t in batch.column("text").to_pylist()], pa.binary())], ["doc_id", "z"])

        def paired(batch: pa.RecordBatch, unzip: zstandard.ZstdDecompressor) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
            """Rows with their texts, as many at a time as hold a megabyte, or one."""
            begin = held = 0
            left: list[bytes] = []
            right: list[bytes] = []
            for k, (a, b) in enumerate(zip(batch.column("z_a"), batch.column("z_b"), strict=True)):
                left.append(unzip.decompress(a.as_py()))
                right.append(unzip.decompress(b.as_py()))
                held += len(left[-1]) + len(right[-1])
                if held >= 1 << 20 or k == len(batch) - 1:
                    yield batch.slice(begin, k + 1 - begin), left + right
                    begin, held, left, right = k + 1, 0, [], []

        def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unzip = zstandard.ZstdDecompressor()
            for batch in batches:
                for part, texts in paired(batch, unzip):
                    names = [c for x in "ab" for c in part.column(x).to_pylist()]
                    data, offsets = common.text_buffer(pa.array(texts, pa.large_binary()))
                    hashes, doc = shingle_sets(data, offsets, shingle)
                    ids, size = set_ids(hashes, doc, len(texts))
                    n = len(part)
                    row = np.where(doc < n, doc, doc - n)
                    order = np.lexsort((hashes, row))
                    h, r = hashes[order], row[order]
                    twice = np.bincount(r[1:][(h[1:] == h[:-1]) & (r[1:] == r[:-1])], minlength=n)
                    both = size[:n] + size[n:] - twice
                    right = (ids == np.array(names)).reshape(2, n).all(0)  # a doc_id may stand in several rows
                    good = right & (100 * twice >= percent * both)
                    yield part.select(["a", "b"]).filter(pa.array(good))

        def unnamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Texts without a doc_id by their node."""
            for batch in batches:
                data, offsets = common.text_buffer(batch.column("text"))
                for i, j in common.pieces(offsets):
                    ids, _ = set_ids(*shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle), j - i)
                    zipped = zstandard.ZstdCompressor(level=3)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([zipped.compress((t or "").encode()) for t in batch.column("text").slice(i, j - i).to_pylist()], pa.binary())], ["node", "z"])

        plain = docs.select("doc_id", "text")
        texts = plain.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(common.lean(squeezed), "doc_id long, z binary")
        bare = plain.where("doc_id is null").mapInArrow(common.lean(unnamed), "node long, z binary").join(wanted.where("doc_id is null").select("node"), "node", "left_semi")
        bare = bare.groupBy("node").agg(F.min("z").alias("z"))  # of copies, one text stands for the node
        held = common.cut(wanted.join(texts, "doc_id").select("node", "z").unionByName(bare), "texts")
        whole = pairs.join(held.select(F.col("node").alias("a"), F.col("z").alias("z_a")), "a").join(held.select(F.col("node").alias("b"), F.col("z").alias("z_b")), "b")
        return whole.mapInArrow(common.lean(compared), PAIRS).distinct()

    def across(pdf: pa.Table) -> pa.Table:
        """Pairs of different components in one group (or in two blocks of it), but those that are too far apart or that a smaller group proposes."""
        blobs = pdf.column("sketch").to_pylist()
        order = sorted(range(len(blobs)), key=lambda k: len(blobs[k]))
        blobs = [blobs[k] for k in order]
        node, root, size, block = (pdf.column(c).to_numpy()[order] for c in ("node", "root", "size", "block"))
        mixed = block.min() != block.max()  # pairs inside one block are another task's work
        length = np.array([len(x) for x in blobs]) // 8
        a, b = [], []
        for words in np.unique(length).tolist():  # those from here on are folded to the shortest
            first, end = np.searchsorted(length, [words, words + 1]).tolist()
            rest = np.concatenate([_matrix(blobs[i:j], words) for i, j in pairwise([first, *np.flatnonzero(np.diff(length[first:])) + first + 1, len(blobs)])])
            rows = max(1, (1 << 20) // (len(rest) * words))
            for low in range(first, end, rows):
                top = min(low + rows, end)
                differ = root[low:top, None] != root[None, low:]
                if mixed:
                    differ &= block[low:top, None] != block[None, low:]
                i, j = np.nonzero(np.triu(differ, 1))
                least = np.bitwise_count(rest[i + low - first] ^ rest[j + low - first]).sum(1, dtype=np.int64)
                open_ = ~far_apart(least, size[i + low], size[j + low], percent)
                a.append(i[open_] + low)
                b.append(j[open_] + low)
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
        if len(a):
            lists = pdf.column("least").combine_chunks()
            many, names = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
            table = np.full((len(many), LEAST), -1, np.int64)
            table[np.repeat(np.arange(len(many)), many), np.arange(len(names)) - np.repeat(np.cumsum(many) - many, many)] = names
            table = np.where(table < pdf.column("name")[0].as_py(), table, -1)[order]
            keep = []
            for k in range(0, len(a), 4096):
                both = np.sort(np.concatenate((table[a[k : k + 4096]], table[b[k : k + 4096]]), axis=1), axis=1)
                keep.append(~((both[:, 1:] == both[:, :-1]) & (both[:, 1:] >= 0)).any(1))
            keep = np.concatenate(keep)
            a, b = node[a[keep]], node[b[keep]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    stars = _unpacked(met.where("kind = 0").select("blob")).distinct()
    links = common.cut(linked(near(stars)), "links", small=True)
    labels = components(links)
    members = _unpacked(met.where("kind = 1").select("blob")).select(F.col("a").alias("name"), F.col("b").alias("node"))
    labelled = members.join(labels, "node", "left").select("name", "node", F.coalesce("root", "node").alias("root"))
    labelled = common.cut(labelled, "members")
    open_ = labelled.groupBy("name").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low <> high").select("name", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    rest = common.cut(labelled.join(open_, "name"), "open")
    least = rest.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("name")), 1, LEAST).alias("least"))
    rest = rest.join(nodes.select("node", "size", "sketch").join(least, "node"), "node").withColumn("block", F.expr("pmod(xxhash64(node), blocks)"))
    meets = F.expr("explode(transform(sequence(0L, blocks - 1), x -> least(x, block) * blocks + greatest(x, block)))")
    more = rest.select("*", meets.alias("meet")).groupBy("name", "meet").applyInArrow(across, PAIRS).distinct().join(stars, ["a", "b"], "left_anti")
    more = common.cut(linked(more), "links", small=True)
    if more.limit(1).count():
        labels = components(links.unionByName(more))

    # the least doc_id of a component comes by its nodes, so copies never gather under its root
    named = common.cut(nodes.select("node", "doc_id").join(labels, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root")), "named")
    shared = common.cut(named.groupBy("root").agg(F.min("doc_id").alias("least")), "least")
    named = named.join(shared, "root").select("node", "root", "least")
    return common.cut(table.join(named, "node", "left").select("doc_id", "row", "size", "root", "least"), "rooted")
