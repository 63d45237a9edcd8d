"""N-gram Jaccard self-join by T-occurrence search, and the components of its links.

A document's set holds the 64-bit hashes of its distinct 5-word shingles (fewer words: the
whole sequence is the one shingle). Two documents link when 100 * |A and B| >= 75 * |A or B|.

1. Documents with one set are one *class* (128-bit key), compared once.
2. A count sketch of fixed size over all documents orders shingles from rare to frequent.
   Only the order comes from it: any order gives the same links.
3. A set's prefix are its first |s| - ceil(0.75 |s|) + 1 shingles in that order. Sets that link
   have ``shared_least`` shingles or more in both prefixes, which is at least one. Most prefix
   shingles are one set's alone: four bytes of each go to shards first, and a bitmap of fixed size
   (16 MB, broadcast) says which may occur twice. Those are dealt to shards by hash, as sorted
   blocks; a shard reads off its inverted lists of two classes or more. A class's *shared* count
   is the number of its prefix shingles in any list.
4. Lists of up to ``PAIRS`` classes give all their pairs, a longer one gives stars: each class
   against the first of the most connected ones that its size can link with. Pairs whose shared
   counts can't reach ``shared_least`` are left out. A list of more than ``LONG`` classes is dealt
   to several tasks, its most connected class to each of them.
5. The sets of each query class and of its candidates (about ``BLOCK`` shingles at once) meet in a
   task; there DivideSkip finds the candidates with the required overlap: the short inverted lists
   are heap-merged, the long ones probed by binary search, and the exact Jaccard test follows.
6. Long lists whose classes are in several components after that are gone through once more,
   block by block: classes outside the list's largest component against all that are in other
   components, each dealt to parts of ``LONG``; the others are copied only to the parts of those
   that ask. Rows carry their class's lists (up to ``MANY``), so a pair is counted where it
   first meets, and only pairs that reach ``shared_least`` leave the task and go through step 5.
   So no link is lost, and a hot group costs stars instead of all pairs.
7. Components: alternating large-star and small-star steps on the links.

Texts are shingled three times (classes and sketch, fingerprints, prefixes); for the comparisons only
those move whose class is in a pair: a bitmap of fixed size (4 MB, broadcast) keeps back most others
where they are read. Only the sketch (8 MB) and the bitmap of shingles (16 MB) go through the driver,
whatever the input.

Defined cases: null texts and texts without words have n_shingles 0 and are their own
component; the nodes of the graph are the classes, so rows that share a doc_id or have none are
linked by their texts alone; null ids are never the smallest, and a component without any id
has component_id null; where ids repeat, two components may have one name (``keep_one`` goes by
nodes, not by names); a text of any length and any
number of copies is worked through; an empty table gives an empty result; other columns are
ignored, or kept by ``keep_one``.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from heapq import merge
from itertools import groupby
from math import log2

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import WORD, fresh, saved, shards, text_key
from barloom.llm.repeats import SEGMENT, Rolling, mix, slices, split_words, word_hashes

N, PERCENT = 5, 75
SKETCH_BITS, SKETCH_BLOCKS = 20, 16
PAIRS, LONG = 4, 1024
#: Shingles that are compared in a block; postings that a task holds; parts of the sketch that are added up at once.
BLOCK, POSTINGS, TOGETHER = 100_000, 500_000, 64
#: Lists of a class up to which its rows carry them all.
MANY = 512
#: Bits of the bitmap that says which texts may be asked for (4 MB); if many are set it lets more pass, the result is the same.
FILTER = 1 << 25
#: Address bits of the bitmap that says which prefix shingles may occur twice (16 MB), the same holds; bits of a hash that the sketch leaves.
TWICE_BITS, BELOW = 27, 44
U = np.uint64
#: What tells a row from others of its doc_id: 128 bits of the text, 64 of the row.
KEYS = ("_k0", "_k1", "_k2")


def overlap(a: int, b: int) -> int:
    """Least common size of two linked sets of these sizes."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def shared_least(a, b):
    """Least number of shingles that two linked sets of these sizes share in both prefixes.

    What they have in common beyond the shorter-reaching prefix fits in that set's rest, which
    has ceil(0.75 size) - 1 shingles. Works on numbers and arrays.
    """
    return -(-PERCENT * (a + b) // (100 + PERCENT)) - np.maximum(-(-PERCENT * a // 100), -(-PERCENT * b // 100)) + 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = N) -> list[np.ndarray]:
    """The sorted distinct hashes of every document's shingles of ``size`` words."""
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    begin, end, first = split_words(data, offsets)
    words = word_hashes(data, begin, end)
    grams = np.empty(max(0, len(words) - size + 1), U)
    for a in range(0, len(grams), SEGMENT):
        part = words[a : a + SEGMENT + size - 1]
        grams[a : a + SEGMENT] = Rolling(part).of(np.arange(len(part) - size + 1), size)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= size:
            out.append(np.unique(grams[lo : hi - size + 1]))
        elif hi > lo:
            out.append(mix(Rolling(words[lo:hi]).of(np.array([0]), hi - lo) + U(hi - lo)))
        else:
            out.append(np.empty(0, U))
    return out


def class_of(s: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents' classes and sizes, and the task's part of the sketch (rows with a block)."""
    schema = pa.schema([("doc_id", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("n", pa.int64()), *((k, pa.int64()) for k in KEYS), ("lot", pa.int64()), ("block", pa.int32()), ("counts", pa.binary())])
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    for batch in batches:
        for a, b, data, offsets in slices(batch.column(1)):
            sets = shingle_sets(data, offsets)
            sketch += np.bincount(np.concatenate(sets) >> U(64 - SKETCH_BITS), minlength=len(sketch))
            keys = [class_of(s) if len(s) else (None, None) for s in sets]
            m = b - a
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[a:b], pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *(batch.column(2 + k)[a:b] for k in range(len(KEYS))), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())],
                schema=schema,
            )
    if sketch.any():
        parts = [zlib.compress(x.tobytes(), 1) for x in sketch.reshape(SKETCH_BLOCKS, -1)]
        none = pa.nulls(SKETCH_BLOCKS, pa.int64())
        lot = pa.array([TaskContext.get().partitionId()] * SKETCH_BLOCKS, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, *(none for _ in KEYS), lot, pa.array(range(SKETCH_BLOCKS), pa.int32()), pa.array(parts, pa.binary())], schema=schema)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lot, block, counts) in order of lot and block -> their sums; ``TOGETHER`` lots become one."""

    def out(key: tuple[int, int], total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["lot", "block", "counts"])

    now, total = None, np.empty(0)
    for batch in batches:
        for lot, block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            part = np.frombuffer(zlib.decompress(counts.as_py()), np.int64)
            if now == (lot, block):
                total = total + part
                continue
            if now is not None:
                yield out(now, total)
            now, total = (lot, block), part
    if now is not None:
        yield out(now, total)


def _sketch(parts: DataFrame, lots: int) -> np.ndarray:
    """Ranks of the shingles' bins by frequency, from parts (lot, block, counts): added up ``TOGETHER`` by ``TOGETHER``."""
    while True:
        lots = max(1, -(-lots // TOGETHER))
        dealt = parts.select((F.col("lot") / TOGETHER).cast("long").alias("lot"), "block", "counts").repartition(min(lots * SKETCH_BLOCKS, shards(parts)), "lot", "block")
        parts = dealt.sortWithinPartitions("lot", "block").mapInArrow(_add_up, "lot long, block int, counts binary")
        if lots == 1:
            break
        parts = saved(parts)
    sketch = np.zeros((SKETCH_BLOCKS, (1 << SKETCH_BITS) // SKETCH_BLOCKS), np.int64)
    for r in parts.collect():
        sketch[r["block"]] += np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    # ranks instead of counts: half the size, the same order
    return np.unique(sketch.ravel(), return_inverse=True)[1].astype(np.int32)


def _prefixes(batches: Iterator[pa.RecordBatch], rank: np.ndarray, seen: set[tuple[int, int]]) -> Iterator[tuple[tuple[int, int], int, np.ndarray]]:
    """(class, size, prefix) of the texts' sets that aren't ``seen``."""
    for batch in batches:
        for _, _, data, offsets in slices(batch.column(0)):
            for s in shingle_sets(data, offsets):
                if not len(s) or (key := class_of(s)) in seen:
                    continue
                seen.add(key)
                m = len(s) - (-(-PERCENT * len(s) // 100)) + 1
                order = np.lexsort((s, rank[s >> U(64 - SKETCH_BITS)]))
                yield key, len(s), s[order[:m]]


def _prints(h: np.ndarray, n_shards: int) -> np.ndarray:
    """Fingerprints: 32 bits within each of ``n_shards`` shards. The sketch's bits, by which prefixes are chosen, aren't in it."""
    return (h & U((1 << BELOW) - 1)) * U(n_shards) >> U(BELOW - 32)


def _places(prints: np.ndarray, n_shards: int) -> np.ndarray:
    """Bits of the bitmap, in order of fingerprints."""
    return prints // U(n_shards) >> U(32 - TWICE_BITS)


def _print_blocks(sketch, n_shards: int):
    """Blocks (shard, once, twice): 32 bits of the fingerprints that a block of sets has once, and several times."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        hashes: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            prints, often = np.unique(_prints(np.concatenate(hashes) if hashes else np.empty(0, U), n_shards), return_counts=True)
            shards, first = np.unique(prints >> U(32), return_index=True)
            parts = np.split(prints.astype(np.uint32), first[1:]), np.split(often > 1, first[1:])
            blobs = [[v[m == many].tobytes() for v, m in zip(*parts, strict=True)][: len(shards)] for many in (False, True)]
            hashes.clear()
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(shards.astype(np.int32)), *(pa.array(x, pa.binary()) for x in blobs)], names=["shard", "once", "twice"])

        held = 0
        for _, _, prefix in _prefixes(batches, sketch.value, seen):
            hashes.append(prefix)
            held += len(prefix)
            if held >= POSTINGS:
                yield out()
                held = 0
        yield out()

    return work


def _repeated(n_shards: int):
    """Blocks in order of shard -> parts of the bitmap (first byte, bits)."""

    def out(shard: int, once: list[np.ndarray], twice: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        v = np.sort(np.concatenate(once))
        again = np.concatenate([v[1:][v[1:] == v[:-1]], *twice]).astype(U)
        if len(again):
            at = np.unique(_places(again | U(shard << 32), n_shards)).astype(np.int64)
            first = int(at[0]) >> 3
            bits = np.zeros((int(at[-1]) >> 3) - first + 1, np.uint8)
            np.bitwise_or.at(bits, (at >> 3) - first, (1 << (at & 7)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())], names=["first", "bits"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice = None, [], []
        for batch in batches:
            for shard, *values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if shard != now and once:
                    yield from out(now, once, twice)
                    once, twice = [], []
                now = shard
                for part, value in zip((once, twice), values, strict=True):
                    part.append(np.frombuffer(value, np.uint32))
        if once:
            yield from out(now, once, twice)

    return work


def _twice(texts: DataFrame, sketch, n_shards: int) -> np.ndarray:
    """The bitmap of prefix shingles: the bit of each that two classes have is set, and few others."""
    blocks = texts.mapInArrow(_print_blocks(sketch, n_shards), "shard int, once binary, twice binary")
    parts = blocks.repartitionById(n_shards, "shard").sortWithinPartitions("shard").mapInArrow(_repeated(n_shards), "first long, bits binary")
    bits = np.zeros(max(1, 1 << TWICE_BITS >> 3), np.uint8)
    for r in parts.collect():  # slices of one bitmap: 16 MB in all
        part = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
        bits[r["first"] : r["first"] + len(part)] |= part
    return bits


def _postings(sketch, twice, n_shards: int):
    """Blocks (shard, data): the table of classes (c1, c2, size), then hash and class of each posting that ``twice`` lets pass."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = twice.value
        seen: set[tuple[int, int]] = set()
        table: list[tuple[int, int, int]] = []
        hashes: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            h = np.concatenate(hashes) if hashes else np.empty(0, U)
            of = np.repeat(np.arange(len(table)), [len(x) for x in hashes]).astype(np.int64)
            at = _places(_prints(h, n_shards), n_shards)
            may = bits[at >> U(3)] >> (at & U(7)).astype(np.uint8) & 1 == 1
            h, of = h[may], of[may]
            shard = (h % U(n_shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            h, of, shard = h[order], of[order], shard[order]
            cuts = np.searchsorted(shard, np.arange(n_shards + 1))
            classes, ids, blobs = np.array(table, np.int64).reshape(-1, 3), [], []
            for s in range(n_shards):
                x, y = h[cuts[s] : cuts[s + 1]], of[cuts[s] : cuts[s + 1]]
                if len(x):
                    used, local = np.unique(y, return_inverse=True)
                    ids.append(s)
                    blobs.append(len(used).to_bytes(8, "little") + classes[used].tobytes() + x.tobytes() + local.astype(np.uint32).tobytes())
            table.clear()
            hashes.clear()
            seen.clear()  # copies beyond a block become one again where lists are read off
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], names=["shard", "data"])

        held = 0
        for key, size, prefix in _prefixes(batches, sketch.value, seen):
            table.append((*key, size))
            hashes.append(prefix)
            held += len(prefix)
            if held >= POSTINGS:
                yield out()
                held = 0
        yield out()

    return work


def _read_block(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k = int.from_bytes(data[:8], "little")
    classes = np.frombuffer(data, np.int64, 3 * k, 8).reshape(-1, 3)
    m = (len(data) - 8 - 24 * k) // 12
    return classes, np.frombuffer(data, U, m, 8 + 24 * k), np.frombuffer(data, np.uint32, m, 8 + 24 * k + 8 * m)


def _ranges(blocks: list[bytes]) -> Iterator[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """A shard's blocks in ranges of hashes, of about ``POSTINGS`` each."""
    parts = [_read_block(x) for x in blocks]
    several = sum(len(h) for _, h, _ in parts) // POSTINGS + 1
    for i in range(several):
        if several == 1:
            yield parts
            return
        mine = [(h >> U(32)) * U(several) >> U(32) == U(i) for _, h, _ in parts]
        yield [(classes, h[m], of[m]) for (classes, h, of), m in zip(parts, mine, strict=True)]


def _lists_of(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, dict[bytes, int]]:
    """(classes, inverted lists of two or more as bytes of sorted class numbers: how many shingles have each)."""
    table = np.concatenate([p[0] for p in parts])
    base = np.cumsum([0, *(len(p[0]) for p in parts)])
    classes, number = np.unique(table, axis=0, return_inverse=True)
    of = number.ravel()[np.concatenate([p[2] + U(b) for p, b in zip(parts, base[:-1].tolist(), strict=True)]).astype(np.int64)]
    h = np.concatenate([p[1] for p in parts])
    order = np.lexsort((of, h))
    h, of = h[order], of[order]
    fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])])[: len(h)]
    h, of = h[fresh], of[fresh]
    cuts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]])) if len(h) else np.zeros(1, int)
    lists: dict[bytes, int] = defaultdict(int)
    for i in np.flatnonzero(np.diff(cuts) > 1).tolist():
        lists[of[cuts[i] : cuts[i + 1]].tobytes()] += 1
    return classes, lists


def _close(a, b):
    return 100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order of shard -> members of inverted lists (list, c1, c2, n, times)."""

    def out(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        classes, lists = _lists_of(parts)
        members = [np.frombuffer(x, np.int64) for x in lists]
        sizes = [len(m) for m in members]
        c = classes[np.concatenate(members)] if members else np.empty((0, 3), np.int64)
        names = [hashlib.blake2b(classes[m].tobytes(), digest_size=16).digest() for m in members]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.array(names, object), sizes), pa.binary()), *(pa.array(c[:, i]) for i in range(3)), pa.array(np.repeat(np.array(list(lists.values()), np.int64), sizes))],
            names=["list", "c1", "c2", "n", "times"],
        )

    now, blocks = None, []
    for batch in batches:
        for shard, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if shard != now and blocks:
                yield from map(out, _ranges(blocks))
                blocks = []
            now = shard
            blocks.append(data.as_py())
    if blocks:
        yield from map(out, _ranges(blocks))


def _possible(x: tuple, y: tuple) -> bool:
    """Of members (c1, c2, n, shared)."""
    return bool(_close(x[2], y[2])) and shared_least(x[2], y[2]) <= min(x[3], y[3])


def _first_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members (list, part, c1, c2, n, shared) in order of list, part and falling shared -> pairs (x, y, ny)."""
    pairs: set[tuple] = set()

    def out() -> pa.RecordBatch:
        rows = sorted(pairs)
        pairs.clear()
        columns = zip(*rows, strict=True) if rows else ((),) * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["x1", "x2", "y1", "y2", "ny"])

    now, start, hubs, last = None, [], [], None
    for batch in batches:
        for name, part, *member in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if (name, part) != now:
                now, start, hubs, last = (name, part), [], [], None
            if member == last:  # the list's first class is in each of its parts
                continue
            last = member
            if len(start) < PAIRS:  # all pairs of the first ones
                pairs.update((x[0], x[1], *member[:3]) for x in start if _possible(x, member))
                start.append(member)
                hubs += [] if any(_close(h[2], member[2]) for h in hubs) else [member]
                continue
            hub = next((h for h in hubs if _close(h[2], member[2])), None)
            if hub is None:
                hubs.append(member)
            elif _possible(hub, member):
                pairs.add((hub[0], hub[1], *member[:3]))
            if len(pairs) > 100_000:
                yield out()
    yield out()


def _open_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells (list, cell, id, c1, c2, n, shared, component, times, asked, query, ids, weights) -> pairs in different components.

    Where both know all their lists, a pair is counted at the first list that they have in common
    and only sent with as many as it needs; else it is sent from every list, with its times.
    """

    def out(here: int, rows: list[tuple]) -> pa.RecordBatch:
        *numbers, asked, query, ids, weights = zip(*rows, strict=True)
        c1, c2, n, shared, component, times = (np.array(x, np.int64) for x in numbers)
        asked, query, knows = np.array(asked, bool), np.array(query, bool), np.array([x is not None for x in ids])
        to = np.flatnonzero(~asked)
        # who is in which list, of the lists that are known here
        whose = np.repeat(to, [len(ids[i] or ()) for i in to.tolist()])
        listed = np.array([x for i in to.tolist() for x in ids[i] or ()], np.int64)
        order = np.argsort(listed, kind="stable")
        listed, whose = listed[order], whose[order]
        found: list[list[np.ndarray]] = [[], [], []]
        for q in np.flatnonzero(asked).tolist():
            fit = to[_close(n[to], n[q]) & (component[to] != component[q])]
            need = shared_least(n[fit], n[q])
            fit = fit[need <= np.minimum(shared[fit], shared[q])]
            # where both are asked about, once
            fit = fit[~query[fit] | (c1[fit] > c1[q]) | ((c1[fit] == c1[q]) & (c2[fit] > c2[q]))]
            often = times[fit]
            if knows[q] and len(fit):
                mine, w = np.array(ids[q], np.int64), np.array(weights[q], np.int64)
                lo, hi = np.searchsorted(listed, mine), np.searchsorted(listed, mine, "right")
                first = mine.tolist().index(here)
                common, earlier = np.zeros(len(n), np.int64), np.zeros(len(n), bool)
                for i, (x, y) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
                    common[whose[x:y]] += w[i]  # a class is in a list once
                    if i < first:
                        earlier[whose[x:y]] = True
                sure = ~knows[fit] | (~earlier[fit] & (common[fit] >= shared_least(n[fit], n[q])))
                often = np.where(knows[fit], common[fit], often)[sure]
                fit = fit[sure]
            for part, x in zip(found, (np.full(len(fit), q), fit, often), strict=True):
                part.append(x)
        x, y, often = (np.concatenate(f) if f else np.empty(0, np.int64) for f in found)
        turn = (c1[x] > c1[y]) | ((c1[x] == c1[y]) & (c2[x] > c2[y]))  # who asks may differ from list to list
        x, y = np.where(turn, y, x), np.where(turn, x, y)
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (c1[x], c2[x], c1[y], c2[y], n[x], n[y], often)], names=["x1", "x2", "y1", "y2", "nx", "ny", "times"])

    now, rows = None, []
    for batch in batches:
        for name, cell, here, *row in zip(*(batch.column(i).to_pylist() for i in range(13)), strict=True):
            if (name, cell, here) != now and rows:
                yield out(now[2], rows)
                rows = []
            now = (name, cell, here)
            rows.append(tuple(row))
    if rows:
        yield out(now[2], rows)


def divide_skip(query: np.ndarray, index: dict[int, list[int]], sets: list[np.ndarray]) -> list[int]:
    """Numbers of the indexed sets that link with ``query``."""
    least = -(-PERCENT * len(query) // 100)  # no set with fewer in common can link
    lists = sorted((index[t] for t in query.tolist() if t in index), key=len)
    if len(lists) < least:
        return []
    most = len(lists[-1])
    n_long = min(least - 1, int(least / (0.01 * log2(most + 1) + 1)))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    found = []
    for y, hits in groupby(merge(*short)):
        n = sum(1 for _ in hits)
        need = max(least, overlap(len(query), len(sets[y])))
        if n + n_long < need or not _close(len(query), len(sets[y])):
            continue
        for i, probed in enumerate(long):
            at = bisect_left(probed, y)
            n += at < len(probed) and probed[at] == y
            if n >= need or n + n_long - i - 1 < need:
                break
        if n >= need:
            found.append(y)
    return found


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (g1, g2, part; queries and candidates with their texts) -> links (x, y)."""
    unpack = zstandard.ZstdDecompressor().decompress

    def out(block: list[tuple[int, int, bool, bool, bytes]]) -> pa.RecordBatch:
        texts = [unpack(z) for *_, z in block]
        offsets = np.cumsum([0, *map(len, texts)])
        sets = shingle_sets(np.frombuffer(b"".join(texts), np.uint8), offsets)
        index: dict[int, list[int]] = defaultdict(list)
        for i, ((_, _, _, candidate, _), s) in enumerate(zip(block, sets, strict=True)):
            if candidate:
                for t in s.tolist():
                    index[t].append(i)
        links = [(i, j) for i, ((_, _, query, _, _), s) in enumerate(zip(block, sets, strict=True)) if query for j in divide_skip(s, index, sets) if i != j]
        columns = [[block[e[i]][k] for e in links] for i in (0, 1) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["x1", "x2", "y1", "y2"])

    now, block = None, []
    for batch in batches:
        for g1, g2, part, c1, c2, q, c, z in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
            if (g1, g2, part) != now and block:
                yield out(block)
                block = []
            now = (g1, g2, part)
            block.append((c1, c2, q, c, z))
    if block:
        yield out(block)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_k0, _k1, text) with the text compressed."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([pack(t.as_buffer()) if t.is_valid else None for t in batch.column(2)], pa.binary())], names=["_k0", "_k1", "z"])


def _links(blocks: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """Links found in blocks of (g1, g2, part, c1, c2, q, c), with the classes' texts (c1, c2, z)."""
    full = blocks.join(texts, ["c1", "c2"]).select("g1", "g2", "part", "c1", "c2", "q", "c", "z")
    full = full.repartition(n, "g1", "g2", "part").sortWithinPartitions("g1", "g2", "part", "c1", "c2")
    return full.mapInArrow(_search, "x1 long, x2 long, y1 long, y2 long")


def _pair_blocks(pairs: DataFrame) -> DataFrame:
    """Each query with its candidates (x, y, ny), dealt to parts of about ``BLOCK`` shingles."""
    degree = pairs.groupBy("x1", "x2").agg(F.ceil(F.sum("ny") / BLOCK).cast("int").alias("parts"))
    dealt = pairs.join(degree, ["x1", "x2"]).withColumn("part", F.pmod(F.hash("y1", "y2"), "parts"))
    names = lambda a, b, q: [F.col("x1").alias("g1"), F.col("x2").alias("g2"), "part", F.col(a).alias("c1"), F.col(b).alias("c2"), F.lit(q).alias("q"), F.lit(not q).alias("c")]
    asked = degree.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select(*names("y1", "y2", False)).unionByName(asked.select(*names("x1", "x2", True)))


def _dealt(members: DataFrame, n: int) -> DataFrame:
    """Members in order of list and falling shared; long lists in parts, each with the list's first member."""
    first = F.min(F.struct((-F.col("shared")).alias("o"), "c1", "c2", "n", "shared")).alias("first")
    long = members.groupBy("list").agg(F.ceil(F.count("*") / LONG).cast("int").alias("parts"), first).where("parts > 1")
    long = saved(long)
    part = F.coalesce(F.pmod(F.hash("c1", "c2"), "parts"), F.lit(0)).alias("part")
    each = members.join(long.select("list", "parts"), "list", "left").select("list", part, "c1", "c2", "n", "shared")
    heads = long.select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *(F.col(f"first.{c}") for c in ("c1", "c2", "n", "shared")))
    return each.unionByName(heads).repartition(n, "list", "part").sortWithinPartitions("list", "part", F.desc("shared"), "c1", "c2")


def _rest(members: DataFrame, node_of: DataFrame, n: int) -> DataFrame:
    """Pairs (x, y, ny) that are still open: see step 6."""
    named = members.join(node_of, ["c1", "c2"])
    per = named.groupBy("list", "component").agg(F.count("*").alias("m"))
    largest = per.groupBy("list").agg(F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("all"), F.count("*").alias("k")).where(f"k > 1 AND all > {PAIRS}")
    largest = saved(largest)  # a table of its own, so that a long list can be split in the join
    open_ = named.join(largest, "list").withColumn("q", F.col("component") != F.col("top.component")).withColumn("id", F.xxhash64("list"))
    # a class's lists, the longest first: pairs in several are then counted where they first meet
    lists = open_.groupBy("c1", "c2").agg(F.sort_array(F.collect_list(F.struct((-F.col("all")).alias("o"), "id", "times"))).alias("l")).where(F.size("l") <= MANY)
    parts = lambda of: F.ceil(of / LONG).cast("int")
    cut = open_.join(lists, ["c1", "c2"], "left").withColumns({"_ask": parts(F.col("all") - F.col("top.m")), "_all": parts(F.col("all"))})
    plain = ["id", "c1", "c2", "n", "shared", "component", "times"]
    knows = [F.col("l.id").alias("ids"), F.col("l.times").alias("weights")]
    mine = lambda of: F.pmod(F.hash("c1", "c2"), of)
    other = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1)).alias("other")
    asked = cut.where("q").select("*", other("_all")).select("list", F.concat_ws("/", mine("_ask"), "other").alias("cell"), *plain, F.lit(True).alias("a"), "q", *knows)
    given = cut.select("*", other("_ask")).select("list", F.concat_ws("/", "other", mine("_all")).alias("cell"), *plain, F.lit(False).alias("a"), "q", *knows)
    dealt = asked.unionByName(given).repartition(n, "list", "cell").sortWithinPartitions("list", "cell")
    pairs = dealt.mapInArrow(_open_pairs, "x1 long, x2 long, y1 long, y2 long, nx long, ny long, times long")
    counted = pairs.groupBy("x1", "x2", "y1", "y2", "nx", "ny").agg(F.sum("times").alias("times"))
    least = F.ceil(PERCENT * (F.col("nx") + F.col("ny")) / (100 + PERCENT)) - F.greatest(F.ceil(PERCENT * F.col("nx") / 100), F.ceil(PERCENT * F.col("ny") / 100)) + 1
    return counted.where(F.col("times") >= least).select("x1", "x2", "y1", "y2", "ny")


def _stars(edges: DataFrame) -> bool:
    """Whether every node has at most one edge to a lesser node, and that one none."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up + down > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable from every node of ``edges`` (a, b)."""
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        low = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        root = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(root, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b")
        now = saved(small.distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def link_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    rows = _linked(docs.select("doc_id", "text", *(k.alias(n) for k, n in zip((*text_key(F.col("text")), F.lit(0).cast("long")), KEYS, strict=True))))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _let_pass(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """All rows of ``docs`` whose _k0 is among ``keys``, and few others: a broadcast bitmap of ``FILTER`` bits tells before anything moves."""
    at = F.pmod("_k0", F.lit(FILTER))
    lot, place = F.bitmap_bucket_number(at), F.bitmap_bit_position(at)
    bits = keys.select(lot.alias("_lot"), place.alias("_place")).repartition("_lot").groupBy("_lot").agg(F.bitmap_construct_agg("_place").alias("_bits"))
    byte = F.conv(F.hex(F.substr("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return docs.withColumn("_lot", lot).join(F.broadcast(bits), "_lot").where(F.getbit(byte, (place % 8).cast("int")) == 1).select(*docs.columns)


def _texts(docs: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(c1, c2, z): a text, compressed, of each of ``classes``."""
    one = classes.join(rows.select("c1", "c2", "_k0", "_k1"), ["c1", "c2"]).groupBy("c1", "c2").agg(F.min(F.struct("_k0", "_k1")).alias("k"))
    one = saved(one.select("c1", "c2", "k.*"))
    packed = _let_pass(docs.select("_k0", "_k1", "text"), one).mapInArrow(_pack, "_k0 long, _k1 long, z binary")
    by_key = packed.groupBy("_k0", "_k1").agg(F.first("z").alias("z"))
    return by_key.join(one, ["_k0", "_k1"]).select("c1", "c2", "z")


def _linked(docs: DataFrame) -> DataFrame:
    """doc_id, c1, c2, n, ``KEYS``, component (a node) and component_id (its least doc_id) of (doc_id, text, ``KEYS``)."""
    spark: SparkSession = docs.sparkSession
    n = shards(docs)
    survey = saved(docs.mapInArrow(_survey, f"doc_id long, c1 long, c2 long, n long, {', '.join(f'{k} long' for k in KEYS)}, lot long, block int, counts binary"))
    rows = survey.where("block IS NULL").select("doc_id", "c1", "c2", "n", *KEYS)
    sketch = _sketch(survey.where("block IS NOT NULL").select("lot", "block", "counts"), docs.rdd.getNumPartitions())
    rank, texts = spark.sparkContext.broadcast(sketch), docs.select("text")
    twice = spark.sparkContext.broadcast(_twice(texts, rank, n))
    postings = texts.mapInArrow(_postings(rank, twice, n), "shard int, data binary")
    postings = postings.repartitionById(n, "shard").sortWithinPartitions("shard")
    lists = saved(postings.mapInArrow(_members, "list binary, c1 long, c2 long, n long, times long"))
    # shards that have the same list count together
    members = lists.groupBy("list", "c1", "c2", "n").agg(F.sum("times").alias("times"))
    members = saved(members.join(lists.groupBy("c1", "c2").agg(F.sum("times").alias("shared")), ["c1", "c2"]))
    pairs = _dealt(members, n).mapInArrow(_first_pairs, "x1 long, x2 long, y1 long, y2 long, ny long").distinct()
    # a class is a node; numbers are given once, ids only name the components at the end
    nodes = saved(rows.where("n > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("least")).withColumn("node", F.monotonically_increasing_id()))
    named = lambda e: (
        e.join(nodes.select(F.col("c1").alias("x1"), F.col("c2").alias("x2"), F.col("node").alias("a")), ["x1", "x2"])
        .join(nodes.select(F.col("c1").alias("y1"), F.col("c2").alias("y2"), F.col("node").alias("b")), ["y1", "y2"])
        .select("a", "b")
    )
    # only texts of classes in a pair are packed and move
    found = lambda pairs: _links(b := saved(_pair_blocks(pairs)), _texts(docs, rows, b.select("c1", "c2").distinct()), n)
    linked = components(named(found(saved(pairs))))
    node_of = members.select("c1", "c2").distinct().join(nodes.drop("least"), ["c1", "c2"]).join(linked, "node", "left").select("c1", "c2", F.coalesce("component", "node").alias("component"))
    rest = saved(_rest(members, node_of, n))
    if not rest.isEmpty():
        more = named(found(rest))
        linked = components(linked.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    of_class = nodes.join(linked, "node", "left").select("c1", "c2", "least", F.coalesce("component", "node").alias("component"))
    names = of_class.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = of_class.join(names, "component").select("c1", "c2", "component", "component_id")
    return rows.join(of_class, ["c1", "c2"], "left")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: of the least doc_id (nulls last), then by class, text and row.

    Rows without words stay.
    """
    text = F.coalesce("text", F.lit(""))
    marks = (*text_key(F.col("text")), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
    words, *keys = fresh(docs, "_words", *KEYS)
    keyed = docs.select("*", text.rlike(WORD).alias(words), *(m.alias(k) for m, k in zip(marks, keys, strict=True)))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "c1", "c2", *KEYS)
    bare = keyed.select("doc_id", "text", *(F.col(k).alias(name) for k, name in zip(keys, KEYS, strict=True)))
    first = _linked(bare).where("n > 0").groupBy("component").agg(F.min(order).alias("o"))
    # the text's and the row's hash name a row; doc_id is one of its columns
    chosen = first.select(*(F.col(f"o.{name}").alias(k) for k, name in zip(keys, KEYS, strict=True)))
    one = keyed.where(F.col(words)).join(chosen, keys, "left_semi").dropDuplicates(keys)
    return one.unionByName(keyed.where(~F.col(words))).select(*(F.col(f"`{c}`") for c in docs.columns))
