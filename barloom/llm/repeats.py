"""Finding repeated windows of a corpus: what suffix-array and repeated-phrase dedup share.

A window is ``width`` consecutive units (bytes or words) of one document; it repeats if the
same units also start anywhere else, in the same document included. Exactness comes from
comparing contents; hashes only bring together what must be compared.

1. Exact copies of a text are one *class* (128-bit key); a class of several rows repeats
   wholly. Everything below works on one text per class.
2. Each window picks its least ``gram``-unit hash as anchor (a minimiser): the choice depends
   on the window's content alone, so equal windows pick the same relative place. Neighbouring
   windows of one anchor form a *chunk* of at most ``chunk`` starts, keyed by the hash of the
   units which all of the chunk's possible windows share. There is about one chunk for every
   80 bytes or 14 words, not one row for each position. Texts are gone through in overlapping
   segments of ``SEGMENT`` windows, so a long text costs no more than its own bytes.
3. Chunks are dealt by key as sorted blocks of numbers, to find keys that occur at two places.
   A key that repeats already within a task's block sends one entry, so a key that holds a
   third of all rows is not one task's load. There are as many shards as the shuffle has
   partitions or the input has splits, whichever is more, and a shard is worked off in ranges
   of keys.
4. Chunks whose key repeats are cut out of their texts (the chunk's windows, overlapping as one
   string), equal ones are counted before and after a shuffle by their contents and written. The
   contents of a key meet in one task, where ``resolve`` (suffix sorting or automata) says which
   windows repeat.
5. A key with more than ``HOT`` different contents never meets in one task. Its contents become
   shorter chunks (``sub`` starts), as hashes of what their windows share; those whose hash
   occurs twice become single windows, counted by 128-bit digest with partial sums.
6. The verdicts go back to the classes, which mark covered units.

Nothing is collected to the driver or broadcast. The chunks with repeated keys, and their
contents, are written to the shared folder; later work starts from there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import fresh, saved, shards, text_key

#: Different contents of one key that are resolved together.
HOT = 512
#: Bytes of text that a task works on at once (a longer text alone), and windows or bytes of a segment of it.
SLICE, SEGMENT = 1_000_000, 1 << 16
_B = 0x9E3779B97F4A7C15
U = np.uint64


@dataclass(frozen=True)
class Kind:
    """Units and sizes: windows of ``width``, anchors of ``gram``, ``chunk`` and ``sub`` starts (below 512)."""

    words: bool
    width: int
    gram: int
    chunk: int
    sub: int


@dataclass
class Prepared:
    units: np.ndarray  # the bytes, or a hash of each word
    offsets: np.ndarray  # first unit of each document, and the end
    raw: np.ndarray  # the documents' (normalised) bytes
    begin: np.ndarray | None  # of each word in raw; a byte's place is its number
    end: np.ndarray | None

    def cut(self, a: int, b: int) -> bytes:
        return (self.raw[a:b] if self.begin is None else self.raw[self.begin[a] : self.end[b - 1]]).tobytes()


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        out, m, p = np.empty(n, U), 1, U(base)
        out[0] = 1
        with np.errstate(over="ignore"):
            while m < n:
                k = min(m, n - m)
                out[m : m + k] = out[:k] * p
                m, p = m + k, p * p
        _POWERS[base] = have = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
        x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


class Rolling:
    """Hashes of any run of units, from prefix sums."""

    def __init__(self, units: np.ndarray):
        self.inverse = _powers(pow(_B, -1, 2**64), len(units) + 1)
        self.sums = np.zeros(len(units) + 1, U)
        with np.errstate(over="ignore"):
            np.cumsum((units + U(1)) * _powers(_B, len(units) + 1)[:-1], out=self.sums[1:])

    def of(self, at: np.ndarray, n: int | np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[at + n] - self.sums[at]) * self.inverse[at])


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end, first word of each document and the end) of words between ASCII white space."""
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    begin = np.flatnonzero(first)
    return begin, np.flatnonzero(last) + 1, np.searchsorted(begin, offsets)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from its bytes alone; about ``SEGMENT`` bytes at once, a longer word by itself."""
    out, a = np.empty(len(begin), U), 0
    while a < len(begin):
        first = int(begin[a])
        b = int(np.searchsorted(end, first + SEGMENT, "right"))
        if b <= a:
            out[a] = np.frombuffer(hashlib.blake2b(data[first : end[a]], digest_size=8).digest(), U)[0]
            b = a + 1
        else:
            out[a:b] = Rolling(data[first : end[b - 1]].astype(U)).of(begin[a:b] - first, end[a:b] - begin[a:b])
        a = b
    return out


def prepare(kind: Kind, data: np.ndarray, offsets: np.ndarray, hashed: bool = True) -> Prepared:
    if not kind.words:
        return Prepared(data, offsets, data, None, None)
    begin, end, first = split_words(data, offsets)
    # the words joined by single spaces: offsets alone tell documents apart
    sizes = end - begin
    raw = np.insert(data[~_SPACE[data]], np.cumsum(sizes)[:-1], 32)
    new_begin = np.cumsum(sizes + 1) - sizes - 1
    return Prepared(word_hashes(data, begin, end) if hashed else np.empty(0, U), first, raw, new_begin, new_begin + sizes)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    y = np.concatenate([x, np.full(-n % w, 2**64 - 1, U)]).reshape(-1, w)
    ahead = np.minimum.accumulate(y, 1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


#: Bits of a place within a segment; they replace the last bits of the hashes that are compared.
_PLACE = U(20)


def chunks(kind: Kind, p: Prepared) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, windows, place of the first within its chunk) of every chunk."""
    windows = len(p.units) - kind.width + 1
    found = [_segment(kind, p, a, min(a + SEGMENT, windows)) for a in range(0, windows, SEGMENT)]
    return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.empty(0, U), *(np.empty(0, np.int64),) * 3)


def _segment(kind: Kind, p: Prepared, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``chunks`` of the windows that start from lo to hi."""
    w, k, c = kind.width, kind.gram, kind.chunk
    roll = Rolling(p.units[lo : hi + w - 1].astype(U))
    at = np.arange(hi - lo + w - k)
    least = _sliding_min((roll.of(at, k) >> _PLACE << _PLACE) | at.astype(U), w - k + 1)
    anchor = (least & ((U(1) << _PLACE) - U(1))).astype(np.int64)
    back = anchor - np.arange(len(anchor))
    lot = back // c
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (lot[1:] != lot[:-1])])
    new[p.offsets[np.searchsorted(p.offsets, lo) : np.searchsorted(p.offsets, hi)] - lo] = True  # each document begins anew
    a = np.flatnonzero(new)
    ends = p.offsets[np.searchsorted(p.offsets, a + lo, "right")]
    count = np.minimum(np.append(a[1:], len(anchor)), ends - lo - w + 1) - a  # windows that end within the document
    a, count = a[count > 0], count[count > 0]
    return roll.of(anchor[a] - c * lot[a], w - c + 1), a + lo, count, c * lot[a] + c - 1 - back[a]


def pack(at: np.ndarray, n: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (at.astype(np.int64) << 18) | (n << 9) | place


def unpack(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return x >> 18, (x >> 9) & 511, x & 511


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; nulls are empty."""
    column = column.cast(pa.string()).fill_null("") if column.null_count else column.cast(pa.string())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``SLICE`` bytes."""
    data, offsets = buffers(column)
    a, rows = 0, len(column)
    while a < rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


#: Entries that a task holds before it sends them on, and that it compares at once.
BLOCK = 300_000
_KNOWN = 1 << 62
_ENTRY = np.dtype([("key", "<i8"), ("h1", "<i8"), ("at", "<i8")])


def _runs(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct entries by key, which are a key's first, which have a key of several)."""
    e = e[np.lexsort((e["at"], e["h1"], e["key"]))]
    if not len(e):
        return e, np.empty(0, bool), np.empty(0, bool)
    first = np.concatenate([[True], e["key"][1:] != e["key"][:-1]])
    e = e[np.concatenate([[True], first[1:] | (e["at"][1:] != e["at"][:-1]) | (e["h1"][1:] != e["h1"][:-1])])]
    first = np.concatenate([[True], e["key"][1:] != e["key"][:-1]])
    run = np.cumsum(first) - 1
    return e, first, np.bincount(run)[run] > 1


def _anchor_blocks(kind: Kind, n_shards: int) -> Callable:
    """(_h1, text) -> blocks of entries by shard of their key; entries of keys that repeat within
    a block go to shards from ``n_shards`` on, and one entry of each, marked, to the key's shard."""

    def blocks(parts: list[np.ndarray]) -> pa.RecordBatch:
        e, first, known = _runs(np.concatenate(parts) if parts else np.empty(0, _ENTRY))
        sent = e[first].copy()
        sent["at"] |= np.where(known[first], _KNOWN, 0)
        where = np.concatenate([sent["key"] % n_shards, n_shards + e["h1"][known] % n_shards])
        e = np.concatenate([sent, e[known]])
        order = np.argsort(where, kind="stable")
        e, where = e[order], where[order]
        cut = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1], [True]])) if len(e) else np.zeros(1, int)
        return pa.RecordBatch.from_arrays(
            [pa.array(where[cut[:-1]], pa.int32()), pa.array([e[x:y].tobytes() for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.binary())], names=["shard", "data"]
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        for batch in batches:
            h1 = np.asarray(batch.column(0))
            for a, b, data, offsets in slices(batch.column(1)):
                p = prepare(kind, data, offsets)
                key, at, n, place = chunks(kind, p)
                doc = np.searchsorted(p.offsets, at, "right") - 1
                e = np.empty(len(key), _ENTRY)
                e["key"], e["h1"], e["at"] = key.view(np.int64), h1[a:b][doc], pack(at - p.offsets[doc], n, place)
                parts.append(e)
                if sum(map(len, parts)) >= BLOCK:
                    yield blocks(parts)
                    parts = []
        yield blocks(parts)

    return work


def _repeated(n_shards: int) -> Callable:
    """Blocks in order of shard -> entries (_h1, at, key) of repeated keys."""

    def rows(e: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(e["h1"]), pa.array(e["at"]), pa.array(e["key"])], names=["_h1", "at", "key"])

    def of_shard(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Parts are sorted by key, and keys are hashes: equal ranges of keys have about as many entries."""
        several = sum(map(len, parts)) // BLOCK + 1
        edges = [(i << 64) // several - (1 << 63) for i in range(1, several)]
        cuts = [[0, *(int(np.searchsorted(e["key"], np.int64(x))) for x in edges), len(e)] for e in parts]
        for i in range(several):
            e = np.concatenate([e[c[i] : c[i + 1]] for e, c in zip(parts, cuts, strict=True)])
            known = np.unique(e["key"][(e["at"] & _KNOWN) != 0])
            e["at"] &= ~_KNOWN
            e, _, twice = _runs(e)
            yield rows(e[twice | np.isin(e["key"], known)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                e = np.frombuffer(data.as_py(), _ENTRY)
                if shard >= n_shards:
                    yield rows(e)
                    continue
                if shard != now and parts:
                    yield from of_shard(parts)
                    parts = []
                now = shard
                parts.append(e)
        if parts:
            yield from of_shard(parts)

    return work


def _digest(*parts: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(b"".join(parts), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _each_piece(kind: Kind, batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(row, key, first window within the document, place, content) for a batch of (_h1, _h2, text, chunks)."""
    lists = batch.column(3)
    starts = np.asarray(lists.offsets)
    ats, keys = (np.asarray(lists.values.field(i)) for i in (0, 1))
    for a, b, data, offsets in slices(batch.column(2)):
        p = prepare(kind, data, offsets, hashed=False)
        for r in range(a, b):
            first, end = p.offsets[r - a], p.offsets[r - a + 1]
            mine = slice(starts[r], starts[r + 1])
            for at, n, place, key in zip(*(x.tolist() for x in (*unpack(ats[mine]), keys[mine])), strict=True):
                if first + at + n + kind.width - 1 <= end:  # entries know 64 bits of their class; a namesake's don't fit or don't match
                    yield r, key, at, place, p.cut(first + at, first + at + n + kind.width - 1)


def _contents(kind: Kind) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(seen: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([k for k, _, _ in seen], pa.int64()), pa.array([o for _, o, _ in seen], pa.int32()), pa.array([c for _, _, c in seen], pa.binary()), pa.array(list(seen.values()), pa.int64())],
                names=["key", "place", "content", "n"],
            )

        for batch in batches:
            seen: dict[tuple[int, int, bytes], int] = {}
            size = 0
            for _, key, _, place, content in _each_piece(kind, batch):
                size += (key, place, content) not in seen and len(content)
                seen[key, place, content] = seen.get((key, place, content), 0) + 1
                if size > SLICE * 4:
                    yield out(seen)
                    seen, size = {}, 0
            yield out(seen)

    return work


def _places(kind: Kind) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, int, int]] = []

            def out() -> pa.RecordBatch:
                r, at, c1, c2 = (np.array(x, np.int64) for x in (zip(*rows, strict=True) if rows else ((),) * 4))
                names = ["_h1", "_h2", "at", "c1", "c2"]
                return pa.RecordBatch.from_arrays([pa.array(np.asarray(batch.column(i))[r]) for i in (0, 1)] + [pa.array(x) for x in (at, c1, c2)], names=names)

            for r, key, at, place, content in _each_piece(kind, batch):
                rows.append((r, at, *content_id(key, place, content)))
                if len(rows) >= 50_000:
                    yield out()
                    rows.clear()
            yield out()

    return work


def content_id(key: int, place: int, content: bytes) -> tuple[int, int]:
    return _digest(key.to_bytes(8, "little", signed=True), place.to_bytes(2, "little"), content)


#: key -> [(place, content, how often)] -> for each content, which of its windows repeat.
Resolver = Callable[[Kind, list[list[tuple[int, bytes, int]]]], list[list[np.ndarray]]]
#: Bytes of contents that a task resolves at once; a key's contents stay together.
BATCH = 500_000


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes, int]]]]:
    """(key, contents) of rows in order of key."""
    now, group = None, []
    for batch in batches:
        for key, place, content, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if key != now:
                if group:
                    yield now, group
                now, group = key, []
            group.append((place, content, n))
    if group:
        yield now, group


def _windows(kind: Kind, content: bytes) -> int:
    return (content.count(b" ") + 1 if kind.words else len(content)) - kind.width + 1


def _resolved(kind: Kind, resolve: Resolver) -> Callable:
    """Contents in order of key -> (c1, c2, ranges of windows that repeat)."""

    def out(keys: list[int], groups: list[list[tuple[int, bytes, int]]]) -> pa.RecordBatch:
        ids, ranges = [], []
        for key, group, flags in zip(keys, groups, resolve(kind, groups), strict=True):
            for (place, content, _), f in zip(group, flags, strict=True):
                edge = np.flatnonzero(np.diff(np.concatenate([[0], f.astype(np.int8), [0]])))
                if len(edge):
                    ids.append(content_id(key, place, content))
                    ranges.append(edge)
        c1, c2 = zip(*ids, strict=True) if ids else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(ranges, pa.list_(pa.int32()))], names=["c1", "c2", "ranges"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, groups, size = [], [], 0
        for key, group in _groups(batches):
            keys.append(key)
            groups.append(group)
            size += sum(len(content) for _, content, _ in group)
            if size > BATCH:
                yield out(keys, groups)
                keys, groups, size = [], [], 0
        yield out(keys, groups)

    return work


def _cutter(kind: Kind, content: bytes) -> Callable[[int, int], bytes]:
    """Units from a to b of a content."""
    if not kind.words:
        return lambda a, b: content[a:b]
    words = content.split(b" ")
    return lambda a, b: b" ".join(words[a:b])


def _out(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else ((),) * len(fields), fields, strict=True)], schema=fields)


_LONG = lambda *names: pa.schema([(n, pa.int64()) for n in names])


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, place, content, n) with the content's name (c1, c2)."""
    for batch in batches:
        names = [content_id(k, p, c) for k, p, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([x[i] for x in names], pa.int64()) for i in (0, 1))], names=["key", "place", "content", "n", "c1", "c2"])


def _shorter(kind: Kind) -> Callable:
    """Named contents -> their sub-chunks (sub, c1, c2, n, first window, windows): equal windows have equal ``sub``."""
    fields, w, s = _LONG("sub", "c1", "c2", "n", "a", "m"), kind.width, kind.sub

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, place, content, n, c1, c2 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cut, count, o = _cutter(kind, content), _windows(kind, content), place
                while o < place + count:
                    stop = min(place + count, (o // s + 1) * s)
                    zero = (o // s) * s - place  # the sub-chunk's first possible window
                    rows.append((_digest(key.to_bytes(8, "little", signed=True), (o // s).to_bytes(2, "little"), cut(zero + s - 1, zero + w))[0], c1, c2, n, o - place, stop - o))
                    o = stop
                if len(rows) >= 20_000:
                    yield _out(rows, fields)
                    rows = []
            yield _out(rows, fields)

    return work


def _single(kind: Kind) -> Callable:
    """(c1, c2, content, n, sub-chunks) -> their windows (w1, w2, c1, c2, window, n)."""
    fields = _LONG("w1", "w2", "c1", "c2", "at", "n")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for c1, c2, content, n, subs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cut = _cutter(kind, content)
                rows += [(*_digest(cut(i, i + kind.width)), c1, c2, i, n) for x in subs for i in range(x["a"], x["a"] + x["m"])]
                if len(rows) >= 20_000:
                    yield _out(rows, fields)
                    rows = []
            yield _out(rows, fields)

    return work


def _by_windows(kind: Kind, contents: DataFrame) -> DataFrame:
    """Verdicts (c1, c2, ranges) on contents of hot keys: no two of them need to meet."""
    named = saved(contents.mapInArrow(_named, "key long, place int, content binary, n long, c1 long, c2 long"))
    subs = named.mapInArrow(_shorter(kind), "sub long, c1 long, c2 long, n long, a long, m long")
    # what repeats is a table of its own: joins with it can split a key that very many rows have
    again = saved(subs.groupBy("sub").agg(F.sum("n").alias("times")).where("times > 1").select("sub"))
    open_ = subs.join(again, "sub").groupBy("c1", "c2").agg(F.collect_list(F.struct("a", "m")).alias("subs"))
    windows = saved(named.join(open_, ["c1", "c2"]).select("c1", "c2", "content", "n", "subs").mapInArrow(_single(kind), "w1 long, w2 long, c1 long, c2 long, at long, n long"))
    twice = saved(windows.groupBy("w1", "w2").agg(F.sum("n").alias("times")).where("times > 1").select("w1", "w2"))
    ats = windows.join(twice, ["w1", "w2"]).groupBy("c1", "c2").agg(F.collect_list(F.col("at").cast("int")).alias("ats"))
    return ats.select("c1", "c2", F.flatten(F.transform("ats", lambda x: F.array(x, x + 1))).alias("ranges"))


def _merged(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Edges of the maximal runs that the runs from starts to ends cover."""
    if not len(starts):
        return np.empty(0, np.int64)
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    return np.column_stack([starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]]).ravel()


def _union(marks: pa.Scalar, width: int) -> np.ndarray:
    """Edges of the maximal runs of units that the marked windows cover."""
    if not marks.is_valid:
        return np.empty(0, np.int64)
    edges = np.concatenate([np.array(x["ranges"], np.int64) + x["at"] for x in marks.as_py()])
    return _merged(edges[::2], edges[1::2] + width - 1)


def _covered(kind: Kind, n: int, copies: int, marks: pa.Scalar) -> np.ndarray:
    """Edges of the runs of units to remove, of a text of n units."""
    return np.array([0, n]) if copies > 1 and n >= kind.width else _union(marks, kind.width)


def _marked(kind: Kind, keep_text: bool) -> Callable:
    """Classes -> their sizes and what is left: (_h1, _h2, n_units, n_removed, n_spans, kept_sha256, kept)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies, lists = np.asarray(batch.column(3)), batch.column(4)
            for a, b, data, offsets in slices(batch.column(2)):
                p = prepare(kind, data, offsets, hashed=False)
                rows: list[list] = [[], [], [], [], []]
                for r in range(a, b):
                    lo, hi = p.offsets[r - a], p.offsets[r - a + 1]
                    n = int(hi - lo)
                    edge = _covered(kind, n, copies[r], lists[r])
                    stay = np.concatenate([[0], edge, [n]]).reshape(-1, 2)
                    kept = (b" " if kind.words else b"").join(p.cut(lo + x, lo + y) for x, y in stay.tolist() if y > x)
                    for column, value in zip(rows, (n, int((edge[1::2] - edge[::2]).sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if keep_text else None), strict=True):
                        column.append(value)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], batch.column(1)[a:b], *(pa.array(x, t) for x, t in zip(rows, types, strict=True))],
                    names=["_h1", "_h2", "n_units", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    return work


def _left(kinds: list[Kind]) -> Callable:
    """Classes with marks of each kind -> (_h1, _h2, kept). A run of words goes from its first letter to its last."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies = np.asarray(batch.column(3))
            for a, b, data, offsets in slices(batch.column(2)):
                begin, end, first = split_words(data, offsets)
                kept = []
                for r in range(a, b):
                    lo, hi = offsets[r - a], offsets[r - a + 1]
                    runs = []
                    for k, kind in enumerate(kinds):
                        x, y = (first if kind.words else offsets)[r - a : r - a + 2]
                        edge = _covered(kind, int(y - x), copies[r], batch.column(4 + k)[r]).reshape(-1, 2)
                        if kind.words and len(edge):
                            edge = np.column_stack([begin[x + edge[:, 0]], end[x + edge[:, 1] - 1]]) - lo
                        runs.append(edge)
                    gone = _merged(*np.concatenate(runs).T)
                    stay = np.concatenate([[0], gone, [hi - lo]]).reshape(-1, 2)
                    kept.append(b"".join(data[lo + u : lo + v].tobytes() for u, v in stay.tolist()).decode("utf-8", "ignore"))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(kept, pa.string())], names=["_h1", "_h2", "kept"])

    return work


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row per document, a row per distinct text)."""
    keyed = docs.select(*text_key(F.col("text")), F.coalesce("text", F.lit("")).alias("text"))
    return keyed, keyed.groupBy("_h1", "_h2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))


def _wanted(keyed: DataFrame, texts: DataFrame, kind: Kind, n: int) -> DataFrame:
    """Distinct texts with their chunks whose keys repeat."""
    blocks = keyed.select("_h1", "text").mapInArrow(_anchor_blocks(kind, n), "shard int, data binary")
    found = blocks.repartitionById(n, "shard").sortWithinPartitions("shard").mapInArrow(_repeated(n), "_h1 long, at long, key long")
    found = saved(found)
    classes = keyed.select("_h1", "_h2").distinct()
    of_class = found.join(classes, "_h1").groupBy("_h1", "_h2").agg(F.collect_set(F.struct("at", "key")).alias("chunks"))
    # all uses of the texts have the same columns, so that one exchange of texts serves all
    return texts.join(of_class, ["_h1", "_h2"]).select("_h1", "_h2", "text", "chunks", "copies")


def _pieces(wanted: DataFrame, kind: Kind) -> DataFrame:
    return wanted.mapInArrow(_contents(kind), "key long, place int, content binary, n long")


def _marks(wanted: DataFrame, contents: DataFrame, kind: Kind, resolve: Resolver, n: int) -> DataFrame:
    """Distinct texts with the ranges of their windows that repeat, from counted contents."""
    hot = saved(contents.groupBy("key").agg(F.count("*").alias("k")).where(F.col("k") > HOT).select("key"))
    some = not hot.isEmpty()
    meet = (contents.join(hot, "key", "left_anti") if some else contents).repartition(n, "key").sortWithinPartitions("key", "place", "content")
    verdicts = meet.mapInArrow(_resolved(kind, resolve), "c1 long, c2 long, ranges array<int>")
    if some:
        verdicts = verdicts.unionByName(_by_windows(kind, contents.join(hot, "key", "left_semi").select("key", "place", "content", "n")))
    places = wanted.mapInArrow(_places(kind), "_h1 long, _h2 long, at long, c1 long, c2 long")
    return places.join(verdicts, ["c1", "c2"]).groupBy("_h1", "_h2").agg(F.collect_list(F.struct("at", "ranges")).alias("marks"))


def remove_repeats(docs: DataFrame, kind: Kind, resolve: Resolver, keep_text: bool = False) -> DataFrame:
    """One row per distinct text: _h1, _h2 (``text_key``), n_units, n_removed, n_spans, kept_sha256, kept."""
    n = shards(docs)
    keyed, texts = _keyed(docs)
    wanted = _wanted(keyed, texts, kind, n)
    contents = saved(_pieces(wanted, kind).groupBy("key", "place", "content").agg(F.sum("n").alias("n")))
    marks = _marks(wanted, contents, kind, resolve, n)
    marked = texts.join(marks, ["_h1", "_h2"], "left").select("_h1", "_h2", "text", "copies", "marks")
    return marked.mapInArrow(_marked(kind, keep_text), "_h1 long, _h2 long, n_units long, n_removed long, n_spans long, kept_sha256 string, kept string")


def cut_repeats(docs: DataFrame, kinds: list[Kind], resolve: Resolver) -> DataFrame:
    """One row per distinct text: _h1, _h2, kept; what a window of any kind covers is gone, the rest stays as it was written.

    Each kind judges the input. Texts move as often as for one kind: the contents of all are cut out in one job.
    """
    n = shards(docs)
    keyed, texts = _keyed(docs)
    wanted = [_wanted(keyed, texts, kind, n) for kind in kinds]
    pieces = [_pieces(w, kind).withColumn("kind", F.lit(k)) for k, (w, kind) in enumerate(zip(wanted, kinds, strict=True))]
    contents = saved(reduce(DataFrame.unionByName, pieces).groupBy("kind", "key", "place", "content").agg(F.sum("n").alias("n")))
    marked = texts
    for k, (w, kind) in enumerate(zip(wanted, kinds, strict=True)):
        marks = _marks(w, contents.where(F.col("kind") == k).drop("kind"), kind, resolve, n)
        marked = marked.join(marks.withColumnRenamed("marks", f"marks{k}"), ["_h1", "_h2"], "left")
    marked = marked.select("_h1", "_h2", "text", "copies", *[f"marks{k}" for k in range(len(kinds))])
    return marked.mapInArrow(_left(kinds), "_h1 long, _h2 long, kept string")


def per_document(docs: DataFrame, classes: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of every row of ``docs`` with its text's row of ``classes``."""
    rows = docs.select(*columns, *text_key(F.col("text")))
    return rows.join(classes, ["_h1", "_h2"]).drop("_h1", "_h2")


def texts_left(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``docs`` with what ``classes`` kept of each text; null texts stay null."""
    h1, h2, none, kept = fresh(docs, "_h1", "_h2", "_null", "_kept")
    key = [k.alias(n) for k, n in zip(text_key(F.col("text")), (h1, h2), strict=True)]
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "text"], F.col("text").isNull().alias(none), *key)
    rows = rows.join(classes.select(F.col("_h1").alias(h1), F.col("_h2").alias(h2), F.col("kept").alias(kept)), [h1, h2])
    return rows.select(*[F.when(~F.col(none), F.col(kept)).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
