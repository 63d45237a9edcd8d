"""Periodic runs of words, by Karp-Miller-Rosenberg naming.

A run is a stretch of consecutive words of one document that has period q (words q apart are
identical), q its smallest, at least ``LEAST`` words and two periods long, and that no neighbouring
word extends. ``collapse`` keeps a run's first period and drops its rest.

1. Words are named within their document; level k + 1 names the stretches of 2^(k+1) words by the
   pairs of names of their halves. A stretch that doesn't recur in its document gets a name of its
   own and is never sorted again, so ordinary prose costs little more than the first levels.
2. A run of period q holds two neighbouring points i and i + q of the grid of multiples of q. Every
   such pair of equal words is a candidate, for every q up to half the document.
3. From a candidate the run reaches forward as far as the stretches at i and i + q agree, and
   backward likewise: both are read off the names, from the highest level down, for ``BLOCK``
   candidates at once in NumPy. No hashes of stretches, no sorting of suffixes.
4. Of equal stretches the smallest q stays: by Fine and Wilf the others are its multiples.

Documents are worked off about ``WORDS`` words at once, a longer one alone; memory is four bytes a
word and level, and there are log2 levels of the longest repetition in it. A map over partitions:
no shuffle, nothing goes to the driver.

Defined cases: null and empty texts have no words and no run, and collapse to the empty string;
null and repeated ids pass through, each row with its own result; equal runs of several periods
can't be (the smallest counts), ties of the longest run go to the smallest start, then period; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 12
#: Words that are named together, candidates that are extended together.
WORDS, BLOCK = 1 << 17, 1 << 18
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"

#: (doc_id, number of words) -> which word stands at each place, or None for all as they are.
Rebuild = Callable[[int | None, int], np.ndarray | None]


def name_levels(names: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Names of the stretches of 2^k words at every place, as far up as any recurs in its document.

    ``names`` are words' names (different ones in different documents), ``ends`` the end of each
    word's document. A stretch that doesn't recur, or doesn't fit, is named by its place alone (below
    zero); each level has one such name more, for the place behind the last.
    """
    own = -1 - np.arange(len(names) + 1, dtype=np.int32)
    first = own.copy()
    often = np.bincount(names)[names] > 1 if len(names) else np.empty(0, bool)
    first[:-1][often] = names[often]
    levels, size = [first], 1
    at = np.flatnonzero(often)
    while True:
        now = levels[-1]
        at = at[at + 2 * size <= ends[at]]
        at = at[now[at + size] >= 0]
        pairs = now[at].astype(np.int64) * len(own) + now[at + size]
        _, name, count = np.unique(pairs, return_inverse=True, return_counts=True)
        stay = count[name] > 1
        at, name = at[stay], name[stay]
        if not len(at):
            return levels
        above = own.copy()
        above[at] = name
        levels.append(above)
        size *= 2


def common_forward(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Words that the stretches from i and from j > i have in common."""
    i, j, n = i.copy(), j.copy(), np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        step = (levels[k][i] == levels[k][j]).astype(np.int64) << k
        i += step
        j += step
        n += step
    return n


def common_backward(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Words that the stretches up to i and up to j > i have in common."""
    i, j, n = i.copy(), j.copy(), np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a = i - (1 << k)
        step = ((a >= 0) & (levels[k][a] == levels[k][j - (1 << k)])).astype(np.int64) << k
        i -= step
        j -= step
        n += step
    return n


def _grid(begins: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of all grid points that have a next one in their document, ``BLOCK`` at once."""
    half = sizes // 2
    of = np.repeat(np.arange(len(sizes)), half)
    period = np.arange(len(of)) - np.repeat(np.cumsum(half) - half, half) + 1
    count = (sizes[of] - 1) // np.maximum(period, 1)
    upto = np.cumsum(count)
    for lo in range(0, int(upto[-1]) if len(upto) else 0, BLOCK):
        hi = min(lo + BLOCK, int(upto[-1]))
        a, b = int(np.searchsorted(upto, lo, "right")), int(np.searchsorted(upto, hi, "left")) + 1
        starts = upto[a:b] - count[a:b]
        mine = np.minimum(upto[a:b], hi) - np.maximum(starts, lo)
        q = np.repeat(period[a:b], mine)
        step = np.arange(lo, hi) - np.repeat(starts, mine)
        yield np.repeat(begins[of[a:b]], mine) + step * q, q


def find(names: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Runs (start, length, period) by start, then period; starts count over all documents' words.

    ``names`` are the words' names, different ones in different documents; ``offsets`` their first words, and the end.
    """
    sizes = np.diff(offsets)
    levels = name_levels(names, np.repeat(offsets[1:], sizes))
    found = [np.empty((0, 3), np.int64)]
    for i, q in _grid(offsets[:-1], sizes):
        same = levels[0][i] == levels[0][i + q]
        i, q = i[same], q[same]
        after, before = common_forward(levels, i, i + q), common_backward(levels, i, i + q)
        long = after + before + q >= np.maximum(LEAST, 2 * q)
        found.append(np.unique(np.column_stack([i - before, after + before + q, q])[long], axis=0))
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    fresh = np.concatenate([[True], (runs[1:, :2] != runs[:-1, :2]).any(1)])[: len(runs)]
    runs = runs[fresh]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def dropped(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of n words a run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge)[:n] > 0


def _batch(ids: list, words: list[list[bytes]], rebuild: Rebuild | None) -> pa.RecordBatch:
    offsets = np.cumsum([0, *map(len, words)])
    names, base = [], 0
    for at, (doc, mine) in enumerate(zip(ids, words, strict=True)):
        known: dict[bytes, int] = {}
        name = np.fromiter((known.setdefault(w, len(known)) for w in mine), np.int64, len(mine))
        places = rebuild(doc, len(mine)) if rebuild else None
        if places is not None:
            words[at], name = [mine[i] for i in places.tolist()], name[places]
        names.append(name + base)
        base += len(known)
    runs = find(np.concatenate(names), offsets)
    cuts = np.searchsorted(runs[:, 0], offsets)
    texts = []
    for k, mine in enumerate(words):
        own = runs[cuts[k] : cuts[k + 1]]
        own[:, 0] -= offsets[k]
        gone = dropped(own, len(mine)) if len(own) else None
        texts.append(b" ".join(mine if gone is None else (w for w, g in zip(mine, gone.tolist(), strict=True) if not g)).decode())
    fields = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(runs[:, c])) for c in range(3)], names=["start", "length", "period"])
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), fields), pa.array(texts, pa.string())],
        names=["doc_id", "n_words", "runs", "collapsed"],
    )


def find_runs(docs: DataFrame, rebuild: Rebuild | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, runs (by start, then period) and the collapsed text.

    ``rebuild`` says which words a document consists of before its runs are looked for.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        words: list[list[bytes]] = []
        held = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                # bytes split at ASCII white space: exactly the words of ``common.WORD``
                mine = text.as_buffer().to_pybytes().split() if text.is_valid else []
                if ids and held + len(mine) > WORDS:
                    yield _batch(ids, words, rebuild)
                    ids, words, held = [], [], 0
                ids.append(doc)
                words.append(mine)
                held += len(mine)
        if ids:
            yield _batch(ids, words, rebuild)

    return docs.select("doc_id", "text").mapInArrow(work, SCHEMA)


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The contract's rebuilding: in a tenth of the documents, by crc32, words from a on repeat with period p; a null id has none."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns, from runs and collapsed texts."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n", "")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))))
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), sha(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))
    return out.select(
        "doc_id", "n_runs", (-F.col("b.before")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.shorter")).alias("period"),
        F.floor(1000 * F.col("b.length") / (-F.col("b.shorter"))).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
