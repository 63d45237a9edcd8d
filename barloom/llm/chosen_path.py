"""MinHash near-duplicates by a chosen-path set similarity join, and the components of the links.

A document's set holds the 64-bit hashes of its distinct 4-word shingles (fewer words: the whole
sequence is the one shingle). Two documents link when 100 * |A and B| >= 80 * |A or B|; every link
is confirmed on full sets.

1. Documents with one set are one class, a *vertex*. Its least hashes under ``COORDINATES`` functions
   are its minwise tokens; a byte of each makes a sketch.
2. ``TREES`` independent trees branch the vertices. A node selects one coordinate, and in one of
   ``1 / (1 / 0.8 - 1)`` nodes a second, so that it has 1 / 0.8 on average; each value of a selected
   token is a child. A pair of similarity s goes on to s / 0.8 children: at 0.8 or more it doesn't
   die out as a rule, below it does. ``miss`` gives the chance that a tree misses a pair.
3. In the nodes of the first level, members whose sketches agree are paired with the first such
   member, the *leader*; nodes beyond ``SMALL`` members are worked off in parts, each with the node's
   first member. These pairs are confirmed and give components.
4. Only nodes with members of several components are open; the members outside a node's largest
   component *ask*. A node with up to ``SMALL`` of them is compared exhaustively, in cells: those that
   ask against all, in parts of ``SMALL``. A node with more branches again; at ``DEPTH`` it is compared
   too, its asking members in parts.
5. First each one's ``BEST`` candidates by sketch are confirmed and the components brought up to date.
   In the cells that are still open all members whose sketches agree with one of another component
   are then compared on their full sets; a pair is skipped when links found before in the same cell
   already join it.
6. Components: the star steps of the Jaccard join.

So a hot group costs a star in each node that holds it, never its pairs; no link between components
is left out of a node. What is missed are pairs that no tree keeps together (at 0.8 sharp under
0.00001 for a pair that meets in first-level nodes, 0.003 at full depth) and pairs whose sketches agree
in fewer than ``AGREE`` places (0.00003 at 0.8). Nothing goes to the driver but whether a table has rows.

Defined cases: null texts and texts without words have n_shingles 0, are their own component and are
kept; the vertices are sets, so rows that share a doc_id or have none are linked by their texts
alone; null ids are never the smallest, a component without any id has component_id null, and its rows
are kept; rows that share an id and a component share ``kept``; a text of any length is worked
through; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import saved, shards, text_key
from barloom.llm.jaccard import class_of, components, shingle_sets
from barloom.llm.repeats import mix, slices

WORDS, PERCENT = 4, 80
COORDINATES, TREES, DEPTH, SMALL = 128, 8, 5, 512
#: Least number of equal bytes in the sketches of a pair that is confirmed.
AGREE = 84
#: One node in so many selects a second coordinate.
SECOND = 4
#: Shingles that are confirmed in a block, hashes that are minimised at once, candidates of a vertex that are confirmed first.
BLOCK, AT_ONCE, BEST = 100_000, 1 << 16, 4
U = np.uint64
_SEEN = ("v", "n", "component", "sketch")
_SEEDS = mix(np.arange(1, 2 * COORDINATES + 1, dtype=U) * U(0x9E3779B97F4A7C15))
_XOR, _TIMES = _SEEDS[:COORDINATES], _SEEDS[COORDINATES:] | U(1)


def miss(similarity: float, depth: int) -> float:
    """The chance that a pair isn't together in any node of one tree at this depth."""
    q, s, two = 0.0, similarity, 1 / SECOND
    for _ in range(depth):
        one = (1 - s) + s * q
        q = (1 - two) * one + two * one**2
    return q


def least_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, COORDINATES): the least value of each hash function over each set; none of them is empty."""
    out = np.empty((len(sets), COORDINATES), U)
    a = 0
    while a < len(sets):
        b, size = a, 0
        while b < len(sets) and (b == a or size + len(sets[b]) <= AT_ONCE):
            size += len(sets[b])
            b += 1
        x = np.concatenate(sets[a:b])
        starts = np.cumsum([0, *map(len, sets[a : b - 1])])
        with np.errstate(over="ignore"):
            for k in range(COORDINATES):
                out[a:b, k] = np.minimum.reduceat((x ^ _XOR[k]) * _TIMES[k], starts)
        a = b
    return out


def selected(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first coordinate, whether there is a second, second coordinate) that each node selects."""
    h = mix(nodes)
    return (h % U(COORDINATES)).astype(np.int64), (h >> U(20)) % U(SECOND) == 0, ((h >> U(32)) % U(COORDINATES)).astype(np.int64)


def children(nodes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child) of every row's node and its values (rows, COORDINATES)."""
    first, two, second = selected(nodes)
    rows = np.arange(len(nodes))
    again = np.flatnonzero(two)
    row = np.concatenate([rows, again])
    at = np.concatenate([first, second[again]])
    with np.errstate(over="ignore"):
        return row, mix(mix(nodes[row] + U(1)) ^ mix(values[row, at].astype(U) * U(COORDINATES) + at.astype(U)))


ROOTS = mix(np.arange(1, TREES + 1, dtype=U) * U(0xD1B54A32D192ED03))


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, _h1, _h2, text) -> (doc_id, _h1, _h2, c1, c2, n, sketch, nodes of the first level)."""
    for batch in batches:
        for a, b, data, offsets in slices(batch.column(3)):
            sets = shingle_sets(data, offsets, WORDS)
            full = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
            values = least_hashes([sets[i] for i in full.tolist()])
            sketch = (mix(values) & U(255)).astype(np.uint8)
            found = [children(np.full(len(full), r, U), values) for r in ROOTS]
            row, nodes = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            row, nodes = full[row], nodes[np.argsort(full[row], kind="stable")].view(np.int64)
            per = np.bincount(row, minlength=b - a)
            sketches, keys = [None] * (b - a), [(None, None)] * (b - a)
            for i, x in zip(full.tolist(), sketch, strict=True):
                sketches[i], keys[i] = x.tobytes(), class_of(sets[i])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[a:b], batch.column(1)[a:b], batch.column(2)[a:b], *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)), pa.array([len(s) for s in sets], pa.int64()), pa.array(sketches, pa.binary()), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per)), pa.int32()), pa.array(nodes))],
                names=["doc_id", "_h1", "_h2", "c1", "c2", "n", "sketch", "nodes"],
            )


class _Group:
    """Members of a node: vertices, set sizes, sketches, components."""

    def __init__(self, rows: list[tuple]):
        v, n, component, sketch = zip(*rows, strict=True)
        self.v, self.n, self.component = (np.array(x, np.int64) for x in (v, n, component))
        self.sketch = np.frombuffer(b"".join(sketch), np.uint8).reshape(len(rows), COORDINATES)

    def agree(self, i: int, others: np.ndarray) -> np.ndarray:
        """In how many places the sketches of ``others`` agree with i's; 0 where the sizes can't link."""
        near = 100 * np.minimum(self.n[others], self.n[i]) >= PERCENT * np.maximum(self.n[others], self.n[i])
        return np.where(near, (self.sketch[others] == self.sketch[i]).sum(1), 0)

    def candidates(self, i: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of ``others``, of another component, that agree with i, the most alike first, and in how many places."""
        others = others[self.component[others] != self.component[i]]
        like = self.agree(i, others)
        others, like = others[like >= AGREE], like[like >= AGREE]
        order = np.argsort(-like, kind="stable")
        return others[order], like[order]


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of sorted batches whose first ``keys`` columns are the key."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != now:
                if rows:
                    yield now, rows
                now, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield now, rows


def _pairs_out(pairs: set[tuple[int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*sorted(pairs), strict=True)) if pairs else [()] * 3
    pairs.clear()
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["x", "y", "ny"])


def _leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, part, v, n, component, sketch) in order of node, part and v -> pairs (x, y, ny) of leaders and members."""
    pairs: set[tuple[int, int, int]] = set()
    for _, rows in _grouped(batches, 2):
        g = _Group(rows)
        left = np.flatnonzero(np.append(True, g.v[1:] != g.v[:-1]))  # a part's own first member may be the node's
        while len(left) > 1:
            first, rest = int(left[0]), left[1:]
            mine = g.agree(first, rest) >= AGREE
            pairs.update((int(g.v[first]), int(g.v[i]), int(g.n[i])) for i in rest[mine].tolist())
            left = rest[~mine]
        if len(pairs) > 50_000:
            yield _pairs_out(pairs)
    yield _pairs_out(pairs)


_MEMBER = pa.schema([("node", pa.int64()), ("cell", pa.string()), ("asks", pa.bool_()), ("v", pa.int64()), ("n", pa.int64()), ("component", pa.int64()), ("sketch", pa.binary())])


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells (node, cell, asks, v, n, component, sketch) in order -> the members that agree with one of another component."""
    out: list[tuple] = []

    def sent() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [()] * len(_MEMBER)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _MEMBER, strict=True)], schema=_MEMBER)

    for key, rows in _grouped(batches, 2):
        g, asks = _Group([r[1:] for r in rows]), np.array([r[0] for r in rows], bool)
        want, given = np.zeros(len(rows), bool), np.flatnonzero(~asks)
        for i in np.flatnonzero(asks).tolist():
            hit, _ = g.candidates(i, given)
            want[hit] = True
            want[i] = len(hit) > 0
        out += [(*key, *rows[i]) for i in np.flatnonzero(want).tolist()]
        if len(out) > 20_000:
            yield sent()
    yield sent()


def _links_out(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[i] for e in links], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _sets(texts: list[bytes]) -> list[np.ndarray]:
    unpack = zstandard.ZstdDecompressor().decompress
    plain = [unpack(z) for z in texts]
    return shingle_sets(np.frombuffer(b"".join(plain), np.uint8), np.cumsum([0, *map(len, plain)]), WORDS)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The exact test on two sorted sets."""
    common = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def _exhaust(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wanted members of cells with texts (node, cell, asks, v, n, component, sketch, z) -> links (a, b) of components, which are nodes, too."""
    for _, rows in _grouped(batches, 2):
        g, sets = _Group([r[1:5] for r in rows]), _sets([r[5] for r in rows])
        asks = np.array([r[0] for r in rows], bool)
        given = np.flatnonzero(~asks)
        found = [(-n, i, j) for i in np.flatnonzero(asks).tolist() for j, n in zip(*(x.tolist() for x in g.candidates(i, given)), strict=True)]
        component = g.component.tolist()
        into = {c: c for c in g.component.tolist()}

        def top(c: int) -> int:
            while into[c] != c:
                c = into[c]
            return c

        links = []
        for _, i, j in sorted(found):  # the most alike first
            a, b = top(component[i]), top(component[j])
            if a != b and linked(sets[i], sets[j]):
                links.append((component[i], component[j]))
                into[a] = b
        yield _links_out(links)


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells in order -> pairs (x, y, ny): for each that asks its ``BEST`` candidates."""
    pairs: set[tuple[int, int, int]] = set()
    for _, rows in _grouped(batches, 2):
        g, asks = _Group([r[1:] for r in rows]), np.array([r[0] for r in rows], bool)
        given = np.flatnonzero(~asks)
        for i in np.flatnonzero(asks).tolist():
            pairs.update((int(g.v[i]), int(g.v[j]), int(g.n[j])) for j in g.candidates(i, given)[0][:BEST].tolist())
            if len(pairs) > 50_000:
                yield _pairs_out(pairs)
    yield _pairs_out(pairs)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (x, part, asks, v, z), the asking vertex first -> links."""
    for _, rows in _grouped(batches, 2):
        sets = _sets([r[2] for r in rows])
        yield _links_out([(rows[0][1], r[1]) for r, s in zip(rows[1:], sets[1:], strict=True) if linked(sets[0], s)])


def _branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, v, n, component, sketch) -> the same of the children."""
    for batch in batches:
        if batch.num_rows:
            sketch = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, COORDINATES)
            row, node = children(np.asarray(batch.column(0)).view(U), sketch)
            rest = pa.RecordBatch.from_arrays(batch.columns[1:], names=_SEEN).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), *rest.columns], names=["node", *_SEEN])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([pack(t.as_buffer()) if t.is_valid else pack(b"") for t in batch.column(2)], pa.binary())], names=["_h1", "_h2", "z"])


def _with_texts(df: DataFrame, texts: DataFrame) -> DataFrame:
    """``df`` with the text z of each v; texts that aren't asked for stay where they are while few are."""
    return df.join(texts.join(saved(df.select("v").distinct()), "v", "left_semi"), "v")


def _confirmed(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """Links (a, b) among pairs (x, y, ny): x meets its candidates in blocks of about ``BLOCK`` shingles."""
    pairs = saved(pairs)
    parts = saved(pairs.groupBy("x").agg(F.ceil(F.sum("ny") / BLOCK).cast("int").alias("parts")))
    given = pairs.join(parts, "x").select("x", F.pmod(F.hash("y"), "parts").alias("part"), F.lit(False).alias("asks"), F.col("y").alias("v"))
    asked = parts.select("x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("asks"), F.col("x").alias("v"))
    blocks = _with_texts(saved(given.unionByName(asked)), texts).select("x", "part", "asks", "v", "z")
    return saved(blocks.repartition(n, "x", "part").sortWithinPartitions("x", "part", F.desc("asks")).mapInArrow(_confirm, "a long, b long"))


def _first_pairs(live: DataFrame, n: int) -> DataFrame:
    plain = ["v", "n", F.lit(0).cast("long").alias("component"), "sketch"]
    parts = F.ceil(F.col("m") / SMALL).cast("int")
    heads = live.where((F.col("m") > SMALL) & (F.col("v") == F.col("head"))).select("node", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), *plain)
    dealt = live.select("node", F.pmod(F.hash("v"), parts).alias("part"), *plain).unionByName(heads).repartition(n, "node", "part").sortWithinPartitions("node", "part", "v")
    return dealt.mapInArrow(_leaders, "x long, y long, ny long").distinct()


def _labelled(rows: DataFrame, now: DataFrame) -> DataFrame:
    """``rows`` with the components of ``now``."""
    told = rows.drop("component").join(now.select(F.col("node").alias("v"), "component"), "v", "left")
    return told.withColumn("component", F.coalesce("component", "v")).select("node", *_SEEN)


def _open(rows: DataFrame) -> DataFrame:
    """Members (node, v, n, component, sketch) of nodes with several components, with all (m) and those outside the largest (k)."""
    of = rows.groupBy("node", "component").agg(F.count("*").alias("c"))
    stat = of.groupBy("node").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("m"), F.count("*").alias("several")).where("several > 1")
    stat = saved(stat.select("node", "m", (F.col("m") - F.col("top.c")).alias("k"), F.col("top.component").alias("main")))
    return saved(rows.join(stat, "node").select("node", "m", "k", "main", *_SEEN))


def _dealt(open_: DataFrame, n: int) -> DataFrame:
    """Open nodes in cells (node, cell, asks, v, n, component, sketch): parts of those that ask against parts of all."""
    parts = lambda of: F.greatest(F.lit(1), F.ceil(F.col(of) / SMALL)).cast("int")
    mine = lambda of: F.pmod(F.hash("v"), parts(of))
    every = lambda of: F.explode(F.sequence(F.lit(0), parts(of) - 1)).alias("other")
    asked = open_.where("component <> main").select("*", every("m")).select("node", F.concat_ws("/", mine("k"), "other").alias("cell"), F.lit(True).alias("asks"), *_SEEN)
    given = open_.select("*", every("k")).select("node", F.concat_ws("/", "other", mine("m")).alias("cell"), F.lit(False).alias("asks"), *_SEEN)
    return asked.unionByName(given).repartition(n, "node", "cell").sortWithinPartitions("node", "cell", "v")


_CELL = "node long, cell string, asks boolean, v long, n long, component long, sketch binary"


def _joined(now: DataFrame, links: DataFrame) -> DataFrame:
    """The components of ``now`` after ``links``."""
    if links.isEmpty():
        return now
    return components(now.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))


def link_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    n = shards(docs)
    keyed = docs.select("doc_id", *text_key(F.col("text")), "text")
    survey = saved(keyed.mapInArrow(_survey, "doc_id long, _h1 long, _h2 long, c1 long, c2 long, n long, sketch binary, nodes array<long>"))
    one = survey.where("n > 0").groupBy("c1", "c2").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("nodes").alias("nodes"), F.min("doc_id").alias("least"), F.min(F.struct("_h1", "_h2")).alias("key"))
    vertices = saved(one.withColumn("v", F.monotonically_increasing_id()))
    members = vertices.select(F.explode("nodes").alias("node"), "v")
    sizes = saved(members.groupBy("node").agg(F.count("*").alias("m"), F.min("v").alias("head")).where("m > 1"))
    live = saved(members.join(sizes, "node").join(vertices.select("v", "n", "sketch"), "v"))
    needed = live.select("v").distinct().join(vertices.select("v", "key.*"), "v")
    packed = keyed.select("_h1", "_h2", "text").mapInArrow(_pack, "_h1 long, _h2 long, z binary").groupBy("_h1", "_h2").agg(F.first("z").alias("z"))
    texts = saved(packed.join(needed, ["_h1", "_h2"]).select("v", "z"))
    now = components(_confirmed(_first_pairs(live, n), texts, n))
    ready, rows = [], _labelled(live, now)
    for level in range(1, DEPTH + 1):
        open_ = _open(rows)
        closing = F.col("k") <= (SMALL if level < DEPTH else F.col("k"))
        ready.append(open_.where(closing))
        large = open_.where(~closing).select("node", *_SEEN)
        if large.isEmpty():
            break
        rows = saved(large.mapInArrow(_branch, "node long, v long, n long, component long, sketch binary"))
    ready = reduce(DataFrame.unionByName, ready)
    now = _joined(now, _confirmed(_dealt(ready, n).mapInArrow(_best, "x long, y long, ny long").distinct(), texts, n))
    wanted = saved(_dealt(_open(_labelled(ready, now)), n).mapInArrow(_wanted, _CELL))
    full = _with_texts(wanted, texts).select(*_MEMBER.names, "z").repartition(n, "node", "cell").sortWithinPartitions("node", "cell", "v")
    now = _joined(now, saved(full.mapInArrow(_exhaust, "a long, b long")))
    told = vertices.select("c1", "c2", "v", "least").join(now.withColumnRenamed("node", "v"), "v", "left").withColumn("component", F.coalesce("component", "v"))
    names = told.groupBy("component").agg(F.min("least").alias("component_id"))
    told = told.join(names, "component").select("c1", "c2", "component_id")
    rows = survey.select("doc_id", "c1", "c2", "n").join(told, ["c1", "c2"], "left")
    name = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), name.alias("component_id"), F.col("doc_id").eqNullSafe(name).alias("kept"))
