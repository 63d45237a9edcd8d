"""Prefix trie of conversations, by smallest-member ownership.

A node is a distinct sequence of first turns (role, text); the root has none. Its members are the
conversations that start with it; the smallest member owns it. A conversation that owns a node owns
all that follow on its path, so it owns a suffix of its path. Sums over a node's subtree then need no
walk of the tree: every node of the subtree lies on the path of a member of it, and is owned by one.

1. Turns become 128-bit marks of role and text, and code points of the text; the texts move no
   further. Rows are dealt to ranges of (conversation, turn), *blocks*: the places of a long
   conversation's turns are counted block by block, and each block starts from its predecessors' sums.
2. A prefix is keyed by its depth and 128 bits: the exclusive or of its turns' marks, each hashed
   with its place. That, and the code points so far, are window sums inside a block.
3. Prefixes of several conversations are counted (first group-by): owner, members, ends. Windows and
   partial sums tell every conversation how much of its path it doesn't own. Of the shared prefixes
   only those that hold a thousandth of all rows (1,000 at most) are broadcast, so that no key of
   the joins is hot.
4. One group-by by prefix then adds up, over the members: code points of the path from here on, less
   those of owned nodes; leaves and children that a member owns.
5. Ends of a node are hashed in order, in pieces that ranges of rows prepare; a node with one end needs none.

Defined cases: null role or text is empty; turns sort by turn (null first), ties by their marks, and
all count; rows without a conv_id form one conversation, which is never the smallest of several, is in
no digest of ends, and isn't rebuilt; repeated rows are turns of their own; a conversation without turns
is a member of the root; an empty table has no root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import partitions, saved

#: A conversation: whether it has no id, and its id.
C = ("none", "c")
NODE = ("depth", "k1", "k2")
#: A prefix with more than one of so many parts of all rows is broadcast: there are no more than that.
SHARE = 1000
#: Characters of a piece of joined ends.
PIECE = 1 << 20
FIRST = 5


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(F.coalesce(b, F.lit(0).cast("long")))


def _before(column: Column, *key: str) -> Column:
    """``column`` aggregated over the blocks of a conversation that stand before."""
    return column.over(Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))


def turns_of(rows: DataFrame) -> DataFrame:
    """(none, c, block, at, m1, m2, tokens): every turn with its place in its conversation, from 0."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    marks = rows.select(
        F.col("conv_id").isNull().alias("none"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("c"), "turn",
        F.xxhash64(role, text).alias("m1"), F.xxhash64(F.lit("second"), text, role).alias("m2"), F.length(text).cast("long").alias("tokens"),
    )
    marks = saved(marks)
    n = partitions(rows.sparkSession)
    # the ranges are drawn by sampling: only what is written keeps its block
    dealt = saved(marks.repartitionByRange(n, *C, "turn", "m1", "m2").withColumn("block", F.spark_partition_id()))
    sizes = dealt.groupBy(*C, "block").agg(F.count("*").alias("n"))
    sizes = sizes.select(*C, "block", F.coalesce(_before(F.sum("n"), *C), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy(*C, "block").orderBy("turn", "m1", "m2"))
    return dealt.withColumn("place", place).join(sizes, [*C, "block"]).select(*C, "block", (F.col("base") + F.col("place") - 1).alias("at"), "m1", "m2", "tokens")


def conversations_of(turns: DataFrame) -> DataFrame:
    return turns.select(*C).distinct()


def rebuild(turns: DataFrame) -> DataFrame:
    """The contract's conversations: the first h turns come from conversation c - c % 100, h = crc32(c) % 6.

    Only ids travel: at most ``FIRST`` turns of every hundredth conversation, to that hundred's.
    """
    h = F.when(F.col("none"), F.lit(0)).otherwise(F.crc32(F.col("c").cast("string").cast("binary")) % 6)
    heads = saved(turns.where(f"NOT none AND c % 100 = 0 AND at < {FIRST}").select(F.col("c").alias("base"), "at", "m1", "m2", "tokens"))
    there = heads.groupBy("base").agg(F.count("*").alias("has"))
    blocks = saved(turns.select(*C, "block").distinct())
    known = blocks.select("*", (F.col("c") - F.col("c") % 100).alias("base"), h.alias("h")).join(there, "base", "left")
    known = known.withColumn("m", F.least("h", F.coalesce("has", F.lit(0))))
    own = turns.join(known, [*C, "block"]).where("at >= h").select(*C, "block", (F.col("m") + F.col("at") - F.col("h")).alias("at"), "m1", "m2", "tokens")
    lent = known.where("m > 0").select(*C, "base", "m").distinct().join(heads, "base").where("at < m")
    return own.unionByName(lent.select(*C, F.lit(-1).alias("block"), "at", "m1", "m2", "tokens"))


def _occurrences(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(every conversation's prefixes with at least one turn, blocks of conversations)."""
    each = saved(turns.select(*C, "block", (F.col("at") + 1).alias("depth"), F.xxhash64("at", "m1", "m2").alias("e1"), F.xxhash64(F.lit("second"), "at", "m2", "m1").alias("e2"), "tokens"))
    sums = each.groupBy(*C, "block").agg(F.bit_xor("e1").alias("e1"), F.bit_xor("e2").alias("e2"), F.sum("tokens").alias("tokens"), F.max("depth").alias("last"))
    base = sums.select(
        *C, "block", _before(F.bit_xor("e1"), *C).alias("b1"), _before(F.bit_xor("e2"), *C).alias("b2"), _before(F.sum("tokens"), *C).alias("before"),
        F.max("last").over(Window.partitionBy(*C)).alias("length"),
    )
    base = saved(base)
    upto = Window.partitionBy(*C, "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    inside = each.select(*C, "block", "depth", F.bit_xor("e1").over(upto).alias("k1"), F.bit_xor("e2").over(upto).alias("k2"), F.sum("tokens").over(upto).alias("p"), "tokens")
    found = inside.join(base, [*C, "block"]).select(
        *C, "block", "depth", _xor(F.col("k1"), F.col("b1")).alias("k1"), _xor(F.col("k2"), F.col("b2")).alias("k2"),
        (F.col("p") - F.col("tokens") + F.coalesce("before", F.lit(0))).alias("before"), "tokens", "length", (F.col("depth") == F.col("length")).alias("last"),
    )
    return saved(found), base.select(*C, "block")


def _id() -> Column:
    return F.when(~F.col("none"), F.col("c"))


def _marked(found: DataFrame) -> DataFrame:
    """``found`` with the owner of each prefix, whether the conversation owns it, whether it is a leaf, and its ends."""
    shared = saved(found.groupBy(*NODE).agg(F.count("*").alias("n"), F.min(_id()).alias("owner"), F.count_if("last").alias("ends")).where("n > 1"))
    hot = F.broadcast(shared.where(F.col("n") * SHARE > found.count()))
    cold = shared.where(F.col("n") * SHARE <= found.count())
    told = found.join(hot, list(NODE)).unionByName(found.join(hot, list(NODE), "left_anti").join(cold, list(NODE), "left"))
    owned = F.col("n").isNull() | F.col("owner").eqNullSafe(_id())
    return told.withColumns({"owned": owned, "leaf": F.col("last") & owned & (F.col("n").isNull() | (F.col("n") == F.col("ends"))), "owner": F.when(F.col("n").isNull(), _id()).otherwise(F.col("owner"))})


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(depth, k1, k2, c) in order -> (depth, k1, k2, first, joined): a prefix's ids, comma-joined, ``PIECE`` characters at once."""
    now, first, ids, size, rows = None, None, [], 0, []

    def out() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (*(pa.int64(),) * 4, pa.string()), strict=True)], names=[*NODE, "first", "joined"])

    for batch in batches:
        for *node, c in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if ids and (node != now or size > PIECE):
                rows.append((*now, first, ",".join(ids)))
                ids, size = [], 0
            if not ids:
                now, first = node, c
            ids.append(str(c))
            size += len(ids[-1]) + 1
        if sum(len(r[4]) for r in rows) > PIECE or len(rows) > 10_000:
            yield out()
    if ids:
        rows.append((*now, first, ",".join(ids)))
    yield out()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order of prefix and first id -> (depth, k1, k2, ends_sha256)."""
    now, digest, rows = None, None, []
    for batch in batches:
        for *node, joined in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
            if node != now:
                if now is not None:
                    rows.append((*now, digest.hexdigest()))
                now, digest = node, hashlib.sha256(joined.encode())
            else:
                digest.update(b"," + joined.encode())
        if len(rows) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=[*NODE, "ends_sha256"])
            rows = []
    if now is not None:
        rows.append((*now, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=[*NODE, "ends_sha256"])


def _end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids of each prefix's ends (depth, k1, k2, c), ascending and comma-joined."""
    n = partitions(ends.sparkSession)
    dealt = saved(ends).repartitionByRange(n, *NODE, "c").sortWithinPartitions(*NODE, "c")
    pieces = dealt.mapInArrow(_pieces, "depth long, k1 long, k2 long, first long, joined string")
    return pieces.repartition(n, *NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_hashed, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` are those of ``turns_of``; ``conversations`` (none, c) are all there are, also those without a turn.
    """
    found, blocks = _occurrences(turns)
    marked = saved(_marked(found))
    # what a conversation doesn't own: so many first nodes, their code points, the last one's owner
    foreign = F.col("owned") == F.lit(False)
    path = marked.groupBy(*C).agg(
        F.count_if(foreign).alias("u"), F.coalesce(F.max(F.when(foreign, F.col("before") + F.col("tokens"))), F.lit(0)).alias("pu"),
        F.max_by("owner", F.when(foreign, F.col("depth"))).alias("above"), F.max(F.col("leaf").cast("long")).alias("leaves"), F.max("length").alias("length"),
    )
    path = saved(path)
    root = conversations.join(path, list(C), "left").agg(
        F.min(_id()).alias("conv_id"), F.count("*").alias("n_convs"), F.count_if(F.col("u") == 0).alias("n_children"), F.sum(F.coalesce("leaves", F.lit(0))).alias("n_leaves"), F.sum(F.coalesce("pu", F.lit(0))).alias("saved_tokens"),
        F.count_if(F.col("length").isNull() & ~F.col("none")).alias("n_ends"), F.min(F.when(F.col("length").isNull(), _id())).alias("end"),
    )
    root = root.where("n_convs > 0").select(
        *(F.lit(0).cast("long").alias(k) for k in NODE), "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children",
        F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), "saved_tokens", "n_ends", "end",
    )
    top = conversations.agg(F.min(_id())).first()[0]  # one number: the root's owner
    whole = marked.select(*C, "block", *NODE, "before", "last").join(blocks.join(path, list(C)), [*C, "block"])
    d, u = F.col("depth"), F.col("u")
    above = F.when(d == 1, F.lit(top).cast("long")).when(d == u + 1, F.col("above")).otherwise(_id())
    nodes = whole.groupBy(*NODE).agg(
        F.min(_id()).alias("conv_id"), F.max(F.when(d > u, above)).alias("parent_conv_id"), F.count("*").alias("n_convs"), F.count_if((d < F.col("length")) & (d >= u)).alias("n_children"),
        F.sum("leaves").alias("n_leaves"), F.sum(F.when(d > u, F.lit(0)).otherwise(F.col("pu") - F.col("before"))).alias("saved_tokens"),
        F.count_if(F.col("last") & ~F.col("none")).alias("n_ends"), F.min(F.when(F.col("last"), _id())).alias("end"),
    )
    several = marked.where("last AND NOT none AND ends > 1").select(*NODE, "c")
    turnless = conversations.join(path, list(C), "left_anti").where("NOT none").select(*(F.lit(0).cast("long").alias(k) for k in NODE), "c")
    nodes = nodes.unionByName(root).join(_end_digests(several.unionByName(turnless)), list(NODE), "left")
    one = F.sha2(F.encode(F.when(F.col("n_ends") == 0, "").otherwise(F.col("end").cast("string")), "UTF-8"), 256)
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.when(F.col("n_ends") > 1, F.col("ends_sha256")).otherwise(one).alias("ends_sha256"))


#: The contract's rows in SQL. CRC-32 is worked out bit by bit; 3988292384 is its polynomial.
ORACLE = """WITH src AS (
    SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i
    FROM conversations
), ids AS (
    SELECT c, c - c % 100 AS base, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: ord(x)::BIGINT)),
        lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 6 AS h
    FROM (SELECT DISTINCT c FROM src)
), turns AS (
    SELECT ids.c, 0 AS own, i, role, text FROM ids JOIN src ON src.c = ids.base AND i < h
    UNION ALL SELECT ids.c, 1, i, role, text FROM ids JOIN src ON src.c = ids.c AND i >= h
), placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY own, i) AS depth FROM turns),
paths AS (
    SELECT c, depth, sha256(string_agg(sha256(role) || sha256(text), '') OVER (PARTITION BY c ORDER BY depth)) AS node, length(text) AS tokens FROM placed
    UNION ALL SELECT c, 0, '', 0 FROM ids
), steps AS (
    SELECT *, lag(node) OVER (PARTITION BY c ORDER BY depth) AS parent, depth = max(depth) OVER (PARTITION BY c) AS ends FROM paths
), nodes AS (
    SELECT node, depth, min(c) AS conv_id, min(parent) AS parent, count(*) AS n_convs, min(tokens) AS tokens,
        sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
    FROM steps GROUP BY node, depth
), children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
below AS (
    SELECT DISTINCT a.node AS top, b.node FROM steps a JOIN steps b ON a.c = b.c AND b.depth >= a.depth
), sums AS (
    SELECT top AS node, CAST(sum((n_convs - 1) * tokens) AS BIGINT) AS saved_tokens, count(*) FILTER (n_children IS NULL) AS n_leaves
    FROM below JOIN nodes USING (node) LEFT JOIN children USING (node) GROUP BY top
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN sums USING (node) LEFT JOIN children USING (node) LEFT JOIN nodes p ON p.node = n.parent"""
