"""op13: SQL on the given table, brute force on awkward conversations, tiny blocks and pieces."""

import hashlib
import random
import zlib
from collections import defaultdict

import oracle
import pytest
from pyspark.sql import functions as F

from barloom.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string"


def said_of(rows, rebuilt):
    """Every conversation's turns in order."""
    of = defaultdict(list)
    for c, turn, role, text in rows:
        of[c].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [t[2:] for t in sorted(ts)] for c, ts in of.items()}
    if not rebuilt:
        return said
    out = {}
    for c, ts in said.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 6
        base = None if c is None else c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = (said.get(base, [])[:h] if c is not None else []) + ts[h:]
    return out


def brute(said):
    """Every node by its sequence of turns, from lists."""
    members, kids = defaultdict(list), defaultdict(list)
    for c, ts in said.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    least = lambda cs: min((c for c in cs if c is not None), default=None)
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        mine = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        below = [sums[k] for k in kids[node]]
        sums[node] = (sum(b[0] for b in below) or 1, mine + sum(b[1] for b in below))
    out = []
    for node, cs in members.items():
        ends = sorted(c for c in cs if c is not None and len(said[c]) == len(node))
        parent = least(members[node[:-1]]) if node else None
        out.append((least(cs), len(node), parent, len(cs), len(kids[node]), *sums[node], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def nodes_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def made(seed, n):
    """Conversations that share openings, with ties in no turn."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), 100, 200, 201, 350, -7, -120]:
        k = rng.randrange(1, 9)
        rows += [(c, t, rng.choice(("user", "assistant", None)), rng.choice(("a", "bb", "日本", None, "a"))) for t in range(k)]
    return rows


@pytest.mark.parametrize("low_constants", [False, True])
def test_against_brute_force(llm_spark, monkeypatch, low_constants):
    if low_constants:
        monkeypatch.setattr(trie, "SHARE", 3)
    rows = made(4, 60) + [(None, None, "user", "a"), (None, 1, "user", "bb"), (None, 1, "user", "bb")]
    rows += [(500, t, "user", f"turn {t}") for t in range(300)] + [(501, None, None, None)]
    turns = llm_spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("c", "none", "depth", "k1", "at", "block", "tokens", "owner")})
    placed = trie.turns_of(turns)
    assert nodes_of(trie.prefix_trie(trie.rebuild(placed), trie.conversations_of(placed))) == brute(said_of(rows, True))
    assert nodes_of(trie.prefix_trie(placed, trie.conversations_of(placed))) == brute(said_of(rows, False))


def test_turnless_and_empty(llm_spark):
    rows = [(c, 0, "user", "x") for c in (1, 2, 3, 4, 7)]  # no base: those with h > 0 have no turn
    placed = trie.turns_of(llm_spark.createDataFrame(rows, SCHEMA))
    got = nodes_of(trie.prefix_trie(trie.rebuild(placed), trie.conversations_of(placed)))
    assert got == brute(said_of(rows, True)) and sum(r[1] == 0 for r in got) == 1
    empty = trie.turns_of(llm_spark.createDataFrame([], SCHEMA))
    assert trie.prefix_trie(trie.rebuild(empty), trie.conversations_of(empty)).count() == 0


def test_many_ends_in_pieces(llm_spark, low):
    """Thousands of equal conversations end at one node; their ids are hashed in many pieces."""
    low(trie, PIECE=100)
    rows = [(c, t, "user", f"turn {t}") for c in range(-1500, 1500) for t in range(2)]
    placed = trie.turns_of(llm_spark.createDataFrame(rows, SCHEMA))
    got = nodes_of(trie.prefix_trie(placed, trie.conversations_of(placed)))
    assert got == brute(said_of(rows, False))


def test_op13_sql(llm_spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert oracle.difference(llm_spark, oracle.connect(sf), queries.QUERIES["op13_prefix_trie"], queries.ORACLE_SQL["op13_prefix_trie"], sf) == ""
