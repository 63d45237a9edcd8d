"""op11 against brute force: given tables, hot groups of edited copies, awkward rows, tiny constants."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from barloom.llm import chosen_path, queries

WORD = r"[^\x20\x09-\x0D]+"


def shingles(text):
    words = re.findall(WORD, re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 4]) for i in range(len(words) - 3)) if len(words) >= 4 else frozenset([tuple(words)] if words else [])


def components(texts):
    sets = {d: shingles(t) for d, t in texts.items()}
    into = {d: d for d in sets}

    def top(x):
        while into[x] != x:
            x = into[x]
        return x

    index = defaultdict(list)
    for d, s in sets.items():
        for o, n in Counter(o for g in s for o in index[g]).items():
            if 100 * n >= 80 * (len(s) + len(sets[o]) - n):
                a, b = sorted((top(d), top(o)))
                into[b] = a
        for g in s:
            index[g].append(d)
    return {d: (len(s), top(d), d == top(d)) for d, s in sets.items()}


def told(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def edited(rng, base, rate):
    return " ".join(f"{rng.choice('xyz')}{rng.randrange(9999)}" if rng.random() < rate else w for w in base)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_op11_against_brute_force(llm_spark, size):
    where = f"/root/testdata/{size}"
    texts = {r["doc_id"]: r["text"] for r in llm_spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text").collect()}
    assert told(queries.op11_chosen_path(llm_spark, where)) == components(texts)


@pytest.mark.parametrize("constants", [{}, {"SMALL": 8, "DEPTH": 3, "BLOCK": 300, "AT_ONCE": 50}, {"SMALL": 4, "DEPTH": 1, "BEST": 1}])
def test_hot_groups(llm_spark, low, constants):
    """Edited copies of two texts, one the other's edit: many are in no link with the leader."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    other = edited(rng, base, 0.06).split()
    docs = [(i, edited(rng, rng.choice((base, other)), e)) for i, e in enumerate([0.0, 0.01, 0.02, 0.03, 0.05] * 40)]
    docs += [(1000 + i, f"one shared opening of texts {i} {i % 3}") for i in range(60)]
    low(chosen_path, **constants)
    assert told(chosen_path.link_documents(llm_spark.createDataFrame(docs, "doc_id long, text string"))) == components(dict(docs))


def test_awkward_rows(llm_spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, long), (4, long), (None, long + " end"), (5, "One two"), (6, "one TWO"), (7, "one two three"), (None, "alone it stands here today"), (None, None), (8, "É " * 50), (9, "é " * 50)]
    docs = llm_spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("n", "v", "node", "sketch", "component", "_h1", "z", "kept", "c1")})
    got = sorted(((r["doc_id"], *tuple(r)[1:]) for r in chosen_path.link_documents(docs).collect()), key=repr)
    want = [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 29_997, 4, True), (4, 29_997, 4, True), (None, 29_998, 4, False), (5, 1, 5, True), (6, 1, 5, False), (7, 1, 7, True), (None, 2, None, True), (None, 0, None, True), (8, 1, 8, True), (9, 1, 9, True)]
    assert got == sorted(want, key=repr)
    assert chosen_path.link_documents(docs.limit(0)).count() == 0


def test_trees_keep_pairs_together():
    """The share of trees that miss a pair is what ``miss`` says, at the first and at later levels."""
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(300):
        x = rng.integers(0, 2**63, 270).astype(np.uint64)
        sets += [np.sort(x[:240]), np.sort(x[30:])]  # 210 of 270 in common
    values = chosen_path.least_hashes(sets)
    assert abs((values[::2] == values[1::2]).mean() - 210 / 270) < 0.01
    assert chosen_path.miss(0.8, 1) ** chosen_path.TREES < 1e-5 and chosen_path.miss(0.8, chosen_path.DEPTH) ** chosen_path.TREES < 0.003
    missed = Counter()
    for root in chosen_path.mix(np.arange(1, 301, dtype=np.uint64) * np.uint64(77)):
        for k in range(0, 40, 2):
            now = [{int(root)}, {int(root)}]
            for level in (1, 2, 3):
                for i in (0, 1):
                    nodes = np.array(sorted(now[i]), np.uint64)
                    _, kids = chosen_path.children(nodes, np.repeat(values[k + i : k + i + 1], len(nodes), 0))
                    now[i] = set(kids.tolist())
                missed[level] += not now[0] & now[1]
    for level in (1, 2, 3):
        assert abs(missed[level] / 6000 - chosen_path.miss(210 / 270, level)) < 0.04


def test_a_cell_counts_sketches_once(monkeypatch):
    """All pairs of a cell are found by a call for each member that asks, and its links name components."""
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join([*words[:i], f"x{i}", *words[i + 1 :]]).encode() for i in range(0, 100, 2)]
    sets = chosen_path.shingle_sets(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), chosen_path.WORDS)
    sketch = [x.tobytes() for x in (chosen_path.mix(chosen_path.least_hashes(sets)) & np.uint64(255)).astype(np.uint8)]
    pack = zstandard.ZstdCompressor().compress
    rows = [(7, "0/0", asks, v, len(sets[v]), 500 + v, sketch[v], pack(t)) for asks in (True, False) for v, t in enumerate(texts)]
    schema = pa.schema([*chosen_path._MEMBER, ("z", pa.binary())])
    calls, real = [], chosen_path._Group.agree
    monkeypatch.setattr(chosen_path._Group, "agree", lambda self, *a: calls.append(1) or real(self, *a))
    links = pa.Table.from_batches(chosen_path._exhaust(iter(pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema).to_batches())))
    linked = [[len(a & b) * 100 >= 80 * len(a | b) for b in map(shingles, map(bytes.decode, texts))] for a in map(shingles, map(bytes.decode, texts))]
    assert all(map(all, linked)) and len(calls) <= len(texts)
    ends = links.column("a").to_pylist() + links.column("b").to_pylist()
    assert len(links) == len(texts) - 1 and set(ends) == {500 + v for v in range(len(texts))}
