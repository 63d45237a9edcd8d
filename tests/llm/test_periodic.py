"""op12 against brute force: small alphabets, planted periods, awkward rows, tiny blocks."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import periodic, queries

WORD = r"[^\x20\x09-\x0D]+"


def runs_of(w):
    """(start, length, period) by scanning every period."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(12, 2 * q):
                found.setdefault((s, i - s + q), q)  # the smallest period comes first
            i += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def rebuilt(doc, w):
    h, n = zlib.crc32(str(doc).encode()), len(w)
    if h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return w[:a] + [w[a + (i - a) % p] for i in range(a, n)]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_runs_of_small_alphabets(monkeypatch):
    rng = random.Random(1)
    for _ in range(400):
        docs = []
        for _ in range(rng.randrange(1, 6)):
            d = [rng.randrange(rng.choice((1, 2, 3, 8))) for _ in range(rng.randrange(0, 90))]
            docs.append((d * 5)[: rng.randrange(1, 120)] if rng.random() < 0.4 and d else d)
        offsets = np.cumsum([0, *map(len, docs)])
        names = np.array([x + 10 * i for i, d in enumerate(docs) for x in d], np.int64)
        monkeypatch.setattr(periodic, "BLOCK", rng.choice((7, 1 << 18)))
        got = list(map(tuple, periodic.find(names, offsets).tolist()))
        assert got == [(s + int(offsets[i]), n, q) for i, d in enumerate(docs) for s, n, q in runs_of(d)]


def test_op12_against_brute_force(llm_spark, sf):
    texts = {r["doc_id"]: r["text"] for r in llm_spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op12_periodic_runs(llm_spark, sf).collect()
    assert len(got) == len(texts) and sum(r["n_runs"] > 0 for r in got) > 10
    for r in got:
        w = rebuilt(r["doc_id"], re.findall(WORD, texts[r["doc_id"]] or ""))
        runs = runs_of(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        want = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert (r["n_runs"], (r["start"], r["length"], r["period"], r["exponent_milli"])) == (len(runs), want)
        assert r["runs_sha256"] == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)) and r["collapsed_sha256"] == sha(collapsed(w, runs))


@pytest.mark.parametrize("words", [periodic.WORDS, 40])
def test_awkward_rows(llm_spark, low, words):
    low(periodic, WORDS=words)
    long = "x y z " * 20_000
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, long), (4, long), (None, "a b " * 6), (5, "a " * 11), (6, "é " * 12 + "end"), (7, " ".join(map(str, range(5000)))), (8, "A a " * 3 + "a A " * 3)]
    docs = llm_spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("runs", "collapsed", "n_words", "start")})
    got = periodic.find_runs(docs).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"]) for r in got) == sorted((d or 0, len((t or "").split())) for d, t in rows)
    runs = {r["doc_id"]: ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in got}
    assert runs[1] == runs[2] == runs[3] == ([], "") and runs[4] == ([(0, 60_000, 3)], "x y z")
    assert runs[None] == ([(0, 12, 2)], "a b") and runs[5] == ([], " ".join("a" * 11)) and runs[6] == ([(0, 12, 1)], "é end")
    assert runs[7][0] == [] and runs[8][0] == runs_of(("A a " * 3 + "a A " * 3).split())
    shown = {r["doc_id"]: r for r in periodic.digests(periodic.find_runs(docs)).collect()}
    assert (shown[1]["n_runs"], shown[1]["start"], shown[1]["runs_sha256"]) == (0, None, sha("")) and shown[4]["exponent_milli"] == 20_000_000
    assert periodic.digests(periodic.find_runs(docs.limit(0))).count() == 0
