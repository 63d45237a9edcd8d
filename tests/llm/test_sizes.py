"""What only large inputs reach, reached by setting the constants low: results stay those of brute force."""

import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import test_operators as T
from pyspark.sql import functions as F

from barloom.llm import decontaminate, jaccard, language, phrases, repeats, suffix, urls
from barloom.llm.common import shards


@pytest.fixture(scope="module")
def passages(llm_spark):
    """Long and short texts around one boilerplate with neighbours of their own, copies, periodic texts, long words."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 7)))
    words = lambda n: " ".join(word() for _ in range(n))
    almost, whole, long = words(33), words(80), words(6000)
    texts = [f"{words(9)} {almost} {words(9)}" for _ in range(60)] + [f"{words(30)} {whole} {words(30)}" for _ in range(40)]
    texts += [f"{words(3)} {almost} end {words(3)}" for _ in range(8)]
    texts += [long, long, long[200:9000] + words(40), "ab " * 900, "x" * 5000, "y" * 3000 + " " + "z" * 3000, "", None, whole]
    return [(i, t) for i, t in enumerate(texts)]


#: Several thousands of units make a slice, a segment, a block and a shard; three contents are a hot key.
LOW = {"SLICE": 3000, "SEGMENT": 700, "BLOCK": 150, "HOT": 3, "BATCH": 2000}


@pytest.mark.parametrize("names", [("SLICE", "SEGMENT"), ("BLOCK",), ("HOT",), ("BATCH",), tuple(LOW)])
@pytest.mark.parametrize("kind", ["bytes", "words"])
def test_repeats(llm_spark, passages, low, kind, names):
    low(repeats, **{n: LOW[n] for n in names})
    docs = llm_spark.createDataFrame(passages, "doc_id long, text string").repartition(3)
    if kind == "bytes":
        units = {d: (t or "").encode() for d, t in passages}
        small = repeats.Kind(words=False, width=100, gram=16, chunk=40, sub=8)
        gone = dict(zip(units, T.bytes_covered(list(units.values()), 100), strict=True))
        got = suffix.digests(docs, suffix.dedup(docs, small))
        kept = lambda u, g: bytes(b for b, x in zip(u, g, strict=True) if not x)
    else:
        units = {d: T.re.findall(T.WORD, t or "") for d, t in passages}
        gone = dict(zip(units, T.covered(list(units.values()), 35), strict=True))
        got = phrases.digests(docs, phrases.dedup(docs))
        kept = lambda u, g: " ".join(w for w, x in zip(u, g, strict=True) if not x)
    got = {r["doc_id"]: r for r in got.collect()}
    assert len(got) == len(passages)
    for d, r in got.items():
        assert (r["n_removed"], r["kept_sha256"]) == (sum(gone[d]), T.sha(kept(units[d], gone[d])))


@pytest.mark.parametrize("names", [(), ("HOT",), tuple(LOW)])
def test_passages_of_over_50_words_go_too(llm_spark, passages, low, names):
    """The pipeline's stage: 400 bytes or 51 words repeat, both judged on the input; what stays keeps its white space."""
    low(repeats, **{n: LOW[n] for n in names})
    rng = random.Random(5)
    short = [" ".join(f"{w}{rng.randint(0, 9)}" for w in ["ab", "cde"] * 26)[:-3] for _ in range(3)]  # 52 words, 233 bytes
    loose = [f"\n one{i}  two\t{p if i % 2 else p.replace(' ', '  ', 5)}  é{i} \n" for i in range(6) for p in short]
    docs = [*passages, *enumerate([*loose, *short, f"{short[0][:90]} alone"], len(passages))]
    raws = [(t or "").encode() for _, t in docs]
    words = [[m.span() for m in T.re.finditer(T.WORD.encode(), r)] for r in raws]
    gone = T.bytes_covered(raws, 400)
    for raw, spans, g, hit in zip(raws, words, gone, T.covered([[r[a:b] for a, b in s] for r, s in zip(raws, words, strict=True)], 51), strict=True):
        for i, x in enumerate(hit):
            if x:
                a, b = spans[i][0], spans[i + 1][0] if hit[i + 1 : i + 2] == [True] else spans[i][1]
                g[a:b] = [True] * (b - a)
    got = {r["doc_id"]: r["text"] for r in suffix.cut_texts(llm_spark.createDataFrame(docs, "doc_id long, text string").repartition(3), suffix.BYTES, suffix.PASSAGE).collect()}
    for (d, t), raw, g in zip(docs, raws, gone, strict=True):
        assert got[d] == (None if t is None else bytes(b for b, x in zip(raw, g, strict=True) if not x).decode("utf-8", "ignore"))
    assert [got[len(passages) + i] for i in (0, 18)] == ["\n one0    é0 \n", ""]  # "two" stands before every copy


def test_low_constants_reach_the_workers(llm_spark, passages, low, monkeypatch):
    """Otherwise the tests above would prove nothing."""
    import pyarrow as pa

    low(repeats, HOT=3, SLICE=77)

    def tell(batches):
        from barloom.llm import repeats as there

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"slice": [there.SLICE]})

    assert llm_spark.range(1).mapInArrow(tell, "slice long").first()[0] == 77
    seen, real = [], repeats._by_windows
    monkeypatch.setattr(repeats, "_by_windows", lambda kind, contents: seen.append(contents.count()) or real(kind, contents))
    phrases.dedup(llm_spark.createDataFrame(passages, "doc_id long, text string")).count()
    assert seen and seen[0] > 3


def test_segments_find_the_same_chunks():
    import numpy as np

    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 5000).astype(np.uint8)
    p = repeats.prepare(suffix.BYTES, data, np.array([0, 1500, 1500, 1700, 5000]))
    whole = repeats.chunks(suffix.BYTES, p)
    covered = lambda c: {(int(k), int(a) + i, int(pl) + i) for k, a, n, pl in zip(*c, strict=True) for i in range(int(n))}
    old = repeats.SEGMENT
    try:
        repeats.SEGMENT = 333
        assert covered(repeats.chunks(suffix.BYTES, p)) == covered(whole)
    finally:
        repeats.SEGMENT = old


@pytest.mark.parametrize("values", [{"BLOCK": 2000}, {"POSTINGS": 400, "TOGETHER": 2}, {"LONG": 8, "PAIRS": 2}, {"MANY": 1, "LONG": 16}, {"SKETCH_BITS": 8}])
def test_jaccard(llm_spark, low, values):
    low(jaccard, **values)
    rng = random.Random(4)
    base = [f"b{i}" for i in range(120)]
    edited = lambda e: " ".join(f"x{rng.randrange(9999)}" if rng.random() < e else w for w in base)
    docs = [(i, edited(e)) for i, e in enumerate([0.01, 0.02, 0.03, 0.05] * 25)] + [(500 + i, " ".join(base[i : i + 40])) for i in range(40)] + [(900, None), (901, "b1 b2")]
    want = T.components({d: T.shingles(t) for d, t in docs})
    got = jaccard.link_documents(llm_spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want


def test_decontamination_beyond_the_broadcast(llm_spark, sf, monkeypatch):
    small = {tuple(r) for r in T.queries.op2_decontamination(llm_spark, sf).collect()}
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST", 0)
    docs, items = (llm_spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    flagged = decontaminate.digests(decontaminate.flag(docs, items))
    assert "BroadcastExchange" not in decontaminate.scan(docs, decontaminate.benchmark_windows(items)).where("n > 0")._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in flagged.collect()} == small and any(r[2] for r in small)


def test_language_of_long_texts_in_steps(monkeypatch):
    text = "Ünï  cödé -- Text 12 " * 300 + " "
    whole = language.gram_counts(text)
    monkeypatch.setattr(language, "STEP", 7)
    counts, n = language.gram_counts(text)
    assert n == whole[1] and (counts == whole[0]).all()
    assert language.gram_counts(" 12 ")[1] == language.gram_counts("")[1] == 0


def test_language_prediction_against_brute_force(llm_spark, sf):
    """Every centroid by every text's vector, one n-gram at a time."""
    import math
    from collections import Counter

    docs = llm_spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(docs)
    assert set(model.langs) == {r[0] for r in docs.where("lang IS NOT NULL").select("lang").distinct().collect()}
    for r in language.identify(docs.limit(60), model).collect():
        letters = "".join(c if c.isalpha() else " " for c in (r["text"] or "").lower())
        s = " " + " ".join(letters.split()) + " "
        grams = [s[i : i + k] for k in (1, 2, 3) for i in range(len(s) - k + 1) if k > 1 or s[i] != " "] if s.strip() else []
        if not grams:
            assert r["lang_pred"] == "und" and r["score"] == 0
            continue
        bins = Counter()
        for g in grams:
            bins[_bin(g)] += 1
        v = {b: math.log1p(n) * float(model.idf[b]) for b, n in bins.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        cos = [sum(x * float(c[b]) for b, x in v.items()) / size for c in model.centroids]
        assert r["score"] == pytest.approx(max(cos), abs=1e-4) and cos[model.langs.index(r["lang_pred"])] <= max(cos)
        assert max(c for c, name in zip(cos, model.langs, strict=True) if name == r["lang_pred"]) == pytest.approx(max(cos), abs=1e-4)


def _bin(gram):
    m = 2**32
    h = [ord(c) for c in gram]
    if len(h) == 1:
        x = h[0] * 2654435761 % m
    else:
        two = (h[0] * 2246822519 + h[1] * 3266489917) % m
        x = two if len(h) == 2 else (two * 668265263 + h[2] * 374761393) % m
    x ^= x >> 15
    return x * 2146121005 % m >> 20


def test_every_language_is_learned(llm_spark):
    rows = [(4 * i, f"wort{i % 300} satz{i % 300} " * 20, f"l{i % 300}") for i in range(900)]
    model = language.fit(llm_spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    kept = {r[0] for r in llm_spark.createDataFrame(rows, "doc_id long, text string, lang string").where(~language.held_out(F.col("doc_id"))).select("lang").distinct().collect()}
    assert set(model.langs) == kept and len(kept) > 250


def test_long_runs_of_letters(llm_spark, low):
    low(urls, STEP=5)
    rows = [(1, "http://" + "good" * 30 + "news.com/net", "good news good com net"), (2, "http://goodnews.net/fr/x", "x")]
    got = {r["page_id"]: r["words"] for r in urls.judge_urls(llm_spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == ["h:good"] * 30 + ["h:news", "h:com", "p:net"]


def test_shards_follow_the_input(llm_spark):
    assert shards(llm_spark.range(10).repartition(37)) == 37 and shards(llm_spark.range(10).coalesce(1)) == int(llm_spark.conf.get("spark.sql.shuffle.partitions"))


def test_only_texts_in_pairs_move(llm_spark, monkeypatch):
    """Many documents share a passage, two of them are alike: texts of the others stay where they are read."""
    shared = " ".join(f"s{i}" for i in range(6))
    texts = [f"{shared} " + " ".join(f"w{k}x{i}" for i in range(40 + 15 * k)) for k in range(8)]
    rows = [(k, t) for k, t in enumerate([*texts, texts[3] + " end", None, ""])]
    docs, seen, real = llm_spark.createDataFrame(rows, "doc_id long, text string"), [], jaccard._links

    def links(blocks, moved, n):
        asked = {tuple(r) for r in blocks.select("c1", "c2").collect()}
        seen.append((asked, {(r["c1"], r["c2"]) for r in moved.collect()}))
        return real(blocks, moved, n)

    monkeypatch.setattr(jaccard, "_links", links)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.link_documents(docs).collect()}
    assert got == {k: 3 if k == 8 else k for k in range(11)}
    assert seen and all(asked == moved for asked, moved in seen) and len(seen[0][0]) < 9


@pytest.mark.parametrize("values", [{}, {"POSTINGS": 200}, {"TWICE_BITS": 9}, {"TWICE_BITS": 0}])
def test_only_shingles_of_several_sets_move(llm_spark, low, values):
    """Of unrelated texts, copies and near copies: postings of a shingle that one set alone has stay where they are read."""
    low(jaccard, **values)
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(1 << 40)}" for _ in range(n)]
    texts = [" ".join(words(80)) for _ in range(60)]
    near = [f"{texts[i]} end" for i in range(10)]
    docs = llm_spark.createDataFrame([(t,) for t in [*texts, *near, *texts[:3], None, "", "one"]], "text string").repartition(4)
    rank, n, batch = SimpleNamespace(value=np.zeros(1 << jaccard.SKETCH_BITS, np.int32)), 5, pa.record_batch([pa.array([*texts, *near])], names=["text"])
    twice = SimpleNamespace(value=jaccard._twice(docs, llm_spark.sparkContext.broadcast(rank.value), n))
    counts = Counter(x for _, _, prefix in jaccard._prefixes(iter([batch]), rank.value, set()) for x in prefix.tolist())
    blocks = [b for r in jaccard._postings(rank, twice, n)(iter([batch])) for b in r.column(1).to_pylist()]
    moved = Counter(x for b in blocks for x in jaccard._read_block(b)[1].tolist())
    several = {x: k for x, k in counts.items() if k > 1}
    assert len(several) > 100 and several.items() <= moved.items() <= counts.items()
    if "TWICE_BITS" not in values:  # else the bitmap is too small to tell; all may pass then
        assert sum(moved.values()) < sum(counts.values()) / 2
    if values == {"TWICE_BITS": 0}:
        assert moved == counts


@pytest.mark.parametrize("bits", [1 << 25, 64, 1])
def test_the_bitmap_loses_no_key(llm_spark, monkeypatch, bits):
    monkeypatch.setattr(jaccard, "FILTER", bits)
    keys = llm_spark.range(3000).select(F.xxhash64("id").alias("_k0"), "id")
    wanted = keys.where("id % 100 = 7")
    passed = jaccard._let_pass(keys, wanted)
    assert passed.columns == ["_k0", "id"]
    ids = sorted(r["id"] for r in passed.collect())
    assert ids == sorted(set(ids)) and {r["id"] for r in wanted.collect()} <= set(ids)
    assert len(ids) < 40 if bits > 64 else len(ids) <= 3000
    assert jaccard._let_pass(keys, wanted.where("false")).isEmpty()
