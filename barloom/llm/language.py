"""Language ID by nearest centroid over TF-IDF character n-grams.

Whole texts become counts of hashed 1- to 3-grams of their letters (lower-cased, everything
else one space; ``STEP`` characters at once); tf is log(1 + count), vectors have length 1. Each
language has up to ``CENTROIDS`` spherical k-means centroids; the nearest by cosine wins, equal
ones by name.

The classifier is fitted on about ``SAMPLE`` labelled documents of each language, of every
language that there is (the sample is drawn by a hash of doc_id and text, over the whole table).
Each language is clustered by itself, in a group of at most its sample's counts (16 KB a document);
only document frequencies, summed before, and centroids reach the driver. Prediction reads every whole text once, in one Python evaluation,
and is a map over partitions.

Rejection: a text is rejected when its cosine is below ``SLACK`` times the ``LOWEST`` quantile of
the cosines of sampled documents of its own length (power of two of n-grams), or when it has no
letter. The sample is halved for that, and each half scored by a model fitted on the other. A
length with fewer than ``ENOUGH`` documents also takes the beginnings of longer ones, cut to it;
one longer than all takes the limit of the longest.

Defined cases: null texts and texts without a letter are ``und`` with score 0; null languages
aren't learned; with nothing to learn from every text is ``und``; repeated rows and null ids
pass through; an empty table gives an empty result; other columns are ignored or kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import fresh, saved

BINS, SAMPLE, CENTROIDS, ROUNDS, SEED = 4096, 400, 3, 12, 7
SLACK, LOWEST, ENOUGH = 0.85, 0.005, 200
#: Characters that are counted at once.
STEP = 1 << 18


@cache
def _letters() -> np.ndarray:
    """Code point -> itself if it is a letter, else a space."""
    table = np.full(0x110000, 32, np.uint32)
    for a, b in ((0, 0xD800), (0xE000, 0x110000)):
        table[a:b] = [c if chr(c).isalpha() else 32 for c in range(a, b)]
    return table


def gram_counts(text: str) -> tuple[np.ndarray, int]:
    """(counts in ``BINS`` hashed bins, number of n-grams); zero n-grams: no letter."""
    counts, total = np.zeros(BINS, np.int64), 0
    before = np.array([32], np.uint32)  # the last two characters that stand before
    for a in range(0, len(text) + 1, STEP):
        c = _letters()[np.frombuffer(text[a : a + STEP].lower().encode("utf-32-le", "replace"), np.uint32)]
        if a + STEP > len(text):
            c = np.append(c, np.uint32(32))
        c = c[(c != 32) | (np.append(before[-1:], c[:-1]) != 32)]
        if not len(c):
            continue
        s = np.concatenate([before, c])
        with np.errstate(over="ignore"):
            one = c[c != 32] * np.uint32(2654435761)
            two = s[:-1] * np.uint32(2246822519) + s[1:] * np.uint32(3266489917)
            three = two[:-1] * np.uint32(668265263) + s[2:] * np.uint32(374761393)
            grams = np.concatenate([one, two[len(before) - 1 :], three])
            grams ^= grams >> np.uint32(15)
            grams *= np.uint32(2146121005)
        counts += np.bincount(grams >> np.uint32(32 - BINS.bit_length() + 1), minlength=BINS)
        total += len(grams)
        before = s[-2:]
    return counts, total


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts.astype(np.float32)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), np.float32(1e-12))


def inverse_frequency(documents: int, having: np.ndarray) -> np.ndarray:
    return (np.log((1 + documents) / (1 + having)) + 1).astype(np.float32)


@dataclass
class Model:
    langs: list[str]  # of each centroid
    centroids: np.ndarray  # (centroids, BINS)
    idf: np.ndarray
    limits: np.ndarray  # lowest allowed cosine by log2 of the number of n-grams

    def vector(self, counts: np.ndarray) -> np.ndarray:
        return vectors(counts[None], self.idf)[0]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        counts, n = gram_counts(text or "")
        if not n or not self.langs:
            return "und", 0.0, True
        cos = self.centroids @ self.vector(counts)
        best = int(cos.argmax())
        score = float(min(1.0, max(0.0, cos[best])))
        return self.langs[best], score, score < self.limits[min(n.bit_length(), len(self.limits) - 1)]


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical: k-means++ seeds, then ``ROUNDS`` assignments by cosine."""
    centers = [x[rng.integers(len(x))]]
    while len(centers) < min(k, len(x)):
        far = np.maximum(0, 1 - (x @ np.array(centers).T).max(1))
        if far.sum() < 1e-9:
            break
        centers.append(x[rng.choice(len(x), p=far / far.sum())])
    c = np.array(centers)
    for _ in range(ROUNDS):
        mine = (x @ c.T).argmax(1)
        for j in range(len(c)):
            if (mine == j).any():
                c[j] = x[mine == j].mean(0)
                c[j] /= max(np.linalg.norm(c[j]), 1e-12)
    return c


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _half(draw: float) -> int:
    return int(draw * (1 << 53)) & 1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text, draw) -> (lang, draw, half, counts) of texts with letters."""
    for batch in batches:
        rows = []
        for lang, text, draw in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            counts, n = gram_counts(text.as_py())
            if n:
                rows.append((lang, draw, _half(draw), counts.astype(np.float32).tobytes()))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.int32(), pa.binary()), strict=True)], names=["lang", "draw", "half", "counts"])


def _bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(half, counts) -> (half, bin, n): how many of the batch's documents have each bin; bin -1: all of them."""
    for batch in batches:
        half = np.asarray(batch.column(0))
        has = np.array([np.frombuffer(c, np.float32) > 0 for c in batch.column(1).to_pylist()], bool).reshape(-1, BINS)
        for h in (0, 1):
            n = np.append(has[half == h].sum(0), (half == h).sum())
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), h, np.int32)), pa.array(np.where(at == BINS, -1, at).astype(np.int32)), pa.array(n[at].astype(np.int64))], names=["half", "bin", "n"])


#: Models of a fit: of the whole sample, and without its one and other half.
WHOLE = 2


def _clusters(idf: np.ndarray):
    """A language's sampled (lang, draw, half, counts) -> (model, lang, place, centroid)."""

    def work(rows: pa.Table) -> pa.Table:
        found = sorted(zip(*(rows.column(c).to_pylist() for c in ("draw", "half", "counts")), strict=True))
        counted = [(h, np.frombuffer(c, np.float32)) for _, h, c in found]
        out: list[tuple] = []
        for model in (WHOLE, 0, 1):
            mine = [c for h, c in counted if h != model]
            if mine:
                centers = _kmeans(vectors(np.array(mine), idf[model]), CENTROIDS, np.random.default_rng(SEED))
                out += [(model, i, c.astype(np.float32).tobytes()) for i, c in enumerate(centers)]
        lang = rows.column("lang")[0].as_py()
        return pa.table({"model": pa.array([o[0] for o in out], pa.int32()), "lang": pa.array([lang] * len(out), pa.string()), "place": pa.array([o[1] for o in out], pa.int32()), "centroid": pa.array([o[2] for o in out], pa.binary())})

    return work


def _cosines(models):
    """(text, draw) -> n-gram length (power of two), whether of the whole text, cosine to the model without its half."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, d in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                text, m = text.as_py(), models.value[_half(d)]
                for cut in (None, *(1 << k for k in range(len(text).bit_length()) if 1 << k < len(text))):
                    c, n = gram_counts(text[:cut])
                    if n:
                        found.append((n.bit_length(), cut is None, float((m.centroids @ m.vector(c)).max(initial=0.0))))
            bits, whole, cos = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(bits, pa.int32()), pa.array(whole, pa.bool_()), pa.array(cos, pa.float64())], names=["bits", "whole", "cos"])

    return work


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """On a sample of the documents that aren't held out; only text and lang are used."""
    spark = docs.sparkSession
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    rate = saved(known.groupBy("lang").agg((F.lit(float(sample)) / F.count("*")).alias("share")))
    draw = (F.xxhash64(F.lit(SEED), "doc_id", "text").bitwiseAND((1 << 53) - 1)) / float(1 << 53)
    drawn = saved(known.join(rate, "lang").select("lang", "text", draw.alias("draw"), "share").where("draw < share").drop("share"))
    counted = saved(drawn.select("lang", "text", "draw").mapInArrow(_counted, "lang string, draw double, half int, counts binary"))
    n, having = np.zeros(3, np.int64), np.zeros((3, BINS), np.int64)
    for r in counted.select("half", "counts").mapInArrow(_bins, "half int, bin int, n long").groupBy("half", "bin").agg(F.sum("n").alias("n")).collect():  # at most 2 * (BINS + 1) rows
        for model in (1 - r["half"], WHOLE):  # the model without the other half
            if r["bin"] < 0:
                n[model] += r["n"]
            else:
                having[model, r["bin"]] += r["n"]
    idf = [inverse_frequency(int(k), h) for k, h in zip(n, having, strict=True)]
    rows = counted.groupBy("lang").applyInArrow(_clusters(idf), "model int, lang string, place int, centroid binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["place"]))
    mine = [[r for r in rows if r["model"] == k] for k in range(3)]
    models = [Model([r["lang"] for r in part], np.array([np.frombuffer(r["centroid"], np.float32) for r in part], np.float32).reshape(-1, BINS), idf[k], np.zeros(64)) for k, part in enumerate(mine)]
    scores = drawn.select("text", "draw").mapInArrow(_cosines(spark.sparkContext.broadcast(models[:2])), "bits int, whole boolean, cos double")
    lowest = scores.groupBy("bits").agg(F.count_if("whole").alias("n"), F.expr(f"percentile_disc({LOWEST}) WITHIN GROUP (ORDER BY cos) FILTER (WHERE whole)").alias("whole"), F.expr(f"percentile_disc({LOWEST}) WITHIN GROUP (ORDER BY cos)").alias("any"))
    models[WHOLE].limits = limits_of({r["bits"]: r["whole"] if r["n"] >= ENOUGH else r["any"] for r in lowest.collect()})
    return models[WHOLE]


def limits_of(lowest: dict[int, float]) -> np.ndarray:
    """Lowest allowed cosine of every length; a length without any takes that of the next shorter one."""
    limits, last = np.zeros(64), 0.0
    for b in range(64):
        last = limits[b] = SLACK * lowest[b] if b in lowest else last
    return limits


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score and rejected, which take the place of columns of these names."""
    docs = docs.drop("lang_pred", "score", "rejected")
    said = fresh(docs, "_said")[0]
    send = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = send.value
        for texts in batches:
            yield pd.DataFrame([m.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    # else a filter on the answer would be pushed below it, with a second evaluation of its own
    return docs.withColumn(said, predict.asNondeterministic()("text")).select(*(F.col(f"`{c}`") for c in docs.columns), f"{said}.*")
