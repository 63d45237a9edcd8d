"""Benchmark decontamination in DataFrame functions only.

Benchmark items become windows of ten normalised words (an item of fewer words is one
window). Their 64-bit hashes form a broadcast hash set; every document's token windows, of all
lengths that items have, are scanned against it once, in one generated stage (tokenise, explode
positions and lengths, hash, probe), and what hits is verified by comparing the words themselves.
The scan writes a row for each document and each hit; all else starts from there.

The set is broadcast only while the benchmark has at most ``MAX_BROADCAST`` windows (about
128 MB); beyond that the hashes of all windows are shuffled to it, without the words, and the
words of what hits are read again.

Defined cases: null and empty texts have no words; an item without words has no window;
a null item id hits but isn't listed; null ids and repeated rows each get their own full
result; an empty benchmark leaves everything clean, an empty table gives an empty result;
other columns are ignored or, in ``decontaminate``, kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import ALNUM_WORD, ascii_lower, fresh, saved

SPAN = 10
MAX_BROADCAST = 2_000_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(ALNUM_WORD), F.lit(0))


def benchmark_windows(benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """(item_id, n, phrase, hash) of every window of every item."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    items = items.withColumn("n", F.least(F.size("w"), F.lit(span)))
    at = items.select("item_id", "w", "n", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)).alias("at"))
    part = F.slice("w", F.col("at"), F.col("n"))
    return at.select("item_id", "n", F.array_join(part, " ").alias("phrase"), F.xxhash64(part).alias("hash")).distinct()


def _phrase(start: str = "start", n: str = "n") -> Column:
    return F.array_join(F.slice("w", F.col(start), F.col(n)), " ")


def scan(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows (doc_id, _h, start, n, n_words, phrase): one of each document, with n 0, and those whose hash is in the set."""
    sizes = windows.groupBy("n").count().collect()  # at most ``span`` rows
    lengths = sorted(r["n"] for r in sizes)
    keys = windows.select("n", "hash").distinct()
    base = docs.select("doc_id", F.xxhash64("text").alias("_h"), words_of(F.col("text")).alias("w"))
    each = base.select("doc_id", "_h", "w", F.explode(F.sequence(F.lit(0), F.size("w"))).alias("start"))
    of = lambda n: F.struct(F.lit(n).alias("n"), F.xxhash64(F.slice("w", F.col("start"), F.lit(n))).alias("hash"))
    none = F.array(F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("hash")))
    each = each.select("*", F.explode(F.when(F.col("start") == 0, none).otherwise(F.array(*map(of, lengths)) if lengths else none)).alias("_x")).select("doc_id", "_h", "w", "start", "_x.*")
    each = each.where("start + n - 1 <= size(w) AND (start = 0 OR n > 0)")
    if sum(r["count"] for r in sizes) <= MAX_BROADCAST:
        hit = each.join(F.broadcast(keys.withColumn("_in", F.lit(True))), ["n", "hash"], "left").where("n = 0 OR _in")
        return hit.select("doc_id", "_h", "start", "n", F.when(F.col("n") == 0, F.size("w")).cast("long").alias("n_words"), F.when(F.col("n") > 0, _phrase()).alias("phrase"))
    rows = base.select("doc_id", "_h", F.lit(0).alias("start"), F.lit(0).alias("n"), F.size("w").cast("long").alias("n_words"), F.lit(None).cast("string").alias("phrase"))
    hit = each.where("n > 0").select("doc_id", "_h", "start", "n", "hash").join(keys, ["n", "hash"]).select("doc_id", "_h", "start", "n").distinct()
    again = hit.alias("h").join(base.dropDuplicates(["doc_id", "_h"]).alias("b"), F.expr("h.doc_id <=> b.doc_id AND h._h = b._h")).select("h.*", "b.w")
    return rows.unionByName(again.select("doc_id", "_h", "start", "n", F.lit(None).cast("long").alias("n_words"), _phrase().alias("phrase")))


def find_hits(docs: DataFrame, benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, _h, start, n, item_id): verified occurrences; ``_h`` is xxhash64(text)."""
    windows = benchmark_windows(benchmark, span)
    return _verified(scan(docs, windows), windows)


def _verified(scanned: DataFrame, windows: DataFrame) -> DataFrame:
    return scanned.where("n > 0").drop("n_words").join(windows.select("n", "phrase", "item_id"), ["n", "phrase"]).select("doc_id", "_h", "start", "n", "item_id").distinct()


def flag(docs: DataFrame, benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """One row per document: doc_id, _h, n_words, n_hit, items (sorted, as strings), spans.

    ``spans`` are the maximal runs of hit words, as (start, end) word numbers from 0.
    """
    windows = saved(benchmark_windows(benchmark, span))
    scanned = saved(scan(docs, windows))
    hits = _verified(scanned, windows)
    of_doc = Window.partitionBy("doc_id", "_h")
    runs = hits.groupBy("doc_id", "_h", "start").agg(F.max("n").alias("n"))
    reach = F.max(F.col("start") + F.col("n")).over(of_doc.orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("_new", (reach.isNull() | (F.col("start") > reach)).cast("int"))
    runs = runs.withColumn("_run", F.sum("_new").over(of_doc.orderBy("start")))
    runs = runs.groupBy("doc_id", "_h", "_run").agg((F.min("start") - 1).alias("start"), (F.max(F.col("start") + F.col("n")) - 1).alias("end"))
    spans = runs.groupBy("doc_id", "_h").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    items = hits.groupBy("doc_id", "_h").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    base = scanned.where("n = 0").select("doc_id", "_h", "n_words")
    found = spans.alias("s").join(items.alias("i"), F.expr("s.doc_id <=> i.doc_id AND s._h = i._h")).select("s.*", "i.items")
    out = base.alias("b").join(found.alias("f"), F.expr("b.doc_id <=> f.doc_id AND b._h = f._h"), "left")
    return out.select(
        "b.doc_id", "b._h", "b.n_words",
        F.coalesce("f.n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("f.items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("f.spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
    )


def digests(flagged: DataFrame) -> DataFrame:
    """The contract's columns."""
    return flagged.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, remove: str = "documents") -> DataFrame:
    """``docs`` without contaminated documents, or (remove="spans") with the text of each
    contaminated one rebuilt from its remaining normalised words, joined by one space."""
    of, key, spans = fresh(docs, "_d", "_k", "_s")
    hits = flag(docs, benchmark, span).where("n_hit > 0").select(F.col("doc_id").alias(of), F.col("_h").alias(key), F.col("spans").alias(spans)).dropDuplicates([of, key])
    same = F.col("doc_id").eqNullSafe(F.col(of)) & (F.xxhash64("text") == F.col(key))
    if remove == "documents":
        return docs.join(hits, same, "left_anti")
    clean = F.filter(words_of(F.col("text")), lambda w, i: ~F.exists(spans, lambda s: (s["start"] <= i) & (i < s["end"])))
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.array_join(clean, " ")).alias("text")
    return docs.join(hits, same, "left").select(*[text if c == "text" else F.col(f"`{c}`") for c in docs.columns])


#: The contract's rows in SQL: every window of every text, joined by its words.
ORACLE = rf"""WITH w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), items AS (
    SELECT DISTINCT item_id, n, array_to_string(w[pos:pos + n - 1], ' ') AS phrase
    FROM (SELECT item_id, w, least(len(w), {SPAN}) AS n, unnest(range(1, len(w) - least(len(w), {SPAN}) + 2)) AS pos FROM b WHERE len(w) > 0)
), hits AS (
    SELECT DISTINCT doc_id, pos, i.n, item_id
    FROM (SELECT doc_id, n, pos, array_to_string(w[pos:pos + n - 1], ' ') AS phrase
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM w, (SELECT DISTINCT n FROM items) WHERE len(w) >= n)) d
    JOIN items i ON d.phrase = i.phrase AND d.n = i.n
), covered AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(pos, pos + n)) FROM hits) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)"""
