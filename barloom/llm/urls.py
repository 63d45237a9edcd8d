"""URL filters: rules first, else naive Bayes over segmented host and path words.

Host labels are split by unigram Viterbi with word frequencies counted over the texts of all
pages; the classifier is multinomial naive Bayes over the words of host and path, with the
rules' own verdicts as labels (distant supervision). Both models are whole tables counted by
Spark: the substrings of the distinct runs of letters, and the tokens of the distinct names
(host, path), are joined to them, by broadcast only where Spark finds a side small. Every URL
is judged.

Defined cases: a null URL or one without ``://`` has an empty host and path, no rule and is
judged by the prior alone; repeated rows and null page ids pass through; equal scores allow;
where no page carries a label, everything without a rule is allowed; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import ascii_lower, saved, text_key

#: (verdict, rule): fixed values of the contract.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Letters of the longest word; start places or pieces a batch.
LONGEST, STEP = 24, 20_000


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to ``/?#``; then up to ``?#``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(u, pattern, 1)), F.regexp_extract(u, pattern, 2)


def match_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, name in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        site, slash, rest = name.partition("/")
        fits = ((host == site) | F.endswith(host, F.lit("." + site))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def word_counts(pages: DataFrame) -> DataFrame:
    """(w, n) of every word of all pages' texts (tags stripped)."""
    plain = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?s)<[^>]*>", " ")
    words = pages.select(F.explode(F.regexp_extract_all(F.lower(plain), F.lit(f"[a-z]{{2,{LONGEST}}}"), 0)).alias("w"))
    return words.groupBy("w").agg(F.count("*").alias("n"))


class Segmenter:
    """Unigram Viterbi: the most probable split; an unknown letter costs ``miss``.

    ``words`` may be only those that occur in the names to split, if ``longest`` and ``miss`` are those of all words.
    """

    def __init__(self, words: dict[str, float], longest: int | None = None, miss: float | None = None):
        self.words, self.longest = words, longest or max(map(len, words), default=1)
        self.miss = min(words.values(), default=0.0) - 10.0 if miss is None else miss
        self.cached = lru_cache(maxsize=100_000)(self._split)

    def _split(self, name: str) -> tuple[str, ...]:
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(name) + 1):
            options = ((best[a][0] + self.words.get(name[a:end], self.miss * (end - a)), a) for a in range(max(0, end - self.longest), end))
            best.append(max(options, key=lambda o: (o[0], -o[1])))
        out, end = [], len(name)
        while end:
            out.append(name[best[end][1] : end])
            end = best[end][1]
        return tuple(reversed(out))

    def tokens(self, host: str, path: str) -> list[str]:
        out = []
        for kind, text in (("h:", host), ("p:", path.lower())):
            for run in re.findall(r"[a-z]+|[0-9]+", text):
                out += [kind + w for w in (self.cached(run) if run[0].isalpha() else (f"#{len(run)}",))]
        return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every substring of 2 to ``LONGEST`` letters of the runs (run, _h1, _h2)."""
    for batch in batches:
        h1, h2, w = [], [], []
        for run, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for i in range(0, len(run), STEP):
                found = {run[k:end] for k in range(i, min(i + STEP, len(run))) for end in range(k + 2, min(k + LONGEST, len(run)) + 1)}
                h1 += [a] * len(found)
                h2 += [b] * len(found)
                w += found
                if len(w) >= STEP:
                    yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(w, pa.string())], names=["_h1", "_h2", "w"])
                    h1, h2, w = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(w, pa.string())], names=["_h1", "_h2", "w"])


def split_runs(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(run, parts) of distinct runs of letters: each meets the counts of its own substrings."""
    size = counts.agg(F.sum("n").alias("total"), F.min("n").alias("least"), F.max(F.length("w")).alias("longest")).first()
    total, longest = size["total"] or 1, size["longest"] or 1
    miss = (math.log(size["least"] / total) if size["least"] else 0.0) - 10.0
    runs = runs.select("run", *text_key(F.col("run")))
    found = runs.mapInArrow(_pieces, "_h1 long, _h2 long, w string").join(counts, "w")
    found = found.groupBy("_h1", "_h2").agg(F.map_from_entries(F.collect_set(F.struct("w", "n"))).alias("n"))

    @F.pandas_udf("array<string>")
    def segment(names: pd.Series, known: pd.Series) -> pd.Series:
        logs = [{w: math.log(n / total) for w, n in (k or {}).items()} for k in known]
        return pd.Series([list(Segmenter(words, longest, miss).cached(r)) for r, words in zip(names, logs, strict=True)])

    return runs.join(found, ["_h1", "_h2"], "left").select("run", segment("run", "n").alias("parts"))


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, words (of host and path), score (log-odds of block)."""
    host, path = split_url(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    # all that follows depends on the name only: host and path, or their 128-bit key (a host has no slash)
    named = split.groupBy("host", "path").agg(F.count("*").alias("pages")).select("*", rule.alias("rule"), verdict.alias("_rule_says"), *text_key(F.concat("host", "path")))
    named = saved(named)
    cut = lambda kind, c: F.transform(F.regexp_extract_all(c, F.lit("[a-z]+|[0-9]+"), 0), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("run")))
    runs = named.select("_h1", "_h2", F.posexplode(F.concat(cut("h:", F.col("host")), cut("p:", F.lower("path")))).alias("pos", "_r")).select("_h1", "_h2", "pos", "_r.*")
    parts = split_runs(runs.where("run >= 'a'").select("run").distinct(), saved(word_counts(pages)))
    own = F.coalesce("parts", F.array(F.concat(F.lit("#"), F.length("run"))))
    placed = runs.join(parts, "run", "left").select("_h1", "_h2", "pos", F.transform(own, lambda w: F.concat("kind", w)).alias("own"))
    words = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "own"))), lambda x: x["own"]))
    words = saved(placed.groupBy("_h1", "_h2").agg(words.alias("words")))
    docs = {r["_rule_says"]: r["n"] for r in named.where("_rule_says IS NOT NULL").groupBy("_rule_says").agg(F.sum("pages").alias("n")).collect()}
    scored = named.join(words, ["_h1", "_h2"], "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    if len(docs) < 2:
        scored = scored.withColumn("score", F.lit(0.0))
    else:
        block = F.when(F.col("_rule_says") == "block", F.col("pages")).otherwise(0)
        labelled = named.where("_rule_says IS NOT NULL").select("_h1", "_h2", "pages", block.alias("b")).join(words, ["_h1", "_h2"])
        counts = saved(labelled.select("pages", "b", F.explode("words").alias("w")).groupBy("w").agg(F.sum("b").alias("block"), F.sum("pages").alias("n")))
        every = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("block"), F.lit(0)).alias("block"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
        blocked, allowed = max(1, every["block"] + every["v"]), max(1, every["n"] - every["block"] + every["v"])
        odds = F.log((F.col("block") + 1) / F.lit(float(blocked))) - F.log((F.col("n") - F.col("block") + 1) / F.lit(float(allowed)))
        prior = math.log(docs["block"] / docs["allow"])

        @F.pandas_udf("double")
        def bayes(odds: pd.Series) -> pd.Series:
            return odds.map(lambda x: prior + math.fsum(x))  # exact, so in any order

        met = words.select("_h1", "_h2", F.explode("words").alias("w")).join(counts.select("w", odds.alias("odds")), "w")
        sums = met.groupBy("_h1", "_h2").agg(F.collect_list("odds").alias("odds")).select("_h1", "_h2", bayes("odds").alias("score"))
        scored = scored.join(sums, ["_h1", "_h2"], "left").withColumn("score", F.coalesce("score", F.lit(prior)))
    says = F.when(F.col("score") > 0, "block").otherwise("allow")
    judged = scored.select("host", "path", "rule", F.coalesce("_rule_says", says).alias("verdict"), "words", "score")
    return split.join(judged, ["host", "path"]).select("page_id", "host", "path", "rule", "verdict", "words", "score")
