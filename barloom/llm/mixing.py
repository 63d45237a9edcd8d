"""Mixing sources to target weights: hierarchical budgets, then seeded token prefixes.

A tree domain > language > source holds the documents. Every node may give at most
``max_epochs`` times its tokens. From the root down, a node's budget is shared among its
children in proportion to their weights; a child that cannot use its share keeps its limit
and what it lacks goes to its siblings (water filling), and only what a whole family cannot
use is missing one level higher. All of it is integer arithmetic in window functions over
the table of leaves. A leaf's budget is met by whole epochs, then by the token prefix of one
more epoch: documents in the order of md5(seed:epoch:doc_id), as long as their running sum
of tokens stays within what is left.

The running sum of a leaf is taken in two levels: sums of 4096 hash buckets, then only the
one bucket in which the cut lies is sorted, so a leaf of any size is never one task's sort.

Defined cases: null domain, language or source count as ''; a null text has no tokens; null
ids sort as '' in the hash; documents without tokens are taken while the cut isn't reached;
repeated rows are documents of their own (ties in the hash go to the one with fewer tokens);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import WORD, saved

LEVELS = ("domain", "lang", "source")
SEED = 17
#: Weights by level and name; a name that isn't listed weighs 1.
WEIGHTS: dict[str, dict[str, int]] = {"domain": {"core": 3, "tail": 1}, "lang": {"en": 3, "de": 2}, "source": {"src0": 2}}
MAX_EPOCHS = 3


def domain_of(source: Column) -> Column:
    """The default tree's first level: short source names are core, the others tail."""
    return F.when(F.length(F.coalesce(source, F.lit(""))) <= 4, "core").otherwise("tail")


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out.cast("long")


def leaf_budgets(leaves: DataFrame, weights: Mapping[str, Mapping[str, int]], max_epochs: int, budget: int | None) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens) with the tokens to take from each, ``take``.

    ``budget`` None: as many as there are.
    """
    nodes = leaves.select(*LEVELS, "tokens", (F.col("tokens") * max_epochs).alias("cap"))
    whole = nodes.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("_b"), F.coalesce(F.sum("cap"), F.lit(0)).alias("_c"))
    given = whole.select(F.least(F.lit(budget).cast("long") if budget is not None else F.col("_b"), F.col("_c")).alias("_budget"))
    above: tuple[str, ...] = ()
    for level in LEVELS:
        keys = (*above, level)
        child = nodes.groupBy(*keys).agg(F.sum("cap").alias("_cap")).withColumn("_w", _weight(level, weights))
        child = child.join(given, list(above)) if above else child.crossJoin(given)
        order = Window.partitionBy(*above or (F.lit(0),)).orderBy(F.col("_cap") / F.col("_w"), level)
        before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
        child = child.select(
            "*",
            F.coalesce(F.sum("_cap").over(before), F.lit(0)).alias("_before"),
            F.sum("_w").over(rest).alias("_rest"),
        )
        full = F.col("_before") * F.col("_w") + F.col("_cap") * F.col("_rest") <= F.col("_budget") * F.col("_w")
        child = child.withColumn("_full", full)
        family = Window.partitionBy(*above or (F.lit(0),))
        kept = F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(family), F.lit(0))
        open_w = F.sum(F.when(~F.col("_full"), F.col("_w"))).over(family)
        child = child.select(*keys, "_cap", "_w", "_full", (F.col("_budget") - kept).alias("_left"), open_w.alias("_open"))
        share = F.expr("least(_cap, (_w * _left) div _open)")
        given = child.select(*keys, F.when(F.col("_full"), F.col("_cap")).otherwise(share).alias("_budget"))
        above = keys
    return leaves.join(given.withColumnRenamed("_budget", "take"), list(LEVELS))


def mix(
    docs: DataFrame,
    weights: Mapping[str, Mapping[str, int]] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    budget: int | None = None,
    seed: int = SEED,
    domain: Column | None = None,
) -> DataFrame:
    """Every document with the number of times it is taken: doc_id, domain, lang, source, tokens, copies."""
    slim = saved(
        docs.select(
            "doc_id",
            F.coalesce(domain_of(F.col("source")) if domain is None else domain, F.lit("")).alias("domain"),
            F.coalesce("lang", F.lit("")).alias("lang"),
            F.coalesce("source", F.lit("")).alias("source"),
            F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("tokens"),
        )
    )
    leaves = slim.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    plan = leaf_budgets(leaves, weights, max_epochs, budget).select(
        *LEVELS,
        F.expr("coalesce(take div nullif(tokens, 0), 0)").alias("_epochs"),
        F.expr("coalesce(take - tokens * (take div nullif(tokens, 0)), 0)").alias("_more"),
    )
    plan = saved(plan)  # a row per leaf
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    keyed = slim.join(plan, list(LEVELS)).withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, 3))
    sums = keyed.groupBy(*LEVELS, "_bucket", "_more").agg(F.sum("tokens").alias("_sum"))
    upto = F.sum("_sum").over(Window.partitionBy(*LEVELS).orderBy("_bucket"))
    sums = sums.select(*LEVELS, "_bucket", (upto - F.col("_sum")).alias("_from"), upto.alias("_upto"))
    placed = keyed.join(sums, [*LEVELS, "_bucket"])
    cut = (F.col("_from") <= F.col("_more")) & (F.col("_upto") > F.col("_more"))
    out = lambda more: ["doc_id", *LEVELS, "tokens", (F.col("_epochs") + more).alias("copies")]
    sure = placed.where(~cut).select(*out(F.when(F.col("_upto") <= F.col("_more"), 1).otherwise(0)))
    within = Window.partitionBy(*LEVELS, "_bucket").orderBy("_key", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    edge = placed.where(cut).withColumn("_run", F.col("_from") + F.sum("tokens").over(within))
    return sure.unionByName(edge.select(*out(F.when(F.col("_run") <= F.col("_more"), 1).otherwise(0))))


def _sql_weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> str:
    cases = "".join(f" WHEN {level} = '{name}' THEN {w}" for name, w in weights.get(level, {}).items())
    return f"CASE{cases} ELSE 1 END" if cases else "1"


def oracle(weights: Mapping[str, Mapping[str, int]] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> str:
    """The same in SQL over ``documents``."""
    sql = rf"""WITH docs AS (
        SELECT doc_id, CASE WHEN length(coalesce(source, '')) <= 4 THEN 'core' ELSE 'tail' END AS domain,
            coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens FROM documents
    ), leaves AS (SELECT domain, lang, source, sum(tokens) AS tokens, sum(tokens) * {max_epochs} AS cap FROM docs GROUP BY ALL),
    b0 AS (SELECT least(sum(tokens), sum(cap)) AS budget FROM leaves)"""
    above = ""
    for n, level in enumerate(LEVELS, 1):
        keys = ", ".join(LEVELS[:n])
        part = f"PARTITION BY {above}" if above else ""
        join = f"JOIN b{n - 1} USING ({above})" if above else "CROSS JOIN b0"
        sql += f""", c{n} AS (
            SELECT *, coalesce(sum(cap) OVER ({part} ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                sum(w) OVER ({part} ORDER BY cap / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
            FROM (SELECT {keys}, sum(cap) AS cap, {_sql_weight(level, weights)} AS w FROM leaves GROUP BY {keys}) {join}
        ), f{n} AS (SELECT *, before * w + cap * rest <= budget * w AS filled FROM c{n}),
        b{n} AS (
            SELECT {keys}, CASE WHEN filled THEN cap ELSE least(cap,
                (w * (budget - coalesce(sum(cap) FILTER (filled) OVER ({part}), 0))) // sum(w) FILTER (NOT filled) OVER ({part})) END AS budget
            FROM f{n})"""
        above = keys
    return sql + f""", plan AS (
        SELECT *, coalesce(budget // nullif(tokens, 0), 0) AS epochs, coalesce(budget - tokens * (budget // nullif(tokens, 0)), 0) AS more
        FROM leaves JOIN b3 USING ({above})
    )
    SELECT doc_id, domain, lang, source, tokens, CAST(epochs + CASE WHEN run <= more THEN 1 ELSE 0 END AS BIGINT) AS copies
    FROM (SELECT d.*, epochs, more, sum(d.tokens) OVER (PARTITION BY domain, lang, source
            ORDER BY md5('{seed}:' || CAST(epochs AS BIGINT) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), d.tokens ROWS UNBOUNDED PRECEDING) AS run
          FROM docs d JOIN plan USING ({above}))"""
