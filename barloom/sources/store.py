"""Named strategies and research notes, as logs of JSON files on the shared file system.

Every save, delete or note is a folder of its own with one file, written by Spark's own writer: its commit makes
the file appear whole or not at all, and no two writers meet. The latest row of a name is the strategy.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from collections.abc import Mapping
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STRATEGIES, NOTES = "strategies", "notes"
STRATEGY_SCHEMA = "name string, file string, saved_at string, version int, params string, execution string, deleted boolean"
NOTE_SCHEMA = "at string, symbol string, verdict string, text string"
#: Of the rows that are written now; rows without one are of version 1, which had no execution block.
VERSION = 2
#: What a strategy is run with.
EXECUTION = ("capital", "commission", "slippage")


def slug(name: str) -> str:
    return re.sub(r"[^a-z0-9_]+", "_", name.lower()).strip("_") or "strategy"


def _now() -> str:
    return dt.datetime.now(dt.UTC).isoformat(timespec="microseconds")


def _append(spark: SparkSession, folder: str, table: str, schema: str, row: Mapping[str, Any]) -> None:
    names = [c.split()[0] for c in schema.split(", ")]
    spark.createDataFrame([tuple(row.get(n) for n in names)], schema).coalesce(1).write.json(f"{folder}/{table}/{uuid.uuid4().hex}")


def _read(spark: SparkSession, folder: str, table: str, schema: str) -> DataFrame:
    """The log's rows; what can't be read as one is passed over."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(f"{folder}/{table}/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def strategies(spark: SparkSession, folder: str) -> DataFrame:
    """The latest row of every name that wasn't deleted, the latest first."""
    last = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("saved_at"), F.desc("file")))
    rows = _read(spark, folder, STRATEGIES, STRATEGY_SCHEMA).where("name IS NOT NULL").withColumn("_n", last)
    return rows.where("_n = 1 AND NOT coalesce(deleted, false)").drop("_n", "deleted").orderBy(F.desc("saved_at"))


def list_strategies(spark: SparkSession, folder: str) -> list[dict[str, Any]]:
    found = []
    for r in strategies(spark, folder).collect():
        try:
            found.append({**r.asDict(), "version": r["version"] or 1, "params": json.loads(r["params"] or "{}"), "execution": json.loads(r["execution"] or "{}")})
        except ValueError:
            continue
    return found


def save_strategy(spark: SparkSession, folder: str, name: str, params: Mapping[str, Any], execution: Mapping[str, float] | None = None) -> str:
    """By name: an existing one is replaced; another name with the same slug gets a number."""
    known = list_strategies(spark, folder)
    file = next((s["file"] for s in known if s["name"] == name), None)
    taken, n = {s["file"] for s in known}, 1
    while file is None or (file in taken and not any(s["file"] == file and s["name"] == name for s in known)):
        file, n = f"{slug(name)}{'' if n == 1 else f'_{n}'}", n + 1
    costs = {k: float(v) for k, v in (execution or {}).items() if k in EXECUTION}
    _append(spark, folder, STRATEGIES, STRATEGY_SCHEMA, {"name": name, "file": file, "saved_at": _now(), "version": VERSION, "params": json.dumps(dict(params), default=str), "execution": json.dumps(costs), "deleted": False})
    return file


def load_strategy(spark: SparkSession, folder: str, name: str) -> dict[str, Any]:
    for s in list_strategies(spark, folder):
        if s["name"] == name:
            if s["version"] > VERSION:
                raise ValueError(f"{name!r} was saved by a later version ({s['version']})")
            return s
    raise KeyError(name)


def delete_strategy(spark: SparkSession, folder: str, name: str) -> bool:
    for s in list_strategies(spark, folder):
        if s["name"] == name:
            _append(spark, folder, STRATEGIES, STRATEGY_SCHEMA, {"name": name, "file": s["file"], "saved_at": _now(), "version": VERSION, "deleted": True})
            return True
    return False


def append_note(spark: SparkSession, folder: str, entry: Mapping[str, Any]) -> None:
    _append(spark, folder, NOTES, NOTE_SCHEMA, {k: None if v is None else str(v) for k, v in {"at": _now(), **entry}.items()})


def notes(spark: SparkSession, folder: str, symbol: str | None = None, verdict: str | None = None, last: int = 20) -> DataFrame:
    """The last notes, newest first, by part of the symbol (any case) and by verdict."""
    found = _read(spark, folder, NOTES, NOTE_SCHEMA)
    if symbol:
        found = found.where(F.contains(F.upper("symbol"), F.lit(symbol.upper())))
    if verdict:
        found = found.where(F.upper("verdict") == verdict.upper())
    return found.orderBy(F.desc("at")).limit(last)
