"""Small shared helpers: tables, shared folder, exact word rules, row keys."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.shared import saved, shared_dir  # noqa: F401  (the operators take them from here)

#: Words of the duplicate operators: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Words of decontamination: ASCII digits and lower-case letters, and everything beyond ASCII.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ARROW_ROWS, ARROW_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package also when it isn't installed on them; batches of at most 1,000 texts and about 16 MB."""
    if int(spark.conf.get(ARROW_ROWS)) > 1000:
        spark.conf.set(ARROW_ROWS, "1000")
        spark.conf.set(ARROW_BYTES, str(16 << 20))
    root, context = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), spark.sparkContext
    if not context.master.startswith("local"):
        if not hasattr(context, "_barloom_shipped"):  # the driver's path isn't there on other machines
            # executors fetch the file when their first task comes, late ones too: it stays as long as the context
            here = tempfile.TemporaryDirectory(prefix="barloom-", ignore_cleanup_errors=True)
            context.addPyFile(shutil.make_archive(f"{here.name}/barloom", "zip", root, "barloom"))
            context._barloom_shipped = here
        return spark
    env = context.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
    return spark


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shards(df: DataFrame) -> int:
    """Parts to deal rows of ``df`` to: the shuffle's partitions, or the splits of its files if they are more."""
    return max(partitions(df.sparkSession), df.rdd.getNumPartitions())


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as no column of ``df`` has (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters stay as they are."""
    return F.translate(c, UPPER, UPPER.lower())


def text_key(c: Column) -> list[Column]:
    """128 bits that name a text; null counts as empty."""
    t = F.coalesce(c, F.lit(""))
    return [F.xxhash64(t).alias("_h1"), F.xxhash64(F.lit("second"), t).alias("_h2")]
