"""Session helpers shared by the operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "lodestrata", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the queries are written for: UTC, ANSI, adaptive execution."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in {**settings, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder the cluster names in spark.checkpoint.dir and read it again.

    Where that setting is absent, a local session takes a temporary folder; on
    a cluster, whose executors couldn't see it, this is an error. Files of
    checkpoints no longer referred to are removed by Spark where
    spark.cleaner.referenceTracking.cleanCheckpoints is set, as build_session does.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError(f"spark.checkpoint.dir is unset on {sc.master}: name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lodestrata-"))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Repartition for steps whose work is large though their rows are few.

    By a hash of the columns rather than the columns themselves: rows that an
    aggregation has just placed by these would else count as placed already,
    and adaptive execution would fold them into one task.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, F.xxhash64(*columns)) if columns else df.repartition(n)
