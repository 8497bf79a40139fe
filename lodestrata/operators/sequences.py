"""Numbered members of lists: parts folded into one, members put in or left out, volumes of a series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_parts(df: DataFrame, group: str, index: str, amount: str) -> DataFrame:
    """group, base, parts, amount: members numbered 1a, 1b or 1.1, 1.2 as one; the sum only where every part has one."""
    base = F.regexp_extract(index, r"^\s*([A-Za-z]?\d+?)(?:[a-z]|\.\d+)?\s*$", 1)
    summed = F.when(F.count(amount) == F.count("*"), F.sum(amount))
    return df.where(base != "").groupBy(group, base.alias("base")).agg(F.count("*").alias("parts"), summed.alias(amount))


def with_extras(listed: DataFrame, extras: DataFrame, group: str, position: str) -> DataFrame:
    """Lists with members put in at positions of the finished list; those without a position come last.

    Listed members fill, in order, the places the extras leave free.
    """
    columns = [c for c in listed.columns if c != position]
    taken = extras.where(F.col(position).isNotNull()).groupBy(group).agg(F.array_sort(F.collect_set(position)).alias("__taken"))
    order = F.row_number().over(Window.partitionBy(group).orderBy(position))
    placed = listed.withColumn("__n", order).join(taken, group, "left")
    # The n-th member stands behind every taken place that is at most its own place so far.
    shift = F.aggregate(F.coalesce("__taken", F.array().cast("array<int>")), F.col("__n"), lambda at, t: F.when(t <= at, at + 1).otherwise(at))
    kept = placed.select(*columns, shift.cast("int").alias(position), F.lit(0).alias("__last"))
    put = extras.select(*columns, F.col(position).cast("int").alias(position), F.when(F.col(position).isNull(), 1).otherwise(0).alias("__last"))
    both = kept.unionByName(put)
    again = F.row_number().over(Window.partitionBy(group).orderBy("__last", F.col(position).asc_nulls_last(), *columns))
    return both.withColumn(position, again).drop("__last")


def volumes(df: DataFrame, key: str, title: str, by: Sequence[str] = ()) -> DataFrame:
    """key, stem, volume: titles that say their volume, and those that merely close with a number where a sibling says it."""
    said = r"(?i)^(.*?)[\s,:(\-]*\b(?:vol(?:ume|\.)?|pt\.?|part)\s*(\d{1,3})\)?\s*$"
    bare = r"^(.*?)\s+(\d{1,3})\s*$"
    out = df.select(
        key, *by,
        F.lower(F.trim(F.coalesce(F.nullif(F.regexp_extract(title, said, 1), F.lit("")), F.nullif(F.regexp_extract(title, bare, 1), F.lit("")), F.col(title)))).alias("stem"),
        F.coalesce(F.regexp_extract(title, said, 2).try_cast("int"), F.regexp_extract(title, bare, 2).try_cast("int")).alias("volume"),
        F.col(title).rlike(said).alias("__said"),
    )
    vouched = out.where("__said").select(*by, "stem").distinct().withColumn("__vouched", F.lit(True))
    joined = out.join(vouched, [*by, "stem"], "left")
    return joined.select(key, "stem", F.when(F.col("__said") | F.coalesce("__vouched", F.lit(False)), F.col("volume")).alias("volume")).where("volume is not null")
