"""Relational idioms of a catalogue, on any tables.

Every operator takes DataFrames and column names, orders by a total order
(ties are broken by the columns given last) and leaves null what is absent.
None collects rows; partitions are the groups named by the caller, cut down by
aggregation before a window where the result allows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Entities of one value that anti_pairs pairs at once with all of that value.
_BLOCK = 256


def latest_per(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The row of each key that is greatest in `order`: an aggregation, so hot keys are combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col("__row")[c].alias(c) for c in rest])


def first_per(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The row of each key that is least in `order`."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col("__row")[c].alias(c) for c in rest])


def exists_flag(df: DataFrame, other: DataFrame, key: str, name: str) -> DataFrame:
    """df with a boolean column: whether `other` holds the key. A null key is held by none."""
    return df.join(other.select(key).distinct().withColumn("__there", F.lit(True)), key, "left").withColumn(
        name, F.coalesce("__there", F.lit(False))
    ).drop("__there")


def priority_pick(df: DataFrame, keys: Sequence[str], ranks: Sequence[Column], *newest: str) -> DataFrame:
    """Of each key the row of the first rank (condition) any of its rows meets; the newest of these."""
    rank = F.lit(0)
    for i, condition in enumerate(ranks):
        rank = F.when(condition & (rank == 0), F.lit(len(ranks) - i)).otherwise(rank)
    ranked = df.withColumn("__rank", rank)
    return latest_per(ranked, keys, "__rank", *newest).drop("__rank")


def divide(df: DataFrame, owner: str, item: str, wanted: DataFrame) -> DataFrame:
    """Owners holding every item of `wanted`; none if that list is empty or holds a null."""
    asked = wanted.select(F.col(item)).distinct()
    size = asked.agg(F.count("*").alias("n"), F.count(item).alias("known"))
    held = df.select(owner, item).distinct().join(asked, item).groupBy(owner).agg(F.count("*").alias("held"))
    return held.join(F.broadcast(size), (F.col("held") == F.col("n")) & (F.col("n") == F.col("known"))).select(owner)


def ambiguous(df: DataFrame, key: str, identity: str, name: str) -> DataFrame:
    """Keys standing for more than one identity, or for an unknown one beside several names."""
    return df.groupBy(key).agg(
        F.countDistinct(identity).alias("identities"), F.count("*").alias("n_rows"), F.count(identity).alias("known"), F.countDistinct(name).alias("names")
    ).where("identities > 1 or (n_rows > known and names > 1)")


def unique_or_null(df: DataFrame, key: str, value: str) -> DataFrame:
    """key -> value where the key has exactly one row, else no row: for anchors that must not guess."""
    return df.groupBy(key).agg(F.count("*").alias("__n"), F.max(value).alias(value)).where("__n = 1").drop("__n")


def union_tagged(parts: dict[str, DataFrame], tag: str) -> DataFrame:
    out = None
    for name, part in parts.items():
        tagged = part.withColumn(tag, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def ties_at_max(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """All rows tied at the greatest value of `order` in their group."""
    top = df.groupBy(*keys).agg(F.max(order).alias("__top"))
    return df.join(top, list(keys)).where(order == F.col("__top")).drop("__top")


def anti_pairs(df: DataFrame, entity: str, shared: str, held: DataFrame, items: Sequence[str]) -> DataFrame:
    """Pairs (one < other) of entities sharing a value, but for those that also hold an item together; as often as their rows meet.

    Items meet within a shared value, so that only pairs that share both are listed. They go as lists to the entities, which are
    paired block by block of those with their value: of the pairs, only these lists are shuffled. No value or list has a cap.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = F.ceil(F.count("*").over(Window.partitionBy("__value")) / _BLOCK).cast("int")
    placed = df.select(F.col(shared).alias("__value"), F.col(entity).alias("one")).withColumn("__of", blocks)
    # Never null, also to the planner: a test for null on one side alone would keep the items' shuffle from being used for both.
    placed = placed.withColumn("__block", F.coalesce(F.pmod(F.xxhash64("one"), "__of").cast("int"), F.lit(0)))

    # A join normalises keys that are floats, and so shuffles again what already stands by them; as text (without -0.0) they stay put.
    kinds = dict(held.dtypes)
    asked = [F.col(c) if kinds[c] not in ("float", "double") else (F.col(c) + F.lit(0).cast(kinds[c])).cast("string") for c in items]
    keys = [*[f"__item{i}" for i in range(len(items))], "__value"]
    own = held.select(F.col(entity).alias("one"), *[c.alias(k) for c, k in zip(asked, keys)])
    own = own.join(placed.select("one", "__value", "__block").distinct(), "one").repartition(*keys).distinct()
    met = own.drop("__block").join(own.withColumnRenamed("one", "other"), keys).where("one < other").select("__value", "__block", "one", "other").distinct()
    met = met.groupBy("__value", "__block", "one").agg(F.collect_list("other").alias("__met"))

    asking = placed.select("__value", "one", F.explode(F.sequence(F.lit(0), F.col("__of") - 1)).alias("__block"))
    asking = asking.join(met, ["__value", "__block", "one"], "left").withColumn("__met", F.coalesce("__met", F.array().cast(met.schema["__met"].dataType)))
    # By a number of partitions: few rows make many pairs, which adaptive execution doesn't know.
    pairs = asking.repartition(n, "__value", "__block").join(placed.select("__value", "__block", F.col("one").alias("other")), ["__value", "__block"])
    return pairs.where((F.col("one") < F.col("other")) & ~F.array_contains("__met", F.col("other"))).select(F.col("__value").alias(shared), "one", "other")


def strict_mode(df: DataFrame, group: str, value: str) -> DataFrame:
    """group -> value held by more than half of its rows, where there is one."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("n"))
    whole = df.groupBy(group).agg(F.count("*").alias("of"))
    return counts.join(whole, group).where("n * 2 > of").select(group, F.col(value).alias(f"{value}_mode"), "n", "of")


def top_k(df: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rank_in_group", F.row_number().over(w)).where(F.col("rank_in_group") <= k)


def compact(df: DataFrame, keys: Sequence[Column | str], *newest: str) -> DataFrame:
    """Last write wins on keys that may be expressions; the tables have no MERGE."""
    named = [F.col(k) if isinstance(k, str) else k for k in keys]
    held = df.select(*[k.alias(f"__k{i}") for i, k in enumerate(named)], "*")
    return latest_per(held, [f"__k{i}" for i in range(len(named))], *newest).select(*df.columns)


def merge_rows(old: DataFrame, new: DataFrame, key: str, same: Column, kept: Sequence[str]) -> DataFrame:
    """Upsert: new rows win; columns in `kept` survive from the old row where the new one has none and `same` (old., new.) holds."""
    o, n = old.alias("old"), new.alias("new")
    joined = o.join(n, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")
    out = [F.coalesce(f"new.{key}", f"old.{key}").alias(key)]
    for c in (c for c in new.columns if c != key):
        fresh = F.when(F.col(f"new.{key}").isNull(), F.col(f"old.{c}"))
        out.append((fresh.otherwise(F.coalesce(f"new.{c}", F.when(same, F.col(f"old.{c}")))) if c in kept else fresh.otherwise(F.col(f"new.{c}"))).alias(c))
    return joined.select(*out)


def relocate(df: DataFrame, path: str, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """Paths below `old` rewritten to stand below `new`, and the rows refused since their new path is taken."""
    inside = F.col(path).startswith(old.rstrip("/") + "/")
    moved = df.where(inside).withColumn("moved_to", F.concat(F.lit(new), F.substring(path, len(old.rstrip("/")) + 1, 1_000_000)))
    taken = df.where(~inside).select(F.col(path).alias("moved_to"))
    return moved.join(taken, "moved_to", "left_anti"), moved.join(taken, "moved_to", "left_semi")


def running(df: DataFrame, group: str, order: Sequence[Column], value: Column, name: str, row: str) -> DataFrame:
    """Add the running total of `value` (this row included) and the row's number within its group.

    The rows are cut into ranges of group and order; sums per range make a
    small table that gives each range its start, and only within a range rows
    are ordered in one task. So a group that holds a third of all rows is
    spread over as many tasks as its ranges. `order` must be total.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = df.withColumn("__v", F.coalesce(value.cast("bigint"), F.lit(0))).repartitionByRange(n, F.col(group), *order)
    sliced = cut_lineage(sliced.withColumn("__slice", F.spark_partition_id()))
    sums = sliced.groupBy(F.col(group).alias("__g"), F.col("__slice").alias("__s")).agg(F.sum("__v").alias("__sum"), F.count("*").alias("__n"))
    before = Window.partitionBy("__g").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("__g", "__s", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("__sum", "__n")])
    within = Window.partitionBy(group, "__slice").orderBy(*order)
    own = sliced.withColumn("__within", F.sum("__v").over(within.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__row", F.row_number().over(within))
    joined = own.join(starts, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__slice") == F.col("__s")))
    return joined.select(*df.columns, (F.col("__sum_before") + F.col("__within")).alias(name), (F.col("__n_before") + F.col("__row")).alias(row))


def budget(df: DataFrame, group: str, size: str, limit: int, *newest_first: Column) -> DataFrame:
    """Rows of each group kept within a budget of sizes, newest first; the newest is kept whatever its size."""
    total = running(df, group, newest_first, F.col(size), "__total", "__row")
    kept = (F.col("__total") <= limit) | (F.col("__row") == 1)
    return total.withColumn("before", F.col("__total") - F.coalesce(size, F.lit(0))).withColumn("kept", kept).drop("__total", "__row")


def trail(df: DataFrame, group: str, failed: Column, *order: str) -> DataFrame:
    """Steps of each trail before its first failure, with the place in which they are to be undone."""
    place = F.struct(*order)
    first = df.where(failed).groupBy(group).agg(F.min(place).alias("__first"))
    done = df.join(first, group, "left").where(F.col("__first").isNull() | (place < F.col("__first"))).drop("__first")
    undone = running(done, group, [F.col(c).desc() for c in order], F.lit(0), "__total", "undo_order")
    return undone.withColumn("undo_order", F.col("undo_order").cast("int")).drop("__total")


def numbers_repeat(df: DataFrame, group: str, number: str, least: int = 2) -> DataFrame:
    """Groups in which every number from 1 to n stands equally often, at least twice: several sets in one place."""
    counts = df.groupBy(group, number).agg(F.count("*").alias("k"))
    whole = counts.groupBy(group).agg(F.min("k").alias("least"), F.max("k").alias("most"), F.count("*").alias("n_numbers"), F.max(number).alias("top"), F.min(number).alias("low"))
    return whole.where(f"least = most and least >= {least} and low = 1 and top = n_numbers")


def descendants(df: DataFrame, path: str) -> DataFrame:
    """folder, files_below: files in each folder and all folders below it, by the ancestors of each path."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return df.where(F.col(path).contains("/")).select(F.explode(above).alias("folder")).groupBy("folder").agg(F.count("*").alias("files_below"))
