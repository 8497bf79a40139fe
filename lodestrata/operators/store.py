"""Writes of a catalogue as transformations: what the table holds afterwards, as a DataFrame.

Keys that may be null are compared null-safely where it says so. Nothing is
collected; each operator aggregates by its key before it joins. Empty inputs
give the other side unchanged; repeated rows count by the newest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import latest_per, running


def adopt(old: DataFrame, new: DataFrame, key: str, path: str, signature: str) -> DataFrame:
    """New rows with the key they keep and how: by path, by the signature of an old row whose path is gone (the least such key), or new (null)."""
    here = old.groupBy(path).agg(F.min(key).alias("__by_path"))
    gone = old.join(new.select(path).distinct(), path, "left_anti").where(F.col(signature).isNotNull()).groupBy(signature).agg(F.min(key).alias("__by_signature"))
    joined = new.join(here, path, "left").join(gone, signature, "left")
    how = F.when(F.col("__by_path").isNotNull(), "path").when(F.col("__by_signature").isNotNull(), "adopted").otherwise("new")
    return joined.withColumn("kept_key", F.coalesce("__by_path", "__by_signature")).withColumn("how", how).drop("__by_path", "__by_signature")


def supersede(df: DataFrame, group: str, order: str, proposed: Column) -> DataFrame:
    """df with `superseded`: proposals behind which the group has a later row. By the group's last row, without a window over it."""
    last = df.groupBy(group).agg(F.max(order).alias("__last"))
    return df.join(last, group, "left").withColumn("superseded", proposed & F.coalesce(F.col(order) < F.col("__last"), F.lit(False))).drop("__last")


def replace_children(old: DataFrame, new: DataFrame, parent: str, child: str, kept: Sequence[str], same: str) -> DataFrame:
    """Children of the parents that `new` holds are replaced; others stay. Columns in `kept` survive where the child's `same` is unchanged and it has none of its own."""
    before = old.select(parent, child, F.col(same).alias("__same"), *[F.col(c).alias(f"__{c}") for c in kept])
    joined = new.join(before, [parent, child], "left")
    for c in kept:
        joined = joined.withColumn(c, F.coalesce(c, F.when(F.col("__same").eqNullSafe(F.col(same)), F.col(f"__{c}"))))
    others = old.join(new.select(parent).distinct(), parent, "left_anti")
    return others.unionByName(joined.select(*old.columns))


def claim(old: DataFrame, new: DataFrame, group: str, key: str, proof: str, *newest: str) -> DataFrame:
    """Old rows without a key take that of a new row of their group with the same proof; then the newest per group and key wins."""
    given = new.where(F.col(key).isNotNull()).groupBy(group, proof).agg(F.max(key).alias("__key"))
    claimed = old.join(given, [group, proof], "left").withColumn(key, F.coalesce(key, "__key")).drop("__key")
    return latest_per(claimed.unionByName(new.select(*claimed.columns)), [group, key], *newest)


def update_null_safe(df: DataFrame, changes: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """df with the changes' value where all keys are equal, null to null; a null change leaves the old value. Changes hold a key once."""
    d, c = df.alias("d"), changes.select(*keys, value).alias("c")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"d.{k}").eqNullSafe(F.col(f"c.{k}"))
    return d.join(c, on, "left").select(*[F.coalesce(f"c.{x}", f"d.{x}").alias(x) if x == value else F.col(f"d.{x}") for x in df.columns])


def compact_with_tombstones(df: DataFrame, keys: Sequence[str], deleted: Column, *newest: str) -> DataFrame:
    """The newest row of each key (null-safe), keys whose newest row is a deletion left out."""
    return latest_per(df.withColumn("__deleted", deleted), keys, *newest).where(~F.coalesce("__deleted", F.lit(False))).drop("__deleted")


def exact_or_legacy(asked: DataFrame, held: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """asked with `value`: of the row of the same group and key, else of the group's row without a key; a null key asks only for the latter."""
    exact = held.where(F.col(key).isNotNull()).groupBy(group, key).agg(F.max(value).alias("__exact"))
    legacy = held.where(F.col(key).isNull()).groupBy(group).agg(F.max(value).alias("__legacy"))
    return asked.join(exact, [group, key], "left").join(legacy, group, "left").withColumn(value, F.coalesce("__exact", "__legacy")).drop("__exact", "__legacy")


def duplicates_by_two_proofs(df: DataFrame, place: str, key: str, print_: str) -> DataFrame:
    """value, proof, places: keys held in several places, and prints of several keys in several places."""
    by_key = df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("value")).agg(F.countDistinct(place).alias("places"), F.lit(1).alias("keys"))
    by_print = df.where(F.col(print_).isNotNull()).groupBy(F.col(print_).cast("string").alias("value")).agg(F.countDistinct(place).alias("places"), F.countDistinct(key).alias("keys"))
    same = by_key.where("places > 1").select("value", F.lit("key").alias("proof"), "places")
    return same.unionByName(by_print.where("places > 1 and keys > 1").select("value", F.lit("print").alias("proof"), "places"))


def same_multiset(a: DataFrame, b: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """group, same: whether two tables hold the same rows of a group equally often. By counts; no group is gathered in a list."""
    def counts(df: DataFrame, sign: int) -> DataFrame:
        return df.groupBy(group, *columns).agg((F.count("*") * sign).alias("n"))

    return counts(a, 1).unionByName(counts(b, -1)).groupBy(group, *columns).agg(F.sum("n").alias("n")).groupBy(group).agg((F.max(F.abs("n")) == 0).alias("same"))


def evict_oldest(df: DataFrame, group: str, size: str, limit: int, keep: Column, *oldest_first: Column) -> DataFrame:
    """df with `evicted`: the oldest rows go until the rest fits; rows to keep never go but count."""
    evictable = F.when(F.coalesce(keep, F.lit(False)), 0).otherwise(F.coalesce(size, F.lit(0)))
    total = running(df.withColumn("__size", evictable), group, oldest_first, F.col("__size"), "__upto", "__row")
    whole = df.groupBy(F.col(group).alias("__g")).agg(F.sum(size).alias("__whole"))
    joined = total.join(whole, F.col(group).eqNullSafe(F.col("__g")), "left")
    gone = ~F.coalesce(keep, F.lit(False)) & (F.coalesce("__whole", F.lit(0)) - (F.col("__upto") - F.col("__size")) > limit)
    return joined.withColumn("evicted", gone).drop("__size", "__upto", "__row", "__g", "__whole")


def number_missing(names: DataFrame, held: DataFrame, name: str, key: str) -> DataFrame:
    """Names that the lookup lacks, with keys that go on from its greatest, in the order of the names."""
    top = held.agg(F.coalesce(F.max(key), F.lit(0)).alias("__top"))
    missing = names.select(name).where(F.col(name).isNotNull()).distinct().join(held.select(name), name, "left_anti").withColumn("__all", F.lit(1))
    placed = running(missing, "__all", [F.col(name)], F.lit(0), "__total", "__place")
    # One row.
    return placed.join(F.broadcast(top)).select(name, (F.col("__top") + F.col("__place")).alias(key))


def expand_overrides(overrides: DataFrame, members: DataFrame, group: str, member: str, value: str) -> DataFrame:
    """Overrides of whole groups (member null) as overrides of their members; what a member says itself wins."""
    whole = overrides.where(F.col(member).isNull()).groupBy(group).agg(F.max(value).alias(value))
    own = overrides.where(F.col(member).isNotNull()).select(group, member, value)
    spread = members.select(group, member).distinct().join(whole, group).join(own.select(group, member), [group, member], "left_anti")
    return own.unionByName(spread.select(group, member, value))


def in_order(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """group, in_order: whether values rise along the order of a list; each list is ordered in one task, so lists are to be those of an album's size."""
    w = Window.partitionBy(group).orderBy(order)
    return df.select(group, (F.col(value) >= F.coalesce(F.lag(value).over(w), F.col(value))).alias("__rises")).groupBy(group).agg(F.min("__rises").alias("in_order"))
