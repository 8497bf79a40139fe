"""Pairs that go together: neighbours on a wheel of twelve, and tempi near each other, doubled or halved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Relative difference of tempi that still mix.
TOLERANCE = 0.06


def neighbours(number: Column, ring: Column) -> Column:
    """The codes a code mixes with: itself, a step to either side, and the other ring."""
    def code(n: Column, r: Column) -> Column:
        return F.concat(n.cast("string"), r)

    other = F.when(ring == "A", "B").otherwise("A")
    return F.array(code(number, ring), code(number % 12 + 1, ring), code((number + 10) % 12 + 1, ring), code(number, other))


def key_relation(number: Column, ring: Column, other: Column, other_ring: Column) -> Column:
    """same, relative, up or down of two codes of the wheel; null where they don't mix."""
    return F.when((number == other) & (ring == other_ring), "same").when(number == other, "relative").when((ring == other_ring) & (other == number % 12 + 1), "up").when(
        (ring == other_ring) & (number == other % 12 + 1), "down"
    )


def tempo_relation(source: Column, target: Column) -> Column:
    """same, double or half, the first that holds; null where a tempo is absent or not positive."""
    def near(x: Column) -> Column:
        return F.abs(x - source) / source <= TOLERANCE

    ok = (source > 0) & (target > 0)
    return F.when(ok & near(target), "same").when(ok & near(target / 2), "double").when(ok & near(target * 2), "half")


def mixing_pairs(df: DataFrame, key: str, number: str, ring: str, tempo: str) -> DataFrame:
    """source, target, relation: pairs whose codes are neighbours and whose tempi agree.

    An equi-join on code and tempo band: a row is offered in the bands its
    tempo, its half and its double fall into, so no code is paired in full.
    """
    width = F.log(F.lit(1 + TOLERANCE))
    band = F.floor(F.log(F.col(tempo)) / width)
    alive = df.where(F.col(tempo) > 0)
    source = alive.select(F.col(key).alias("source"), F.col(tempo).alias("t1"), F.explode(neighbours(F.col(number), F.col(ring))).alias("code"), band.alias("band"))
    reach = F.array_distinct(F.flatten(F.transform(F.array(F.lit(0.0), -F.log(F.lit(2.0)), F.log(F.lit(2.0))), lambda s: F.transform(
        F.sequence(F.lit(-2), F.lit(2)), lambda i: F.floor((F.log(F.col(tempo)) + s) / width) + i))))
    target = alive.select(F.col(key).alias("target"), F.col(tempo).alias("t2"), F.concat(F.col(number).cast("string"), F.col(ring)).alias("code"), F.explode(reach).alias("band"))
    pairs = source.join(target, ["code", "band"]).where("source <> target").withColumn("relation", tempo_relation(F.col("t1"), F.col("t2")))
    return pairs.where("relation is not null").select("source", "target", "code", "relation")
