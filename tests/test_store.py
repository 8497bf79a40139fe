"""Writes and verdicts on small tables: nulls, repeated rows, empty inputs."""

from pyspark.sql import functions as F

from lodestrata.functions import spectra
from lodestrata.operators import store


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_adoption(spark):
    old = spark.createDataFrame([(1, "a", "s"), (2, "gone", "t"), (3, "gone2", "t"), (4, "gone3", None)], "id long, path string, sig string")
    new = spark.createDataFrame([("a", "x"), ("b", "t"), ("c", None), ("d", "s"), ("d", "s")], "path string, sig string")
    assert rows(store.adopt(old, new, "id", "path", "sig"), "path", "kept_key", "how") == sorted([("a", 1, "path"), ("b", 2, "adopted"), ("c", None, "new"), ("d", None, "new"), ("d", None, "new")], key=str)
    assert store.adopt(old.limit(0), new, "id", "path", "sig").where("how <> 'new'").count() == 0 and store.adopt(old, new.limit(0), "id", "path", "sig").count() == 0


def test_null_keys(spark):
    df = spark.createDataFrame([(1, "a", 5), (None, "a", 6), (None, None, 7)], "x int, y string, v int")
    changes = spark.createDataFrame([(None, "a", 60), (1, "a", None)], "x int, y string, v int")
    assert rows(store.update_null_safe(df, changes, ["x", "y"], "v"), "x", "y", "v") == sorted([(1, "a", 5), (None, "a", 60), (None, None, 7)], key=str)
    kept = store.compact_with_tombstones(df.withColumn("t", F.col("v")), ["y"], F.col("v") == 6, "t")
    assert rows(kept, "y", "v") == [(None, 7)]
    asked = spark.createDataFrame([("g", 1), ("g", 2), ("g", None), ("h", 1), (None, 1)], "g string, k int")
    held = spark.createDataFrame([("g", 1, "one"), ("g", None, "old")], "g string, k int, a string")
    assert rows(store.exact_or_legacy(asked, held, "g", "k", "a"), "g", "k", "a") == sorted([("g", 1, "one"), ("g", 2, "old"), ("g", None, "old"), ("h", 1, None), (None, 1, None)], key=str)


def test_multisets_and_eviction(spark):
    a = spark.createDataFrame([("g", "x"), ("g", "x"), ("h", None), ("i", "z")], "g string, c string")
    b = spark.createDataFrame([("g", "x"), ("h", None), ("j", "z")], "g string, c string")
    assert rows(store.same_multiset(a, b, "g", ["c"]), "g", "same") == [("g", False), ("h", True), ("i", False), ("j", False)]
    copies = spark.createDataFrame([("g", 1, 50, False), ("g", 2, 50, True), ("g", 3, 50, False), ("g", 4, None, False), (None, 1, 500, None)], "g string, t int, size long, keep boolean")
    assert rows(store.evict_oldest(copies, "g", "size", 110, F.col("keep"), F.col("t")), "g", "t", "evicted") == sorted([("g", 1, True), ("g", 2, False), ("g", 3, False), ("g", 4, False), (None, 1, True)], key=str)
    assert store.evict_oldest(copies.limit(0), "g", "size", 1, F.col("keep"), F.col("t")).count() == 0


def test_spectra_of_little(spark):
    kind = "id int, bands array<struct<hertz:int,rms_db:double>>"
    steep = [(10_000, -30.0), (13_000, -32.0), (16_000, -34.0), (17_500, -70.0), (19_000, -71.0), (21_500, -72.0)]
    df = spark.createDataFrame([(1, None), (2, []), (3, [(10_000, -30.0)]), (4, steep), (5, [(h, -30.0 - i) for i, (h, _) in enumerate(steep)])], kind)
    b = F.col("bands")
    out = df.withColumn("dense", spectra.density(b)).select("id", spectra.wall(b)["high"].alias("high"), spectra.floor_from(F.col("dense")).alias("floor"), spectra.cliff(F.col("dense")).alias("cliff"), spectra.decay(b).alias("decay"), spectra.ceiling(b).alias("top"))
    got = {r["id"]: r for r in out.collect()}
    assert got[4]["high"] == 17_500 and got[4]["decay"] == 37.0 and got[4]["top"] == -72.0 and got[4]["cliff"] > 16
    assert [got[i]["high"] for i in (1, 2, 3, 5)] == [None] * 4 and got[2]["top"] == got[1]["top"] == -95.0 and got[3]["decay"] == 0.0 and got[2]["floor"] is None and got[1]["cliff"] == 0.0
