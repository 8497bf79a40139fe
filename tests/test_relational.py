from pyspark.sql import functions as F

from lodestrata.operators import relational as r
from lodestrata.operators.compatibility import mixing_pairs, neighbours, tempo_relation
from lodestrata.operators.components import connected_components


def rows(df, *cols):
    return sorted([tuple(x[c] for c in cols) for x in df.collect()], key=lambda t: [(v is None, v) for v in t])


def test_latest_ties_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, 1, "a", None), (1, 1, "b", 5), (2, None, "c", 1), (None, 3, "d", 2)], "k int, at int, id string, __row_x int")
    assert rows(r.latest_per(df, ["k"], "at", "id"), "k", "id") == [(1, "b"), (2, "c"), (None, "d")]
    assert rows(r.first_per(df, ["k"], "at", "id"), "k", "id") == [(1, "a"), (2, "c"), (None, "d")]
    assert r.latest_per(df.limit(0), ["k"], "at").count() == 0


def test_priority_pick(spark):
    df = spark.createDataFrame([(1, "x", 1), (1, None, 2), (1, "y", 3), (2, "y", 1), (2, "y", 2)], "k int, kind string, at int")
    out = r.priority_pick(df, ["k"], [F.col("kind") == "x", F.col("kind").isNull(), F.lit(True)], "at")
    assert rows(out, "k", "at") == [(1, 1), (2, 2)]


def test_division(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1), ("c", 2), ("c", 3), ("c", 3)], "o string, i int")
    assert rows(r.divide(df, "o", "i", df.where("o = 'a'")), "o") == [("a",), ("c",)]
    assert r.divide(df, "o", "i", df.limit(0)).count() == 0
    assert r.divide(df, "o", "i", spark.createDataFrame([(1,), (None,)], "i int")).count() == 0


def test_ambiguous_unique_ties_mode(spark):
    df = spark.createDataFrame([("s", "k1", "n"), ("s", "k2", "n"), ("t", None, "n1"), ("t", "k", "n2"), ("u", "k", "n")], "sig string, key string, name string")
    assert rows(r.ambiguous(df, "sig", "key", "name"), "sig") == [("s",), ("t",)]
    assert rows(r.unique_or_null(df, "sig", "key"), "sig", "key") == [("u", "k")]
    assert rows(r.strict_mode(df, "sig", "key"), "sig") == [("u",)]
    t = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, 4, "c")], "g int, v int, n string")
    assert rows(r.ties_at_max(t, ["g"], F.col("v")), "n") == [("a",), ("b",)]


def test_merge_keeps_old_only_where_same(spark):
    old = spark.createDataFrame([("p", 10, "d1"), ("q", 5, "d2"), ("r", 1, "d3")], "path string, size int, digest string")
    new = spark.createDataFrame([("p", 10, None), ("q", 6, None), ("s", 2, "d4")], "path string, size int, digest string")
    out = r.merge_rows(old, new, "path", F.col("old.size") == F.col("new.size"), ["digest"])
    assert rows(out, "path", "digest") == [("p", "d1"), ("q", None), ("r", "d3"), ("s", "d4")]


def test_relocate_budget_trail_numbers_descendants(spark):
    df = spark.createDataFrame([("/a/x",), ("/a/y",), ("/b/y",), ("/ab/z",)], "p string")
    moved, refused = r.relocate(df, "p", "/a", "/b")
    assert rows(moved, "moved_to") == [("/b/x",)] and rows(refused, "moved_to") == [("/b/y",)]
    b = spark.createDataFrame([("g", 1, 9), ("g", 2, 3), ("g", 3, 20)], "g string, at int, size int")
    assert rows(r.budget(b, "g", "size", 10, F.col("at").desc()).where("kept"), "at") == [(3,)]
    t = spark.createDataFrame([(1, 1, False), (1, 2, None), (1, 3, True), (1, 4, False)], "g int, s int, failed boolean")
    assert rows(r.trail(t, "g", F.col("failed"), "s"), "s", "undo_order") == [(1, 2), (2, 1)]
    n = spark.createDataFrame([(1, i) for i in (1, 2, 1, 2)] + [(2, 1), (2, 1), (2, 3), (2, 3)], "g int, n int")
    assert rows(r.numbers_repeat(n, "g", "n"), "g") == [(1,)]
    assert rows(r.descendants(df, "p"), "folder", "files_below") == [("", 4), ("/a", 2), ("/ab", 1), ("/b", 1)]


def test_mixing_pairs_against_all_pairs(spark):
    data = [(i, i % 12 + 1, "AB"[i % 2], 60.0 + i * 7 % 130) for i in range(60)] + [(100, 1, "A", 0.0), (101, 1, "A", None)]
    df = spark.createDataFrame(data, "id int, n int, r string, t double")
    a, b = df.select(*[F.col(c).alias(f"a_{c}") for c in df.columns]), df.select(*[F.col(c).alias(f"b_{c}") for c in df.columns])
    code = F.concat(F.col("b_n").cast("string"), F.col("b_r"))
    brute = a.join(b, F.col("a_id") != F.col("b_id")).where(F.array_contains(neighbours(F.col("a_n"), F.col("a_r")), code))
    brute = brute.withColumn("relation", tempo_relation(F.col("a_t"), F.col("b_t"))).where("relation is not null").select(F.col("a_id").alias("source"), F.col("b_id").alias("target"), "relation")
    got = mixing_pairs(df, "id", "n", "r", "t").select("source", "target", "relation")
    assert rows(got, "source", "target", "relation") == rows(brute, "source", "target", "relation") and got.count() > 40


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (None, 1)], "a int, b int")
    got = {x["node"]: x["component"] for x in connected_components(chain, "a", "b").collect()}
    assert {got[i] for i in range(41)} == {0} and got[101] == 100
    assert connected_components(chain.limit(0), "a", "b").count() == 0


def test_sequences(spark):
    from lodestrata.operators import sequences as q

    parts = spark.createDataFrame([("g", "1a", 10), ("g", "1b", 20), ("g", "2", 5), ("g", "3.1", None), ("g", "3.2", 7), ("g", "x", 1), ("g", None, 1)], "g string, i string, ms int")
    assert rows(q.merge_parts(parts, "g", "i", "ms"), "base", "parts", "ms") == [("1", 2, 30), ("2", 1, 5), ("3", 2, None)]
    listed = spark.createDataFrame([("g", 1, "a"), ("g", 2, "b"), ("h", 1, "z")], "g string, p int, t string")
    extras = spark.createDataFrame([("g", 2, "X"), ("g", None, "Y")], "g string, p int, t string")
    assert rows(q.with_extras(listed, extras, "g", "p"), "g", "p", "t") == [("g", 1, "a"), ("g", 2, "X"), ("g", 3, "b"), ("g", 4, "Y"), ("h", 1, "z")]
    titles = spark.createDataFrame([(1, "Hits Vol. 1"), (2, "Hits 2"), (3, "Apollo 13"), (4, None), (5, "Hits Volume 3")], "id int, title string")
    assert rows(q.volumes(titles, "id", "title"), "id", "stem", "volume") == [(1, "hits", 1), (2, "hits", 2), (5, "hits", 3)]


def test_edges_and_top_band():
    import numpy as np

    from lodestrata.functions import signals

    rate, rng = 44100, np.random.default_rng(1)
    noise = rng.standard_normal(rate * 3)
    spectrum = np.fft.rfft(noise)
    hertz = np.fft.rfftfreq(len(noise), 1 / rate)
    cut = np.fft.irfft(np.where(hertz < 16000, spectrum, spectrum * 1e-4), len(noise))
    edge, share = signals.edge_of(cut, rate)
    assert abs(edge - 16000) < 600 and share > 0.8
    assert signals.edge_of(noise, rate) == (0.0, 0.0) and signals.edge_of(np.zeros(rate), rate) is None
    assert signals.top_band_of(cut, rate) < -60 < -3 < signals.top_band_of(noise, rate) and signals.top_band_of(noise[:100], rate) is None
