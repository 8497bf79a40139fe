import numpy as np
from pyspark.sql import functions as F

from lodestrata.functions import evidence, matching, signals, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_text(spark):
    assert one(spark, "  a \t b\n", text.collapse) == "a b" and one(spark, " \n", text.collapse) is None
    assert one(spark, "Élan à São", text.fold_accents) == "Elan a Sao" and one(spark, None, text.fold_accents) is None
    assert str(one(spark, "1999-00-07", text.partial_date)) == "1999-01-07" and one(spark, "1999-13", text.partial_date) is None
    assert str(one(spark, "1984", text.partial_date)) == "1984-01-01" and one(spark, "x", text.partial_date) is None
    assert one(spark, "3:05", text.duration_ms) == 185000 and one(spark, "1500", text.duration_ms) == 1500 and one(spark, "3:5", text.duration_ms) is None
    assert one(spark, "07/12", text.number_of) == 7 and one(spark, "A1", text.number_of) is None
    assert len(one(spark, "ã" * 400, text.within_bytes).encode()) <= 255 and one(spark, "a/b", text.within_bytes) == "a_b"
    df = spark.createDataFrame([("a b", "b a"), ("abc", "abd"), (None, "x")], "a string, b string").select(matching.similarity("a", "b").alias("s"))
    assert [r["s"] for r in df.collect()] == [1.0, 0.6667, None]
    t = spark.createDataFrame([("t", None), ("t", 1999)], "title string, year int")
    out = t.select(text.render("%title%{ (%year%)}", {"title": F.col("title"), "year": F.col("year")}).alias("r"))
    assert [r["r"] for r in out.collect()] == ["t", "t (1999)"]


def test_casing(spark):
    from lodestrata.functions import casing

    cases = {"tales OF the sea": "Tales of the Sea", "CANÇÃO DO AVÔ": "Canção do Avô", "corazón de la peña - live in the park": "Corazón de la Peña - Live in the Park", "McCoy": "McCoy", "": "", "of": "Of"}
    for text_, wanted in cases.items():
        assert casing.title_case(text_) == wanted
        assert casing.title_case(text_).casefold() == text_.casefold() and casing.title_case(wanted) == wanted
    assert one(spark, None, casing.titles) is None


def test_alignment(spark):
    import itertools
    import random

    from lodestrata.operators import alignment as al

    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.randint(0, 40) for _ in range(rng.randint(0, 5))] for _ in range(2))
        best = max((sum(abs(x - y) <= 6 for x, y in zip(a, p)) for p in itertools.permutations(b + [999] * 5, len(a))), default=0)
        assert al.agreeing(a, b, 6) == best
    assert al.agreeing(None, [1, None]) == 0
    f = [("Silver Garden", 100_000), ("Paper Clock", 200_000)]
    assert al.align(f, [("x", 101_000), ("y", 199_000)]) == ("place", [0, 1])
    assert al.align(f, [("Paper Clock", 1), ("Silver Garden", None), ("z", 5)]) == ("title", [1, 0])
    assert al.align([("a", 100_000), ("b", 200_000)], [("x", 201_000), ("y", 100_500), ("z", 900_000)]) == ("duration", [1, 0])
    assert al.align([], f) == ("none", []) and al.align(f, []) == ("none", [-1, -1]) and al.align([(None, None)], f) == ("none", [-1])
    df = spark.createDataFrame([([("a", 100_000)], [("x", 100_001)]), (None, [("x", 1)])], "f array<struct<n:string,d:long>>, t array<struct<n:string,d:long>>")
    got = df.select(al.aligned("f", "t").alias("x")).select("x.*").collect()
    assert [(r["method"], r["tracks"]) for r in got] == [("place", [0]), ("none", [])]


def test_absent_evidence_drops_out(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, 0.0), (None, None)], "a double, b double")
    got = [r["m"] for r in df.select(evidence.weighted_mean([(F.col("a"), 0.35), (F.col("b"), 0.25)]).alias("m")).collect()]
    assert got == [1.0, 0.5833, None]


def test_signals(spark):
    rate = 11025
    t = np.arange(rate * 4) / rate
    chord = sum(np.sin(2 * np.pi * f * t) for f in (261.63, 329.63, 392.0, 523.25, 293.66, 349.23))
    clicks = np.zeros(rate * 8)
    for i in range(0, len(clicks) - 400, rate // 2):
        clicks[i : i + 400] = np.sin(np.arange(400)) * np.exp(-np.arange(400) / 80)
    assert signals.key_of(chord, rate)[:2] == (0, "major")
    assert abs(signals.tempo_of(clicks, rate)[0] - 120) < 3
    assert signals.key_of(np.zeros(20000), rate) is None and signals.tempo_of(np.zeros(20000), rate) is None
    df = spark.createDataFrame([([1.0, 1.0, 2.0, 3.0, 50.0],), ([1.0],), (None,), ([2.0, 2.0],)], "v array<double>")
    got = df.select(signals.robust_peak(F.col("v")).alias("p"), signals.steepest_fall(F.col("v")).alias("f")).collect()
    assert abs(got[0]["p"] - 48 / 1.4826) < 1e-9 and got[1]["f"] is None and got[2]["p"] is None and got[3]["p"] is None


def test_wheel(spark):
    tones = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
    df = spark.createDataFrame([(i, m) for i in range(12) for m in ("major", "minor")], "t int, m string").select("t", "m", signals.camelot(F.col("t"), F.col("m")).alias("c"))
    codes = {(tones[r["t"]], r["m"]): r["c"] for r in df.collect()}
    assert codes["C", "major"] == "8B" and codes["A", "minor"] == "8A" and codes["B", "major"] == "1B" and codes["E", "major"] == "12B" and codes["C#", "minor"] == "12A" and codes["G#", "minor"] == "1A"
    assert len(set(codes.values())) == 24


def test_spelling_and_ladder(spark):
    from lodestrata.functions import naming

    assert naming.words_apart("Paper Lantern", "Paper Lanterns") == "slip" and naming.words_apart("From Here", "For Here") == "word" and naming.words_apart("Sea", "Sky") == ""
    assert naming.spelling("cancao do AVO", "Canção do Avô") == "Canção do Avô" and naming.spelling("CANÇÃO", "Cancao") == "Canção" and naming.spelling(None, "x") == "x" and naming.spelling("a", "b") == "b"
    df = spark.createDataFrame([("Ana", "Ebb and Flow - Tide (Live)")], "a string, t string")
    rungs = [tuple(q) for q in df.select(naming.query_ladder(F.col("a"), F.col("t"), F.col("a"), F.col("t")).alias("l")).first()["l"]]
    assert rungs[0] == ("Ana", "Ebb and Flow - Tide (Live)", None) and ("Ana", "Ebb and Flow - Tide", None) in rungs and ("Ebb and Flow", "Tide", None) in rungs
    assert ("Ana", "Ebb & Flow - Tide", None) in rungs and len(rungs) == len(set(rungs)) <= 12


def test_titles_agree():
    local, tracks = ["Blue Garden", "Red River", "Night"], ["Blue Garden (Remastered)", "Red River", "Nigth", "Bonus"]
    assert matching.agreeing_titles(local, tracks) == (3, True) and matching.agreeing_titles(local[::-1], tracks) == (3, False)
    assert matching.agreeing_titles(None, tracks) == (0, False) and matching.likeness("São & João", "joao and sao") == 1.0 and matching.likeness("", "x") == 0.0
