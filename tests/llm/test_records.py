"""Names, canonical values, entities, leaks, mixtures: brute force and planted cases."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from lodestrata.llm import canonical, entities, leaks, mixing, names


def test_bk_tree_against_all_names():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    tree = canonical.BKTree(words)
    for q in words[::10] + ["", "zzz"]:
        for most in (0, 1, 2):
            assert sorted(set(tree.within(q, most))) == sorted({(canonical.distance(q, w), w) for w in words if canonical.distance(q, w) <= most})


def test_distance_is_a_metric():
    rng = random.Random(2)
    some = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 5))) for _ in range(40)]
    assert canonical.distance("ab", "ba") == 1 and canonical.distance("ca", "abc") == 2
    for a in some[:12]:
        for b in some[:12]:
            assert canonical.distance(a, b) == canonical.distance(b, a)
            for c in some[:12]:
                assert canonical.distance(a, c) <= canonical.distance(a, b) + canonical.distance(b, c)


def test_typed_values(spark):
    entries = [(1, "media_grade", "Mint (M)"), (2, "media_grade", "Near Mint (NM or M-)"), (4, "media_grade", "Very Good (VG)"), (9, "country", "Brazil"), (12, "country", "UK"), (51, "categories", "Bossa Nova"), (55, "categories", "Forró")]
    ref = spark.createDataFrame(entries, "value_id long, field_name string, canonical string")
    rows = [(1, "mint", "brésil", "bossa; forro,, Samba ;"), (2, "m-", "the islands", None), (3, " Mint (M) ", "", " "), (4, "muito bm", "G.B.", "Forró"), (4, "muito bm", "G.B.", "Forró"), (5, None, None, None), (6, "x" * 5000, "brzail", "bossanoav")]
    df = spark.createDataFrame(rows, "id long, media_grade string, country string, categories string").withColumn("value_id", F.lit(7))
    got = sorted(tuple(r) for r in canonical.map_values(canonical.typed_values(df, "id"), ref).select("record_id", "field_name", "item_no", "value_id").collect())
    assert got == sorted([
        (1, "media_grade", 0, 1), (1, "country", 0, 9), (1, "categories", 0, 51), (1, "categories", 1, 55), (1, "categories", 2, -1), (2, "media_grade", 0, 2), (2, "country", 0, -1),
        (4, "media_grade", 0, 4), (4, "country", 0, 12), (4, "media_grade", 0, 4), (4, "country", 0, 12), (6, "media_grade", 0, -1), (6, "country", 0, 9), (6, "categories", 0, 51),
    ])
    assert canonical.map_values(canonical.typed_values(df.limit(0), "id"), ref).count() == 0


def test_shards_say_what_one_tree_says(spark, monkeypatch):
    rng = random.Random(8)
    name = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(4, 9)))
    entries = spark.createDataFrame([(i, "city", n) for i, n in enumerate(sorted({name() for _ in range(120)}))], "value_id long, field_name string, canonical string")
    others = spark.createDataFrame([("city", r["canonical"], r["canonical"][::-1]) for r in entries.limit(20).collect()] + [("gone", "x", "y"), (None, None, None)], "field_name string, canonical string, name string")
    values = spark.createDataFrame([(i, "city", 0, name()) for i in range(300)] + [(900, "nowhere", 0, "x")], "record_id long, field_name string, item_no int, typed string")
    whole = sorted(map(tuple, canonical.map_values(values, entries, others).collect()))
    monkeypatch.setattr(canonical, "SHARD", 40)
    monkeypatch.setattr(canonical, "BLOCK", 70)
    assert sorted(map(tuple, canonical.map_values(values, entries, others).collect())) == whole and sum(r[4] >= 0 for r in whole) > 30


def test_very_long_typed_values():
    of = canonical.Reference({"brazil": {(9, "Brazil")}})
    assert of.meant("x" * 10_001) == of.meant("brazil " * 30_000) == -1 and of.meant("brazol") == 9


def test_spellings(spark):
    same = [
        ["Antônio Fútrerjiv", "Fútrerjiv, Antônio", "ANTONIO FUTRERJIV", "A. Fútrerjiv", "Antônio Fútrersiv", "Tonho Fútrerjiv", "Maestro Antônio Fútrerjiv"],
        ["The Tungzistlol Quartet", "Tungzistlol Quartet, The", "TUNGZISTLOL QUARTET"], ["Antônio Kizbransent", "Kizbransent A."], ["Robert Zopvelgrart"], ["Tungmatlol Quartet"],
    ]
    df = spark.createDataFrame([(s,) for group in same for s in group] * 2 + [(None,), ("",), ("...",)], "spelling string").withColumn("class", F.lit(1))
    known = spark.createDataFrame([("Antônio Fútrerjiv", "Tonho Fútrerjiv"), (None, "x")], "spelling_a string, spelling_b string").dropna()
    pairs = {tuple(r) for r in names.spelling_pairs(names.link_spellings(df.select("spelling"), known)).collect()}
    wanted = {tuple(sorted((a, b))) for g in same for a in g for b in g if a < b}
    assert pairs == wanted
    assert names.link_spellings(df.limit(0).select("spelling")).count() == 0


def test_similar_keys_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(names, "DEALT", 7, raising=False)
    rng = random.Random(4)
    given = ["ana", "antonio", "joao", "li"]
    family = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))) for _ in range(12)]
    made = {f"{rng.choice(given)} {rng.choice(family)}{rng.choice(['', 'x', 'ov', 'sky'])}" for _ in range(120)} | {"kizbransent", "kizbransentov"}
    keys = spark.createDataFrame(list(enumerate(sorted(made))), "id long, key string")
    grams = {k: {g for w in k.split(" ") for g in [f"#{w}#"[i : i + names.GRAM] for i in range(max(len(w) + 3 - names.GRAM, 1))]} for k in made}
    df = Counter(g for of in grams.values() for g in of)
    weight = {g: math.log(1 + len(made) / n) for g, n in df.items()}
    length = {k: math.sqrt(sum(weight[g] ** 2 for g in of)) for k, of in grams.items()}
    cosine = {(a, b): sum(weight[g] ** 2 for g in grams[a] & grams[b]) / length[a] / length[b] for a in made for b in made if a < b}
    got = {(r["key_a"], r["key_b"]): r["cosine"] for r in names.similar_keys(keys).collect()}
    assert set(got) == {p for p, c in cosine.items() if c >= names.COSINE} and all(abs(got[p] - cosine[p]) < 1e-9 for p in got)
    linked = {r["key"]: r["class"] for r in names.link_spellings(keys.select(F.col("key").alias("spelling"))).collect()}
    assert linked["kizbransent"] == linked["kizbransentov"]


def test_linkage_in_task_and_by_joins(spark, monkeypatch):
    rng = random.Random(5)
    links = {}
    for part in range(6):
        for _ in range(rng.randint(1, 40)):
            a, b = sorted(rng.sample(range(part * 100, part * 100 + rng.randint(3, 14)), 2))
            links[a, b] = rng.uniform(0.4, 1)

    def slow(of):
        groups = {n: {n} for p in of for n in p}
        while True:
            means = {(x, y): sum(of.get((min(a, b), max(a, b)), 0) for a in groups[x] for b in groups[y]) / len(groups[x]) / len(groups[y]) for x in groups for y in groups if x < y}
            best = max(means, key=means.get, default=None)
            if best is None or means[best] < names.LINKAGE:
                return {n: x for x, of in groups.items() for n in of}
            groups[best[0]] |= groups.pop(best[1])

    wanted = slow(links)
    assert names.average_linkage((a, b, w) for (a, b), w in links.items()) == wanted
    df = spark.createDataFrame([(a, b, w) for (a, b), w in links.items()], "a long, b long, cosine double")
    for most in (50_000, 2):
        monkeypatch.setattr(names, "IN_TASK", most)
        got = [tuple(r) for r in names.linked_classes(df).select("id", "class").collect()]
        assert sorted(got) == sorted(wanted.items())


NOTE = "the quiet producer told Anderson that seventeen musicians recorded inside the lighthouse while Bertram counted every falling leaf beside the frozen canal before sunrise came"
ITEM = "Read this note.\n\n{}\n\nWhat is asked?"


def test_leaks(spark):
    other = "her uncle carried nine heavy lanterns across Marrowgate bridge because nobody believed the printed timetable any longer said Corvina Holt"
    items = spark.createDataFrame([(1, ITEM.format(NOTE)), (2, ITEM.format(other)), (3, ITEM.format("too short")), (4, None), (5, ""), (6, ITEM.format(NOTE))], "item_id long, text string")
    w = NOTE.split()
    docs = {
        10: "Before. " + NOTE.upper().replace(" ", "  ") + " After.", 11: " ".join(w[3:19]), 12: " ".join(w[3:14]), 13: " ".join(w[:6] + ["maybe"] + w[7:13] + ["quite"] + w[14:20]),
        14: "<p>" + " ".join(f"<b>{x}</b>" if i % 4 == 0 else x for i, x in enumerate(w[:18])) + "</p>", 15: NOTE.replace("lighthouse", "light-\nhouse"), 16: "Read this note. What is asked?",
        17: None, 18: "", 19: other + " " + NOTE, 20: NOTE, 21: " ".join(reversed(w)), 22: "filler words " * 50_000 + NOTE,
    }
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumn("item_id", F.lit(0))
    got = {tuple(r) for r in leaks.find_leaks(items, df).collect()}
    wanted = {(i, d) for i in (1, 6) for d in (10, 11, 13, 14, 15, 19, 20, 22)} | {(2, 19)}
    assert got == wanted
    assert leaks.find_leaks(items.limit(0), df).count() == 0 and leaks.find_leaks(items, df.limit(0)).count() == 0


def test_budgets():
    assert mixing.budgets([("a", 0.5, 1), ("b", 0.5, 1)], {"a": 100, "b": 100}) == {"a": 100.0, "b": 100.0}
    got = mixing.budgets([("a", 0.5, 1), ("b", 0.5, 3), ("c", 0.0, 3), ("gone", 0.2, 4)], {"a": 300, "b": 20})
    assert got["b"] == 60 and abs(got["a"] - 260) < 1e-6 and got["c"] == 0 and got["gone"] == 0
    assert mixing.budgets([], {}) == {}


def test_mixture(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["big", "big", "big", "small", "other", None]), "some words of text " * rng.randint(1, 30)) for i in range(600)] + [(900, "big", None), (901, "small", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("tokens", F.lit(1))
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 2), ("none", 0.0, 3)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mix(docs, targets)
    got = {r["source"]: r for r in report.collect()}
    whole = sum(r["available_tokens"] for r in got.values())
    for s in ("big", "small"):
        assert abs(got[s]["reached_tokens"] - got[s]["budget_tokens"]) <= 200, got[s]
    assert abs(sum(r["reached_tokens"] for r in got.values()) - whole) <= 400 and got["none"]["reached_tokens"] == 0
    times = [r["times"] for r in chosen.where("source = 'small'").collect()]
    assert max(times) <= 2 and chosen.where("doc_id >= 900").count() == 0
    assert sorted(map(tuple, chosen.collect())) == sorted(map(tuple, mixing.mix(docs.repartition(7), targets)[0].collect()))


def _releases(spark):
    def release(i, title, artist, date, n, edition=""):
        payload = f'{{"artists": [{{"name": "{artist}", "credited_as": null}}], "tracks": []}}'
        return (i, "discogs", str(i), title + edition, artist, date, None, n, payload)

    kind = "id long, source string, source_release_id string, title string, primary_artist string, released_on string, original_released_on string, track_count int, payload string"
    return spark.createDataFrame([
        release(1, "Canção do Avô", "Antônio Fútrerjiv", "1999", 9), release(2, "CANÇÃO DO AVÔ", "Fútrerjiv, Antônio", "1999-05", 9, " (Deluxe Edition)"),
        release(3, "Canção do Avô Vol. 2", "Antônio Fútrerjiv", "2001", 9), release(4, "Canção do Avô", "Robert Zopvelgrart", "1999", 9),
        release(5, "Canção do Avô Live", "Antônio Fútrerjiv", "2003", 9), (6, None, None, None, None, None, None, None, None),
    ], kind)


def test_same_album(spark):
    paths = {
        1: "/m/Antônio Fútrerjiv/1999 - Canção do Avô [FLAC]", 2: "/m/Canção do Avô [A. Fútrerjiv, 1999]", 3: "/m/antônio_fútrerjiv_-_canção_do_avô_vol._2-f123-2001", 4: "/m/Antônio.Fútrerjiv.Cancao.do.Avo.1999.MP3",
        5: "/m/Unknown Album (1234567)", 6: "/m/Robert Zopvelgrart - Canção do Avô (1999) (320)/CD1", 7: None, 8: "/m/Antonio Futrejiv/CanÃ§Ã£o do AvÃ´ copy", 9: "/m/Antônio Fútrerjiv - Canção do Avô Live (2003)", 10: "",
    }
    units = spark.createDataFrame([(i, p, 9, 1000) for i, p in paths.items()], "id long, folder_path string, track_count int, total_duration_ms long").withColumn("title", F.lit("clash"))
    releases = _releases(spark)
    spellings = releases.select(F.col("primary_artist").alias("spelling"))
    known = spark.createDataFrame([], "spelling_a string, spelling_b string")
    got = {(r["album_unit_id"], r["release_id"]) for r in entities.match(units, releases, spellings, known).collect()}
    assert got == {(u, r) for u in (1, 2, 4, 8) for r in (1, 2)} | {(3, 3), (6, 4), (9, 5)}


def test_artists_without_a_rare_word(spark):
    albums = [("Águas Vivas", "Gal Costa"), ("Noite Azul", "Ana Costa"), ("Rio Manso", "Rui Costa"), ("Serra Alta", "Leonor Costa"), ("Ring Song", "Abba"), ("Serra Alta", "Ana Kim")]
    payload = '{{"artists": [{{"name": "{}", "credited_as": null}}], "tracks": []}}'
    rows = [(i, "discogs", str(i), t, a, "1999", None, 9, payload.format(a)) for i, (t, a) in enumerate(albums, 1)]
    releases = spark.createDataFrame(rows, _releases(spark).schema)
    paths = {
        1: "/m/Gal Costa - Águas Vivas", 2: "/m/Costa - Noite Azul (1999)", 3: "/m/Rui Costa/1999 - Rio Manso [FLAC]", 4: "/m/L. Costa/Serra Alta", 5: "/m/Abba - Ring Song (1999)",
        6: "/m/Ana Kim - Serra Alta", 7: "/m/Costa - Rio Branco (1999)", 8: "/m/Ana Zupkovic - Rio Manso",
    }
    units = spark.createDataFrame([(i, p, 9, 1000) for i, p in paths.items()], "id long, folder_path string, track_count int, total_duration_ms long")
    known = spark.createDataFrame([], "spelling_a string, spelling_b string")
    found = entities.match(units, releases, releases.select(F.col("primary_artist").alias("spelling")), known)
    assert {(r["album_unit_id"], r["release_id"]) for r in found.collect()} == {(i, i) for i in range(1, 7)}


def test_family_names_of_many_and_short_names(spark):
    rng = random.Random(6)
    made = lambda n: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(n)).title()
    artists = [f"{made(3)} Silveira" for _ in range(60)] + [f"{made(1)} {made(2)}" for _ in range(20)] + ["Nico", "Cher", "Abba"]
    albums = [(a, f"{made(3)} {made(4)}") for a in dict.fromkeys(artists) for _ in range(2)]
    payload = '{{"artists": [{{"name": "{}", "credited_as": null}}], "tracks": []}}'
    rows = [(i, "discogs", str(i), t, a, "1999", None, 9, payload.format(a)) for i, (a, t) in enumerate(albums)]
    releases = spark.createDataFrame(rows, _releases(spark).schema)
    styles = ["/m/{a} - {t} (1999)", "/m/{a}/1999 - {t} [FLAC]", "/m/{t} [{a}, 1999]"]
    units = spark.createDataFrame([(i, styles[i % 3].format(a=a, t=t), 9, 1000) for i, (a, t) in enumerate(albums)], "id long, folder_path string, track_count int, total_duration_ms long")
    found = {(r["album_unit_id"], r["release_id"]) for r in entities.match(units, releases, releases.select(F.col("primary_artist").alias("spelling")), spark.createDataFrame([], "spelling_a string, spelling_b string")).collect()}
    true = {(i, i) for i in range(len(albums))}
    assert len(found & true) >= 0.95 * len(true) and len(found - true) <= 0.02 * len(true)


def test_messages_settle(spark):
    pairs = [(i, j) for i in range(9) for j in (i, i + 1)]
    prior = {p: 3.0 for p in pairs}
    to = {p: (0.0, 0.0) for p in pairs}
    for _ in range(400):
        up = {p: (math.exp(prior[p] + to[p][1]), math.exp(prior[p] + to[p][0])) for p in pairs}
        to = {(i, j): tuple(0.5 * old - 0.5 * math.log1p(sum(up[q][k] for q in pairs if q != (i, j) and q[k] == (i, j)[k])) for k, old in enumerate(to[i, j])) for i, j in pairs}
    wanted = {p: 1 / (1 + math.exp(-(prior[p] + sum(to[p])))) for p in pairs}
    edges = spark.createDataFrame([(str(i), str(j), True, prior[i, j]) for i, j in pairs], "left string, right string, left_sure boolean, prior double")
    got = {(int(r["left"]), int(r["right"])): r["confidence"] for r in entities.propagate(edges).collect()}
    assert set(got) == set(wanted) and max(abs(got[p] - wanted[p]) for p in pairs) < 2e-3


def test_evidence_of_nodes(spark):
    row = dict(title="x", same=True, is_short=0, lost_alike=0, both_known=False, named_exactly=1, f_tracks=None, r_tracks=None)
    sets = dict(f_years=[1970, 1999], r_years=[1971, 2010], f_numbers=["5"], r_ids=["5", "9"], f_durations=[1_000_000], r_durations=[1_010_000, 2_000_000])
    kind = "title string, same boolean, is_short int, lost_alike int, both_known boolean, named_exactly int, f_tracks double, r_tracks double, "
    kind += "f_years array<int>, r_years array<int>, f_numbers array<string>, r_ids array<string>, f_durations array<long>, r_durations array<long>"
    cases = [sets, {**sets, "f_durations": [1_500_000]}, {**sets, "f_durations": [], "r_ids": ["9"]}]
    df = spark.createDataFrame([tuple({**row, **c}.values()) for c in cases], kind)
    assert [round(r[0], 6) for r in df.select(entities._prior()).collect()] == [7.7, 6.9, 5.2]
