"""Wrong encodings, look-alikes, stuffing: small tables, brute force and round trips."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import garble_tables, lookalikes, mojibake, stuffing

PLAIN = ["Coração de João", "Canção do Avô", "Żółty Świt", "Šťastný Čas", "Тихий Город", "Ήσυχο Ταξίδι", "夜のラジオ", "Güneşli Işık", "Blá Þrá", "Quinta Velha²", "at 6½", "for ‘You’"]


@pytest.mark.parametrize("written,read", [("utf_8", "latin_1"), ("utf_8", "cp1252"), ("utf_8", "mac_roman"), ("utf_8", "cp437"), ("utf_8", "cp850"), ("utf_8", "cp1251"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp1252", "cp437")])
def test_round_trip_through_each_pair(written, read):
    for text in PLAIN[:4]:
        for token in text.split():
            if token.isascii():
                continue
            try:
                raw = token.encode(written)
            except UnicodeEncodeError:
                continue
            garbled = garble_tables.lenient_decode(raw, read)
            if garbled and garbled != token and not garbled.isascii():
                assert token in [r for r, _, _ in mojibake.readings(garbled)], (token, garbled)


@pytest.mark.parametrize("written,text", [("gbk", "我爱你"), ("euc_jp", "静かな散歩道"), ("cp932", "夜のラジオ"), ("cp949", "작은노래"), ("utf_8", "夜のラジオ")])
def test_east_asian_tables_through_all_readers(written, text):
    for read in garble_tables.READ_AS:
        garbled = garble_tables.lenient_decode(text.encode(written), read)
        if garbled and garble_tables.lenient_encode(garbled, read) == text.encode(written) and not set(garbled) & set(" _[]{}\\"):
            assert text in [r for r, _, _ in mojibake.readings(garbled)], (read, garbled)


def test_signs_between_letters_prove_nothing(spark):
    plain = ["Hits A–Z", "LED–Zeppelin IV", "rock“n”roll", "I♥NY", "→ Left", "créée", "Coração", "GUÐRÚN", "Café★Bar", "«BLÅ»", "50€uro", "L’Été…Encore", "Beyoncé—Live"]
    bad = ["StraÃe", "Ð\u009dÐ¾Ñ\u0087", "ï¿½Ame", "ÐÐ¾ÐµÐ·Ð´", "Cna‡Æo", "GÃ¼neÅli"]
    df = spark.createDataFrame(list(enumerate(plain + bad)), "id long, text string")
    assert {r["text"] for r in mojibake.find_garbled(df, "text", ["id"]).join(df, "id").collect()} == set(bad)


def test_find_and_restore(spark):
    rows = [(i, t) for i, t in enumerate(PLAIN * 4)]
    bad = [(100, "CoraÃ§Ã£o de JoÃ£o"), (101, "Coraçăo � x"), (102, "Can\x8d‹o do Av™"), (103, "CoraÃ\x83Â§Ã\x83Â£o"), (104, "x/Ð¢Ð¸Ñ\x85Ð¸Ð¹ plain Coração"), (104, "x/Ð¢Ð¸Ñ\x85Ð¸Ð¹ plain Coração")]
    none = [(200, None), (201, ""), (202, "plain ascii " * 20_000), (203, "Quintа Velha"), (204, "Ｑｕｅ")]
    df = spark.createDataFrame(rows + bad + none, "id long, text string").withColumn("restored", F.lit("clash"))
    got = {r["id"]: (r["restored"], r["whole"]) for r in mojibake.restore(df.drop("restored"), "text", ["id"]).collect()}
    assert set(got) == {100, 101, 102, 103, 104}
    assert got[100] == ("Coração de João", True) and got[103] == ("Coração", True) and got[104] == ("x/Тихий plain Coração", True)
    assert not got[101][1] and got[102][0].startswith("Canção do")
    assert mojibake.restore(df.limit(0), "text", ["id"]).count() == 0


def test_plain_forms(spark):
    cases = {
        "Ｒｉｖｉèｒｅ ｄ＇Éｔé": "Rivière d'Été", "Signa\u200cl": "Signal", "Оrаção": "Oração", "Sa\u0303o": "São", "A\u00a0B": "A B", "Inﬆrumental": "Instrumental", "\u212aüste": "Küste",
        "Тpaмвaй": "Трамвай", "Chоіr²": "Choir²", "do а Sertão": "do a Sertão",
    }
    for shown, plain in cases.items():
        assert lookalikes.plain_form(shown) == plain, shown
    same = ["Тихий Город", "Ήσυχο Ταξίδι", "夜のラジオ", "12″ Mix – Nº 3 at 6½ “x” ‘y’ …²⅓", "Küste", "ВЕТЕР", "", "x" * 100_000]
    for text in same:
        assert lookalikes.plain_form(text) == text
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*cases, *same, None])], "id long, t string").withColumn("plain", F.lit("clash"))
    got = {r["id"]: r["plain"] for r in lookalikes.to_plain(df, "t", ["id"]).collect()}
    assert got == dict(enumerate(cases.values()))


def test_quick_check_passes_nothing_that_a_rule_changes(spark):
    shown = {"Som dɑ Noite": "Som da Noite", "Sonɡ": "Song", "Miſt": "Mist", "Ĳs": "IJs", "ĳs": "ijs", "Ǆep": "DŽep", "ǉeto": "ljeto", "ǌe": "nje", "ǳ": "dz", "Küste ĸ¾ß": None}
    df = spark.createDataFrame(list(enumerate(shown)), "id long, t string")
    assert {r["t"]: r["plain"] for r in lookalikes.to_plain(df, "t", ["id"]).collect()} == {t: p for t, p in shown.items() if p}


def _spliced(text):
    parts, at = [], 0
    for start, end, canonical in lookalikes._segments(text):
        parts += (text[at:start], canonical)
        at = end
    return "".join([*parts, text[at:]])


def test_segments_equal_normalisation_of_the_whole():
    every = [chr(c) for c in range(0x80, 0x30000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co") and not any(map(lookalikes._compatible, unicodedata.normalize("NFD", chr(c))))]
    for c in every:
        for shown in (c, unicodedata.normalize("NFD", c)):
            assert _spliced(f"a{shown}b") == unicodedata.normalize("NFC", f"a{shown}b"), hex(ord(c))
    rng = random.Random(7)
    marks = [c for c in every if unicodedata.combining(c)] + sorted(lookalikes._joining())
    for _ in range(3000):
        text = "".join(rng.choice(marks if rng.random() < 0.5 else every) for _ in range(8))
        assert _spliced(text) == unicodedata.normalize("NFC", text), ascii(text)
    for text in ["한국의 노래", "বাংলা গোলাপ", "தமிழ் கொடி", "Việt Nam"]:
        assert lookalikes.plain_form(unicodedata.normalize("NFD", text)) == text


def test_plain_form_is_stable():
    for text in ["Ｒｉｖ", "Оrаção", "Тpaмвaй", "Sa\u0303o \u200bx", "ﬁn"]:
        assert lookalikes.plain_form(lookalikes.plain_form(text)) == lookalikes.plain_form(text)


STUFFED = [
    "vinyl records | stylus | vinyl records | box set | stylus | vinyl records | box set | stylus | vinyl records | stylus",
    "\n".join(f"Home > Vinyl > Stylus > Box {i % 3}" for i in range(12)),
    " ".join(f"#boxset #stylus{i}" for i in range(10)),
    "\n".join(f"Title {i} - https://shop{i}.example/p/{i}" for i in range(10)),
    "Our stylus team sells stylus to every stylus lover. Looking for stylus? Here stylus means stylus you can trust. " * 4,
    "A short sentence before all of that, with some words. " + "colored vinyl ★ used records ✓ colored vinyl ! used records & " * 12,
]
NOUNS = "lamp table chair sofa rug mirror vase clock shelf desk bed pillow blanket towel curtain basket candle frame tray bowl plate cup mug glass fork knife".split()
STUFFED += [", ".join(NOUNS), "\n".join(NOUNS), "A word before.\n" + " ".join([*NOUNS, *(w + "s" for w in NOUNS)] * 5)]
TEXT = [
    "\n".join(f"{i}. Silver {w}" for i, w in enumerate(NOUNS)), "\n".join(f"A{i} {w.title()}" for i, w in enumerate(NOUNS)), ", ".join(f"Ana{w} Silva{w}".title() for w in NOUNS),
    "The gatefold never quite reaches a stubborn hum, and the old mono cut answers the melody. See https://a.example and https://b.example #mono #jazz",
    "\n".join(f"{i}. The Silver Garden {i} 3:{10 + i}" for i in range(1, 15)),
    "\n".join(f"2023-04-{i:02}T09:41:06 DEBUG measure: unit {i} left as it was after {i} ms" for i in range(1, 20)),
    "\n".join(f"19{60 + i}  Silver Garden  LP" for i in range(15)),
    "\n".join(f"Anna Smith{i}: horn arrangement" for i in range(12)),
    "And the river carries on to the sea, my love\nAnd the river carries on to the sea, my love\nAll the boats are gone but the song is with me\n" * 4,
    "", "word",
]


def test_stuffing(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*STUFFED, *TEXT, None])], "doc_id long, text string").withColumn("links", F.lit(1))
    got = {r["doc_id"]: r["stuffed"] for r in stuffing.judge_pages(df).collect()}
    assert got == {i: i < len(STUFFED) for i in range(len(STUFFED) + len(TEXT) + 1)}
    assert stuffing.judge_pages(df.limit(0)).count() == 0
