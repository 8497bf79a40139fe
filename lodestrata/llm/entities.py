"""Folders and releases that are the same album, without a common key.

A folder's path is read in the light of the artists known from the releases.
Its words meet the words of artists and titles, equal or a slip apart, and
each artist class offers keys to be found by: a word that few classes bear,
two words of one name (or a word and an initial), and any commoner word
together with the two rarest words of one of its titles. The last is weak: it
needs year, counts or number beside the title. What is left of the folder's
name after the artist's words, years and format tags gives the title.

Release titles of one class that are slips of each other, but for titles that
several artists use, are one album. Folders and albums of one class whose
titles are equal, a slip apart or cut short are candidates; each has a prior
from title, artist, year, track count, duration and release number.

Candidates of different albums exclude each other: a folder is one album, and
an album that some folder names exactly isn't the one a folder of another
known title means. Loopy belief propagation passes messages between these
one-to-one factors by joins until nothing moves (a warning tells if that
doesn't come about); the marginal probability is
the confidence of the match.

Rows with equal path reading or equal release are folded into one node before,
so copies and a very productive artist don't multiply the candidates; the
join is by artist and title together, never by artist alone.

Defined results: null paths and titles and folders that name no album match
nothing; null counts, durations and dates are no evidence; repeated rows match
under each of their keys.
"""

from __future__ import annotations

import re
import unicodedata
import warnings
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, spread
from . import mojibake, names
from .lookalikes import plain_form

#: Classes in which a word may stand to be a key by itself (commoner ones are keys beside other words), letters of a word that may hold a slip, least confidence.
TELLING, LONG, CONFIDENCE = 3, 5, 0.5
#: Rounds of messages after which a warning tells that they didn't settle, the change that ends them, and how much of a message is kept from the round before.
ROUNDS, STILL, DAMPING = 500, 1e-3, 0.3

# Words that stand beside titles and don't belong to them.
_FORMATS = set("flac mp3 wav ape aac m4a ogg alac web vinyl lp cd rip 320 v0 24 96 192 16 44 copy cd1 cd2 cd3 cd4 id".split())
_EDITIONS = set(
    "mono stereo deluxe edition expanded remaster remastered remasterizado remasterizada reissue bonus anniversary special limited version ep "
    "single edicao edición edition complete original disc disco".split()
)
_DISC = re.compile(r"^(?:cd|disc|disk|disco)[ _\-.]*\d{1,2}$", re.I)
_VOLUME = re.compile(r"\b(?:vol(?:ume|umen|\.)?|pt\.?|part|parte)[ ._]*(\d{1,3}|[ivx]{1,4})\b", re.I)
_NUMBERED = re.compile(r"[(\[](?:id |r|release )?(\d{5,8})[)\]]", re.I)
_TAGGED = re.compile(r"[\[(][^\])]*[\])]")
_YEAR = re.compile(r"(?<!\d)(19[3-9]\d|20[0-3]\d)(?!\d)")
_SCENE = re.compile(r"-[a-z]\d{3}-((?:19|20)\d\d)\s*$", re.I)
_COPY = re.compile(r"\s*(?:copy|#\d+)\s*$|/+\s*$", re.I)
_ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}


@lru_cache(maxsize=1 << 16)
def fold(text: str) -> str:
    bare = unicodedata.normalize("NFKD", plain_form(text).replace("ß", "ss").replace("ı", "i"))
    return "".join(c for c in bare if not unicodedata.combining(c)).casefold()


def words(text: str) -> list[str]:
    return [w for w in re.split(r"[^\w]+|_", fold(text).replace("'", "").replace("’", "")) if w]


def title_parts(text: str) -> tuple[list[str], str]:
    """Words of a title without editions, and its mark: numbers, volume, live."""
    volume = ""

    def take(m: re.Match) -> str:
        nonlocal volume
        volume = str(_ROMAN.get(m[1].lower(), m[1]))
        return " "

    rest = _VOLUME.sub(take, text)
    all_words = [w for w in words(rest) if w not in _EDITIONS and w != "the"]
    live = "live" in all_words or "vivo" in all_words and "ao" in all_words
    numbers = sorted(str(int(w)) for w in all_words if w.isascii() and w.isdigit())
    kept = [w for w in all_words if not (w.isascii() and w.isdigit()) and w != "live"]
    return kept, f"{','.join(numbers)}|{volume}|{'live' if live else ''}"


def read_path(path: str) -> tuple[list[str], list[str], int, str, bool]:
    """Words of the last folder and of the one around it, the year, the release number, and whether letters are lost."""
    while _COPY.search(path):
        path = _COPY.sub("", path)
    parts = [p for p in path.split("/") if p.strip()]
    while len(parts) > 1 and _DISC.match(parts[-1].strip()):
        parts.pop()
    last = parts[-1] if parts else ""
    around = parts[-2] if len(parts) > 1 else ""
    number = _NUMBERED.search(last)
    last = _NUMBERED.sub(" ", last)
    scene = _SCENE.search(last)
    years = [scene[1]] if scene else _YEAR.findall(last)
    last = _SCENE.sub(" ", last)
    return last, around, int(years[0]) if years else 0, number[1] if number else "", "�" in path


def _without_year(text: str, year: int) -> str:
    return re.sub(rf"(?<!\d){year}(?!\d)", " ", text) if year else text


class Known:
    """Words of a class of artists; what was asked once is kept, since a class has many titles made of few words."""

    def __init__(self, held):
        self.held = frozenset(held)
        self.letters = [(k, len(k), frozenset(k)) for k in self.held if len(k) > 3]
        self.asked: dict[str, bool] = {}

    def near(self, word: str) -> bool:
        """Whether a word is one of these or a slip apart; letters are compared as sets before distances are worked out."""
        if word in self.held:
            return True
        if word not in self.asked:
            most, letters, n = (2 if len(word) > 7 else 1), frozenset(word), len(word)
            self.asked[word] = n > 3 and any(abs(m - n) <= most and len(letters ^ own) <= 2 * most and names.slips(word, k, most) <= most for k, m, own in self.letters)
        return self.asked[word]

    def starts(self, letter: str) -> bool:
        return any(k.startswith(letter) for k in self.held)


class _Classes(dict):
    """Known words by class, made when first asked for."""

    def of(self, key: int, held) -> Known:
        if key not in self:
            self[key] = Known(held)
        return self[key]


_SEGMENTS = re.compile(r"\s+-\s+|_-_|(?<=.)[\[(]|[\])]")


def _without_artist(text: str, named: set[str]) -> str:
    """The segments of a name that don't hold the family name; the whole if it has one segment only."""
    segments = [x for x in _SEGMENTS.split(text) if x.strip(" -_.,")]
    apart = [bool(named & set(words(x.replace("_", " ").replace(".", " ").replace("�", "")))) for x in segments]
    if any(apart) and not all(apart) and any(w.isalpha() and w not in _FORMATS for x, a in zip(segments, apart) if not a for w in words(x)):
        return " ".join(x for x, a in zip(segments, apart) if not a)
    return text


def _without_leading_artist(text: str, artist: Known, named: set[str]) -> str:
    """A name that opens with the artist's words, honorifics and articles among them, from its first other word on."""
    at = 0
    for m in re.finditer(r"[^\W_]+", text):
        here = words(m[0])
        if not here or not (here[0] in names.HONORIFICS or here[0] in named or artist.near(here[0]) or len(here[0]) == 1):
            return text[at:]
        at = m.end()
        if here[0] in named:
            return text[at:]
    return text


def title_of_folder(last: str, year: int, artist: Known, named: set[str]) -> tuple[str, str]:
    """Squashed title and mark of a folder's name once its artist is known."""
    bare = _without_year(last, year)
    bare = re.sub(r"[\[(]\s*(?:flac|mp3|wav|web|vinyl|320|v0|24-96|24-192|16-44|cd)\s*[\])]", " ", bare, flags=re.I)
    bare = re.sub(r"(?:[ ._]|^)(?:WEB|FLAC|MP3|WAV)\s*$", " ", bare)
    bare = _without_leading_artist(_without_artist(bare, named).replace("_", " ").replace(".", " "), artist, named)
    kept, mark = title_parts(bare)
    kept = [w for w in kept if w not in _FORMATS and w not in named and not artist.near(w) and not (len(w) == 1 and artist.starts(w))]
    return "".join(kept), mark


def title_of_release(title: str, artist: Known) -> tuple[str, str, str, str, str, list[str]]:
    """The same of a release, the letters that survive where accented ones are lost, what stays where the last word is cut off, and the words."""
    kept, mark = title_parts(title)
    kept = [w for w in kept if not artist.near(w) and not (len(w) == 1 and artist.starts(w))]
    bare = "".join(c for c in plain_form(title) if c.isascii())
    lost = "".join(w for w in title_parts(bare)[0] if not artist.near(w))
    tokens = re.findall(r"[^\W_]+", fold(title))
    short, short_mark = title_parts(" ".join(tokens[:-1])) if len(tokens) > 2 else ([], mark)
    short = [w for w in short if not artist.near(w)]
    return "".join(kept), mark, lost, "".join(short), short_mark, kept


def _read_series(series: pd.Series) -> pd.DataFrame:
    rows = []
    for p in series:
        last, around, year, number, lost = read_path(p)
        both = words(last.replace("_", " ").replace(".", " ").replace("�", "")) + words(around.replace("�", ""))
        rows.append((last, around, year, number, lost, list(dict.fromkeys(both))))
    return pd.DataFrame(rows, columns=["last", "around", "year", "number", "lost", "every"])


def _read(column: str) -> Column:
    return F.pandas_udf(_read_series, "struct<last:string,around:string,year:int,number:string,lost:boolean,every:array<string>>")(column)


def _lost_series(series: pd.Series) -> pd.Series:
    """Of the words of a spelling that hold accented letters: what is left without these, and the word."""
    out = []
    for spelling in series:
        found = []
        for raw in re.findall(r"[^\W_]+", spelling):
            left, whole = "".join(c for c in raw if c.isascii()).lower(), words(raw)
            if len(left) > 2 and whole and left != whole[0]:
                found.append((left, whole[0]))
        out.append(found)
    return pd.Series(out, dtype=object)


def artist_classes(spellings: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """spelling -> class, and the words of each class with the number of classes that hold the word."""
    linked = cut_lineage(names.link_spellings(spellings, known))
    of = linked.select("class", F.explode(F.split("key", " ")).alias("word")).distinct()
    held = of.groupBy("word").agg(F.countDistinct("class").alias("classes"))
    return linked, cut_lineage(of.join(held, "word"))


def release_nodes(releases: DataFrame, linked: DataFrame, class_words: DataFrame, restored: DataFrame) -> DataFrame:
    """release_id, class, title, mark, lost, year, number, tracks, duration of every release and artist class."""
    kind = "struct<artists:array<struct<name:string,credited_as:string>>,tracks:array<struct<duration_ms:bigint>>>"
    p = F.from_json("payload", kind)
    flat = releases.withColumn("p", p).select(
        F.col("id").alias("release_id"), "title", "track_count", "source_release_id",
        F.substring(F.coalesce("original_released_on", "released_on"), 1, 4).try_cast("int").alias("first_year"),
        F.substring("released_on", 1, 4).try_cast("int").alias("year"),
        F.when(F.size("p.tracks") > 0, F.aggregate("p.tracks", F.lit(0).cast("bigint"), lambda s, t: s + t["duration_ms"])).alias("duration"),
        F.array_distinct(F.array_compact(F.concat(
            F.array("primary_artist"), F.coalesce(F.flatten(F.transform("p.artists", lambda a: F.array(a["name"], a["credited_as"]))), F.array())))).alias("artists"),
    )
    per = flat.where("title is not null").withColumn("spelling", F.explode("artists")).join(linked.select("spelling", "class"), "spelling")
    per = per.drop("spelling", "artists").distinct()
    whole = class_words.groupBy("class").agg(F.array_sort(F.collect_set("word")).alias("class_words"))
    mended = restored.where("kind = 'release'").select(F.col("id").alias("release_id"), F.col("restored").alias("title_restored"))
    per = per.join(mended, "release_id", "left").join(whole, "class")

    classes = _Classes()

    @F.pandas_udf("struct<title:string,mark:string,lost:string,short:string,short_mark:string,title_words:array<string>>")
    def read(title: pd.Series, key: pd.Series, of: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([title_of_release(t, classes.of(k, w)) for t, k, w in zip(title, key, of)], columns=["title", "mark", "lost", "short", "short_mark", "title_words"])

    read_ = spread(per, "release_id").withColumn("r", read(F.coalesce("title_restored", "title"), "class", "class_words"))
    return read_.select("release_id", "class", "r.title", "r.mark", "r.lost", "r.short", "r.short_mark", "r.title_words", "year", "first_year", "track_count", "duration", "source_release_id")


def _telling() -> Column:
    return (F.col("classes") <= TELLING) & ~F.col("word").isin(sorted(names.HONORIFICS)) & (F.length("word") > 1)


def title_keys(releases: DataFrame) -> DataFrame:
    """class, rare: the two rarest words of each title, in order."""
    split = releases.select("class", "mark", "title", F.explode("title_words").alias("title_word")).distinct()
    counts = split.groupBy("title_word").agg(F.count("*").alias("n"))
    rare = split.join(counts, "title_word").groupBy("class", "mark", "title").agg(F.slice(F.array_sort(F.collect_set(F.struct("n", "title_word"))), 1, 2).alias("rare"))
    return rare.select("class", F.array_sort("rare.title_word").alias("rare")).distinct()


def class_keys(linked: DataFrame, class_words: DataFrame, rare: DataFrame) -> DataFrame:
    """class, key, exactly, nearly: what a folder must hold to be asked for a class, and how well that names it (1, 0, -1), word for word or with slips."""
    of = linked.select("class", "key").distinct().select("class", "key", F.explode(F.split("key", " ")).alias("word"))
    held = of.join(class_words.withColumn("telling", _telling()), ["class", "word"]).groupBy("class", "key").agg(F.array_sort(F.collect_set(F.struct("classes", "word", "telling"))).alias("w"))
    strong = lambda x: x["telling"] & ((F.length(x["word"]) >= LONG) | (F.size("w") == 1))

    def key(name: Column, exactly: Column, nearly: int) -> Column:
        return F.struct(name.alias("key"), exactly.alias("exactly"), F.lit(nearly).alias("nearly"))

    first, others = F.get("w", F.lit(0))["word"], F.slice("w", F.lit(2), F.size("w"))
    alone = F.transform(F.filter("w", lambda x: x["telling"]), lambda x: F.struct(x["word"].alias("key"), F.when(strong(x), 1).otherwise(-1).alias("exactly"), F.when(strong(x), 0).otherwise(-1).alias("nearly")))
    pairs = F.transform(others, lambda y: key(F.array_join(F.array_sort(F.array(first, y["word"])), " "), F.lit(1), 0))
    initials = F.flatten(F.transform(F.filter("w", lambda x: F.length(x["word"]) > 3), lambda x: F.transform(
        F.filter("w", lambda y: y["word"] != x["word"]), lambda y: key(F.concat_ws(" ", F.substring(y["word"], 1, 1), x["word"]), F.lit(0), 0))))
    named = held.select("class", F.inline(F.concat(alone, pairs, initials)))
    common = class_words.where(~_telling() & (F.length("word") > 2) & ~F.col("word").isin(sorted(names.HONORIFICS))).select("class", "word")
    beside = common.join(rare, "class").select("class", F.array_join(F.concat(F.array("word"), "rare"), "~").alias("key"), F.lit(-1).alias("exactly"), F.lit(-1).alias("nearly"))
    return named.unionByName(beside).groupBy("class", F.xxhash64("key").alias("key")).agg(F.max("exactly").alias("exactly"), F.max("nearly").alias("nearly"))


def words_met(read: DataFrame, linked: DataFrame, class_words: DataFrame, rare: DataFrame) -> DataFrame:
    """token, word, is_artist, is_title, telling: words of folders beside the words of artists and titles that they are, or are a slip from if they are none themselves."""
    lost = linked.select(F.inline(F.pandas_udf(_lost_series, "array<struct<form:string,word:string>>")("spelling")))
    artist = class_words.groupBy("word").agg(F.max(_telling()).alias("telling")).select(F.col("word").alias("form"), "word", F.lit(True).alias("is_artist"), F.lit(False).alias("is_title"), "telling")
    damaged = lost.distinct().join(artist.select("word", "is_artist", "is_title", "telling"), "word").select("form", "word", "is_artist", "is_title", "telling")
    title = rare.select(F.explode("rare").alias("form")).distinct().select("form", F.col("form").alias("word"), F.lit(False).alias("is_artist"), F.lit(True).alias("is_title"), F.lit(False).alias("telling"))
    flags = [F.max(c).alias(c) for c in ("is_artist", "is_title", "telling")]
    forms = cut_lineage(artist.unionByName(damaged).unionByName(title).groupBy("form", "word").agg(*flags))
    tokens = read.select(F.explode("every").alias("word")).distinct()
    near = names.near_words(tokens, forms.select(F.col("form").alias("word")).distinct()).withColumnsRenamed({"word_a": "token", "word_b": "form"})
    own = forms.groupBy(F.col("form").alias("token")).agg(F.max("is_artist").alias("own_artist"), F.max("is_title").alias("own_title"))
    met = near.join(forms, "form").join(own, "token", "left")
    as_is, slip = F.col("token") == F.col("form"), F.length("token") > LONG
    kind = lambda c: F.col(f"is_{c}") & (as_is | slip & ~F.coalesce(f"own_{c}", F.lit(False)))
    met = met.select("token", "word", kind("artist").alias("is_artist"), kind("title").alias("is_title"), "telling").where("is_artist or is_title")
    return met.groupBy("token", "word").agg(*flags)


def folder_keys(read: DataFrame, met: DataFrame) -> DataFrame:
    """album_unit_id, key, exact, tokens: the keys that the words of a folder make."""
    held = read.select("album_unit_id", F.explode("every").alias("token")).join(met, "token").groupBy("album_unit_id").agg(
        F.collect_set(F.when(F.col("is_artist"), F.struct("word", "token", "telling"))).alias("artists"), F.collect_set(F.when(F.col("is_title"), F.struct("word", "token"))).alias("titles")
    )
    held = held.join(read.select("album_unit_id", F.filter("every", lambda x: F.length(x) == 1).alias("initials")), "album_unit_id")
    same = lambda x: x["word"] == x["token"]

    def made(words: Column, exact: Column, tokens: Column) -> Column:
        return F.struct(words.alias("key"), exact.alias("exact"), tokens.alias("tokens"))

    alone = F.transform("artists", lambda x: made(x["word"], same(x), F.array(x["token"])))
    pairs = F.flatten(F.transform("artists", lambda x: F.transform(
        F.filter("artists", lambda y: (y["word"] > x["word"]) & (y["token"] != x["token"])), lambda y: made(F.concat_ws(" ", x["word"], y["word"]), same(x) & same(y), F.array(x["token"], y["token"])))))
    initials = F.flatten(F.transform("artists", lambda x: F.transform("initials", lambda i: made(F.concat_ws(" ", i, x["word"]), same(x), F.array(x["token"])))))
    two = F.array_distinct(F.flatten(F.transform("titles", lambda t: F.transform(F.filter("titles", lambda u: u["word"] >= t["word"]), lambda u: F.array_distinct(F.array(t["word"], u["word"]))))))
    beside = F.flatten(F.transform(F.filter("artists", lambda x: ~x["telling"]), lambda x: F.transform(
        "two", lambda t: made(F.concat_ws("~", x["word"], F.array_join(t, "~")), F.lit(True), F.array(x["token"])))))
    keys = held.withColumn("two", two).select("album_unit_id", F.inline(F.concat(alone, pairs, initials, beside)))
    return keys.select("album_unit_id", F.xxhash64("key").alias("key"), "exact", "tokens")


def folder_nodes(units: DataFrame, linked: DataFrame, class_words: DataFrame, restored: DataFrame, releases: DataFrame) -> DataFrame:
    """album_unit_id, class, title, mark, lost, year, number, tracks, duration of every folder and class it may name.

    named_exactly: 1, 0 where a slip or initials lie between, -1 where only a common word of the artist is named.
    """
    base = units.select(F.col("id").alias("album_unit_id"), "folder_path", "track_count", F.col("total_duration_ms").alias("duration")).where("folder_path is not null")
    mended = restored.where("kind = 'folder'").select(F.col("id").alias("album_unit_id"), "restored")
    paths = base.join(mended, "album_unit_id", "left").withColumn("path", F.coalesce("restored", "folder_path"))
    read = cut_lineage(spread(paths, "album_unit_id").select("album_unit_id", "track_count", "duration", _read("path").alias("r")).select("album_unit_id", "track_count", "duration", "r.*"))
    rare = cut_lineage(title_keys(releases))
    # Cut in parts: adaptive execution writes out the whole plan anew with every stage that ends, which the driver holds.
    met = cut_lineage(words_met(read, linked, class_words, rare))
    offered = cut_lineage(class_keys(linked, class_words, rare))
    asked = folder_keys(read, met).join(offered, "key")
    level = F.when(F.col("exact"), F.col("exactly")).otherwise(F.col("nearly"))
    per = cut_lineage(asked.groupBy("album_unit_id", "class").agg(F.max(level).alias("named_exactly"), F.array_distinct(F.flatten(F.collect_set("tokens"))).alias("tokens_named")))
    whole = class_words.groupBy("class").agg(F.array_sort(F.collect_set("word")).alias("class_words"))
    per = per.join(read.drop("every"), "album_unit_id").join(whole, "class")

    classes = _Classes()

    @F.pandas_udf("struct<title:string,mark:string>")
    def title(last: pd.Series, year: pd.Series, key: pd.Series, of: pd.Series, named: pd.Series) -> pd.DataFrame:
        rows = zip(last, year, key, of, named)
        return pd.DataFrame([title_of_folder(x.replace("�", ""), y, classes.of(k, w), set(n)) for x, y, k, w, n in rows], columns=["title", "mark"])

    out = spread(per, "album_unit_id").withColumn("f", title("last", "year", "class", "class_words", "tokens_named"))
    return out.select("album_unit_id", "class", "f.title", "f.mark", F.col("lost").alias("letters_lost"), "year", "number", "track_count", "duration", "named_exactly")


def _with_cuts(titles: DataFrame, title: str) -> DataFrame:
    return titles.where(F.length(title) > 4).select("*", F.explode(names.cut_column(title)).alias("cut"))


def albums(releases: DataFrame) -> DataFrame:
    """class, r_mark, r_title, album, r_known: release titles with the title of the album they mean.

    A title that only one artist has, a slip from another one of theirs, is
    taken for a slip of it: of one that several artists have, else of the commoner.
    """
    known = releases.groupBy(F.col("title").alias("r_title")).agg((F.countDistinct("class") > 1).alias("r_known"))
    titles = releases.groupBy("class", F.col("mark").alias("r_mark"), F.col("title").alias("r_title")).agg(F.countDistinct("release_id").alias("n"))
    titles = cut_lineage(titles.join(known, "r_title"))
    cuts = _with_cuts(titles, "r_title").withColumn("rank", F.struct("r_known", "n", F.col("r_title").alias("t")))
    other = cuts.select("class", "r_mark", "cut", F.col("rank").alias("rank_b"))
    near = cuts.where("not r_known").join(other, ["class", "r_mark", "cut"]).where(F.col("rank_b") > F.col("rank"))
    near = near.where(F.levenshtein("r_title", "rank_b.t") <= F.when(F.least(F.length("r_title"), F.length("rank_b.t")) > 7, 2).otherwise(1))
    up = cut_lineage(near.groupBy("class", "r_mark", "r_title").agg(F.max("rank_b")["t"].alias("up")))
    further = up.select("class", "r_mark", F.col("r_title").alias("up"), F.col("up").alias("top"))
    mapped = titles.join(up, ["class", "r_mark", "r_title"], "left").join(further, ["class", "r_mark", "up"], "left")
    return mapped.select("class", "r_mark", "r_title", F.coalesce("top", "up", "r_title").alias("album"), "r_known")


def candidates(folders: DataFrame, releases: DataFrame, of_albums: DataFrame) -> DataFrame:
    """Pairs of a folder title and an album of one class: equal titles, titles a slip apart where none is equal, and titles cut short by a word."""
    f = cut_lineage(folders.select("class", "title", "mark", "letters_lost").distinct())
    r = releases.select("class", F.col("title").alias("r_title"), F.col("mark").alias("r_mark"), "lost", "short", "short_mark").distinct()
    equal, lost, short = (r.select("class", "r_title", "r_mark", F.col(m).alias("mark"), F.col(t).alias("title"), F.lit(k).alias("kind")) for m, t, k in (("r_mark", "r_title", 3), ("r_mark", "lost", 2), ("short_mark", "short", 1)))
    forms = equal.unionByName(lost.where("title <> '' and title <> r_title")).unionByName(short.where("length(title) > 4 and (title <> r_title or mark <> r_mark)"))
    # Volume and live stay telling where a title is cut off; a number it closed with may be gone.
    same_kind = F.substring_index("mark", "|", -2) == F.substring_index("r_mark", "|", -2)
    at_once = cut_lineage(f.join(forms.distinct(), ["class", "mark", "title"]).where((F.col("kind") == 3) | (F.col("kind") == 2) & F.col("letters_lost") | (F.col("kind") == 1) & same_kind))
    open_ = f.join(at_once.where("kind > 1").select("class", "mark", "title"), ["class", "mark", "title"], "left_anti").select("class", "mark", "title").distinct()
    whole = r.select("class", "r_title", F.col("r_mark").alias("mark"), "lost").distinct()
    right = _with_cuts(whole, "r_title").unionByName(whole.where("length(lost) > 4").withColumn("cut", F.col("lost"))).drop("lost")
    slips = _with_cuts(open_, "title").join(right, ["class", "mark", "cut"]).where(F.levenshtein("title", "r_title") <= 2)
    slips = slips.select("class", "mark", "title", F.col("mark").alias("r_mark"), "r_title", F.lit(0).alias("kind")).distinct()
    pairs = at_once.select("class", "mark", "title", "r_mark", "r_title", "kind").unionByName(slips).join(of_albums, ["class", "r_mark", "r_title"])
    # Titles that several artists use are titles of their own; two of them aren't slips of each other.
    known = releases.groupBy("title").agg((F.countDistinct("class") > 1).alias("is_known"))
    pairs = pairs.join(known, "title", "left").withColumn("is_known", F.coalesce("is_known", F.lit(False)))
    kind = F.col("kind")
    return pairs.groupBy("class", "mark", "title", "r_mark", "album").agg(
        F.max(kind == 3).alias("same"), F.max((kind == 2).cast("int")).alias("lost_alike"), F.min((kind == 1).cast("int")).alias("is_short"),
        F.min(F.col("is_known") & F.col("r_known")).alias("both_known"), F.max("is_known").alias("is_known"),
    )


def _prior() -> Column:
    """Log-odds of a pair of rows before exclusion."""
    same = F.col("same")
    title = F.when(F.col("is_short") == 1, -0.4).when(same & (F.col("title") != ""), 4.0).when(same, 2.5).when(F.col("lost_alike") == 1, 3.0).when(F.col("both_known"), -3.0).otherwise(2.0)
    # A word that many artists bear is no evidence by itself: title and it need year, counts or number beside them.
    artist = F.when(F.col("named_exactly") == 1, 0.5).when(F.col("named_exactly") == 0, -0.5).otherwise(-4.6)
    def agree(left: str, right: str, alike, yes: float, no: float) -> Column:
        """Evidence of two sets of values: for the pair if any two are alike, none if a set is empty."""
        met = F.exists(left, lambda x: F.exists(right, lambda y: alike(x, y)))
        return F.when((F.size(left) == 0) | (F.size(right) == 0), 0.0).when(met, yes).otherwise(no)

    year = agree("f_years", "r_years", lambda x, y: F.abs(x - y) <= 1, 0.7, -0.5)
    duration = agree("f_durations", "r_durations", lambda x, y: F.abs(x - y) <= 0.05 * F.greatest(x, y), 0.5, -0.3)
    count = F.when(F.col("f_tracks").isNull() | F.col("r_tracks").isNull(), 0.0).when(F.abs(F.col("f_tracks") - F.col("r_tracks")) <= 2, 0.5).otherwise(-0.3)
    number = agree("f_numbers", "r_ids", lambda x, y: x == y, 2.0, 0.0)
    return title + artist + year + count + duration + number


def propagate(edges: DataFrame) -> DataFrame:
    """Marginals of `edges` (left, right, left_sure, prior) under one-to-one factors.

    Left: at most one right. Right: at most one among the lefts that are surely
    titles of their own. Messages are log-odds; each round is two aggregations
    and two joins over the edges, cut off from their lineage. Edges without a
    rival on either side receive no message and keep their prior.
    """
    rivals = edges.groupBy("left").agg(F.count("*").alias("n_left"))
    sures = edges.groupBy("right").agg(F.count_if("left_sure").alias("n_right"))
    counted = edges.join(rivals, "left").join(sures, "right")
    alone = (F.col("n_left") == 1) & ((F.col("n_right") <= 1) | ~F.col("left_sure"))
    # An edge takes part if it or any rival of it has a rival: the two sides of every factor stay whole.
    contested = counted.where(~alone).select("left", "right")
    shared_left, shared_right = contested.select("left").distinct(), contested.select("right").distinct()
    touched = counted.join(shared_left.withColumn("l", F.lit(True)), "left", "left").join(shared_right.withColumn("r", F.lit(True)), "right", "left")
    touched = cut_lineage(touched.withColumn("in_play", F.coalesce("l", F.lit(False)) | F.coalesce("r", F.lit(False))).drop("l", "r", "n_left", "n_right"))
    now = touched.where("in_play").drop("in_play").withColumn("from_left", F.lit(0.0)).withColumn("from_right", F.lit(0.0))
    for step in range(ROUNDS):
        up = now.withColumn("to_left", F.exp(F.least(F.col("prior") + F.col("from_right"), F.lit(30.0)))).withColumn(
            "to_right", F.when(F.col("left_sure"), F.exp(F.least(F.col("prior") + F.col("from_left"), F.lit(30.0)))).otherwise(0.0)
        )
        lefts, rights = up.groupBy("left").agg(F.sum("to_left").alias("left_sum")), up.groupBy("right").agg(F.sum("to_right").alias("right_sum"))
        new = up.join(lefts, "left").join(rights, "right")
        left_message = -F.log1p(F.greatest(F.col("left_sum") - F.col("to_left"), F.lit(0.0)))
        right_message = F.when(F.col("left_sure"), -F.log1p(F.greatest(F.col("right_sum") - F.col("to_right"), F.lit(0.0)))).otherwise(0.0)
        new = new.withColumn("new_left", DAMPING * F.col("from_left") + (1 - DAMPING) * left_message)
        new = new.withColumn("new_right", DAMPING * F.col("from_right") + (1 - DAMPING) * right_message)
        moved = F.greatest(F.abs(F.col("new_left") - F.col("from_left")), F.abs(F.col("new_right") - F.col("from_right")))
        new = new.select("left", "right", "left_sure", "prior", F.col("new_left").alias("from_left"), F.col("new_right").alias("from_right"), moved.alias("moved"))
        new = cut_lineage(new)
        now = new.drop("moved")
        # Asked every third round: each question is a job.
        if step % 3 == 2:
            last = new.agg(F.max("moved")).first()[0] or 0.0
            if last < STILL:
                break
    else:
        warnings.warn(f"belief propagation moved by {last} after {ROUNDS} rounds", RuntimeWarning, stacklevel=2)
    free = touched.where("not in_play").select("left", "right", F.col("prior").alias("odds"))
    settled = now.select("left", "right", (F.col("prior") + F.col("from_left") + F.col("from_right")).alias("odds")).unionByName(free)
    return settled.select("left", "right", (1 / (1 + F.exp(-F.col("odds")))).alias("confidence"))


def match(units: DataFrame, releases: DataFrame, spellings: DataFrame, known: DataFrame) -> DataFrame:
    """album_unit_id, release_id, confidence of all pairs that are the same album with a confidence of at least CONFIDENCE."""
    linked, class_words = artist_classes(spellings, known)
    texts = units.select(F.lit("folder").alias("kind"), "id", F.col("folder_path").alias("text")).unionByName(
        releases.select(F.lit("release").alias("kind"), "id", F.col("title").alias("text"))
    )
    restored = cut_lineage(mojibake.restore(texts, "text", ["kind", "id"]).select("kind", "id", "restored"))
    rs = cut_lineage(release_nodes(releases, linked, class_words, restored))
    fs = cut_lineage(folder_nodes(units, linked, class_words, restored, rs))
    of_albums = cut_lineage(albums(rs))
    titles = cut_lineage(candidates(fs, rs, of_albums))
    # A folder that names an artist with a title of theirs isn't asked for others by common words; one that doesn't is a node by itself.
    settled = fs.where("named_exactly >= 0").join(titles.select("class", "mark", "title").distinct(), ["class", "mark", "title"]).select("album_unit_id").distinct()
    partly = fs.where("named_exactly < 0").join(settled, "album_unit_id", "left_anti")
    fs = fs.where("named_exactly >= 0").unionByName(partly).withColumn("alone", F.when(F.col("named_exactly") < 0, F.col("album_unit_id")))
    # Nodes: a folder reading and an album, with their best evidence; exclusion is between titles of one class.
    fs = cut_lineage(fs.withColumn("left", F.when(F.col("alone").isNull(), F.xxhash64("class", "mark", "title")).otherwise(F.xxhash64(F.lit("alone"), "alone"))))
    f = fs.select("class", "mark", "title", "left", "alone", "year", "duration", F.col("track_count").alias("f_tracks"), "number", "named_exactly")
    f = cut_lineage(f.groupBy("class", "mark", "title", "left").agg(
        F.max("named_exactly").alias("named_exactly"), F.collect_set(F.when(F.col("year") > 0, F.col("year"))).alias("f_years"), F.max("alone").alias("alone"),
        F.collect_set(F.when(F.col("number") != "", F.col("number"))).alias("f_numbers"), F.collect_set("duration").alias("f_durations"), F.expr("percentile(f_tracks, 0.5)").alias("f_tracks")
    ))
    named = rs.withColumnsRenamed({"mark": "r_mark", "title": "r_title"}).join(of_albums, ["class", "r_mark", "r_title"])
    named = cut_lineage(named.withColumn("right", F.xxhash64("class", "r_mark", "album")))
    r = cut_lineage(named.groupBy("right").agg(
        F.array_union(F.collect_set("year"), F.collect_set("first_year")).alias("r_years"), F.expr("percentile(track_count, 0.5)").alias("r_tracks"),
        F.collect_set("source_release_id").alias("r_ids"), F.collect_set("duration").alias("r_durations"),
    ))
    sure = (F.col("is_known") | F.col("same")) & (F.col("is_short") == 0) & F.col("alone").isNull()
    edges = titles.withColumn("right", F.xxhash64("class", "r_mark", "album")).join(f, ["class", "mark", "title"]).join(r, "right")
    edges = edges.select("left", "right", sure.alias("left_sure"), _prior().alias("prior")).groupBy("left", "right").agg(F.max("left_sure").alias("left_sure"), F.max("prior").alias("prior"))
    held = propagate(cut_lineage(edges)).where(F.col("confidence") >= CONFIDENCE)
    found = held.join(fs.select("album_unit_id", "left").distinct(), "left").join(named.select("release_id", "right").distinct(), "right")
    return found.groupBy("album_unit_id", "release_id").agg(F.max("confidence").alias("confidence"))
