"""Names of folders, files, credits and genres: read, cleaned, written. Built-in expressions but where noted."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of editions, kinds of release, years that can be meant.
EDITIONS = "remaster|remasteriz|deluxe|expanded|anniversar|aniversár|edition|edição|versão|bonus|bônus|ao vivo|live|mono|stereo|reissue"
KINDS = ("EP", "Single", "Maxi-Single", "Remix", "Remixes", "Compilation", "Live", "Mixtape")
YEARS = (1900, 2099)
#: Passes of the cleaning of a title: decorations that may stand behind each other.
PASSES = 4

_SPACES = r"[ \t\n\r\f]+"
_BRACKET = r"\s*\[[^\]]*\]\s*$"
_YEAR_END = rf"(?i)\s*[（(]\s*(?:(?:{'|'.join(KINDS)})\s*[-–—]\s*)?(\d{{4}})\s*[)）]\s*$"
_EDITION_END = rf"(?i)\([^()]*(?:{EDITIONS})[^()]*\)\s*$"
_YEAR_START = r"^\s*[（(]\s*(19\d\d|20\d\d)\s*[)）]\s*(\S.*)$"
_INDEX = r"^\s*(\d{1,4})\s*[-–—]\s*(\S.* [-–—] .*)$"


def tidy(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _SPACES, " "))


def clean_title(text: Column) -> Column:
    """A title without brackets, years and edition wording behind it, as often as they stand there, unless nothing else is left."""
    out = tidy(text)
    for _ in range(PASSES):
        bare = tidy(F.regexp_replace(F.regexp_replace(F.regexp_replace(out, _BRACKET, ""), _YEAR_END, ""), _EDITION_END, ""))
        out = F.when(bare != "", bare).otherwise(out)
    return out


def year_behind(text: Column) -> Column:
    """The year in parentheses at the end, brackets and editions aside."""
    bare = F.regexp_replace(F.regexp_replace(tidy(text), _BRACKET, ""), _EDITION_END, "")
    return F.nullif(F.regexp_extract(bare, _YEAR_END, 1), F.lit("")).try_cast("int")


def folder_hints(name: Column) -> Column:
    """struct(artist, album, year, text) of `Artist - Album (Year) [FORMAT]` and the looser forms around it."""
    cleaned = clean_title(name)
    opening = F.nullif(F.regexp_extract(cleaned, _YEAR_START, 1), F.lit("")).try_cast("int")
    rest = F.when(opening.isNotNull(), F.regexp_extract(cleaned, _YEAR_START, 2)).otherwise(cleaned)
    number = F.nullif(F.regexp_extract(rest, _INDEX, 1), F.lit(""))
    numbered_year = F.when((F.length(number) == 4) & number.try_cast("int").between(*YEARS), number.try_cast("int"))
    text = F.when(number.isNotNull(), F.regexp_extract(rest, _INDEX, 2)).otherwise(rest)
    parted = text.rlike(r" [-–—] ")
    artist = F.when(parted, F.trim(F.regexp_extract(text, r"^(.*?) [-–—] ", 1)))
    album = F.when(parted, F.trim(F.regexp_extract(text, r"^.*? [-–—] (.*)$", 1)))
    return F.struct(artist.alias("artist"), album.alias("album"), F.coalesce(year_behind(name), opening, numbered_year).alias("year"), text.alias("text"))


def query_ladder(artist: Column, album: Column, folded_artist: Column, folded_album: Column, most: int = 12) -> Column:
    """Ever looser queries, the most specific first: array of struct(artist, album, text), without repeats. The bound is a budget of requests."""
    none = F.lit(None).cast("string")

    def q(a: Column, b: Column, t: Column = none) -> Column:
        return F.struct(a.cast("string").alias("artist"), b.cast("string").alias("album"), t.cast("string").alias("text"))

    plain = F.nullif(tidy(F.regexp_replace(album, r"\s*\([^)]*\)\s*$", "")), F.lit(""))
    kind = tidy(F.regexp_replace(F.coalesce(plain, album), rf"(?i)\s+(?:{'|'.join(KINDS)})$", ""))
    base = F.coalesce(plain, album)
    left, right = (F.nullif(F.trim(F.regexp_extract(base, r"^(.*?)(?: [-–—] |: )(.+)$", i)), F.lit("")) for i in (1, 2))
    both = left.isNotNull() & right.isNotNull()
    joined = base.rlike(r"(?i)\s(?:&|\+|and|e|y)\s")
    variants = [F.when(joined, F.regexp_replace(base, r"(?i)\s+(?:&|\+|and|e|y)\s+", f" {form} ")) for form in ("&", "and", "e")]
    text = F.concat_ws(" ", artist, album)
    rungs = [
        (F.lit(True), q(artist, album)), (album.isNotNull() & artist.isNotNull(), q(none, album)), (plain.isNotNull() & (plain != album), q(artist, plain)),
        ((kind != "") & (kind != album) & ~kind.eqNullSafe(plain), q(artist, kind)), (both, q(artist, left)), (both, q(artist, right)), (both, q(left, right)),
        *[rung for v in variants for rung in ((v.isNotNull() & (v != base), q(artist, v)), (v.isNotNull() & (v != base) & artist.isNotNull(), q(none, v)))],
        (album.isNotNull() & (~folded_artist.eqNullSafe(artist) | ~folded_album.eqNullSafe(album)), q(folded_artist, folded_album)), (text != "", q(none, none, text)),
        (text != F.concat_ws(" ", folded_artist, folded_album), q(none, none, F.concat_ws(" ", folded_artist, folded_album))),
    ]
    return F.slice(F.array_distinct(F.array_compact(F.array(*[F.when(c, x) for c, x in rungs]))), 1, most)


def track_hint(name: Column, numbered: Column) -> Column:
    """A track's title as its file name says it: extension and number aside, a bare number only where the folder is numbered."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    bare = F.regexp_replace(stem, r"^\s*(?:\d{1,2}\s*-\s*)?\d{1,3}\s*[.\-–]\s*", "")
    bare = F.when(numbered, F.regexp_replace(bare, r"^\s*\d{1,3}\s+(\S)", "$1")).otherwise(bare)
    return F.coalesce(F.nullif(tidy(bare), F.lit("")), stem)


def carries_an_index(numbers: Column) -> Column:
    """Aggregate: whether at least 3 names, four fifths of them opening with a number, and no number twice."""
    return (F.count("*") >= 3) & (F.count(numbers) >= 0.8 * F.count("*")) & (F.count_distinct(numbers) == F.count(numbers))


def distinguish(titles: Column) -> Column:
    """Aggregate: whether titles tell members apart; true where any is missing or fewer than two stand there."""
    present = F.nullif(F.trim(titles), F.lit(""))
    return (F.count(present) < 2) | (F.count(present) != F.count("*")) | (F.count_distinct(F.lower(present)) > 1)


def kind_of(name: Column) -> Column:
    """The kind of release a name closes with, in or out of parentheses, written one way."""
    found = F.regexp_extract(name, rf"(?i)(?:^|[\s(\[{{])({'|'.join(KINDS)})[)\]}}]?\s*$", 1)
    out = F.lit(None).cast("string")
    for kind in KINDS:
        out = F.when(F.lower(found) == kind.lower(), kind).otherwise(out)
    return out


def written_credit(artists: Column) -> Column:
    """Artists (array of struct<name, joined_by>) joined as their source joins them; a comma stands tight, & is the fallback."""
    named = F.filter(artists, lambda a: F.trim(a["name"]) != "")
    sep = lambda a: F.coalesce(F.nullif(F.trim(a["joined_by"]), F.lit("")), F.lit("&"))
    start = F.struct(F.lit("").alias("text"), F.lit("").alias("sep"))
    step = lambda s, a: F.struct(
        F.when(s["text"] == "", F.trim(a["name"])).otherwise(F.concat(s["text"], F.when(F.startswith(s["sep"], F.lit(",")), s["sep"]).otherwise(F.concat(F.lit(" "), s["sep"])), F.lit(" "), F.trim(a["name"]))).alias("text"),
        sep(a).alias("sep"))
    return F.aggregate(named, start, step)["text"]


def split_credit(credit: Column) -> Column:
    """The names a credit holds, parted at commas and ampersands."""
    return F.filter(F.split(credit, r"\s*[,&]\s*"), lambda x: x != "")


def spell_genres(values: Column, spellings: dict[str, str]) -> Column:
    """One spelling for each genre, in order and without repeats: that of the list, else each word with a capital."""
    key = lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}]", "")
    known = F.create_map(*[F.lit(v) for k, s in spellings.items() for v in (k, s)]) if spellings else F.create_map().cast("map<string,string>")
    keyed = F.filter(F.transform(values, lambda x: F.struct(key(x).alias("k"), F.trim(x).alias("v"))), lambda x: x["k"] != "")
    first = F.filter(keyed, lambda x, i: F.array_position(F.transform(keyed, lambda y: y["k"]), x["k"]) == i + 1)
    return F.transform(first, lambda x: F.coalesce(F.try_element_at(known, x["k"]), F.initcap(x["v"])))


def folder_of_share(path: Column) -> Column:
    """A remote path without the share it begins with."""
    return F.array_join(F.filter(F.split(path, r"\\"), lambda p: (p != "") & ~F.startswith(p, F.lit("@@"))), "/")


def khz(rate: Column) -> Column:
    """A sample rate as it is shown: 44.1, 48, 96."""
    return F.regexp_replace(F.format_string("%.1f", rate / 1000), r"\.0$", "")


def length_of(ms: Column) -> Column:
    """Milliseconds as m:ss."""
    seconds = F.floor(ms / 1000)
    return F.format_string("%d:%02d", F.floor(seconds / 60), seconds % 60)


def year_in(text: Column) -> Column:
    """The first year that can be meant."""
    return F.nullif(F.regexp_extract(text, r"(?:^|\D)((?:19|20)\d\d)(?:\D|$)", 1), F.lit("")).try_cast("int")


def _plain(text: str | None) -> str:
    bare = unicodedata.normalize("NFKD", (text or "").replace("º", "").replace("°", ""))
    return " ".join("".join(c for c in bare if not unicodedata.combining(c)).casefold().split())


def plain(text: Column | str) -> Column:
    """For comparison with what people type: compatibility forms, case, accents and degree signs aside. Arrow batches."""
    return F.pandas_udf(lambda s: s.map(lambda t: None if t is None else _plain(t)), "string")(text)


def _slip(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def words_apart(a: str | None, b: str | None) -> str:
    """`slip` where two titles differ in one word by a letter or an exchange, `word` where in one whole word, else empty."""
    mine, theirs = ([_plain(w) for w in re.findall(r"[^\W\d_]+", t or "")] for t in (a, b))
    if not a or len(mine) != len(theirs):
        return ""
    apart = [(x, y) for x, y in zip(mine, theirs) if x != y]
    if len(apart) != 1:
        return ""
    x, y = apart[0]
    if min(len(x), len(y)) >= 4 and abs(len(x) - len(y)) <= 2:
        d = _slip(x, y)
        if d == 1 or d == 2 and sorted(x) == sorted(y):
            return "slip"
    return "word" if len(mine) > 1 else ""


def apart(a: Column | str, b: Column | str) -> Column:
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([words_apart(p, q) if q is not None else "" for p, q in zip(x, y)])

    return F.pandas_udf(run, "string")(a, b)


def spelling(local: str | None, catalogue: str | None) -> str | None:
    """Of two spellings that differ in case and accents only the one with more accents, in the catalogue's case; else the catalogue's."""
    if local is None or catalogue is None or _plain(local) != _plain(catalogue):
        return catalogue
    marks = lambda t: sum(unicodedata.combining(c) > 0 for c in unicodedata.normalize("NFD", t))
    if marks(local) <= marks(catalogue):
        return catalogue
    if catalogue.isupper() or len(local) != len(catalogue):
        return local
    return "".join(c.upper() if of.isupper() else c.lower() for c, of in zip(local, catalogue))


def resolved(local: Column | str, catalogue: Column | str) -> Column:
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([spelling(p, q) for p, q in zip(x, y)], dtype=object)

    return F.pandas_udf(run, "string")(local, catalogue)
