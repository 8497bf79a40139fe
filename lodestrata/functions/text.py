"""Text and value functions: built-in expressions where Spark has them, Arrow batches where it hasn't."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(text: Column) -> Column:
    """Runs of white space as one space, trimmed; empty text as null."""
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def _folded(series: pd.Series) -> pd.Series:
    def one(t):
        if t is None or t.isascii():
            return t
        return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn"))

    return series.map(one, na_action="ignore")


def fold_accents(text: Column | str) -> Column:
    """Letters without their marks; null stays null."""
    return F.pandas_udf(_folded, "string")(text)


def nfc(text: Column | str) -> Column:
    """The composed Unicode form; null stays null."""

    def run(series: pd.Series) -> pd.Series:
        return series.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")

    return F.pandas_udf(run, "string")(text)


def partial_date(text: Column) -> Column:
    """year[-month[-day]] as a date; absent or zero parts are 1, anything else is null."""
    def part(i: int) -> Column:
        return F.greatest(F.coalesce(F.regexp_extract(text, r"^(\d{4})(?:-(\d{1,2}))?(?:-(\d{1,2}))?$", i).try_cast("int"), F.lit(1)), F.lit(1))

    year = F.regexp_extract(text, r"^(\d{4})(?:-(\d{1,2}))?(?:-(\d{1,2}))?$", 1).try_cast("int")
    return F.when(year > 0, F.try_to_date(F.format_string("%04d-%02d-%02d", year, part(2), part(3))))


def duration_ms(text: Column) -> Column:
    """Digits as milliseconds, MM:SS and H:MM:SS as such; anything else is null."""
    pieces = F.split(text, ":")
    seconds = F.aggregate(pieces, F.lit(0).cast("bigint"), lambda acc, p: acc * 60 + p.try_cast("bigint"))
    return F.when(text.rlike(r"^\d+$"), text.try_cast("bigint")).when(text.rlike(r"^\d{1,3}(:\d{2}){1,2}$"), seconds * 1000)


def number_of(text: Column) -> Column:
    """The leading number of 7, 07 or 7/12; null where there is none."""
    return F.regexp_extract(text, r"^\s*(\d{1,9})", 1).try_cast("int")


def volume_of(text: Column) -> Column:
    """The number a title closes with."""
    return F.regexp_extract(text, r"(\d{1,9})\s*$", 1).try_cast("int")


def within_bytes(text: Column, limit: int = 255) -> Column:
    """The longest beginning whose UTF-8 form has at most `limit` bytes, without separators and control characters."""
    clean = F.trim(F.regexp_replace(text, r"[/\\:*?\"<>|\x00-\x1f]", "_"))

    def cut(series: pd.Series) -> pd.Series:
        return series.map(lambda t: t.encode()[:limit].decode("utf-8", "ignore"), na_action="ignore")

    return F.when(F.octet_length(clean) <= limit, clean).otherwise(F.pandas_udf(cut, "string")(clean))


def words_all_in(haystack: Column, needles: str) -> Column:
    """Whether a folded text holds every word of a query."""
    out = F.lit(True)
    for word in needles.casefold().split():
        out = out & F.contains(F.lower(haystack), F.lit(word))
    return out


def folded_query(query: str) -> str:
    """A typed query as fold_accents leaves texts."""
    return _folded(pd.Series([query]))[0]


def render(template: str, values: dict[str, Column]) -> Column:
    """A template with %name% fields; text in braces is left out where one of its fields is null or empty."""
    def filled(part: str) -> tuple[Column, list[Column]]:
        pieces, used = [], []
        for i, x in enumerate(part.split("%")):
            if i % 2:
                used.append(values[x])
                pieces.append(F.coalesce(values[x].cast("string"), F.lit("")))
            elif x:
                pieces.append(F.lit(x))
        return F.concat(*pieces) if pieces else F.lit(""), used

    out = []
    for i, part in enumerate(template.replace("}", "{").split("{")):
        text, used = filled(part)
        if i % 2:
            present = F.lit(True)
            for v in used:
                present = present & v.isNotNull() & (v.cast("string") != "")
            text = F.when(present, text).otherwise("")
        out.append(text)
    return F.concat(*out)
