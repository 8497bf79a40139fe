"""How well a folder and a candidate release agree: signals weighed to one confidence, as column expressions.

Signals are columns; an absent observation is null and drops out. Only the
likeness of two titles needs Python, in Arrow batches.
"""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .evidence import weighted_mean

# Weights of the signals, and the lines they are held against.
TEXT, COUNT = 0.85, 0.15
ALBUM, ARTIST, TITLES, YEAR, ORDER_BONUS = 0.35, 0.25, 0.30, 0.10, 0.1
VETO_SHARE, RESCUE, VETO_CEILING, GUESS_CEILING, LIFT, EDITION, DIVERGENCE = 0.25, 0.5, 0.15, 0.55, 0.5, 0.25, 0.2
ALIKE, STEM, AGREES = 0.80, 0.90, 0.85
VARIOUS = ("va", "v.a.", "v/a", "various", "various artists")
CONJUNCTIONS = frozenset({"e", "and", "y", "&", "+"})

_WORD = re.compile(r"\w+|&|\+")
_DECORATION = re.compile(r"\s*(?:[(\[][^)\]]*\b(?:bonus|remaster\w*|live|mono|stereo|version|mix|edit)\b[^)\]]*[)\]]|\s-\s.*\b(?:bonus|remaster\w*|live|mono|stereo|version|mix|edit)\b.*)\s*$", re.I)


def folded(text: str | None) -> str:
    bare = unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", " ".join((text or "").split())) if unicodedata.category(c) != "Mn"))
    return bare.casefold()


def words(text: str | None) -> list[str]:
    return sorted("&" if w in CONJUNCTIONS else w for w in _WORD.findall(folded(text)))


def likeness(a: str | None, b: str | None) -> float:
    """1 for the same words in any order, accents, case, conjunctions and punctuation aside; else the Ratcliff-Obershelp ratio; 0 where one is empty."""
    one, two = folded(a), folded(b)
    if not one or not two:
        return 0.0
    if words(a) and words(a) == words(b):
        return 1.0
    return round(difflib.SequenceMatcher(None, one, two).ratio(), 4)


def title_likeness(a: str | None, b: str | None) -> float:
    """The same, seeing past a decoration that only one title carries where the stems agree closely."""
    raw, one, two = likeness(a, b), _DECORATION.sub("", a or ""), _DECORATION.sub("", b or "")
    if one == (a or "") and two == (b or ""):
        return raw
    stem = likeness(one, two)
    return max(raw, stem) if stem >= STEM else raw


def agreeing_titles(local: list[str] | None, tracks: list[str] | None) -> tuple[int, bool]:
    """How many titles pair up, the best first and each used once, and whether those that each find their best one stand in order."""
    local, tracks = list(local if local is not None else []), list(tracks if tracks is not None else [])
    scores = {(i, j): title_likeness(a, b) for i, a in enumerate(local) for j, b in enumerate(tracks)}
    ours, theirs = set(), set()
    for (i, j), x in sorted(scores.items(), key=lambda s: (-s[1], -s[0][0], -s[0][1])):
        if x < ALIKE:
            break
        if i not in ours and j not in theirs:
            ours.add(i)
            theirs.add(j)
    places: list[int] = []
    for i in range(len(local)):
        best = max((j for j in range(len(tracks)) if j not in places), key=lambda j: (scores[i, j], -j), default=None)
        if best is not None and scores[i, best] >= ALIKE:
            places.append(best)
    return len(ours), len(places) > 1 and places == sorted(places)


def similarity(a: Column | str, b: Column | str) -> Column:
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else likeness(p, q) for p, q in zip(x, y)], dtype="float64")

    return F.pandas_udf(run, "double")(a, b)


def titles_agree(local: Column | str, tracks: Column | str) -> Column:
    """struct(agreeing, in_order) of two arrays of titles."""

    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([agreeing_titles(p, q) for p, q in zip(x, y)], columns=["agreeing", "in_order"])

    return F.pandas_udf(run, "struct<agreeing:int,in_order:boolean>")(local, tracks)


def artist_similarity(hint: Column, credit: Column, similar: Column) -> Column:
    """`similar`, but null where one side names nobody or only various artists."""
    nobody = F.coalesce(F.trim(hint), F.lit("")).isin("") | F.coalesce(F.trim(credit), F.lit("")).isin("")
    return F.when(~nobody & ~F.lower(F.trim(hint)).isin(*VARIOUS) & ~F.lower(F.trim(credit)).isin(*VARIOUS), similar)


def edition_side(local: Column, remote: Column) -> Column:
    """Which of two arrays of edition words names one the other doesn't: empty, local, release or each."""
    ours, theirs = F.size(F.array_except(local, remote)) > 0, F.size(F.array_except(remote, local)) > 0
    return F.when(ours & theirs, "each").when(ours, "local").when(theirs, "release").otherwise("")


def share(agreeing: Column, compared: Column) -> Column:
    return F.when(compared > 0, agreeing / compared)


def vetoed(titles_agreeing: Column, titles_compared: Column, duration: Column) -> Column:
    """Whether both sides have names of which hardly any meet, and the lengths don't speak for them."""
    return (titles_compared > 0) & (titles_agreeing / F.greatest(titles_compared, F.lit(1)) < VETO_SHARE) & (duration.isNull() | (duration < RESCUE))


def text_score(s: dict[str, Column], titles: bool = True) -> Column:
    """Mean of the signals present, by weight; the plain likeness where there is none."""
    # `least` passes over nulls.
    named = F.when(s["title"].isNotNull(), F.least(F.lit(1.0), s["title"] + F.when(s["in_order"], ORDER_BONUS).otherwise(0.0)))
    parts = [(s["album"], ALBUM), (s["artist"], ARTIST), *([(named, TITLES)] if titles else []), (s["year"], YEAR)]
    return F.coalesce(weighted_mean(parts, 15), s["text"])


def confidence(s: dict[str, Column]) -> Column:
    """One number from all signals.

    s: text, album, artist, year, title (share of titles agreeing), in_order,
    duration (share), titles_agreeing, titles_compared, count_agrees, edition.
    """
    d = s["duration"]
    noise = (s["titles_compared"] > 0) & (s["titles_agreeing"] / F.greatest(s["titles_compared"], F.lit(1)) < VETO_SHARE) & F.coalesce(d >= RESCUE, F.lit(False))
    count = F.when(s["count_agrees"], COUNT).otherwise(0.0)
    with_titles, without = TEXT * text_score(s) + count, TEXT * text_score(s, titles=False) + count
    some = F.coalesce(d > 0, F.lit(False))
    reading = (
        F.when(noise, without + (1.0 - without) * d)
        .when(s["title"].isNull() & some, with_titles + (1.0 - with_titles) * d)
        .when(s["title"].isNull(), F.least(F.lit(GUESS_CEILING), with_titles))
        .when(some, with_titles + (1.0 - with_titles) * LIFT * d)
        .otherwise(with_titles)
    )
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), reading - F.when(s["edition"], EDITION).otherwise(0.0)))
    veto = vetoed(s["titles_agreeing"], s["titles_compared"], d)
    return F.bround(F.when(veto, F.least(F.lit(VETO_CEILING), s["text"] / 4)).otherwise(held), 4)


def ordering(confidence_: Column, hint_year: Column, pressing_year: Column, release_id: Column) -> list[Column]:
    """The order of candidates: surest first, then the year that is written on the folder, the earliest pressing, the id."""
    return [confidence_.desc(), F.coalesce(pressing_year == hint_year, F.lit(False)).desc(), F.coalesce(pressing_year, F.lit(9999)).asc(), release_id.asc()]


def reconciled(confidence_: Column, contradicting: Column) -> Column:
    """Confidence lowered by every source that has evidence and says otherwise."""
    return F.when(contradicting > 0, F.bround(F.greatest(F.lit(0.0), confidence_ - DIVERGENCE * contradicting), 4)).otherwise(confidence_)


def explained(s: dict[str, Column]) -> Column:
    """What spoke for and against, in one line."""
    return F.concat_ws("; ",
        F.when(vetoed(s["titles_agreeing"], s["titles_compared"], s["duration"]), "the titles refuse it"),
        F.when(s["titles_compared"] > 0, F.concat(s["titles_agreeing"].cast("string"), F.lit(" of "), s["titles_compared"].cast("string"), F.lit(" titles"))),
        F.when(s["in_order"] & (s["titles_agreeing"] > 1), "in order"), F.when(s["count_agrees"], "same number of tracks"), F.when(s["edition"], "another edition"))
