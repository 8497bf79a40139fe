"""Files assigned to the tracks of a release: by place, by title, by duration; and counts of what agrees.

The candidates of one pair of unit and release are one row with two arrays,
so an assignment is a function of a row; nothing is shuffled for it.
Null arrays and null durations agree with nothing.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.matching import title_likeness

#: Milliseconds within which durations agree, and within which they may stand in order; least likeness of titles and its lead.
AGREE_MS, ORDER_MS, ALIKE, LEAD = 6_000, 15_000, 0.8, 0.05


def agreeing(a: list[int | None] | None, b: list[int | None] | None, tolerance: int = AGREE_MS) -> int:
    """How many of two sets of durations pair up, shortest first, each used once."""
    left = sorted(x for x in (a if a is not None else []) if x is not None)
    right = sorted(x for x in (b if b is not None else []) if x is not None)
    n = j = 0
    for x in left:
        while j < len(right) and right[j] < x - tolerance:
            j += 1
        if j < len(right) and right[j] <= x + tolerance:
            n, j = n + 1, j + 1
    return n


def _names_another(name: str | None, place: int, tracks: list[tuple[str | None, int | None]]) -> bool:
    """Whether a file is named for another track than the one in its place."""
    if not name:
        return False
    own = title_likeness(name, tracks[place][0]) if tracks[place][0] else 0.0
    return own < ALIKE and any(t[0] and title_likeness(name, t[0]) >= ALIKE for k, t in enumerate(tracks) if k != place)


def align(files: list[tuple[str | None, int | None]], tracks: list[tuple[str | None, int | None]]) -> tuple[str, list[int]]:
    """How the files were assigned (place, title, duration or none) and the track of each, -1 where it has none."""
    if not files or not tracks:
        return "none", [-1] * len(files)
    by_length = len(files) == len(tracks) and all(f[1] is not None and t[1] is not None and abs(f[1] - t[1]) <= ORDER_MS for f, t in zip(files, tracks))
    if by_length and not any(_names_another(f[0], k, tracks) for k, f in enumerate(files)):
        return "place", list(range(len(files)))
    if len(files) == len(tracks) and not any(t[1] for t in tracks) and all(f[0] and t[0] and title_likeness(f[0], t[0]) >= ALIKE for f, t in zip(files, tracks)):
        return "titled place", list(range(len(files)))
    chosen = []
    for name, _ in files:
        scores = sorted(((title_likeness(name, t[0]), -k) for k, t in enumerate(tracks) if name and t[0]), reverse=True)
        sure = scores and scores[0][0] >= ALIKE and (len(scores) == 1 or scores[0][0] - scores[1][0] >= LEAD)
        chosen.append(-scores[0][1] if sure else -1)
    named = [c for c in chosen if c >= 0]
    if named and len(named) == len(files) and len(set(named)) == len(named):
        return "title", chosen
    taken = {c for c in named if named.count(c) == 1}
    out = [c if c in taken else -1 for c in chosen]
    gaps = sorted((abs(f[1] - t[1]), i, k) for i, f in enumerate(files) if out[i] < 0 and f[1] is not None for k, t in enumerate(tracks) if k not in taken and t[1] is not None)
    for gap, i, k in gaps:
        rivals = [g for g, i2, k2 in gaps if (i2 == i) != (k2 == k) and g <= AGREE_MS and g == gap]
        if gap <= AGREE_MS and out[i] < 0 and k not in taken and not rivals:
            out[i] = k
            taken.add(k)
    return ("duration", out) if any(x >= 0 for x in out) else ("none", out)


def agreeing_durations(a: Column | str, b: Column | str) -> Column:
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([agreeing(p, q) for p, q in zip(x, y)], dtype="int32")

    return F.pandas_udf(run, "int")(a, b)


def aligned(files: Column | str, tracks: Column | str) -> Column:
    """struct(method, tracks) of two columns of array<struct<name,duration>>."""

    def pairs(rows) -> list[tuple[str | None, int | None]]:
        return [(None, None) if r is None else tuple(r.values())[:2] for r in (rows if rows is not None else [])]

    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([align(pairs(p), pairs(q)) for p, q in zip(x, y)], columns=["method", "tracks"])

    return F.pandas_udf(run, "struct<method:string,tracks:array<int>>")(files, tracks)
