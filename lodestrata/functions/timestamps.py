"""Times written in many formats, precisions and zones, brought to one instant.

A value may be read under several formats (is 04/05 April or May?). For each
source the shares of the formats are estimated by expectation maximisation:
every value spreads its likelihood over the formats under which it is a valid
time, and the shares follow from the posteriors. Each value then takes its
most probable format, or is marked ambiguous where none stands out.

Values are first counted by source and by the set of formats valid for them,
so the iterations run over a handful of counts per source, not over rows.

Defined results: null, empty and placeholder values (anything that is no time
under any format, and years before FIRST_YEAR) have the status `none` and no
instant. A wall-clock time of a row whose zone is null or unknown has the
status `no_zone`. A wall-clock time that occurs twice is the earlier one, one
that is skipped is read with the offset before the gap. Digits beyond
microseconds are dropped. Repeated rows are each resolved under their own key.
Columns of the input that are named like those added are replaced.
"""

from __future__ import annotations

import zoneinfo
from collections.abc import Sequence
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Years outside of this range tell no time.
FIRST_YEAR, LAST_YEAR = 1902, 2199
#: Steps of the estimation, and the pseudo-count of the stated date order.
STEPS, PRIOR = 25, 2.0
#: Below this posterior a value stays ambiguous.
SURE = 0.75

#: The one form that needs no work, and month names.
CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}Z$"
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?: ?([AaPp])\.?[Mm]\.?)?"
_ZONE = r"(?: ?(Z|[+-]\d{2}(?::?\d{2})?|\[[A-Za-z_/+\-0-9]+\]|[A-Z]{2,5}))?"
_YEAR_FIRST = rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:,?[T ]{_CLOCK}{_ZONE})?$"
_YEAR_LAST = rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}})(?:,? {_CLOCK}{_ZONE})?$"
_NAMED = rf"^(?:[A-Za-z]{{2,9}}\.?,? )?(\d{{1,2}})\.? ([A-Za-z]{{3,9}})\.?,? (\d{{4}})(?:,? {_CLOCK}{_ZONE})?$"
_COMPACT = rf"^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}})?()(){_ZONE}$"
_EPOCH = r"^\d{9,16}$"

EPOCHS = {"epoch_s": 1_000_000, "epoch_ms": 1_000, "epoch_us": 1}


def zone_abbreviations(zones: Sequence[str] = (
    "UTC", "Europe/London", "Europe/Berlin", "Europe/Lisbon", "Europe/Moscow", "Europe/Athens", "America/New_York",
    "America/Chicago", "America/Denver", "America/Los_Angeles", "Asia/Tokyo", "Asia/Kolkata", "Asia/Seoul", "Australia/Sydney",
    "Australia/Adelaide", "Australia/Perth", "Africa/Johannesburg", "Pacific/Auckland",
)) -> dict[str, int]:
    """Offsets in minutes of the letters that these zones use, in winter and summer; the first zone wins."""
    out = {"GMT": 0, "UT": 0, "Z": 0}
    for name in zones:
        for month in (1, 7):
            at = datetime(2024, month, 1, tzinfo=zoneinfo.ZoneInfo(name))
            if (letters := at.tzname()).isalpha():
                out.setdefault(letters, int(at.utcoffset().total_seconds() // 60))
    return out


def own_abbreviations(zones: Sequence[str]) -> dict[str, dict[int, list[str]]]:
    """letters -> minutes -> zones that use them so: letters such as IST mean what the row's own zone means by them."""
    out: dict[str, dict[int, list[str]]] = {}
    for name in zones:
        for month in (1, 7):
            at = datetime(2024, month, 1, tzinfo=zoneinfo.ZoneInfo(name))
            if (letters := at.tzname()).isalpha():
                out.setdefault(letters, {}).setdefault(int(at.utcoffset().total_seconds() // 60), []).append(name)
    return out


def _minutes_of(letters: Column, zone: Column, known: Sequence[str]) -> Column:
    """The offset letters stand for; where zones disagree on them the row's zone decides, else the best-known one."""
    default, branches = zone_abbreviations(), []
    for name, meanings in own_abbreviations(known).items():
        usual = default.get(name, next(iter(meanings)))
        others = [(zone.isin(zones), F.lit(minutes)) for minutes, zones in meanings.items() if minutes != usual]
        branches.append((letters == name, _first(others).otherwise(usual) if others else F.lit(usual)))
    return _first(branches + [(letters == name, F.lit(m)) for name, m in default.items()])


#: Parts of a value, as every pattern numbers them: three figures of the date, hour, minute, second, fraction, half of the day, zone.
_PARTS = "\x01".join(f"${i}" for i in range(1, 10))
_FAMILIES = {
    "year_first": (r"^\d{4}[-/.]", _YEAR_FIRST),
    "compact": (r"^\d{8}T", _COMPACT),
    "figures": (r"^\d{1,2}[-/.]\d", _YEAR_LAST),
    "named": (r"\d{1,2}\.? [A-Za-z]", _NAMED),
}
#: family -> formats with the parts that hold year, month and day
_ORDERS = {
    "year_first": {"year_first": (0, 1, 2)},
    "compact": {"compact": (0, 1, 2)},
    "figures": {"dmy": (2, 1, 0), "mdy": (2, 0, 1)},
    "named": {"named": (2, 1, 0)},
}


def _first(branches: list[tuple[Column, Column]]) -> Column:
    out = F.when(*branches[0])
    for condition, value in branches[1:]:
        out = out.when(condition, value)
    return out


def read_candidates(values: DataFrame, text: str) -> DataFrame:
    """Add `__c`, the formats under which the value is a time with their local microseconds, and `__zone` as written.

    Each step is a projection of its own, so that no expression is worked out twice.
    """
    out = values.withColumn("__t", F.when(~F.col(text).rlike(CANONICAL), F.trim(F.col(text))))
    out = out.withColumn(
        "__family",
        _first([(F.col("__t").rlike(_EPOCH), F.lit("epoch"))] + [(F.col("__t").rlike(sign), F.lit(f)) for f, (sign, _) in _FAMILIES.items()]),
    )
    cut = _first([(F.col("__family") == f, F.regexp_replace("__t", pattern, _PARTS)) for f, (_, pattern) in _FAMILIES.items()])
    out = out.withColumn("__p", F.split(cut, "\x01"))
    out = out.withColumn("__p", F.when(F.size("__p") == 9, F.col("__p")))

    def number(i: int) -> Column:
        return F.get("__p", i).try_cast("int")

    month = F.array_position(F.array(*[F.lit(x) for x in MONTHS]), F.lower(F.substring(F.get("__p", 1), 1, 3))).cast("int")
    out = out.withColumns({f"__{i}": F.coalesce(number(i), month) if i == 1 else number(i) for i in range(6)})
    half = F.lower(F.get("__p", 7))
    hour = (
        F.when(half == "", F.coalesce("__3", F.lit(0)))
        .when(~F.col("__3").between(1, 12), None)
        .otherwise(F.col("__3") % 12 + F.when(half == "p", 12).otherwise(0))
    )
    minute, second = F.coalesce("__4", F.lit(0)), F.coalesce("__5", F.lit(0))
    fraction = F.coalesce(F.rpad(F.substring(F.get("__p", 6), 1, 6), 6, "0").try_cast("bigint"), F.lit(0))
    clock = (hour * 3600 + minute * 60 + second).cast("bigint") * 1_000_000 + fraction
    out = out.withColumn("__clock", F.when(hour.between(0, 23) & minute.between(0, 59) & second.between(0, 59), clock))

    def dated(name: str, y: int, m: int, d: int) -> Column:
        year = F.col(f"__{y}")
        day = F.unix_date(F.try_to_date(F.format_string("%04d-%02d-%02d", year, f"__{m}", f"__{d}")))
        us = F.when(year.between(FIRST_YEAR, LAST_YEAR), day.cast("bigint") * 86_400_000_000 + F.col("__clock"))
        return F.struct(F.lit(name).alias("key"), us.alias("us"))

    def counted(name: str, scale: int) -> Column:
        us = F.try_multiply(F.col("__t").try_cast("bigint"), F.lit(scale))
        # Counted from 1990 to 2100: so only one of the units fits a value.
        return F.struct(F.lit(name).alias("key"), F.when(us.between(631_152_000_000_000, 4_102_444_800_000_000), us).alias("us"))

    read = _first(
        [(F.col("__family") == "epoch", F.array(*[counted(n, scale) for n, scale in EPOCHS.items()]))]
        + [(F.col("__family") == f, F.array(*[dated(n, *at) for n, at in orders.items()])) for f, orders in _ORDERS.items()]
    )
    zone = F.when(F.col("__family") == "epoch", "Z").otherwise(F.get("__p", 8))
    return out.select(*values.columns, F.filter(read, lambda c: c["us"].isNotNull()).alias("__c"), zone.alias("__zone"))


def _estimate(counts: pd.DataFrame) -> pd.DataFrame:
    """For one source: the most probable format of each set of valid formats."""
    counts = counts[counts["formats"].fillna("") != ""].reset_index(drop=True)
    if not len(counts):
        return pd.DataFrame({"source": [], "formats": [], "format": [], "posterior": []}).astype({"posterior": float, "source": str, "formats": str, "format": str})
    sets = [s.split("|") for s in counts["formats"]]
    prior = {f: PRIOR if counts["date_order"].iloc[0] == f else 0.01 for s in sets for f in s}
    share = {f: 1 / len(prior) for f in prior}
    for _ in range(STEPS):
        new = dict(prior)
        for s, n in zip(sets, counts["n"]):
            total = sum(share[f] for f in s)
            for f in s:
                new[f] += n * share[f] / total
        whole = sum(new.values())
        share = {f: v / whole for f, v in new.items()}
    rows = []
    for s in sets:
        total = sum(share[f] for f in s)
        best = max(s, key=lambda f: (share[f], f))
        rows.append((best, share[best] / total))
    out = counts[["source", "formats"]].copy()
    out["format"], out["posterior"] = [r[0] for r in rows], [r[1] for r in rows]
    return out


def to_instants(values: DataFrame, text: str, source: Sequence[str], zone: str, date_order: str) -> DataFrame:
    """Add `format`, `posterior`, `status` (one of given, none, no_zone, ambiguous, read) and `utc_us`.

    `zone` and `date_order` name columns with the wall clock and the habit of
    the row's source. The posteriors are a table of a few rows per source; it
    is joined by source, and Spark broadcasts it only while it is small.
    """
    values = values.drop("format", "posterior", "status", "utc_us")
    read = read_candidates(values, text)
    read = read.withColumn("__source", F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in source]))
    read = read.withColumn("__formats", F.array_join(F.transform("__c", lambda c: c["key"]), "|"))
    counts = (
        # No filter here: pushed below the projections, it would work every step out anew.
        read.groupBy(F.col("__source").alias("source"), F.col("__formats").alias("formats"))
        .agg(F.count("*").alias("n"), F.first(date_order, ignorenulls=True).alias("date_order"))
    )
    posteriors = counts.groupBy("source").applyInPandas(_estimate, "source string, formats string, format string, posterior double")
    posteriors = posteriors.select(F.col("source").alias("__source"), F.col("formats").alias("__formats"), "format", "posterior")
    joined = read.join(posteriors, ["__source", "__formats"], "left")
    at = joined.withColumn("__us", F.filter("__c", lambda c: c["key"] == F.col("format")))
    at = at.withColumn("__us", F.when(F.size("__us") > 0, F.col("__us")[0]["us"]))
    at = at.withColumn("__utc", _instant(F.col("__us"), F.col("__zone"), F.col(zone)))
    given, sure = F.col(text).rlike(CANONICAL), F.col("posterior") >= SURE
    return at.select(
        *values.columns,
        "format",
        "posterior",
        F.when(given, "given")
        .when(F.col("__us").isNull(), "none")
        .when(~sure, "ambiguous")
        .when(F.col("__utc").isNull(), "no_zone")
        .otherwise("read")
        .alias("status"),
        F.when(given, F.unix_micros(F.try_to_timestamp(F.col(text)))).when(sure, F.col("__utc")).alias("utc_us"),
    )


def _instant(us: Column, written: Column, zone: Column) -> Column:
    """Microseconds in UTC of a wall clock, by the zone written or else the row's own."""
    known = sorted(zoneinfo.available_timezones())
    wall = F.when(written == "", zone).when(written.startswith("["), F.regexp_replace(written, r"^\[|\]$", ""))
    figures = F.regexp_replace(written, ":", "")
    sign = F.when(written.startswith("-"), -1).otherwise(1)
    minutes = sign * (F.substring(figures, 2, 2).try_cast("int") * 60 + F.coalesce(F.substring(figures, 4, 2).try_cast("int"), F.lit(0)))
    return (
        F.when(written.isin("Z", "UTC", "GMT"), us)
        .when(wall.isin(known), F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(us), wall)))
        .when(written.rlike(r"^[+-]\d"), us - minutes.cast("bigint") * 60_000_000)
        .when(written.rlike("^[A-Z]"), us - _minutes_of(written, zone, known).cast("bigint") * 60_000_000)
    )
