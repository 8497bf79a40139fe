"""Summaries of a spectrum and what they prove, as column expressions.

A spectrum is an array of struct<hertz, rms_db>: the energy above each
frequency, from low to high. Everything is a higher-order function of one
row; nothing is shuffled and no Python runs.

Defined results: a null or empty spectrum has no wall, floor or cliff, decay 0
and the ceiling of silence; an absent measurement convicts nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What separates a filter from music.
SILENCE_DB, WALL_DB, FLAT_DB, CLIFF_DB = -95.0, 20.0, 6.0, 16.0
DECAY_FROM, DECAY_TO, TRUSTED_HZ = 16_000, 19_000, 19_000
DECAY_DB, CEILING_DB, NEAR_DECAY_DB, NEAR_CEILING_DB = 15.0, -88.0, 13.5, -86.0
PEAK_Z, READINGS, EDGE_SHARE = 8.0, 4, 0.15
CLIP_DB, CLIPPED, OFFSET, DEEP, SHALLOW = -0.1, 100, 0.01, 24, 16


def linear(decibels: Column) -> Column:
    """Power of a level."""
    return F.pow(F.lit(10.0), decibels / 10)


def decibels(power: Column) -> Column:
    """Level of a power; none at all is silence."""
    return F.when(power > 0, 10 * F.log10(F.when(power > 0, power))).otherwise(F.lit(SILENCE_DB))


def _neighbours(a: Column, leave: int = 0) -> Column:
    """Pairs of neighbours of an array, without the last `leave` pairs."""
    n = F.greatest(F.size(a) - 1 - leave, F.lit(0))
    return F.when(n > 0, F.arrays_zip(F.slice(a, F.lit(1), n).alias("one"), F.slice(a, F.lit(2), n).alias("other"))).otherwise(F.array())


def wall(bands: Column) -> Column:
    """struct(low, high): the steepest fall between neighbours if it is a step; the last pair, where all music ends, is none."""
    steps = F.transform(_neighbours(bands, 1), lambda p: F.struct((p["one"]["rms_db"] - p["other"]["rms_db"]).alias("fall"), p["one"]["hertz"].alias("low"), p["other"]["hertz"].alias("high")))
    steepest = F.array_max(steps)
    return F.when(steepest["fall"] >= WALL_DB, F.struct(steepest["low"].alias("low"), steepest["high"].alias("high")))


def density(bands: Column) -> Column:
    """array of struct(low, high, level): energy per hertz between neighbours."""
    pairs = F.filter(_neighbours(bands), lambda p: p["other"]["hertz"] > p["one"]["hertz"])
    return F.transform(pairs, lambda p: F.struct(
        p["one"]["hertz"].alias("low"), p["other"]["hertz"].alias("high"),
        decibels((linear(p["one"]["rms_db"]) - linear(p["other"]["rms_db"])) / (p["other"]["hertz"] - p["one"]["hertz"])).alias("level")))


def floor_from(dense: Column) -> Column:
    """The frequency from which the density holds still up to the top; null where it keeps falling."""
    n = F.size(dense)
    floor = F.array_min(F.transform(F.slice(dense, n - 1, F.lit(2)), lambda d: d["level"]))
    flat = F.filter(F.transform(dense, lambda d, i: F.struct(d["low"].alias("low"), F.array_max(F.transform(F.slice(dense, i + 1, n), lambda e: e["level"])).alias("above"))), lambda x: x["above"] - floor <= FLAT_DB)
    return F.when(n >= 3, F.get(flat, F.lit(0))["low"])


def cliff(dense: Column) -> Column:
    """The steepest fall of the density on the way to its floor."""
    began = floor_from(dense)
    falls = F.transform(F.filter(_neighbours(dense), lambda p: p["other"]["low"] <= began), lambda p: p["one"]["level"] - p["other"]["level"])
    return F.coalesce(F.array_max(falls), F.lit(0.0))


def _level_at(bands: Column, hertz: int) -> Column:
    return F.coalesce(F.get(F.filter(bands, lambda b: b["hertz"] >= hertz), F.lit(0))["rms_db"], F.try_element_at(bands, F.lit(-1))["rms_db"], F.lit(SILENCE_DB))


def decay(bands: Column) -> Column:
    return _level_at(bands, DECAY_FROM) - _level_at(bands, DECAY_TO)


def ceiling(bands: Column) -> Column:
    return F.coalesce(F.try_element_at(bands, F.lit(-1))["rms_db"], F.lit(SILENCE_DB))


def steepest(bands: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(_neighbours(bands), lambda p: p["one"]["rms_db"] - p["other"]["rms_db"])), F.lit(0.0))


def bitrate_for(wall_low: Column) -> Column:
    """The bitrate whose encoder stops just above; none where two bitrates share the place."""
    return F.when(wall_low <= 16_000, 128).when(wall_low <= 17_500, 192)


def transcoded(cutoff: Column, fall: Column, top: Column, floor: Column) -> Column:
    """Whether one track by itself was lossy: cut off where no music ends, or falling steeply into an empty top that doesn't begin above that."""
    return F.when(cutoff <= TRUSTED_HZ, True).when(floor >= TRUSTED_HZ, False).otherwise((fall >= DECAY_DB) & (top <= CEILING_DB))


def borderline(fall: Column, top: Column) -> Column:
    """Whether one of the two signs holds and the other nearly does."""
    both = (fall >= DECAY_DB) & (top <= CEILING_DB)
    return ~both & ((fall >= DECAY_DB) & (top <= NEAR_CEILING_DB) | (fall >= NEAR_DECAY_DB) & (top <= CEILING_DB))


def framed(peak_z: Column, readings: Column) -> Column:
    return F.coalesce((peak_z >= PEAK_Z) & (readings >= READINGS), F.lit(False))


def edged(hertz: Column, share: Column) -> Column:
    return F.coalesce((hertz <= TRUSTED_HZ) & (share >= EDGE_SHARE), F.lit(False))


def empty_top(headroom: Column, has_wall: Column) -> Column:
    """Whether nothing stands above the reference band, of a track whose wall was looked for."""
    return F.coalesce((headroom <= SILENCE_DB) & has_wall.isNotNull(), F.lit(False))


def health(peak_db: Column, clipped: Column, offset: Column, effective: Column, container: Column) -> Column:
    """What is wrong with the waveform itself."""
    return F.array_compact(F.array(
        F.when(peak_db <= SILENCE_DB, "silent"), F.when((peak_db >= CLIP_DB) & (clipped >= CLIPPED), "clipping"), F.when(F.abs(offset) > OFFSET, "dc_offset"),
        F.when((container >= DEEP) & (effective <= SHALLOW), "inflated_bit_depth")))


def judge(m: dict[str, Column]) -> Column:
    """struct(encoding, proof, cutoff, bitrate): the first rule that answers.

    m: silent, lossless, declared, n_bands, wall_low, wall_high, floor, cliff, decay, ceiling, peak_z, readings, edge_hertz, edge_share.
    """
    cut_low = F.when((m["floor"] < TRUSTED_HZ) & (m["cliff"] >= CLIFF_DB), m["floor"])
    cutoff, bitrate = F.coalesce(m["wall_high"], cut_low), bitrate_for(m["wall_low"])

    def said(encoding: str, proof: str | None = None, at: Column = cutoff, rate: Column | None = None) -> Column:
        return F.struct(F.lit(encoding).alias("encoding"), F.lit(proof).alias("proof"), at.cast("int").alias("cutoff"), (F.lit(None) if rate is None else rate).cast("int").alias("bitrate"))

    nothing = F.lit(None).cast("int")
    is_cut = m["wall_high"].isNotNull() | cut_low.isNotNull()
    guilty = is_cut | F.coalesce(transcoded(cutoff, m["decay"], m["ceiling"], m["floor"]), F.lit(False))
    return (
        F.when(m["silent"] | (m["n_bands"] == 0), said("undecided", at=nothing))
        .when(m["lossless"] & framed(m["peak_z"], m["readings"]), said("transcoded", "grid"))
        .when(m["lossless"] & edged(m["edge_hertz"], m["edge_share"]), said("transcoded", "wall", m["edge_hertz"]))
        .when(m["lossless"] & ~guilty, said("lossless", at=nothing))
        .when(m["lossless"] & is_cut, said("transcoded", "wall", rate=bitrate))
        .when(m["lossless"], said("transcoded", "spectrum", rate=bitrate))
        .when(bitrate < m["declared"] * 0.75, said("overstated", rate=bitrate))
        .otherwise(said("lossy", rate=F.coalesce(bitrate, m["declared"])))
    )


def album_columns(m: dict[str, Column]) -> list[Column]:
    """Aggregates of an album's tracks (encoding, cutoff, bitrate, lossless, heard, decay, ceiling, floor, framed), from which judge_album tells what it is."""
    inside = m["lossless"]
    heard = m["heard"]
    return [
        F.count_if(heard).alias("n_heard"), F.count_if(inside).alias("n_inside"), F.count("*").alias("n_tracks"),
        F.count_if(m["encoding"] == "overstated").alias("n_overstated"), F.count_if(inside & (m["cutoff"] <= TRUSTED_HZ)).alias("n_walls"), F.count_if(inside & m["framed"]).alias("n_framed"),
        F.median(F.when(heard, m["decay"])).alias("drop_all"), F.median(F.when(heard & inside, m["decay"])).alias("drop_inside"), F.median(F.when(heard & inside, m["ceiling"])).alias("top_inside"),
        F.sort_array(F.collect_list(F.when(heard & inside, m["floor"]))).alias("floors"),
        F.bround(F.median(F.when(m["bitrate"] > 0, m["bitrate"]))).cast("int").alias("rate_all"), F.bround(F.median(F.when(inside & (m["bitrate"] > 0), m["bitrate"]))).cast("int").alias("rate_inside"),
    ]


def judge_album() -> dict[str, Column]:
    """encoding, proof, drop, top, bitrate of an album, of the columns that album_columns names. The lower middle stands for the floor."""
    drop = F.coalesce("drop_inside", "drop_all")
    top = F.coalesce("top_inside", F.lit(0.0))
    floor = F.get("floors", F.floor((F.size("floors") - 1) / 2).cast("int"))
    walls, grid = F.col("n_walls") * 2 > F.col("n_inside"), F.col("n_framed") * 2 > F.col("n_inside")
    both = F.when(floor >= TRUSTED_HZ, False).otherwise((drop >= DECAY_DB) & (top <= CEILING_DB))
    guilty = walls | grid | both
    undecided, lossy = F.col("n_heard") == 0, F.col("n_inside") == 0
    overstated = F.col("n_overstated") * 2 > F.col("n_tracks")
    encoding = F.when(undecided, "undecided").when(lossy & overstated, "overstated").when(lossy, "lossy").when(guilty, "transcoded").otherwise("lossless")
    proof = F.when(~undecided & ~lossy & guilty, F.when(grid, "grid").when(walls, "wall").otherwise("spectrum"))
    rate = F.when(undecided, F.lit(None)).when(lossy, F.col("rate_all")).when(guilty, F.col("rate_inside"))
    return {"encoding": encoding, "proof": proof, "drop": F.when(undecided, 0.0).when(lossy, F.col("drop_all")).otherwise(drop), "top": F.when(undecided | lossy, 0.0).otherwise(top), "bitrate": rate}


def margin(encoding: Column, drop: Column, top: Column) -> Column:
    """Decibels from the verdict's turning: of a convicted album its weaker sign, of an acquitted one the sign that saved it; null where decibels didn't decide."""
    convicted = (drop >= DECAY_DB) & (top <= CEILING_DB)
    return F.when((encoding == "transcoded") & ~convicted, F.lit(None)).when(encoding.isin("lossless", "transcoded") & convicted, F.least(drop - DECAY_DB, CEILING_DB - top)).when(
        encoding.isin("lossless", "transcoded"), F.greatest(DECAY_DB - drop, top - CEILING_DB)
    )


def sureness(encoding: Column, drop: Column, top: Column, tracks: Column, analyzed: Column, shared: Column, dissenting: Column) -> Column:
    """struct(word, margin, reasons): strong, fair or weak. Every reason can only lower the word."""
    gap = F.when(analyzed > 0, margin(encoding, drop, top))
    near = (encoding == "lossless") & borderline(drop, top)
    heavy = encoding.isin("lossless", "transcoded")
    partial = (tracks > 0) & (analyzed < tracks) & (analyzed > 0)
    apart = (analyzed > 0) & (dissenting * 3 > analyzed)
    level = F.least(
        F.when((shared > 0) & heavy, 0).when(shared > 0, 1).otherwise(2), F.when(analyzed == 0, 0).otherwise(2), F.when(partial & (analyzed * 2 < tracks), 0).when(partial, 1).otherwise(2),
        F.when((analyzed > 0) & near, 1).otherwise(2), F.when(gap < 3, 1).otherwise(2), F.when(apart, 1).otherwise(2),
    )
    reasons = F.concat_ws("; ",
        F.when(shared > 0, F.concat(shared.cast("string"), F.lit(" shared"))), F.when(analyzed == 0, "nothing measured"),
        F.when(partial, F.concat_ws(" of ", analyzed.cast("string"), tracks.cast("string"))), F.when((analyzed > 0) & near, "borderline"),
        F.when(gap < 3, "narrow"), F.when(apart, F.concat(dissenting.cast("string"), F.lit(" dissent"))))
    return F.struct(F.element_at(F.array(F.lit("weak"), F.lit("fair"), F.lit("strong")), level + 1).alias("word"), gap.alias("margin"), reasons.alias("reasons"))


def key_sureness(lead: Column, mixes: Column) -> Column:
    """How far a key can be trusted by its lead over the runner-up; a tie between keys that mix does no harm."""
    return F.when(lead >= 0.10, "strong").when(lead >= 0.05, "fair").when(lead.isNotNull() & mixes, "mixable").when(lead.isNotNull(), "weak")
