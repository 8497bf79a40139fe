"""Queries of spectra, verdicts and their sureness, each beside its SQL.

The spectra are made of the first values of each embedding: a level that only
falls from one frequency to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spectra
from ..session import table
from .registry import query

#: Frequencies at which the energy above is measured.
PROBES = (10_000, 13_000, 15_000, 16_000, 17_500, 19_000, 20_000, 21_500)

_SPECTRA_SQL = f"""
with e as (select vec_id, label, embedding, unnest(range(1, 9)) as i from embeddings),
s as (select vec_id, label, i, {list(PROBES)}[i] as hertz, -30 - 300 * power(abs(embedding[i]::double), 1.5) * case when vec_id % 3 = 0 and i = 4 then 8 else 1 end as step from e),
b as (select vec_id, label, i, hertz, sum(step) over (partition by vec_id order by i) / 2.5 as rms_db from s),
p as (select *, lead(hertz) over w as high, lead(rms_db) over w as below from b window w as (partition by vec_id order by i)),
falls as (select vec_id, max(struct_pack(fall := rms_db - below, low := hertz, high := high)) filter (where i <= 6) as w, max(rms_db - below) as steepest from p where high is not null group by 1),
d as (select vec_id, i, hertz as low, 10 * log10((power(10.0, rms_db / 10) - power(10.0, below / 10)) / (high - hertz)) as level from p where high is not null),
d2 as (select *, max(level) over (partition by vec_id order by i rows between current row and unbounded following) as above, lag(level) over (partition by vec_id order by i) as before from d),
fl as (select vec_id, min(level) filter (where i >= 6) as floor from d2 group by 1),
ff as (select vec_id, min(low) filter (where above - floor <= 6) as floor_from from d2 join fl using (vec_id) group by 1),
cl as (select vec_id, coalesce(max(before - level) filter (where low <= floor_from), 0.0) as cliff from d2 join ff using (vec_id) group by 1),
lv as (select vec_id, any_value(label) as label, max(rms_db) filter (where i = 4) - max(rms_db) filter (where i = 6) as decay, max(rms_db) filter (where i = 8) as ceiling from b group by 1),
m as (select vec_id, label, case when w.fall >= 20 then w.low end as wall_low, case when w.fall >= 20 then w.high end as wall_high, floor_from, cliff, decay, ceiling, steepest,
vec_id % 7 = 0 as silent, vec_id % 4 <> 0 as lossless, cast(96 + 32 * (vec_id % 8) as integer) as declared, case when vec_id % 5 <> 0 then (vec_id * 13) % 12 + 0.5 end as peak_z,
cast((vec_id * 11) % 7 as integer) as readings, case when vec_id % 6 <> 0 then cast(15000 + 500 * (vec_id % 12) as integer) end as edge_hertz, (vec_id % 20) / 100.0 as edge_share
from falls join ff using (vec_id) join cl using (vec_id) join lv using (vec_id)),
c as (select *, case when floor_from < 19000 and cliff >= 16 then floor_from end as cut_low, coalesce(peak_z >= 8 and readings >= 4, false) as framed,
coalesce(edge_hertz <= 19000 and edge_share >= 0.15, false) as edged, case when wall_low <= 16000 then 128 when wall_low <= 17500 then 192 end as wall_rate from m),
g as (select *, coalesce(wall_high, cut_low) as stop, wall_high is not null or cut_low is not null as is_cut from c),
k as (select *, is_cut or coalesce(case when stop <= 19000 then true when floor_from >= 19000 then false else decay >= 15 and ceiling <= -88 end, false) as guilty from g),
v as (select *, case when silent then 'undecided' when lossless and (framed or edged) then 'transcoded' when lossless and not guilty then 'lossless' when lossless then 'transcoded'
when wall_rate < declared * 0.75 then 'overstated' else 'lossy' end as encoding,
case when silent or not lossless then null when framed then 'grid' when edged then 'wall' when not guilty then null when is_cut then 'wall' else 'spectrum' end as proof,
cast(case when silent then null when lossless and framed then stop when lossless and edged then edge_hertz when lossless and not guilty then null else stop end as integer) as cutoff,
cast(case when silent or lossless and (framed or edged or not guilty) then null when lossless or wall_rate < declared * 0.75 then wall_rate else coalesce(wall_rate, declared) end as integer) as bitrate from k)
"""


def _measured(s, d) -> DataFrame:
    e = F.transform(F.slice("embedding", 1, len(PROBES)), lambda x: F.pow(F.abs(x.cast("double")), F.lit(1.5)))
    step = F.transform(e, lambda x, i: -30 - 300 * x * F.when((F.col("vec_id") % 3 == 0) & (i == 3), 8).otherwise(1))
    level = F.transform(F.sequence(F.lit(1), F.lit(len(PROBES))), lambda i: F.aggregate(F.slice("step", F.lit(1), i), F.lit(0.0), lambda a, x: a + x) / 2.5)
    hertz = F.array(*map(F.lit, PROBES))
    bands = F.zip_with(hertz, level, lambda h, x: F.struct(h.alias("hertz"), x.alias("rms_db")))
    base = table(s, d, "embeddings").select("vec_id", "label", step.alias("step")).select("vec_id", "label", bands.alias("bands"))
    dense = base.withColumn("dense", spectra.density(F.col("bands"))).withColumn("wall", spectra.wall(F.col("bands")))
    b, x, n = F.col("bands"), F.col("dense"), F.col("vec_id")
    return dense.select(
        "vec_id", "label", F.col("wall.low").alias("wall_low"), F.col("wall.high").alias("wall_high"), spectra.floor_from(x).alias("floor_from"), spectra.cliff(x).alias("cliff"),
        spectra.decay(b).alias("decay"), spectra.ceiling(b).alias("ceiling"), spectra.steepest(b).alias("steepest"), (n % 7 == 0).alias("silent"), (n % 4 != 0).alias("lossless"),
        (96 + 32 * (n % 8)).cast("int").alias("declared"), F.when(n % 5 != 0, (n * 13) % 12 + F.lit(0.5).cast("double")).alias("peak_z"), ((n * 11) % 7).cast("int").alias("readings"),
        F.when(n % 6 != 0, (15000 + 500 * (n % 12)).cast("int")).alias("edge_hertz"), ((n % 20) / 100.0).alias("edge_share"), F.size("bands").alias("n_bands"),
    )


def _judged(s, d) -> DataFrame:
    m = _measured(s, d)
    names = {k: F.col(k) for k in ("silent", "lossless", "declared", "n_bands", "wall_low", "wall_high", "cliff", "decay", "ceiling", "peak_z", "readings", "edge_hertz", "edge_share")}
    return m.withColumn("v", spectra.judge(names | {"floor": F.col("floor_from")})).select("*", "v.*")


@query(_SPECTRA_SQL + "select vec_id, wall_low, wall_high, floor_from, round(cliff, 6) as cliff, round(decay, 6) as decay, round(ceiling, 6) as ceiling, round(steepest, 6) as steepest from m")
def spectral_profile(s, d):
    """Wall, floor, cliff, decay, ceiling and steepest fall of each spectrum."""
    return _measured(s, d).select("vec_id", "wall_low", "wall_high", "floor_from", *[F.round(c, 6).alias(c) for c in ("cliff", "decay", "ceiling", "steepest")])


@query(_SPECTRA_SQL + "select vec_id, i as place, round(10 * log10((power(10.0, rms_db / 10) - power(10.0, below / 10)) / (high - hertz)), 6) as level from p where high is not null")
def band_density(s, d):
    """Energy per hertz between neighbouring frequencies."""
    e = F.transform(F.slice("embedding", 1, len(PROBES)), lambda x: F.pow(F.abs(x.cast("double")), F.lit(1.5)))
    step = F.transform(e, lambda x, i: -30 - 300 * x * F.when((F.col("vec_id") % 3 == 0) & (i == 3), 8).otherwise(1))
    level = F.transform(F.sequence(F.lit(1), F.lit(len(PROBES))), lambda i: F.aggregate(F.slice("step", F.lit(1), i), F.lit(0.0), lambda a, x: a + x) / 2.5)
    bands = F.zip_with(F.array(*map(F.lit, PROBES)), level, lambda h, x: F.struct(h.alias("hertz"), x.alias("rms_db")))
    dense = table(s, d, "embeddings").select("vec_id", step.alias("step")).select("vec_id", F.posexplode(spectra.density(bands)).alias("i", "x"))
    return dense.select("vec_id", (F.col("i") + 1).cast("bigint").alias("place"), F.round("x.level", 6).alias("level"))


@query(_SPECTRA_SQL + "select vec_id, encoding, proof, cutoff, bitrate, lossless and not silent and encoding = 'lossless' and not (decay >= 15 and ceiling <= -88) and (decay >= 15 and ceiling <= -86 or decay >= 13.5 and ceiling <= -88) as near from v")
def track_verdicts(s, d):
    """What each track is, what proved it, and whether it was a near thing."""
    near = F.col("lossless") & ~F.col("silent") & (F.col("encoding") == "lossless") & spectra.borderline(F.col("decay"), F.col("ceiling"))
    return _judged(s, d).select("vec_id", "encoding", "proof", "cutoff", "bitrate", near.alias("near"))


_ALBUM_SQL = _SPECTRA_SQL + """,
a as (select label, count(*) filter (where not silent) as n_heard, count(*) filter (where lossless) as n_inside, count(*) as n_tracks, count(*) filter (where encoding = 'overstated') as n_over,
count(*) filter (where lossless and cutoff <= 19000) as n_walls, count(*) filter (where lossless and framed) as n_framed, median(decay) filter (where not silent) as drop_all,
median(decay) filter (where not silent and lossless) as drop_in, median(ceiling) filter (where not silent and lossless) as top_in,
quantile_disc(floor_from, 0.5) filter (where not silent and lossless) as floor_low, cast(round_even(median(bitrate) filter (where bitrate > 0), 0) as integer) as rate_all,
cast(round_even(median(bitrate) filter (where bitrate > 0 and lossless), 0) as integer) as rate_in from v group by 1),
j as (select *, n_framed * 2 > n_inside as grid, n_walls * 2 > n_inside as walls, coalesce(drop_in, drop_all) as drp, coalesce(top_in, 0.0) as tp from a),
q as (select *, grid or walls or case when floor_low >= 19000 then false else drp >= 15 and tp <= -88 end as guilty from j),
al as (select label, n_tracks, n_heard, case when n_heard = 0 then 'undecided' when n_inside = 0 and n_over * 2 > n_tracks then 'overstated' when n_inside = 0 then 'lossy' when guilty then 'transcoded' else 'lossless' end as encoding,
case when n_heard > 0 and n_inside > 0 and guilty then case when grid then 'grid' when walls then 'wall' else 'spectrum' end end as proof, case when n_heard = 0 then 0.0 when n_inside = 0 then drop_all else drp end as fall,
case when n_heard = 0 or n_inside = 0 then 0.0 else tp end as top, case when n_heard = 0 then null when n_inside = 0 then rate_all when guilty then rate_in end as bitrate from q)
"""


def _albums(s, d) -> DataFrame:
    tracks = _judged(s, d).withColumn("framed", spectra.framed(F.col("peak_z"), F.col("readings")))
    names = {k: F.col(k) for k in ("encoding", "cutoff", "bitrate", "lossless", "decay", "ceiling", "framed")}
    grouped = tracks.groupBy("label").agg(*spectra.album_columns(names | {"heard": ~F.col("silent"), "floor": F.col("floor_from")}))
    v = spectra.judge_album()
    return grouped.select("label", "n_tracks", "n_heard", v["encoding"].alias("encoding"), v["proof"].alias("proof"), v["drop"].alias("fall"), v["top"].alias("top"), v["bitrate"].alias("bitrate"))


@query(_ALBUM_SQL + "select label, encoding, proof, round(fall, 6) as fall, round(top, 6) as top, bitrate from al")
def album_verdicts(s, d):
    """What each album is by the medians and majorities of its tracks, with the strongest proof."""
    return _albums(s, d).select("label", "encoding", "proof", F.round("fall", 6).alias("fall"), F.round("top", 6).alias("top"), "bitrate")


@query(_ALBUM_SQL + """,
ds as (select v.label, count(*) filter (where v.encoding <> al.encoding and not v.silent) as dissenting, count(*) filter (where v.vec_id % 50 = 0) as shared from v join al using (label) group by 1),
x as (select *, fall >= 15 and top <= -88 as convicted from al join ds using (label)),
y as (select *, case when n_heard = 0 then null when encoding = 'transcoded' and not convicted then null when encoding in ('lossless', 'transcoded') and convicted then least(fall - 15, -88 - top)
when encoding in ('lossless', 'transcoded') then greatest(15 - fall, top + 88) end as gap, encoding = 'lossless' and not convicted and (fall >= 15 and top <= -86 or fall >= 13.5 and top <= -88) as near from x),
z as (select *, least(case when shared > 0 and encoding in ('lossless', 'transcoded') then 0 when shared > 0 then 1 else 2 end, case when n_heard = 0 then 0 else 2 end,
case when n_heard > 0 and n_heard < n_tracks and n_heard * 2 < n_tracks then 0 when n_heard > 0 and n_heard < n_tracks then 1 else 2 end, case when n_heard > 0 and near then 1 else 2 end,
case when gap < 3 then 1 else 2 end, case when n_heard > 0 and dissenting * 3 > n_heard then 1 else 2 end) as lv from y)
select label, ['weak', 'fair', 'strong'][lv + 1] as sureness, round(gap, 6) as margin, concat_ws('; ', case when shared > 0 then shared || ' shared' end, case when n_heard = 0 then 'nothing measured' end,
case when n_heard > 0 and n_heard < n_tracks then n_heard || ' of ' || n_tracks end, case when n_heard > 0 and near then 'borderline' end, case when gap < 3 then 'narrow' end,
case when n_heard > 0 and dissenting * 3 > n_heard then dissenting || ' dissent' end) as reasons from z""")
def album_sureness(s, d):
    """How far each album's verdict can be trusted, and why."""
    tracks = _judged(s, d).select("vec_id", "label", "silent", F.col("encoding").alias("own"))
    albums = _albums(s, d)
    apart = tracks.join(albums.select("label", "encoding"), "label").groupBy("label").agg(
        F.count_if((F.col("own") != F.col("encoding")) & ~F.col("silent")).alias("dissenting"), F.count_if(F.col("vec_id") % 50 == 0).alias("shared")
    )
    x = spectra.sureness(*[F.col(c) for c in ("encoding", "fall", "top", "n_tracks", "n_heard", "shared", "dissenting")])
    return albums.join(apart, "label").withColumn("x", x).select("label", F.col("x.word").alias("sureness"), F.round("x.margin", 6).alias("margin"), F.col("x.reasons").alias("reasons"))


@query("""
with t as (select l_orderkey, l_linenumber, -l_quantity * 2 as peak, cast(l_partkey % 300 as integer) as clipped, (l_suppkey % 30) / 1000.0 as off, cast(8 * (1 + l_linenumber % 3) as integer) as effective, case when l_suppkey % 2 = 0 then 24 else 16 end as container from lineitem)
select l_orderkey, l_linenumber, concat_ws(', ', case when peak <= -95 then 'silent' end, case when peak + 2 >= -0.1 and clipped >= 100 then 'clipping' end, case when abs(off) > 0.01 then 'dc_offset' end,
case when container >= 24 and effective <= 16 then 'inflated_bit_depth' end) as findings from t""")
def health_findings(s, d):
    """What is wrong with each waveform."""
    quantity = -F.col("l_quantity") * 2
    peak = F.when(quantity <= spectra.SILENCE_DB, quantity).otherwise(quantity + 2)
    found = spectra.health(peak, F.col("l_partkey") % 300, (F.col("l_suppkey") % 30) / 1000.0, 8 * (1 + F.col("l_linenumber") % 3), F.when(F.col("l_suppkey") % 2 == 0, 24).otherwise(16))
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws(", ", found).alias("findings"))


@query("""
select event_id, case when value >= 50 then 'strong' when value >= 25 then 'fair' when value is not null and event_type = 'view' then 'mixable' when value is not null then 'weak' end as sureness from events""")
def key_sureness(s, d):
    """How far a key can be trusted."""
    return table(s, d, "events").select("event_id", spectra.key_sureness(F.col("value") / 500, F.col("event_type") == "view").alias("sureness"))


def _arms() -> Column:
    return F.when(F.col("l_returnflag") == "N", "honest").otherwise("laundered")


@query("""
select case when l_returnflag = 'N' then 'honest' else 'laundered' end as arm, count(*) filter (where l_discount >= 0.05) as convicted, count(*) filter (where l_tax > 0) as measured,
count(*) filter (where l_tax = 0) as errors from lineitem group by 1""")
def score_arms(s, d):
    """Convicted, measured and failed files of each arm of a paired benchmark."""
    return table(s, d, "lineitem").groupBy(_arms().alias("arm")).agg(
        F.count_if(F.col("l_discount") >= 0.05).alias("convicted"), F.count_if(F.col("l_tax") > 0).alias("measured"), F.count_if(F.col("l_tax") == 0).alias("errors")
    )
