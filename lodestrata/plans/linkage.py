"""Queries of record linkage, names and titles, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import evidence, matching, naming, text
from ..operators import relational, sequences
from ..session import table
from .registry import query

_SIGNALS_SQL = """
with s as (select l_orderkey as k, count(*) as n, count(*) filter (where l_linestatus = 'F') as titles_compared, count(*) filter (where l_linestatus = 'F' and l_returnflag = 'R') as titles_agreeing,
count(*) filter (where l_tax > 0.02) as lengths, count(*) filter (where l_tax > 0.02 and l_discount > 0.04) as lengths_agreeing from lineitem group by 1),
x as (select *, (k % 101) / 100.0 as txt, case when k % 4 > 0 then (k % 89) / 88.0 end as artist, case when k % 5 > 0 then (k % 53) / 52.0 end as album,
case when k % 3 = 1 then 1.0 when k % 3 = 2 then 0.8 end as yr, k % 2 = 0 as in_order, k % 7 = 0 as edition, k % 3 > 0 as count_agrees,
case when titles_compared > 0 then titles_agreeing / titles_compared end as title, case when lengths > 0 then lengths_agreeing / lengths end as duration from s),
m as (select *, title is not null as ht from x),
t as (select *, coalesce(album * 0.35::double, 0) + coalesce(artist * 0.25::double, 0) as two, case when album is null then 0::double else 0.35::double end + case when artist is null then 0::double else 0.25::double end as w2,
case when title is null then 0::double else 0.3::double * least(1.0, title + case when in_order then 0.1::double else 0 end) end as tsum, case when title is null then 0::double else 0.3::double end as tw,
coalesce(yr * 0.1::double, 0) as ysum, case when yr is null then 0::double else 0.1::double end as yw from m),
u as (select *, 0.85::double * coalesce(round_even((two + tsum + ysum) / nullif(w2 + tw + yw, 0), 15), txt) + case when count_agrees then 0.15::double else 0 end as full_base,
0.85::double * coalesce(round_even((two + ysum) / nullif(w2 + yw, 0), 15), txt) + case when count_agrees then 0.15::double else 0 end as bare_base, titles_compared > 0 and title < 0.25 as few from t),
r as (select *, case when few and coalesce(duration >= 0.5, false) then bare_base + (1 - bare_base) * duration when title is null and coalesce(duration > 0, false) then full_base + (1 - full_base) * duration
when title is null then least(0.55, full_base) when coalesce(duration > 0, false) then full_base + (1 - full_base) * 0.5 * duration else full_base end as reading from u),
c as (select *, few and (duration is null or duration < 0.5) as veto, case when few and (duration is null or duration < 0.5) then least(0.15, txt / 4) else greatest(0.0, least(1.0, reading - case when edition then 0.25 else 0 end)) end as conf from r)
"""


def _signals(s, d) -> tuple[DataFrame, dict]:
    f, measured = F.col("l_linestatus") == "F", F.col("l_tax") > 0.02
    rows = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.count("*").alias("n"), F.count_if(f).alias("titles_compared"), F.count_if(f & (F.col("l_returnflag") == "R")).alias("titles_agreeing"),
        F.count_if(measured).alias("lengths"), F.count_if(measured & (F.col("l_discount") > 0.04)).alias("lengths_agreeing"),
    )
    k = F.col("k")
    names = {
        "text": (k % 101) / 100.0, "artist": F.when(k % 4 > 0, (k % 89) / 88.0), "album": F.when(k % 5 > 0, (k % 53) / 52.0), "year": F.when(k % 3 == 1, 1.0).when(k % 3 == 2, 0.8),
        "in_order": k % 2 == 0, "edition": k % 7 == 0, "count_agrees": k % 3 > 0, "title": matching.share(F.col("titles_agreeing"), F.col("titles_compared")),
        "duration": matching.share(F.col("lengths_agreeing"), F.col("lengths")), "titles_agreeing": F.col("titles_agreeing"), "titles_compared": F.col("titles_compared"),
    }
    return rows, names


@query(_SIGNALS_SQL + "select k, cast(floor(round_even(conf, 4) * 1000 + 0.001) as bigint) as thousandths, veto, round_even(conf, 4) >= 0.9 as automatic from c")
def candidate_confidence(s, d):
    """The confidence of each candidate from its thirteen signals, and whether its titles refuse it."""
    rows, x = _signals(s, d)
    out = rows.select("k", matching.confidence(x).alias("c"), matching.vetoed(x["titles_agreeing"], x["titles_compared"], x["duration"]).alias("veto"))
    # Whole thousandths: of ties in the fourth place the two engines may round either way.
    return out.select("k", F.floor(F.col("c") * 1000 + 0.001).alias("thousandths"), "veto", (F.col("c") >= 0.9).alias("automatic"))


@query(_SIGNALS_SQL + """select k, concat_ws('; ', case when veto then 'the titles refuse it' end, case when titles_compared > 0 then titles_agreeing || ' of ' || titles_compared || ' titles' end,
case when in_order and titles_agreeing > 1 then 'in order' end, case when count_agrees then 'same number of tracks' end, case when edition then 'another edition' end) as explanation from c""")
def candidate_explanations(s, d):
    """What spoke for and against each candidate."""
    rows, x = _signals(s, d)
    return rows.select("k", matching.explained(x).alias("explanation"))


@query("""
with c as (select o_custkey, o_orderkey, (o_orderkey % 11) / 10.0 as conf, case when o_orderkey % 5 > 0 then cast(year(o_orderdate) as integer) end as pressed, 1996 as hint from orders),
r as (select *, cast(row_number() over (partition by o_custkey order by conf desc, coalesce(pressed = hint, false) desc, coalesce(pressed, 9999), o_orderkey) as integer) as place from c)
select o_custkey, o_orderkey, place from r where place <= 5""")
def candidate_order(s, d):
    """Candidates in their settled order: surest, the folder's year, the earliest pressing, the id."""
    c = table(s, d, "orders").select("o_custkey", "o_orderkey", ((F.col("o_orderkey") % 11) / 10.0).alias("conf"), F.when(F.col("o_orderkey") % 5 > 0, F.year("o_orderdate")).alias("pressed"))
    order = matching.ordering(F.col("conf"), F.lit(1996), F.col("pressed"), F.col("o_orderkey"))
    return relational.top_k(c, "o_custkey", 5, *order).select("o_custkey", "o_orderkey", F.col("rank_in_group").alias("place"))


@query("""
with m as (select doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '\\b(live|mono|stereo|deluxe|remaster|remix)', 1)) as w from documents)
select a.doc_id, case when len(list_distinct(list_concat(a.w, b.w))) > len(b.w) and len(list_distinct(list_concat(a.w, b.w))) > len(a.w) then 'each' when len(list_distinct(list_concat(a.w, b.w))) > len(b.w) then 'local'
when len(list_distinct(list_concat(a.w, b.w))) > len(a.w) then 'release' else '' end as side from m a join m b on b.doc_id = a.doc_id + 1""")
def edition_sides(s, d):
    """Which of two texts names an edition that the other doesn't."""
    m = table(s, d, "documents").select("doc_id", F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\b(live|mono|stereo|deluxe|remaster|remix)"), 1)).alias("w"))
    other = m.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    return m.join(other, "doc_id").select("doc_id", matching.edition_side(F.col("w"), F.col("v")).alias("side"))


@query("""
select id, case when released_on is null and original_released_on is null then null else case least(abs(1980 - try_cast(substr(original_released_on, 1, 4) as integer)), abs(1980 - try_cast(substr(released_on, 1, 4) as integer)))
when 0 then 1.0 when 1 then 0.8 else 0.0 end end::double as agreement from metadata_releases""")
def nearer_year(s, d):
    """Agreement of a year with the nearer of a pressing's and the original's."""
    r = table(s, d, "metadata_releases")
    years = [F.substring(c, 1, 4).try_cast("int") for c in ("original_released_on", "released_on")]
    return r.select("id", evidence.year_agreement(F.lit(1980), *years).alias("agreement"))


def _clean_sql(column: str) -> str:
    spaces, bracket = r"'[ \t\n\r\f]+', ' ', 'g'", r"'\s*\[[^\]]*\]\s*$', ''"
    year = r"'\s*[（(]\s*(?:(?:" + "|".join(naming.KINDS) + r")\s*[-–—]\s*)?(\d{4})\s*[)）]\s*$', '', 'i'"
    edition = r"'\([^()]*(?:" + naming.EDITIONS + r")[^()]*\)\s*$', '', 'i'"
    out = f"trim(regexp_replace({column}, {spaces}))"
    for _ in range(naming.PASSES):
        out = f"(select case when y <> '' then y else x end from (select x, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, {bracket}), {year}), {edition}), {spaces})) as y from (select {out} as x)))"
    return out


_LAST = "string_split(rtrim(folder_path, '/'), '/')[-1]"


@query(f"select id, {_clean_sql('title')} as cleaned from metadata_releases where title is not null")
def clean_titles(s, d):
    """Titles without the decoration no catalogue stores."""
    return table(s, d, "metadata_releases").where("title is not null").select("id", naming.clean_title(F.col("title")).alias("cleaned"))


@query(f"""
with c as (select id, {_LAST} as name, {_clean_sql(_LAST)} as t from album_units where folder_path is not null),
o as (select *, try_cast(nullif(regexp_extract(t, '^\\s*[（(]\\s*(19\\d\\d|20\\d\\d)\\s*[)）]\\s*(\\S.*)$', 1), '') as integer) as opening from c),
r as (select *, case when opening is not null then regexp_extract(t, '^\\s*[（(]\\s*(19\\d\\d|20\\d\\d)\\s*[)）]\\s*(\\S.*)$', 2) else t end as rest from o),
n as (select *, nullif(regexp_extract(rest, '^\\s*(\\d{{1,4}})\\s*[-–—]\\s*(\\S.* [-–—] .*)$', 1), '') as number from r),
x as (select *, case when number is not null then regexp_extract(rest, '^\\s*(\\d{{1,4}})\\s*[-–—]\\s*(\\S.* [-–—] .*)$', 2) else rest end as txt from n)
select id, case when regexp_matches(txt, ' [-–—] ') then trim(regexp_extract(txt, '^(.*?) [-–—] ', 1)) end as artist, case when regexp_matches(txt, ' [-–—] ') then trim(regexp_extract(txt, '^.*? [-–—] (.*)$', 1)) end as album,
coalesce(try_cast(nullif(regexp_extract(regexp_replace(regexp_replace(trim(regexp_replace(name, '[ \\t\\n\\r\\f]+', ' ', 'g')), '\\s*\\[[^\\]]*\\]\\s*$', ''), '\\([^()]*(?:{naming.EDITIONS})[^()]*\\)\\s*$', '', 'i'),
'\\s*[（(]\\s*(?:(?:{"|".join(naming.KINDS)})\\s*[-–—]\\s*)?(\\d{{4}})\\s*[)）]\\s*$', 1, 'i'), '') as integer), opening,
case when length(number) = 4 and try_cast(number as integer) between 1900 and 2099 then try_cast(number as integer) end) as year, txt as searched from x""")
def folder_hints(s, d):
    """Artist, album and year as a folder's name says them."""
    name = F.element_at(F.split(F.regexp_replace("folder_path", "/+$", ""), "/"), -1)
    hints = table(s, d, "album_units").where("folder_path is not null").select("id", naming.folder_hints(name).alias("h"))
    return hints.select("id", "h.artist", "h.album", "h.year", F.col("h.text").alias("searched"))


@query()
def query_ladder(s, d):
    """The queries worth trying for each release, from specific to loose."""
    r = table(s, d, "metadata_releases").where("title is not null")
    a, t = F.col("primary_artist"), F.col("title")
    ladder = naming.query_ladder(a, t, text.fold_accents(a), text.fold_accents(t))
    return r.select("id", F.posexplode(ladder).alias("rung", "q")).select("id", "rung", "q.artist", "q.album", "q.text")


_NAME = "string_split(filename, '\\')[-1]"


@query(f"""
with f as (select directory, try_cast(nullif(regexp_extract({_NAME}, '^\\s*(\\d{{1,3}})\\D', 1), '') as integer) as n from downloads where directory is not null and filename is not null)
select directory, count(*) >= 3 and count(n) >= 0.8 * count(*) and count(distinct n) = count(n) as numbered from f group by 1""")
def folders_with_an_index(s, d):
    """Folders whose names are numbered by their agreement."""
    rows = table(s, d, "downloads").where("directory is not null and filename is not null")
    number = F.nullif(F.regexp_extract(F.element_at(F.split("filename", r"\\"), -1), r"^\s*(\d{1,3})\D", 1), F.lit("")).try_cast("int")
    return rows.select("directory", number.alias("n")).groupBy("directory").agg(naming.carries_an_index(F.col("n")).alias("numbered"))


@query(f"""
with f as (select directory, nullif(trim({_NAME}), '') as t from downloads where directory is not null)
select directory, count(t) < 2 or count(t) <> count(*) or count(distinct lower(t)) > 1 as distinguish from f group by 1""")
def titles_that_distinguish(s, d):
    """Whether the titles in a folder tell its files apart."""
    rows = table(s, d, "downloads").where("directory is not null").select("directory", F.element_at(F.split("filename", r"\\"), -1).alias("t"))
    return rows.groupBy("directory").agg(naming.distinguish(F.col("t")).alias("distinguish"))


@query(f"""
with f as (select row_id, {_NAME} as n from downloads where filename is not null), g as (select row_id, regexp_replace(n, '\\.[^.]*$', '') as stem from f),
h as (select *, regexp_replace(regexp_replace(stem, '^\\s*(?:\\d{{1,2}}\\s*-\\s*)?\\d{{1,3}}\\s*[.\\-–]\\s*', ''), '^\\s*\\d{{1,3}}\\s+(\\S)', '\\1') as bare from g)
select row_id, coalesce(nullif(trim(regexp_replace(bare, '[ \\t\\n\\r\\f]+', ' ', 'g')), ''), stem) as hint from h""")
def track_hints(s, d):
    """Titles of tracks as their files' names say them."""
    name = F.element_at(F.split("filename", r"\\"), -1)
    return table(s, d, "downloads").where("filename is not null").select("row_id", naming.track_hint(name, F.lit(True)).alias("hint"))


@query("""
select id, array_to_string(list_filter(string_split_regex(artist, '\\s*[,&]\\s*'), lambda x: x <> ''), '|') as names from physical_records where artist is not null""")
def split_credits(s, d):
    """The names a credit holds."""
    return table(s, d, "physical_records").where("artist is not null").select("id", F.array_join(naming.split_credit(F.col("artist")), "|").alias("names"))


@query("""
with x as (select id, unnest(string_split_regex(categories, '[;,]')) as v, generate_subscripts(string_split_regex(categories, '[;,]'), 1) as p from physical_records where categories is not null),
k as (select id, p, trim(v) as v, regexp_replace(lower(trim(v)), '[^\\pL]', '', 'g') as k from x), f as (select id, k, min(p) as p, arg_min(v, p) as v from k where k <> '' group by 1, 2)
select id, string_agg(case k when 'hiphop' then 'Hip Hop' when 'bossanova' then 'Bossa Nova' when 'rb' then 'R&B' else array_to_string(list_transform(string_split(lower(v), ' '), lambda w: upper(w[1]) || w[2:]), ' ') end, ', ' order by p) as genres from f group by 1""")
def spelled_genres(s, d):
    """Categories in one spelling each, in order and without repeats."""
    listed = naming.spell_genres(F.split("categories", "[;,]"), {"hiphop": "Hip Hop", "bossanova": "Bossa Nova", "rb": "R&B"})
    return table(s, d, "physical_records").where("categories is not null").select("id", F.array_join(listed, ", ").alias("genres")).where("genres <> ''")


@query("""
with a as (select snapshot_id, unnest([0, 1, 2]) i from downloads_all) select snapshot_id, i as place, case i when 0 then 'Ana Lima' when 1 then 'Ana Lima, Rui Reis' else 'Ana Lima Feat. Rui Reis & Bo' end as credit from a""")
def written_credits(s, d):
    """Artists joined as their source joins them."""
    def person(name: str, by: str | None):
        return F.struct(F.lit(name).alias("name"), F.lit(by).cast("string").alias("joined_by"))

    cases = F.array(
        F.array(person("Ana Lima", None)), F.array(person(" Ana Lima ", ", "), person("", "x"), person("Rui Reis", None)),
        F.array(person("Ana Lima", "Feat."), person("Rui Reis", None), person("Bo", None)),
    )
    rows = table(s, d, "downloads_all").select("snapshot_id", F.posexplode(cases).alias("place", "a"))
    return rows.select("snapshot_id", "place", naming.written_credit(F.col("a")).alias("credit"))


@query("""
select id, case when regexp_matches(lower(title), '(^|[\\s(\\[{])ep[)\\]}]?\\s*$') then 'EP' when regexp_matches(lower(title), '(^|[\\s(\\[{])single[)\\]}]?\\s*$') then 'Single'
when regexp_matches(lower(title), '(^|[\\s(\\[{])maxi-single[)\\]}]?\\s*$') then 'Maxi-Single' when regexp_matches(lower(title), '(^|[\\s(\\[{])remix[)\\]}]?\\s*$') then 'Remix'
when regexp_matches(lower(title), '(^|[\\s(\\[{])remixes[)\\]}]?\\s*$') then 'Remixes' when regexp_matches(lower(title), '(^|[\\s(\\[{])compilation[)\\]}]?\\s*$') then 'Compilation'
when regexp_matches(lower(title), '(^|[\\s(\\[{])live[)\\]}]?\\s*$') then 'Live' when regexp_matches(lower(title), '(^|[\\s(\\[{])mixtape[)\\]}]?\\s*$') then 'Mixtape' end as kind from metadata_releases""")
def release_kinds(s, d):
    """The kind of release a title closes with."""
    return table(s, d, "metadata_releases").select("id", naming.kind_of(F.col("title")).alias("kind"))


@query("""
select row_id, array_to_string(list_filter(string_split(directory, '\\'), lambda p: p <> '' and not starts_with(p, '@@')), '/') as folder from downloads where directory is not null""")
def share_folders(s, d):
    """Remote folders without their share."""
    return table(s, d, "downloads").where("directory is not null").select("row_id", naming.folder_of_share(F.col("directory")).alias("folder"))


@query("""
select l_orderkey, l_linenumber, regexp_replace(printf('%.1f', l_partkey * 100 / 1000), '\\.0$', '') as khz, (l_suppkey * 1234 // 60000) || ':' || lpad(cast(l_suppkey * 1234 // 1000 % 60 as varchar), 2, '0') as length from lineitem""")
def displayed_numbers(s, d):
    """Rates and lengths as they are shown."""
    rows = table(s, d, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", naming.khz(F.col("l_partkey") * 100).alias("khz"), naming.length_of(F.col("l_suppkey") * 1234).alias("length"))


@query("select id, try_cast(nullif(regexp_extract(folder_path, '(?:^|\\D)((?:19|20)\\d\\d)(?:\\D|$)', 1), '') as integer) as year from album_units")
def years_in_names(s, d):
    return table(s, d, "album_units").select("id", naming.year_in(F.col("folder_path")).alias("year"))


@query()
def titles_in_agreement(s, d):
    """How many track titles of another edition agree with the first edition's, and whether in order."""
    from .catalogue import _editions

    x = matching.titles_agree(F.col("tracks.title"), F.col("first_tracks.title"))
    return _editions(s, d).select("id", "first_id", x.alias("x")).select("id", "first_id", "x.agreeing", "x.in_order")


@query()
def spelling_variants(s, d):
    """What differs between a record's artist and the catalogue's, and the spelling to be kept."""
    r = table(s, d, "physical_records").where("release_row_id is not null").select("id", "album", F.col("release_row_id").alias("r"))
    joined = r.join(table(s, d, "metadata_releases").select(F.col("id").alias("r"), "title"), "r")
    return joined.select("id", naming.apart("album", "title").alias("apart"), naming.resolved("album", "title").alias("kept"))


@query("""
with t as (select o_orderkey, case o_orderkey % 4 when 0 then (o_orderkey % 90) || ':' || lpad(cast(o_orderkey % 60 as varchar), 2, '0') when 1 then cast(o_orderkey * 10 as varchar)
when 2 then '1:' || lpad(cast(o_orderkey % 60 as varchar), 2, '0') || ':07' else o_orderkey || '/x' end as written from orders)
select o_orderkey, cast(case when regexp_matches(written, '^[0-9]+$') then try_cast(written as bigint) when regexp_matches(written, '^[0-9]{1,3}:[0-9]{2}$') then 1000 * (60 * cast(split_part(written, ':', 1) as bigint) + cast(split_part(written, ':', 2) as bigint))
when regexp_matches(written, '^[0-9]{1,3}:[0-9]{2}:[0-9]{2}$') then 1000 * (3600 * cast(split_part(written, ':', 1) as bigint) + 60 * cast(split_part(written, ':', 2) as bigint) + cast(split_part(written, ':', 3) as bigint)) end as bigint) as ms,
try_cast(nullif(regexp_extract(written, '^\\s*([0-9]{1,9})', 1), '') as integer) as number from t""")
def written_numbers(s, d):
    """Lengths and numbers as people write them."""
    k = F.col("o_orderkey")
    two = F.lpad((k % 60).cast("string"), 2, "0")
    written = F.when(k % 4 == 0, F.concat((k % 90).cast("string"), F.lit(":"), two)).when(k % 4 == 1, (k * 10).cast("string")).when(k % 4 == 2, F.concat(F.lit("1:"), two, F.lit(":07"))).otherwise(F.concat(k.cast("string"), F.lit("/x")))
    return table(s, d, "orders").select("o_orderkey", written.alias("w")).select("o_orderkey", text.duration_ms(F.col("w")).alias("ms"), text.number_of(F.col("w")).alias("number"))


@query("""
with x as (select l_orderkey, l_linenumber || case when l_suppkey % 3 = 0 then 'a' when l_suppkey % 3 = 1 then '.2' else '' end as idx, case when l_tax > 0 then l_quantity end as q from lineitem)
select l_orderkey, regexp_extract(idx, '^\\s*([A-Za-z]?\\d+?)(?:[a-z]|\\.\\d+)?\\s*$', 1) as base, count(*) as parts, case when count(q) = count(*) then sum(q) end as q from x group by 1, 2""")
def merged_parts(s, d):
    """Parts of one member as one; their sum only where every part has an amount."""
    suffix = F.when(F.col("l_suppkey") % 3 == 0, "a").when(F.col("l_suppkey") % 3 == 1, ".2").otherwise("")
    rows = table(s, d, "lineitem").select("l_orderkey", F.concat(F.col("l_linenumber").cast("string"), suffix).alias("idx"), F.when(F.col("l_tax") > 0, F.col("l_quantity")).alias("q"))
    return sequences.merge_parts(rows, "l_orderkey", "idx", "q")


@query()
def bands_and_edges(s, d):
    """Where each signal stops and how full its top band is; here of arrays repeated to a signal."""
    from ..functions import signals

    samples = F.flatten(F.array_repeat(F.col("embedding").cast("array<double>"), 512))
    measured = table(s, d, "embeddings").select("vec_id", signals.measure_edge(samples, 44100).alias("e"), signals.measure_top_band(samples, 44100).alias("top_db"))
    return measured.select("vec_id", "e.hertz", "e.share", "top_db")
