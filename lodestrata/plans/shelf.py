"""Queries of what a shelf shows: buckets, filters, searches, orders, plans of operations, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import compatibility, relational
from ..session import table
from .registry import query

_BUCKET_SQL = """case when folder_path is null then 'review' when state = 'rejected' then 'rejected' when state = 'organized' then 'organized' when track_count is null then 'unlooked'
when state = 'unidentified' then 'nomatch' when rating >= 4 and cleared_at is null then 'automatic' else 'review' end"""


def _bucket():
    return (
        F.when(F.col("folder_path").isNull(), "review").when(F.col("state") == "rejected", "rejected").when(F.col("state") == "organized", "organized").when(F.col("track_count").isNull(), "unlooked")
        .when(F.col("state") == "unidentified", "nomatch").when((F.col("rating") >= 4) & F.col("cleared_at").isNull(), "automatic").otherwise("review")
    )


@query(f"select id, {_BUCKET_SQL} as bucket, coalesce(rating, 0) >= 3 as three_or_better, coalesce(rating, 0) = 0 as unrated from album_units")
def shelf_filters(s, d):
    """The bucket of each album and whether the filters of ratings let it through."""
    rating = F.coalesce("rating", F.lit(0))
    return table(s, d, "album_units").select("id", _bucket().alias("bucket"), (rating >= 3).alias("three_or_better"), (rating == 0).alias("unrated"))


@query(f"select {_BUCKET_SQL} as bucket, count(*) as n from album_units group by 1")
def bucket_counts(s, d):
    return table(s, d, "album_units").groupBy(_bucket().alias("bucket")).agg(F.count("*").alias("n"))


@query("select id from album_units where contains(lower(strip_accents(concat_ws(' ', folder_path, origin, state))), 'coracao') and contains(lower(strip_accents(concat_ws(' ', folder_path, origin, state))), 'flac')")
def shelf_search(s, d):
    """Every word in any of several fields, accents and case aside."""
    units = table(s, d, "album_units").withColumn("hay", text.fold_accents(F.concat_ws(" ", "folder_path", "origin", "state")))
    return units.where(text.words_all_in(F.col("hay"), text.folded_query("Coração FLAC"))).select("id")


@query("""
select row_id from downloads where contains(lower(strip_accents(concat_ws(' ', username, directory, state))), 'garden')""")
def history_search(s, d):
    """The same over the history."""
    rows = table(s, d, "downloads").withColumn("hay", text.fold_accents(F.concat_ws(" ", "username", "directory", "state")))
    return rows.where(text.words_all_in(F.col("hay"), "garden")).select("row_id")


def _places(df, *order):
    return relational.running(df.withColumn("all", F.lit(1)), "all", list(order), F.lit(0), "total", "place").select("id", "place")


@query("select id, row_number() over (order by case when rating > 0 then 0 else 1 end, rating, id desc) as place from album_units")
def worst_rated_order(s, d):
    """The shelf from worst to best, the unrated still last."""
    units = table(s, d, "album_units").select("id", "rating")
    return _places(units, F.when(F.col("rating") > 0, 0).otherwise(1), F.col("rating").asc_nulls_last(), F.col("id").desc())


@query("select id, row_number() over (order by lower(coalesce(primary_artist, '')), id desc) as place from metadata_releases")
def artist_order(s, d):
    return _places(table(s, d, "metadata_releases").select("id", F.lower(F.coalesce("primary_artist", F.lit(""))).alias("a")), F.col("a"), F.col("id").desc())


@query("select id, row_number() over (order by lower(coalesce(title, '')), id desc) as place from metadata_releases")
def album_order(s, d):
    return _places(table(s, d, "metadata_releases").select("id", F.lower(F.coalesce("title", F.lit(""))).alias("a")), F.col("a"), F.col("id").desc())


@query("select id, row_number() over (order by try_cast(substr(released_on, 1, 4) as integer) desc nulls last, id desc) as place from metadata_releases")
def year_order(s, d):
    """By year, the undated last."""
    return _places(table(s, d, "metadata_releases").select("id", F.substring("released_on", 1, 4).try_cast("int").alias("y")), F.col("y").desc_nulls_last(), F.col("id").desc())


@query("select id, row_number() over (order by case id % 97 when 5 then 0 when 3 then 1 else 2 end, case when id % 97 in (3, 5) then -id else 0 end, id desc) as place from album_units")
def pinned_order(s, d):
    """The newest first, pinned ones before them in the order of their pins."""
    units = table(s, d, "album_units").select("id").withColumn("pin", F.coalesce(F.nullif(F.array_position(F.array(F.lit(5), F.lit(3)), (F.col("id") % 97).cast("int")), F.lit(0)), F.lit(9)))
    return _places(units, F.col("pin"), F.col("id").desc())


@query("""
select l_orderkey, l_linenumber, cast(row_number() over (partition by l_orderkey order by case l_returnflag when 'R' then 0 when 'A' then 1 else 2 end, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as integer) as place from lineitem""")
def reading_order(s, d):
    """Operations of a plan in the order in which they are read."""
    from pyspark.sql import Window

    kind = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    w = Window.partitionBy("l_orderkey").orderBy(kind, "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).alias("place"))


@query("""
with v as (select vec_id, label + 1 as n, case when vec_id % 2 = 0 then 'A' else 'B' end as r, 60 + (vec_id * 37) % 120 as bpm from embeddings)
select vec_id, row_number() over (order by n, r, bpm, vec_id) as place from v where n || r in ('8A', '8B', '9A', '3B')""")
def wheel_order(s, d):
    """Tracks of some keys in the order of the wheel, then by tempo."""
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") + 1).alias("n"), F.when(F.col("vec_id") % 2 == 0, "A").otherwise("B").alias("r"), (60 + (F.col("vec_id") * 37) % 120).alias("bpm"))
    v = v.where(F.concat(F.col("n").cast("string"), "r").isin("8A", "8B", "9A", "3B"))
    return _places(v, F.col("n"), F.col("r"), F.col("bpm"), F.col("id")).withColumnRenamed("id", "vec_id")


@query("""
with v as (select vec_id, label + 1 as n, case when vec_id % 2 = 0 then 'A' else 'B' end as r from embeddings)
select a.vec_id as source, b.vec_id as target, case when a.n = b.n and a.r = b.r then 'same' when a.n = b.n then 'relative' when a.r = b.r and b.n = a.n % 12 + 1 then 'up' when a.r = b.r and a.n = b.n % 12 + 1 then 'down' end as relation
from v a join v b on b.vec_id = a.vec_id + 1""")
def key_relations(s, d):
    """How two keys stand to each other on the wheel; null where they don't mix."""
    v = table(s, d, "embeddings").select("vec_id", (F.col("label") + 1).alias("n"), F.when(F.col("vec_id") % 2 == 0, "A").otherwise("B").alias("r"))
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("n").alias("m"), F.col("r").alias("q"))
    relation = compatibility.key_relation(F.col("n"), F.col("r"), F.col("m"), F.col("q"))
    return v.join(other, "vec_id").select(F.col("vec_id").alias("source"), (F.col("vec_id") + 1).alias("target"), relation.alias("relation"))


@query("""
with g as (select primary_artist, title, count(*) n, min(id) first from metadata_releases where title is not null and primary_artist is not null group by 1, 2)
select m.id, cast(g.n as bigint) as pressings, g.first as under from metadata_releases m join g on g.title = m.title and g.primary_artist = m.primary_artist""")
def pressings_under_albums(s, d):
    """Each pressing under its album, with the album's size and first place."""
    r = table(s, d, "metadata_releases").where("title is not null and primary_artist is not null").select("id", "title", "primary_artist")
    return r.join(r.groupBy("title", "primary_artist").agg(F.count("*").alias("pressings"), F.min("id").alias("under")), ["title", "primary_artist"]).select("id", "pressings", "under")


@query("""
with t as (select l_orderkey, l_linenumber, lower(p_name) as target from lineitem join part on p_partkey = l_partkey % 50), c as (select l_orderkey, target, count(*) n from t group by 1, 2)
select t.l_orderkey, count(*) filter (where n > 1) as collisions, count(*) as operations, bool_or(n > 1) as blocked from t join c on c.l_orderkey = t.l_orderkey and c.target = t.target group by 1""")
def plan_operations(s, d):
    """Operations of each plan, those whose targets collide (case aside), and whether that blocks it."""
    names = table(s, d, "part").select((F.col("p_partkey")).alias("p"), F.lower("p_name").alias("target"))
    ops = table(s, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 50).alias("p")).join(names, "p")
    counts = ops.groupBy("l_orderkey", "target").agg(F.count("*").alias("n"))
    return counts.groupBy("l_orderkey").agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("collisions"), F.sum("n").alias("operations"), (F.max("n") > 1).alias("blocked"))


@query("""
with m as (select id, folder_path as p from album_units where folder_path is not null), a as (select id, p, case when starts_with(p, '/music/') then '/new/' || substr(p, 8) else p end as b from m)
select id, case when starts_with(b, '/new/_incoming/') then null when starts_with(b, '/srv/library/') then '/old/' || substr(b, 14) else b end as planned from a""")
def undone_paths(s, d):
    """Where a path stood before recorded moves, the newest undone first; null where it had been moved away."""
    moves = F.array(*[F.struct(F.lit(a).alias("was"), F.lit(b).cast("string").alias("now")) for a, b in (("/srv/library/", "/old/"), ("/new/_incoming/", None), ("/music/", "/new/"))])
    step = lambda p, m: F.when(F.startswith(p, m["was"]), F.concat(m["now"], F.substr(p, F.length(m["was"]) + 1))).otherwise(p)
    undone = F.aggregate(F.reverse(moves), F.col("folder_path"), step)
    return table(s, d, "album_units").where("folder_path is not null").select("id", undone.alias("planned"))


@query("""
select l_orderkey, l_linenumber, l_partkey * l_suppkey > l_quantity * 10000 as worth_writing, l_partkey >= 640 and l_suppkey * 10 >= 640 as worth_keeping from lineitem""")
def pictures_worth_writing(s, d):
    """Whether a picture has more pixels than the one in place, and whether it is large enough to be kept."""
    rows = table(s, d, "lineitem")
    more, large = F.col("l_partkey") * F.col("l_suppkey") > F.col("l_quantity") * 10000, (F.col("l_partkey") >= 640) & (F.col("l_suppkey") * 10 >= 640)
    return rows.select("l_orderkey", "l_linenumber", more.alias("worth_writing"), large.alias("worth_keeping"))


@query("""
select a.id, (a.title is distinct from b.title) or (a.primary_artist is distinct from b.primary_artist) as differ from metadata_releases a join metadata_releases b on b.id = a.id + 1""")
def tags_differ(s, d):
    """Whether what is to be written differs from what is there, null for null."""
    r = table(s, d, "metadata_releases").select("id", F.struct("title", "primary_artist").alias("t"))
    return r.join(r.select((F.col("id") - 1).alias("id"), F.col("t").alias("u")), "id").select("id", (~F.col("t.title").eqNullSafe(F.col("u.title")) | ~F.col("t.primary_artist").eqNullSafe(F.col("u.primary_artist"))).alias("differ"))


@query("""
select id, concat_ws(', ', 'album=' || title, 'artist=' || primary_artist, 'date=' || released_on, 'tracks=' || track_count) as tags from metadata_releases""")
def desired_tags(s, d):
    """What is to be written of each release: the fields it has."""
    fields = F.create_map(F.lit("album"), F.col("title"), F.lit("artist"), F.col("primary_artist"), F.lit("date"), F.col("released_on"), F.lit("tracks"), F.col("track_count").cast("string"))
    present = F.map_filter(fields, lambda k, v: v.isNotNull())
    return table(s, d, "metadata_releases").select("id", F.array_join(F.transform(F.map_entries(present), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ").alias("tags"))


@query("""
with a as (select l_orderkey, count(distinct l_suppkey) n, bool_and(l_suppkey % 10 <> l_orderkey % 10) as others from lineitem group by 1) select l_orderkey, n > 1 and others as various from a""")
def various_artists(s, d):
    """Whether every member is somebody else's and they aren't one's."""
    other = F.col("l_suppkey") % 10 != F.col("l_orderkey") % 10
    return table(s, d, "lineitem").groupBy("l_orderkey").agg(((F.countDistinct("l_suppkey") > 1) & F.bool_and(other)).alias("various"))


@query("""
with f as (select r_name as tag, 0 as part, r_regionkey as p from region where r_regionkey < 3), o as (select distinct n_name as tag from nation)
select tag, row_number() over (order by part, p, lower(tag)) as place from (select tag, part, p from f union all select tag, 1, 0 from o where tag not in (select tag from f))""")
def tag_catalogue(s, d):
    """Favourites in their order, then the rest by name."""
    first = table(s, d, "region").where("r_regionkey < 3").select(F.col("r_name").alias("id"), F.lit(0).alias("part"), F.col("r_regionkey").alias("p"))
    rest = table(s, d, "nation").select(F.col("n_name").alias("id")).distinct().join(first.select("id"), "id", "left_anti").select("id", F.lit(1).alias("part"), F.lit(0).alias("p"))
    return _places(first.unionByName(rest), F.col("part"), F.col("p"), F.lower("id")).withColumnRenamed("id", "tag")


@query("select doc_id from documents where lang = 'en' except select doc_id from documents where source in (select source from mix_targets)")
def set_difference(s, d):
    docs = table(s, d, "documents")
    listed = docs.join(table(s, d, "mix_targets").select("source"), "source", "left_semi").select("doc_id")
    return docs.where("lang = 'en'").select("doc_id").exceptAll(listed).distinct()


@query("""
select row_number() over (order by r_regionkey % 2, case when r_regionkey % 3 > 0 then r_regionkey % 3 else 0 end, r_regionkey) as place, r_regionkey as v from region""")
def rank_order(s, d):
    """Rows by arrays of ranks of different lengths, what is missing standing for zero."""
    r = table(s, d, "region").select(F.col("r_regionkey").cast("bigint").alias("id"), F.when(F.col("r_regionkey") % 3 > 0, F.array(F.col("r_regionkey") % 2, F.col("r_regionkey") % 3)).otherwise(F.array(F.col("r_regionkey") % 2)).alias("ranks"))
    padded = r.withColumn("padded", F.concat("ranks", F.array_repeat(F.lit(0), 3 - F.size("ranks"))))
    return _places(padded, F.col("padded"), F.col("id")).select("place", F.col("id").cast("int").alias("v"))
