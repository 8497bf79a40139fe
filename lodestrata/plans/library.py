"""Queries of writes, lookups and aggregates of a catalogue, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import relational, store
from ..session import table
from .registry import query


@query("""
with old as (select id, folder_path, unit_signature from album_units where id % 2 = 0),
new as (select id as new_id, case when id % 3 = 0 then folder_path || '/moved' else folder_path end as folder_path, unit_signature from album_units where folder_path is not null),
here as (select folder_path, min(id) k from old group by 1),
gone as (select unit_signature, min(id) k from old where unit_signature is not null and not exists (select 1 from new where new.folder_path = old.folder_path) group by 1)
select new_id, coalesce(h.k, g.k) as kept_key, case when h.k is not null then 'path' when g.k is not null then 'adopted' else 'new' end as how
from new left join here h using (folder_path) left join gone g using (unit_signature)""")
def adopted_rows(s, d):
    """Rows of a new walk with the key they keep: by path, by signature where the old path is gone, or none."""
    units = table(s, d, "album_units").select("id", "folder_path", "unit_signature")
    moved = F.when(F.col("id") % 3 == 0, F.concat("folder_path", F.lit("/moved"))).otherwise(F.col("folder_path"))
    new = units.where("folder_path is not null").select(F.col("id").alias("new_id"), moved.alias("folder_path"), "unit_signature")
    return store.adopt(units.where("id % 2 = 0"), new, "id", "folder_path", "unit_signature").select("new_id", "kept_key", "how")


@query("select event_id, event_type = 'view' and event_id < max(event_id) over (partition by user_id) as superseded from events")
def superseded_proposals(s, d):
    """Proposals that a later row of the same key has replaced."""
    return store.supersede(table(s, d, "events"), "user_id", "event_id", F.col("event_type") == "view").select("event_id", "superseded")


@query("""
with old as (select l_orderkey, l_linenumber, l_partkey as print, l_quantity as sig from lineitem), new as (select l_orderkey, l_linenumber, case when l_linenumber % 2 = 0 then l_partkey + 1 end as print,
case when l_suppkey % 2 = 0 then l_quantity else -1 end as sig from lineitem where l_orderkey % 2 = 0 and l_linenumber > 1),
merged as (select n.l_orderkey, n.l_linenumber, coalesce(n.print, case when o.sig is not distinct from n.sig then o.print end) as print, n.sig from new n left join
(select l_orderkey, l_linenumber, max(print) print, max(sig) sig from old group by 1, 2 having count(*) = 1) o on o.l_orderkey = n.l_orderkey and o.l_linenumber = n.l_linenumber)
select l_orderkey, cast(sum(print) as bigint) as prints, sum(sig) as sigs, count(*) as n from (select * from merged where l_orderkey in (select l_orderkey from old group by l_orderkey having count(*) = count(distinct l_linenumber))
union all select * from old where l_orderkey not in (select l_orderkey from new) and l_orderkey in (select l_orderkey from old group by l_orderkey having count(*) = count(distinct l_linenumber))) group by 1""")
def replaced_children(s, d):
    """A parent's children replaced as a whole; a remembered value survives where the child is unchanged."""
    lines = table(s, d, "lineitem")
    single = lines.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.countDistinct("l_linenumber").alias("k")).where("n = k").select("l_orderkey")
    lines = lines.join(single, "l_orderkey", "left_semi")
    old = lines.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("print"), F.col("l_quantity").alias("sig"))
    new = lines.where("l_orderkey % 2 = 0 and l_linenumber > 1").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey") + 1).alias("print"), F.when(F.col("l_suppkey") % 2 == 0, F.col("l_quantity")).otherwise(-1.0).alias("sig")
    )
    merged = store.replace_children(old, new, "l_orderkey", "l_linenumber", ["print"], "sig")
    return merged.groupBy("l_orderkey").agg(F.sum("print").alias("prints"), F.sum("sig").alias("sigs"), F.count("*").alias("n"))


@query("""
with old as (select event_id, user_id, case when event_id % 3 > 0 then event_type end as k, cast(floor(value) as bigint) % 5 as p from events where event_id % 2 = 0 and value is not null),
new as (select event_id, user_id, event_type as k, cast(floor(value) as bigint) % 5 as p from events where event_id % 2 = 1 and value is not null),
given as (select user_id, p, max(k) g from new where k is not null group by 1, 2),
everything as (select event_id, user_id, coalesce(k, g) as k, p from old left join given using (user_id, p) union all select event_id, user_id, k, p from new)
select user_id, k as claimed_key, max(event_id) as event_id, arg_max(p, event_id) as print from everything group by 1, 2""")
def claimed_prints(s, d):
    """Rows without a key claimed by the key that has their print, then the newest per key."""
    rows = table(s, d, "events").where("value is not null").select("event_id", "user_id", F.col("event_type").alias("k"), (F.floor("value") % 5).alias("p"))
    old = rows.where("event_id % 2 = 0").withColumn("k", F.when(F.col("event_id") % 3 > 0, F.col("k")))
    out = store.claim(old, rows.where("event_id % 2 = 1"), "user_id", "k", "p", "event_id")
    return out.select("user_id", F.col("k").alias("claimed_key"), "event_id", F.col("p").alias("print"))


@query("""
with c as (select source, case when lang = 'en' then null else lang end as lang, cast(max(n_chars) as bigint) as n from documents group by 1, 2)
select d.doc_id, coalesce(c.n, d.n_chars) as n_chars from documents d left join c on c.source is not distinct from d.source and c.lang is not distinct from d.lang""")
def null_safe_update(s, d):
    """A keyed update in which null keys meet null keys."""
    docs = table(s, d, "documents").select("doc_id", "source", "lang", "n_chars")
    changes = docs.groupBy("source", F.when(F.coalesce("lang", F.lit("en")) != "en", F.col("lang")).alias("lang")).agg(F.max("n_chars").alias("n_chars"))
    return store.update_null_safe(docs, changes, ["source", "lang"], "n_chars").select("doc_id", "n_chars")


@query("""
select album_unit_id, field, track_position, id, value from (select *, row_number() over (partition by album_unit_id, field, track_position order by created_at desc, id desc) k from manual_corrections)
where k = 1 and value is not null""")
def standing_corrections(s, d):
    """The newest correction of each field and place (null to null), cleared ones left out."""
    rows = table(s, d, "manual_corrections")
    keys = ["album_unit_id", "field", "track_position"]
    return store.compact_with_tombstones(rows, keys, F.col("value").isNull(), "created_at", "id").select(*keys, "id", "value")


@query("""
with held as (select user_id, case when event_type = 'view' then null else event_type end as k, max(event_id) v from events group by 1, 2),
asked as (select event_id, user_id, case when event_id % 4 = 0 then null else event_type end as k from events)
select event_id, coalesce(e.v, l.v) as answer from asked a left join held e on e.user_id = a.user_id and e.k = a.k left join held l on l.user_id = a.user_id and l.k is null""")
def acoustic_answers(s, d):
    """The answer to exactly this key, else the legacy one without a key."""
    events = table(s, d, "events")
    held = events.select("user_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("k"), F.col("event_id").alias("answer"))
    asked = events.select("event_id", "user_id", F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("k"))
    return store.exact_or_legacy(asked, held, "user_id", "k", "answer").select("event_id", "answer")


@query("""
select id as value, 'key' as proof, count(distinct directory) as places from downloads where id is not null group by 1 having count(distinct directory) > 1
union all select cast(size as varchar), 'print', count(distinct directory) from downloads where size is not null group by 1 having count(distinct directory) > 1 and count(distinct id) > 1""")
def duplicate_proofs(s, d):
    """What stands in several places, by its key and by its print."""
    return store.duplicates_by_two_proofs(table(s, d, "downloads"), "directory", "id", "size")


@query("""
with a as (select l_suppkey, l_returnflag, count(*) n from lineitem where l_linenumber = 1 group by 1, 2), b as (select l_suppkey, l_returnflag, count(*) n from lineitem where l_linenumber = 2 group by 1, 2)
select l_suppkey, bool_and(coalesce(a.n, 0) = coalesce(b.n, 0)) as same from a full join b using (l_suppkey, l_returnflag) group by 1""")
def same_contents(s, d):
    """Whether two sightings hold the same things equally often."""
    lines = table(s, d, "lineitem").select("l_suppkey", "l_linenumber", "l_returnflag")
    return store.same_multiset(lines.where("l_linenumber = 1"), lines.where("l_linenumber = 2"), "l_suppkey", ["l_returnflag"])


@query("""
with w as (select doc_id, author, n_chars, coalesce(lang = 'en', false) as keep, sum(n_chars) over (partition by author) whole,
coalesce(sum(case when lang = 'en' then 0 else n_chars end) over (partition by author order by doc_id rows between unbounded preceding and 1 preceding), 0) older from documents where author is not null)
select doc_id, not keep and whole - older > 5000 as evicted from w""")
def evicted_copies(s, d):
    """Oldest first until the rest fits; what is to be kept never goes but counts."""
    docs = table(s, d, "documents").where("author is not null").select("doc_id", "author", "n_chars", "lang")
    return store.evict_oldest(docs, "author", "n_chars", 5000, F.col("lang") == "en", F.col("doc_id")).select("doc_id", "evicted")


@query("""
with held as (select c_mktsegment as name, min(c_custkey) + 1 as key from customer where c_nationkey < 3 group by 1), names as (select distinct label as name from physical_records where label is not null)
select name, cast((select max(key) from held) + row_number() over (order by name) as bigint) as key from names where name not in (select name from held)""")
def new_lookup_names(s, d):
    """Names an import brings that the lookup lacks, with new keys."""
    held = table(s, d, "customer").where("c_nationkey < 3").groupBy(F.col("c_mktsegment").alias("name")).agg((F.min("c_custkey") + 1).alias("key"))
    return store.number_missing(table(s, d, "physical_records").select(F.col("label").alias("name")), held, "name", "key")


@query("""
with o as (select c_nationkey, case when c_custkey % 5 > 0 then c_custkey end as member, c_mktsegment from customer where c_custkey % 2 = 0), whole as (select c_nationkey, max(c_mktsegment) word from o where member is null group by 1)
select c_nationkey, member, c_mktsegment as word from o where member is not null
union all select c.c_nationkey, c.c_custkey, word from customer c join whole using (c_nationkey) where not exists (select 1 from o where o.c_nationkey = c.c_nationkey and o.member = c.c_custkey)""")
def expanded_overrides(s, d):
    """What is said of a whole group, said of each member that doesn't speak for itself."""
    people = table(s, d, "customer").select("c_nationkey", F.col("c_custkey").alias("member"), F.col("c_mktsegment").alias("word"))
    said = people.where("member % 2 = 0").withColumn("member", F.when(F.col("member") % 5 > 0, F.col("member")))
    return store.expand_overrides(said, people, "c_nationkey", "member", "word")


@query("select filename, count(*) as n from downloads where filename is not null and not regexp_matches(lower(filename), '\\.(mp3|ogg)$') group by 1")
def keys_that_are_no_files(s, d):
    """Keys that look like file names of some kinds left out."""
    rows = table(s, d, "downloads").where("filename is not null").where(~F.lower("filename").rlike(r"\.(mp3|ogg)$"))
    return rows.groupBy("filename").agg(F.count("*").alias("n"))


@query("""
with j as (select user_id, event_id, event_type from events) select user_id, arg_max(event_type, event_id) as state, count(*) as steps, max(event_id) filter (where event_type = 'error') as failed_at from j group by 1""")
def journal_fold(s, d):
    """A journal of transitions folded to the state each key has come to."""
    return table(s, d, "events").groupBy("user_id").agg(
        F.max_by("event_type", "event_id").alias("state"), F.count("*").alias("steps"), F.max(F.when(F.col("event_type") == "error", F.col("event_id"))).alias("failed_at")
    )


@query("""
select u.id as a, v.id as b from (select id, nfc_normalize(folder_path) p from album_units) u join (select id, nfc_normalize(folder_path) p from album_units) v on u.p = v.p and u.id < v.id""")
def both_spellings(s, d):
    """Equal paths in either Unicode spelling: one normalised key, one equi-join."""
    units = table(s, d, "album_units").where("folder_path is not null").select("id", text.nfc("folder_path").alias("p"))
    return units.select(F.col("id").alias("a"), "p").join(units.select(F.col("id").alias("b"), "p"), "p").where("a < b").select("a", "b")


@query("""
select row_id from downloads where ended_at is null and average_speed is null""")
def records_never_asked(s, d):
    return table(s, d, "downloads").where("ended_at is null and average_speed is null").select("row_id")


@query("select distinct unit_signature from album_units where unit_signature is not null")
def keyed_signatures(s, d):
    return table(s, d, "album_units").select("unit_signature").where("unit_signature is not null").distinct()


@query("select shelf_location, count(*) as uses from physical_records where shelf_location is not null group by 1")
def location_uses(s, d):
    return table(s, d, "physical_records").where("shelf_location is not null").groupBy("shelf_location").agg(F.count("*").alias("uses"))


@query("""
select trim(x) as category, count(*) as uses from (select unnest(regexp_split_to_array(categories, '[;,]')) as x from physical_records) where trim(x) <> '' group by 1""")
def category_uses(s, d):
    rows = table(s, d, "physical_records").select(F.explode(F.split("categories", "[;,]")).alias("x")).select(F.trim("x").alias("category"))
    return rows.where("category <> ''").groupBy("category").agg(F.count("*").alias("uses"))


@query("""
select o_orderkey, c_name, n_name, row_number() over (partition by n_name order by o_orderdate desc, o_orderkey desc) as place from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey""")
def change_log(s, d):
    """A three-way join with a stable order within each part, numbered without one sorted partition per part."""
    people = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "c_name", "n_name")
    rows = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate").join(people, "o_custkey")
    numbered = relational.running(rows, "n_name", [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], F.lit(0), "total", "place")
    return numbered.select("o_orderkey", "c_name", "n_name", "place")


@query("""
select o_orderkey, l_linenumber from orders join lineitem on l_orderkey = o_orderkey where o_orderstatus = 'F' and l_returnflag = 'R' and l_shipdate is not null""")
def standing_renames(s, d):
    """Operations of finished plans that still stand."""
    plans = table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey"))
    ops = table(s, d, "lineitem").where("l_returnflag = 'R' and l_shipdate is not null").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return plans.join(ops, "o_orderkey").select("o_orderkey", "l_linenumber")


@query("""
select d.row_id from downloads d join album_units u on u.id = d.row_id % 500 where d.average_speed is null and u.cleared_at is null""")
def unread_pictures(s, d):
    """Children without a reading, of units that stand."""
    units = table(s, d, "album_units").where("cleared_at is null").select("id")
    rows = table(s, d, "downloads").where("average_speed is null").select("row_id", (F.col("row_id") % 500).alias("id"))
    return rows.join(units, "id").select("row_id")


@query("""
select directory, count(distinct id) as streams from downloads where directory is not null and starts_with(filename, directory || '\\') group by 1""")
def streams_held(s, d):
    """Different keys below a folder: an equi-key with a prefix beside it."""
    rows = table(s, d, "downloads").where("directory is not null").where(F.startswith("filename", F.concat("directory", F.lit("\\"))))
    return rows.groupBy("directory").agg(F.countDistinct("id").alias("streams"))


@query("""
select l_orderkey, bool_and(coalesce(l_partkey >= p, true)) as in_order from (select l_orderkey, l_partkey, lag(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey) p from lineitem) group by 1""")
def positions_in_order(s, d):
    """Whether positions rise along a list."""
    lines = table(s, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey").alias("o"), "l_partkey")
    return store.in_order(lines, "l_orderkey", "o", "l_partkey")


@query("select max(id) as highest, count(*) filter (where cleared_at is null) as standing, count(*) filter (where state = 'identified') as identified from album_units")
def unit_lookups(s, d):
    """Highest key and counts of states."""
    return table(s, d, "album_units").agg(F.max("id").alias("highest"), F.count_if(F.col("cleared_at").isNull()).alias("standing"), F.count_if(F.col("state") == "identified").alias("identified"))


@query("""
with k as (select o_custkey, coalesce(o_orderpriority, cast(o_orderkey as varchar)) as piece, count(*) n from orders group by 1, 2)
select o_custkey from k group by 1 having count(*) >= 2 and min(n) = max(n) and min(n) >= 2""")
def album_more_than_once(s, d):
    """Groups of which every member stands equally often, at least twice."""
    pieces = table(s, d, "orders").groupBy("o_custkey", F.coalesce("o_orderpriority", F.col("o_orderkey").cast("string")).alias("piece")).agg(F.count("*").alias("n"))
    return pieces.groupBy("o_custkey").agg(F.count("*").alias("k"), F.min("n").alias("low"), F.max("n").alias("high")).where("k >= 2 and low = high and low >= 2").select("o_custkey")


@query("""
select username, directory, count(*) as file_count, cast(coalesce(sum(size), 0) as bigint) as total_size, arg_max(state, row_id) as last_state from downloads group by 1, 2""")
def grouped_folders(s, d):
    """Flat results grouped to folders with counts and sizes."""
    return table(s, d, "downloads").groupBy("username", "directory").agg(
        F.count("*").alias("file_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"), F.max_by("state", F.when(F.col("state").isNotNull(), F.col("row_id"))).alias("last_state")
    )


@query("""
with c as (select source, lang, count(*) n, row_number() over (partition by source order by count(*) desc, lang) k from documents where lang is not null and source is not null group by 1, 2),
t as (select source, count(*) n_rows, count(lang) n_known, min(year(fetched_at)) as first_year from documents where source is not null group by 1)
select t.source, c.lang as agreed, c.n as agreeing, n_known - c.n as dissenting, n_rows, first_year from t left join c on c.source = t.source and k = 1""")
def tag_provenance(s, d):
    """What most members of a group say (alphabetical on ties), how many dissent, the earliest year."""
    docs = table(s, d, "documents").where("source is not null")
    votes = docs.where("lang is not null").groupBy("source", "lang").agg(F.count("*").alias("n")).withColumn("minus", -F.col("n"))
    best = relational.first_per(votes, ["source"], "minus", "lang").select("source", F.col("lang").alias("agreed"), F.col("n").alias("agreeing"))
    whole = docs.groupBy("source").agg(F.count("*").alias("n_rows"), F.count("lang").alias("n_known"), F.min(F.year("fetched_at")).cast("bigint").alias("first_year"))
    return whole.join(best, "source", "left").select("source", "agreed", "agreeing", (F.col("n_known") - F.col("agreeing")).alias("dissenting"), "n_rows", "first_year")


@query("""
with g as (select l_orderkey, l_suppkey % 7 as grp, count(distinct l_linenumber) n from lineitem group by 1, 2), t as (select l_orderkey, count(distinct l_linenumber) whole from lineitem group by 1),
m as (select l_orderkey, grp from g join t using (l_orderkey) where n * 2 > whole)
select l.l_orderkey, l.l_linenumber, case when count(m.grp) = 0 then 'unknown' when bool_or(m.grp = l.l_suppkey % 7) then 'same' else 'foreign' end as belonging
from lineitem l left join m using (l_orderkey) group by 1, 2""")
def belonging(s, d):
    """Whether a member carries a group that most of its neighbours carry."""
    lines = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 7).alias("grp"))
    groups = lines.groupBy("l_orderkey", "grp").agg(F.countDistinct("l_linenumber").alias("n"))
    whole = lines.groupBy("l_orderkey").agg(F.countDistinct("l_linenumber").alias("whole"))
    major = groups.join(whole, "l_orderkey").where("n * 2 > whole").select("l_orderkey", F.col("grp").alias("m"))
    joined = lines.join(major, "l_orderkey", "left").groupBy("l_orderkey", "l_linenumber").agg(F.count("m").alias("k"), F.bool_or(F.col("m") == F.col("grp")).alias("own"))
    return joined.select("l_orderkey", "l_linenumber", F.when(F.col("k") == 0, "unknown").when(F.col("own"), "same").otherwise("foreign").alias("belonging"))


@query("""
with c as (select l_suppkey, l_tax, l_linestatus, count(*) n, min(l_orderkey) as first from lineitem group by 1, 2, 3), b as (select l_suppkey, arg_max(struct_pack(t := l_tax, s := l_linestatus), struct_pack(n := n, f := -first)) as m from c group by 1)
select l.l_suppkey, count(*) filter (where l.l_tax <> m.t or l.l_linestatus <> m.s) as odd, count(*) as n from lineitem l join b using (l_suppkey) group by 1""")
def odd_labels(s, d):
    """Members whose label isn't the commonest of their group (of equally common ones the first seen)."""
    lines = table(s, d, "lineitem").select("l_suppkey", "l_tax", "l_linestatus", "l_orderkey")
    counts = lines.groupBy("l_suppkey", "l_tax", "l_linestatus").agg(F.count("*").alias("n"), (-F.min("l_orderkey")).alias("first"))
    best = relational.latest_per(counts, ["l_suppkey"], "n", "first").select("l_suppkey", F.col("l_tax").alias("t"), F.col("l_linestatus").alias("s"))
    odd = (F.col("l_tax") != F.col("t")) | (F.col("l_linestatus") != F.col("s"))
    return lines.join(best, "l_suppkey").groupBy("l_suppkey").agg(F.count_if(odd).alias("odd"), F.count("*").alias("n"))
