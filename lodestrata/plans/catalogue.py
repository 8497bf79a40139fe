"""Queries of the core's operators on the star-schema tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import casing, evidence, matching, signals, text
from ..operators import alignment, compatibility, relational, sequences
from ..session import table
from . import library, linkage, quality, shelf, training
from .registry import QUERIES, SQL, Query, query

def _standing(s: SparkSession, d: str) -> DataFrame:
    return relational.latest_per(table(s, d, "orders").where("o_orderstatus <> 'P'"), ["o_custkey"], "o_orderkey")


@query("""
with latest as (select o_custkey, max(o_orderkey) k from orders where o_orderstatus <> 'P' group by 1),
lines as (select l_orderkey, count(*) n_lines, sum(l_quantity) quantity from lineitem group by 1),
returned as (select distinct o_custkey from orders join lineitem on o_orderkey = l_orderkey where l_returnflag <> 'N')
select c_custkey, k as order_key, o.o_totalprice as total_price, n.n_lines, n.quantity, r.o_custkey is not null as ever_returned
from customer c left join latest on latest.o_custkey = c_custkey left join orders o on o.o_orderkey = k
left join lines n on n.l_orderkey = k left join returned r on r.o_custkey = c_custkey""")
def latest_child_left_join(s, d):
    """Every parent with its latest standing child, a summary of that child's rows and an existence flag."""
    lines = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.sum("l_quantity").alias("quantity"))
    returned = table(s, d, "lineitem").where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    owners = table(s, d, "orders").join(returned, "o_orderkey", "left_semi").select(F.col("o_custkey").alias("c_custkey"))
    latest = _standing(s, d).select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("order_key"), F.col("o_totalprice").alias("total_price"))
    out = table(s, d, "customer").select("c_custkey").join(latest, "c_custkey", "left")
    out = out.join(lines.withColumnRenamed("l_orderkey", "order_key"), "order_key", "left")
    return relational.exists_flag(out, owners, "c_custkey", "ever_returned")


@query("""
select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderkey desc) k
from orders where o_orderstatus <> 'P') where k = 1 and o_totalprice > 100000""")
def latest_then_predicate(s, d):
    """The latest child is chosen first; the predicate may then leave none."""
    return _standing(s, d).where("o_totalprice > 100000").select("o_custkey", "o_orderkey", "o_totalprice")


@query("""
select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderkey desc) k
from orders where o_orderstatus <> 'P' and o_totalprice > 100000) where k = 1""")
def predicate_then_latest(s, d):
    """The predicate comes first; the latest of those that meet it is chosen."""
    rows = table(s, d, "orders").where("o_orderstatus <> 'P' and o_totalprice > 100000")
    return relational.latest_per(rows, ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("""
with wanted as (select distinct p_brand from lineitem join part on l_partkey = p_partkey where l_suppkey = 0),
held as (select distinct l_suppkey, p_brand from lineitem join part on l_partkey = p_partkey)
select l_suppkey from held join wanted using (p_brand) group by 1 having count(*) = (select count(*) from wanted)""")
def relational_division(s, d):
    """Owners that hold every item one owner holds."""
    held = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "p_brand")
    return relational.divide(held, "l_suppkey", "p_brand", held.where("l_suppkey = 0"))


@query("""
with common as (select distinct a.l_suppkey one, b.l_suppkey other from (select distinct l_suppkey, l_partkey, l_quantity from lineitem) a
join (select distinct l_suppkey, l_partkey, l_quantity from lineitem) b on a.l_partkey = b.l_partkey and a.l_quantity = b.l_quantity and a.l_suppkey < b.l_suppkey)
select a.s_nationkey, a.s_suppkey as one, b.s_suppkey as other from supplier a join supplier b on a.s_nationkey = b.s_nationkey
and a.s_suppkey < b.s_suppkey where not exists (select 1 from common c where c.one = a.s_suppkey and c.other = b.s_suppkey)""")
def shared_value_antijoin(s, d):
    """Pairs that share a value, but for pairs that also share an item. Only items shared within a value are looked at."""
    held = table(s, d, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_partkey", "l_quantity")
    return relational.anti_pairs(table(s, d, "supplier"), "s_suppkey", "s_nationkey", held, ["l_partkey", "l_quantity"])


@query("""
select p_brand, count(distinct p_type) identities, count(*) n_rows, count(p_type) known, count(distinct p_name) names from part group by 1
having count(distinct p_type) > 1 or (count(*) > count(p_type) and count(distinct p_name) > 1)""")
def ambiguous_having(s, d):
    """Keys that stand for more than one identity."""
    return relational.ambiguous(table(s, d, "part"), "p_brand", "p_type", "p_name")


@query("""
with names as (select distinct string_split(filename, '\\')[-1] as base_name, directory as place from downloads union select distinct string_split(folder_path, '/')[-1], folder_path from album_units)
select base_name, count(distinct place) places from names where base_name <> '' group by 1 having count(distinct place) > 1""")
def union_basename_ambiguity(s, d):
    """Last names that stand in more than one place of two registries."""
    a = table(s, d, "downloads").select(F.element_at(F.split("filename", r"\\"), -1).alias("base_name"), F.col("directory").alias("place"))
    b = table(s, d, "album_units").select(F.element_at(F.split("folder_path", "/"), -1).alias("base_name"), F.col("folder_path").alias("place"))
    return a.union(b).distinct().where("base_name <> ''").groupBy("base_name").agg(F.countDistinct("place").alias("places")).where("places > 1")


@query("""
select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by
case when event_type = 'purchase' then 0 when event_type = 'view' then 1 else 2 end, ts desc, event_id desc) k from events) where k = 1""")
def priority_pick(s, d):
    """The exact kind before the fallback before the newest."""
    picked = relational.priority_pick(table(s, d, "events"), ["user_id"], [F.col("event_type") == "purchase", F.col("event_type") == "view", F.lit(True)], "ts", "event_id")
    return picked.select("user_id", "event_id", "event_type", "value")


@query("select sha256(text) as digest, count(*) as copies, min(doc_id) as first_id from documents where text is not null group by 1 having count(*) > 1")
def duplicate_exact(s, d):
    """Texts held more than once, by digest."""
    docs = table(s, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))
    return docs.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query("""
select sha256(lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' '))) as digest, count(*) as copies, min(doc_id) as first_id from documents
where trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' ') <> '' group by 1 having count(*) > 1""")
def duplicate_normalized(s, d):
    """Texts held more than once but for case and white space."""
    docs = table(s, d, "documents").withColumn("plain", text.collapse(F.col("text"))).where("plain is not null")
    return docs.groupBy(F.sha2(F.lower("plain"), 256).alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query("select id, 'downloads' as place, count(*) as copies from downloads group by 1 having count(*) > 1 union all select folder_path, 'album_units', count(*) from album_units group by 1 having count(*) > 1")
def duplicate_tagged_union(s, d):
    """Repeated keys of two registries, tagged by registry."""
    def repeated(name: str, key: str) -> DataFrame:
        return table(s, d, name).groupBy(F.col(key).alias("id")).agg(F.count("*").alias("copies")).where("copies > 1")

    return relational.union_tagged({"downloads": repeated("downloads", "id"), "album_units": repeated("album_units", "folder_path")}, "place").select("id", "place", "copies")


@query("select doc_id, strip_accents(text) as folded from documents where text is not null")
def fold_accents(s, d):
    """Texts without their accents."""
    return table(s, d, "documents").where("text is not null").select("doc_id", text.fold_accents("text").alias("folded"))


@query("""
with one as (select s_nationkey, max(s_suppkey) s_suppkey from supplier group by 1 having count(*) = 1)
select c_custkey, coalesce(s.s_suppkey, o.s_suppkey) as anchor from customer c left join supplier s on s.s_suppkey = c.c_custkey
left join one o on o.s_nationkey = c.c_nationkey""")
def unique_anchor_else_null(s, d):
    """The anchor of a row by key, else by value where the value has one owner only."""
    suppliers = table(s, d, "supplier")
    one = relational.unique_or_null(suppliers, "s_nationkey", "s_suppkey").select(F.col("s_nationkey").alias("c_nationkey"), F.col("s_suppkey").alias("by_value"))
    exact = suppliers.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_suppkey").alias("by_key"))
    return table(s, d, "customer").join(exact, "c_custkey", "left").join(one, "c_nationkey", "left").select("c_custkey", F.coalesce("by_key", "by_value").alias("anchor"))


@query("""
select o_orderkey, coalesce(n, 0) as n_lines, coalesce(r, 0) as n_returned from orders left join
(select l_orderkey, count(*) n, count(*) filter (where l_returnflag = 'R') r from lineitem group by 1) on l_orderkey = o_orderkey""")
def history_with_counts(s, d):
    """Every parent with two counts of its children, zero where it has none."""
    counts = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned"))
    return table(s, d, "orders").select("o_orderkey").join(counts, "o_orderkey", "left").na.fill(0)


@query("""
select l_suppkey, count(*) filter (where l_returnflag = 'A' and l_linestatus = 'F') as a_f, count(*) filter (where l_returnflag = 'A' and l_linestatus = 'O') as a_o,
count(*) filter (where l_returnflag = 'R' and l_linestatus = 'F') as r_f, count(*) filter (where l_returnflag = 'R' and l_linestatus = 'O') as r_o from lineitem group by 1""")
def pivot_counters(s, d):
    """Fixed counters of kind and outcome, zero where absent."""
    kinds = [(k, o) for k in "AR" for o in "FO"]
    counters = [F.count_if((F.col("l_returnflag") == k) & (F.col("l_linestatus") == o)).alias(f"{k}_{o}".lower()) for k, o in kinds]
    return table(s, d, "lineitem").groupBy("l_suppkey").agg(*counters)


@query("select user_id, event_id, cast(ts as date) as day from events e where cast(ts as date) = (select max(cast(ts as date)) from events x where x.user_id = e.user_id)")
def max_ties(s, d):
    """All rows of each key's last day."""
    rows = table(s, d, "events").select("user_id", "event_id", F.to_date("ts").alias("day"))
    return relational.ties_at_max(rows, ["user_id"], F.col("day"))


@query("select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) k from events) where k = 1")
def upsert_compaction(s, d):
    """Last write wins on a key of which a part may be null."""
    return relational.compact(table(s, d, "events"), ["user_id", F.coalesce("event_type", F.lit(""))], "ts", "event_id").select("user_id", "event_type", "event_id", "value")


@query("""
select user_id, string_agg(event_type || '=' || event_id, ',' order by event_type) as latest from (select user_id, event_type, max(event_id) event_id from events group by 1, 2) group by 1""")
def latest_map(s, d):
    """The newest entry of each kind as one map per key, written out in order."""
    newest = table(s, d, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"))
    entries = F.array_sort(F.collect_list(F.struct("event_type", "event_id")))
    return newest.groupBy("user_id").agg(F.array_join(F.transform(entries, lambda e: F.concat(e["event_type"], F.lit("="), e["event_id"].cast("string"))), ",").alias("latest"))


@query("""
with m as (select id, folder_path, '/archive' || substr(folder_path, 7) as moved_to from album_units where starts_with(folder_path, '/music/'))
select id, folder_path, moved_to from m where not exists (select 1 from album_units u where u.folder_path = m.moved_to)""")
def prefix_relocate(s, d):
    """Paths under one root rewritten to another, where the place is free."""
    return relational.relocate(table(s, d, "album_units").select("id", "folder_path"), "folder_path", "/music", "/archive")[0].select("id", "folder_path", "moved_to")


@query("""
select parent, min(rank) as first_seen, count(*) as held from (select regexp_replace(rtrim(folder_path, '/'), '/[^/]*$', '') as parent, id as rank from album_units where folder_path is not null) group by 1""")
def known_parents(s, d):
    """Parent folders in the order in which they were first met."""
    parent = F.regexp_replace(F.regexp_replace("folder_path", "/+$", ""), "/[^/]*$", "")
    return table(s, d, "album_units").where("folder_path is not null").groupBy(parent.alias("parent")).agg(F.min("id").alias("first_seen"), F.count("*").alias("held"))


@query("""
select array_to_string(list_slice(string_split(folder_path, '/'), 1, i), '/') as folder, count(*) as files_below
from (select folder_path, unnest(range(1, len(string_split(folder_path, '/')))) as i from album_units where contains(folder_path, '/')) group by 1""")
def descendants(s, d):
    """Entries below every folder, at any depth."""
    return relational.descendants(table(s, d, "album_units"), "folder_path")


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events where cast(json_extract(props, '$.k') as bigint) >= 50")
def json_extract_filter(s, d):
    """A field of a JSON text, typed and filtered."""
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k")).where("k >= 50")


@query("""
select l_orderkey, count(*) as n, median(l_quantity) as mid, quantile_disc(l_quantity, 0.5) as mid_low,
count(*) filter (where l_discount >= 0.05) * 2 > count(*) as mostly_discounted,
case when count(*) filter (where l_returnflag = 'R') * 2 > count(*) then 'returned' when count(*) filter (where l_discount >= 0.05) * 2 > count(*) then 'discounted'
when median(l_quantity) >= 30 then 'bulk' end as proof from lineitem group by 1""")
def group_verdict(s, d):
    """A group judged by medians, low medians and majorities, with the strongest proof."""
    discounted, returned = evidence.majority(F.col("l_discount") >= 0.05), evidence.majority(F.col("l_returnflag") == "R")
    return table(s, d, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.median("l_quantity").alias("mid"), F.expr("percentile_disc(0.5) within group (order by l_quantity)").alias("mid_low"), discounted.alias("mostly_discounted"),
        F.when(returned, "returned").when(discounted, "discounted").when(F.median("l_quantity") >= 30, "bulk").alias("proof"),
    )


@query("""
with v as (select l_orderkey, count(*) n, count(*) filter (where l_linestatus = 'F') measured, least(median(l_quantity) - 10, 40 - median(l_quantity)) margin from lineitem group by 1)
select l_orderkey, n, measured, margin, case when measured = 0 or measured * 2 < n then 'weak' when measured < n or margin < 3 then 'fair' else 'strong' end as sureness,
concat_ws('; ', case when measured < n then measured || ' of ' || n end, case when margin < 3 then 'narrow' end) as reasons from v""")
def group_confidence(s, d):
    """How far a verdict can be trusted: each reason can only lower it."""
    v = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("measured"), F.median("l_quantity").alias("m"))
    v = v.withColumn("margin", F.least(F.col("m") - 10, 40 - F.col("m"))).drop("m")
    thin, partial, narrow = F.col("measured") * 2 < F.col("n"), F.col("measured") < F.col("n"), F.col("margin") < 3
    level = F.least(F.when((F.col("measured") == 0) | thin, 0).otherwise(2), F.when(partial, 1).otherwise(2), F.when(narrow, 1).otherwise(2))
    reasons = F.concat_ws("; ", F.when(partial, F.concat_ws(" of ", F.col("measured").cast("string"), F.col("n").cast("string"))), F.when(narrow, "narrow"))
    return v.withColumn("sureness", F.element_at(F.array(F.lit("weak"), F.lit("fair"), F.lit("strong")), level + 1)).withColumn("reasons", reasons)


@query("""
with c as (select c_nationkey, c_mktsegment, count(*) n from customer group by 1, 2), t as (select c_nationkey, count(*) n_all from customer group by 1)
select c.c_nationkey, c_mktsegment, n, n_all from c join t using (c_nationkey) where n * 4 > n_all""")
def dominant_values(s, d):
    """Values that hold more than a quarter of their group."""
    customers = table(s, d, "customer")
    counts = customers.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return counts.join(customers.groupBy("c_nationkey").agg(F.count("*").alias("n_all")), "c_nationkey").where("n * 4 > n_all")


@query("""
with c as (select l_suppkey, l_linestatus, count(*) n from lineitem group by 1, 2), t as (select l_suppkey, count(*) of from lineitem group by 1),
m as (select l_suppkey, l_linestatus m from c join t using (l_suppkey) where n * 2 > of)
select l_orderkey, l_linenumber, l_partkey, l.l_suppkey, l_linestatus, m as l_linestatus_mode from lineitem l join m using (l_suppkey) where l_linestatus <> m""")
def outlier_vs_majority(s, d):
    """Rows that differ from what most of their group holds. One row per group is joined to the rows."""
    lines = table(s, d, "lineitem")
    mode = relational.strict_mode(lines, "l_suppkey", "l_linestatus").select("l_suppkey", "l_linestatus_mode")
    return lines.join(mode, "l_suppkey").where("l_linestatus <> l_linestatus_mode").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus", "l_linestatus_mode")


@query("select l_suppkey, string_agg(distinct l_returnflag, ', ' order by l_returnflag) as label from lineitem group by 1")
def ordered_labels(s, d):
    """The different values of a group as one label, in order."""
    return table(s, d, "lineitem").groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ", ").alias("label"))


@query("""
with votes as (select l_orderkey, l_returnflag, count(*) n from lineitem group by 1, 2), r as (select *, rank() over (partition by l_orderkey order by n desc) k from votes)
select l_orderkey, string_agg(l_returnflag, '/' order by l_returnflag) as winners, max(n) as votes from r where k = 1 group by 1""")
def group_vote(s, d):
    """The values tied at the top of a vote."""
    votes = table(s, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"))
    top = relational.ties_at_max(votes, ["l_orderkey"], F.col("n"))
    return top.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("l_returnflag")), "/").alias("winners"), F.max("n").alias("votes"))


@query("""
with c as (select l_orderkey, l_linenumber, count(*) k from lineitem group by 1, 2)
select l_orderkey, min(k) as least, max(k) as most, count(*) as n_numbers, max(l_linenumber) as top, min(l_linenumber) as low from c group by 1
having min(k) = max(k) and min(k) >= 2 and min(l_linenumber) = 1 and max(l_linenumber) = count(*)""")
def numbers_repeat(s, d):
    """Groups that hold every number equally often, at least twice."""
    return relational.numbers_repeat(table(s, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("""
with v as (select vec_id, label + 1 as n, case when vec_id % 2 = 0 then 'A' else 'B' end as r, 60.0 + (vec_id * 37) % 120 as t from embeddings),
p as (select a.vec_id as source, b.vec_id as target, b.n || b.r as code, a.t as t1, b.t as t2 from v a join v b on a.vec_id <> b.vec_id and
((b.r = a.r and (b.n = a.n or b.n = a.n % 12 + 1 or b.n = (a.n + 10) % 12 + 1)) or (b.r <> a.r and b.n = a.n))),
q as (select *, case when abs(t2 - t1) / t1 <= 0.06 then 'same' when abs(t2 / 2 - t1) / t1 <= 0.06 then 'double' when abs(t2 * 2 - t1) / t1 <= 0.06 then 'half' end as relation from p)
select source, target, code, relation from q where relation is not null""")
def mix_pairs(s, d):
    """Pairs with neighbouring codes and agreeing tempi, by code and tempo band."""
    v = table(s, d, "embeddings").select(
        "vec_id", (F.col("label") + 1).alias("n"), F.when(F.col("vec_id") % 2 == 0, "A").otherwise("B").alias("r"), (60.0 + (F.col("vec_id") * 37) % 120).alias("t")
    )
    return compatibility.mixing_pairs(v, "vec_id", "n", "r", "t")


@query("select doc_id from documents where contains(lower(text), 'bass') and contains(lower(text), 'waltz')")
def all_words_search(s, d):
    """Texts that hold every word of a query."""
    return table(s, d, "documents").where(text.words_all_in(F.col("text"), "bass waltz")).select("doc_id")


@query("select id, rating, row_number() over (order by rating desc nulls last, id desc) as place from album_units")
def rated_order(s, d):
    """The shelf by rating, the unrated last, ties by age: places without a single sorted partition."""
    rated = table(s, d, "album_units").select("id", "rating").withColumn("all", F.lit(1))
    order = [F.col("rating").desc_nulls_last(), F.col("id").desc()]
    return relational.running(rated, "all", order, F.lit(0), "total", "place").select("id", "rating", "place")


@query("""
select id, case when track_count is null and rating is null then null else round_even((coalesce(least(track_count, 20) / 20.0 * 0.35, 0) + coalesce(rating / 5.0 * 0.25, 0)) /
((case when track_count is null then 0 else 0.35 end) + (case when rating is null then 0 else 0.25 end)), 4) end as score from album_units""")
def weighted_evidence(s, d):
    """A weighted mean in which absent observations don't count."""
    parts = [(F.least("track_count", F.lit(20)) / 20.0, 0.35), (F.col("rating") / 5.0, 0.25)]
    return table(s, d, "album_units").select("id", evidence.weighted_mean(parts).alias("score"))


@query("""
select a.o_orderkey, case when abs(year(a.o_orderdate) - 1997) = 0 then 1.0 when abs(year(a.o_orderdate) - 1997) = 1 then 0.8 else 0.0 end::double as agreement from orders a""")
def year_agreement(s, d):
    return table(s, d, "orders").select("o_orderkey", evidence.year_agreement(F.year("o_orderdate"), F.lit(1997)).alias("agreement"))


@query("select c_nationkey, c_custkey, rank_in_group from (select c_nationkey, c_custkey, cast(row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as integer) rank_in_group from customer) where rank_in_group <= 5")
def shortlist_topk(s, d):
    """The first five of each group."""
    return relational.top_k(table(s, d, "customer"), "c_nationkey", 5, F.col("c_acctbal").desc(), F.col("c_custkey")).select("c_nationkey", "c_custkey", "rank_in_group")


@query("""
select o_custkey, round(max(o_totalprice) / 1000000 - 0.2::double * count(*) filter (where o_orderpriority = '1-URGENT'), 8) as confidence,
count(*) filter (where o_orderpriority = '1-URGENT') as contradicting from orders group by 1""")
def reconcile(s, d):
    """A reading lowered by every source that contradicts it."""
    against = F.count_if(F.col("o_orderpriority") == "1-URGENT")
    return table(s, d, "orders").groupBy("o_custkey").agg(F.round(F.max("o_totalprice") / 1000000 - 0.2 * against, 8).alias("confidence"), against.alias("contradicting"))


@query("""
with n as (select distinct p_name from part) select a.p_name as one, b.p_name as other, levenshtein(a.p_name, b.p_name) as slips from n a join n b
on a.p_name < b.p_name and abs(length(a.p_name) - length(b.p_name)) <= 2 and a.p_name[1:1] = b.p_name[1:1] where levenshtein(a.p_name, b.p_name) <= 3""")
def edit_distance(s, d):
    """Different names a few slips apart that begin alike; a few hundred names stand for all rows."""
    names = table(s, d, "part").select("p_name").distinct().withColumn("first", F.substring("p_name", 1, 1))
    pairs = names.select("first", F.col("p_name").alias("one")).join(names.select("first", F.col("p_name").alias("other")), "first").where("one < other")
    return pairs.where(F.abs(F.length("one") - F.length("other")) <= 2).select("one", "other", F.levenshtein("one", "other").cast("bigint").alias("slips")).where("slips <= 3")


@query("select s_suppkey, cast(nullif(regexp_extract(s_name, '([0-9]{1,9})\\s*$', 1), '') as integer) as volume from supplier")
def series_volume(s, d):
    return table(s, d, "supplier").select("s_suppkey", text.volume_of(F.col("s_name")).alias("volume"))


@query("select p_partkey, round_even(p_retailprice / 7, 2) as rounded from part")
def round_half_even(s, d):
    return table(s, d, "part").select("p_partkey", F.bround(F.col("p_retailprice") / 7, 2).alias("rounded"))


@query("""
select id, released_on, case when regexp_matches(released_on, '^[0-9]{4}(-[0-9]{1,2}){0,2}$') then try_cast(
split_part(released_on, '-', 1) || '-' || lpad(cast(greatest(coalesce(try_cast(nullif(split_part(released_on, '-', 2), '') as integer), 1), 1) as varchar), 2, '0') || '-' ||
lpad(cast(greatest(coalesce(try_cast(nullif(split_part(released_on, '-', 3), '') as integer), 1), 1) as varchar), 2, '0') as date) end as released from metadata_releases""")
def partial_dates(s, d):
    """Dates of which month and day may be absent or zero."""
    return table(s, d, "metadata_releases").select("id", "released_on", text.partial_date(F.col("released_on")).alias("released"))


@query("""
select p.id from physical_records p where not exists (select 1 from metadata_releases m where lower(m.title) = lower(p.album) and lower(m.primary_artist) = lower(p.artist))""")
def import_new_rows(s, d):
    """Rows of an import that the catalogue doesn't hold yet."""
    held = table(s, d, "metadata_releases").select(F.lower("title").alias("t"), F.lower("primary_artist").alias("a")).distinct()
    rows = table(s, d, "physical_records")
    return rows.join(held, (F.lower("album") == F.col("t")) & (F.lower("artist") == F.col("a")), "left_anti").select("id")


@query("""
with f as (select *, sum(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by ts, event_id) n from events)
select user_id, event_id, cast(row_number() over (partition by user_id order by ts desc, event_id desc) as integer) as undo_order from f where n = 0""")
def undo_trail(s, d):
    """Steps before the first failure, in the order in which they are undone."""
    return relational.trail(table(s, d, "events"), "user_id", F.col("event_type") == "error", "ts", "event_id").select("user_id", "event_id", "undo_order")


@query("""
with w as (select doc_id, author, n_chars, coalesce(sum(n_chars) over (partition by author order by doc_id desc rows between unbounded preceding and 1 preceding), 0) as b,
row_number() over (partition by author order by doc_id desc) k from documents where author is not null)
select doc_id, author, cast(b as bigint) as before, b + n_chars <= 5000 or k = 1 as kept from w""")
def eviction_budget(s, d):
    """What a budget of characters keeps of each author, newest first."""
    docs = table(s, d, "documents").where("author is not null").select("doc_id", "author", "n_chars")
    return relational.budget(docs, "author", "n_chars", 5000, F.col("doc_id").desc()).select("doc_id", "author", "before", "kept")


@query("""
select id, coalesce(origin, '') || ' - ' || id || case when rating is not null then ' (' || rating || ')' else '' end as label from album_units""")
def template_names(s, d):
    """Names rendered from a template with an optional part."""
    units = table(s, d, "album_units")
    return units.select("id", text.render("%origin% - %id%{ (%rating%)}", {c: F.col(c) for c in ("origin", "id", "rating")}).alias("label"))


@query("select distinct c_nationkey from customer intersect select distinct s_nationkey from supplier")
def set_intersection(s, d):
    return table(s, d, "customer").select("c_nationkey").intersect(table(s, d, "supplier").select("s_nationkey"))


@query("""
select event_type, time_bucket(interval '1 day', ts, timestamp '2024-01-01') as day, count(*) as n, round(sum(value), 4) as total from events group by 1, 2""")
def tumbling_days(s, d):
    """Events by kind and day (an addition: the reference has no windows)."""
    w = F.window("ts", "1 day")
    return table(s, d, "events").groupBy("event_type", w.alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("w.start").alias("day"), "n", "total")


@query("""
with g as (select user_id, event_id, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) > interval '6 hours' then 1 else 0 end as starts from events),
n as (select *, sum(starts) over (partition by user_id order by ts, event_id) as session from g)
select user_id, min(event_id) as first_event, count(*) as n from n group by user_id, session""")
def settled_sessions(s, d):
    """Runs of events that no pause of six hours parts."""
    w = F.session_window("ts", F.lit("6 hours 0.000001 seconds"))
    return table(s, d, "events").groupBy("user_id", w.alias("w")).agg(F.min("event_id").alias("first_event"), F.count("*").alias("n")).select("user_id", "first_event", "n")


@query()
def similarity_ratio(s, d):
    """How alike different part names are that share their last word."""
    names = table(s, d, "part").select("p_name").distinct().withColumn("last", F.element_at(F.split("p_name", " "), -1))
    pairs = names.select("last", F.col("p_name").alias("one")).join(names.select("last", F.col("p_name").alias("other")), "last").where("one < other")
    return pairs.select("one", "other", matching.similarity("one", "other").alias("ratio"))


@query()
def key_and_tempo(s, d):
    """Key and tempo of sampled signals; here of arrays repeated to a signal of 64 x 256 samples."""
    samples = F.flatten(F.array_repeat(F.col("embedding").cast("array<double>"), 256))
    measured = table(s, d, "embeddings").select("vec_id", signals.measure_key(samples, 11025).alias("k"), signals.measure_tempo(samples, 11025).alias("t"))
    return measured.select("vec_id", "k.*", signals.camelot(F.col("k.tonic"), F.col("k.mode")).alias("code"), "t.bpm", F.col("t.confidence").alias("beat"), "t.twin_bpm")


@query("""
with x as (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as i from embeddings), m as (select vec_id, median(v) as mid, max(v) as top from x group by 1),
d as (select vec_id, any_value(mid) as mid, any_value(top) as top, median(abs(v - mid)) as mad from x join m using (vec_id) group by 1), s as (select vec_id, i, v - lead(v) over (partition by vec_id order by i) as fall from x),
f as (select vec_id, max(fall) as fall, arg_max(i, struct_pack(f := fall, p := -i)) as i from s where fall is not null group by 1)
select vec_id, round((top - mid) / nullif(mad * 1.4826, 0), 6) as peak, cast(i - 1 as integer) as place, round(fall, 9) as fall from d join f using (vec_id)""")
def spectrum_summaries(s, d):
    """Robust peak and steepest fall of arrays of levels."""
    levels = F.col("embedding").cast("array<double>")
    fall = signals.steepest_fall(levels)
    return table(s, d, "embeddings").select("vec_id", F.round(signals.robust_peak(levels), 6).alias("peak"), fall["place"].alias("place"), F.round(fall["fall"], 9).alias("fall"))


@query(r"""
with t as (select id, coalesce(primary_artist, '') as a, title, regexp_matches(title, '(?i)^(.*?)[\s,:(\-]*\b(?:vol(?:ume|\.)?|pt\.?|part)\s*([0-9]{1,3})\)?\s*$') as said from metadata_releases where title is not null),
p as (select id, a, said, lower(trim(coalesce(nullif(regexp_extract(title, '(?i)^(.*?)[\s,:(\-]*\b(?:vol(?:ume|\.)?|pt\.?|part)\s*([0-9]{1,3})\)?\s*$', 1), ''),
nullif(regexp_extract(title, '^(.*?)\s+([0-9]{1,3})\s*$', 1), ''), title), ' ')) as stem,
coalesce(try_cast(regexp_extract(title, '(?i)^(.*?)[\s,:(\-]*\b(?:vol(?:ume|\.)?|pt\.?|part)\s*([0-9]{1,3})\)?\s*$', 2) as integer), try_cast(regexp_extract(title, '^(.*?)\s+([0-9]{1,3})\s*$', 2) as integer)) as volume from t),
v as (select distinct a, stem from p where said)
select id, p.stem, volume from p left join v on v.a = p.a and v.stem = p.stem where (said or v.stem is not null) and volume is not null""")
def series_volumes(s, d):
    """Volumes of series, by what titles say and what their siblings vouch for."""
    r = table(s, d, "metadata_releases").where("title is not null").select("id", F.coalesce("primary_artist", F.lit("")).alias("a"), "title")
    return sequences.volumes(r, "id", "title", ["a"])


@query()
def title_casing(s, d):
    """Titles with their capitals in order."""
    return table(s, d, "metadata_releases").where("title is not null").select("id", "title", casing.titles("title").alias("cased"))


def _editions(s: SparkSession, d: str) -> DataFrame:
    """Every release beside the first one of its folded title and artist; never all pairs of a group."""
    kind = "struct<tracks:array<struct<title:string,duration_ms:bigint>>>"
    r = table(s, d, "metadata_releases").where("title is not null").select(
        "id", F.from_json("payload", kind)["tracks"].alias("tracks"), F.lower("title").alias("t"), F.coalesce(F.lower("primary_artist"), F.lit("")).alias("a")
    )
    first = r.groupBy("t", "a").agg(F.min("id").alias("first_id"), F.min_by("tracks", "id").alias("first_tracks"))
    return r.join(first, ["t", "a"]).where("id <> first_id")


@query()
def edition_durations(s, d):
    """How many durations of an edition agree with the first edition's."""
    count = alignment.agreeing_durations(F.col("tracks.duration_ms"), F.col("first_tracks.duration_ms"))
    return _editions(s, d).select("id", "first_id", F.size("tracks").alias("n_tracks"), count.alias("agreeing"))


@query()
def edition_alignment(s, d):
    """Which track of the first edition each track of another one is, and how that was told."""
    return _editions(s, d).select("id", "first_id", alignment.aligned("tracks", "first_tracks").alias("x")).select("id", "first_id", "x.method", "x.tracks")


def queries() -> dict[str, Query]:
    return QUERIES | training.queries()


def oracle_sql() -> dict[str, str]:
    return SQL | training.oracle_sql()
