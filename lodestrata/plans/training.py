"""Queries of the core's operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timestamps
from ..operators import nested
from ..session import table


def _answers(spark: SparkSession, d: str, *fields) -> dict[str, DataFrame]:
    return nested.flat_tables(table(spark, d, "downloads_all"), ["snapshot_id"], "payload", fields)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every file object of every answer with its place and its ancestors' places."""
    return _answers(spark, d)["files"]


def p3_users(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d)["users"]


def p3_directories(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d)["directories"]


def p3_files(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d, *nested.FILE_FIELDS)["files"]


def _times(spark: SparkSession, d: str) -> DataFrame:
    down = table(spark, d, "downloads").select(
        F.lit("downloads").alias("table_name"), "row_id", "instance",
        F.inline(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("written")) for c in ("requested_at", "ended_at")])),
    )
    units = table(spark, d, "album_units").select(
        F.lit("album_units").alias("table_name"), F.col("id").alias("row_id"), "instance",
        F.lit("created_at").alias("field_name"), F.col("created_at").alias("written"),
    )
    values = down.unionByName(units).where("written is not null").where(~F.col("written").rlike(timestamps.CANONICAL))
    # One row per instance, ten in all: its size follows the number of installations, not that of rows.
    return values.join(table(spark, d, "instances"), "instance", "left")


def p6_times(spark: SparkSession, d: str) -> DataFrame:
    """Every value not in the one form, with its format, its posterior, its status and its instant."""
    return timestamps.to_instants(_times(spark, d), "written", ["table_name", "field_name", "instance"], "zone_name", "date_order")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_times(spark, d).where("status = 'read'").select("table_name", "row_id", "field_name", "utc_us")


_LIST = "case json_type({0}) when 'ARRAY' then json_extract({0}, '$[*]') when 'OBJECT' then [{0}] else [] end"
_USER = "json_exists(j, '$.directories') or json_exists(j, '$.username')"
_LEVELS = f"""
with recursive p as (select snapshot_id, case when json_valid(t) then t::json end j, 0 as depth from (select snapshot_id, ltrim(payload, chr(65279) || ' ' || chr(10) || chr(13) || chr(9)) t from downloads_all)
union all select snapshot_id, case when json_type(j) = 'VARCHAR' then case when json_valid(j->>'$') then (j->>'$')::json end else json_extract(j, '$.*')[1] end, depth + 1 from p
where depth < 8 and (json_type(j) = 'VARCHAR' or json_type(j) = 'OBJECT' and not ({_USER}))),
l as (select snapshot_id, {_LIST.format('j')} us from p where json_type(j) = 'ARRAY' or json_type(j) = 'OBJECT' and ({_USER})),
u as (select snapshot_id, unnest(us) j, cast(generate_subscripts(us, 1) - 1 as integer) user_no from l), users as (select * from u where json_type(j) = 'OBJECT' and ({_USER})),
dl as (select snapshot_id, user_no, {_LIST.format("json_extract(j, '$.directories')")} ds from users),
d as (select snapshot_id, user_no, unnest(ds) j, cast(generate_subscripts(ds, 1) - 1 as integer) directory_no from dl), directories as (select * from d where json_type(j) = 'OBJECT'),
fl as (select snapshot_id, user_no, directory_no, {_LIST.format("json_extract(j, '$.files')")} fs from directories),
f as (select snapshot_id, user_no, directory_no, unnest(fs) j, cast(generate_subscripts(fs, 1) - 1 as integer) file_no from fl), files as (select * from f where json_type(j) = 'OBJECT')
"""

_SQL = {
    "p3_found": _LEVELS + "select snapshot_id, user_no, directory_no, file_no from files",
    "p3_users": _LEVELS + "select snapshot_id, user_no, j->>'$.username' as username from users",
    "p3_directories": _LEVELS + "select snapshot_id, user_no, directory_no, j->>'$.directory' as directory, try_cast(j->>'$.fileCount' as integer) as file_count from directories",
    "p3_files": _LEVELS + "select snapshot_id, user_no, directory_no, file_no, " + ", ".join(
        f"try_cast(j->>'$.{name}' as {kind}) as {column}".replace("as string", "as varchar") for column, name, kind in nested.FILE_FIELDS) + " from files",
}


def oracle_sql() -> dict[str, str]:
    return _SQL


def queries():
    return {f.__name__: f for f in (p3_found, p3_users, p3_directories, p3_files, p6_found, p6_times)}
