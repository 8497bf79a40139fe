"""The text fields of the tables, one row per value, keyed by table, row, field and place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

KEYS = ("table_name", "row_id", "field_name", "item_no")


def _keyed(df: DataFrame, name: str, row_id: str, field: str, text: str, item_no=None) -> DataFrame:
    return df.select(
        F.lit(name).alias("table_name"),
        F.col(row_id).alias("row_id"),
        F.lit(field).alias("field_name"),
        (F.lit(-1) if item_no is None else item_no).cast("int").alias("item_no"),
        F.col(text).alias("text"),
    )


def track_titles(releases: DataFrame) -> DataFrame:
    """One row per track of each payload; an absent or unreadable payload has none, a null track keeps its place."""
    tracks = F.from_json("payload", "struct<tracks:array<struct<title:string>>>")["tracks"]
    placed = releases.select("id", F.posexplode(tracks).alias("item_no", "track")).select("id", "item_no", F.col("track.title").alias("title"))
    return _keyed(placed, "metadata_releases", "id", "track_title", "title", F.col("item_no"))


def garble_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    down = _keyed(table(spark, sf_dir, "downloads"), "downloads", "row_id", "filename", "filename")
    units = _keyed(table(spark, sf_dir, "album_units"), "album_units", "id", "folder_path", "folder_path")
    return down.unionByName(units).unionByName(track_titles(table(spark, sf_dir, "metadata_releases")))


def title_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    releases = table(spark, sf_dir, "metadata_releases")
    titles = _keyed(releases, "metadata_releases", "id", "title", "title")
    fixes = _keyed(table(spark, sf_dir, "manual_corrections"), "manual_corrections", "id", "value", "value")
    return titles.unionByName(track_titles(releases)).unionByName(fixes)


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """who: name and credited_as of every artist of a release or of its tracks."""
    person = "struct<name:string,credited_as:string>"
    parsed = F.from_json("payload", f"struct<artists:array<{person}>,tracks:array<struct<artists:array<{person}>>>>")
    release = table(spark, sf_dir, "metadata_releases").select(parsed.alias("p"))
    everyone = F.concat(
        F.coalesce("p.artists", F.array()), F.flatten(F.transform(F.coalesce("p.tracks", F.array()), lambda t: F.coalesce(t["artists"], F.array())))
    )
    return release.select(F.explode(everyone).alias("who"))


def artist_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spellings of artists: of releases and tracks (name, credited_as) and of records."""
    people = _people(spark, sf_dir).select(F.explode(F.array("who.name", "who.credited_as")).alias("spelling"))
    return people.unionByName(table(spark, sf_dir, "physical_records").select(F.col("artist").alias("spelling")))


def credited_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spelling_a, spelling_b: the name and the credit one artist has in one release."""
    return _people(spark, sf_dir).select(F.col("who.name").alias("spelling_a"), F.col("who.credited_as").alias("spelling_b")).dropna()
