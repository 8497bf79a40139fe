"""Queries of the operators for training data, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import canonical, entities, leaks, lookalikes, mixing, mojibake, names, stuffing, texts


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field in which a character came out wrong."""
    return mojibake.find_garbled(texts.garble_fields(spark, sf_dir), "text", texts.KEYS).select(*texts.KEYS).distinct()


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fields with their restored text."""
    return mojibake.restore(texts.garble_fields(spark, sf_dir), "text", texts.KEYS)


def p2_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a folder and a release that are the same album, with their confidence."""
    return entities.match(
        table(spark, sf_dir, "album_units"), table(spark, sf_dir, "metadata_releases"),
        texts.artist_spellings(spark, sf_dir), texts.credited_pairs(spark, sf_dir),
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_matches(spark, sf_dir).select("album_unit_id", "release_id")


def p4_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every typed value that isn't exactly an entry, with the entry meant."""
    typed = canonical.typed_values(table(spark, sf_dir, "physical_records"), "id")
    return canonical.map_values(typed, table(spark, sf_dir, "canonical_values"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_values(spark, sf_dir).drop("typed")


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling of an artist with the class of the person or group it means."""
    return names.link_spellings(texts.artist_spellings(spark, sf_dir), texts.credited_pairs(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.spelling_pairs(p5_classes(spark, sf_dir))


def p7_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every title and correction that isn't its plain writing, with that writing; texts read in a wrong encoding aside."""
    fields = texts.title_fields(spark, sf_dir)
    changed = lookalikes.to_plain(fields, "text", texts.KEYS)
    garbled = mojibake.find_garbled(fields, "text", texts.KEYS).select(*texts.KEYS).distinct()
    return changed.join(garbled, list(texts.KEYS), "left_anti")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_plain(spark, sf_dir).select(*texts.KEYS)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item and document where the document holds a passage of the item's note."""
    return leaks.find_leaks(table(spark, sf_dir, "eval_items"), table(spark, sf_dir, "documents"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture and how often each is used."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares the mixture reaches, source by source."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages made for search engines."""
    return stuffing.judge_pages(table(spark, sf_dir, "documents")).where("stuffed").select("doc_id")


def p10_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its share of listed and repeated matter."""
    return stuffing.judge_pages(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("p") and k[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {}
