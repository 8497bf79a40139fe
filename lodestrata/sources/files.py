"""Reading what lies in folders: the files themselves, delimited tables of unknown make, nested answers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIO = ("flac", "mp3", "wav", "aiff", "aif", "m4a", "ogg", "opus", "ape", "wv")


def scan(spark: SparkSession, root: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """path, folder, name, extension, size, modified of all files below a root, hidden and excluded folders aside.

    The content is not read: the column is pruned from the scan.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", "^file:/*", "/")
    out = files.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    # Hidden below the root, whatever the root itself is called.
    plain_root = re.sub("^file:/*", "/", root).rstrip("/")
    out = out.where(~F.substring("path", len(plain_root) + 1, 1_000_000).rlike(r"/\.[^/]+"))
    for prefix in excluded:
        out = out.where(~F.startswith("path", F.lit(prefix.rstrip("/") + "/")))
    name = F.element_at(F.split("path", "/"), -1)
    return out.select(
        "path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), name.alias("name"),
        F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("extension"), "size", "modified",
    )


def disc_units(files: DataFrame) -> DataFrame:
    """unit, n_audio, n_discs, kind: folders with audio, discs counted to the folder around them.

    album: audio of its own; multi-disc: discs only; container: no audio of its
    own but several folders with audio below; ambiguous: both of its own and in discs.
    """
    units = folder_units(files)
    unit = F.when(F.col("is_disc"), F.regexp_replace("folder", "/[^/]*$", "")).otherwise(F.col("folder"))
    grouped = units.groupBy(unit.alias("unit")).agg(
        F.sum("n_audio").alias("n_audio"), F.count_if("is_disc").alias("n_discs"), F.count_if(~F.col("is_disc")).alias("own")
    )
    around = grouped.groupBy(F.regexp_replace("unit", "/[^/]*$", "").alias("unit")).agg(F.count("*").alias("n_units"), F.sum("n_audio").alias("n_below"))
    containers = around.join(grouped.select("unit"), "unit", "left_anti").where("n_units > 1").select("unit", F.col("n_below").alias("n_audio"), F.lit(0).cast("bigint").alias("n_discs"), F.lit("container").alias("kind"))
    kind = F.when((F.col("n_discs") > 0) & (F.col("own") > 0), "ambiguous").when(F.col("n_discs") > 0, "multi-disc").otherwise("album")
    return grouped.select("unit", "n_audio", "n_discs", kind.alias("kind")).unionByName(containers)


def folder_units(files: DataFrame) -> DataFrame:
    """folder, n_audio, n_companions, is_disc: folders with audio, and whether they are one disc of the folder around them."""
    audio = F.col("extension").isin(*AUDIO)
    units = files.groupBy("folder").agg(F.count_if(audio).alias("n_audio"), F.count_if(~audio).alias("n_companions")).where("n_audio > 0")
    return units.withColumn("is_disc", F.lower(F.element_at(F.split("folder", "/"), -1)).rlike(r"^(cd|dis[ck])[ _.-]*\d{1,2}$"))


def _decode(content: bytes) -> str:
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("cp1252", "replace")


def read_tables(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, line_no, cells: rows of delimited files whose encoding and delimiter are found file by file.

    UTF-8 with or without mark, else Windows-1252; comma, semicolon or tab,
    whichever the first line holds most. Empty rows are dropped, short ones
    padded to the header's width with null; line numbers are those of the file.
    """
    import csv
    import io

    def rows(content: bytes | None):
        if content is None:
            return []
        text = _decode(bytes(content))
        first = text.split("\n", 1)[0]
        delimiter = max(",;\t", key=first.count)
        reader, out, width = csv.reader(io.StringIO(text), delimiter=delimiter), [], 0
        for cells in reader:
            if any(c.strip() for c in cells):
                width = width or len(cells)
                out.append((reader.line_num, [c.strip() or None for c in cells] + [None] * (width - len(cells))))
        return out

    def run(contents: pd.Series) -> pd.Series:
        return contents.map(rows)

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    # One file is a row and its rows stay with it: tables typed by people, which fit a task.
    read = F.pandas_udf(run, "array<struct<line_no:int,cells:array<string>>>")
    return files.select("path", F.inline(read("content")))


def with_header(rows: DataFrame) -> DataFrame:
    """path, line_no, fields: each row as a map of the names in its file's first row; blank names become `Column n`."""
    heads = rows.groupBy("path").agg(F.min_by("cells", "line_no").alias("head"), F.min("line_no").alias("first"))
    names = F.transform("head", lambda c, i: F.coalesce(c, F.concat(F.lit("Column "), (i + 1).cast("string"))))
    joined = rows.join(heads, "path").where("line_no > first")
    return joined.select("path", "line_no", F.map_from_arrays(names, F.slice("cells", F.lit(1), F.size("head"))).alias("fields"))
