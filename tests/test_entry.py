"""Every query of the core against its SQL on the smallest tables, and the streaming and file operators."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from lodestrata.plans import catalogue
from lodestrata.sources import files
from lodestrata.streaming import transfers

DATA = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are absent")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = catalogue.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    sql = con.sql(catalogue.oracle_sql()[name])
    assert sorted(sql.columns) == columns
    at = [sql.columns.index(c) for c in columns]
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in sql.fetchall())


def test_pairs_without_shared_item_shuffle_no_pairs_times_items(spark, tmp_path):
    suppliers = [(i, i % 7 // 6) for i in range(350)] + [(3, 0), (3, 1), (5, 0), (900, None), (None, 0), (901, 0)]
    lines = [(i, (i * 31 + j * 7) % 4000, float(j % 5)) for i in range(350) for j in range(20)] + [(1, 5000, float("nan")), (2, 5000, float("nan")), (3, 5001, 0.0), (4, 5001, -0.0)]
    lines += [(7, None, 1.0), (8, None, 1.0), (9, 5002, None), (10, 5002, None), (None, 1, 1.0), (900, 5001, 0.0), *lines[:40]]
    spark.createDataFrame(suppliers, "s_suppkey bigint, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame(lines, "l_suppkey bigint, l_partkey bigint, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    for name in ("supplier", "lineitem"):
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = Counter(con.sql(catalogue.oracle_sql()["shared_value_antijoin"]).fetchall())
    sc = spark.sparkContext
    store, bus = sc._jsc.sc().statusStore(), sc._jsc.sc().listenerBus()

    def shuffled():
        bus.waitUntilEmpty()
        stages = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = shuffled()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = Counter(tuple(r) for r in catalogue.queries()["shared_value_antijoin"](spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(n for k, n in shuffled().items() if k not in before) < 100_000 < sum(want.values()) * 20
    assert got == want and sum(want.values()) > 30_000 and any(n > 1 for n in want.values())


def test_tables_of_unknown_make(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿name;;year\nSão;x;1999\n;;\nshort\n".encode())
    (tmp_path / "b.csv").write_bytes("name,year\nCafé,2001\n".encode("cp1252"))
    got = files.with_header(files.read_tables(spark, str(tmp_path)))
    found = sorted((r["path"][-5:], r["line_no"], tuple(sorted(r["fields"].items()))) for r in got.collect())
    assert found == [
        ("a.csv", 2, (("Column 2", "x"), ("name", "São"), ("year", "1999"))), ("a.csv", 4, (("Column 2", None), ("name", "short"), ("year", None))),
        ("b.csv", 2, (("name", "Café"), ("year", "2001"))),
    ]


def test_scan(spark, tmp_path):
    for p in ("A/CD1/1.flac", "A/CD1/cover.jpg", "B/2.MP3", ".hidden/3.mp3", "skip/4.mp3"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"x")
    units = files.folder_units(files.scan(spark, str(tmp_path), (f"{tmp_path}/skip",)))
    kinds = {r["unit"].rsplit("/", 1)[-1]: (r["kind"], r["n_audio"]) for r in files.disc_units(files.scan(spark, str(tmp_path), (f"{tmp_path}/skip",))).collect()}
    assert kinds == {"A": ("multi-disc", 1), "B": ("album", 1), tmp_path.name: ("container", 2)}
    hidden = tmp_path / ".hidden"
    assert [r["name"] for r in files.scan(spark, str(hidden)).collect()] == ["3.mp3"]
    assert sorted((r["folder"].rsplit("/", 1)[-1], r["n_audio"], r["n_companions"], r["is_disc"]) for r in units.collect()) == [("B", 1, 0, False), ("CD1", 1, 1, True)]


def test_streams(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00", "Queued"), ("a", "2024-01-01 02:00:00", "Completed, Succeeded"), ("a", "2024-01-01 03:00:00", "Queued"), ("b", "2024-01-02 00:00:00", None)]
    spark.createDataFrame(rows, "id string, ts string, state string").selectExpr("id", "cast(ts as timestamp) ts", "state").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, ts timestamp, state string").parquet(str(tmp_path / "in"))
    for name, df, mode in (("w", transfers.windowed_counts(stream, "ts", "id"), "complete"), ("s", transfers.latest_states(stream, "id", "ts", "state"), "update")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert {(r["id"], r["n"]) for r in spark.table("w").collect()} == {("a", 3), ("b", 1)}
    assert {(r["id"], r["latest_state"]) for r in spark.table("s").collect()} == {("a", "Completed, Succeeded"), ("b", None)}
