from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from lodestrata.functions.timestamps import to_instants

KIND = "id int, written string, source string, zone_name string, date_order string, status string"


def us(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp()) * 1_000_000


CASES = [
    ("2023-01-03T04:40:56.150932Z", "Asia/Tokyo", us(2023, 1, 3, 4, 40, 56) + 150932, "given"),
    ("2023-01-03T13:40:31[Asia/Tokyo]", "UTC", us(2023, 1, 3, 4, 40, 31), "read"),
    ("2023-01-03 04:04:24", "America/Chicago", us(2023, 1, 3, 10, 4, 24), "read"),
    ("1672720837815", "Asia/Tokyo", us(2023, 1, 3, 4, 40, 37) + 815000, "read"),
    ("1672914802", None, us(2023, 1, 5, 10, 33, 22), "read"),
    ("1672765677320438", None, us(2023, 1, 3, 17, 7, 57) + 320438, "read"),
    ("2023-01-03T01:45:33.4117909Z", None, us(2023, 1, 3, 1, 45, 33) + 411790, "read"),
    ("20230107T050106Z", None, us(2023, 1, 7, 5, 1, 6), "read"),
    ("Tue, 03 Jan 2023 04:04:36 -0600", None, us(2023, 1, 3, 10, 4, 36), "read"),
    ("20 Jul 2023 05:21 CEST", "Europe/Berlin", us(2023, 7, 20, 3, 21), "read"),
    ("2023-11-05 01:30:00", "America/New_York", us(2023, 11, 5, 5, 30), "read"),  # occurs twice: the earlier one
    ("2023-03-12 02:30:00", "America/New_York", us(2023, 3, 12, 7, 30), "read"),  # skipped: the offset before
    ("25/12/2022 10:00:00", "UTC", us(2022, 12, 25, 10), "read"),
    ("12/25/2022 10:00:00 PM", "UTC", us(2022, 12, 25, 22), "read"),
    ("12/25/2022 12:00:00 AM", "UTC", us(2022, 12, 25, 0), "read"),
    ("2023-01-11T23:01+05:30", None, us(2023, 1, 11, 17, 31), "read"),
    ("2023-01-11 23:01", None, None, "no_zone"),
    ("2023-01-11 23:01", "No/Such", None, "no_zone"),
    ("0001-01-01T00:00:00", "UTC", None, "none"), ("N/A", "UTC", None, "none"), ("", "UTC", None, "none"), (None, "UTC", None, "none"),
    ("2023-02-30 10:00:00", "UTC", None, "none"), ("x" * 100_000, "UTC", None, "none"),
]


def test_every_writing(spark):
    rows = [(i, w, f"s{i}", z, None, "clash") for i, (w, z, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, KIND).withColumn("utc_us", F.lit(1))
    got = {r["id"]: r for r in to_instants(df, "written", ["source"], "zone_name", "date_order").collect()}
    for i, (w, _, instant, status) in enumerate(CASES):
        assert (got[i]["status"], got[i]["utc_us"]) == (status, instant), (w and w[:40], got[i])


@pytest.mark.parametrize("order,day", [(None, 5), ("mdy", 4)])
def test_mixture_decides_and_repeats_stay(spark, order, day):
    sure = [(i, f"{20 + i}/05/2023 10:00:00", "a", "UTC", order, "") for i in range(8)] if order is None else []
    df = spark.createDataFrame(sure + [(99, "05/04/2023 10:00:00", "a", "UTC", order, "")] * 2, KIND)
    got = [r for r in to_instants(df.drop("status"), "written", ["source"], "zone_name", "date_order").collect() if r["id"] == 99]
    assert len(got) == 2 and {r["status"] for r in got} == {"read"}
    assert {datetime.fromtimestamp(r["utc_us"] / 1e6, timezone.utc).day for r in got} == {5 if order is None else 4}


def test_ambiguity_is_marked_and_empty_tables_pass(spark):
    df = spark.createDataFrame([(1, "05/04/2023 10:00:00", "a", "UTC", None, "")], KIND).drop("status")
    assert to_instants(df, "written", ["source"], "zone_name", "date_order").first()["status"] == "ambiguous"
    assert to_instants(df.limit(0), "written", ["source"], "zone_name", "date_order").count() == 0
