"""Instants (p2) and yearly amounts (p7) on small cases."""

import datetime as dt

from pyspark.sql import functions as F

from sievework.operators import timestamps, units


def instants(spark, rows, zone="Europe/Berlin", order="DMY"):
    feeds = spark.createDataFrame([("f", zone, order)], "source string, zone string, date_order string")
    df = spark.createDataFrame([(i, v, "f", dt.datetime(2024, 7, 10, 12)) for i, v in enumerate(rows)], "id long, v string, source string, seen timestamp").withColumn("utc_us", F.lit("clash"))
    out = timestamps.resolved(df, "id", "v", "source", feeds, "seen").collect()
    return {r.row_id: None if r.utc_us is None else dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=r.utc_us) for r in out}


def test_formats_zones_and_nonsense(spark):
    got = instants(
        spark,
        ["2024-06-24T21:41:31.482871999Z", "2024-06-24 21:41:31", "02.06.2024 17:33", "03/06/2024", "1720891018475", "1718371485", "20240514", "20240605T191211Z", "Wed, 19 Jun 2024 10:39:04 +0530",
         "June 5, 2024 12:34 AM", "2024-06-17 02:05:22 CEST", "2024-01-17 02:05:22 CET", "2024-07-04T02:42:42+01:00[Europe/London]", "Posted 3 weeks ago", "yesterday", "just now", "2025-02-30", "25:61", "", None, "TBD", "31/02/2025", "0000-00-00 00:00:00"],
    )
    d = dt.datetime
    want = [d(2024, 6, 24, 21, 41, 31, 482871), d(2024, 6, 24, 19, 41, 31), d(2024, 6, 2, 15, 33), d(2024, 6, 2, 22), d(2024, 7, 13, 17, 16, 58, 475000), d(2024, 6, 14, 13, 24, 45), d(2024, 5, 13, 22), d(2024, 6, 5, 19, 12, 11), d(2024, 6, 19, 5, 9, 4),
            d(2024, 6, 4, 22, 34), d(2024, 6, 17, 0, 5, 22), d(2024, 1, 17, 1, 5, 22), d(2024, 7, 4, 1, 42, 42), d(2024, 6, 19, 12), d(2024, 7, 9, 12), d(2024, 7, 10, 12)] + [None] * 7
    assert [got[i] for i in range(len(want))] == want


def test_clock_changes(spark):
    # skipped: 02:30 on 2025-03-09; doubled: 01:30 on 2024-11-03 (New York)
    got = instants(spark, ["2025-03-09 02:30:00", "2024-11-03 01:30:00", "2024-11-03 01:30:00 EST", "3/9/2025"], "America/New_York", "MDY")
    assert got == {0: dt.datetime(2025, 3, 9, 7, 30), 1: dt.datetime(2024, 11, 3, 5, 30), 2: dt.datetime(2024, 11, 3, 6, 30), 3: dt.datetime(2025, 3, 9, 5)}


def test_mixture_learns_the_order_of_a_source(spark):
    feeds = spark.createDataFrame([("us", "UTC", None), ("eu", "UTC", None)], "source string, zone string, date_order string")
    rows = [("us", f"{m}/{d}/2024") for m in (1, 5, 9) for d in range(13, 29)] + [("eu", f"{d}/{m}/2024") for m in (1, 5, 9) for d in range(13, 29)] + [("us", "3/4/2024"), ("eu", "3/4/2024")]
    df = spark.createDataFrame([(i, v, s) for i, (s, v) in enumerate(rows)], "id long, v string, source string")
    out = {r.row_id: r for r in timestamps.resolved(df, "id", "v", "source", feeds).collect()}
    assert out[len(rows) - 2].format == "month_first" and out[len(rows) - 1].format == "day_first" and not out[len(rows) - 1].ambiguous
    alone = timestamps.resolved(df.where(f"id = {len(rows) - 1}"), "id", "v", "source", feeds).head()
    assert alone.ambiguous and alone.utc_us is None


def test_empty_tables(spark):
    feeds = spark.createDataFrame([], "source string, zone string, date_order string")
    assert timestamps.resolved(spark.createDataFrame([], "id long, v string, source string"), "id", "v", "source", feeds).count() == 0
    assert units.yearly(spark.createDataFrame([], "id long, a double, b double, u string, t string"), "id", "a", "b", "u", "t").count() == 0


def amounts(spark, rows, **options):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, a double, b double, u string, t string").withColumn("low", F.lit("clash"))
    return {r.id: (r.currency, r.year_min, r.year_max) for r in units.yearly(df, "id", "a", "b", "u", "t", **options).collect()}


def test_units(spark):
    got = amounts(
        spark,
        [(20.0, 25.0, "US$/hr", ""), (10.25, 14.45, "kUSD per month", ""), (8.0, 12.0, "LPA", ""), (2470.0, None, "EUR cents hourly", None), (300.0, 400.0, "£ p.d.", ""), (5.0, 6.0, None, "Calm people.\nFigures in the header are thousands of pounds sterling and apply a month."),
         (50000.0, float("nan"), "usd", "You get 41 percent."), (0.0, 0.0, "usd", ""), (None, None, "usd", ""), (5.0, 6.0, "", "nothing said"), (24.0, 30.0, "Euro", "Compensation is stated for each hour worked and in euros."), (7.0, 9.0, "Rs lakh", ""), (-5.0, 10.0, "zł pcm", "")],
        prior={"year": 1.0},
    )
    assert got == {
        0: ("USD", 41600, 52000), 1: ("USD", 123000, 173400), 2: ("INR", 800000, 1200000), 3: ("EUR", 51376, 0), 4: ("GBP", 78000, 104000), 5: ("GBP", 60000, 72000),
        6: ("USD", 50000, 0), 10: ("EUR", 49920, 62400), 11: ("INR", 700000, 900000), 12: ("PLN", 0, 120),
    }


def test_mixture_of_units(spark):
    rows = [(float(50_000 + 100 * i), None, "USD per year", "") for i in range(200)] + [(float(24 + i % 8), None, "USD", "") for i in range(50)] + [(61_000.0, None, "USD", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, a double, b double, u string, t string")
    out = {r.id: r for r in units.yearly(df, "id", "a", "b", "u", "t").collect()}
    assert out[200].unit == "hour" and not out[200].uncertain and out[250].unit == "year"
