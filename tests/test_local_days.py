"""Local dates as bounds: the same rows as the wrapped column, and a scan that prunes."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.exprs import local_date, within_local_days
from tidemark.operators import costs as co


@pytest.mark.parametrize("tz", ["Asia/Taipei", "America/New_York", "UTC", "Pacific/Apia"])
def test_bounds_equal_the_local_date(spark, tz):
    r = random.Random(4)
    days = [datetime.date(2024, 3, 9), datetime.date(2024, 3, 10), datetime.date(2024, 11, 3), datetime.date(2011, 12, 31)]  # clocks forward, back, a date that was left out before
    rows = [(int(datetime.datetime(d.year, d.month, d.day, tzinfo=datetime.timezone.utc).timestamp() * 1e6) + r.randrange(-2 * 86400, 3 * 86400) * 1_000_000 + r.randrange(2),) for d in days for _ in range(400)] + [(None,)]
    df = spark.createDataFrame(rows, "us long")
    for d in days:
        got = df.where(within_local_days("us", F.lit(d), F.lit(d), tz)).orderBy("us").collect()
        assert got == df.where(local_date("us", tz) == F.lit(d)).orderBy("us").collect() and got
    two = df.where(within_local_days("us", F.lit(days[0]), F.lit(days[1]), tz)).count()
    assert two == df.where(local_date("us", tz).between(F.lit(days[0]), F.lit(days[1]))).count()


def test_files_and_folders_are_pruned(spark, tmp_path):
    noon = 1_704_110_400_000_000  # 2024-01-01 12:00 UTC
    rows = [(noon + n * 3_600_000_000, datetime.date(2024, 1, 1) + datetime.timedelta(hours=12 + n) // datetime.timedelta(days=1) * datetime.timedelta(days=1), "serve", 10, 1) for n in range(240)]
    spark.createDataFrame(rows, "logged_us long, usage_date date, job string, prompt_tokens long, output_tokens long").write.partitionBy("usage_date").parquet(f"{tmp_path}/ledger")
    ledger = spark.read.parquet(f"{tmp_path}/ledger")
    out = co.spend_today(ledger, "serve", F.lit(datetime.date(2024, 1, 5)), 0.75, 3.75, partition="usage_date")
    assert out.first().prompt_tokens == 240  # the 24 hours of that day in Taipei
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    out = out.select("*")
    plan = out._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(logged_us," in plan and "LessThan(logged_us," in plan and "convert_timezone" not in plan
    folders = plan[plan.index("PartitionFilters"):]
    assert "usage_date" in folders[:folders.index("PushedFilters")] and "2024-01-04" in folders and "2024-01-06" in folders
