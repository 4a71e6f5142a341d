"""Check tables: (check_name, expected, actual, ok) with OK / DIFF / INFO."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def as_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def check_rows(facts: DataFrame, checks: Sequence[tuple], first: str = "expected", second: str = "actual") -> DataFrame:
    """One row per check out of a one-row table of facts.

    A check is (name, expected, actual) or (name, expected, actual, passes); names starting with ``info.`` are never judged.
    """
    rows = []
    for name, expected, actual, *rule in checks:
        expected = expected if isinstance(expected, Column) else F.lit(expected)
        e, a = as_text(expected), as_text(actual)
        passes = rule[0] if rule else (e == a)
        verdict = F.lit("INFO") if name.startswith("info.") else F.when(passes, "OK").otherwise("DIFF")
        rows.append(F.struct(F.lit(name).alias("check_name"), e.alias(first), a.alias(second), verdict.alias("ok")))
    return facts.select(F.inline(F.array(*rows)))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def one_row(spark: SparkSession, **scalars: Column) -> DataFrame:
    """A one-row table of scalar subqueries."""
    return spark.range(1).select(*[c.alias(n) for n, c in scalars.items()])


def row_hash(columns: Sequence[str]) -> Column:
    """60-bit integer from the MD5 of all columns; NULL and empty text differ."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("<null>")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(20,0)")


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Fingerprint of a whole table, independent of row order and partitioning.

    Row hashes are added up map-side, so a table of any size is fingerprinted without a sort and without one task
    seeing all rows.
    """
    columns = list(columns or sorted(df.columns))
    return df.agg(F.count(F.lit(1)).alias("row_count"),
                  F.coalesce(F.sum(row_hash(columns)), F.lit(0)).cast("decimal(38,0)").cast("string").alias("fingerprint"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    b = b.select(*a.columns)
    return a.subtract(b).unionByName(b.subtract(a))


def compare_metrics(a: DataFrame, b: DataFrame, rel: float = 1e-9, tolerances: Mapping[str, float] | None = None) -> DataFrame:
    """Join two (metric, value) vectors; text must be equal, decimals may differ by ``rel``, absence is a mismatch.

    ``tolerances`` gives single metrics, or with a name that ends in a dot all metrics that start so, a relative tolerance of their own.
    """
    left = a.select("metric", F.col("value").alias("value_a"))
    right = b.select("metric", F.col("value").alias("value_b"))
    x, y = F.expr("try_cast(value_a as double)"), F.expr("try_cast(value_b as double)")
    is_float = F.col("value_a").contains(".") | F.col("value_b").contains(".")
    allowed = F.lit(rel)
    for name, own in sorted((tolerances or {}).items(), key=lambda t: len(t[0])):
        mine = F.col("metric").startswith(name) if name.endswith(".") else F.col("metric") == name
        allowed = F.when(mine, own).otherwise(allowed)
    near = F.abs(x - y) <= allowed * F.greatest(F.lit(1.0), F.abs(x), F.abs(y))
    same = F.when(F.col("value_a").isNull() | F.col("value_b").isNull(), False) \
        .otherwise((F.col("value_a") == F.col("value_b")) | (is_float & F.coalesce(near, F.lit(False))))
    return left.join(right, "metric", "full").withColumn("ok", F.when(same, "OK").otherwise("DIFF"))
