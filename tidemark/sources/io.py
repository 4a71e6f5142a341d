"""Readers and writers: typed files in, partitioned Parquet tables out."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

DAILY_TABLE = r"^\d{8}$"


class NoSharedFolder(RuntimeError):
    pass


def shared_root(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.

    Only in local mode, where one machine is everything, may the setting be missing; on a cluster a local folder would silently hold
    a part of the rows on each machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise NoSharedFolder("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return shared.rstrip("/") if shared else _local_scratch()


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_root(spark)}/{uuid.uuid4().hex}"


@functools.cache
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="tidemark-")


def materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    For results that several later steps use (daily facts, training features, latest replies): computed one time, and a lost
    executor only costs a re-read.
    """
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_typed_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """S1 / W-01: header line, fixed schema, the first bad record fails the load."""
    return (spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False)
            .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ssXXX").csv(path))


def header_matches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """S2: loading is positional, so the header must list the schema's names in the same order."""
    header = spark.read.option("header", False).option("mode", "PERMISSIVE").text(path).limit(1)
    wanted = ",".join(schema.fieldNames())
    return header.select(F.col("value").alias("header"), F.lit(wanted).alias("schema"), (F.col("value") == wanted).alias("ok"))


def loaded_rows_match(loaded: DataFrame, path: str) -> DataFrame:
    """S3: rows in the table against the records of all files, counted a second time as plain text columns.

    Every file has a header of its own, and a quoted line break belongs to its record.
    """
    records = loaded.sparkSession.read.option("header", True).option("multiLine", True).csv(path).agg(F.count(F.lit(1)).alias("n")).scalar()
    return loaded.agg(F.count(F.lit(1)).alias("loaded")).select(records.alias("in_file"), "loaded", (F.col("loaded") == records).alias("ok"))


def read_ndjson(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """S4: JSON lines with a fixed schema; JSON-valued columns stay text and are parsed where used."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_daily_tables(spark: SparkSession, path: str, schema: T.StructType, pattern: str = DAILY_TABLE, day: str = "day") -> DataFrame:
    """S5: one folder per day; folders whose name is not a date (such as intraday ones) are pruned by partition."""
    full = T.StructType([f for f in schema.fields if f.name != day] + [T.StructField(day, T.StringType())])
    return spark.read.schema(full).option("basePath", path).parquet(path).where(F.col(day).rlike(pattern))


def file_listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """S6: file metadata without reading contents."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
            .select(F.col("path").alias("uri"), F.col("length").alias("size"), F.col("modificationTime").alias("updated")))


def literal_relation(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """S7: a small fixed relation."""
    return spark.createDataFrame(list(rows), schema)


def write_fact(df: DataFrame, path: str, partition: str, cluster: Sequence[str] = ()) -> None:
    """S12: replace a date-partitioned table; rows are sorted by the cluster columns so that file statistics can skip.

    The extra hash on the cluster columns spreads a heavy day over several tasks instead of one.
    """
    spread = df.repartition(partition, *cluster) if cluster else df
    ordered = spread.sortWithinPartitions(partition, *cluster) if cluster else spread
    ordered.write.mode("overwrite").partitionBy(partition).parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    """S13."""
    df.write.mode("overwrite").parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    """S14 / S18: append-only logs."""
    df.write.mode("append").parquet(path)


def empty_table(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def delete_where(df: DataFrame, condition) -> DataFrame:
    """S15: what remains after a conditional delete; rows for which the condition is NULL stay."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def add_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """S16: add the columns that do not exist yet as NULL."""
    return df.withColumns({n: F.lit(None).cast(t) for n, t in columns.items() if n not in df.columns})


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def create_view(df: DataFrame, name: str) -> DataFrame:
    """S17."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


class UnfilteredScan(ValueError):
    pass


def read_fact(spark: SparkSession, path: str, date_column: str, start=None, end=None) -> DataFrame:
    """W-14: the big facts may only be read with a date range, which reaches the scan as a partition filter."""
    if start is None and end is None:
        raise UnfilteredScan(f"a filter on {date_column} is required")
    df = spark.read.parquet(path)
    if start is not None:
        df = df.where(F.col(date_column) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(date_column) <= F.lit(end).cast("date"))
    return df
