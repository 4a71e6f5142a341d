"""Fitted models kept as tables: fitted once per training table, written below the shared folder and read back by every later query."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from ..functions.checks import fingerprint
from ..sources.io import shared_root


def model_version(training: DataFrame, *settings: object, seen: Row | None = None) -> str:
    """Name of a model's version: rows and row hashes of its training table, and its settings. Order and partitioning do not matter.

    ``seen`` is the table's fingerprint if the caller has it: several models of one written table need only one.
    """
    seen = seen or fingerprint(training).first()
    return hashlib.sha256(repr((seen.row_count, seen.fingerprint, *settings)).encode()).hexdigest()[:16]


def frozen(spark: SparkSession, name: str, version: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The saved table ``name`` in this version, with a ``version`` column; ``make`` is called, and its result written, if there is none yet.

    Rows go to a folder of their own, whose name is noted in a second table once they are all written. A write that was broken off is
    therefore never read, and two sessions that write the same version at once do not touch each other's files.
    """
    path = f"{shared_root(spark)}/models/{name}/{version}"
    if not _noted(spark, path):
        folder = uuid.uuid4().hex
        make().withColumn("version", F.lit(version)).write.parquet(f"{path}/{folder}")
        spark.createDataFrame([(folder,)], "folder string").coalesce(1).write.mode("append").parquet(f"{path}/noted")
    return spark.read.parquet(f"{path}/{_noted(spark, path)}")


def _noted(spark: SparkSession, path: str) -> str | None:
    try:
        return spark.read.schema("folder string").parquet(f"{path}/noted").agg(F.min("folder")).first()[0]
    except AnalysisException:  # nothing has been written yet
        return None


def frozen_pipeline(spark: SparkSession, name: str, version: str, fit: Callable[[], PipelineModel]) -> PipelineModel:
    """The saved pipeline ``name`` in this version; ``fit`` is called, and its result written, if there is none yet."""

    def save() -> DataFrame:
        path = f"{shared_root(spark)}/models/{name}/{version}/pipeline-{uuid.uuid4().hex}"
        fit().write().save(path)
        return spark.createDataFrame([(path,)], "path string")

    return PipelineModel.load(frozen(spark, f"{name}_pipeline", version, save).agg(F.min("path")).first()[0])
