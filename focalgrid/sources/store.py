"""Folders of Parquet tables with a JSON description, on any file system of Spark's."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession


def save(path: str, tables: Mapping[str, DataFrame], meta: dict) -> None:
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{path}/{name}")
        spark = t.sparkSession
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(spark: SparkSession, path: str) -> tuple[dict, Callable[[str], DataFrame]]:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    return meta, lambda name: spark.read.parquet(f"{path}/{name}")
