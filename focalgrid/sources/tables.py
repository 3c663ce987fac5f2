"""Feature files, abstracts, feature maps and CSV results."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

ABSTRACTS = "pmid string, abstract string"


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """A wide tab-separated table; its first column is the study.  A missing file fails at once."""
    return spark.read.option("sep", "\t").option("header", True).option("inferSchema", True).csv(path)


def read_feature_maps(spark: SparkSession, path: str, voxel_ids: list[int]) -> DataFrame:
    """(feature, voxel_id, value) from a .npy matrix of voxels by features, named 0 to n - 1; non-zero values only."""
    m = np.load(path, mmap_mode="r")
    if len(voxel_ids) != m.shape[0]:
        raise ValueError(f"{m.shape[0]} rows for {len(voxel_ids)} voxels")
    rows, columns = np.nonzero(m)
    data = [(str(c), voxel_ids[r], float(m[r, c])) for r, c in zip(rows.tolist(), columns.tolist())]
    return spark.createDataFrame(data, "feature string, voxel_id int, value double")


def write_csv(df: DataFrame, path: str) -> None:
    """One folder of CSV files with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_abstracts(spark: SparkSession, path: str) -> DataFrame:
    """(pmid, abstract) from CSV."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(ABSTRACTS).csv(path)


def write_abstracts(df: DataFrame, path: str) -> None:
    df.select("pmid", "abstract").write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
