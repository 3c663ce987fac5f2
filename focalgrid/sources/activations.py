"""Activations: tables of points by study."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import Grid, Transforms

REQUIRED = ("x", "y", "z", "id", "space")


def read(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Tab-separated activations; without a schema types are inferred, which decides about truncation (see ``to_foci``)."""
    reader = spark.read.option("sep", "\t").option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def to_foci(raw: DataFrame, grid: Grid = Grid(), transforms: Transforms | None = Transforms(), truncate: bool | None = None) -> DataFrame:
    """(study_id, x, y, z, space, xi, yj, zk, and all other columns) in the target space.

    Names are lower-cased; ValueError if one of x, y, z, id, space is missing.  truncate: moved coordinates lose their
    fraction; by default where all three columns are integers.
    """
    d = raw.toDF(*(c.lower() for c in raw.columns))
    if missing := [c for c in REQUIRED if c not in d.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if truncate is None:
        truncate = all(isinstance(d.schema[c].dataType, T.IntegralType) for c in "xyz")
    x, y, z = (F.col(c).cast("double") for c in "xyz")
    moved = transforms.apply(F.col("space"), x, y, z, truncate) if transforms else (x, y, z)
    d = d.select(F.col("id").cast("string").alias("study_id"), *(m.alias(c) for m, c in zip(moved, "xyz")), "space", *(F.col(f"`{c}`") for c in d.columns if c not in REQUIRED))
    at = grid.to_index(F.col("x"), F.col("y"), F.col("z"))
    return d.select("*", *(a.alias(n) for a, n in zip(at, ("xi", "yj", "zk"))))
