"""New activations as a stream: the same columns as in a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.geometry import Grid, Transforms, stamp
from ..sources.activations import to_foci


def read_foci(spark: SparkSession, path: str, schema: T.StructType, grid: Grid = Grid(), transforms: Transforms | None = Transforms()) -> DataFrame:
    """Foci of tab-separated files as they arrive in a folder."""
    raw = spark.readStream.option("sep", "\t").option("header", True).schema(schema).csv(path)
    return to_foci(raw, grid, transforms)


def append_voxels(foci: DataFrame, path: str, checkpoint: str, radius: float = 6.0, grid: Grid = Grid()):
    """Writes (study_id, voxel_id) of each batch; a study's foci should come in one batch, else its rows can repeat."""

    def write(batch: DataFrame, _: int) -> None:
        stamp(batch, radius, grid).write.mode("append").parquet(path)

    return foci.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
