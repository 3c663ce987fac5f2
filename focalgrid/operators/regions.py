"""Averages within regions and grid cells, and coactivation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Grid, grid_label
from ..utils import small
from .dataset import Dataset
from .meta import MetaAnalysis


def average_within_regions(dataset: Dataset, regions: DataFrame, masker=None, threshold: float | int | None = None, remove_zero: bool = True, dense: bool = False) -> DataFrame:
    """(region_id, study_id, value) from ``regions`` (region_id, voxel_id), which may overlap.

    The value is the share of a region's voxels that a study activates; with an integer threshold the number of them.
    With a threshold it is whether that is at least the threshold.  Region 0 is left out if ``remove_zero``.  Only
    regions that a study touches have a row, unless ``dense``.  Regions go to all executors if their count allows it:
    the studies' voxels, dealt by study, then are summed without a shuffle.
    """
    r = regions.select("region_id", "voxel_id").distinct()
    if masker is not None:
        r = r.join(masker.mask(), "voxel_id", "left_semi")
    r = r.join(dataset.masker.volume.select("voxel_id"), "voxel_id", "left_semi")
    if remove_zero:
        r = r.where("region_id <> 0")
    sizes = r.groupBy("region_id").agg(F.count(F.lit(1)).alias("size"))
    n = dataset.study_voxel.join(small(r), "voxel_id").groupBy("region_id", "study_id").agg(F.count(F.lit(1)).alias("n"))
    if dense:
        n = dataset.studies.join(small(sizes.select("region_id"))).join(n, ["region_id", "study_id"], "left").fillna(0, ["n"])
    by_count = isinstance(threshold, int) and not isinstance(threshold, bool)
    value = F.col("n") if by_count else F.try_divide("n", "size")
    if threshold is not None:
        value = value >= threshold
    return n.join(sizes, "region_id").select("region_id", "study_id", value.alias("value"))


def create_grid(volume: DataFrame, grid: Grid = Grid(), scale: int = 4, apply_mask: bool = True) -> DataFrame:
    """(region_id, voxel_id): cubic cells of ``scale`` voxels over the grid, or over the volume only."""
    spark = volume.sparkSession
    v = grid.voxels(spark)
    if apply_mask:
        v = v.join(volume.select("voxel_id"), "voxel_id", "left_semi")
    return v.select(grid_label(grid, F.col("xi"), F.col("yj"), F.col("zk"), scale).alias("region_id"), "voxel_id")


def apply_grid(dataset: Dataset, masker=None, scale: int = 5, threshold: float | int | None = None, dense: bool = False) -> DataFrame:
    """``average_within_regions`` over the cells of a grid."""
    volume = (masker or dataset.masker).volume
    return average_within_regions(dataset, create_grid(volume, dataset.grid, scale), masker, threshold, dense=dense)


def sphere(dataset: Dataset, point: Sequence[float], radius: float) -> DataFrame:
    """(voxel_id, value 1.0) of the volume's voxels within ``radius`` mm of a point."""
    grid, spark = dataset.grid, dataset.foci.sparkSession
    at = [round(o + s * c / grid.size) for o, s, c in zip(grid.origin, grid.sign, point)]
    v = grid.voxels(spark)
    square = sum(((F.col(c) - i) * grid.size * ((F.col(c) - i) * grid.size) for c, i in zip(("xi", "yj", "zk"), at)), F.lit(0.0))
    return v.where(F.sqrt(square) <= radius).join(dataset.masker.volume.select("voxel_id"), "voxel_id", "left_semi").select("voxel_id", F.lit(1.0).alias("value"))


def coactivation(dataset: Dataset, seed, threshold: float | int = 0.0, path: str | None = None, prefix: str = "", radius: float = 6.0, q: float = 0.01) -> DataFrame:
    """The images of the studies that activate a seed: a region (voxel_id, value) over ``threshold``, or points within ``radius``."""
    ids = dataset.by_region(seed, threshold) if isinstance(seed, DataFrame) else dataset.by_peaks(seed, radius)
    analysis = MetaAnalysis(dataset, ids, q=q)
    if path:
        analysis.save(path, prefix)
    return analysis.images()
