"""A data set: foci, the voxels that studies activate, features and a mask; and the selection of studies."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import Grid, Transforms, stamp
from ..sources import activations, store
from ..utils import small
from .features import FeatureTable
from .masker import Masker


@dataclass(frozen=True)
class Dataset:
    """``foci`` (study_id, x, y, z, space, xi, yj, zk, ...), in the target space.  ``radius`` of the spheres in mm."""

    foci: DataFrame
    masker: Masker
    features: FeatureTable | None = None
    radius: float = 6.0
    grid: Grid = Grid()
    kept_voxels: DataFrame | None = None

    @classmethod
    def from_activations(cls, raw: DataFrame, masker: Masker, radius: float = 6.0, transforms: Transforms | None = Transforms(), grid: Grid = Grid(), truncate: bool | None = None, **more) -> Dataset:
        """From rows with x, y, z, id and space; ``transforms`` None: coordinates as they are."""
        return cls(activations.to_foci(raw, grid, transforms, truncate), masker, radius=radius, grid=grid, **more)

    @cached_property
    def studies(self) -> DataFrame:
        """(study_id) of all studies, also those without a voxel in the mask."""
        return self.foci.select("study_id").distinct()

    @cached_property
    def study_voxel(self) -> DataFrame:
        """(study_id, voxel_id): where a study has a focus within the radius, inside the volume; a row is a 1."""
        if self.kept_voxels is not None:
            return self.kept_voxels
        return stamp(self.foci, self.radius, self.grid).join(self.masker.volume.select("voxel_id"), "voxel_id", "left_semi").select("study_id", "voxel_id")

    def voxels_in(self, mask: DataFrame) -> DataFrame:
        """The rows of ``study_voxel`` at the voxels of ``mask``; only foci that can reach the box around these are stamped."""
        mask = mask.select("voxel_id").distinct()
        if self.kept_voxels is not None:
            return self.kept_voxels.join(mask, "voxel_id", "left_semi")
        axes = dict(zip(("xi", "yj", "zk"), self.grid.indices(F.col("voxel_id"))))
        box = mask.agg(*(f(i).alias(f"{n}_{a}") for a, i in axes.items() for n, f in (("min", F.min), ("max", F.max)))).first()
        reach = math.ceil(self.radius / self.grid.size) + 1
        near = reduce(lambda a, b: a & b, (F.col(a).between(box[f"min_{a}"] - reach, box[f"max_{a}"] + reach) if box[f"min_{a}"] is not None else F.lit(False) for a in axes))
        rows = stamp(self.foci.where(near), self.radius, self.grid).join(mask, "voxel_id", "left_semi")
        return rows.join(self.masker.volume.select("voxel_id"), "voxel_id", "left_semi").select("study_id", "voxel_id")

    def with_radius(self, radius: float) -> Dataset:
        return replace(self, radius=radius, kept_voxels=None)

    def add_features(self, new: FeatureTable, append: bool = True, **how) -> Dataset:
        """With more features, or with these alone if not ``append``; ``how`` as in ``FeatureTable.add``."""
        old = self.features
        if old is None:
            empty = new.weights.limit(0), new.names.limit(0), new.studies.limit(0)
            old = FeatureTable(*empty)
        return replace(self, features=old.add(new, append=append, known=self.studies, **how))

    def trim(self, ids: DataFrame) -> Dataset:
        """Only the given studies."""
        ids = ids.select("study_id").distinct()
        return replace(self, foci=self.foci.join(ids, "study_id", "left_semi"), kept_voxels=None if self.kept_voxels is None else self.kept_voxels.join(ids, "study_id", "left_semi"))

    def image_data(self, ids: DataFrame | None = None, voxels: DataFrame | None = None, dense: bool = False) -> DataFrame:
        """(study_id, voxel_id) of some studies and voxels; with ``dense`` (.., value) with zeros.  Unknown ids are ignored."""
        d = self.study_voxel
        if ids is not None:
            d = d.join(ids.select("study_id").distinct(), "study_id", "left_semi")
        if voxels is not None:
            d = d.join(voxels.select("voxel_id").distinct(), "voxel_id", "left_semi")
        if not dense:
            return d
        studies = self.studies if ids is None else self.studies.join(ids.select("study_id").distinct(), "study_id", "left_semi")
        places = self.masker.volume.select("voxel_id") if voxels is None else self.masker.volume.select("voxel_id").join(voxels.select("voxel_id").distinct(), "voxel_id", "left_semi")
        every = studies.join(small(places))
        return every.join(d.withColumn("value", F.lit(1)), ["study_id", "voxel_id"], "left").fillna(0, ["value"])

    def random_voxels(self, n: int, seed: int = 0) -> DataFrame:
        """The rows of n voxels drawn without replacement from the volume."""
        return self.image_data(voxels=self.masker.volume.select("voxel_id").orderBy(F.rand(seed)).limit(n))

    # selection

    def by_region(self, region: DataFrame, threshold: float | int = 0.0) -> DataFrame:
        """(study_id) with more than ``threshold`` of the region active: a share if it is a float, else a number of voxels.

        ``region`` (voxel_id, value): non-zero voxels count, within the masker's volume and layers.
        """
        voxels = region.where("value <> 0").select("voxel_id").distinct().join(self.masker.mask(), "voxel_id", "left_semi")
        active = self.study_voxel.join(voxels, "voxel_id", "left_semi").groupBy("study_id").agg(F.count(F.lit(1)).alias("n"))
        if isinstance(threshold, int) and not isinstance(threshold, bool):
            over = active.where(F.col("n") > threshold)
            return over.select("study_id") if threshold >= 0 else self.studies
        size = voxels.agg(F.count(F.lit(1)).alias("size"))
        if threshold < 0:
            return self.studies
        return active.join(F.broadcast(size)).where(F.try_divide("n", "size") > threshold).select("study_id")

    def by_peaks(self, peaks: Sequence[Sequence[float]], radius: float = 6.0) -> DataFrame:
        """(study_id) with a focus at most ``radius`` mm from one of the points."""
        near = F.lit(False)
        for x, y, z in peaks:
            box = F.col("x").between(x - radius, x + radius) & F.col("y").between(y - radius, y + radius) & F.col("z").between(z - radius, z + radius)
            square = (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y) + (F.col("z") - z) * (F.col("z") - z)
            near = near | (box & (F.sqrt(square) <= radius))
        return self.foci.where(near).select("study_id").distinct()

    def get_studies(self, features=None, expression: str | None = None, mask: DataFrame | None = None, peaks=None, frequency_threshold: float = 0.001, activation_threshold: float | int = 0.0, func: str | Callable = "sum", return_type: str = "ids", radius: float = 6.0) -> DataFrame:
        """The studies that meet every criterion given; ValueError without any.

        return_type: ``ids`` (study_id), ``data`` their voxels, ``weights`` (study_id, weight), with features alone.
        """
        if return_type not in ("ids", "data", "weights"):
            raise ValueError("return_type: ids, data or weights")
        if return_type == "weights" and (features is None or expression is not None or mask is not None or peaks is not None):
            raise ValueError("weights are of features alone")
        found = []
        if features is not None:
            found.append(self._features().study_weights(features, frequency_threshold, func))
            if return_type == "weights":
                return found[0]
        if expression is not None:
            found.append(self._features().ids_by_expression(expression, frequency_threshold, func))
        if mask is not None:
            found.append(self.by_region(mask, activation_threshold))
        if peaks is not None:
            found.append(self.by_peaks(peaks, radius))
        if not found:
            raise ValueError("give at least one of features, expression, mask and peaks")
        ids = reduce(lambda a, b: a.join(b, "study_id", "left_semi"), [f.select("study_id") for f in found])
        return self.image_data(ids) if return_type == "data" else ids

    def _features(self) -> FeatureTable:
        if self.features is None:
            raise ValueError("the data set has no features")
        return self.features

    # storage

    def save(self, path: str) -> None:
        """Parquet tables and a JSON description in a folder."""
        f = self.features
        tables = {"foci": self.foci, "volume": self.masker.volume.select("voxel_id"), "study_voxel": self.study_voxel}
        if f is not None:
            tables |= {"features": f.weights, "feature_names": f.names, "feature_studies": f.studies}
        tables |= {f"layer_{i}": t for i, t in enumerate(self.masker.layers.values())}
        g = self.grid
        store.save(path, tables, {"radius": self.radius, "layers": list(self.masker.layers), "dims": list(g.dims), "size": g.size, "origin": list(g.origin), "sign": list(g.sign), "features": f is not None})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Dataset:
        meta, table = store.load(spark, path)
        grid = Grid(tuple(meta["dims"]), meta["size"], tuple(meta["origin"]), tuple(meta["sign"]))
        masker = Masker(table("volume"), grid, {n: table(f"layer_{i}") for i, n in enumerate(meta["layers"])})
        features = FeatureTable(table("features"), table("feature_names"), table("feature_studies")) if meta["features"] else None
        return cls(table("foci"), masker, features, meta["radius"], grid, table("study_voxel"))
