"""Decoding: how images relate to the maps of features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..utils import small
from .dataset import Dataset
from .meta import analyze_features
from .regions import average_within_regions

METHODS = ("pearson", "dot", "roi")


@dataclass(frozen=True)
class Decoder:
    """``maps`` (feature, voxel_id, value): non-zero values; ``voxels`` (voxel_id): all voxels that count, zeros too."""

    method: str = "pearson"
    maps: DataFrame | None = None
    voxels: DataFrame | None = None
    dataset: Dataset | None = None
    features: Sequence[str] | None = None

    def __post_init__(self):
        if self.method not in METHODS:
            raise ValueError(f"method: one of {METHODS}")

    def set_method(self, method: str) -> Decoder:
        return replace(self, method=method)

    @classmethod
    def from_dataset(cls, dataset: Dataset, features: Sequence[str] | None = None, method: str = "pearson", mask=None, image_type: str = "association-test_z", threshold: float = 0.001) -> Decoder:
        """Over the maps of the data set's features of these names; unknown names are left out.  ``mask``: a masker."""
        names = dataset._features().feature_names(features)
        voxels = (mask or dataset.masker).mask()
        if method == "roi":
            return cls(method, None, voxels, dataset, names)
        maps = analyze_features(dataset, names, image_type, threshold).where("value <> 0").join(voxels, "voxel_id", "left_semi")
        return cls(method, maps, voxels, dataset, names)

    @classmethod
    def from_images(cls, images: DataFrame, voxels: DataFrame, names: dict[str, str] | None = None, method: str = "pearson") -> Decoder:
        """Over images (image_id, voxel_id, value); ``names`` of all image ids, else ValueError."""
        name = F.col("image_id")
        if names is not None:
            missing = images.select("image_id").distinct().where(~F.col("image_id").isin(list(names)))
            if not missing.isEmpty():
                raise ValueError("names don't match the images")
            name = F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), name)
        return cls(method, images.select(name.alias("feature"), "voxel_id", "value").join(voxels, "voxel_id", "left_semi"), voxels)

    def decode(self, images: DataFrame, places: int = 4, value: str = "z", binarize: float | None = None) -> DataFrame:
        """(feature, image_id, value), rounded half to even."""
        found = {"pearson": self._pearson, "dot": self._dot}[self.method](images) if self.method != "roi" else self._roi(images, value, binarize)
        return found.select("feature", "image_id", F.bround(F.col("value"), places).alias("value"))

    def _pearson(self, images: DataFrame) -> DataFrame:
        """Over all voxels: sums of the non-zero ones suffice."""
        x = self.maps
        y = images.where("value <> 0").join(self.voxels, "voxel_id", "left_semi")
        n = self.voxels.agg(F.count(F.lit(1)).cast("double").alias("n"))
        sx = x.groupBy("feature").agg(F.sum("value").alias("sx"), F.sum(F.col("value") * F.col("value")).alias("sxx"))
        sy = y.groupBy("image_id").agg(F.sum("value").alias("sy"), F.sum(F.col("value") * F.col("value")).alias("syy"))
        sxy = self._products(x, y)
        # one row a feature and image: as many as the result
        every = sx.join(small(sy.join(F.broadcast(n)))).join(sxy, ["feature", "image_id"], "left")
        r = stats.correlation(F.col("sx"), F.col("sy"), F.col("sxx"), F.col("syy"), F.coalesce("sxy", F.lit(0.0)), F.col("n"))
        return every.select("feature", "image_id", r.alias("value"))

    def _products(self, x: DataFrame, y: DataFrame) -> DataFrame:
        a = x.select("feature", "voxel_id", F.col("value").alias("a"))
        return a.join(y.select("image_id", "voxel_id", F.col("value").alias("b")), "voxel_id").groupBy("feature", "image_id").agg(F.sum(F.col("a") * F.col("b")).alias("sxy"))

    def _dot(self, images: DataFrame) -> DataFrame:
        every = self.maps.select("feature").distinct().join(small(images.select("image_id").distinct()))
        found = self._products(self.maps, images.join(self.voxels, "voxel_id", "left_semi"))
        return every.join(found, ["feature", "image_id"], "left").select("feature", "image_id", F.coalesce("sxy", F.lit(0.0)).alias("value"))

    def _roi(self, images: DataFrame, value: str, binarize: float | None) -> DataFrame:
        """The correlation, over studies, of a region's activation and a feature's weight; or its Fisher z."""
        d = self.dataset
        names = images.select("image_id").distinct()
        regions = images.where("value <> 0").select(F.col("image_id").alias("region_id"), "voxel_id").join(self.voxels, "voxel_id", "left_semi")
        x = average_within_regions(d, regions, remove_zero=False).withColumn("value", F.col("value").cast("double"))
        w = d._features().weights.where(F.col("feature").isin(list(self.features))).join(d.studies, "study_id", "left_semi")
        if binarize is not None:
            w = w.withColumn("weight", stats.binarize(F.col("weight"), binarize)).where("weight <> 0")
        n = d.studies.agg(F.count(F.lit(1)).cast("double").alias("n"))
        sx = x.groupBy("region_id").agg(F.sum("value").alias("sx"), F.sum(F.col("value") * F.col("value")).alias("sxx"))
        sy = w.groupBy("feature").agg(F.sum("weight").alias("sy"), F.sum(F.col("weight") * F.col("weight")).alias("syy"))
        sxy = x.join(w, "study_id").groupBy("region_id", "feature").agg(F.sum(F.col("value") * F.col("weight")).alias("sxy"))
        every = sx.join(small(sy.join(F.broadcast(n)))).join(sxy, ["region_id", "feature"], "left")
        r = stats.correlation(F.col("sx"), F.col("sy"), F.col("sxx"), F.col("syy"), F.coalesce("sxy", F.lit(0.0)), F.col("n"))
        out = stats.fisher_z(r, F.col("n")) if value == "z" else r
        return every.select("feature", F.col("region_id").alias("image_id"), out.alias("value"))


def wide(decoded: DataFrame) -> DataFrame:
    """One row a feature, one column an image."""
    return decoded.groupBy("feature").pivot("image_id").agg(F.first("value"))


def top_features(decoded: DataFrame, n: int = 3) -> DataFrame:
    """The n features of each image with the largest values, with their rank."""
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc_nulls_last("value"), "feature"))
    return decoded.withColumn("rank", rank).where(F.col("rank") <= n)
