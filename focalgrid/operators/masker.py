"""Masks: a base volume and named layers over it, all as tables of voxels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Grid
from ..functions.stats import clean
from ..utils import small


def cut(value: Column, above: float | None = None, below: float | None = None) -> Column:
    """0 where the value is under ``above`` or over ``below``."""
    out = value
    if above is not None:
        out = F.when(value < above, F.lit(0.0)).otherwise(out)
    if below is not None:
        out = F.when(value > below, F.lit(0.0)).otherwise(out)
    return out


@dataclass(frozen=True)
class Masker:
    """``volume`` (voxel_id): the valid voxels.  ``layers``: name to a table (voxel_id, value), in the order they came.

    A masker never changes; each method gives a new one.  The tables are bounded by the grid, so joins with them may
    broadcast.
    """

    volume: DataFrame
    grid: Grid = Grid()
    layers: Mapping[str, DataFrame] = field(default_factory=dict)

    def add(self, layers, above: float | None = None, below: float | None = None) -> Masker:
        """With more layers: a mapping by name, or one or more tables, which get the names layer_0, layer_1 ..."""
        found = dict(self.layers)
        if not isinstance(layers, Mapping):
            layers = layers if isinstance(layers, (list, tuple)) else [layers]
            layers = {f"layer_{len(found) + i}": x for i, x in enumerate(layers)}
        for name, image in layers.items():
            found[name] = image.select("voxel_id", cut(F.col("value").cast("double"), above, below).alias("value"))
        return replace(self, layers=found)

    def remove(self, layers) -> Masker:
        """Without layers, by name or by place, also from the end; ValueError if there is none of the name."""
        found = dict(self.layers)
        for x in layers if isinstance(layers, (list, tuple)) else [layers]:
            if isinstance(x, int):
                x = list(self.layers)[x]
            if x not in found:
                raise ValueError(f"no layer {x!r}")
            del found[x]
        return replace(self, layers=found)

    def reset(self) -> Masker:
        return replace(self, layers={})

    def _chosen(self, layers: Sequence[str] | str | None) -> list[DataFrame]:
        names = self.layers if layers is None else [layers] if isinstance(layers, str) else layers
        return [self.layers[n] for n in names if n in self.layers]

    def mask(self, layers: Sequence[str] | str | None = None) -> DataFrame:
        """(voxel_id) of the valid voxels that are non-zero in all the layers; unknown names are ignored."""
        out = self.volume.select("voxel_id")
        for layer in self._chosen(layers):
            out = out.join(layer.where("value <> 0").select("voxel_id"), "voxel_id", "left_semi")
        return out

    def apply(self, image: DataFrame, layers=None, nan_to_num: bool = True, in_global_mask: bool = False) -> DataFrame:
        """An image (.., voxel_id, value) within the mask; with ``in_global_mask`` over all valid voxels, 0 outside the layers."""
        d = image.withColumn("value", clean(F.col("value")) if nan_to_num else F.col("value"))
        if not in_global_mask:
            return d.join(self.mask(layers), "voxel_id", "left_semi")
        inside = d.join(self.mask(layers), "voxel_id", "left_semi")
        return self.fill(inside, self.volume.select("voxel_id"))

    def fill(self, image: DataFrame, voxels: DataFrame) -> DataFrame:
        """Every image at every one of the voxels, zeros filled in."""
        keys = [c for c in image.columns if c not in ("voxel_id", "value")]
        if not keys:
            return voxels.join(image, "voxel_id", "left").select("voxel_id", F.coalesce("value", F.lit(0.0)).alias("value"))
        every = image.select(*keys).distinct().join(small(voxels))
        return every.join(image, [*keys, "voxel_id"], "left").select(*keys, "voxel_id", F.coalesce("value", F.lit(0.0)).alias("value"))

    def unmask(self, image: DataFrame, layers=None) -> DataFrame:
        """A masked image over the whole grid, zeros filled in."""
        inside = image.join(self.mask(layers), "voxel_id", "left_semi")
        return self.fill(inside, self.grid.voxels(image.sparkSession).select("voxel_id"))
