"""Grids of voxels, coordinate transforms and sphere kernels, as columns.

A voxel has grid indices (xi, yj, zk) and the id (xi * ny + yj) * nz + zk.  Points are in millimetres.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """A regular grid: index = origin + sign * coordinate / size, rounded half to even."""

    dims: tuple[int, int, int] = (91, 109, 91)
    size: float = 2.0
    origin: tuple[float, float, float] = (45.0, 63.0, 36.0)
    sign: tuple[int, int, int] = (-1, 1, 1)

    @property
    def n(self) -> int:
        return math.prod(self.dims)

    def voxel_id(self, xi: Column, yj: Column, zk: Column) -> Column:
        return ((xi * self.dims[1] + yj) * self.dims[2] + zk).cast("int")

    def indices(self, voxel_id: Column) -> tuple[Column, Column, Column]:
        ny, nz = self.dims[1:]
        return (voxel_id / (ny * nz)).cast("int"), ((voxel_id / nz).cast("int") % ny).cast("int"), (voxel_id % nz).cast("int")

    def to_index(self, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
        """Grid indices of a point; they may lie outside the grid."""
        return tuple(F.rint(F.lit(o) + s * c / self.size).cast("int") for o, s, c in zip(self.origin, self.sign, (x, y, z)))

    def to_point(self, xi: Column, yj: Column, zk: Column) -> tuple[Column, Column, Column]:
        """The point at a voxel's centre."""
        return tuple(F.rint(s * (i - o) * self.size).cast("int") for o, s, i in zip(self.origin, self.sign, (xi, yj, zk)))

    def inside(self, xi: Column, yj: Column, zk: Column) -> Column:
        ok = F.lit(True)
        for i, n in zip((xi, yj, zk), self.dims):
            ok = ok & (i >= 0) & (i < n)
        return ok

    def voxels(self, spark: SparkSession) -> DataFrame:
        """voxel_id, xi, yj, zk of the whole grid."""
        v = F.col("id").cast("int")
        return spark.range(self.n).select(v.alias("voxel_id"), *(c.alias(n) for n, c in zip(("xi", "yj", "zk"), self.indices(v))))


#: The forward Lancaster transform from MNI to Talairach space, row by row.
LANCASTER = (
    (0.9254, 0.0024, -0.0118, -1.0207),
    (-0.0048, 0.9316, -0.0871, -1.7667),
    (0.0152, 0.0883, 0.8924, 4.0926),
    (0.0, 0.0, 0.0, 1.0),
)


def apply_matrix(matrix: np.ndarray, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """The point that a stored 4 x 4 matrix (rows act on columns x, y, z, 1) maps to (x, y, z): its pseudo-inverse applied."""
    t = np.linalg.pinv(np.asarray(matrix, float))
    return tuple(float(t[r][0]) * x + float(t[r][1]) * y + float(t[r][2]) * z + float(t[r][3]) for r in range(3))


@dataclass(frozen=True)
class Transforms:
    """Named transforms into a target space; a space without one passes through."""

    target: str = "MNI"
    matrices: Mapping[str, object] = field(default_factory=lambda: {"T88": LANCASTER, "TAL": LANCASTER})

    def add(self, name: str, matrix) -> Transforms:
        return Transforms(self.target, {**self.matrices, name: matrix})

    def apply(self, space: Column, x: Column, y: Column, z: Column, truncate: bool = False) -> tuple[Column, Column, Column]:
        """The point in the target space.  truncate: moved coordinates lose their fraction, as integer ones do."""
        out = [x, y, z]
        for name, matrix in self.matrices.items():
            if name == self.target:
                continue
            moved = apply_matrix(matrix, x, y, z)
            if truncate:
                moved = [m.cast("long").cast("double") for m in moved]
            out = [F.when(space == name, m).otherwise(o) for m, o in zip(moved, out)]
        return tuple(out)


def kernel(radius: float, grid: Grid) -> list[tuple[float, float, float]]:
    """Offsets, in voxels, of a cube of step 1 from -radius / size whose length in mm is at most ``radius``."""
    reach = radius / grid.size
    steps = np.arange(-reach, reach + 1e-9, 1.0).tolist()
    return [o for o in itertools.product(steps, repeat=3) if math.sqrt(sum((grid.size * c) ** 2 for c in o)) <= radius]


def kernel_column(radius: float, grid: Grid) -> Column:
    """The kernel as one constant array of structs, so that stamping needs no join.  Catalyst folds it into a literal.

    Offsets are ints if all are whole, else doubles.
    """
    offsets = kernel(radius, grid)
    whole = all(c == int(c) for o in offsets for c in o)
    text = (lambda c: str(int(c))) if whole else (lambda c: f"{c!r}D")
    return F.expr("array(" + ",".join(f"named_struct('dx',{text(a)},'dy',{text(b)},'dz',{text(c)})" for a, b, c in offsets) + ")")


def stamp(foci: DataFrame, radius: float, grid: Grid) -> DataFrame:
    """Distinct (study_id, voxel_id) of the grid's voxels within ``radius`` mm of a study's foci.

    Foci are dealt by study before the kernel multiplies them, so that the voxels need no shuffle of their own.  They
    are made distinct first: a study then has at most as many as the grid (with its rim) has voxels, however often its
    foci repeat.
    """
    places = foci.select("study_id", "xi", "yj", "zk").distinct().repartition("study_id")
    # a null index is outside; columns that can't be null keep the stage's code short enough to be compiled
    outside = -4 * max(grid.dims) - 4 * math.ceil(radius / grid.size)
    places = places.select("study_id", *(F.coalesce(c, F.lit(outside)).alias(c) for c in ("xi", "yj", "zk")))
    offsets = places.select("study_id", "xi", "yj", "zk", F.explode(kernel_column(radius, grid)).alias("o"))
    whole = all(c == int(c) for o in kernel(radius, grid) for c in o)

    def moved(i: str, d: str) -> Column:
        at = F.col(i) + F.col(f"o.{d}")
        return at if whole else F.rint(at).cast("int")

    xi, yj, zk = moved("xi", "dx"), moved("yj", "dy"), moved("zk", "dz")
    return offsets.where(grid.inside(xi, yj, zk)).select("study_id", grid.voxel_id(xi, yj, zk).alias("voxel_id")).distinct()


def grid_cell(i: Column, n: int, scale: int) -> Column:
    """The cell of an axis that an index falls in; cells past the far edge wrap to the first."""
    cell = F.floor((i + scale // 2) / scale)
    return F.when(cell >= math.ceil(n / scale), F.lit(0)).otherwise(cell)


def grid_label(grid: Grid, xi: Column, yj: Column, zk: Column, scale: int) -> Column:
    """1 + the number of the cubic cell of ``scale`` voxels that a voxel falls in, x slowest."""
    ny, nz = (math.ceil(n / scale) for n in grid.dims[1:])
    cx, cy, cz = (grid_cell(i, n, scale) for i, n in zip((xi, yj, zk), grid.dims))
    return (1 + (cx * ny + cy) * nz + cz).cast("int")
