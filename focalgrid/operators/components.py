"""Principal components of a sparse 0/1 table too large for a square matrix on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..utils import cut


def _names(k: int) -> list[str]:
    return [f"v{i}" for i in range(k)]


def _sums(rows: DataFrame, table: DataFrame, by: str, to: str, k: int) -> DataFrame:
    """(to, size, v0 ..): the sums over each ``to`` of the vectors of its ``by``, and how many there are."""
    return rows.join(table.select(by, *_names(k)), by).groupBy(to).agg(F.count(F.lit(1)).alias("size"), *(F.sum(c).alias(c) for c in _names(k)))


def _gram(table: DataFrame, k: int) -> np.ndarray:
    """The products of the columns; k * k numbers come to the driver, from each partition one row each."""

    def part(batches, k=k):
        import pandas as pd

        total = np.zeros((k, k))
        for b in batches:
            x = b.to_numpy(float)
            total += x.T @ x
        i, j = np.indices((k, k))
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    out = np.zeros((k, k))
    for r in table.select(*_names(k)).mapInPandas(part, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = r.v
    return (out + out.T) / 2


def _turned(table: DataFrame, keep: list[str], matrix: np.ndarray) -> DataFrame:
    """(keep, v0 ..): the vectors times ``matrix``, which has a row for each of them."""
    k, new = matrix.shape
    schema = ", ".join([*(f"`{c}` {table.schema[c].dataType.simpleString()}" for c in keep), *(f"{c} double" for c in _names(new))])

    def turn(batches, matrix=matrix):
        import pandas as pd

        for b in batches:
            v = pd.DataFrame(b[_names(k)].to_numpy(float) @ matrix, columns=_names(new), index=b.index)
            yield pd.concat([b[keep], v], axis=1)

    return table.select(*keep, *_names(k)).mapInPandas(turn, schema)


def spread_components(data: DataFrame, n_components: int, extra: int = 10, power: int = 2) -> DataFrame:
    """(study_id, c array<double>): principal components of studies by voxels, by subspace iteration from random signs.

    ``data`` has distinct (study_id, voxel_id).  Each round sums voxel vectors by study, centres them, and sums them back
    by voxel; only matrices of (n_components + extra) squared reach the driver.  Components whose variance is well
    over the next ones' are exact to rounding; near-equal ones at the end may be mixed, less so with more ``power``.
    Fewer come back if the rank is less.  An empty table gives an empty result.
    """
    data = cut(data.select("study_id", "voxel_id"))
    n = data.select("study_id").distinct().count()
    k = n_components + extra
    signs = (F.when(F.xxhash64("voxel_id", F.lit(i)) % 2 == 0, 1.0).otherwise(-1.0).alias(c) for i, c in enumerate(_names(k)))
    v = data.groupBy("voxel_id").agg(F.count(F.lit(1)).alias("size")).select("voxel_id", "size", *signs)

    def centred(v: DataFrame, k: int) -> DataFrame:
        mean = v.agg(*(F.sum(F.col("size") * F.col(c)).alias(c) for c in _names(k))).first()
        y = _sums(data, v, "voxel_id", "study_id", k)
        return y.select("study_id", *((F.col(c) - F.lit((mean[c] or 0.0) / max(1, n))).alias(c) for c in _names(k)))

    for _ in range(power + 1):
        z = cut(_sums(data, centred(v, k), "study_id", "voxel_id", k))
        values, vectors = np.linalg.eigh(_gram(z, k))
        some = values > 1e-13 * max(values.max(), 1e-300)
        if not some.any():
            return data.select("study_id").distinct().select("study_id", F.array().cast("array<double>").alias("c"))
        v = _turned(z, ["voxel_id", "size"], vectors[:, some] / np.sqrt(values[some]))
        k = int(some.sum())
    y = cut(centred(v, k))
    axes = np.linalg.eigh(_gram(y, k))[1][:, ::-1][:, :n_components]
    out = _turned(y, ["study_id"], axes)
    return out.select("study_id", F.array(*_names(axes.shape[1])).alias("c"))
