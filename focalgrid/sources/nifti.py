"""Images: tables (image_id, voxel_id, value) from and to single-file NIfTI-1."""

from __future__ import annotations

import gzip
import struct
import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import Grid
from ..functions.stats import clean

#: NIfTI-1 data type codes.
DTYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}


def decode(content: bytes) -> np.ndarray:
    """The scaled values of a file, as an array of its dimensions."""
    data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    order = "<" if struct.unpack("<i", data[:4])[0] == 348 else ">"
    dim = struct.unpack(f"{order}8h", data[40:56])
    code = struct.unpack(f"{order}h", data[70:72])[0]
    offset, slope, inter = struct.unpack(f"{order}3f", data[108:120])
    if code not in DTYPES:
        raise ValueError(f"NIfTI data type {code}")
    shape = dim[1 : 1 + dim[0]]
    values = np.frombuffer(data, order + DTYPES[code], int(np.prod(shape)), int(offset)).astype(float)
    return (values * slope + inter if slope else values).reshape(shape, order="F")


def encode(values: np.ndarray, size: float, origin=(0.0, 0.0, 0.0), sign=(1, 1, 1), dtype: str = "f8") -> bytes:
    """A gzip NIfTI-1 file; cal_min and cal_max are the least and the largest value."""
    code = next(k for k, v in DTYPES.items() if v == dtype)
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, values.ndim, *values.shape, *[1] * (7 - values.ndim))
    struct.pack_into("<2h", head, 70, code, np.dtype(dtype).itemsize * 8)
    struct.pack_into("<8f", head, 76, 1.0, size, size, size, 1, 1, 1, 1)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    struct.pack_into("<2f", head, 124, float(values.max()), float(values.min()))
    struct.pack_into("<2h", head, 252, 0, 1)
    for i in range(3):
        row = [0.0] * 4
        row[i], row[3] = sign[i] * size, -sign[i] * size * origin[i]
        struct.pack_into("<4f", head, 280 + 16 * i, *row)
    head[344:348] = b"n+1\0"
    return gzip.compress(bytes(head) + values.astype("<" + dtype).tobytes(order="F"))


def read(spark: SparkSession, paths, nan_to_num: bool = True) -> DataFrame:
    """(image_id, voxel_id, value) of the non-zero voxels of files; image_id is the path."""

    def run(frames):
        import pandas as pd

        for f in frames:
            for path, content in zip(f["path"], f["content"]):
                flat = decode(content).ravel()
                at = np.flatnonzero(flat != 0)
                yield pd.DataFrame({"image_id": path, "voxel_id": at.astype("int32"), "value": flat[at]})

    found = spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, "image_id string, voxel_id int, value double")
    return found.withColumn("value", clean(F.col("value"))) if nan_to_num else found


def export(image: DataFrame, path: str, grid: Grid = Grid()) -> None:
    """One image (voxel_id, value) as a local .nii.gz file, written by the driver; an image is bounded by its grid."""
    out = np.zeros(grid.n)
    for r in image.select("voxel_id", "value").toLocalIterator():
        out[r.voxel_id] = r.value
    with open(path, "wb") as f:
        f.write(encode(out.reshape(grid.dims), grid.size, grid.origin, grid.sign))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
