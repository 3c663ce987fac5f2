"""The engine's tables made from the driver's: for Spark, and the same as DuckDB SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import LANCASTER, Grid
from ..operators.dataset import Dataset
from ..operators.features import FeatureTable
from ..operators.masker import Masker

GRID = Grid()
RADIUS = 4.0
CENTRE, RADII = (45, 54, 40), (36, 44, 34)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def volume(spark: SparkSession) -> DataFrame:
    """(voxel_id, xi, yj, zk) of the voxels in an ellipsoid, by whole numbers."""
    a, b, c = RADII
    terms = [((F.col(n).cast("long") - m) * (F.col(n).cast("long") - m) * f * f) for n, m, f in zip(("xi", "yj", "zk"), CENTRE, (b * c, a * c, a * b))]
    return GRID.voxels(spark).where(terms[0] + terms[1] + terms[2] <= (a * b * c) ** 2)


def activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point for each line item."""
    k, s, q = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity").cast("long")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("id"),
        ((k * 37) % 131 - 65).cast("double").alias("x"),
        ((s * 53 + k * 11) % 161 - 95).cast("double").alias("y"),
        ((q * 7 + k * 3) % 121 - 45).cast("double").alias("z"),
        F.when(F.col("l_linestatus") == "F", "TAL").otherwise("MNI").alias("space"),
    )


def features(spark: SparkSession, sf_dir: str) -> FeatureTable:
    """The words of the names of an order's parts, and the names, by their share of the quantity."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("study_id"), "l_partkey", "l_quantity")
    parts = read(spark, sf_dir, "part").select("p_partkey", F.array_distinct(F.array_append(F.split("p_name", " "), F.col("p_name"))).alias("tokens"))
    per_part = lines.groupBy("study_id", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    tokens = per_part.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("study_id", F.explode("tokens").alias("feature"), "q")
    totals = lines.groupBy("study_id").agg(F.sum("l_quantity").alias("total"))
    weights = tokens.groupBy("study_id", "feature").agg(F.sum("q").alias("q")).join(totals, "study_id").select("study_id", "feature", (F.col("q") / (2 * F.col("total"))).alias("weight"))
    names = parts.select(F.explode("tokens").alias("feature")).distinct()
    from pyspark.sql import Window

    ordered = names.withColumn("ordinal", (F.row_number().over(Window.orderBy("feature")) - 1).cast("int"))
    return FeatureTable(weights, ordered, lines.select("study_id").distinct())


def dataset(spark: SparkSession, sf_dir: str, with_features: bool = True) -> Dataset:
    masker = Masker(volume(spark), GRID)
    return Dataset.from_activations(activations(spark, sf_dir), masker, radius=RADIUS, features=features(spark, sf_dir) if with_features else None)


def _moved(row: int) -> str:
    t = np.linalg.pinv(np.asarray(LANCASTER, float))[row]
    return f"({float(t[0])!r} * x + {float(t[1])!r} * y + {float(t[2])!r} * z + {float(t[3])!r})"


#: DuckDB: foci, voxels of the volume, study_voxel, features, study ids.
FOCI = f"""
    raw as (select cast(l_orderkey as varchar) as study_id, cast((l_partkey * 37) % 131 - 65 as double) as x,
        cast((l_suppkey * 53 + l_partkey * 11) % 161 - 95 as double) as y,
        cast((cast(l_quantity as bigint) * 7 + l_partkey * 3) % 121 - 45 as double) as z,
        case l_linestatus when 'F' then 'TAL' else 'MNI' end as space from lineitem),
    moved as (select study_id, case space when 'TAL' then {_moved(0)} else x end as x, case space when 'TAL' then {_moved(1)} else y end as y,
        case space when 'TAL' then {_moved(2)} else z end as z, space from raw),
    foci as (select *, cast(round_even(45 - x / 2, 0) as integer) as xi, cast(round_even(63 + y / 2, 0) as integer) as yj,
        cast(round_even(36 + z / 2, 0) as integer) as zk from moved),
    studies as (select distinct study_id from foci)"""
VOLUME = """
    vol as (select cast(range as integer) as voxel_id, cast(range // 9919 as integer) as xi, cast((range // 91) % 109 as integer) as yj, cast(range % 91 as integer) as zk
        from range(902629)
        where (range // 9919 - 45) * (range // 9919 - 45) * 2238016 + ((range // 91) % 109 - 54) * ((range // 91) % 109 - 54) * 1498176
            + (range % 91 - 40) * (range % 91 - 40) * 2509056 <= 53856::bigint * 53856)"""
VOXELS = (
    FOCI
    + ","
    + VOLUME
    + """,
    k as (select cast(a.range as integer) as dx, cast(b.range as integer) as dy, cast(c.range as integer) as dz from range(-2, 3) a, range(-2, 3) b, range(-2, 3) c
        where sqrt(4.0 * (a.range * a.range + b.range * b.range + c.range * c.range)) <= 4),
    st as (select distinct study_id, (xi + dx) * 9919 + (yj + dy) * 91 + zk + dz as voxel_id from foci, k
        where xi + dx between 0 and 90 and yj + dy between 0 and 108 and zk + dz between 0 and 90),
    sv as (select st.study_id, st.voxel_id from st join vol using (voxel_id))"""
)
FEATURES = """
    tok as (select p_partkey, unnest(list_distinct(list_append(string_split(p_name, ' '), p_name))) as feature from part),
    tot as (select cast(l_orderkey as varchar) as study_id, sum(l_quantity) as total from lineitem group by 1),
    fw as (select cast(l_orderkey as varchar) as study_id, feature, sum(l_quantity) / (2 * any_value(total)) as weight
        from lineitem join tok on l_partkey = p_partkey join tot on tot.study_id = cast(l_orderkey as varchar) group by 1, 2),
    fstudies as (select study_id from tot), fnames as (select distinct feature from tok)"""
