"""Meta-analysis: contrasts of voxel counts between sets of studies."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from .dataset import Dataset


def image_names(q: float, prior: float) -> list[str]:
    """The nine images of an analysis, in order."""
    return ["pA", "pAgF", "pFgA", f"pA_given_pF={prior:0.2f}", f"pFgA_given_pF={prior:0.2f}", "uniformity-test_z", "association-test_z", f"uniformity-test_z_FDR_{q}", f"association-test_z_FDR_{q}"]


def counts(dataset: Dataset, flags: DataFrame, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Voxel counts and set sizes.

    ``flags`` (keys.., study_id, s, u): whether a study is selected and unselected, in the analysis of the keys.  Gives
    (keys.., voxel_id, n_sa, n_ua, n_a) of the voxels that a flagged study activates, and (keys.., n_s, n_u).
    """
    one = F.count_if
    voxels = dataset.study_voxel.join(flags, "study_id").groupBy(*keys, "voxel_id").agg(one(F.col("s")).alias("n_sa"), one(F.col("u")).alias("n_ua"), F.count(F.lit(1)).alias("n_a"))
    sizes = flags.groupBy(*keys).agg(one(F.col("s")).alias("n_s"), one(F.col("u")).alias("n_u")) if keys else flags.agg(one(F.col("s")).alias("n_s"), one(F.col("u")).alias("n_u"))
    return voxels, sizes


@dataclass(frozen=True)
class MetaAnalysis:
    """``ids`` (study_id) against ``ids2``, or against all other studies; ids of no study are ignored.

    A study in both sets counts in both.  Where a value isn't defined the images hold nulls: pFgA where no study is
    active, all uniformity images if no selected study is active at all.
    """

    dataset: Dataset
    ids: DataFrame
    ids2: DataFrame | None = None
    q: float = 0.01
    prior: float = 0.5
    min_studies: int | float = 1

    @cached_property
    def flags(self) -> DataFrame:
        """(study_id, s, u) of the studies of either set."""
        def marked(ids: DataFrame, name: str) -> DataFrame:
            return ids.select("study_id").distinct().withColumn(name, F.lit(True))

        d = self.dataset.studies.join(marked(self.ids, "s"), "study_id", "left")
        d = d.join(marked(self.ids2, "u"), "study_id", "left") if self.ids2 is not None else d.withColumn("u", F.col("s").isNull())
        d = d.select("study_id", F.coalesce("s", F.lit(False)).alias("s"), F.coalesce("u", F.lit(False)).alias("u"))
        return d.where("s or u")

    def counts(self) -> DataFrame:
        """(voxel_id, n_sa, n_ua, n_a, n_s, n_u) of every voxel of the volume, zeros filled in."""
        found, sizes = counts(self.dataset, self.flags)
        n = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_sa", "n_ua", "n_a")]
        return self.dataset.masker.volume.select("voxel_id").join(found, "voxel_id", "left").select("voxel_id", *n).join(F.broadcast(sizes))

    def images(self) -> DataFrame:
        """voxel_id and the nine images, named as in ``image_names``."""
        return evaluate(self.counts(), self.q, self.prior, self.min_studies)

    def save(self, path: str, prefix: str = "", separator: str = "_", images: Sequence[str] | None = None) -> None:
        """One Parquet folder an image, ``prefix`` + ``separator`` + name; no separator without a prefix."""
        found = self.images().cache()
        for name in images or image_names(self.q, self.prior):
            label = f"{prefix}{separator}{name}" if prefix else name
            found.select("voxel_id", F.col(f"`{name}`").alias("value")).write.mode("overwrite").parquet(f"{path}/{label}")
        found.unpersist()


def evaluate(table: DataFrame, q: float, prior: float, min_studies: int | float, keys: Sequence[str] = ()) -> DataFrame:
    """The nine images from counts (keys.., voxel_id, n_sa, n_ua, n_a, n_s, n_u) of every voxel.

    p depends on the counts alone, so each test ranks the distinct counts, however many voxels share them.
    """
    from pyspark.sql import Window

    k = list(keys)
    n_sa, n_ua, n_s, n_u = (F.col(c).cast("double") for c in ("n_sa", "n_ua", "n_s", "n_u"))
    pairs = table.groupBy(*k, "n_sa", "n_ua", "n_s", "n_u").agg(F.count(F.lit(1)).alias("w"))
    everything = Window.partitionBy(*k)
    mean = F.try_divide(F.sum(F.col("n_sa") * F.col("w")).over(everything).cast("double"), F.sum("w").over(everything))
    pairs = pairs.withColumn("mean", mean)
    uniform = F.when(F.col("mean") > 0, stats.one_way(n_sa, n_s, F.col("mean")))
    related = F.when((n_s > 0) & (n_u > 0), stats.two_way(n_sa, n_ua, n_s - n_sa, n_u - n_ua))
    pairs = pairs.withColumn("chi_u", uniform).withColumn("chi_a", related)
    pairs = pairs.withColumn("p_u", stats.chi2_p(F.col("chi_u"))).withColumn("p_a", stats.chi2_p(F.col("chi_a")))
    for t in ("u", "a"):
        # the rank of the last of equal p: a range frame ends with its peers
        upto = Window.partitionBy(*k).orderBy(F.col(f"p_{t}").asc_nulls_last()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        pairs = pairs.withColumn(f"rank_{t}", F.sum("w").over(upto)).withColumn(f"all_{t}", F.sum("w").over(everything))
        ok = F.when(F.col(f"p_{t}") <= F.col(f"rank_{t}") * q / F.col(f"all_{t}"), F.col(f"p_{t}"))
        pairs = pairs.withColumn(f"limit_{t}", F.coalesce(F.max(ok).over(everything), F.lit(-1.0)))
    z_u = stats.signed_z(F.col("chi_u"), n_sa - F.col("mean"))
    z_a = stats.signed_z(F.col("chi_a"), F.try_divide(n_sa, n_s) - F.try_divide(n_ua, n_u))
    pairs = pairs.select(*k, "n_sa", "n_ua", "n_s", "n_u", z_u.alias("z_u"), z_a.alias("z_a"), *(F.when(F.col(f"p_{t}") <= F.col(f"limit_{t}"), 1.0).when(F.col(f"p_{t}").isNotNull(), 0.0).alias(f"in_{t}") for t in "ua"))

    joined = table.join(pairs, [*k, "n_sa", "n_ua", "n_s", "n_u"])
    n = n_s + n_u
    given, other = F.try_divide(n_sa, n_s), F.try_divide(n_ua, n_u)
    p_a = F.try_divide(F.col("n_a").cast("double"), n)
    p_f = F.try_divide(n_s, n)
    mixed = prior * given + (1 - prior) * other
    values = [p_a, given, F.try_divide(given * p_f, p_a), mixed, F.try_divide(given * prior, mixed), F.col("z_u"), F.col("z_a"), F.col("z_u") * F.col("in_u"), F.col("z_a") * F.col("in_a")]
    least = F.lit(float(min_studies)) if isinstance(min_studies, float) else min_studies / n

    def kept(v: Column) -> Column:
        return F.when(p_a < least, F.lit(0.0)).otherwise(v)

    return joined.select(*k, "voxel_id", *(kept(v).alias(name) for v, name in zip(values, image_names(q, prior))))


def feature_counts(dataset: Dataset, features: Sequence[str], threshold: float = 0.001) -> DataFrame:
    """(feature, voxel_id, n_sa, n_ua, n_a, n_s, n_u) of every feature and voxel, in one job.

    Only selected studies are joined with the voxels, by feature; what is unselected is the rest of the total.
    """
    names = dataset._features().search(list(features))
    w = dataset._features().weights
    chosen = w.where(F.col("feature").isin(names) & (F.col("weight") >= threshold)).select("study_id", "feature").join(dataset.studies, "study_id", "left_semi")
    active = dataset.study_voxel.join(chosen, "study_id").groupBy("feature", "voxel_id").agg(F.count(F.lit(1)).alias("n_sa"))
    total = dataset.study_voxel.groupBy("voxel_id").agg(F.count(F.lit(1)).alias("n_a"))
    studies = dataset.studies.agg(F.count(F.lit(1)).alias("n"))
    sizes = dataset._features().names.where(F.col("feature").isin(names)).select("feature").join(chosen.groupBy("feature").agg(F.count(F.lit(1)).alias("n_s")), "feature", "left").fillna(0, ["n_s"])
    every = dataset.masker.volume.select("voxel_id").join(total, "voxel_id", "left").fillna(0, ["n_a"]).join(F.broadcast(sizes.join(F.broadcast(studies))))
    out = every.join(active, ["feature", "voxel_id"], "left").fillna(0, ["n_sa"])
    return out.select("feature", "voxel_id", "n_sa", (F.col("n_a") - F.col("n_sa")).alias("n_ua"), "n_a", "n_s", (F.col("n") - F.col("n_s")).alias("n_u"))


def analyze_features(dataset: Dataset, features: Sequence[str], image_type: str | None = "association-test_z", threshold: float = 0.001, q: float = 0.01, prior: float = 0.5) -> DataFrame:
    """(feature, voxel_id, value) of one image of the analysis of each feature; with ``image_type`` None all nine, wide."""
    found = evaluate(feature_counts(dataset, features, threshold), q, prior, 1, ["feature"])
    return found if image_type is None else found.select("feature", "voxel_id", F.col(f"`{image_type}`").alias("value"))
