"""Clustering voxels by the studies, the features or the coactivation they have."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..utils import cut, small
from .components import spread_components
from .dataset import Dataset
from .meta import evaluate


@dataclass(frozen=True)
class Clusterable:
    """A data set cut down for clustering.

    Studies with one of the features over the threshold; then voxels that at least ``min_studies`` of them activate;
    then studies with at least ``min_voxels`` of all voxels; last the voxels of ``mask`` (voxel_id).
    """

    dataset: Dataset
    mask: DataFrame | None = None
    features: str | Sequence[str] | None = None
    feature_threshold: float = 0.0
    min_voxels: int | None = None
    min_studies: int | None = None

    @cached_property
    def data(self) -> DataFrame:
        """(study_id, voxel_id)."""
        d = self.dataset
        # the whole grid matters only to how many voxels a study has
        rows = d.study_voxel if self.mask is None or self.min_voxels is not None else d.voxels_in(self.mask)
        if self.features is not None:
            rows = rows.join(d._features().study_weights(self.features, self.feature_threshold).select("study_id"), "study_id", "left_semi")
        voxels = studies = None
        if self.min_studies is not None:
            voxels = rows.groupBy("voxel_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= self.min_studies).select("voxel_id")
        if self.min_voxels is not None:
            studies = rows.groupBy("study_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= self.min_voxels).select("study_id")
        for keep, key in ((voxels, "voxel_id"), (studies, "study_id"), (self.mask, "voxel_id")):
            if keep is not None:
                rows = rows.join(keep.select(key).distinct(), key, "left_semi")
        return rows

    def transform(self, transformer, transpose: bool = False) -> np.ndarray:
        """``fit_transform`` of a driver-side object on the dense matrix of voxels by studies; for small masks."""
        rows = self.data.collect()
        voxels, studies = ({v: i for i, v in enumerate(sorted({r[c] for r in rows}))} for c in ("voxel_id", "study_id"))
        m = np.zeros((len(voxels), len(studies)))
        for r in rows:
            m[voxels[r.voxel_id], studies[r.study_id]] = 1
        return transformer.fit_transform(m.T if transpose else m)


#: Rows whose Gram matrix goes to the driver: 8 bytes times the square of them.
MAX_ROWS = 10_000


def study_components(data: DataFrame, n_components: int, max_studies: int = MAX_ROWS) -> DataFrame:
    """(study_id, c array<double>): principal components of studies by voxels, from the Gram matrix of the studies.

    The matrix of the voxels that up to ``max_studies`` studies have in common goes to the driver; more studies go to
    ``spread_components``.
    """
    ids = [r.study_id for r in data.select("study_id").distinct().orderBy("study_id").limit(max_studies + 1).collect()]
    if len(ids) > max_studies:
        return spread_components(data, n_components)
    place = {s: i for i, s in enumerate(ids)}
    a, b = data.select(F.col("study_id").alias("a"), "voxel_id"), data.select(F.col("study_id").alias("b"), "voxel_id")
    gram = np.zeros((len(ids), len(ids)))
    for r in a.join(b, "voxel_id").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():
        gram[place[r.a], place[r.b]] = r.n
    centre = np.eye(len(ids)) - 1 / max(1, len(ids))
    values, vectors = np.linalg.eigh(centre @ gram @ centre)
    order = np.argsort(values)[::-1][: min(n_components, len(ids))]
    scores = vectors[:, order] * np.sqrt(np.maximum(values[order], 0))
    return data.sparkSession.createDataFrame([(s, [float(x) for x in scores[i]]) for s, i in place.items()], "study_id string, c array<double>")


def independent(scores: np.ndarray, rounds: int = 200, seed: int = 0) -> np.ndarray:
    """Independent components of whitened columns by fixed-point iteration with tanh."""
    x = scores - scores.mean(axis=0)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    keep = s > 1e-9 * (s.max() if len(s) else 1)
    z = u[:, keep] * np.sqrt(len(x))
    k = z.shape[1]
    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(k, k)))[0]
    for _ in range(rounds):
        g = np.tanh(z @ w.T)
        new = g.T @ z / len(z) - np.diag((1 - g * g).mean(axis=0)) @ w
        a, _, b = np.linalg.svd(new)
        new = a @ b
        if np.abs(np.abs(np.einsum("ij,ij->i", new, w)) - 1).max() < 1e-6:
            w = new
            break
        w = new
    return z @ w.T


def _bounded(scores: DataFrame) -> list:
    """The rows of components, for a rotation on the driver."""
    rows = scores.limit(100 * MAX_ROWS + 1).collect()
    if len(rows) > 100 * MAX_ROWS:
        raise ValueError(f"over {100 * MAX_ROWS} rows to rotate")
    return rows


def _voxel_profile(roi: DataFrame, scores: DataFrame, metric: str) -> DataFrame:
    """(voxel_id, profile): the distance of each voxel's study vector to each component, over all studies with scores."""
    n, size = (scores.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("c")).alias("k")).first()[x] for x in ("n", "k"))
    long = scores.select("study_id", F.posexplode("c").alias("k", "v"))
    sums = long.groupBy("k").agg(F.sum("v").alias("sv"), F.sum(F.col("v") * F.col("v")).alias("svv"))
    counts = roi.join(scores.select("study_id"), "study_id", "left_semi").groupBy("voxel_id").agg(F.count(F.lit(1)).alias("m"))
    dots = roi.join(long, "study_id").groupBy("voxel_id", "k").agg(F.sum("v").alias("xv"))
    d = dots.join(F.broadcast(sums), "k").join(counts, "voxel_id")
    m, sv, svv, xv = F.col("m"), F.col("sv"), F.col("svv"), F.col("xv")
    distance = {
        "correlation": 1 - F.try_divide(n * xv - m * sv, F.sqrt(n * m - m * m) * F.sqrt(n * svv - sv * sv)),
        "cosine": 1 - F.try_divide(xv, F.sqrt(m.cast("double")) * F.sqrt(svv)),
        "euclidean": F.sqrt(F.greatest(m - 2 * xv + svv, F.lit(0.0))),
    }[metric]
    rows = d.select("voxel_id", "k", F.coalesce(distance, F.lit(1.0)).alias("v"))
    return rows.groupBy("voxel_id").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("p")).select("voxel_id", F.transform("p", lambda x: x["v"]).alias("profile"))


def _projected(data: DataFrame, n_components: int) -> DataFrame:
    """``study_components`` but for a shift, from the covariance of the columns ``voxel_id``, where these are few."""
    sums = {r.voxel_id: r.n for r in data.groupBy("voxel_id").agg(F.count(F.lit(1)).alias("n")).limit(MAX_ROWS + 1).collect()}
    if len(sums) > MAX_ROWS:
        raise ValueError(f"over {MAX_ROWS} voxels and studies")
    place = {v: i for i, v in enumerate(sorted(sums))}
    n = data.select("study_id").distinct().count()
    a, b = data.select("study_id", F.col("voxel_id").alias("a")), data.select("study_id", F.col("voxel_id").alias("b"))
    total = np.array([sums[v] for v in place], float)
    spread = -np.outer(total, total) / n
    for r in a.join(b, "study_id").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():
        spread[place[r.a], place[r.b]] += r.n
    axes = np.linalg.eigh(spread)[1][:, ::-1][:, :n_components]
    loads = data.sparkSession.createDataFrame([(v, [float(x) for x in axes[i]]) for v, i in place.items()], "voxel_id string, l array<double>")
    sums_of = data.join(loads, "voxel_id").select("study_id", F.posexplode("l").alias("k", "v")).groupBy("study_id", "k").agg(F.sum("v").alias("v"))
    return sums_of.groupBy("study_id").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("p")).select("study_id", F.transform("p", lambda x: x["v"]).alias("c"))


def _study_profile(roi: DataFrame, reduce_reference: str | None, n_components: int, seed: int) -> DataFrame:
    """(voxel_id, profile): principal or independent components of voxels by studies; with None all of the former,
    between which the distances are those between the voxels' own rows."""
    turned = roi.select(F.col("voxel_id").cast("string").alias("study_id"), F.col("study_id").alias("voxel_id"))
    limit = MAX_ROWS if reduce_reference is None else n_components
    if turned.select("study_id").distinct().limit(MAX_ROWS + 1).count() <= MAX_ROWS:
        scores = study_components(turned, limit)
    elif reduce_reference is not None and roi.select("study_id").distinct().limit(MAX_ROWS + 1).count() > MAX_ROWS:
        scores = spread_components(turned, limit)
    else:
        scores = _projected(turned, limit)
    if reduce_reference == "ica":
        rows = _bounded(scores)
        mixed = independent(np.array([r.c for r in rows]), seed=seed)
        scores = scores.sparkSession.createDataFrame([(r.study_id, [float(x) for x in t]) for r, t in zip(rows, mixed)], "study_id string, c array<double>")
    return scores.select(F.col("study_id").cast(roi.schema["voxel_id"].dataType).alias("voxel_id"), F.col("c").alias("profile"))


def magic(dataset: Dataset, method: str = "coactivation", roi_mask: DataFrame | None = None, coactivation_mask: DataFrame | None = None, features=None, feature_threshold: float = 0.05, min_voxels_per_study: int | None = None, min_studies_per_voxel: int | None = None, reduce_reference: str | None = "pca", n_components: int = 100, distance_metric: str = "correlation", algorithm: str = "kmeans", n_clusters: int = 5, seed: int = 0) -> DataFrame:
    """(voxel_id, cluster): clusters from 1 of the voxels of ``roi_mask``.

    coactivation: by the distances of a voxel's studies to the components (``pca``, ``ica`` or None: the studies' own
    reduced scores without rotation) of the studies over ``coactivation_mask``.  features: by the mean feature weights
    of a voxel's studies.  studies: by the components of the voxels over their studies, or by the studies as they are
    (``reduce_reference`` None); there, voxels or studies must be at most ``MAX_ROWS``.  coactivation reduces with None
    too.  ``ica`` turns at most 100 * ``MAX_ROWS`` rows of components, on the driver.  k-means only; ``minik`` means the same, as Spark has no batches.
    """
    if algorithm not in ("kmeans", "minik"):
        raise ValueError("algorithm: kmeans or minik")
    roi = Clusterable(dataset, roi_mask, features, feature_threshold, min_voxels_per_study, min_studies_per_voxel).data
    if method == "coactivation":
        reference = Clusterable(dataset, coactivation_mask, features, feature_threshold, min_voxels_per_study, min_studies_per_voxel).data
        scores = study_components(reference, n_components)
        if reduce_reference == "ica":
            rows = _bounded(scores)
            turned = independent(np.array([r.c for r in rows]), seed=seed)
            scores = scores.sparkSession.createDataFrame([(r.study_id, [float(x) for x in t]) for r, t in zip(rows, turned)], "study_id string, c array<double>")
        points = _voxel_profile(roi, scores, distance_metric)
    elif method == "features":
        f = dataset._features()
        n = dataset.studies.count()
        roi = cut(roi)  # read three times
        w = f.weights.join(small(roi.select("study_id").distinct()), "study_id", "left_semi").join(f.names, "feature").select("study_id", F.col("ordinal").alias("k"), "weight")
        mean = roi.join(w, "study_id").groupBy("voxel_id", "k").agg((F.sum("weight") / n).alias("v"))
        size = f.names.count()
        pairs = mean.groupBy("voxel_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
        points = roi.select("voxel_id").distinct().join(pairs, "voxel_id", "left").select("voxel_id", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("profile"))
    elif method == "studies":
        points = _study_profile(roi, reduce_reference, n_components, seed)
    else:
        raise ValueError("method: coactivation, features or studies")
    vectors = cut(points).select("voxel_id", array_to_vector("profile").alias("features"))  # read by each pass and by the model
    model = KMeans(k=n_clusters, seed=seed).fit(vectors)
    return model.transform(vectors).select("voxel_id", (F.col("prediction") + 1).alias("cluster"))


def coactivation_by_cluster(dataset: Dataset, clusters: DataFrame, threshold: float = 0.1, q: float = 0.01) -> DataFrame:
    """(cluster, voxel_id, the nine images): for each cluster, studies that activate over ``threshold`` of it against the others.

    All clusters in one job; background (cluster 0) is none.
    """
    c = clusters.where("cluster <> 0").select("cluster", "voxel_id").join(dataset.masker.volume.select("voxel_id"), "voxel_id", "left_semi")
    sizes = c.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    n = dataset.study_voxel.join(small(c), "voxel_id").groupBy("cluster", "study_id").agg(F.count(F.lit(1)).alias("n"))
    chosen = n.join(sizes, "cluster").where(F.try_divide("n", "size") > threshold).select("cluster", "study_id")
    active = dataset.study_voxel.join(chosen, "study_id").groupBy("cluster", "voxel_id").agg(F.count(F.lit(1)).alias("n_sa"))
    total = dataset.study_voxel.groupBy("voxel_id").agg(F.count(F.lit(1)).alias("n_a"))
    studies = dataset.studies.agg(F.count(F.lit(1)).alias("n"))
    of = sizes.select("cluster").join(chosen.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_s")), "cluster", "left").fillna(0, ["n_s"]).join(F.broadcast(studies))
    every = dataset.masker.volume.select("voxel_id").join(total, "voxel_id", "left").fillna(0, ["n_a"]).join(small(of))
    table = every.join(active, ["cluster", "voxel_id"], "left").fillna(0, ["n_sa"])
    table = table.select("cluster", "voxel_id", "n_sa", (F.col("n_a") - F.col("n_sa")).alias("n_ua"), "n_a", "n_s", (F.col("n") - F.col("n_s")).alias("n_u"))
    return evaluate(table, q, 0.5, 1, ["cluster"])


