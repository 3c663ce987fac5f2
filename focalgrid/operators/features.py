"""The feature table: weights of features in studies, long and sparse."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from . import expression as ex

log = logging.getLogger(__name__)

FUNCTIONS = ("sum", "mean", "max", "min")


@dataclass(frozen=True)
class FeatureTable:
    """``weights`` (study_id, feature, weight), non-zero rows; ``names`` (feature, ordinal); ``studies`` (study_id).

    The last two keep the order of features, and the studies and features whose weights are all zero.
    """

    weights: DataFrame
    names: DataFrame
    studies: DataFrame

    @classmethod
    def from_wide(cls, wide: DataFrame, key: str | None = None) -> FeatureTable:
        """From one row a study and one column a feature; the first column, or ``key``, is the study."""
        key = key or wide.columns[0]
        columns = [c for c in wide.columns if c != key]
        spark = wide.sparkSession
        d = wide.select(F.col(f"`{key}`").cast("string").alias("study_id"), *(F.col(f"`{c}`").cast("double").alias(c) for c in columns))
        long = d.unpivot("study_id", columns, "feature", "weight") if columns else spark.createDataFrame([], "study_id string, feature string, weight double")
        names = spark.createDataFrame([(c, i) for i, c in enumerate(columns)], "feature string, ordinal int")
        return cls(long.where("weight <> 0"), names, d.select("study_id").distinct())

    @classmethod
    def from_long(cls, weights: DataFrame, studies: DataFrame | None = None) -> FeatureTable:
        """From (study_id, feature, weight) rows; features are ordered by name."""
        w = weights.select(F.col("study_id").cast("string").alias("study_id"), "feature", F.col("weight").cast("double").alias("weight"))
        ordered = w.select("feature").distinct().orderBy("feature").collect()  # the vocabulary of features, chosen by the user
        names = w.sparkSession.createDataFrame([(r.feature, i) for i, r in enumerate(ordered)], "feature string, ordinal int")
        return cls(w.where("weight <> 0"), names, (studies or w).select(F.col("study_id").cast("string").alias("study_id")).distinct())

    def feature_names(self, features: Sequence[str] | None = None) -> list[str]:
        """All names, or those given, in the table's order."""
        names = self.names if features is None else self.names.where(F.col("feature").isin(list(features)))
        return [r.feature for r in names.orderBy("ordinal").collect()]

    def search(self, search: str | Sequence[str]) -> list[str]:
        """Names that a pattern matches from start to end; ``*`` stands for any characters, other regular syntax holds."""
        patterns = [search] if isinstance(search, str) else list(search)
        if not patterns:
            return []
        test = [F.col("feature").rlike(f"^(?:{p.replace('*', '.*')})$") for p in patterns]
        ok = test[0]
        for t in test[1:]:
            ok = ok | t
        return [r.feature for r in self.names.where(ok).orderBy("ordinal").collect()]

    def _aggregate(self, features: Sequence[str], func: str) -> Column:
        """Per study, over all matched features with zeros for missing rows."""
        n, w = len(features), F.when(F.col("feature").isin(list(features)), F.col("weight"))
        if func == "sum" or n == 0:
            return F.coalesce(stats.exact_sum(w), F.lit(0.0)) if func == "sum" else F.lit(None).cast("double")
        if func == "mean":
            return F.coalesce(stats.exact_sum(w), F.lit(0.0)) / n
        edge, pick = (F.max, F.greatest) if func == "max" else (F.min, F.least)
        return F.when(F.count(w) == n, edge(w)).otherwise(pick(F.coalesce(edge(w), F.lit(0.0)), F.lit(0.0)))

    def study_weights(self, features: str | Sequence[str], threshold: float = 0.0, func: str | Callable = "sum") -> DataFrame:
        """(study_id, weight) of the studies whose aggregate over the matched features is at least the threshold."""
        names = self.search(features)
        if callable(func):
            out = self._apply(names, func)
        else:
            if func not in FUNCTIONS:
                raise ValueError(f"func: a callable or one of {FUNCTIONS}")
            some = self.weights.where(F.col("feature").isin(names)) if names else self.weights.limit(0)
            got = some.groupBy("study_id").agg(self._aggregate(names, func).alias("weight"))
            if threshold > 0 and func != "min":
                out = got
            else:
                empty = 0.0 if func == "sum" or names else None
                out = self.studies.join(got, "study_id", "left").withColumn("weight", F.coalesce("weight", F.lit(empty).cast("double")))
        return out.where(F.col("weight") >= threshold)

    def _apply(self, names: list[str], func: Callable) -> DataFrame:
        """Any function of a study's weights, by Arrow batches of dense rows."""
        order = {n: i for i, n in enumerate(names)}
        pairs = F.map_from_entries(F.collect_list(F.struct("feature", "weight"))).alias("m")
        got = self.studies.join(self.weights.where(F.col("feature").isin(names)).groupBy("study_id").agg(pairs), "study_id", "left")

        def run(frames):
            import pandas as pd

            for f in frames:
                rows = []
                for m in f["m"]:
                    dense = [0.0] * len(order)
                    for k, v in dict(m if m is not None else {}).items():
                        dense[order[k]] = v
                    rows.append(float(func(dense)))
                yield pd.DataFrame({"study_id": f["study_id"], "weight": rows})

        return got.mapInPandas(run, "study_id string, weight double")

    def ids_by_expression(self, text: str, threshold: float = 0.001, func: str = "sum") -> DataFrame:
        """(study_id, weight) of the studies an expression selects, by one aggregation of the weights."""
        tree = ex.parse(text)
        wanted = {leaf: self.search(leaf) for leaf in ex.leaves(tree)}
        aggregates, columns = [], {}
        for i, (leaf, names) in enumerate(wanted.items()):
            value = self._aggregate(names, func)
            aggregates.append(F.when(value >= threshold, value).alias(f"leaf_{i}"))
            columns[leaf] = F.col(f"leaf_{i}")
        every = sorted({n for names in wanted.values() for n in names})
        source = self.weights.where(F.col("feature").isin(every)) if every else self.weights.limit(0)
        if threshold <= 0 or func == "min":
            source = self.studies.select("study_id", F.lit(None).cast("string").alias("feature"), F.lit(None).cast("double").alias("weight")).unionByName(source)
        got = source.groupBy("study_id").agg(*aggregates)
        return got.select("study_id", ex.weigh(tree, columns, func).alias("weight")).where(F.col("weight").isNotNull())

    def counts(self, threshold: float = 0.001) -> DataFrame:
        """(feature, n): how many studies have at least the threshold; features of no study too."""
        got = self.weights.where(F.col("weight") >= threshold).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
        if threshold <= 0:
            under = self.weights.where(F.col("weight") < threshold).groupBy("feature").agg(F.count(F.lit(1)).alias("under"))
            total = self.studies.agg(F.count(F.lit(1)).alias("total"))
            return self.names.select("feature").join(under, "feature", "left").join(F.broadcast(total)).select("feature", (F.col("total") - F.coalesce("under", F.lit(0))).alias("n"))
        return self.names.select("feature").join(got, "feature", "left").select("feature", F.coalesce("n", F.lit(0)).alias("n"))

    def by_ids(self, ids: DataFrame, threshold: float = 0.0001, func: str = "mean") -> DataFrame:
        """(feature, weight) of the features whose aggregate over the given studies is at least the threshold."""
        ids = self.studies.join(ids.select(F.col("study_id").cast("string").alias("study_id")).distinct(), "study_id", "left_semi")
        total = ids.agg(F.count(F.lit(1)).alias("total"))
        some = self.weights.join(ids, "study_id", "left_semi")
        got = some.groupBy("feature").agg(F.sum("weight").alias("s"), F.count(F.lit(1)).alias("c"), F.max("weight").alias("hi"), F.min("weight").alias("lo"))
        row = self.names.select("feature").join(got, "feature", "left").join(F.broadcast(total))
        s = F.coalesce("s", F.lit(0.0))
        full = F.col("c") == F.col("total")
        value = {
            "sum": s,
            "mean": F.try_divide(s, F.col("total")),
            "max": F.when(full, F.col("hi")).otherwise(F.greatest(F.coalesce("hi", F.lit(0.0)), F.lit(0.0))),
            "min": F.when(full, F.col("lo")).otherwise(F.least(F.coalesce("lo", F.lit(0.0)), F.lit(0.0))),
        }[func]
        return row.select("feature", value.alias("weight")).where(F.col("weight") >= threshold)

    def data(self, ids: DataFrame | None = None, features: Sequence[str] | None = None, dense: bool = False) -> DataFrame:
        """The weights of some studies and features, long; with ``dense`` one column a feature, zeros filled in."""
        w, studies = self.weights, self.studies
        if ids is not None:
            ids = ids.select(F.col("study_id").cast("string").alias("study_id")).distinct()
            w, studies = w.join(ids, "study_id", "left_semi"), studies.join(ids, "study_id", "left_semi")
        if features is not None:
            w = w.where(F.col("feature").isin(list(features)))
        if not dense:
            return w
        names = self.feature_names(features)
        wide = w.groupBy("study_id").pivot("feature", names).agg(F.first("weight")) if names else studies
        return studies.join(wide, "study_id", "left").fillna(0.0, names)

    def add(self, new: FeatureTable, merge: str = "outer", duplicates: str = "ignore", min_studies: float = 0, threshold: float = 0.0001, append: bool = True, known: DataFrame | None = None) -> FeatureTable:
        """This table with another's features.

        merge: which studies stay (left, right, inner, outer).  duplicates: of features in both, ``ignore`` drops the
        new, ``replace`` the old, ``merge`` keeps both as name_x and name_y.  New features stay only with at least
        ``min_studies`` studies at or over the threshold.  ``known``: ids of which at least 1 % of the new should be.
        """
        if merge not in ("left", "right", "inner", "outer") or duplicates not in ("ignore", "replace", "merge"):
            raise ValueError("merge: left, right, inner or outer; duplicates: ignore, replace or merge")
        if min_studies:
            keep = new.counts(threshold).where(F.col("n") >= min_studies).select("feature")
            new = FeatureTable(new.weights.join(keep, "feature", "left_semi"), new.names.join(keep, "feature", "left_semi"), new.studies)
        if known is not None:
            row = new.studies.join(known.select("study_id").distinct().withColumn("known", F.lit(1)), "study_id", "left").agg(F.count("known").alias("k"), F.count(F.lit(1)).alias("n")).first()
            if row.n and row.k / row.n < 0.01:
                log.warning("less than 1%% of the new studies are in the image table: %d of %d", row.k, row.n)
        if not append:
            return new
        old_names, new_names = self.feature_names(), new.feature_names()
        both = [n for n in new_names if n in set(old_names)]
        old, fresh = self.weights, new.weights
        if duplicates == "ignore":
            fresh = fresh.where(~F.col("feature").isin(both)) if both else fresh
            order = old_names + [n for n in new_names if n not in both]
        elif duplicates == "replace":
            old = old.where(~F.col("feature").isin(both)) if both else old
            order = [n for n in old_names if n not in both] + new_names
        else:
            def named(end: str) -> Column:
                return F.when(F.col("feature").isin(both), F.concat("feature", F.lit(end))).otherwise(F.col("feature")) if both else F.col("feature")

            old, fresh = old.withColumn("feature", named("_x")), fresh.withColumn("feature", named("_y"))
            order = [n + "_x" * (n in both) for n in old_names] + [n + "_y" * (n in both) for n in new_names]
        a, b = self.studies, new.studies
        studies = {"left": a, "right": b, "inner": a.join(b, "study_id", "left_semi"), "outer": a.union(b).distinct()}[merge]
        weights = old.unionByName(fresh)
        if merge != "outer":
            weights = weights.join(studies, "study_id", "left_semi")
        names = weights.sparkSession.createDataFrame([(n, i) for i, n in enumerate(order)], "feature string, ordinal int")
        return FeatureTable(weights, names, studies)
