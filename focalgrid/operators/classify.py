"""Classification of studies by the regions they activate."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import UnivariateFeatureSelector
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dataset import Dataset


def feature_order(dataset: Dataset, features: Sequence[str]) -> list[int]:
    """The places of the names in the data set's order."""
    order = {n: i for i, n in enumerate(dataset._features().feature_names())}
    return [order[f] for f in features]


def studies_by_regions(dataset: Dataset, masks: Sequence[DataFrame], threshold: float = 0.08, remove_overlap: bool = True) -> DataFrame:
    """(study_id, label): studies that activate over ``threshold`` of a mask, with the mask's number; those of several are dropped."""
    out = None
    for i, m in enumerate(masks):
        some = dataset.by_region(m, threshold).select("study_id", F.lit(float(i)).alias("label"))
        out = some if out is None else out.union(some)
    if remove_overlap:
        n = F.count(F.lit(1)).over(Window.partitionBy("study_id"))
        out = out.withColumn("n", n).where("n = 1").drop("n")
    return out


def regularize(rows: DataFrame, method: str | None = "scale", column: str = "x") -> DataFrame:
    """Arrays scaled to unit variance (of the population), not centred; constant components stay."""
    if method is None:
        return rows
    if method != "scale":
        raise ValueError("regularization: scale or None")
    n = rows.select(F.max(F.size(column))).first()[0] or 0
    sd = rows.agg(*(F.stddev_pop(F.get(F.col(column), F.lit(i))).alias(f"s{i}") for i in range(n))).first() if n else []
    scale = F.array(*(F.lit(float(s) if s else 1.0) for s in sd))
    return rows.withColumn(column, F.zip_with(column, scale, lambda a, b: a / b))


def design_matrix(dataset: Dataset, masks: Sequence[DataFrame], threshold: float = 0.08, remove_overlap: bool = True, features: Sequence[str] | None = None, regularization: str | None = "scale") -> DataFrame:
    """(study_id, label, x): the weights of the features, in the table's order, of the studies of one mask each."""
    f = dataset._features()
    names = f.feature_names(features)
    labels = studies_by_regions(dataset, masks, threshold, remove_overlap)
    pairs = f.weights.where(F.col("feature").isin(names)).groupBy("study_id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "weight"))).alias("m"))
    x = F.transform(F.array(*(F.lit(n) for n in names)), lambda n: F.coalesce(F.try_element_at("m", n), F.lit(0.0)))
    rows = labels.join(pairs, "study_id", "left").select("study_id", "label", x.alias("x"))
    return regularize(rows, regularization)


def weights(rows: DataFrame) -> DataFrame:
    """With ``w``, the inverse share of a row's class, of mean 1."""
    each = F.count(F.lit(1)).over(Window.partitionBy("label"))
    return rows.withColumn("n_of", each).withColumn("w", F.lit(1.0) / F.col("n_of")).drop("n_of")


def folds(rows: DataFrame, k: int, key: str = "study_id", seed: int = 0) -> DataFrame:
    """With ``fold``: each class dealt evenly."""
    order = Window.partitionBy("label").orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
    return rows.withColumn("fold", ((F.row_number().over(order) - 1) % k).cast("int"))


def select_features(rows: DataFrame, how: str, seed: int = 0, names: Sequence[int] | None = None) -> list[int]:
    """Places of the chosen components of x: '10-best' by ANOVA F, or '10-randombest' by chance."""
    n, kind = how.split("-", 1)
    size = rows.select(F.max(F.size("x"))).first()[0]
    n = min(int(n), size)
    if kind == "randombest":
        import random

        return sorted(random.Random(seed).sample(range(size), n))
    if kind != "best":
        raise ValueError("feature selection: N-best or N-randombest")
    selector = UnivariateFeatureSelector(featuresCol="f", labelCol="label", outputCol="o", selectionMode="numTopFeatures").setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(n)
    return list(selector.fit(rows.select("label", array_to_vector("x").alias("f"))).selectedFeatures)


@dataclass(frozen=True)
class Dummy:
    """Draws classes by their shares."""

    shares: Mapping[float, float]

    def transform(self, rows: DataFrame) -> DataFrame:
        u, total, out = F.rand(0), 0.0, None
        rows = rows.withColumn("_u", u)
        for label, share in sorted(self.shares.items()):
            total += share
            test = F.col("_u") < total
            out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
        return rows.withColumn("prediction", out.otherwise(F.lit(max(self.shares)))).drop("_u")


def estimator(method: str, n_classes: int):
    """SVM: a linear one, against the rest; ERF: a forest; GBC: boosted stumps, against the rest."""
    columns = {"featuresCol": "f", "labelCol": "label"}
    if method == "SVM":
        return OneVsRest(classifier=LinearSVC(**columns), **columns)
    if method == "ERF":
        return RandomForestClassifier(numTrees=100, maxDepth=10, seed=0, **columns)
    if method == "GBC":
        one = GBTClassifier(maxIter=100, maxDepth=1, seed=0, **columns)
        return one if n_classes == 2 else OneVsRest(classifier=one, **columns)
    raise ValueError("method: SVM, ERF, GBC or Dummy")


def score(predicted: DataFrame, scoring: str | Callable = "accuracy") -> float:
    """accuracy, f1 of class 1, or any function of (label, prediction) rows."""
    if callable(scoring):
        return scoring(predicted)
    metric = {"accuracy": "accuracy", "f1": "fMeasureByLabel"}[scoring]
    return MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction", metricName=metric, metricLabel=1.0).evaluate(predicted)


@dataclass(frozen=True)
class Classifier:
    """Fits, scores and cross-validates; ``supplied`` is used instead of a method's estimator."""

    method: str = "ERF"
    supplied: object | None = None
    param_grid: Mapping[str, Sequence] | None = None
    class_weight: str | None = "auto"

    def fit(self, rows: DataFrame, k: int = 3):
        d = weights(rows).withColumn("f", array_to_vector("x"))
        if self.method == "Dummy" and self.supplied is None:
            counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
            return Dummy({c: n / sum(counts.values()) for c, n in counts.items()})
        e = self.supplied or estimator(self.method, rows.select("label").distinct().count())
        if self.class_weight == "auto" and e.hasParam("weightCol"):
            e = e.copy().setWeightCol("w")
        if not self.param_grid:
            return Pipeline(stages=[e]).fit(d)
        builder = ParamGridBuilder()
        for name, values in self.param_grid.items():
            builder.addGrid(e.getParam(name), list(values))
        judge = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")
        return CrossValidator(estimator=e, estimatorParamMaps=builder.build(), evaluator=judge, foldCol="fold", numFolds=k).fit(folds(d, k))

    def predict(self, model, rows: DataFrame) -> DataFrame:
        return model.transform(rows.withColumn("f", array_to_vector("x"))).select("study_id", "label", "prediction")

    def cross_validate(self, rows: DataFrame, cross_val: str = "4-Fold", scoring="accuracy", feat_select: str | None = None) -> tuple[float, DataFrame]:
        """(mean score, predictions of the folds left out); selection of features happens inside each fold."""
        k, kind = cross_val.split("-", 1)
        if kind.lower() != "fold":
            raise ValueError("cross_val: N-Fold")
        d = folds(rows, int(k)).cache()
        scores, out = [], None
        for i in range(int(k)):
            train, test = d.where(F.col("fold") != i).drop("fold"), d.where(F.col("fold") == i).drop("fold")
            if feat_select:
                keep = select_features(train, feat_select)
                pick = F.array(*(F.get("x", F.lit(j)) for j in keep))
                train, test = train.withColumn("x", pick), test.withColumn("x", pick)
            predicted = self.predict(self.fit(train), test).cache()
            scores.append(score(predicted, scoring))
            out = predicted if out is None else out.union(predicted)
        return sum(scores) / len(scores), out


def classify(rows: DataFrame, method: str = "ERF", classifier=None, output: str = "summary_clf", cross_val: str | None = None, class_weight: str | None = None, regularization: str | None = None, param_grid=None, scoring="accuracy", feat_select: str | None = None):
    """``clf``: the model; ``summary``: score, n of each label and predictions; ``summary_clf``: both."""
    if output not in ("clf", "summary", "summary_clf"):
        raise ValueError("output: clf, summary or summary_clf")
    rows = regularize(rows, regularization)
    c = Classifier(method, classifier, param_grid, class_weight)
    if cross_val:
        value, predicted = c.cross_validate(rows, cross_val, scoring, feat_select)
        model = c.fit(rows)
    else:
        model = c.fit(rows)
        predicted = c.predict(model, rows)
        value = score(predicted, scoring)
    if output == "clf":
        return model
    n = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    summary = {"score": value, "n": n, "predictions": predicted}
    return summary if output == "summary" else summary | {"clf": model}


def classify_regions(dataset: Dataset, masks: Sequence[DataFrame], method: str = "ERF", threshold: float = 0.08, remove_overlap: bool = True, regularization: str | None = "scale", output: str = "summary", features=None, class_weight="auto", classifier=None, cross_val: str = "4-Fold", param_grid=None, scoring="accuracy"):
    """``classify`` of the ``design_matrix``."""
    rows = design_matrix(dataset, masks, threshold, remove_overlap, features, regularization)
    return classify(rows, method, classifier, output, cross_val, class_weight, None, param_grid, scoring)
