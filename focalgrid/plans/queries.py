"""The queries registered for the driver's tables, and their DuckDB SQL.

Each is one operator over whole tables, or a composition.  Values that come of divisions and roots are rounded to nine
digits, as the two engines may differ in the last bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import classify, cluster, decode, meta, regions, topics
from ..operators.dataset import Dataset
from ..operators.expression import Leaf, leaves, parse
from ..operators.features import FeatureTable
from ..operators.masker import Masker
from . import adapter as ad

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with some columns rounded to nine digits; -0.0 becomes 0.0.

    As DuckDB's ``round`` does: the double nearest to value * 1e9 to a whole number, halves away from zero.  Spark's own
    rounds the decimal digits, and differs where the product is rounded to a half.
    """

    def nine(v: Column) -> Column:
        size = F.abs(v) * 1e9
        even = F.rint(size)
        return F.signum(v) * F.when(size - even == 0.5, even + 1).otherwise(even) / 1e9 + F.lit(0.0)

    return df.withColumns({c: nine(F.col(f"`{c}`")) for c in columns})


# foci and voxels


@query(f"with {ad.FOCI} select study_id, round(x, 9) + 0.0 as x, round(y, 9) + 0.0 as y, round(z, 9) + 0.0 as z, space, xi, yj, zk from foci")
def foci_transform(spark, sf_dir):
    """Points moved into the target space, and their grid indices."""
    return rounded(ad.dataset(spark, sf_dir, False).foci, "x", "y", "z")


@query(f"with {ad.VOXELS} select study_id, voxel_id from sv")
def foci_voxels(spark, sf_dir):
    """The voxels that each study activates."""
    return ad.dataset(spark, sf_dir, False).study_voxel


@query(f"with {ad.VOXELS} select study_id, count(*) as n_voxels from sv group by 1")
def study_voxel_counts(spark, sf_dir):
    """How many voxels each study activates."""
    return ad.dataset(spark, sf_dir, False).study_voxel.groupBy("study_id").agg(F.count(F.lit(1)).alias("n_voxels"))


@query(f"with {ad.FOCI} select distinct xi, yj, zk, -2 * xi + 90 as x, 2 * yj - 126 as y, 2 * zk - 72 as z from foci")
def voxel_points(spark, sf_dir):
    """The centres of the voxels that hold foci."""
    at = ad.dataset(spark, sf_dir, False).foci.select("xi", "yj", "zk").distinct()
    point = ad.GRID.to_point(F.col("xi"), F.col("yj"), F.col("zk"))
    return at.select("*", *(p.alias(n) for p, n in zip(point, "xyz")))


# selection of studies


@query(f"with {ad.FEATURES} select study_id, round(sum(weight), 9) as weight from fw where regexp_matches(feature, '^(?:re.*)$') group by 1 having sum(weight) >= 0.1")
def select_by_feature(spark, sf_dir):
    """Studies by the sum of features that match a pattern."""
    return rounded(ad.features(spark, sf_dir).study_weights("re*", 0.1), "weight")


def _matched(pattern: str) -> str:
    return f"regexp_matches(feature, '^(?:{pattern.replace('*', '.*')})$')"


def _feature_func(func: str) -> str:
    n = f"(select count(*) from fnames where {_matched('b*')})"
    value = {"mean": f"coalesce(sum(weight), 0) / {n}", "max": "greatest(coalesce(max(weight), 0), 0)", "min": f"case when count(weight) = {n} then min(weight) else 0 end"}[func]
    return f"with {ad.FEATURES}, a as (select f.study_id, {value} as weight from fstudies f left join (select * from fw where {_matched('b*')}) w using (study_id) group by 1) select study_id, round(weight, 9) as weight from a where weight >= 0.0"


@query(_feature_func("mean"))
def select_by_feature_mean(spark, sf_dir):
    """Studies by the mean, zeros included; at threshold 0 all qualify."""
    return rounded(ad.features(spark, sf_dir).study_weights("b*", 0.0, "mean"), "weight")


@query(_feature_func("max"))
def select_by_feature_max(spark, sf_dir):
    """Studies by the largest weight."""
    return rounded(ad.features(spark, sf_dir).study_weights("b*", 0.0, "max"), "weight")


@query(_feature_func("min"))
def select_by_feature_min(spark, sf_dir):
    """Studies by the smallest weight, zeros included."""
    return rounded(ad.features(spark, sf_dir).study_weights("b*", 0.0, "min"), "weight")


@query(f"with {ad.FEATURES} select feature from fnames where {_matched('re*')} or {_matched('*e')}")
def search_features(spark, sf_dir):
    """Names by patterns."""
    return spark.createDataFrame([(n,) for n in ad.features(spark, sf_dir).search(["re*", "*e"])], "feature string")


def _expression_sql(text: str, threshold: float, func: str) -> str:
    """The SQL of an expression: a column for each leaf, then CASE by CASE."""
    tree = parse(text)
    names = leaves(tree)
    columns = ", ".join(f"sum(case when {_matched(n)} then weight end) as r{i}" for i, n in enumerate(names))
    limited = ", ".join(f"case when r{i} >= {threshold} then r{i} end as l{i}" for i in range(len(names)))

    def both(a: str, b: str) -> str:
        return {"sum": f"({a} + {b})", "mean": f"(({a} + {b}) / 2)", "max": f"greatest({a}, {b})"}[func]

    def sql(t) -> str:
        if isinstance(t, Leaf):
            return f"l{names.index(t.feature)}"
        a = sql(t.left)
        if t.op in "<>":
            return f"(case when {a} {'<' if t.op == '<' else '>='} {t.right} then {a} end)"
        b = sql(t.right)
        if t.op == "&":
            return f"(case when {a} is not null and {b} is not null then {both(a, b)} end)"
        if t.op == "|":
            return f"(case when {a} is not null or {b} is not null then {both(f'coalesce({a}, 0)', f'coalesce({b}, 0)')} end)"
        return f"(case when {b} is null then {a} end)"

    return f"with {ad.FEATURES}, r as (select study_id, {columns} from fw group by 1), l as (select study_id, {limited} from r) select study_id, round({sql(tree)}, 9) as weight from l where {sql(tree)} is not null"


def _expression(name: str, text: str, threshold: float = 0.01, func: str = "sum") -> None:
    def run(spark, sf_dir):
        return rounded(ad.features(spark, sf_dir).ids_by_expression(text, threshold, func), "weight")

    run.__name__ = name
    run.__doc__ = f"The expression {text}."
    query(_expression_sql(text, threshold, func))(run)


for _name, _text in (
    ("expr_and", "re* & b*"),
    ("expr_or", "re* | b*"),
    ("expr_andnot", "re* &~ b*"),
    ("expr_lt", "re* < 0.2"),
    ("expr_ge", "re* > 0.2"),
    ("expr_nested", "(re* | gr*) &~ (b* > 0.1)"),
    ("expr_right", "re* &~ b* | gr*"),
    ("expr_ngram", "red plate"),
):
    _expression(_name, _text)

_ROI_POINT, _ROI_RADIUS = (-20.0, 10.0, 20.0), 12.0
_ROI = "roi as (select voxel_id from vol where sqrt(4.0 * ((xi - 55) * (xi - 55) + (yj - 68) * (yj - 68) + (zk - 46) * (zk - 46))) <= 12)"


@query(f"with {ad.VOXELS}, {_ROI} select study_id from sv join roi using (voxel_id) group by 1 having count(*) / (select cast(count(*) as double) from roi) > 0.02")
def select_by_roi_float(spark, sf_dir):
    """Studies that activate over a share of a region."""
    d = ad.dataset(spark, sf_dir, False)
    return d.get_studies(mask=regions.sphere(d, _ROI_POINT, _ROI_RADIUS), activation_threshold=0.02)


@query(f"with {ad.VOXELS}, {_ROI} select study_id from sv join roi using (voxel_id) group by 1 having count(*) > 20")
def select_by_roi_int(spark, sf_dir):
    """Studies that activate over a number of voxels of a region."""
    d = ad.dataset(spark, sf_dir, False)
    return d.get_studies(mask=regions.sphere(d, _ROI_POINT, _ROI_RADIUS), activation_threshold=20)


_NEAR = "sqrt((x - -20.0) * (x - -20.0) + (y - 10.0) * (y - 10.0) + (z - 20.0) * (z - 20.0)) <= 10.0 or sqrt((x - 30.0) * (x - 30.0) + (y - -50.0) * (y - -50.0) + (z - 5.0) * (z - 5.0)) <= 10.0"
_PEAKS = [(-20.0, 10.0, 20.0), (30.0, -50.0, 5.0)]


@query(f"with {ad.FOCI} select distinct study_id from foci where {_NEAR}")
def select_by_peaks(spark, sf_dir):
    """Studies with a focus near one of two points."""
    return ad.dataset(spark, sf_dir, False).get_studies(peaks=_PEAKS, radius=10.0)


@query(f"with {ad.FOCI}, {ad.FEATURES} select distinct study_id from foci where ({_NEAR}) and study_id in (select study_id from fw where {_matched('b*')} group by 1 having sum(weight) >= 0.05)")
def select_multi_criteria(spark, sf_dir):
    """Studies near two points and with a feature."""
    return ad.dataset(spark, sf_dir).get_studies(features="b*", frequency_threshold=0.05, peaks=_PEAKS, radius=10.0)


# the feature table


@query(f"with {ad.FEATURES} select feature, count(study_id) as n from fnames left join (select * from fw where weight >= 0.1) using (feature) group by 1")
def feature_counts(spark, sf_dir):
    """How many studies have each feature."""
    return ad.features(spark, sf_dir).counts(0.1)


def _halves(spark, sf_dir) -> tuple[FeatureTable, FeatureTable]:
    """Two overlapping parts of the features: of studies with ids of last digit under 7, and over 3; names up to 's', and from 'g'."""
    f = ad.features(spark, sf_dir)
    digit = F.substring("study_id", -1, 1).cast("int")
    a = FeatureTable(f.weights.where((digit < 7) & (F.col("feature") < "s")), f.names.where("feature < 's'"), f.studies.where(digit < 7))
    b = FeatureTable(f.weights.where((digit > 3) & (F.col("feature") >= "g")).withColumn("weight", F.col("weight") * 0.5), f.names.where("feature >= 'g'"), f.studies.where(digit > 3))
    return a, b


_HALVES = (
    ad.FEATURES
    + """, d as (select *, cast(right(study_id, 1) as integer) as digit from fw),
    a as (select study_id, feature, weight from d where digit < 7 and feature < 's'),
    b as (select study_id, feature, weight * 0.5 as weight from d where digit > 3 and feature >= 'g'),
    sa as (select study_id from fstudies where cast(right(study_id, 1) as integer) < 7),
    sb as (select study_id from fstudies where cast(right(study_id, 1) as integer) > 3)"""
)


@query(f"with {_HALVES} select * replace (round(weight, 9) as weight) from (select * from a union all select * from b where feature >= 's')")
def feature_merge_outer(spark, sf_dir):
    """Two tables merged: all studies; old features win."""
    a, b = _halves(spark, sf_dir)
    return rounded(a.add(b, merge="outer").weights, "weight")


@query(f"with {_HALVES} select * replace (round(weight, 9) as weight) from (select * from a union all select * from b where feature >= 's') where study_id in (select study_id from sa) and study_id in (select study_id from sb)")
def feature_merge_inner(spark, sf_dir):
    """Two tables merged: studies of both."""
    a, b = _halves(spark, sf_dir)
    return rounded(a.add(b, merge="inner").weights, "weight")


@query(f"with {_HALVES} select * replace (round(weight, 9) as weight) from (select * from a union all select * from b where feature >= 's') where study_id in (select study_id from sa)")
def feature_dup_ignore(spark, sf_dir):
    """Two tables merged: studies of the first, its features win."""
    a, b = _halves(spark, sf_dir)
    return rounded(a.add(b, merge="left", duplicates="ignore").weights, "weight")


@query(f"with {_HALVES} select * replace (round(weight, 9) as weight) from (select * from a where feature < 'g' union all select * from b) where study_id in (select study_id from sb)")
def feature_dup_replace(spark, sf_dir):
    """Two tables merged: studies of the second, its features win."""
    a, b = _halves(spark, sf_dir)
    return rounded(a.add(b, merge="right", duplicates="replace").weights, "weight")


@query(f"with {_HALVES}, m as (select study_id, case when feature >= 'g' then feature || '_x' else feature end as feature, weight from a union all select study_id, case when feature < 's' then feature || '_y' else feature end, weight from b) select study_id, feature, round(weight, 9) as weight from m")
def feature_dup_merge(spark, sf_dir):
    """Two tables merged: features of both under two names."""
    a, b = _halves(spark, sf_dir)
    return rounded(a.add(b, duplicates="merge").weights, "weight")


@query(f"with {_HALVES}, ok as (select feature from b where weight >= 0.1 group by 1 having count(*) >= 20) select * replace (round(weight, 9) as weight) from (select * from a union all select * from b where feature >= 's' and feature in (select feature from ok))")
def feature_min_studies(spark, sf_dir):
    """Two tables merged: only new features of enough studies."""
    a, b = _halves(spark, sf_dir)
    return rounded(a.add(b, min_studies=20, threshold=0.1).weights, "weight")


@query(f"with {ad.FEATURES}, i as (select study_id from fw where {_matched('re*')} group by 1 having sum(weight) >= 0.1) select feature, round(sum(weight) / (select count(*) from i), 9) as weight from fw where study_id in (select study_id from i) group by 1 having sum(weight) / (select count(*) from i) >= 0.01")
def features_by_ids(spark, sf_dir):
    """Features by their mean over some studies."""
    f = ad.features(spark, sf_dir)
    return rounded(f.by_ids(f.study_weights("re*", 0.1), 0.01), "weight")


@query(f"with {ad.FEATURES}, n as (select feature from fnames where {_matched('re*')} and not contains(feature, ' ')) select study_id, feature, round(weight, 9) as weight from fw join n using (feature)")
def feature_data(spark, sf_dir):
    """The weights of some features."""
    f = ad.features(spark, sf_dir)
    return rounded(f.data(features=[n for n in f.search("re*") if " " not in n]), "weight")


# masks and images

_LAYERS = ad.VOLUME + ", a as (select voxel_id, cast((xi * 7 + yj * 3) % 10 as double) as value from vol), b as (select voxel_id, cast((zk * 5 + yj) % 7 as double) as value from vol)"


def _layered(spark) -> Masker:
    v = ad.volume(spark)
    a = v.select("voxel_id", ((F.col("xi") * 7 + F.col("yj") * 3) % 10).cast("double").alias("value"))
    b = v.select("voxel_id", ((F.col("zk") * 5 + F.col("yj")) % 7).cast("double").alias("value"))
    return Masker(v, ad.GRID).add({"a": a, "b": b})


@query(f"with {_LAYERS} select a.voxel_id from a join b using (voxel_id) where a.value <> 0 and b.value <> 0")
def mask_conjunction(spark, sf_dir):
    """Voxels in two layers."""
    return _layered(spark).mask()


@query(f"with {_LAYERS} select voxel_id from a where value >= 3 and value <= 7")
def mask_above_below(spark, sf_dir):
    """Voxels of a layer between two limits."""
    m = _layered(spark)
    return m.reset().add({"cut": m.layers["a"]}, above=3, below=7).mask("cut")


@query(f"with {_LAYERS} select cast(g.range as integer) as voxel_id, coalesce(a.value, 0) as value from range(902629) g left join (select a.* from a join b using (voxel_id) where a.value <> 0 and b.value <> 0) a on a.voxel_id = g.range")
def unmask_fill(spark, sf_dir):
    """A masked image over the whole grid."""
    m = _layered(spark)
    return m.unmask(m.layers["a"])


@query(f"with {_LAYERS} select voxel_id, case when b.value < 4 then 0.0 else a.value end as value from a join b using (voxel_id)")
def threshold_image(spark, sf_dir):
    """An image where a second one reaches a limit."""
    m = _layered(spark)
    both = m.layers["a"].join(m.layers["b"].withColumnRenamed("value", "other"), "voxel_id")
    return both.select("voxel_id", stats.threshold(F.col("value"), 4.0, F.col("other")).alias("value"))


@query(f"with {ad.VOXELS} select study_id, voxel_id from sv where voxel_id % 10 = 3 and study_id in (select study_id from foci group by 1 having count(*) >= 5)")
def image_slice(spark, sf_dir):
    """The voxels of some studies at some places."""
    d = ad.dataset(spark, sf_dir, False)
    ids = d.foci.groupBy("study_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")
    return d.image_data(ids, d.masker.volume.where("voxel_id % 10 = 3"))


@query()
def random_voxels(spark, sf_dir):
    """The rows of 100 voxels drawn by chance."""
    return ad.dataset(spark, sf_dir, False).random_voxels(100, seed=1)


# meta-analysis

_SELECTED = f"sel as (select study_id from fw where {_matched('re*')} group by 1 having sum(weight) >= 0.1)"
_META = (
    ad.VOXELS
    + ","
    + ad.FEATURES
    + f""", {_SELECTED},
    ids as (select study_id, study_id in (select study_id from sel) as s from studies),
    n as (select count(*) filter (s) as n_s, count(*) filter (not s) as n_u from ids),
    c as (select voxel_id, count(*) filter (s) as n_sa, count(*) filter (not s) as n_ua from sv join ids using (study_id) group by 1),
    t as (select vol.voxel_id, coalesce(n_sa, 0) as n_sa, coalesce(n_ua, 0) as n_ua, n_s, n_u from vol left join c using (voxel_id), n)"""
)


def _cell(cell: str, row: str, column: str) -> str:
    e = f"(({row}) * ({column}) / (n_s + n_u)::double)"
    return f"(case when {e} = 0 then 1.0 else (({cell}) - {e}) * (({cell}) - {e}) / {e} end)"


def _erfc_sql(z: str) -> str:
    t = f"(1.0 / (1.0 + 0.5 * {z}))"
    poly = str(stats.ERFC[-1])
    for c in stats.ERFC[-2::-1]:
        poly = f"({c} + {t} * {poly})"
    return f"({t} * exp({poly} - {z} * {z}))"


_CHI = " + ".join((_cell("n_sa", "n_sa + n_ua", "n_s"), _cell("n_ua", "n_sa + n_ua", "n_u"), _cell("n_s - n_sa", "n_s + n_u - n_sa - n_ua", "n_s"), _cell("n_u - n_ua", "n_s + n_u - n_sa - n_ua", "n_u")))


def _tests(source: str, key: str = "") -> str:
    """CTE ``z``: chi-squares, signed roots, p and the limits, over distinct counts."""
    by, part = (f"{key}, ", f"partition by {key}") if key else ("", "")
    order = f"{part} order by"
    return f"""
    g as (select {by}n_sa, n_ua, n_s, n_u, count(*) as w from {source} group by all),
    e as (select *, sum(n_sa * w) over ({part}) / (sum(w) over ({part}))::double as mean from g),
    x as (select *, {_CHI} as chi_a, case when mean > 0 then (n_sa - mean) * (n_sa - mean) / mean + (n_sa - mean) * (n_sa - mean) / (n_s - mean) end as chi_u from e),
    p as (select *, greatest({_erfc_sql("sqrt(chi_a / 2)")}, 1e-240) as p_a, greatest({_erfc_sql("sqrt(chi_u / 2)")}, 1e-240) as p_u from x),
    r as (select *, sum(w) over ({order} p_a range between unbounded preceding and current row) as rank_a, sum(w) over ({order} p_u range between unbounded preceding and current row) as rank_u, sum(w) over ({part}) as m from p),
    l as (select *, coalesce(max(case when p_a <= rank_a * 0.01 / m then p_a end) over ({part}), -1) as limit_a, coalesce(max(case when p_u <= rank_u * 0.01 / m then p_u end) over ({part}), -1) as limit_u from r),
    z as (select {by}n_sa, n_ua, n_s, n_u, sign(n_sa / n_s::double - n_ua / n_u::double) * least(sqrt(chi_a), {stats.Z_MAX}) as z_a, sign(n_sa - mean) * least(sqrt(chi_u), {stats.Z_MAX}) as z_u, p_a <= limit_a as in_a, p_u <= limit_u as in_u, p_a, p_u, limit_a, limit_u, m from l)"""


def _images(cut_at: str, source: str = "t", key: str = "") -> str:
    """The select of the nine images."""
    by, on = (f"{key}, ", f"{key}, n_sa, n_ua, n_s, n_u") if key else ("", "n_sa, n_ua, n_s, n_u")
    a, s, u = "((n_sa + n_ua) / (n_s + n_u)::double)", "(n_sa / n_s::double)", "(n_ua / n_u::double)"
    mixed = f"(0.5 * {s} + 0.5 * {u})"
    values = (a, s, f"({s} * (n_s / (n_s + n_u)::double) / nullif({a}, 0))", mixed, f"({s} * 0.5 / nullif({mixed}, 0))", "z_u", "z_a", "(z_u * in_u::integer)", "(z_a * in_a::integer)")
    columns = ", ".join(f'round(case when {a} < {cut_at} then 0 else {v} end, 9) + 0.0 as "{name}"' for v, name in zip(values, meta.image_names(0.01, 0.5)))
    return f"select {by}voxel_id, {columns} from {source} join z using ({on})"


def _analysis(spark, sf_dir, **how) -> meta.MetaAnalysis:
    d = ad.dataset(spark, sf_dir)
    return meta.MetaAnalysis(d, d.get_studies(features="re*", frequency_threshold=0.1), **how)


@query(f"with {_META} select voxel_id, n_sa, n_ua, n_s, n_u from t")
def meta_counts(spark, sf_dir):
    """How many selected and other studies activate each voxel."""
    return _analysis(spark, sf_dir).counts().drop("n_a")


@query(f'with {_META}, {_tests("t")} select voxel_id, round(z_a, 9) + 0.0 as z, round(z_a * in_a::integer, 9) + 0.0 as z_fdr from t join z using (n_sa, n_ua, n_s, n_u)')
def meta_association_z(spark, sf_dir):
    """The test of association."""
    found = _analysis(spark, sf_dir, min_studies=0).images()
    return rounded(found.select("voxel_id", F.col("`association-test_z`").alias("z"), F.col("`association-test_z_FDR_0.01`").alias("z_fdr")), "z", "z_fdr")


@query(f'with {_META}, {_tests("t")} select voxel_id, round(z_u, 9) + 0.0 as z, round(z_u * in_u::integer, 9) + 0.0 as z_fdr from t join z using (n_sa, n_ua, n_s, n_u)')
def meta_uniformity_z(spark, sf_dir):
    """The test of uniformity."""
    found = _analysis(spark, sf_dir, min_studies=0).images()
    return rounded(found.select("voxel_id", F.col("`uniformity-test_z`").alias("z"), F.col("`uniformity-test_z_FDR_0.01`").alias("z_fdr")), "z", "z_fdr")


@query(f"with {_META}, {_tests('t')} {_images('20 / (n_s + n_u)::double')}")
def meta_min_studies(spark, sf_dir):
    """All nine images, zero where under 20 studies are active."""
    return rounded(_analysis(spark, sf_dir, min_studies=20).images(), *meta.image_names(0.01, 0.5))


_TWO = (
    ad.VOXELS
    + ","
    + ad.FEATURES
    + f""", s1 as (select study_id from fw where {_matched('re*')} group by 1 having sum(weight) >= 0.1), s2 as (select study_id from fw where {_matched('b*')} group by 1 having sum(weight) >= 0.1),
    ids as (select study_id, study_id in (select study_id from s1) as s, study_id in (select study_id from s2) as u from studies),
    n as (select count(*) filter (s) as n_s, count(*) filter (u) as n_u from ids where s or u),
    c as (select voxel_id, count(*) filter (s) as n_sa, count(*) filter (u) as n_ua, count(*) filter (s or u) as n_a from sv join ids using (study_id) group by 1),
    t as (select vol.voxel_id, coalesce(n_sa, 0) as n_sa, coalesce(n_ua, 0) as n_ua, coalesce(n_a, 0) as n_a, n_s, n_u from vol left join c using (voxel_id), n)"""
)


@query(f'with {_TWO}, {_tests("t")} select voxel_id, n_sa, n_ua, n_a, round(z_a, 9) + 0.0 as z from t join z using (n_sa, n_ua, n_s, n_u)')
def meta_contrast_two_sets(spark, sf_dir):
    """Two sets of studies, which overlap."""
    d = ad.dataset(spark, sf_dir)
    a = meta.MetaAnalysis(d, d.get_studies(features="re*", frequency_threshold=0.1), d.get_studies(features="b*", frequency_threshold=0.1), min_studies=0)
    z = a.images().select("voxel_id", F.col("`association-test_z`").alias("z"))
    return rounded(a.counts().select("voxel_id", "n_sa", "n_ua", "n_a").join(z, "voxel_id"), "z")


@query("with p as (select (n_chars % 997 + 1) / 1000.0 * (doc_id % 13 + 1) / 13.0 as p from documents), g as (select p, count(*) as n from p group by 1), r as (select p, sum(n) over (order by p) as k, (select count(*) from p) as m from g) select coalesce(max(case when p <= k * 0.8 / m then p end), -1.0) as threshold from r")
def fdr_threshold(spark, sf_dir):
    """The false discovery rate's limit of a list of p."""
    p = ad.read(spark, sf_dir, "documents").select((((F.col("n_chars") % 997 + 1) / F.lit(1000.0)) * (F.col("doc_id") % 13 + 1) / F.lit(13.0)).alias("p"))
    return stats.fdr(p, 0.8)


# regions and grids

_REGIONS = "reg as (select 1 + ((xi + 3) // 6 * 19 + (yj + 3) // 6) * 16 + (zk + 3) // 6 as region_id, voxel_id from vol), size as (select region_id, count(*) as size from reg group by 1), hit as (select region_id, study_id, count(*) as n from sv join reg using (voxel_id) group by 1, 2)"


@query(f"with {ad.VOLUME} select 1 + ((case when (xi + 2) // 4 >= 23 then 0 else (xi + 2) // 4 end) * 28 + (case when (yj + 2) // 4 >= 28 then 0 else (yj + 2) // 4 end)) * 23 + (case when (zk + 2) // 4 >= 23 then 0 else (zk + 2) // 4 end) as region_id, voxel_id from vol")
def grid_labels(spark, sf_dir):
    """The cubic cells of a grid."""
    return regions.create_grid(ad.volume(spark), ad.GRID, 4)


@query(f"with {ad.VOXELS}, {_REGIONS} select region_id, study_id, round(n / size::double, 9) as value from hit join size using (region_id)")
def grid_average(spark, sf_dir):
    """The share of each cell that each study activates."""
    return rounded(regions.apply_grid(ad.dataset(spark, sf_dir, False), scale=6), "value")


_BALLS = "reg as (select 1 as region_id, voxel_id from vol where sqrt(4.0 * ((xi - 55) * (xi - 55) + (yj - 68) * (yj - 68) + (zk - 46) * (zk - 46))) <= 12 union all select 2, voxel_id from vol where sqrt(4.0 * ((xi - 50) * (xi - 50) + (yj - 68) * (yj - 68) + (zk - 46) * (zk - 46))) <= 10), size as (select region_id, count(*) as size from reg group by 1), hit as (select region_id, study_id, count(*) as n from sv join reg using (voxel_id) group by 1, 2)"


def _balls(d) -> DataFrame:
    a = regions.sphere(d, (-20.0, 10.0, 20.0), 12.0).select(F.lit(1).alias("region_id"), "voxel_id")
    return a.union(regions.sphere(d, (-10.0, 10.0, 20.0), 10.0).select(F.lit(2).alias("region_id"), "voxel_id"))


@query(f"with {ad.VOXELS}, {_BALLS} select region_id, study_id, round(n / size::double, 9) as value from hit join size using (region_id)")
def roi_average(spark, sf_dir):
    """The share of two overlapping regions that each study activates."""
    d = ad.dataset(spark, sf_dir, False)
    return rounded(regions.average_within_regions(d, _balls(d)), "value")


@query(f"with {ad.VOXELS}, {_BALLS} select region_id, study_id, n >= 15 as value from hit")
def roi_count(spark, sf_dir):
    """Whether a study activates a number of a region's voxels."""
    d = ad.dataset(spark, sf_dir, False)
    return regions.average_within_regions(d, _balls(d), threshold=15)


@query(f"with {ad.VOXELS}, {_BALLS} select region_id, study_id, n / size::double >= 0.03 as value from hit join size using (region_id)")
def roi_threshold(spark, sf_dir):
    """Whether a study activates a share of a region."""
    d = ad.dataset(spark, sf_dir, False)
    return regions.average_within_regions(d, _balls(d), threshold=0.03)


def _chosen(ids: str) -> str:
    return f"with {ad.VOXELS}, {_ROI}, sel as ({ids}), ids as (select study_id, study_id in (select study_id from sel) as s from studies), n as (select count(*) filter (s) as n_s, count(*) filter (not s) as n_u from ids), c as (select voxel_id, count(*) filter (s) as n_sa, count(*) filter (not s) as n_ua from sv join ids using (study_id) group by 1), t as (select vol.voxel_id, coalesce(n_sa, 0) as n_sa, coalesce(n_ua, 0) as n_ua, n_s, n_u from vol left join c using (voxel_id), n), {_tests('t')} {_images('1 / (n_s + n_u)::double')}"


@query(_chosen("select study_id from sv join roi using (voxel_id) group by 1 having count(*) / (select cast(count(*) as double) from roi) > 0.02"))
def coactivation_seed(spark, sf_dir):
    """The analysis of the studies that activate a region."""
    d = ad.dataset(spark, sf_dir, False)
    return rounded(regions.coactivation(d, regions.sphere(d, _ROI_POINT, _ROI_RADIUS), 0.02), *meta.image_names(0.01, 0.5))


@query(_chosen(f"select distinct study_id from foci where {_NEAR}"))
def coactivation_peaks(spark, sf_dir):
    """The analysis of the studies near two points."""
    return rounded(regions.coactivation(ad.dataset(spark, sf_dir, False), _PEAKS, radius=10.0), *meta.image_names(0.01, 0.5))


# many features, decoding

_FEATURE_NAMES = ("red", "blue", "green", "plate")
_LIST = ", ".join(f"'{n}'" for n in _FEATURE_NAMES)
_MANY = (
    ad.VOXELS
    + ","
    + ad.FEATURES
    + f""", chosen as (select study_id, feature from fw where feature in ({_LIST}) and weight >= 0.05 and study_id in (select study_id from studies)),
    names as (select feature from fnames where feature in ({_LIST})), n as (select feature, count(study_id) as n_s from names left join chosen using (feature) group by 1),
    act as (select feature, voxel_id, count(*) as n_sa from sv join chosen using (study_id) group by 1, 2), total as (select voxel_id, count(*) as n_a from sv group by 1),
    t as (select n.feature, vol.voxel_id, coalesce(n_sa, 0) as n_sa, coalesce(n_a, 0) - coalesce(n_sa, 0) as n_ua, n_s, (select count(*) from studies) - n_s as n_u
        from n cross join vol left join total using (voxel_id) left join act on act.feature = n.feature and act.voxel_id = vol.voxel_id)"""
)


@query(f"with {_MANY}, {_tests('t', 'feature')}, i as ({_images('1 / (n_s + n_u)::double', 't', 'feature')}) select feature, voxel_id, \"association-test_z\" as value from i")
def analyze_features(spark, sf_dir):
    """One image for each of several features, in one job."""
    return rounded(meta.analyze_features(ad.dataset(spark, sf_dir), _FEATURE_NAMES, threshold=0.05), "value")


_IMAGES = "img as (select 'a' as image_id, voxel_id, cast((xi * 7 + yj * 3) % 10 as double) as value from vol union all select 'b', voxel_id, cast((zk * 5 + yj) % 7 as double) from vol)"
_MAPS = f"{_MANY}, {_tests('t', 'feature')}, {_IMAGES}, i as ({_images('1 / (n_s + n_u)::double', 't', 'feature').replace('round(', '(').replace(', 9) + 0.0', ')')}), maps as (select feature, voxel_id, coalesce(\"association-test_z\", 0) as value from i)"


def _pictures(spark) -> DataFrame:
    m = _layered(spark)
    return m.layers["a"].select(F.lit("a").alias("image_id"), "voxel_id", "value").union(m.layers["b"].select(F.lit("b").alias("image_id"), "voxel_id", "value"))


@query(f"with {_MAPS} select feature, image_id, round_even(corr(m.value, img.value), 4) + 0.0 as value from maps m join img using (voxel_id) group by 1, 2")
def decode_pearson(spark, sf_dir):
    """The correlation of images with features' maps."""
    d = decode.Decoder.from_dataset(ad.dataset(spark, sf_dir), _FEATURE_NAMES, threshold=0.05)
    return d.decode(_pictures(spark)).withColumn("value", F.col("value") + F.lit(0.0))


@query(f"with {_MAPS} select feature, image_id, round_even(sum(m.value * img.value), 4) + 0.0 as value from maps m join img using (voxel_id) group by 1, 2")
def decode_dot(spark, sf_dir):
    """The dot product of images with features' maps."""
    d = decode.Decoder.from_dataset(ad.dataset(spark, sf_dir), _FEATURE_NAMES, "dot", threshold=0.05)
    return d.decode(_pictures(spark)).withColumn("value", F.col("value") + F.lit(0.0))


@query(
    f"with {ad.VOXELS}, {ad.FEATURES}, {_BALLS}, pairs as (select cast(region_id as varchar) as image_id, study_id, n / size::double as v from hit join size using (region_id)), every as (select distinct cast(region_id as varchar) as image_id from reg), names as (select feature from fnames where feature in ({_LIST})), r as (select feature, image_id, corr(coalesce(v, 0), coalesce(weight, 0)) as r from every cross join names cross join studies s left join pairs using (image_id, study_id) left join fw using (feature, study_id) group by 1, 2) select feature, image_id, round_even(atanh(r) * sqrt((select count(*) from studies) - 3), 4) + 0.0 as value from r"
)
def decode_roi_z(spark, sf_dir):
    """How regions' activation and features' weights go together over studies."""
    d = ad.dataset(spark, sf_dir)
    images = _balls(d).select(F.col("region_id").cast("string").alias("image_id"), "voxel_id", F.lit(1.0).alias("value"))
    return decode.Decoder.from_dataset(d, _FEATURE_NAMES, "roi").decode(images).withColumn("value", F.col("value") + F.lit(0.0))


# clusters, classes, topics


@query(f"with {ad.VOXELS}, v as (select voxel_id from sv group by 1 having count(*) >= 3), s as (select study_id from sv group by 1 having count(*) >= 60) select study_id, voxel_id from sv join v using (voxel_id) join s using (study_id)")
def clusterable_filter(spark, sf_dir):
    """Voxels of enough studies and studies of enough voxels."""
    return cluster.Clusterable(ad.dataset(spark, sf_dir, False), min_studies=3, min_voxels=60).data


@query(
    f"with {ad.VOXELS}, {_BALLS}, chosen as (select region_id as cluster, study_id from hit join size using (region_id) where n / size::double > 0.02), n as (select cluster, count(*) as n_s from chosen group by 1), act as (select cluster, voxel_id, count(*) as n_sa from sv join chosen using (study_id) group by 1, 2), total as (select voxel_id, count(*) as n_a from sv group by 1), t as (select n.cluster, vol.voxel_id, coalesce(n_sa, 0) as n_sa, coalesce(n_a, 0) - coalesce(n_sa, 0) as n_ua, n_s, (select count(*) from studies) - n_s as n_u from n cross join vol left join total using (voxel_id) left join act on act.cluster = n.cluster and act.voxel_id = vol.voxel_id), {_tests('t', 'cluster')}, i as ({_images('1 / (n_s + n_u)::double', 't', 'cluster')}) select cluster, voxel_id, \"association-test_z\" as value from i"
)
def coactivation_by_cluster(spark, sf_dir):
    """The analysis of the studies of each cluster, in one job."""
    d = ad.dataset(spark, sf_dir, False)
    found = cluster.coactivation_by_cluster(d, _balls(d).withColumnRenamed("region_id", "cluster"), 0.02)
    return rounded(found.select("cluster", "voxel_id", F.col("`association-test_z`").alias("value")), "value")


@query(f"with {ad.VOXELS}, {_BALLS}, s as (select region_id - 1 as label, study_id from hit join size using (region_id) where n / size::double > 0.02) select study_id, cast(any_value(label) as double) as label from s group by 1 having count(*) = 1")
def regions_studies(spark, sf_dir):
    """Studies of one region only."""
    d = ad.dataset(spark, sf_dir, False)
    masks = [_balls(d).where(f"region_id = {i}").select("voxel_id", F.lit(1.0).alias("value")) for i in (1, 2)]
    return classify.studies_by_regions(d, masks, 0.02)


def _masks(d) -> list[DataFrame]:
    return [_balls(d).where(f"region_id = {i}").select("voxel_id", F.lit(1.0).alias("value")) for i in (1, 2)]


@query(
    f"with {ad.VOXELS}, {ad.FEATURES}, {_BALLS}, s as (select region_id - 1 as label, study_id from hit join size using (region_id) where n / size::double > 0.02), l as (select study_id, cast(any_value(label) as double) as label from s group by 1 having count(*) = 1), names as (select feature from fnames where feature in ({_LIST})), e as (select study_id, label, feature, coalesce(weight, 0) as weight from l cross join names left join fw using (study_id, feature)), d as (select feature, stddev_pop(weight) as sd from e group by 1) select study_id, label, feature, round(weight / case when sd = 0 then 1 else sd end, 7) as value from e join d using (feature)"
)
def regions_design_matrix(spark, sf_dir):
    """Feature weights, scaled, of the studies of one region only."""
    d = ad.dataset(spark, sf_dir)
    rows = classify.design_matrix(d, _masks(d), 0.02, features=_FEATURE_NAMES)
    names = d.features.feature_names(_FEATURE_NAMES)
    return rows.select("study_id", "label", F.explode(F.arrays_zip(F.array(*map(F.lit, names)).alias("f"), F.col("x").alias("v"))).alias("e")).select("study_id", "label", F.col("e.f").alias("feature"), F.round(F.col("e.v"), 7).alias("value"))


@query()
def classify_cv(spark, sf_dir):
    """Labels of left-out folds by a forest."""
    d = ad.dataset(spark, sf_dir)
    rows = classify.design_matrix(d, _masks(d), 0.02, features=_FEATURE_NAMES)
    return classify.Classifier("ERF").cross_validate(rows, "3-Fold")[1]


@query()
def kmeans_clusters(spark, sf_dir):
    """Clusters of a region's voxels by their studies' features."""
    d = ad.dataset(spark, sf_dir)
    names = _FEATURE_NAMES
    some = FeatureTable(d.features.weights.where(F.col("feature").isin(list(names))), spark.createDataFrame([(n, i) for i, n in enumerate(names)], "feature string, ordinal int"), d.features.studies)
    from dataclasses import replace

    roi = regions.sphere(d, _ROI_POINT, _ROI_RADIUS).select("voxel_id")
    return cluster.magic(replace(d, features=some), "features", roi_mask=roi, n_clusters=3)


@query()
def lda_topics(spark, sf_dir):
    """The topics of documents."""
    docs = ad.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("pmid"), F.col("text").alias("abstract"))
    return topics.run_lda(docs)[1]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred voxels most associated with a feature."""
    return _analysis(spark, sf_dir).images().select("voxel_id", F.col("`association-test_z`").alias("z"), "pAgF").orderBy(F.desc_nulls_last("z"), "voxel_id").limit(100)


def on_saved(d: Dataset) -> dict[str, Callable[[], DataFrame]]:
    """Analyses of a data set that was built and saved before, for the bench: by name, what gives the rows."""
    return {
        "saved_meta_min_studies": lambda: meta.MetaAnalysis(d, d.get_studies(features="re*", frequency_threshold=0.1), min_studies=20).images(),
        "saved_grid_average": lambda: regions.apply_grid(d, scale=6),
        "saved_coactivation_seed": lambda: regions.coactivation(d, regions.sphere(d, _ROI_POINT, _ROI_RADIUS), 0.02),
        "saved_decode_pearson": lambda: decode.Decoder.from_dataset(d, _FEATURE_NAMES, threshold=0.05).decode(_pictures(d.foci.sparkSession)),
    }
