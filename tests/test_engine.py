"""The engine on the small fixtures of the reference's own tests, written out here, and on a toy grid."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from focalgrid import utils
from focalgrid.functions import geometry, stats
from focalgrid.operators import classify, cluster, components, decode, meta, regions, topics
from focalgrid.operators.dataset import Dataset
from focalgrid.operators.expression import Leaf, parse
from focalgrid.operators.features import FeatureTable
from focalgrid.operators.masker import Masker
from focalgrid.plans.queries import QUERIES, rounded
from focalgrid.sources import activations, nifti

from .conftest import SF

FOCI = {
    "study1": [(-26, 54, 14), (52, 18, 12), (10, 16, 32), (1000, 1000, 1000)],
    "study2": [(12, 57, -60), (33, 21, 15), (24, 15, 60), (42, 6, 51)],
    "study3": [(24, -3, 57), (15, -27, 0), (24, -69, -12), (18, -75, 39), (-45, 48, -15)],
    "study4": [(-12, 21, 57), (-30, 21, 9)],
    "study5": [(-48, 9, 60), (-27, 3, 60), (-54, -6, 39), (-42, -27, 30), (-30, -42, 45), (3, 30, -9)],
}
WIDE = [
    ("study1", 0.0003, 0.0008, 0.012, 0.0008, 0.02),
    ("study2", 0.0001, 0.0, 0.0, 0.0005, 0.03),
    ("study3", 0.02, 0.02, 0.0, 0.0, 0.0),
    ("study4", 0.0003, 0.0008, 0.012, 0.0008, 0.008),
    ("study5", 0.0001, 0.0006, 0.01, 0.0011, 0.0),
]
NEW = [("study1", 0.001, 0.1, 0.003), ("study4", 0.02, 0.0008, 0.0003), ("study6", 0.001, 0.002, 0.05)]


@pytest.fixture(scope="module")
def table(spark):
    return FeatureTable.from_wide(spark.createDataFrame(WIDE, "id string, f1 double, f2 double, f3 double, f4 double, g1 double"))


@pytest.fixture(scope="module")
def new(spark):
    return FeatureTable.from_wide(spark.createDataFrame(NEW, "id string, g1 double, g2 double, g3 double"))


@pytest.fixture(scope="module")
def data(spark, table):
    raw = spark.createDataFrame([(*p, s, "MNI") for s, ps in FOCI.items() for p in ps], "x int, y int, z int, id string, space string")
    grid = geometry.Grid()
    return Dataset.from_activations(raw, Masker(grid.voxels(spark).select("voxel_id"), grid), features=table, radius=6)


def ids(df):
    return sorted(int(r.study_id[-1]) for r in df.select("study_id").collect())


def test_sphere_sizes_and_rounding(spark):
    g = geometry.Grid()
    assert [len(geometry.kernel(r, g)) for r in (4, 6, 8, 10)] == [33, 123, 257, 515]
    row = spark.range(1).select(*(c.alias(n) for c, n in zip(g.to_index(F.lit(1.0), F.lit(-1.0), F.lit(3.0)), "xyz"))).first()
    assert (row.x, row.y, row.z) == (44, 62, 38)  # halves go to even numbers


def test_stamp_matches_loops(spark):
    g = geometry.Grid((10, 12, 10), 2.0, (5, 6, 5), (-1, 1, 1))
    points = [("a", 1, 1, 1), ("a", 2, 1, 1), ("b", 9, 11, 9)]
    got = {tuple(r) for r in geometry.stamp(spark.createDataFrame(points, "study_id string, xi int, yj int, zk int"), 4, g).collect()}
    want = set()
    for s, *p in points:
        for o in itertools.product(range(-2, 3), repeat=3):
            q = [a + b for a, b in zip(p, o)]
            if 2 * math.dist(p, q) <= 4 and all(0 <= a < n for a, n in zip(q, g.dims)):
                want.add((s, (q[0] * 12 + q[1]) * 10 + q[2]))
    assert got == want


def test_transform_is_the_inverse_and_truncates(spark):
    raw = spark.createDataFrame([(10, -20, 30, "a", "TAL"), (10, -20, 30, "b", "MNI")], "X int, y int, z int, id string, space string")
    t = np.linalg.pinv(np.array(geometry.LANCASTER))
    want = t @ [10, -20, 30, 1]
    exact = {r.study_id: (r.x, r.y, r.z) for r in activations.to_foci(raw, truncate=False).collect()}
    assert np.allclose(exact["a"], want[:3]) and exact["b"] == (10, -20, 30)
    assert {r.study_id: r.x for r in activations.to_foci(raw).collect()}["a"] == math.trunc(want[0])
    with pytest.raises(ValueError):
        activations.to_foci(raw.drop("z"))


def test_points_out_of_the_grid_are_dropped(data):
    assert ids(data.studies) == [1, 2, 3, 4, 5]
    n = {r.study_id: r["count"] for r in data.study_voxel.groupBy("study_id").count().collect()}
    assert n["study1"] == 3 * 123 and n["study4"] == 2 * 123


@pytest.mark.parametrize(
    "text, func, threshold, want",
    [
        ("* &~ (g*)", "sum", 0.003, [3, 5]),
        ("f* > 0.005", "mean", 0.0, [3]),
        ("f* < 0.05", "sum", 0.0, [1, 2, 3, 4, 5]),
        ("f* | g*", "mean", 0.003, [1, 2, 3, 4]),
        ("(f* & g*)", "sum", 0.001, [1, 4]),
    ],
)
def test_expressions(table, text, func, threshold, want):
    assert ids(table.ids_by_expression(text, threshold, func)) == want


def test_phrases(spark):
    t = FeatureTable.from_wide(spark.createDataFrame(WIDE, "id string, f1 double, f2 double, `my ngram` double, `my ngram reprise` double, g1 double"))
    assert ids(t.ids_by_expression("my ngram reprise", 0.001)) == [5]
    assert ids(t.ids_by_expression("my ngram*", 0.01)) == [1, 4, 5]


def test_grammar():
    tree = parse("a &~ b | c > 0.5")
    assert tree.op == "&~" and tree.right.op == "|" and tree.right.right.op == ">" and tree.left == Leaf("a")
    for bad in ("", "a &", "(a", "f1", "a > b"):
        with pytest.raises(ValueError):
            parse(bad)


def test_study_weights(table):
    assert ids(table.study_weights(["f*"], 0.02, "sum")) == [3]
    assert ids(table.study_weights("f*", 0.01, "max")) == [1, 3, 4, 5]
    assert ids(table.study_weights("f*", 0.0, "min")) == [1, 2, 3, 4, 5]
    assert ids(table.study_weights("f*", 0.01, lambda w: max(w))) == [1, 3, 4, 5]
    assert ids(table.study_weights("nothing", 0.0, "sum")) == [1, 2, 3, 4, 5]
    assert ids(table.study_weights("nothing", 0.0, "mean")) == []


def test_sums_at_a_limit_do_not_depend_on_order(spark):
    orders = list(itertools.permutations((0.1, 0.2, 0.3)))
    rows = [(f"study{i}", f"f{k}", w) for i, ws in enumerate(orders) for k, w in enumerate(ws)]
    t = FeatureTable.from_long(spark.createDataFrame(rows, "study_id string, feature string, weight double").coalesce(1))
    every = list(range(len(orders)))
    assert ids(t.study_weights("f*", 0.6)) == every  # 0.6000000000000001 in some orders
    assert {r.weight for r in t.study_weights("f*", 0.6).collect()} == {math.fsum(orders[0])} == {0.6}
    assert ids(t.study_weights("f*", math.nextafter(0.6, 1))) == []
    assert ids(t.study_weights("f*", 0.6 / 3, "mean")) == ids(t.ids_by_expression("f* > 0.6")) == every
    assert ids(t.ids_by_expression(f"f* > {math.nextafter(0.6, 1)!r}")) == ids(t.ids_by_expression("f* < 0.6")) == []


def test_exact_sum(spark):
    rng = np.random.default_rng(0)
    values = [float(x) for x in rng.random(3000) * rng.choice([1e-5, 1.0, 1e3], 3000) * rng.choice([-1, 1], 3000)]
    for v in (values, [0.0], [None, 0.1], [1e300, 1.0], [float("inf"), 1.0], [2.0**23, 2.0**-30]):
        got = spark.createDataFrame([(x,) for x in v], "x double").repartition(3).agg(stats.exact_sum(F.col("x")).alias("s")).first().s
        assert got == math.fsum(x for x in v if x is not None)
    assert spark.createDataFrame([(None,)], "x double").agg(stats.exact_sum(F.col("x")).alias("s")).first().s is None


def test_rounding_is_that_of_duckdb(spark):
    import duckdb

    rng = np.random.default_rng(1)
    x = (rng.integers(16 * 10**9, 32 * 10**9, 2000) + 0.5) / 1e9
    x = [float(v) for v in (*x, *np.nextafter(x, 0), *-np.nextafter(x, 0), 0.0, -0.0, -1e-12, 0.49999999999999994e-9, 1e15)] + [None]
    got = rounded(spark.createDataFrame(list(enumerate(x)), "i int, x double"), "x").orderBy("i").toPandas().x.tolist()
    want = [r for (r,) in duckdb.execute("select round(v, 9) + 0.0 from (select unnest(?::double[]) as v)", [x]).fetchall()]
    assert [g for g in got[:-1]] == want[:-1] and got[-1] != got[-1] and want[-1] is None


def test_merges(table, new):
    def shape(t):
        return t.studies.count(), t.names.count()

    assert shape(table.add(new, append=False)) == (3, 3)
    assert shape(table.add(new)) == (6, 7)
    replaced = table.add(new, duplicates="replace")
    assert shape(replaced) == (6, 7)
    assert replaced.weights.where("study_id = 'study1' and feature = 'g1'").first().weight == 0.001
    left = table.add(new, merge="left", duplicates="merge")
    assert shape(left) == (5, 8) and "g1_y" in left.feature_names()
    assert shape(table.add(new, min_studies=2, threshold=0.003)) == (6, 6)


def test_counts_and_by_ids(table, spark):
    assert {r.feature: r.n for r in table.counts(0.001).collect()} == {"f1": 1, "f2": 1, "f3": 3, "f4": 1, "g1": 3}
    some = spark.createDataFrame([("study1",), ("study2",)], "study_id string")
    assert {r.feature: round(r.weight, 6) for r in table.by_ids(some, 0.005).collect()} == {"f3": 0.006, "g1": 0.025}
    assert table.feature_names(["g1", "f2"]) == ["f2", "g1"]
    wide = {r.study_id: (r.f2, r.g1) for r in table.data(some, ["g1", "f2"], dense=True).collect()}
    assert wide == {"study1": (0.0008, 0.02), "study2": (0.0, 0.03)}


def test_peaks_and_criteria(data):
    assert ids(data.get_studies(peaks=[(3, 30, -9)], radius=1)) == [5]
    found = data.get_studies(peaks=[(3, 30, -9)], radius=40, expression="f* < 0.013", frequency_threshold=0.0)
    assert ids(found) == [2, 5]
    with pytest.raises(ValueError):
        data.get_studies()
    with pytest.raises(ValueError):
        data.get_studies(features="f*", return_type="images")


def test_regions(data):
    ball = regions.sphere(data, (24, -3, 57), 6)
    assert ids(data.by_region(ball, 0.5)) == [3] and ids(data.by_region(ball, 120)) == [3]
    assert regions.create_grid(data.masker.volume, scale=6, apply_mask=False).select("region_id").distinct().count() == 16 * 19 * 16
    both = ball.select(F.lit(0).alias("region_id"), "voxel_id").union(ball.select(F.lit(3).alias("region_id"), "voxel_id"))
    assert {(r.region_id, r.study_id, r.value) for r in regions.average_within_regions(data, both, threshold=0.9).collect()} >= {(3, "study3", True)}


def two_way(a, b, c, d):
    n, out = a + b + c + d, 0
    for x, r, k in ((a, a + b, a + c), (b, a + b, b + d), (c, c + d, a + c), (d, c + d, b + d)):
        e = r * k / n
        out += 1 if e == 0 else (x - e) ** 2 / e
    return out


def test_statistics(spark):
    chi = stats.two_way(*(F.lit(x) for x in (42, 32, 60, 81)))
    row = spark.range(1).select(chi.alias("chi"), stats.chi2_p(chi).alias("p")).first()
    assert abs(row.chi - two_way(42, 32, 60, 81)) < 1e-9 and abs(row.p - 0.04753082) < 1e-6
    p = spark.createDataFrame([(0.005,), (0.1,), (0.2,), (0.5,)], "p double")
    assert stats.fdr(p, 0.05).first().threshold == 0.005
    assert stats.fdr(p.limit(0), 0.05).first().threshold == -1
    zs = spark.createDataFrame([(z / 4, math.erfc(z / 4)) for z in range(40)], "z double, e double")
    assert all(abs(r[0] / r[1] - 1) < 2e-7 for r in zs.select(stats.erfc(F.col("z")), "e").collect())
    z = spark.createDataFrame([(0.05,), (1e-10,)], "p double").select(stats.p_to_z(F.col("p"), F.lit(-1)).alias("z")).collect()
    assert abs(z[0].z + 1.959964) < 1e-4 and abs(z[1].z + 6.466951) < 1e-4


@pytest.mark.parametrize("seed", [1, 2])
def test_analysis_matches_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    g = geometry.Grid((4, 5, 4))
    m = rng.random((g.n, 40)) < rng.random((g.n, 1)) * 0.5
    voxels = spark.createDataFrame([(f"s{j}", int(i)) for i, j in zip(*np.nonzero(m))], "study_id string, voxel_id int")
    foci = spark.createDataFrame([(f"s{j}", 0.0, 0.0, 0.0) for j in range(40)], "study_id string, x double, y double, z double")
    d = Dataset(foci, Masker(g.voxels(spark).select("voxel_id"), g), grid=g, kept_voxels=voxels)
    chosen = [f"s{j}" for j in range(15)] + ["unknown"]
    a = meta.MetaAnalysis(d, spark.createDataFrame([(c,) for c in chosen], "study_id string"), q=0.2, min_studies=3)
    got = {r.voxel_id: r for r in a.images().collect()}
    sa, ua = m[:, :15].sum(1), m[:, 15:].sum(1)
    chi = np.array([two_way(x, y, 15 - x, 25 - y) for x, y in zip(sa, ua)])
    p = np.array([math.erfc(math.sqrt(c / 2)) for c in chi])
    order = np.sort(p)
    ok = order <= np.arange(1, g.n + 1) * 0.2 / g.n
    limit = order[ok].max() if ok.any() else -1
    z = np.sign(sa / 15 - ua / 25) * np.sqrt(chi)
    low = (sa + ua) / 40 < 3 / 40
    for v in range(g.n):
        r = got[v]
        assert math.isclose(r["association-test_z"], 0 if low[v] else z[v], abs_tol=1e-9)
        if abs(p[v] - limit) > 1e-7:
            assert math.isclose(r["association-test_z_FDR_0.2"], 0 if low[v] or p[v] > limit else z[v], abs_tol=1e-9)
        assert math.isclose(r["pA"], 0 if low[v] else (sa[v] + ua[v]) / 40)
        if not low[v] and sa[v]:
            assert math.isclose(r["pFgA_given_pF=0.50"], 0.5 * sa[v] / 15 / (0.5 * sa[v] / 15 + 0.5 * ua[v] / 25))
    assert len(meta.image_names(0.01, 0.5)) == 9


def test_masker(spark):
    g = geometry.Grid((2, 2, 2))
    base = Masker(spark.range(6).select(F.col("id").cast("int").alias("voxel_id")), g)
    layer = spark.createDataFrame([(i, float(i)) for i in range(8)], "voxel_id int, value double")
    m = base.add({"a": layer}).add(layer, above=3, below=4)
    assert list(m.layers) == ["a", "layer_1"]
    assert sorted(r.voxel_id for r in m.mask().collect()) == [3, 4]
    assert sorted(r.voxel_id for r in m.mask(["a", "unknown"]).collect()) == [1, 2, 3, 4, 5]
    assert list(m.remove(-1).layers) == ["a"] and list(m.remove("a").layers) == ["layer_1"]
    with pytest.raises(ValueError):
        m.remove("b")
    odd = spark.createDataFrame([(3, float("nan")), (4, None), (5, 2.0)], "voxel_id int, value double")
    assert {r.voxel_id: r.value for r in m.apply(odd).collect()} == {3: 0.0, 4: 0.0}
    assert m.unmask(layer, "a").count() == 8
    assert {r.voxel_id: r.value for r in m.apply(layer, in_global_mask=True).collect()} == {0: 0, 1: 0, 2: 0, 3: 3.0, 4: 4.0, 5: 0}


def test_decoder_is_a_correlation(spark):
    rng = np.random.default_rng(0)
    maps, image = rng.normal(size=(2, 30)), rng.normal(size=30)
    image[:5] = 0
    m = spark.createDataFrame([(f"f{i}", j, float(maps[i, j])) for i in range(2) for j in range(30)], "feature string, voxel_id int, value double")
    y = spark.createDataFrame([("x", j, float(image[j])) for j in range(30)], "image_id string, voxel_id int, value double")
    voxels = spark.range(30).select(F.col("id").cast("int").alias("voxel_id"))
    d = decode.Decoder("pearson", m, voxels)
    got = {r.feature: r.value for r in d.decode(y).collect()}
    assert all(abs(got[f"f{i}"] - np.corrcoef(maps[i], image)[0, 1]) < 1e-4 for i in range(2))
    dots = {r.feature: r.value for r in d.set_method("dot").decode(y).collect()}
    assert all(abs(dots[f"f{i}"] - maps[i] @ image) < 1e-4 for i in range(2))
    assert decode.top_features(d.decode(y), 1).count() == 1
    with pytest.raises(ValueError):
        d.set_method("other")


def test_clusters(data):
    mask = regions.sphere(data, (24, -3, 57), 8).union(regions.sphere(data, (-48, 9, 60), 8)).select("voxel_id")
    found = cluster.magic(data, roi_mask=mask, reduce_reference="pca", n_components=3, n_clusters=2)
    assert {r.cluster for r in found.select("cluster").distinct().collect()} == {1, 2}
    x = np.random.default_rng(0).laplace(size=(500, 3)) @ np.random.default_rng(1).normal(size=(3, 3))
    assert np.allclose(np.cov(cluster.independent(x), rowvar=False), np.eye(3), atol=0.05)


@pytest.mark.parametrize("radius", [6, 4, 5])
def test_foci_far_from_a_mask_are_not_stamped(spark, data, monkeypatch, radius):
    d = data.with_radius(radius)
    mask = regions.sphere(d, (-30, 15, 20), 24.0)
    want = {(r.study_id, r.voxel_id) for r in d.study_voxel.join(mask, "voxel_id", "left_semi").select("study_id", "voxel_id").collect()}
    seen = []
    monkeypatch.setattr("focalgrid.operators.dataset.stamp", lambda foci, *a: seen.append(foci.count()) or geometry.stamp(foci, *a))
    rows = cluster.Clusterable(d, mask).data.collect()
    assert want and len(rows) == len(want) and {(r.study_id, r.voxel_id) for r in rows} == want
    assert seen and seen[0] < d.foci.count()
    assert cluster.Clusterable(d, mask.limit(0)).data.count() == 0


@pytest.mark.parametrize("limit", [10_000, 6])
def test_clusters_by_studies_keep_the_rows(data, monkeypatch, limit):
    monkeypatch.setattr(cluster, "MAX_ROWS", limit)
    mask = regions.sphere(data, (24, -3, 57), 8).union(regions.sphere(data, (-48, 9, 60), 8)).select("voxel_id")
    taken, real = [], cluster.KMeans

    class Seen(real):
        def fit(self, df):
            taken.append({r.voxel_id: r.features.toArray() for r in df.collect()})
            return super().fit(df)

    monkeypatch.setattr(cluster, "KMeans", Seen)
    cluster.magic(data, "studies", roi_mask=mask, reduce_reference=None, n_clusters=2)
    studies = {}
    for r in cluster.Clusterable(data, mask, None).data.collect():
        studies.setdefault(r.voxel_id, set()).add(r.study_id)
    got = taken[0]
    assert set(got) == set(studies)
    for a, b in itertools.combinations(sorted(got)[::7], 2):
        assert abs(((got[a] - got[b]) ** 2).sum() - len(studies[a] ^ studies[b])) < 1e-6


@pytest.mark.parametrize("studies, voxels, rank", [(60, 40, 4), (12, 8, 20)])
def test_components_without_a_square_matrix(spark, studies, voxels, rank):
    rng = np.random.default_rng(studies)
    x = (rng.random((studies, voxels)) < 0.3).astype(float)
    x[:, : voxels // 2] *= rng.random((studies, 1)) < 0.5
    x[:, 0] = 1  # every study has a row
    rows = [(f"s{i}", int(j)) for i, j in zip(*np.nonzero(x))]
    data = spark.createDataFrame(rows, "study_id string, voxel_id int")
    got = {r.study_id: r.c for r in components.spread_components(data, rank, extra=14, power=5).collect()}
    assert len(got) == studies
    y = np.array([got[f"s{i}"] for i in range(studies)])
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    k = y.shape[1]
    assert k <= rank and np.allclose(s[k:rank], 0, atol=1e-6)
    assert np.allclose(np.linalg.norm(y, axis=0), s[:k], rtol=1e-3)
    assert np.allclose(y.sum(axis=0), 0, atol=1e-6) and np.allclose(y.T @ y, np.diag((y * y).sum(axis=0)), atol=1e-6)
    best = u[:, 0] * s[0]
    assert min(np.abs(y[:, 0] - best).max(), np.abs(y[:, 0] + best).max()) < 1e-2
    if rank > voxels:
        assert cluster.study_components(data, 2, max_studies=5).count() == studies
        assert components.spread_components(data.limit(0), 3, 0, 0).count() == 0


def test_topics_learn_from_all_documents(spark, monkeypatch):
    made, real, asked = [], topics.LDA, []
    monkeypatch.setattr(topics, "LDA", lambda **k: made.append(real(**k)) or made[-1])
    docs = spark.createDataFrame([(i, "apple pear plum" if i % 2 else "nail screw hammer") for i in range(20)], "pmid int, abstract string")
    weights, keys = topics.run_lda(docs, n_topics=2, n_words=3, n_iters=2)
    assert weights.count() == 40 and keys.count() == 2 and made[0].getSubsamplingRate() == 1.0
    monkeypatch.setattr(topics, "run_lda", lambda docs, **k: asked.append(k) or (None, docs))
    QUERIES["lda_topics"](spark, SF)
    assert asked == [{}]


def test_topics_take_each_document_once_and_infer_as_spark(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"{'pq'[i % 2]}{'abcdefghij'[j]}x" for j in rng.integers(0, 10, 5 + 40 * (i % 9 == 0))) for i in range(60)] + ["of the"]
    words = spark.createDataFrame([(str(i), t.split()) for i, t in enumerate(texts)], "doc_id string, kept array<string>")
    counter = topics.CountVectorizer(inputCol="kept", outputCol="features").fit(words.where("doc_id < '60'"))
    counted = counter.transform(words).select("doc_id", "features")
    lda = topics.LDA(k=3, maxIter=4, seed=1, subsamplingRate=1.0, docConcentration=[0.5] * 3, topicConcentration=0.01)
    model = lda.fit(counted)
    matrix = model.topicsMatrix().toArray()
    vectors = topics._vectors(counted)
    mine = np.zeros((len(texts), 3))
    for r in topics.document_topics(vectors, matrix, np.array(model.estimatedDocConcentration().toArray())).collect():
        mine[int(r.doc_id), r.topic] = r.weight
    theirs = {int(r.doc_id): r.topicDistribution.toArray() for r in model.transform(counted).collect()}
    assert max(np.abs(mine[i] - theirs[i]).max() for i in theirs) < 2e-3

    lam, alpha = topics.learn(vectors, lda, len(counter.vocabulary))
    tokens = sum(r.features.values.sum() for r in counted.collect())
    mass = np.random.default_rng(1).gamma(100, 0.01, lam.shape).sum()
    for turn in range(1, 5):
        w = (1024 + turn) ** -0.51
        mass = (1 - w) * mass + w * (tokens + lam.size * 0.01)
    assert lam.sum() == pytest.approx(mass, rel=1e-5)  # Spark draws documents with replacement and misses some
    assert (alpha > 0).all() and np.abs(alpha - 0.5).max() > 1e-4


def test_long_documents_settle_under_flat_topics_in_few_updates(monkeypatch):
    rng, made, real = np.random.default_rng(5), [], np.matmul
    beta = topics.word_weights(rng.gamma(100, 0.01, (3000, 50)))
    words = np.concatenate([rng.permutation(3000)[:1000] for _ in range(8)])
    counts, starts, alpha = rng.integers(1, 4, len(words)).astype(np.float32), np.arange(0, 8001, 1000), np.ones(50)
    sums = np.zeros(beta.shape)
    monkeypatch.setattr(np, "matmul", lambda *a: made.append(1) or real(*a))
    got = topics.infer(starts, words, counts, beta.astype(np.float32), alpha, sums)
    assert len(made) < 400  # two for each update of a group; plain updates took 1,452
    assert np.allclose((sums * beta).sum(axis=1), np.bincount(words, counts, 3000), atol=1e-2)
    assert np.allclose(got.sum(axis=1), np.add.reduceat(counts, starts[:-1]) + 50, rtol=1e-4)
    monkeypatch.setattr(topics, "LEAPS", 0)
    plain = topics.infer(starts, words, counts, beta.astype(np.float32), alpha)
    for i, gamma in [*enumerate(got), *enumerate(plain)]:
        b, c, theta = beta[words[starts[i] : starts[i + 1]]], counts[starts[i] : starts[i + 1]], np.exp(topics.expectation(gamma))
        assert np.abs(theta * ((c / (b @ theta)) @ b) + alpha - gamma).mean() < 2 * topics.SETTLED


def test_classes(spark):
    rows = spark.createDataFrame([(f"s{i}", float(i % 2), [float(i % 2) + 0.01 * i, 1.0, float(i % 7)]) for i in range(60)], "study_id string, label double, x array<double>")
    assert classify.select_features(rows, "1-best") == [0]
    assert len(classify.select_features(rows, "2-randombest")) == 2
    got = classify.classify(rows, "ERF", cross_val="3-Fold", output="summary", regularization="scale", class_weight="auto")
    assert got["score"] > 0.9 and got["n"] == {0.0: 30, 1.0: 30} and got["predictions"].count() == 60
    assert 0 <= classify.classify(rows, "Dummy", output="summary")["score"] <= 1


def test_storage_and_images(spark, data, tmp_path):
    data.masker.volume.limit(1).count()
    data.save(str(tmp_path / "d"))
    again = Dataset.load(spark, str(tmp_path / "d"))
    assert again.study_voxel.count() == data.study_voxel.count() and again.features.feature_names() == data.features.feature_names()
    g = geometry.Grid((3, 4, 5))
    image = spark.createDataFrame([(7, 1.5), (59, -2.0)], "voxel_id int, value double")
    nifti.export(image, str(tmp_path / "x.nii.gz"), g)
    assert {(r.voxel_id, r.value) for r in nifti.read(spark, str(tmp_path / "x.nii.gz")).collect()} == {(7, 1.5), (59, -2.0)}


def test_stream(spark, tmp_path):
    from focalgrid.streaming.foci import append_voxels, read_foci

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.tsv").write_text("x\ty\tz\tid\tspace\n0\t0\t0\ta\tMNI\n")
    foci = read_foci(spark, str(tmp_path / "in"), activations.read(spark, str(tmp_path / "in")).schema)
    append_voxels(foci, str(tmp_path / "out"), str(tmp_path / "check"), 4).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 33


def test_deprecated():
    @utils.deprecated("use another")
    def f():
        return 1

    with pytest.warns(DeprecationWarning):
        assert f() == 1
    utils.set_logging_level("info")


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 100 and set(e.oracle_sql()) <= set(e.queries())
