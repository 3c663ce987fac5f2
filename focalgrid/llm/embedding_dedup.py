"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation of the principal axes, learnt on a bounded sample so that the signs of the rotated components lose little,
gives every vector a binary code.  The code is cut into substrings, one table each; vectors that agree on a substring
meet in a bucket and are compared there by their original components, in double precision.  A pair that shares several
buckets counts in the first table only.  How many tables there are is chosen by the recall of pairs of the threshold's
cosine, planted on the sample's vectors, so it doesn't depend on which pairs the sample holds.

Equal vectors are one row with a weight.  A bucket of more than ``block`` rows is cut into blocks and each pair of
blocks is a group of its own, so no task holds a whole hot bucket.  What leaves a group is a count for each vector and
the edges of a spanning forest, never all pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship
from .graph import components


@dataclass(frozen=True)
class Index:
    """code = signs of (unit vector - mean) @ rotation; ``tables`` substrings.

    ``recall`` is the lower of that on planted pairs of the threshold's cosine and that on the sample's own pairs;
    ``bands`` has (cosine, recall) of planted pairs from the threshold up.
    """

    mean: np.ndarray
    rotation: np.ndarray
    tables: int
    recall: float
    bands: tuple[tuple[float, float], ...] = ()


def itq(sample: np.ndarray, bits: int, rounds: int = 50, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(mean, rotation) of the sample's unit vectors."""
    mean = sample.mean(axis=0)
    _, axes = np.linalg.eigh(np.cov(sample - mean, rowvar=False).reshape(sample.shape[1], -1))
    axes = axes[:, ::-1][:, :bits]
    low = (sample - mean) @ axes
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(low @ turn >= 0, 1.0, -1.0).T @ low)
        turn = (u @ v).T
    return mean, axes @ turn


def substrings(unit: np.ndarray, mean: np.ndarray, rotation: np.ndarray, tables: int) -> np.ndarray:
    """The substring of each vector's code in each table, as numbers."""
    code = (unit - mean) @ rotation >= 0
    out = np.zeros((len(unit), tables), np.int64)
    for t, part in enumerate(np.array_split(np.arange(code.shape[1]), tables)):
        out[:, t] = code[:, part] @ (1 << np.arange(len(part), dtype=np.int64))
    return out


def partners(unit: np.ndarray, cosine: float, seed: int = 0) -> np.ndarray:
    """A vector of the given cosine to each unit vector, in a random direction."""
    off = np.random.default_rng(seed).normal(size=unit.shape)
    off -= (off * unit).sum(axis=1, keepdims=True) * unit
    off /= np.maximum(np.linalg.norm(off, axis=1, keepdims=True), 1e-9)
    out = cosine * unit + np.sqrt(max(0.0, 1 - cosine * cosine)) * off
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _choices(mean: np.ndarray, rotation: np.ndarray, seed: int = 0):
    """(rotation, tables), the fewest tables first.  After the narrowest substrings of one code come codes of further,
    random rotations, and last a code of no bits, which has all vectors in one bucket."""
    size, bits = rotation.shape
    for tables in sorted({max(1, bits // width) for width in (16, 12, 10, 8, 6, 4)}):
        yield rotation, tables
    rng = np.random.default_rng(seed)
    for codes in (2, 4, 8):
        more = [np.linalg.qr(rng.normal(size=(size, size)))[0][:, :bits] for _ in range(codes - 1)]
        yield np.concatenate([rotation, *more], axis=1), codes * max(1, bits // 8)
    yield rotation[:, :0], 1


def fit(sample: np.ndarray, labels: np.ndarray, similarity: float, least_recall: float = 0.99) -> Index:
    """Learn the rotation, and take the fewest tables that find ``least_recall`` of the pairs of exactly ``similarity``.

    Those pairs are planted, 8,192 at least: each distinct vector of the sample's odd rows has as many partners as that
    takes.  The rotation is learnt on the even rows, because it suits the vectors it is learnt on better than others.
    Pairs that the sample itself holds must be found as often; that it holds none says nothing.
    """
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    bits = min(64, unit.shape[1])
    mean, rotation = itq(unit[::2], bits) if len(unit) > 2 else (np.zeros(unit.shape[1]), np.eye(unit.shape[1])[:, :bits])
    own = np.unique(np.column_stack([labels, unit]), axis=0, return_index=True)[1]
    pairs = [np.zeros((2, 0), np.int64)]
    for x in np.unique(labels[own]):
        at = own[labels[own] == x]
        for i in range(0, len(at), 1024):
            a, b = np.nonzero(unit[at[i : i + 1024]] @ unit[at].T >= similarity)
            keep = at[i + a] < at[b]
            pairs.append(np.stack([at[i + a][keep], at[b][keep]]))
    a, b = np.concatenate(pairs, axis=1)
    base = np.unique(unit[1::2] if len(unit) > 1 else unit, axis=0)
    base = np.repeat(base, -(-8192 // len(base)), axis=0)
    cosines = [similarity + (1 - similarity) * x / 4 for x in range(4)]
    planted = [partners(base, c, i) for i, c in enumerate(cosines)]
    for turn, tables in _choices(mean, rotation):
        at = substrings(base, mean, turn, tables)
        bands = tuple((c, float((at == substrings(p, mean, turn, tables)).any(axis=1).mean())) for c, p in zip(cosines, planted))
        sub, met = substrings(unit, mean, turn, tables), np.zeros(len(a), bool)
        for column in sub.T:
            met |= column[a] == column[b]
        recall = min(bands[0][1], float(met.mean()) if len(a) else 1.0)
        if recall >= least_recall:
            break
    return Index(mean, turn, tables, recall, bands)


def _keys(index: Index):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            v = np.array(batch.column("v").flatten()).reshape(len(batch), -1) if len(batch) else np.zeros((0, len(index.mean)))
            sub = substrings(v / np.linalg.norm(v, axis=1, keepdims=True), index.mean, index.rotation, index.tables)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * index.tables), pa.array(sub.ravel()))
            yield pa.record_batch([*(batch.column(c) for c in ("rep", "label", "weight", "v")), lists], ["rep", "label", "weight", "v", "sub"])

    return run


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges from the smallest row of each component of an adjacency matrix to its others."""
    n = len(linked)
    name = np.arange(n)
    while True:
        least = np.where(linked, name[None, :], n).min(axis=1)
        new = np.minimum(name, least)
        new = new[new]
        if (new == name).all():
            return [(int(name[i]), i) for i in np.flatnonzero(name != np.arange(n))]
        name = new


def _compare(similarity: float):
    def run(table):
        import pyarrow as pa

        rep, weight = table.column("rep").to_numpy(), table.column("weight").to_numpy()
        salt, pair = table.column("salt").to_numpy(), table.column("pair").to_numpy()
        where = table.column("at").to_numpy()
        every = table.combine_chunks()
        v = np.array(every.column("v").combine_chunks().flatten(), np.float64).reshape(len(rep), -1)
        sub = np.array(every.column("sub").combine_chunks().flatten()).reshape(len(rep), -1)
        v = v / np.linalg.norm(v, axis=1, keepdims=True)
        bucket = [table.column(c).to_numpy() for c in ("label", "at", "key", "pair")]
        order = np.lexsort((rep, *bucket[::-1]))
        cut = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([b[order][1:] != b[order][:-1] for b in bucket]), [True]]))
        counts: dict[int, int] = {}
        edges = []
        for first, end in zip(cut[:-1], cut[1:]):
            if end - first < 2:
                continue
            rows = order[first:end]
            linked = v[rows] @ v[rows].T >= similarity
            t = int(where[rows[0]])
            for earlier in range(t):
                s = sub[rows, earlier]
                linked &= s[:, None] != s[None, :]
            np.fill_diagonal(linked, False)
            low, high = divmod(int(pair[rows[0]]), 1 << 31)
            if low != high:
                linked &= salt[rows][:, None] != salt[rows][None, :]
            if not linked.any():
                continue
            for r, n in zip(rep[rows].tolist(), (linked @ weight[rows]).tolist()):
                if n:
                    counts[r] = counts.get(r, 0) + n
            edges += [(int(rep[rows[i]]), int(rep[rows[j]])) for i, j in _forest(linked)]
        a = [*counts, *(e[0] for e in edges)]
        b = [*[None] * len(counts), *(e[1] for e in edges)]
        n = [*counts.values(), *[0] * len(edges)]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})

    return run


def near_vectors(vectors: DataFrame, similarity: float = 0.93, max_sample: int = 8192, block: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row a row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors with one label are linked if their cosine is at least ``similarity``.  The index is fitted on the
    ``max_sample`` distinct usable vectors whose hashed ids come first, and holds all vectors.

    Vectors that are null, zero, hold null or non-finite components, or have a null label or id link with nothing.
    Vectors of different lengths have no cosine: each length is a search of its own.  Rows that repeat an id and a vector
    each count as a link of the others; an empty table gives an empty result; other columns are not used.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    big = F.array_max(F.transform("v", F.abs))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.coalesce(big, F.lit(0.0)) > 0)
    good = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & good, F.lit(False))
    sizes = sorted(r.d for r in v.where(good).select(F.size("v").alias("d")).distinct().collect())
    # scaled, so that squares neither overflow nor vanish
    usable = v.where(good).select("vec_id", "label", F.transform("v", lambda x: F.try_divide(x, big)).alias("v"))
    done = v.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    for d in sizes:
        done = done.union(_of_one_size(usable.where(F.size("v") == d), similarity, max_sample, block))
    return done


def _of_one_size(usable: DataFrame, similarity: float, max_sample: int, block: int) -> DataFrame:
    """``near_vectors`` for usable vectors (vec_id, label, v) of one length."""
    distinct = materialize(usable.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight")), "distinct")
    taken = distinct.orderBy(F.xxhash64("rep"), "rep").limit(max_sample).collect()
    names = {x: i for i, x in enumerate(sorted({r.label for r in taken}))}
    index = fit(np.array([r.v for r in taken]), np.array([names[r.label] for r in taken]), similarity)

    reps = materialize(distinct.select("rep", "label", "weight", "v").mapInArrow(_keys(index), "rep long, label string, weight long, v array<double>, sub array<long>"), "codes")
    rows = reps.select("*", F.posexplode("sub").alias("at", "key"))
    hot = reps.select("label", F.posexplode("sub").alias("at", "key")).groupBy("label", "at", "key").agg(F.count(F.lit(1)).alias("n"))
    parts = F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("long")
    rows = rows.join(hot.where("n > 1"), ["label", "at", "key"]).withColumn("parts", parts).drop("n")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("rep"), "parts"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = rows.withColumn("pair", F.least("salt", "other") * (1 << 31) + F.greatest("salt", "other"))
    groups = max(1, reps.count() * index.tables // 4000)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("label", "at", "key", "pair"), F.lit(groups))).drop("parts", "other")
    found = materialize(rows.groupBy("part").applyInArrow(_compare(similarity), "a long, b long, n long"), "links")
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    reached = components(found.where("b is not null")).withColumnRenamed("node", "rep")

    linked = usable.join(distinct.select("label", "v", "rep", "weight"), ["label", "v"]).join(counts, "rep", "left").join(reached, "rep", "left")
    done = linked.select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    return done.withColumn("kept", F.col("vec_id") == F.col("component_id"))


ship(__name__)
