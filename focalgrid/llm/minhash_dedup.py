"""Near-duplicate documents: MinHash bands, odd sketches and a check on the full shingle sets.

Each document's distinct shingles give MinHash samples.  Bands of samples are the keys of candidate buckets.  For the
documents that meet others, more samples are folded into an *odd sketch*, a bitmap in which each sample flips one bit;
the population count of the XOR of two sketches estimates how many samples differ, and with it the Jaccard similarity.
Candidates whose estimate is clearly too low go; the others are compared on their full shingle sets.

Documents with equal sets are one node.  At first the members of a bucket are compared with one of them only, in a few
rounds with another one each; that joins most groups of copies, and buckets of one component are done.  A last round
takes all pairs of the other buckets' components.  No pair that shares a band is left out, unless its ends are already
linked through others.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import frugal, materialize, ship
from .graph import components

#: Samples in an odd sketch, and its bits.
SKETCH_SAMPLES, SKETCH_BITS = 512, 2048
_LONGS = SKETCH_BITS // 64


def sketch_limit(similarity: float) -> int:
    """The XOR population count expected of two documents of that similarity."""
    return math.ceil(SKETCH_BITS / 2 * (1 - math.exp(-4 * SKETCH_SAMPLES * (1 - similarity) / SKETCH_BITS)))


def shingles_of(data: np.ndarray, offsets: np.ndarray, k: int):
    """The distinct shingles of some texts: (hashes, text of each), ordered by text; a text of fewer words is one shingle."""
    n = len(offsets) - 1
    _, hashes, of = tx.words(data, offsets, tx.tables(lower=True))
    grams, first = tx.shingles(hashes, of, k)
    doc = of[first]
    counts = np.bincount(of, minlength=n)
    if (short := np.flatnonzero((counts > 0) & (counts < k))).size:
        at = np.searchsorted(of, short)
        c = tx.constants(k, 3)
        whole = counts[short].astype(np.uint64)
        for j in range(k - 1):
            more = counts[short] > j
            whole[more] += hashes[at[more] + j] * c[j]
        grams, doc = np.concatenate([grams, tx.mix(whole)]), np.concatenate([doc, short])
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    if len(grams):
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
        grams, doc = grams[new], doc[new]
    return grams, doc


def minhash(grams: np.ndarray, starts: np.ndarray, perms: int, seed: int) -> np.ndarray:
    """``perms`` MinHash samples of each text whose shingles begin at ``starts``."""
    samples = np.zeros((perms, len(starts)), np.uint64)
    flips, factors = tx.constants(perms, seed), tx.constants(perms, seed + 2)
    space = np.empty_like(grams)
    for i in range(perms):
        np.bitwise_xor(grams, flips[i], out=space)
        np.multiply(space, factors[i], out=space)
        samples[i] = np.minimum.reduceat(space, starts)
    return samples


def signatures(data: np.ndarray, offsets: np.ndarray, k: int, bands: int, rows: int):
    """Of some texts: (set sizes, two digests of the sets, keys of the bands); texts without shingles have zeros."""
    n = len(offsets) - 1
    grams, doc = shingles_of(data, offsets, k)
    sizes = np.bincount(doc, minlength=n)
    have = np.flatnonzero(sizes)
    digests, keys = np.zeros((2, n), np.uint64), np.zeros((n, bands), np.uint64)
    if len(have):
        starts = np.searchsorted(doc, have)
        for i, c in enumerate(tx.constants(2, 19)):
            digests[i, have] = np.add.reduceat(tx.mix(grams ^ c), starts)
        samples = minhash(grams, starts, bands * rows, 101)
        c = tx.constants(rows, 107)
        for b in range(bands):
            keys[have, b] = tx.mix(sum(samples[b * rows + j] * c[j] for j in range(rows)) + np.uint64(b))
    return sizes, digests, keys


def sketches(data: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """The odd sketch of each text, as rows of 64-bit numbers."""
    grams, doc = shingles_of(data, offsets, k)
    have = np.unique(doc)
    out = np.zeros((len(offsets) - 1, SKETCH_BITS // 8), np.uint8)
    if len(have):
        samples = minhash(grams, np.searchsorted(doc, have), SKETCH_SAMPLES, 211)
        bit = (tx.mix(samples ^ tx.constants(SKETCH_SAMPLES, 109)[:, None]) % np.uint64(SKETCH_BITS)).astype(np.int64)
        flat = np.bincount((bit + np.arange(len(have)) * SKETCH_BITS).ravel(), minlength=len(have) * SKETCH_BITS) & 1
        out[have] = np.packbits(flat.astype(np.uint8).reshape(len(have), SKETCH_BITS), axis=1)
    return out.view(np.int64)


def _signatures(k: int, bands: int, rows: int):
    @frugal
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = tx.buffers(batch.column("text"))
            for i, j in tx.chunks(offsets):
                at = offsets[i : j + 1]
                sizes, d, keys = signatures(data[at[0] : at[-1]], at - at[0], k, bands, rows)
                some = sizes > 0
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)), pa.array(keys[some].view(np.int64).ravel()))
                yield pa.record_batch([batch.column("doc_id").slice(i, j - i), pa.array(sizes.astype(np.int64)), pa.array(d[0].view(np.int64)), pa.array(d[1].view(np.int64)), lists], ["doc_id", "n_shingles", "d1", "d2", "bands"])

    return run


def _sketches(k: int):
    @frugal
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = tx.buffers(batch.column("text"))
            for i, j in tx.chunks(offsets, tx.CHUNK // 4):
                at = offsets[i : j + 1]
                longs = sketches(data[at[0] : at[-1]], at - at[0], k)
                yield pa.record_batch([batch.column("doc_id").slice(i, j - i), *(pa.array(np.ascontiguousarray(longs[:, x])) for x in range(_LONGS))], ["node", *(f"s{x}" for x in range(_LONGS))])

    return run


def shingle_set(text: str | None, k: int) -> set:
    """The distinct runs of k words of a text, A-Z as a-z; of fewer words the whole sequence; of none the empty set."""
    w = (text or "").encode().lower().split()
    return set(zip(*(w[i:] for i in range(k)))) if len(w) >= k else {tuple(w)} if w else set()


def _confirm(k: int, percent: int):
    @frugal
    def run(batches):
        import pyarrow as pa

        key, left = None, set()
        for batch in batches:
            a, b, ta, tb = (batch.column(c) for c in ("a", "b", "text_a", "text_b"))
            good = []
            for i in range(len(a)):
                text = ta[i].as_py()
                if text != key:
                    key, left = text, shingle_set(text, k)
                right = shingle_set(tb[i].as_py(), k)
                both = len(left & right)
                good.append(bool(left) and 100 * both >= percent * (len(left) + len(right) - both))
            yield pa.record_batch([a, b], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, slack: float = 0.08, centres: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of ``docs``: doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * intersection >= percent * union of their sets of k-word shingles; component_id is
    the smallest id that links reach.  A pair of similarity 0.8 misses all of 32 bands of 4 samples once in 10**7; the
    sketch drops candidates that it estimates ``slack`` below the threshold, over four standard deviations.

    A null or blank text has an empty set and is linked with nothing.  A null id has a null component and is kept.
    Rows that repeat an id are one node.  An empty table gives an empty result; other columns are not used.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    p = materialize(d.mapInArrow(_signatures(k, bands, rows), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"), "signatures")
    able = p.where("n_shingles > 0 and doc_id is not null")
    groups = able.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep"))
    nodes = able.join(groups.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    members = nodes.select(F.explode("bands").alias("key"), F.col("doc_id").alias("node"))
    shared = members.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key")
    met = materialize(members.join(shared, "key"), "buckets")
    texts = materialize(d.join(met.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi"), "texts")
    sketch = [f"s{i}" for i in range(_LONGS)]
    marks = materialize(texts.mapInArrow(_sketches(k), "node long, " + ", ".join(f"{x} long" for x in sketch)), "sketches")
    limit = sketch_limit(percent / 100 - slack)

    def near() -> Column:
        return sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in sketch), F.lit(0)) <= limit

    def confirmed(pairs: DataFrame) -> DataFrame:
        ta = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
        tb = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
        return pairs.join(ta, "a").join(tb, "b").select("a", "b", "text_a", "text_b").mapInArrow(_confirm(k, percent), "a long, b long")

    # rows of the buckets with more than one component
    open_rows = met.select("key", "node", F.col("node").alias("component"))
    tried = links = None
    for turn in range(centres + 1):
        if turn < centres:
            # each bucket's members against one of them: the smallest, then others by hash
            order = F.struct(F.xxhash64("node", F.lit(turn)) if turn else F.lit(0), "node", "component")
            centre = open_rows.groupBy("key").agg(F.min(order).alias("c")).select("key", F.col("c.node").alias("centre"), F.col("c.component").alias("own"))
            pairs = open_rows.join(centre, "key").where("component <> own").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
            pairs = pairs.join(marks.alias("x"), F.col("a") == F.col("x.node")).join(marks.alias("y"), F.col("b") == F.col("y.node")).where(near()).select("a", "b")
        else:
            # a pair that shares several buckets is taken in the one of the least key; a node has at most ``bands`` keys
            keys = open_rows.groupBy("node").agg(F.collect_set("key").alias("keys"))
            full = open_rows.join(marks, "node").join(keys, "node")
            same = (F.col("x.key") == F.col("y.key")) & (F.col("x.component") < F.col("y.component"))
            first = F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key")
            pairs = full.alias("x").join(full.alias("y"), same & near() & first).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        new = materialize(confirmed(pairs), "links")
        tried = pairs if tried is None else tried.union(pairs)
        if turn and new.isEmpty():
            continue
        links = new if links is None else links.union(new)
        reached = materialize(components(links), "components")
        # a bucket of one component stays one
        named = open_rows.select("key", "node").join(reached, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
        mixed = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
        open_rows = materialize(named.join(mixed, "key", "left_semi"), "open")

    named = able.select("doc_id", "n_shingles", "d1", "d2").join(groups, ["n_shingles", "d1", "d2"])
    named = named.join(reached.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    alone = p.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return named.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


ship(__name__)
