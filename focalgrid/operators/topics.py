"""Topics of abstracts by latent Dirichlet allocation."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizer, RegexTokenizer, StopWordsRemover
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Mean change of a document's topic counts at which they are settled, as in Spark's LDA.
SETTLED = 1e-3

#: Numbers in the word weights of the documents that are worked on at once: they stay in a core's cache.
TOGETHER = 300_000

#: The longest leap, in steps, and the leaps after which documents that haven't settled go on step by step.
LEAP, LEAPS = 64, 500

#: Tokens of a document from which single precision would not settle.
LONG = 5_000

#: Into how many ranges of words the sums of a pass are dealt.
RANGES = 64

VECTOR = pa.schema([("doc_id", pa.string()), ("words", pa.list_(pa.int32())), ("counts", pa.list_(pa.float32()))])


def psi(x: np.ndarray) -> np.ndarray:
    """Digamma of positive numbers: six steps of its recurrence, then the asymptotic series."""
    q, y = x * (x + 5), x + 6
    t = 1 / (y * y)
    series = t * (1 / 12 - t * (1 / 120 - t * (1 / 252 - t * (1 / 240 - t / 132))))
    return np.log(y) - 0.5 / y - series - (2 * x + 5) * (3 * q * q + 20 * q + 24) / (q * (q + 4) * (q + 6))


def trigamma(x: np.ndarray) -> np.ndarray:
    t = 1 / (x + 6)
    u = t * t
    return sum(1 / (x + i) ** 2 for i in range(6)) + t + u / 2 + t * u * (1 / 6 - u * (1 / 30 - u * (1 / 42 - u / 30)))


def expectation(x: np.ndarray) -> np.ndarray:
    """The mean of the logarithm of Dirichlet distributions, one in each row."""
    return psi(x) - psi(x.sum(axis=-1, keepdims=True))


def word_weights(lam: np.ndarray) -> np.ndarray:
    """The exponential of the mean logarithm of each word's probability in each topic."""
    return np.exp(psi(lam) - psi(lam.sum(axis=0)))


def exp_psi(x: np.ndarray) -> np.ndarray:
    """exp(psi(x)) of positive numbers: six steps of digamma's recurrence, then the series around x - 1/2."""
    q, z = x * (x + 5), x + 5.5
    t = 1 / (z * z)
    series = z * (1 + t * (1 / 24 - t * (37 / 5760 - t * (10313 / 2903040 - t * (5509121 / 1393459200)))))
    return series * np.exp(-(2 * x + 5) * ((3 * q + 20) * q + 24) / (q * (q + 4) * (q + 6)))


def infer(starts: np.ndarray, words: np.ndarray, counts: np.ndarray, beta: np.ndarray, alpha: np.ndarray, sums: np.ndarray | None = None, plain: bool = False) -> np.ndarray:
    """The topic counts (gamma) of each document, by Hoffman's updates until they settle; those of one without words are 0.

    Document i has the words ``words[starts[i]:starts[i + 1]]``; ``beta`` is a row of topics for each word.  What the
    documents add to lambda, without the factor of beta, is added to ``sums``.  After two updates a document leaps on by
    the ratio of their steps (Varadhan and Roland, Simple and globally convergent methods for accelerating the convergence
    of any EM algorithm); it has settled only when a whole update changes it by less than ``SETTLED``.  ``plain``: no leaps,
    so that documents settle where Spark's do.
    """
    long, k = np.diff(starts), beta.shape[1]
    out = np.zeros((len(long), k))
    waiting = np.argsort(long, kind="stable")
    waiting = waiting[long[waiting] > 0]
    out[waiting] = 1
    pool = waiting[:0]
    seen, place = np.zeros(len(beta), bool), np.zeros(len(beta), np.int64)
    while len(pool) or len(waiting):
        # documents of about one length, padded to the longest; as half of them settle, others take their places
        room = (len(pool) + np.arange(1, len(waiting) + 1)) * np.maximum(long[waiting], long[pool].max(initial=0)) * k
        more = int(np.searchsorted(room, TOGETHER, side="right"))
        more = more if len(pool) else max(1, more)
        pool, waiting = np.append(pool, waiting[:more]), waiting[more:]
        inside = np.arange(long[pool].max()) < long[pool][:, None]
        at = np.where(inside, starts[pool][:, None] + np.arange(inside.shape[1]), 0)
        ids, c = words[at], np.where(inside, counts[at], 0)
        kind = np.float32 if c.sum(axis=1).max() < LONG else np.float64
        b, c, a, gamma = np.take(beta, ids, axis=0).astype(kind, copy=False), c.astype(kind, copy=False), alpha.astype(kind), out[pool].astype(kind)
        going, last, leaps = np.ones(len(pool), bool), None, 0

        def share(theta, b=b, c=c, kind=kind):
            return c / (np.matmul(b, theta[:, :, None])[:, :, 0] + kind(1e-30))

        def update(gamma, share=share, b=b, a=a):
            theta = exp_psi(gamma)  # in any scale, as shares are in its inverse
            new = theta * np.matmul(share(theta)[:, None, :], b)[:, 0] + a
            return new, np.abs(new - gamma).sum(axis=1)

        def unsettled(new, change, going, pool=pool):
            settled = going & (change < SETTLED * k)
            out[pool[settled]] = new[settled]
            return going & ~settled

        while going.sum() * 2 > len(pool):
            one, change = update(gamma)
            if last is not None:
                # a leap after which an update changes more than before it is taken back
                worse = change > last[2]
                if worse.any():
                    gamma[worse], one[worse], change[worse] = last[0][worse], last[1][worse], last[2][worse]
            going = unsettled(one, change, going)
            two, change = update(one)
            going = unsettled(two, change, going)
            last, step = (one, two, change), one - gamma
            turn = two - one - step
            leap = np.sqrt(np.einsum("ij,ij->i", step, step) / np.maximum(np.einsum("ij,ij->i", turn, turn), kind(1e-30)))
            leap = np.clip(leap, 1, LEAP)[:, None]
            leaps += 1
            gamma = np.maximum(gamma + leap * (2 * step + leap * turn), a) if leaps <= LEAPS and not plain else two
        out[pool[going]] = last[1][going]
        if sums is not None:
            theta = exp_psi(out[pool].astype(kind))
            ended = inside & ~going[:, None]
            named = ids[ended]
            seen[named] = True
            found = np.flatnonzero(seen)
            seen[found], place[found] = False, np.arange(len(found))
            shares = np.zeros((len(pool), len(found)), kind)
            shares[np.nonzero(ended)[0], place[named]] = share(theta)[ended]
            sums[found] += shares.T @ theta
        pool = pool[going]
    return out


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, counts = batch.column("words"), batch.column("counts")
    starts = words.offsets.to_numpy().astype(np.int64)
    return starts - starts[0], words.flatten().to_numpy(), counts.flatten().to_numpy()


def _vectors(counted: DataFrame) -> DataFrame:
    """(doc_id, words, counts) of the sparse vectors of (doc_id, features)."""

    def run(batches):
        for b in batches:
            f = b.column("features")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), f.field("indices").cast(VECTOR.field("words").type), f.field("values").cast(VECTOR.field("counts").type)], schema=VECTOR)

    return counted.mapInArrow(run, "doc_id string, words array<int>, counts array<float>")


def learn(vectors: DataFrame, lda: LDA, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """(lambda, a row of topics for each word; alpha) by the updates of Spark's online LDA, with every document once in each.

    Spark's own would draw the documents of an update with replacement.  Only matrices of words x topics reach the driver.
    """
    spark, k, eta = vectors.sparkSession, lda.getK(), lda.getTopicConcentration()
    alpha = np.array(lda.getDocConcentration(), dtype=float)
    lam = np.random.default_rng(lda.getSeed()).gamma(100, 1 / 100, (vocabulary, k))
    ends = np.linspace(0, vocabulary, RANGES + 1).astype(int)
    # one task for each core: a task's sums are as large as the model
    dealt = vectors.coalesce(spark.sparkContext.defaultParallelism)
    schema = pa.schema([("part", pa.int32()), ("body", pa.binary())])

    for turn in range(1, lda.getMaxIter() + 1):
        known = word_weights(lam)
        model = spark.sparkContext.broadcast((known.astype(np.float32), alpha))

        def expect(batches, model=model):
            beta, alpha = model.value
            total, rest = np.zeros(beta.shape), np.zeros(len(alpha) + 1)
            for batch in batches:
                gamma = infer(*_arrays(batch), beta, alpha, total)
                gamma = gamma[gamma[:, 0] > 0]
                rest += np.append(expectation(gamma).sum(axis=0), len(gamma))
            bodies = [rest.tobytes(), *(total[a:z].tobytes() for a, z in zip(ends, ends[1:]))]
            for part, body in enumerate(bodies):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([body], pa.binary())], schema=schema)

        def add(t: pa.Table) -> pa.Table:
            body = sum(np.frombuffer(x.as_buffer()) for x in t.column("body")).tobytes()
            return pa.Table.from_arrays([t.column("part").slice(0, 1), pa.array([body], pa.binary())], schema=schema)

        sums = dealt.mapInArrow(expect, "part int, body binary").groupBy("part").applyInArrow(add, "part int, body binary")
        got = {r.part: np.frombuffer(r.body) for r in sums.collect()}
        model.destroy()
        rest = got.pop(0, np.zeros(k + 1))
        if not rest[-1]:
            break
        stats = np.concatenate([got[p] for p in sorted(got)]).reshape(vocabulary, k)
        weight = (lda.getLearningOffset() + turn) ** -lda.getLearningDecay()
        lam = (1 - weight) * lam + weight * (stats * known + eta)
        if lda.getOptimizeDocConcentration():
            alpha = _newton(alpha, rest[:-1] / rest[-1], rest[-1], weight)
    return lam, alpha


def _newton(alpha: np.ndarray, logs: np.ndarray, n: float, weight: float) -> np.ndarray:
    """One step of Newton's method on alpha, if it stays positive (Huang, Maximum likelihood estimation of Dirichlet parameters)."""
    gradient = n * (logs - expectation(alpha))
    c, q = n * trigamma(alpha.sum()), -n * trigamma(alpha)
    b = (gradient / q).sum() / (1 / c + (1 / q).sum())
    new = alpha - weight * (gradient - b) / q
    return new if (new > 0).all() else alpha


def document_topics(vectors: DataFrame, lam: np.ndarray, alpha: np.ndarray) -> DataFrame:
    """(doc_id, topic, weight): the share of each topic in each document; all 0 for one without words, as in Spark's."""
    model = vectors.sparkSession.sparkContext.broadcast((word_weights(lam).astype(np.float32), alpha))

    def run(batches):
        beta, alpha = model.value
        for batch in batches:
            gamma = infer(*_arrays(batch), beta, alpha, plain=True)
            out = gamma / np.maximum(gamma.sum(axis=1, keepdims=True), 1e-300)
            weights = pa.ListArray.from_arrays(np.arange(0, out.size + 1, len(alpha), dtype=np.int32), out.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), weights], names=["doc_id", "weights"])

    return vectors.mapInArrow(run, "doc_id string, weights array<double>").select("doc_id", F.posexplode("weights").alias("topic", "weight"))


def run_lda(abstracts: DataFrame, n_topics: int = 50, n_words: int = 31, n_iters: int = 20, alpha: float | None = None, beta: float = 0.001, vocabulary: int = 50_000, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(weights (doc_id, topic, weight), keys (topic, terms)) of abstracts (pmid, abstract).

    ``alpha`` is the sum over the topics, 50 by default.  The optimiser is the online variational one, with all documents
    in every iteration; topics agree with those of a sampler in kind, not in number.
    """
    d = abstracts.where(F.trim("abstract") != "").select(F.col("pmid").cast("string").alias("doc_id"), "abstract")
    words = RegexTokenizer(inputCol="abstract", outputCol="words", pattern=r"[^\p{L}]+", minTokenLength=2).transform(d)
    kept = StopWordsRemover(inputCol="words", outputCol="kept").transform(words)
    counter = CountVectorizer(inputCol="kept", outputCol="features", vocabSize=vocabulary).fit(kept)
    vectors = _vectors(counter.transform(kept).select("doc_id", "features")).repartition(4 * abstracts.sparkSession.sparkContext.defaultParallelism)
    # the parameters; Spark's own fit takes each document alone and was many times slower
    lda = LDA(k=n_topics, maxIter=n_iters, seed=seed, optimizer="online", subsamplingRate=1.0, docConcentration=[(50.0 if alpha is None else alpha) / n_topics] * n_topics, topicConcentration=beta)
    kept_vectors = vectors.persist(StorageLevel.MEMORY_AND_DISK)  # every iteration reads all of them
    lam, alphas = learn(kept_vectors, lda, len(counter.vocabulary))
    kept_vectors.unpersist()
    return document_topics(vectors, lam, alphas), top_words(vectors.sparkSession, lam, counter.vocabulary, n_words)


def top_words(spark, lam: np.ndarray, vocabulary: list[str], n_words: int) -> DataFrame:
    """(topic, terms): the heaviest words of each topic."""
    order = np.argsort(-lam / lam.sum(axis=0), axis=0, kind="stable")[:n_words]
    return spark.createDataFrame([(t, [vocabulary[i] for i in order[:, t]]) for t in range(lam.shape[1])], "topic int, terms array<string>")


# the executors need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
