"""Packing documents into training sequences by linear grouping and best fit.

Lengths are whole numbers up to the capacity, so a histogram of them, of bounded size, is all that the plan needs:

1. *Group.*  Long lengths, ordered, fall into groups of equal cardinality; each counts as its group's largest.
2. *Optimise.*  The configurations of these few sizes that fill a sequence are chosen by a linear programme with column
   generation; whole multiples of them are used.
3. *Substitute.*  The real documents take the places of their groups, in order.
4. *Best fit.*  What is left and all short documents go, longest first, where the least room is left.

Every step handles runs of equal sequences at once.  Its outcome is a table of runs, (length, rank) to (sequence,
offset), of bounded size; a document finds its place by its rank among those of its length.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, materialize, once, ship

#: Words whose ids a worker process keeps.
KEPT_WORDS = 500_000

#: Fixed value: the pattern by which the vocabulary splits text before its merges.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Texts of other characters take the library's own path: there, rules for case and white space could differ.
_PLAIN = r"[\x09-\x0d\x20-\x7e\xa1-\xffĀ-įı-ſ‐-‧‰-⁞€]*"


class WordTokenizer:
    """``encode`` of a lower-casing word vocabulary, with the ids of each white-space-separated word remembered."""

    def __init__(self, spec: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(spec)
        self.model = self.whole.model
        self.split = regex.compile(_SPLIT)
        self.plain = re.compile(_PLAIN)
        self.known: dict[str, bytes] = {}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        # the library takes added tokens out of a text before anything else, so a text that may hold one is left to it
        added = [t["content"] for t in json.loads(spec).get("added_tokens") or []]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.IGNORECASE)
        self.cached = '"Lowercase"' in spec and _SPLIT.replace("\\", "\\\\") in spec and not any(re.search(r"\s", t) for t in added)

    def word(self, w: str) -> bytes:
        out: list[int] = []
        for piece in self.split.findall(w):
            if not piece.isascii():
                piece = "".join([self.letters[b] for b in piece.encode()])
            out += [t.id for t in self.model.tokenize(piece)]
        return np.array(out, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not self.cached or self.added.search(text) or not self.plain.fullmatch(text) or not unicodedata.is_normalized("NFC", text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        known = self.known
        if len(known) > KEPT_WORDS:
            known.clear()
        words = text.lower().split()
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = self.word(w)
            return b"".join([known[w] for w in words])


def _pieces(spec: str, capacity: int, end_id: int, with_ids: bool):
    @frugal
    def run(batches):
        import pyarrow as pa

        tokens = once(f"tokenizer {zlib.crc32(spec.encode())}", lambda: WordTokenizer(spec))
        last = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out = defaultdict(list)
            for k, value in enumerate(batch.column("text")):
                ids = tokens.encode(value.as_py() or "") + last
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for name, x in zip(("row", "piece", "start", "length", "crc", "ids"), (k, piece, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None)):
                        out[name].append(x)
            docs = batch.column("doc_id").take(pa.array(out["row"], pa.int64()))
            ids = pa.array([None if x is None else np.frombuffer(x, "<u4").astype(np.int64) for x in out["ids"]], pa.list_(pa.int64()))
            yield pa.record_batch([docs, pa.array(out["piece"], pa.int32()), pa.array(out["start"], pa.int64()), pa.array(out["length"], pa.int64()), pa.array(out["crc"], pa.int64()), ids], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return run


def _fill(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits the capacity: (value, count of each size)."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    size, worth = np.array(sizes)[order], np.asarray(values)[order]
    for room in range(int(size[0]), capacity + 1):
        fit = int(np.searchsorted(size, room, "right"))
        got = best[room - size[:fit]] + worth[:fit]
        i = int(got.argmax())
        best[room] = best[room - 1]
        if got[i] > best[room] + 1e-12:
            best[room], take[room] = got[i], order[i]
    counts, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if take[room] < 0:
            room -= 1
        else:
            counts[take[room]] += 1
            room -= sizes[take[room]]
    return float(best[capacity]), counts


def configurations(sizes: list[int], demand: list[int], capacity: int, max_rounds: int = 400) -> list[tuple[float, np.ndarray]]:
    """(how often, count of each size): a fractional cover of the demand by few configurations, by column generation."""
    m = len(sizes)
    columns = np.diag([float(capacity // s) for s in sizes])
    need = np.array(demand, float)
    inverse = np.diag([1.0 / (capacity // s) for s in sizes])
    x = inverse @ need
    for _ in range(max_rounds):
        value, new = _fill(sizes, inverse.sum(axis=0), capacity)
        if value <= 1 + 1e-7:
            break
        step = inverse @ new
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        columns[:, out] = new
        inverse = np.linalg.inv(columns)
        x = np.maximum(inverse @ need, 0)
    return [(float(x[i]), columns[:, i]) for i in range(m) if x[i] > 0]


def plan(histogram: dict[int, int], capacity: int, groups: int = 32, long_share: float = 1 / 6) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, first rank, end rank, first sequence, offset, documents a sequence) and the number of sequences."""
    runs: list[tuple[int, int, int, int, int, int]] = []
    left = {n: c for n, c in histogram.items() if c}
    ranks = dict.fromkeys(left, 0)
    sequences = 0
    # runs of sequences of one fill: fill -> [(first, end)]
    open_runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
    if full := left.pop(capacity, 0):
        runs.append((capacity, 0, full, 0, 0, 1))
        sequences = full
    longs = sorted((n for n in left if n > capacity * long_share), reverse=True)
    total = sum(left[n] for n in longs)
    if total:
        members: list[list[list[int]]] = [[]]
        size, each = 0, max(1, -(-total // groups))
        for n in longs:
            c = left[n]
            while c:
                if size >= each:
                    members.append([])
                    size = 0
                some = min(c, each - size)
                members[-1].append([n, some])
                size += some
                c -= some
        merged: dict[int, list[list[int]]] = {}
        for g in members:
            merged.setdefault(g[0][0], []).extend(g)
        sizes = list(merged)
        demand = [sum(c for _, c in merged[s]) for s in sizes]
        queues = [merged[s] for s in sizes]
        for often, counts in configurations(sizes, demand, capacity):
            whole = int(often + 1e-9)
            slots = [i for i, c in enumerate(counts.astype(int)) for _ in range(c)]
            while whole > 0:
                # as many equal sequences as the documents at the heads of the queues allow
                n_of = [0] * len(sizes)
                for i in slots:
                    n_of[i] += 1
                if any(not queues[i] for i in slots):
                    break
                same = min([whole, *(queues[i][0][1] // n_of[i] for i in set(slots))])
                fill = 0
                if same:
                    for i in slots:
                        n = queues[i][0][0]
                        runs.append((n, ranks[n], ranks[n] + same, sequences, fill, 1))
                        ranks[n] += same
                        left[n] -= same
                        queues[i][0][1] -= same
                        fill += n
                else:
                    same = 1
                    took = []
                    for i in slots:
                        while queues[i] and not queues[i][0][1]:
                            queues[i].pop(0)
                        if not queues[i]:
                            break
                        queues[i][0][1] -= 1
                        took.append((i, queues[i][0][0]))
                    for _, n in took:
                        runs.append((n, ranks[n], ranks[n] + 1, sequences, fill, 1))
                        ranks[n] += 1
                        left[n] -= 1
                        fill += n
                    if not took:
                        break
                open_runs[fill].append((sequences, sequences + same))
                sequences += same
                whole -= same
                for i in set(slots):
                    while queues[i] and not queues[i][0][1]:
                        queues[i].pop(0)
    fills = sorted(open_runs)
    for n in sorted(left, reverse=True):
        while left[n]:
            at = bisect_left(fills, capacity - n + 1) - 1
            if at < 0:
                # new sequences, filled with this length at once where it leaves whole ones
                per = capacity // n
                whole, rest = divmod(left[n], per)
                groups_new = [(whole, per)] * bool(whole) + [(1, rest)] * bool(rest)
                for often, q in groups_new:
                    runs.append((n, ranks[n], ranks[n] + often * q, sequences, 0, q))
                    ranks[n] += often * q
                    left[n] -= often * q
                    if q * n not in open_runs or not open_runs[q * n]:
                        insort(fills, q * n)
                    open_runs[q * n].append((sequences, sequences + often))
                    sequences += often
                continue
            fill = fills[at]
            first, end = open_runs[fill].pop()
            if not open_runs[fill]:
                fills.pop(at)
            per = (capacity - fill) // n
            often, q = (min(end - first, left[n] // per), per) if left[n] >= per else (1, left[n])
            runs.append((n, ranks[n], ranks[n] + often * q, first, fill, q))
            ranks[n] += often * q
            left[n] -= often * q
            for new, a, b in ((fill + q * n, first, first + often), (fill, first + often, end)):
                if a < b and new < capacity:
                    if not open_runs[new]:
                        insort(fills, new)
                    open_runs[new].append((a, b))
    return runs, sequences


def best_plan(histogram: dict[int, int], capacity: int, groups: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """The plan of fewest sequences where lengths over a half, a third or a sixth of the capacity count as long."""
    return min((plan(histogram, capacity, groups, share) for share in (1 / 2, 1 / 3, 1 / 6)), key=lambda x: x[1])


def pack(docs: DataFrame, spec: str, capacity: int = 2048, end_id: int = 0, groups: int = 32, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with ``with_ids`` its ids, else null.

    ``spec`` is the content of a tokenizer file.  A document is its text's ids and then ``end_id``; only one longer than
    ``capacity`` is cut.  A null or empty text is one piece of one id.  Rows that repeat an id, or have none, are
    documents of their own.  An empty table gives an empty result; other columns are not used.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = materialize(d.mapInArrow(_pieces(spec, capacity, end_id, with_ids), "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<long>"), "pieces")
    spark = d.sparkSession
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    runs, _ = best_plan(histogram, capacity, groups)
    # ranks: a length of very many pieces is dealt into parts, each ranked by itself
    part = max(200, sum(histogram.values()) // 100_000)
    parts = F.greatest(F.lit(1), (F.col("n") / part).cast("long"))
    lengths = spark.createDataFrame(sorted(histogram.items()), "length long, n long").select("length", parts.alias("parts"))
    dealt = pieces.join(F.broadcast(lengths), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), "parts")).drop("parts")
    counted = dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 100,000 rows more than ``capacity``
    before: dict[int, int] = defaultdict(int)
    bases = []
    for r in sorted(counted):
        bases.append((r.length, r.part, before[r.length]))
        before[r.length] += r.n
    bases_df = spark.createDataFrame(bases, "length long, part long, base long")
    from pyspark.sql import Window

    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(F.broadcast(bases_df), ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base"))
    places = spark.createDataFrame(runs, "length long, first long, until long, sequence long, at long, per long").withColumnRenamed("length", "of")
    found = ranked.join(F.broadcast(places), (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("until")))
    k = F.col("rank") - F.col("first")
    sequence = F.col("sequence") + F.floor(k / F.col("per")).cast("long")
    offset = F.col("at") + k % F.col("per") * F.col("length")
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), offset.alias("offset"), "ids")


ship(__name__)
