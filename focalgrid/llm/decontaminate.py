"""Benchmark passages in documents, found with the q-gram lemma and banded alignment.

Texts are compared with A-Z and the capitals of Latin-1 in lower case and runs of white space as one space.  An item of m bytes is in a document if a
stretch of it is within e = ``edit_share`` * m edits of the whole item.  Such a stretch shares at least
m - q + 1 - q * e of the item's q-grams, on diagonals that lie within e of each other.  So the shared q-grams are
counted in overlapping bands of 2 * e + 1 diagonals; bands that reach the bound go to a banded alignment.  e is at most
(m - q) / q, which keeps the bound positive: a smaller ``q`` allows more edits and gives more bands to align.

The items' q-gram index is built on the driver and sent to the executors.  Its size is checked: it takes about 40 bytes a
byte of the items, and items beyond ``block_bytes`` are searched in several passes of one block each, whose results are
written before the next block is read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .common import frugal, materialize, ship


def normalise(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes with capitals lowered and each run of white space as one space, the place of each in ``data``)."""
    low = data + ((data >= 65) & (data <= 90)) * np.uint8(32)
    latin = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
    low[1:] += latin * np.uint8(32)
    white = (low == 32) | ((low >= 9) & (low <= 13))
    low[white] = 32
    keep = ~white
    keep[1:] |= ~white[:-1]
    if len(keep):
        keep[0] |= True
    at = np.flatnonzero(keep)
    return low[at], at


def grams(data: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each run of q bytes (8 <= q <= 16)."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    m = len(data) - 7
    eight = np.empty(m, np.uint64)
    raw = data.tobytes()
    for j in range(min(8, m)):
        eight[j::8] = np.frombuffer(raw, "<u8", (m - j + 7) // 8, j)
    c = tx.constants(2, 307)
    out = eight[:n] * c[0]
    out ^= out >> np.uint64(29)
    out += eight[q - 8 :]
    out *= c[1]
    return out ^ (out >> np.uint64(32))


class Index:
    """The q-grams of some items and the bounds of the lemma."""

    def __init__(self, items: list[tuple[int, str]], q: int, edit_share: float):
        self.q = q
        self.ids: list[int] = []
        self.texts: list[bytes] = []
        short: list[tuple[int, bytes]] = []
        for item_id, text in items:
            norm = normalise(np.frombuffer((text or "").encode(), np.uint8))[0].tobytes().strip()
            if len(norm) >= q:
                self.ids.append(item_id)
                self.texts.append(norm)
            elif norm:
                short.append((item_id, norm))
        m = np.array([len(t) for t in self.texts], np.int64)
        #: items without a q-gram, by text: they leak as whole documents only
        self.short: dict[bytes, list[int]] = {}
        for item_id, norm in short:
            self.short.setdefault(norm, []).append(item_id)
        self.edits = np.minimum((m * edit_share).astype(np.int64), np.maximum(0, (m - q) // q))
        self.need = np.maximum(1, m - q + 1 - q * self.edits)
        self.reach = int((m + 2 * self.edits).max()) if len(m) else 0
        g = [grams(np.frombuffer(t, np.uint8), q) for t in self.texts]
        every = np.concatenate(g) if g else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.keys, first, count = np.unique(every[order], return_index=True, return_counts=True)
        self.first, self.count = first, count
        self.item = np.repeat(np.arange(len(g)), [len(x) for x in g])[order] if g else np.zeros(0, np.int64)
        self.place = np.concatenate([np.arange(len(x)) for x in g])[order] if g else np.zeros(0, np.int64)
        self.bits = max(16, int(np.ceil(np.log2(len(every) + 1))) + 4)
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[(self.keys >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def regions(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(text, item, first diagonal of a band) of every band that reaches the bound."""
        none = np.zeros((0, 3), np.int64)
        g = grams(data, self.q)
        if not len(g) or not len(self.keys):
            return none
        at = np.flatnonzero(self.seen[(g >> np.uint64(64 - self.bits)).astype(np.int64)])
        # only where the least bound of all items is reached within the longest reach
        k = int(self.need.min())
        if len(at) < k:
            return none
        dense = np.flatnonzero(at[k - 1 :] - at[: len(at) - k + 1] <= self.reach)
        near = np.zeros(len(at) + 1, np.int64)
        np.add.at(near, dense, 1)
        np.add.at(near, dense + k, -1)
        at = at[np.cumsum(near[:-1]) > 0]
        key = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
        real = self.keys[key] == g[at]
        at, key = at[real], key[real]
        text = np.searchsorted(offsets, at, "right") - 1
        inside = at + self.q <= offsets[text + 1]
        at, key, text = at[inside], key[inside], text[inside]
        n = self.count[key]
        post = np.repeat(self.first[key], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item, place = self.item[post], self.place[post]
        diagonal = np.repeat(at, n) - place
        text = np.repeat(text, n)
        step = np.maximum(1, self.edits[item])
        band = diagonal // step
        rows = np.concatenate([np.stack([text, item, band]), np.stack([text, item, band - 1])], axis=1).T
        if not len(rows):
            return none
        rows = rows[np.lexsort(rows.T[::-1])]
        new = np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])
        first = np.flatnonzero(new)
        count = np.diff(np.concatenate([first, [len(rows)]]))
        rows = rows[first][count >= self.need[rows[first, 1]]]
        rows[:, 2] *= np.maximum(1, self.edits[rows[:, 1]])
        return rows

    def matches(self, data: np.ndarray, offsets: np.ndarray):
        """(text, item, first byte, end, edits) of every stretch found; those of one item don't overlap."""
        last: tuple[int, int, int] = (-1, -1, -1)
        for text, item, diagonal in self.regions(data, offsets).tolist():
            e, want = int(self.edits[item]), self.texts[item]
            low = max(int(offsets[text]), diagonal - e)
            high = min(int(offsets[text + 1]), diagonal + 3 * e + len(want) + 1)
            if last[:2] == (text, item) and diagonal + e < last[2]:
                continue
            part = data[low:high].tobytes()
            found = part.find(want)
            hit = (found, found + len(want), 0) if found >= 0 else align(want, part, e)
            if hit is not None:
                last = (text, item, low + hit[1])
                yield text, item, low + hit[0], low + hit[1], hit[2]


def align(want: bytes, part: bytes, limit: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the stretch of ``part`` that is nearest to ``want``, or None if it takes more than ``limit`` edits.

    Rows of the alignment are kept only for the diagonals of ``part``: a band, as ``part`` is little longer than ``want``.
    """
    a, b = np.frombuffer(want, np.uint8), np.frombuffer(part, np.uint8)

    def ends(x: np.ndarray, y: np.ndarray, free: bool) -> np.ndarray:
        """The edits that turn x into the y[.. :j] of each end j; from any start if ``free``, else from the first byte."""
        width = len(y) + limit - len(x) + limit + 1  # diagonals -limit .. len(y) - len(x) + limit
        k = np.arange(width)
        far = 1 << 20
        padded = np.concatenate([np.zeros(limit, np.int16), y.astype(np.int16), np.zeros(width + limit, np.int16)])
        ok = np.concatenate([np.zeros(limit, bool), np.ones(len(y), bool), np.zeros(width + limit, bool)])
        row = np.where(k >= limit, 0 if free else k - limit, far)
        row = np.where(k - limit <= len(y), row, far)
        for i in range(len(x)):
            y_here = padded[i : i + width]
            new = np.where(ok[i : i + width], row + (y_here != x[i]), far)
            new[:-1] = np.minimum(new[:-1], row[1:] + 1)
            row = np.minimum.accumulate(new - k) + k
            # the least of a row never falls again
            if i % 8 == 7 and row.min() > limit:
                break
        return row

    if len(b) + 2 * limit < len(a):
        return None
    row = ends(a, b, True)
    at = np.arange(len(row)) - limit + len(a)
    row = np.where((at >= 0) & (at <= len(b)), row, 1 << 20)
    edits = int(row.min())
    if edits > limit:
        return None
    end = int(at[row.argmin()])
    back = b[:end][::-1]
    row = ends(a[::-1], back, False)
    at = np.arange(len(row)) - limit + len(a)
    row = np.where((at >= 0) & (at <= len(back)), row, 1 << 20)
    return end - int(at[row.argmin()]), end, edits


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """How many blocks of items there are, and a generator of them: the driver holds one block's items at a time."""
    b = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id is not null and text is not null")
    size = b.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()[0] or 0
    n = int(size // block_bytes + 1)
    part = F.pmod(F.xxhash64("item_id"), F.lit(n))
    return n, (sorted((r.item_id, r.text) for r in b.where(part == i).collect()) for i in range(n))


def _search(index: Index, column):
    """(row, item, start, end, edits) of every match in an Arrow column of texts; places in code points of the text."""
    data, offsets = tx.buffers(column)
    for i, j in tx.chunks(offsets):
        at = offsets[i : j + 1]
        raw = data[at[0] : at[-1]]
        norm, place = normalise(raw)
        ends = np.searchsorted(place, at - at[0])
        for k in np.flatnonzero(np.diff(ends) <= index.q + 1).tolist() if index.short else ():
            whole = norm[ends[k] : ends[k + 1]].tobytes()
            for item_id in index.short.get(whole.strip(), ()):
                skip = len(whole) - len(whole.lstrip())
                begin = int(at[k] - at[0])
                first, last = (int(place[ends[k] + x]) for x in (skip, skip + len(whole.strip()) - 1))
                yield i + k, item_id, *(int(np.count_nonzero((raw[begin:x] & 0xC0) != 0x80)) for x in (first, last + 1)), 0
        for k, item, start, end, edits in index.matches(norm, ends):
            begin = int(at[k] - at[0])
            first, last = int(place[start]), int(place[end - 1]) + 1
            chars = [int(np.count_nonzero((raw[begin:x] & 0xC0) != 0x80)) for x in (first, last)]
            yield i + k, index.ids[item], chars[0], chars[1], edits


def leaks(docs: DataFrame, benchmark: DataFrame, edit_share: float = 0.05, q: int = 12, block_bytes: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row a match: doc_id, item_id, start, end (code points of the text), edits.

    Null and blank texts and items match nothing; items under ``q`` bytes match documents that hold nothing else, as they
    would be found in most others by chance; a null id of a document is carried, an
    item with a null id is not searched.  Items that are equal each match.  Rows that repeat are searched each.  An
    empty table on either side gives an empty result; other columns are not used.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    n, blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    for items in blocks:
        index = Index(items, q, edit_share)

        @frugal
        def run(batches, index=index):
            import pyarrow as pa

            for batch in batches:
                rows = list(_search(index, batch.column("text")))
                ids = batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.record_batch([ids, *(pa.array([r[x] for r in rows], pa.int64()) for x in range(1, 5))], ["doc_id", "item_id", "start", "end", "edits"])

        some = d.mapInArrow(run, "doc_id long, item_id long, start long, end long, edits long")
        some = some if n == 1 else materialize(some, "leaks")
        out = some if out is None else out.union(some)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, edit_share: float = 0.05, q: int = 12, block_bytes: int = 4 << 20, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns; cases as in ``leaks``."""
    out = docs
    where = docs.columns.index(text_col)
    n, blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    for items in blocks:
        index = Index(items, q, edit_share)

        @frugal
        def run(batches, index=index):
            import pyarrow as pa

            for batch in batches:
                keep = np.ones(len(batch), bool)
                keep[[r[0] for r in _search(index, batch.column(where))]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, T.StructType(docs.schema.fields))
        out = out if n == 1 else materialize(out, "clean")
    return out


ship(__name__)
