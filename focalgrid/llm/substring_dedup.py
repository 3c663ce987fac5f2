"""Removal of repeated passages by digests, and by Aho-Corasick automata over the documents that hold one.

A *window* is ``n_words`` consecutive words of one document.  A word goes if some window that covers it has a word
sequence that also starts in a document with a smaller id.

1. *Filter.*  The documents are dealt into shards of bounded bytes.  Of each window the least hash of its inner
   7-word runs (for 13 words: a quarter as many as windows) goes as a 39-bit print to the bucket of its hash, once a
   shard.  Buckets answer each shard with the prints that two documents have.  Equal windows have equal prints, so no
   repeat is lost; a chance agreement only costs work.
2. *Confirm.*  A shard sends the 96-bit digests of the windows that are left, each with its smallest document; a
   bucket answers with those that another shard has in a smaller one.
3. *Locate.*  The digests tell which windows of a shard's documents are confirmed.  The documents that hold one go, in
   batches, through Aho-Corasick automata of at most ``MAX_WORDS`` words of the batch's own confirmed passages, so a
   window goes only if its words are found; other documents are not streamed.

What a shard sends is aggregated first, so a passage that a third of all documents share is one entry a shard.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import ship, text_bytes

#: Words of passages in one automaton, which takes about 100 bytes a word.
MAX_WORDS = 300_000

_PRINT_BITS, _SHIFT = 39, 25
_OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, removed_spans string"


def _wide(prints: np.ndarray) -> bytes:
    """40-bit numbers as 5 bytes each."""
    return np.ascontiguousarray(prints.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _narrow(blob: bytes) -> np.ndarray:
    raw = np.zeros((len(blob) // 5, 8), np.uint8)
    raw[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return raw.view("<u8").ravel().astype(np.uint64)


def _least(hashes: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(the least inner run's hash of each window, the window's first word)."""
    k = n // 2 + 1
    last = len(hashes) - n + 1
    if last <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    c = tx.constants(k, 31)
    m = len(hashes) - k + 1
    runs = hashes[:m] * c[0]
    for j in range(1, k):
        runs += hashes[j : j + m] * c[j]
    runs = tx.mix(runs)
    out = runs[:last].copy()
    for j in range(1, n - k + 1):
        np.minimum(out, runs[j : j + last], out=out)
    at = np.flatnonzero(of[:last] == of[n - 1 :])
    return out[at], at


def _windows(table, n: int, ids: np.ndarray):
    """For each chunk of a shard: (first text, offsets, word hashes, text of each word, least hashes, their first words, ids of the windows)."""
    t = tx.tables()
    data, offsets = tx.buffers(table.column("text"))
    for i, j in tx.chunks(offsets):
        at = offsets[i : j + 1]
        _, hashes, of = tx.words(data[at[0] : at[-1]], at - at[0], t)
        least, first = _least(hashes, of, n)
        yield i, hashes, of, least, first, ids[i:j][of[first]]


def _ids(table) -> tuple[np.ndarray, np.ndarray]:
    import pyarrow.compute as pc

    column = table.column("doc_id")
    return pc.fill_null(column, 0).to_numpy(), ~pc.is_null(column).to_numpy(zero_copy_only=False)


def _extremes(keys: list[np.ndarray], ids: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Group by the keys, the first of which comes first: (distinct keys, smallest id, whether two ids differ)."""
    if not len(ids):
        return keys, ids, np.zeros(0, bool)
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    keys, ids = [k[order] for k in keys], ids[order]
    new = np.ones(len(ids), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    low = np.minimum.reduceat(ids, at)
    return [k[at] for k in keys], low, low != np.maximum.reduceat(ids, at)


def _send_prints(table, *, n: int, buckets: int):
    import pyarrow as pa

    ids, known = _ids(table)
    got: list[tuple[np.ndarray, np.ndarray]] = []
    for _, _, _, least, _, row in _windows(table, n, np.arange(len(ids))):
        keep = known[row]
        least, doc = least[keep], ids[row[keep]]
        if len(least):
            new = np.ones(len(least), bool)
            new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
            got.append((least[new], doc[new]))
    shard = table.column("shard")[0].as_py() if len(table) else 0
    out: dict[str, list] = {"bucket": [], "shard": [], "blob": []}
    if got:
        (h,), _, many = _extremes([np.concatenate([x for x, _ in got])], np.concatenate([x for _, x in got]))
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        prints = (h >> np.uint64(_SHIFT)) << np.uint64(1) | many.astype(np.uint64)
        order = np.argsort(bucket, kind="stable")
        bucket, prints = bucket[order], prints[order]
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        for i, j in zip(cut, [*cut[1:], len(bucket)]):
            out["bucket"].append(int(bucket[i]))
            out["shard"].append(shard)
            out["blob"].append(_wide(prints[i:j]))
    return pa.table({"bucket": pa.array(out["bucket"], pa.int64()), "shard": pa.array(out["shard"], pa.int64()), "blob": pa.array(out["blob"], pa.binary())})


def _answer_prints(table):
    import pyarrow as pa

    shards, blobs = table.column("shard").to_pylist(), [_narrow(x) for x in table.column("blob").to_pylist()]
    every = np.concatenate(blobs) if blobs else np.zeros(0, np.uint64)
    # a print that two shards sent, or one shard of two documents
    prints = np.sort(every >> np.uint64(1))
    repeated = np.unique(np.concatenate([prints[1:][prints[1:] == prints[:-1]], every[(every & np.uint64(1)) == 1] >> np.uint64(1)]))
    del every, prints
    bucket = table.column("bucket")[0].as_py() if len(table) else 0
    rows = []
    for s, blob in zip(shards, blobs if len(repeated) else []):
        own = blob >> np.uint64(1)  # each once, in order
        own = own[repeated[np.minimum(np.searchsorted(repeated, own), len(repeated) - 1)] == own]
        if len(own):
            rows.append((bucket, s, b"p", _wide(own)))
    return pa.table({k: pa.array([r[i] for r in rows], kind) for i, (k, kind) in enumerate((("bucket", pa.int64()), ("shard", pa.int64()), ("kind", pa.binary()), ("blob", pa.binary())))})


def _left(docs, answers, n: int, buckets: int, ids: np.ndarray, known: np.ndarray):
    """For each chunk: the windows whose print two documents have, as (first text, text of each word, first words, digests, ids)."""
    import pyarrow.compute as pc

    prints = answers.filter(pc.equal(answers.column("kind"), b"p"))
    keys = [_narrow(b) * np.uint64(buckets) + np.uint64(k) for k, b in zip(prints.column("bucket").to_pylist(), prints.column("blob").to_pylist())]
    keys = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
    if not len(keys):
        return
    c, d = tx.constants(n, 41), tx.constants(n, 43)
    for i, hashes, of, least, first, doc in _windows(docs, n, ids):
        key = (least >> np.uint64(_SHIFT)) * np.uint64(buckets) + least % np.uint64(buckets)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        at = np.flatnonzero((keys[at] == key) & known[i:][of[first]])
        if len(at):
            first, doc = first[at], doc[at]
            h1, h2 = hashes[first] * c[0], hashes[first] * d[0]
            for j in range(1, n):
                h1 += hashes[first + j] * c[j]
                h2 += hashes[first + j] * d[j]
            yield i, of, first, tx.mix(h1), (tx.mix(h2) >> np.uint64(32)).astype(np.uint32), doc


def _pack(h1, h2, low) -> bytes:
    return np.concatenate([h1.view(np.uint8), low.astype(np.int64).view(np.uint8), h2.view(np.uint8)]).tobytes()


def _unpack(blob: bytes):
    n = len(blob) // 20
    return np.frombuffer(blob, np.uint64, n), np.frombuffer(blob, np.uint32, n, 16 * n), np.frombuffer(blob, np.int64, n, 8 * n)


def _send_digests(key, docs, answers, *, n: int, buckets: int):
    import pyarrow as pa

    ids, known = _ids(docs)
    got = [x[3:] for x in _left(docs, answers, n, buckets, ids, known)]
    rows = []
    if got:
        (h1, h2), low, _ = _extremes([np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])], np.concatenate([x[2] for x in got]))
        bucket = (h1 % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, h1, h2, low = bucket[order], h1[order], h2[order], low[order]
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        rows = [(int(bucket[i]), key[0].as_py(), _pack(h1[i:j], h2[i:j], low[i:j])) for i, j in zip(cut, [*cut[1:], len(bucket)])]
    return pa.table({k: pa.array([r[i] for r in rows], kind) for i, (k, kind) in enumerate((("bucket", pa.int64()), ("shard", pa.int64()), ("blob", pa.binary())))})


def _answer_digests(table):
    import pyarrow as pa

    shards, blobs = table.column("shard").to_pylist(), [_unpack(x) for x in table.column("blob").to_pylist()]
    rows = []
    if blobs:
        h1, h2, low = (np.concatenate([b[i] for b in blobs]) for i in range(3))
        order = np.lexsort((h2, h1))
        s1, s2 = h1[order], h2[order]
        new = np.concatenate([[True], (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])])
        least = np.empty(len(h1), np.int64)
        least[order] = np.minimum.reduceat(low[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        at = 0
        for s, (a, b, own) in zip(shards, blobs):
            first = least[at : at + len(a)]
            at += len(a)
            if (later := first < own).any():
                rows.append((0, s, b"d", _pack(a[later], b[later], first[later])))
    return pa.table({k: pa.array([r[i] for r in rows], kind) for i, (k, kind) in enumerate((("bucket", pa.int64()), ("shard", pa.int64()), ("kind", pa.binary()), ("blob", pa.binary())))})


def _common(a: str, b: str) -> int:
    """How many characters two strings of one length share at their start."""
    if a == b:
        return len(a)
    low, high = 0, len(a)
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def _occurrences(texts: list[list[bytes]], passages: list[tuple[int, int, int, int]], n: int):
    """Every place where a text has n or more consecutive words of a passage: yields (text, first word, words, document).

    A passage is (text, first word, end, smallest document that has it).  Its words become characters of a private
    alphabet, any other word character 0.  The automaton holds the passages cut into blocks of (n + 1) // 2 words: n
    words of a passage always hold a whole block.  From a block the match is extended both ways.
    """
    import ahocorasick

    block = (n + 1) // 2
    i = 0
    while i < len(passages):
        letters: dict[bytes, str] = {}
        places: dict[str, list[tuple[int, int]]] = {}
        some: list[tuple[str, int]] = []
        size = 0
        while i < len(passages) and (not some or size + passages[i][2] - passages[i][1] <= MAX_WORDS):
            k, first, end, low = passages[i]
            word = "".join([letters.get(w) or letters.setdefault(w, chr(len(letters) + 1 + 2048 * (len(letters) + 1 >= 0xD800))) for w in texts[k][first:end]])
            for at in range(0, len(word) - block + 1, block):
                places.setdefault(word[at : at + block], []).append((len(some), at))
            some.append((word, low))
            size += len(word)
            i += 1
        machine = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for word, where in places.items():
            machine.add_word(word, where)
        machine.make_automaton()
        get = letters.get
        for k, text in enumerate(texts):
            code = "".join([get(w, "\0") for w in text])
            done: dict[tuple[int, int], int] = {}
            for end, where in machine.iter(code):
                at = end - block + 1
                for p, off in where:
                    if done.get((p, at - off), -1) > at:
                        continue
                    word, low = some[p]
                    left = min(at, off)
                    left = _common(code[at - left : at][::-1], word[off - left : off][::-1])
                    right = min(len(code) - at, len(word) - off)
                    right = _common(code[at : at + right], word[off : off + right])
                    done[p, at - off] = at + right
                    if left + right >= n:
                        yield k, at - left, left + right, low


def _remove(key, docs, answers, *, n: int, buckets: int, texts_out: bool):
    import pyarrow as pa
    import pyarrow.compute as pc

    ids, known = _ids(docs)
    told = [_unpack(x) for x in answers.filter(pc.equal(answers.column("kind"), b"d")).column("blob").to_pylist()]
    found = list(_left(docs, answers, n, buckets, ids, known))
    marks: dict[int, list[tuple[int, int, int]]] = {}
    if found:
        h1, h2, doc = (np.concatenate([x[i] for x in found]) for i in (3, 4, 5))
        text = np.concatenate([x[0] + x[1][x[2]] for x in found])
        # the index of a word in its own text
        first = np.concatenate([x[2] - np.searchsorted(x[1], x[1][x[2]]) for x in found])
        own = len(h1)
        a, b, low = (np.concatenate([x, *(y[i] for y in told)]) for i, x in enumerate((h1, h2, doc)))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        least = np.empty(len(a), np.int64)
        group = np.empty(len(a), np.int64)
        group[order] = np.cumsum(new) - 1
        least[order] = np.minimum.reduceat(low[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        later = np.flatnonzero(least[:own] < doc)
        for k, g, at, low_id in zip(text[later].tolist(), group[later].tolist(), first[later].tolist(), least[later].tolist()):
            marks.setdefault(k, []).append((g, at, low_id))
    out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept_text": [], "removed_spans": []}
    gone: dict[int, np.ndarray] = {}
    words: dict[int, list[bytes]] = {}
    column = docs.column("text")

    def flush(batch: list[int]) -> None:
        """Streams some documents with confirmed windows through the automata of all their passages."""
        texts = [words[k] for k in batch]
        passages: list[tuple[int, int, int, int]] = []
        seen: set[int] = set()
        for x, k in enumerate(batch):
            start = last = end = -1
            for g, at, low in marks[k]:
                if g in seen:
                    continue
                seen.add(g)
                if at == end - n + 1 and low == last and end - start < MAX_WORDS:
                    end += 1
                    passages[-1] = (x, start, end, low)
                else:
                    start, end, last = at, at + n, low
                    passages.append((x, start, end, low))
        masks = [np.zeros(len(t) + 1, np.int64) for t in texts]
        for x, at, size, low in _occurrences(texts, passages, n):
            if low < ids[batch[x]]:
                masks[x][at] += 1
                masks[x][at + size] -= 1
        for k, mask in zip(batch, masks):
            gone[k] = np.cumsum(mask[:-1]) > 0

    batch: list[int] = []
    size = 0
    for k in sorted(marks):
        words[k] = (column[k].as_py() or "").encode().split()
        batch.append(k)
        size += len(words[k])
        if size >= MAX_WORDS:
            flush(batch)
            batch, size = [], 0
            words.clear()
    if batch:
        flush(batch)
    for k, value in enumerate(column):
        have = (value.as_py() or "").encode().split()
        mask = gone.get(k)
        kept = have if mask is None else [w for w, x in zip(have, mask.tolist()) if not x]
        joined = b" ".join(kept)
        out["n_words"].append(len(have))
        out["n_removed"].append(len(have) - len(kept))
        out["kept_sha256"].append(hashlib.sha256(joined).hexdigest())
        out["kept_text"].append(joined.decode() if texts_out else None)
        spans = None
        if texts_out:
            change = np.flatnonzero(np.diff(np.concatenate([[0], (mask if mask is not None else np.zeros(0)).astype(np.int8), [0]])))
            spans = ",".join(f"{i}:{j}" for i, j in zip(change[::2].tolist(), change[1::2].tolist()))
        out["removed_spans"].append(spans)
    kinds = {"n_words": pa.int64(), "n_removed": pa.int64()}
    return pa.table({"doc_id": docs.column("doc_id").cast(pa.int64()), **{k: pa.array(v, kinds.get(k, pa.string())) for k, v in out.items()}})


def remove_repeated_passages(docs: DataFrame, n_words: int = 13, id_col: str = "doc_id", text_col: str = "text", texts_out: bool = True, shard_bytes: int | None = None) -> DataFrame:
    """One row a row of ``docs``: doc_id, n_words, n_removed, kept_sha256, and with ``texts_out`` kept_text and removed_spans (``first:end`` in words), else nulls.

    ``shard_bytes`` bounds what one task holds; by default it follows the total, between 4 and 256 MB, so that neither
    shards nor the parts they exchange grow too many.

    Shards are dealt by id and text, so rows that share an id, or have none, don't share a shard.

    A null text has no words.  A row with a null id loses nothing and lets none be lost.  Rows that repeat an id are one
    document to the rule: they lose nothing to each other.  Texts with fewer than ``n_words`` words stay.  An empty
    table gives an empty result.  Other columns of ``docs`` are not used.
    """
    total = text_bytes(docs, text_col)
    shard_bytes = shard_bytes or int(min(256 << 20, max(4 << 20, 128 * math.sqrt(total))))
    shards = total // shard_bytes + 1
    buckets = total // (24 << 20) + 1  # about a million prints each
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    d = d.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)))

    def send_prints(t):
        return _send_prints(t, n=n_words, buckets=buckets)

    def send_digests(key, t, answers):
        return _send_digests(key, t, answers, n=n_words, buckets=buckets)

    def remove(key, t, answers):
        return _remove(key, t, answers, n=n_words, buckets=buckets, texts_out=texts_out)

    sent = d.groupBy("shard").applyInArrow(send_prints, "bucket long, shard long, blob binary")
    kinds = "bucket long, shard long, kind binary, blob binary"
    prints = sent.groupBy("bucket").applyInArrow(_answer_prints, kinds)
    left = d.groupBy("shard").cogroup(prints.groupBy("shard")).applyInArrow(send_digests, "bucket long, shard long, blob binary")
    digests = left.groupBy("bucket").applyInArrow(_answer_digests, kinds)
    return d.groupBy("shard").cogroup(prints.union(digests).groupBy("shard")).applyInArrow(remove, _OUT)


ship(__name__)
