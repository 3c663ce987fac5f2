"""Vectorised word and shingle hashing over batches of UTF-8 texts.

A word is a run of bytes other than space and 0x09-0x0D.  Hashes depend on the words alone: every executor and every
run gets the same.
"""

from __future__ import annotations

import numpy as np

from .common import once, ship

#: Bytes of text that are hashed at once; it bounds the memory of the vectors below (about 60 bytes a byte).  Longer texts are
#: hashed in pieces that end between words, so only a single longer word takes more.
CHUNK = 1 << 19

_M64 = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64 bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def tables(lower: bool = False, letters_only: bool = False) -> dict:
    """The tables that the functions below need.  lower: A-Z count as a-z.  letters_only: ASCII characters other than letters and digits separate words too."""
    return once(f"tables {lower} {letters_only}", lambda: _tables(lower, letters_only))


def _tables(lower: bool, letters_only: bool) -> dict:
    byte = constants(256, 5)
    if lower:
        byte[65:91] = byte[97:123]
    white = np.zeros(256, bool)
    white[[9, 10, 11, 12, 13, 32]] = True
    if letters_only:
        white[:128] = [not chr(i).isalnum() for i in range(128)]
    return {"byte": byte, "white": white}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n or more powers of the base of all hashes, and of its inverse; kept for pieces of the usual size."""
    base = int(constants(1, 77)[0])
    inverse = pow(base, -1, 1 << 64)
    if n > CHUNK:
        return powers(base, n), powers(inverse, n)
    return once("powers", lambda: (powers(base, CHUNK), powers(inverse, CHUNK)))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(1, np.uint64)
    step = base & _M64
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(step)])
        step = step * step & _M64
    return out[:n]


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and where each text begins and, at last, ends.  A null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, size: int = CHUNK):
    """Ranges of whole texts of about ``size`` bytes; a longer text has a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = j


def words(data: np.ndarray, offsets: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each word, its 64-bit hash, index of its text) over some texts; ``data`` and ``offsets`` as of ``buffers``."""
    starts, hashes = [], []
    i, n = 0, len(data)
    while i < n:
        j = _between(data, i, t["white"])
        inner = offsets[(offsets > i) & (offsets < j)] - i
        start, h = _words(data[i:j], inner, t)
        starts.append(start + i)
        hashes.append(h)
        i = j
    if not starts:
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z
    start = np.concatenate(starts) if len(starts) > 1 else starts[0]
    return start, np.concatenate(hashes) if len(hashes) > 1 else hashes[0], np.searchsorted(offsets, start, "right") - 1


def _between(data: np.ndarray, i: int, white: np.ndarray) -> int:
    """Where the piece from ``i`` ends: after a white byte at most ``CHUNK`` bytes on, or, within a longer word, after that word."""
    n, j = len(data), i + CHUNK
    if j >= n:
        return n
    for back in (256, CHUNK):
        if (at := np.flatnonzero(white[data[j - back : j]])).size:
            return j - back + int(at[-1]) + 1
    while j < n:
        if (at := np.flatnonzero(white[data[j : j + CHUNK]])).size:
            return j + int(at[0]) + 1
        j += CHUNK
    return n


def _words(data: np.ndarray, inner: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words of one piece; ``inner``: where texts begin within it."""
    n = len(data)
    white = t["white"][data]
    first = np.zeros(n, bool)
    first[0] = True
    first[1:] = white[:-1]
    first[inner] = True
    last = np.zeros(n, bool)
    last[-1] = True
    last[:-1] = white[1:]
    last[inner - 1] = True
    start = np.flatnonzero(first & ~white)
    end = np.flatnonzero(last & ~white)
    up, down = _powers(n)
    sums = t["byte"][data]
    sums *= up[:n]
    np.cumsum(sums, out=sums)
    total = sums[end]
    before = np.where(start > 0, sums[start - 1], np.uint64(0))
    return start, mix((total - before) * down[start] + (end - start + 1).astype(np.uint64))


def shingles(hashes: np.ndarray, of: np.ndarray, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of k consecutive words of one text, index of its first word)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    c = constants(k, seed)
    out = hashes[:n] * c[0]
    for j in range(1, k):
        out += hashes[j : j + n] * c[j]
    at = np.flatnonzero(of[:n] == of[k - 1 :])
    return mix(out[at]), at


ship(__name__)
