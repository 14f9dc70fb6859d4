"""Array work on whole batches of texts: bytes, words and n-grams without a Python object for each.

A batch of texts is one long array of UTF-8 bytes with offsets, as Arrow holds it.
"""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute

U64 = np.uint64
#: Odd multipliers of the hashes; any would do, but all runs must use the same.
BASE = U64(0x9E3779B97F4A7C15)
MIX_A, MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * MIX_A
        x ^= x >> U64(27)
        x *= MIX_B
        x ^= x >> U64(31)
    return x


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]] if len(offsets) else raw
    return raw, (offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64))


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z lower-cased."""
    return raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (runs of anything but ASCII white space), and the words before each text."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    begins = offsets[:-1]
    begins = begins[begins < n]
    start[begins] = inside[begins]  # a word never goes on from one text to the next
    starts = np.flatnonzero(start)
    # a word ends before white space or before the next text
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    last = offsets[1:] - 1
    last = last[last >= 0]
    stop[last] = inside[last]
    ends = np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: each byte is mixed with its place before the sum, so no regular pattern of bytes cancels out."""
    if not len(starts):
        return np.zeros(0, U64)
    lengths = ends - starts
    with np.errstate(over="ignore"):
        # position of every byte in its word, for the bytes that are in words
        at = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        where = at + np.repeat(starts, lengths)
        value = mix((at.astype(U64) << U64(8) | raw[where]) + BASE)
        sums = np.add.reduceat(value, np.cumsum(lengths) - lengths)
        return mix(sums ^ (lengths.astype(U64) * MIX_B))


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text's shingles of `width` lower-cased words, ascending, and their offsets.

    A text of fewer words gives its whole sequence as one shingle; without words it gives none.
    """
    raw, offsets = bytes_of(texts)
    raw = lowered(raw)
    starts, ends, before = words_of(raw, offsets)
    w = word_hashes(raw, starts, ends)
    out, sizes = [], np.zeros(len(offsets), np.int64)
    with np.errstate(over="ignore"):
        if len(w) >= width:
            h = np.zeros(len(w) - width + 1, U64)
            for k in range(width):
                h = mix(h * BASE + w[k : len(w) - width + 1 + k] + U64(k + 1))
        for i, (a, b) in enumerate(zip(before[:-1].tolist(), before[1:].tolist())):
            if b - a >= width:
                part = np.sort(h[a : b - width + 1])
                if len(part) > 1:
                    part = part[np.r_[True, part[1:] != part[:-1]]]
            elif b > a:
                x = U64(b - a) * MIX_A
                for k in range(a, b):
                    x = mix(np.asarray([x * BASE + w[k] + U64(k - a + 1)], U64))[0]
                part = np.asarray([x], U64)
            else:
                part = np.zeros(0, U64)
            out.append(part)
            sizes[i + 1] = len(part)
    return (np.concatenate(out) if out else np.zeros(0, U64)), np.cumsum(sizes)


def slices(texts: pa.Array, size: int = 1 << 21):
    """(first, part) of consecutive texts of about `size` bytes together; one text is never split."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0), dtype=np.int64)
    ends = np.cumsum(lengths)
    lo = 0
    while lo < len(texts):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield lo, texts.slice(lo, hi - lo)
        lo = hi


def spaced(raw: np.ndarray) -> np.ndarray:
    """All ASCII white space as blanks."""
    return np.where((raw >= 9) & (raw <= 13), np.uint8(32), raw)


def release() -> None:
    """Gives memory that earlier tasks of this worker process have left unused back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)
