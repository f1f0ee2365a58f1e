"""Vectorised text helpers for Arrow batches: bytes, word spans, rolling hashes, shingles.

All work on a slice of a batch at a time, so the memory of a task follows SLICE_BYTES and
the longest single text, not the size of a batch or partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
U = np.uint64
_M = U((1 << 31) - 1)
_TABLES: dict[int, list[dict]] = {}


def byte_class(*spans: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in spans:
        out[a : b + 1] = True
    return out


#: Bytes of a word `[^\x20\x09-\x0D]+`; UTF-8 continuation bytes belong to the word.
BLANK_SPLIT = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Bytes of a word `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing.
LETTER_DIGIT = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows holding about `limit` bytes of text, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def flatten(texts: pa.Array, terminator: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each followed by one terminator byte, and the n + 1 offsets. Null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    joined = pc.binary_join_element_wise(texts, pa.scalar(b"", pa.large_binary()), pa.scalar(terminator, pa.large_binary()))
    if isinstance(joined, pa.ChunkedArray):
        joined = joined.combine_chunks()
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    data = np.frombuffer(joined.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(joined) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0] if len(joined) else np.zeros(1, np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1, for x below 2^63."""
    x = (x & _M) + (x >> U(31))
    x = (x & _M) + (x >> U(31))
    return np.minimum(x, x - _M)  # below the prime, x - prime wraps round


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, U)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = _reduced(out[:more] * U(pow(base, done, int(_M))))
        done += more
    return out.astype(np.uint32)


def _tables(salt: int, n: int) -> list[dict]:
    """For each of two random bases: codes of the bytes, and powers of the base and of its inverse."""
    if salt not in _TABLES:
        rng = np.random.Generator(np.random.PCG64([20240117, salt]))
        _TABLES[salt] = [{"base": int(b), "code": rng.integers(1, int(_M), 256, dtype=np.int64).astype(U), "size": 0} for b in rng.integers(1 << 20, int(_M) - 1, 2)]
    for t in _TABLES[salt]:
        if t["size"] < n:
            t["size"] = max(n, SLICE_BYTES + 4096)
            t["up"], t["down"] = _powers(t["base"], t["size"]), _powers(pow(t["base"], -1, int(_M)), t["size"])
    return _TABLES[salt]


class SpanHash:
    """Hash of any span of a byte array in constant time, from prefix sums.

    Two polynomials modulo the prime 2^31 - 1 at random bases: for any two spans of n bytes the
    chance (over the bases) of equal hashes is at most (n / 2^31)^2. Salts have bases of their own.
    """

    def __init__(self, data: np.ndarray, salt: int = 0):
        self.parts = []
        for t in _tables(salt, len(data) + 1):
            sums = np.zeros(len(data) + 1, U)
            x = t["code"][data] * t["up"][: len(data)]
            np.cumsum((x & _M) + (x >> U(31)), out=sums[1:])
            self.parts.append((sums, t["down"]))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        one, two = (_reduced(_reduced(sums[end] - sums[start]) * down[start]) for sums, down in self.parts)
        return mix(((one << U(31)) | two) + (end - start).astype(U) * U(0xD6E8FEB86659FD93))

    def order(self, length: int) -> np.ndarray:
        """A number of 32 bits for each span of `length` bytes, by one base only: to choose spans by, not to tell them apart."""
        sums, down = self.parts[0]
        n = max(len(sums) - length, 0)
        return (_reduced(_reduced(sums[length:] - sums[:n]) * down[:n]) * U(0x9E3779B97F4A7C15)) >> U(32)


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the range of its words. The terminator must not be a word byte."""
    flags = np.zeros(len(data) + 1, np.int8)
    flags[1:] = is_word[data]
    steps = np.diff(flags)
    starts, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(texts: pa.Array, is_word: np.ndarray, lower: bool = True, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and for each text the range of its words."""
    data, offsets = flatten(texts)
    if lower:
        data = LOWER[data]
    starts, ends, at = word_spans(data, offsets, is_word)
    return SpanHash(data, salt)(starts, ends), at


def shingles(words: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each n-word window, and for each text the range of its windows; a shorter text is one window."""
    count = np.diff(at)
    windows = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    to = np.zeros(len(at), np.int64)
    np.cumsum(windows, out=to[1:])
    first = np.repeat(at[:-1] - to[:-1], windows) + np.arange(to[-1])
    end = np.repeat(at[1:], windows)
    out = words[first] if len(first) else np.zeros(0, U)
    for j in range(1, n):
        inside = first + j < end
        out = np.where(inside, out * U(0xFF51AFD7ED558CCD) + words[np.where(inside, first + j, 0)], out) if len(first) else out
    return mix(out), to


def split_ranges(values: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    return [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
