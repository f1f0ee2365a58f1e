"""Lists of whole numbers as bytes, made and read again inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

PART = 24  # a list's numbers share all but their lowest 24 bits
LISTS = "key long, part long, items binary"
FOUND = "key long, sources array<long>, depth int"
WIDTHS = np.array([1, 2, 4])
PIECE = 1 << 22  # bytes of lists that are read at once


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, source) as rows (key, part, items): a list for each run of a key's rising sources in a part.

    Four bytes hold the first number and the width of a step, then each step to the next number takes 1, 2 or 4 bytes.
    Runs end with their batch, so that no key makes a large row.
    """
    for b in batches:
        key, source = (b.column(n).to_numpy(zero_copy_only=False) for n in ("key", "source"))
        other = np.ones(len(key), bool)
        other[1:] = (key[1:] != key[:-1]) | (source[1:] != source[:-1])
        key, source = key[other], source[other]
        n, part, number = len(key), source >> PART, source & (1 << PART) - 1
        if not n:
            continue
        step, starts = np.diff(number, prepend=0), np.ones(n, bool)
        starts[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1]) | (step[1:] <= 0)
        first = np.flatnonzero(starts)
        step[first] = 0
        most, size = np.maximum.reduceat(step, first), np.diff(first, append=n)
        code = (most > 0xFF).astype(np.int64) + (most > 0xFFFF)
        width = WIDTHS[code]
        ends = np.cumsum(4 + (size - 1) * width)
        begins = np.concatenate([[0], ends[:-1]])
        out = np.zeros(ends[-1], np.uint8)
        out[begins[:, None] + np.arange(4)] = (number[first] | code << PART).astype("<u4").view(np.uint8).reshape(-1, 4)
        wide = np.repeat(width, size)
        at = np.repeat(begins + 4, size) + (np.arange(n) - np.repeat(first, size) - 1) * wide
        for k in range(4):
            own = ~starts & (wide > k)
            out[at[own] + k] = step[own] >> 8 * k & 0xFF
        items = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(out)])
        yield pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(part[first]), items], names=["key", "part", "items"])


def numbers(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of packed lists, and for each the list that it is of."""
    head = data[begins[:, None] + np.arange(4)].view("<u4")[:, 0].astype(np.int64)
    code, first = head >> PART, head & (1 << PART) - 1
    steps = (ends - begins - 4) // WIDTHS[code]
    size = steps + 1
    start = np.cumsum(size) - size
    out = np.empty(size.sum(), np.int64)
    out[start] = first
    for c, width in enumerate(WIDTHS):
        own = np.flatnonzero((code == c) & (steps > 0))
        n = steps[own]
        i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(begins[own] + 4, n) + i * width
        out[np.repeat(start[own] + 1, n) + i] = sum(data[at + k].astype(np.int64) << 8 * k for k in range(width))
    out = np.cumsum(out)
    out -= np.repeat(out[start] - first, size)
    return out, np.repeat(np.arange(len(size)), size)


def unpack(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (key, part, items, depth), those of a key and part side by side, as rows (key, sources, depth): each source once, with its smallest depth, where that is `least` or more.

    Of a key and part that goes on in the next piece only its numbers are kept, at most 2 ** PART.
    """

    def rows(key, part, codes) -> pa.RecordBatch:
        codes = codes[(codes & 0xFF) >= least]
        group, depth = codes >> PART + 8, codes & 0xFF
        sources = (part[group] << PART) + (codes >> 8 & (1 << PART) - 1)
        first = np.flatnonzero(np.concatenate([[len(codes) > 0], (group[1:] != group[:-1]) | (depth[1:] != depth[:-1])]))
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(codes)).astype(np.int32)), pa.array(sources))
        return pa.RecordBatch.from_arrays([pa.array(key[group[first]]), lists, pa.array(depth[first].astype(np.int32))], names=["key", "sources", "depth"])

    def read(batches):
        kept = None
        for b in batches:
            if not b.num_rows:
                continue
            keys, parts, depths = (b.column(n).to_numpy(zero_copy_only=False) for n in ("key", "part", "depth"))
            items = b.column("items").cast(pa.binary())
            data, offsets = np.frombuffer(items.buffers()[2], np.uint8), np.frombuffer(items.buffers()[1], np.int32)[items.offset : items.offset + len(items) + 1].astype(np.int64)
            for piece in np.split(np.arange(len(keys)), np.flatnonzero(np.diff((offsets[1:] - offsets[0]) // PIECE)) + 1):
                key, part = keys[piece], parts[piece]
                turns = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
                group = np.zeros(len(key), np.int64)
                group[turns] = 1
                group = np.cumsum(group)
                value, row = numbers(data, offsets[piece], offsets[piece + 1])
                codes = group[row] << PART + 8 | value << 8 | depths[piece][row]
                if kept and (kept[0][0], kept[1][0]) == (key[0], part[0]):
                    codes = np.concatenate([kept[2], codes])
                elif kept:
                    yield rows(*kept)
                codes.sort()
                other = np.ones(len(codes), bool)
                other[1:] = codes[1:] >> 8 != codes[:-1] >> 8
                codes, at = codes[other], np.concatenate([[0], turns])
                end = np.searchsorted(codes, group[-1] << PART + 8)
                if end:
                    yield rows(key[at], part[at], codes[:end])
                kept = key[-1:], part[-1:], codes[end:] & (1 << PART + 8) - 1
        if kept:
            yield rows(*kept)

    return read
