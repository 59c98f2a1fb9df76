"""Word shingles of whole texts as 64-bit hashes, computed in NumPy over Arrow buffers.

Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes with A-Z lowered; all the
separators are ASCII, so bytes and characters cut alike.  A word's hash is a
polynomial over its bytes modulo 2^64, read off one running sum per chunk and
then mixed; a shingle's hash mixes its words' hashes.  A text with fewer words
than a shingle has its whole sequence as its only one; no words, no shingle.

Work runs over chunks of a quarter MB, so memory is bounded by the chunk or by one
very long text: every byte of a chunk takes some 40 bytes of a worker, and idle
workers keep the powers of the base.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 256 << 10
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection of 64-bit values."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
_BYTE = mix(np.arange(256, dtype=np.uint64))
_LOW_BYTE = _BYTE[_LOWERED]
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int, way: str) -> np.ndarray:
    """The first ``n`` powers of the base ("up") or of its inverse ("down")."""
    if len(_POWERS[way]) < n:
        with np.errstate(over="ignore"):
            step = np.full(max(n + n // 4, CHUNK_BYTES + 1), _BASE if way == "up" else _BASE_INVERSE, np.uint64)
            step[0] = 1
            _POWERS[way] = np.cumprod(step)
    return _POWERS[way][:n]


def running_hash(data: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """Prefix sums H with hash(data[i:j]) = (H[j] - H[i]) * base^-i."""
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(table[data] * powers(len(data), "up"), out=out[1:])
    return out


def text_chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets within them) of runs of rows of about ``size`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def text_pieces(batches: Iterable[pa.RecordBatch], at: int, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches, in order, cut into batches with about ``size`` bytes in the text column ``at``."""
    for batch in batches:
        for first, _, offsets in text_chunks(batch.column(at), size):
            yield batch.slice(first, len(offsets) - 1)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of a chunk and the number of words of each row."""
    inside = ~_SEPARATOR[data]
    n = len(data)
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]  # a row's first byte begins a word, whatever stands before
    begin[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = running_hash(data, _LOW_BYTE)
    with np.errstate(over="ignore"):
        return mix((sums[ends] - sums[starts]) * powers(len(data) + 1, "down")[starts])


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every row."""
    for _, data, offsets in text_chunks(column):
        starts, ends, counts = words(data, offsets)
        hashed = word_hashes(data, starts, ends)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        with np.errstate(over="ignore"):
            if len(hashed) >= width:
                joined = np.zeros(len(hashed) - width + 1, np.uint64)
                for j in range(width):
                    joined = joined * _BASE + hashed[j:j + len(joined)]
                joined = mix(joined)
            for a, b in zip(bounds[:-1], bounds[1:]):
                if b - a >= width:
                    yield np.unique(joined[a:b - width + 1])
                elif b > a:
                    short = np.uint64(b - a)
                    for h in hashed[a:b]:
                        short = short * _BASE + h
                    yield mix(np.array([short], np.uint64))
                else:
                    yield hashed[:0]


def word_sequences(column: pa.Array, lengths: list[int]) -> Iterator[list[np.ndarray]]:
    """For every row and each of ``lengths``, the sorted distinct hashes of its sequences of so many words.

    The hash is that of a text of just these words, as :func:`shingle_sets` gives it to texts shorter than a shingle.
    """
    for _, data, offsets in text_chunks(column):
        starts, ends, counts = words(data, offsets)
        hashed = word_hashes(data, starts, ends)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        joined = []
        with np.errstate(over="ignore"):
            for m in lengths:
                run = np.full(max(len(hashed) - m + 1, 0), m, np.uint64)
                for j in range(m):
                    run = run * _BASE + hashed[j:j + len(run)]
                joined.append(mix(run))
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield [np.unique(run[a:max(b - m + 1, a)]) for m, run in zip(lengths, joined)]


def long_lists(parts: list[np.ndarray]) -> pa.ListArray:
    """64-bit hashes as an array<bigint> column, bit for bit."""
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate([*parts, np.zeros(0, np.uint64)])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))
