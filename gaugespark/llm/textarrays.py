"""Texts as byte arrays inside Arrow tasks: words, their hashes, distinct shingles.

A word is a run of bytes other than space and 0x09-0x0D. Everything is done on
whole arrays, without a Python object for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_INK = ~_SPACE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words longer than this take a block factor besides the power of their position.
_REACH = 1 << 16
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = np.ones(_REACH, _U)
_POWERS[1:] = _U(_BASE)
_POWERS = np.multiply.accumulate(_POWERS)
#: Texts are taken in blocks of about so many bytes, cut at white space.
_BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def byte_views(column: pa.Array) -> Iterator[np.ndarray | None]:
    """The UTF-8 bytes of each text; None for null."""
    if isinstance(column, pa.ChunkedArray):
        for chunk in column.chunks:
            yield from byte_views(chunk)
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(len(column) + 1, np.int32)
    everything = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    known = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield everything[at[i] : at[i + 1]] if known[i] else None


def lowered(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word."""
    inside = np.zeros(len(buf) + 2, bool)
    np.take(_INK, buf, out=inside[1:-1])
    edges = (inside[1:] != inside[:-1]).nonzero()[0]
    return edges[::2], edges[1::2]


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span; spans are in order and don't overlap."""
    if not len(start):
        return np.zeros(0, _U)
    long = end - start
    first = np.cumsum(long) - long
    at = np.arange(int(long.sum())) - np.repeat(first, long)
    value = buf[np.repeat(start, long) + at].astype(_U) + _U(1)
    if long.max() > _REACH:
        value *= _U(2) * (at // _REACH).astype(_U) + _U(1)
        at %= _REACH
    value *= _POWERS[at]
    return mix(np.add.reduceat(value, first) + long.astype(_U) * _U(0xD6E8FEB86659FD93))


def _blocks(buf: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    at = 0
    while len(buf) - at > _BLOCK:
        end = at + _BLOCK
        while end < len(buf):
            gap = np.flatnonzero(_SPACE[buf[end : end + _BLOCK]])
            if len(gap):
                end += int(gap[0])
                break
            end += _BLOCK
        end = min(end, len(buf))
        yield at, buf[at:end]
        at = end
    yield at, buf[at:]


def word_hashes(buf: np.ndarray) -> np.ndarray:
    """The hash of every word of a text, in order."""
    parts = [span_hashes(b, *spans(b)) for _, b in _blocks(buf)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """The sorted distinct hashes of n-word shingles; of fewer words, one of all."""
    if not len(words):
        return words
    # The length goes in, so that a short text never equals a shingle of a longer one.
    size = min(n, len(words))
    rolled = np.full(len(words) - size + 1, size, _U)
    for i in range(size):
        rolled = mix(rolled * _U(0x9DDFEA08EB382D69) + words[i : len(words) - size + 1 + i])
    rolled.sort()
    keep = np.empty(len(rolled), bool)
    keep[0] = True
    np.not_equal(rolled[1:], rolled[:-1], out=keep[1:])
    return rolled[keep]
