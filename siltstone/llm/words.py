"""Words of many texts at once, as 64-bit hashes in NumPy arrays.

A word is a run of bytes other than white space (tab to carriage return, space) after lower-casing A-Z. Words of up to
eight bytes have hashes of their own; of n longer ones, n^2 / 2^65 pairs are expected to share one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)
_LONG = 64  # longer words are hashed one by one
BUFFER = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def buffers(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts of about BUFFER bytes; a longer text is alone."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        size = len(t or b"")
        if i > first and held + size > BUFFER:
            yield first, i
            first, held = i, 0
        held += size
    if first < len(texts):
        yield first, len(texts)


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, line within the text) of every word in order, and the number of lines of each text."""
    texts = [t or b"" for t in texts]
    lines = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
    data = b"\n" + b"\n".join(texts).lower() + b"\n" + b"\0" * 8
    raw = np.frombuffer(data, np.uint8)
    space = _SPACE[raw[: len(raw) - 8]]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[0::2], edge[1::2]  # the data begin and end with white space
    size = end - start
    ahead = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    h = mix((ahead[start] & _MASK[np.minimum(size, 8)]) + size.astype(_U) * _U(0x9E3779B97F4A7C15))
    left = np.flatnonzero((size > 8) & (size <= _LONG))
    at = 8
    while len(left):
        h[left] = mix(h[left] * _U(5) + (ahead[start[left] + at] & _MASK[np.minimum(size[left] - at, 8)]))
        at += 8
        left = left[size[left] > at]
    for i in np.flatnonzero(size > _LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]], 42)
    breaks = np.cumsum(raw[: len(raw) - 8] == 10) - 1  # the line of each byte, over all texts
    line = breaks[start] if len(start) else np.zeros(0, np.int64)
    first = np.cumsum(lines) - lines
    text = np.searchsorted(first, line, side="right") - 1
    return h, text, line - first[text] if len(text) else line, lines


def distinct(group: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, value) of the distinct pairs, sorted by group; groups are small non-negative numbers."""
    if not len(group):
        return group, values
    if int(group.max()) < 1 << 24:
        packed = (group.astype(_U) << _U(40)) | (values >> _U(24))
        order = np.argsort(packed)
        packed, group, values = packed[order], group[order], values[order]
        same = packed[1:] == packed[:-1]
        if (same & (values[1:] != values[:-1])).any():
            order = np.lexsort((values, group))
            group, values = group[order], values[order]
    else:
        order = np.lexsort((values, group))
        group, values = group[order], values[order]
    fresh = np.r_[True, (group[1:] != group[:-1]) | (values[1:] != values[:-1])]
    return group[fresh], values[fresh]
