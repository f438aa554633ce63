"""Vectorised text kernels over Arrow buffers: words, shingles, sketches.

Words are runs of bytes other than 0x20 and 0x09-0x0D after lower-casing A-Z,
which on UTF-8 is the same as on code points.  A word's hash is a polynomial
over a random byte table modulo 2**64, finished by a mixer; all hashes are
deterministic across processes and machines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
PIECE = 1 << 20  # bytes hashed at a time

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(n, dtype=U64) * U64(0xD1342543DE82EF95) + U64(salt))


_BYTES = seeds(256, 0xB17E)
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, PIECE + (1 << 16))
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=U64)
    return _powers["up"], _powers["down"]


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """Cut bytes at white space into pieces of about PIECE bytes."""
    at = 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data):
            ahead = np.flatnonzero(_SPACE[data[end : end + PIECE]])
            if len(ahead):
                end += int(ahead[0])
                break
            end = min(len(data), end + PIECE)
        yield data[at:end]
        at = end


def _hash_piece(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words in ``data``."""
    low = _LOWER[data]
    solid = ~_SPACE[low]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    up, down = _power_tables(len(data) + 1)
    run = np.empty(len(data) + 1, dtype=U64)
    run[0] = 0
    np.cumsum(_BYTES[low] * up[: len(data)], out=run[1:])
    value = (run[end] - run[start]) * down[start]
    return mix(value ^ ((end - start).astype(U64) << U64(48))), start


def words_of(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of one text given as bytes, in order."""
    if not len(data):
        return np.empty(0, dtype=U64)
    return np.concatenate([_hash_piece(p)[0] for p in _pieces(data)])


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; nulls have length 0."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = column.fill_null("") if column.null_count else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return raw, at


def doc_words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after last, word hashes, word offsets by row) for runs of rows.

    Rows are gathered until their texts reach PIECE bytes; a longer text is a
    run of its own, hashed piece by piece.
    """
    raw, at = string_buffers(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, side="right")) - 1)
        j = min(j, n)
        if j == i + 1:
            h = words_of(raw[at[i] : at[j]])
            yield i, j, h, np.array([0, len(h)], dtype=np.int64)
        else:
            # one separator byte after each text keeps words of neighbours apart
            lengths = np.diff(at[i : j + 1])
            marks = np.arange(1, j - i) + np.cumsum(lengths)[:-1] - 1
            data = np.insert(raw[at[i] : at[j]], np.cumsum(lengths)[:-1], 32)
            h, start = _hash_piece(data)
            yield i, j, h, np.concatenate(([0], np.searchsorted(start, marks), [len(h)])).astype(np.int64)
        i = j


_SHINGLE = seeds(64, 0x5417) | U64(1)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the width-word shingles in order; a shorter text is one shingle."""
    n = len(words)
    if n == 0:
        return words
    if n < width:
        total = np.full(1, n, dtype=U64) * U64(0xA24BAED4963EE407)
        for k in range(n):
            total = total + words[k : k + 1] * _SHINGLE[k]
        return mix(total)
    total = words[: n - width + 1] * _SHINGLE[0]
    for k in range(1, width):
        total = total + words[k : n - width + 1 + k] * _SHINGLE[k]
    return mix(total)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(shingles(words, width))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def similarity_sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Fast similarity sketches: a row of t coordinates for each non-empty set.

    Round i < t throws every element into one of t bins; round i >= t throws
    all elements into bin i - t.  A coordinate is the least (round, hash) that
    reached its bin, so after 2t rounds no coordinate is empty, and agreeing
    coordinates estimate Jaccard with sampling-without-replacement bounds.
    Sets whose bins are full leave after that round.
    """
    out = np.full((len(sets), t), np.iinfo(U64).max, dtype=U64)
    if not sets:
        return out
    element = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = out.reshape(-1)
    salt = seeds(2 * t, 0xFA57)
    top = U64(2**53 - 1)
    for i in range(2 * t):
        h = mix(element ^ salt[i])
        bins = (h >> U64(53)).astype(np.int64) % t if i < t else np.full(len(h), i - t)
        np.minimum.at(flat, row * t + bins, (U64(i) << U64(53)) | (mix(h) & top))
        if i < t and i % 4 and i > 8:
            continue
        open_rows = (out[:, :] == np.iinfo(U64).max).any(axis=1)
        if not open_rows.any():
            break
        stay = open_rows[row]
        element, row = element[stay], row[stay]
    return out
