"""Byte-level text kernels: vectorised word finding and hashing over Arrow string buffers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that one vectorised step works on; intermediate arrays take about forty times as much.
PIECE = 1 << 19
#: Bytes from which a word has a cryptographic hash: sums modulo 2 to the 64 are easy to make collide in long ones.
LONG = 256
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def byte_class(pattern: str) -> np.ndarray:
    """Membership of every byte value in a bracket expression written for code points below 256."""
    import re

    return np.array([bool(re.match(pattern, chr(i), re.S)) for i in range(256)])


#: A-Z to a-z, every other byte as it is; safe in UTF-8, where other characters use bytes from 0x80.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Everything but ASCII white space.
NOT_SPACE = byte_class(r"[^\x20\x09-\x0D]")
#: ASCII letters and digits, and every byte of a character beyond ASCII.
ALNUM = byte_class(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offset of each row in them; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, most: int = 4 * PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows holding at most so many bytes together, or one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([[_U(1)], np.full(n - 1, _U(_BASE))]), dtype=_U)
        down = np.cumprod(np.concatenate([[_U(1)], np.full(n - 1, _U(pow(_BASE, -1, 1 << 64)))]), dtype=_U)
    return up, down


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, for hashes whose low bits are not spread well."""
    h = h.astype(_U, copy=True)
    h ^= h >> _U(30)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


class Words:
    """Word positions in a buffer of documents: start and end byte, 64-bit hash, and each document's first word."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray, fold: np.ndarray = LOWER, prefixes: tuple[int, ...] = ()):
        parts = [_piece(buf[a:b], offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a, a, inside, fold, prefixes) for a, b in _cuts(buf, offsets, inside)]
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, t) for t in (np.int64, np.int64, _U, *[_U] * len(prefixes))]
        self.start, self.end, self.hash, *self.prefix = columns
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.start)

    def document(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)


def _cuts(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about PIECE that cut no word."""
    a, n = 0, len(buf)
    while a < n:
        b = min(a + PIECE, n)
        if b < n:
            k = int(np.searchsorted(offsets, b, "right")) - 1
            if offsets[k] > a:
                b = int(offsets[k])
            else:  # inside one long document: after the last separator, or else before the next one
                gap = np.flatnonzero(~inside[buf[a:b]])
                if len(gap):
                    b = a + int(gap[-1]) + 1
                else:
                    stop = int(offsets[k + 1]) if k + 1 < len(offsets) else n
                    while b < stop and not len(gap := np.flatnonzero(~inside[buf[b : b + PIECE]])):
                        b = min(b + PIECE, stop)
                    b = min(stop, b + int(gap[0]) + 1 if len(gap) else stop)
        yield a, b
        a = b


def _piece(raw: np.ndarray, heads: np.ndarray, at: int, inside: np.ndarray, fold: np.ndarray, prefixes: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    is_word = inside[raw]
    begins, ends = is_word.copy(), is_word.copy()
    begins[1:] &= ~is_word[:-1]
    ends[:-1] &= ~is_word[1:]
    heads = heads[heads < len(raw)]
    begins[heads] = is_word[heads]
    last = heads[heads > 0] - 1
    ends[last] = is_word[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    up, down = _powers(1 << max(20, int(len(raw) - 1).bit_length()))
    term = (fold[raw].astype(_U) + _U(1)) * up[: len(raw)]
    total = np.cumsum(term, dtype=_U)
    before = total[start] - term[start]
    scale = down[start]
    key = mix((total[end] - before) * scale)
    for k in np.flatnonzero(end - start >= LONG).tolist():
        key[k] = int.from_bytes(blake2b(fold[raw[start[k] : end[k] + 1]].tobytes(), digest_size=8).digest(), "little")
    out = [start + at, end + 1 + at, key]
    for k in prefixes:
        out.append(mix((total[np.minimum(end, start + k - 1)] - before) * scale))
    return tuple(out)


def folded_words(buf: np.ndarray, w: Words, fold: np.ndarray = LOWER) -> list[bytes]:
    """The words as bytes; for small inputs."""
    data = fold[buf].tobytes()
    return [data[a:b] for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)]
