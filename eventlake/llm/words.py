"""Words and their 64-bit hashes of whole Arrow text columns, by NumPy.

A word is a run of bytes other than blank and 0x09 to 0x0D; A to Z count as a to z. Its hash is a
polynomial over the bytes, read off running sums, so that the cost is a few passes over the bytes
and no Python object is made for a word. Two different words share a hash about once in 2^60.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 17
_U = np.uint64
# The multipliers of the usual 64-bit finishing step, and of the polynomial.
M1, M2, BASE = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """Finishing step: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * M1
    x = (x ^ (x >> _U(27))) * M2
    return x ^ (x >> _U(31))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
with np.errstate(over="ignore"):
    VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _U(BASE))[LOWER]


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, as far as they were needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, PIECE + 1)
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row starts; a null is an empty text."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if column.null_count:
        return column_bytes(column.fill_null("") if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.fill_null(b""))
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def spans(buf: np.ndarray, cuts: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; a row start (`cuts`) also ends a word."""
    inside = ~space[buf]
    first = np.empty(len(buf) + 1, bool)
    first[0] = first[-1] = True
    np.logical_not(inside[:-1], out=first[1:-1])
    first[cuts] = True
    starts = np.flatnonzero(inside & first[:-1])
    after = np.empty(len(buf), bool)
    after[-1] = True
    np.logical_not(inside[1:], out=after[:-1])
    after |= first[1:]
    return starts, np.flatnonzero(inside & after) + 1


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        up, down = _powers(len(buf))
        run = np.empty(len(buf) + 1, np.uint64)
        run[0] = 0
        np.cumsum(VALUE[buf] * up, out=run[1:])
        return mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def pieces(buf: np.ndarray, at: np.ndarray, size: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Cut a column into (bytes, row starts in them, first row, rows) of about `size` bytes.

    A longer row is cut at white space, its parts come one after the other; a longer word stays whole.
    """
    n, row = len(at) - 1, 0
    while row < n:
        last = int(np.searchsorted(at, at[row] + size, side="right")) - 1
        if last > row:
            yield buf[at[row] : at[last]], at[row:last] - at[row], row, last - row
            row = last
            continue
        begin, end = int(at[row]), int(at[row + 1])
        while begin < end:
            stop = min(begin + size, end)
            while stop < end and not SPACE[buf[stop]]:
                gap = np.flatnonzero(SPACE[buf[stop : stop + size]])
                stop = min(stop + (int(gap[0]) if len(gap) else size), end)
            yield buf[begin:stop], np.zeros(1, np.int64), row, 1
            begin = stop
        row += 1


def column_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a text column, and where each row's words start (one more entry at the end)."""
    buf, at = column_bytes(column)
    counts, hashes = np.zeros(len(column), np.int64), []
    for piece, cuts, row, rows in pieces(buf, at):
        if not len(piece):
            continue
        starts, ends = spans(piece, cuts[cuts < len(piece)])
        hashes.append(span_hashes(piece, starts, ends))
        counts[row : row + rows] += np.diff(np.searchsorted(starts, np.append(cuts, len(piece))))
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(counts)])
