"""Words of Arrow text columns as arrays: byte classes, runs, and 64-bit hashes.

Texts stay UTF-8 bytes. A table of 256 flags says which bytes are part of a word; every byte of a
code point beyond ASCII has the same flag, so runs of flagged bytes are the words. Work is done on
slices of a few megabytes, which bounds memory for any batch; a longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_table(separators: str) -> np.ndarray:
    """Flags of the bytes that are in words, from the ASCII characters that separate words."""
    table = np.ones(256, bool)
    table[[ord(c) for c in separators]] = False
    return table


# Words between white space, and words of letters and digits (all beyond ASCII counts as letters).
SOLID = word_table(" \t\n\v\f\r")
ALNUM = word_table("".join(chr(c) for c in range(128) if not chr(c).isalnum()))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD6E8FEB86659FD93)


def large(column: pa.Array) -> pa.Array:
    """The column as texts with 64-bit offsets, nulls as empty texts."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    else:
        column = column.cast(pa.large_string())
    return column.fill_null("" if pa.types.is_large_string(column.type) else b"")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column from :func:`large`; the offsets begin at 0."""
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[tuple]:
    """(rows, bytes, offsets) of consecutive rows with at most ``size`` bytes, or of one row."""
    if not batch.num_rows:
        return
    texts = large(batch.column(batch.schema.get_field_index(column)))
    data, offsets = buffers(texts)
    row = 0
    while row < len(texts):
        end = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        end = min(max(end, row + 1), len(texts))
        yield (
            batch.slice(row, end - row),
            data[offsets[row] : offsets[end]],
            offsets[row : end + 1] - offsets[row],
        )
        row = end


class Words:
    """Words of a slice: byte bounds, the first word of each text, and hashes on demand."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        inside = table[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        # A word ends with its text.
        begins = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[begins] = inside[begins]
        ends = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        last[ends] = inside[ends]
        self.data, self.inside = data, inside
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self._hashes: np.ndarray | None = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def texts(self) -> np.ndarray:
        """The text (by number) of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = run_hashes(self.data[self.inside], self.ends - self.starts)
        return self._hashes


def run_hashes(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of consecutive non-empty runs of bytes."""
    if not len(lengths):
        return np.zeros(0, np.uint64)
    begins = np.cumsum(lengths) - lengths
    place = np.arange(len(data), dtype=np.int32) - np.repeat(begins.astype(np.int32), lengths)
    powers = np.full(int(lengths.max()), _BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    parts = _BYTE[data]
    parts *= powers[place]
    return mix(np.add.reduceat(parts, begins))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each word on; the last n - 1 words have none."""
    size = max(0, len(hashes) - n + 1)
    out = np.zeros(size, np.uint64)
    factor = 1
    for i in range(n):
        out += hashes[i : i + size] * np.uint64(factor)
        factor = factor * int(_BASE) % (1 << 64)
    return mix(out)


def within(words: Words, n: int) -> np.ndarray:
    """Whether the ``n`` words from each word on are of one text, for each word that has n - 1 after."""
    texts = words.texts()
    size = max(0, len(texts) - n + 1)
    return texts[:size] == texts[len(texts) - size :]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every range, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
