"""Words and hashes of many texts at once, on NumPy byte arrays.

A word is a run of bytes other than space and the ASCII controls 9 to 13, so
UTF-8 never needs decoding.  All functions work on a bounded stretch of bytes;
``stretches`` cuts a stream of Arrow batches into such stretches.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once; a longer text is cut at white space and continued.
STRETCH = 1 << 21

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Fixed values of the XXH64 specification.
P1 = np.uint64(11400714785074694791)
P2 = np.uint64(14029467366897019727)
P3 = np.uint64(1609587929392839161)
P4 = np.uint64(9650029242287828579)
P5 = np.uint64(2870177450012600261)


def text_bytes(column: pa.Array) -> list[memoryview]:
    """The UTF-8 bytes of each value, without copying; null gives no bytes."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1].tolist()
    view = memoryview(data) if data is not None else memoryview(b"")
    nulls = column.is_null().to_pylist() if column.null_count else None
    return [view[0:0] if nulls and nulls[i] else view[ends[i] : ends[i + 1]] for i in range(len(column))]


def stretches(texts: list[memoryview], carry_words: int = 0) -> Iterator[tuple[list[int], bytes, bool]]:
    """(row numbers, bytes joined by newlines, whether the one row goes on from before).

    A text over STRETCH bytes is given in several stretches of its own; each
    after the first begins with the last ``carry_words`` words of the one before.
    """
    rows: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        if len(text) > STRETCH:
            if rows:
                yield rows, b"\n".join(texts[r] for r in rows), False
                rows, size = [], 0
            yield from _long(i, text, carry_words)
            continue
        if size + len(text) > STRETCH:
            yield rows, b"\n".join(texts[r] for r in rows), False
            rows, size = [], 0
        rows.append(i)
        size += len(text) + 1
    if rows:
        yield rows, b"\n".join(texts[r] for r in rows), False


def _long(row: int, text: memoryview, carry_words: int) -> Iterator[tuple[list[int], bytes, bool]]:
    at, carry, more = 0, b"", False
    while at < len(text):
        end = min(len(text), at + STRETCH)
        while end < len(text):  # to the next white space: a word is never cut
            found = np.flatnonzero(_SPACE[np.frombuffer(text[end : end + STRETCH], np.uint8)])
            if len(found):
                end += int(found[0])
                break
            end = min(len(text), end + STRETCH)
        piece = carry + bytes(text[at:end])
        yield [row], piece, more
        # Enough bytes to hold the words to carry, whatever their length.
        carry = b" ".join(piece.split()[-carry_words:]) + b" " if carry_words else b""
        at, more = end, True


class Words:
    """The words of one stretch: lower-cased bytes with one space after each word.

    ``data`` has 32 spare bytes at its end, so that wide reads stay inside.
    ``row`` holds, per word, the position in the stretch's list of rows.
    """

    def __init__(self, joined: bytes, n_rows: int, apart: np.ndarray = _SPACE):
        raw = np.frombuffer(joined + b"\n", np.uint8)
        space = apart[raw]
        before = np.empty_like(space)
        before[0] = True
        before[1:] = space[:-1]
        first = np.flatnonzero(~space & before)
        keep = ~(space & before)
        data = _LOWER[raw[keep]]
        data[space[keep]] = 32
        self.data = np.concatenate([data, np.zeros(32, np.uint8)])
        ends = np.flatnonzero(space[keep])
        self.end = ends
        self.start = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        if n_rows == 1:
            self.row = np.zeros(len(first), np.int64)
        else:
            # Rows are joined by one newline each; texts may hold newlines too, so positions decide.
            self.row = None
        self._first = first

    def set_rows(self, lengths: np.ndarray) -> None:
        begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        self.row = np.searchsorted(begins, self._first, side="right") - 1

    def __len__(self) -> int:
        return len(self.end)


def words_of(rows: list[int], joined: bytes, texts: list[memoryview], apart: np.ndarray = _SPACE) -> Words:
    """Words between the bytes that ``apart``, white space as a rule, marks."""
    words = Words(joined, len(rows), apart)
    if len(rows) != 1:
        words.set_rows(np.fromiter((len(texts[r]) for r in rows), np.int64, len(rows)))
    return words


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()
#: Longer words are hashed one by one.
_CRC_AT_ONCE = 64


def crc32(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of data[start : start + length] for every pair."""
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    live = np.flatnonzero((length > 0) & (length <= _CRC_AT_ONCE))
    step = 0
    while len(live):
        c = crc[live]
        crc[live] = _CRC[(c ^ data[start[live] + step]) & np.uint32(255)] ^ (c >> np.uint32(8))
        step += 1
        live = live[length[live] > step]
    crc = ~crc
    for i in np.flatnonzero(length > _CRC_AT_ONCE):
        crc[i] = zlib.crc32(data[start[i] : start[i] + length[i]])
    return crc


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of data[start : start + length] for every pair; data needs 8 spare bytes."""
    with np.errstate(over="ignore"):
        return _xxh64(data, start.astype(np.int64), length.astype(np.int64), np.uint64(seed))


def _xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: np.uint64) -> np.ndarray:
    n = len(data) - 7
    u64 = np.ndarray((n,), "<u8", data, strides=(1,))
    u32 = np.ndarray((n,), "<u4", data, strides=(1,))
    stripes = length >> 5
    h = np.full(len(start), seed + P5, np.uint64)
    wide = np.flatnonzero(stripes)
    if len(wide):
        at, left = start[wide], stripes[wide]
        v = [np.full(len(wide), x, np.uint64) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
        live = np.arange(len(wide))
        step = 0
        while len(live):
            where = at[live] + 32 * step
            for k in range(4):
                v[k][live] = _rotl(v[k][live] + u64[where + 8 * k] * P2, 31) * P1
            step += 1
            live = live[left[live] > step]
        total = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
        for x in v:
            total = (total ^ (_rotl(x * P2, 31) * P1)) * P1 + P4
        h[wide] = total
    h += length.astype(np.uint64)
    at, left = start + (stripes << 5), length & 31
    for _ in range(3):
        live = np.flatnonzero(left >= 8)
        if not len(live):
            break
        k = _rotl(u64[at[live]] * P2, 31) * P1
        h[live] = _rotl(h[live] ^ k, 27) * P1 + P4
        at[live] += 8
        left[live] -= 8
    live = np.flatnonzero(left >= 4)
    if len(live):
        h[live] = _rotl(h[live] ^ (u32[at[live]].astype(np.uint64) * P1), 23) * P2 + P3
        at[live] += 4
        left[live] -= 4
    for _ in range(3):
        live = np.flatnonzero(left > 0)
        if not len(live):
            break
        h[live] = _rotl(h[live] ^ (data[at[live]].astype(np.uint64) * P5), 11) * P1
        at[live] += 1
        left[live] -= 1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))
