"""Vectorised word hashing over Arrow string batches.

A batch is cut into blocks of bounded size; each block is one flat byte array
with document offsets, and all words in it are found and hashed by a handful of
numpy passes, with no Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def byte_table(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


#: Tab, line feed, vertical tab, form feed, carriage return and space.
WHITESPACE = byte_table(b"\x09\x0a\x0b\x0c\x0d\x20")
#: Every ASCII byte that is neither letter nor digit.
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)


@dataclass
class Block:
    """Some whole documents of a batch: rows lo..hi-1, their bytes, and offsets of each into these."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return self.hi - self.lo


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; a null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n, buffers = len(column), column.buffers()
    if n == 0 or buffers[1] is None:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return offsets, data


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of about ``limit`` bytes; a longer document makes up a block of its own."""
    offsets, data = string_buffers(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield Block(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


@dataclass
class Words:
    """Words of a block: byte ranges start..end-1, and for each document its range of words."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # of len(block)+1: the words of document i are first[i]..first[i+1]-1

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def find_words(block: Block, separators: np.ndarray = WHITESPACE) -> Words:
    n = len(block.data)
    inside = np.zeros(n + 2, bool)
    np.logical_not(separators[block.data], out=inside[1:-1])
    edge = np.zeros(n + 1, bool)  # a document starts or ends before this byte
    edge[block.offsets] = True
    here, before = inside[1:], inside[:-1]
    start = np.flatnonzero(here & (~before | edge))
    end = np.flatnonzero(before & (~here | edge))
    return Words(start, end, np.searchsorted(start, block.offsets))


def hash_words(data: np.ndarray, words: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands."""
    power, inverse = _powers_to(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
    return mix((total[words.end] - total[words.start]) * inverse[words.start])


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return LOWER[data]


def lower_latin(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the accented Latin-1 capitals in UTF-8."""
    out = LOWER[data]
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    if len(at):
        b = out[at]
        out[at] = np.where((b >= 0x80) & (b <= 0x9E) & (b != 0x97), b + 32, b)
    return out


def per_doc_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over consecutive ranges; empty ranges give zero."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(v: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(v + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of the bytes start..end-1 of each range, all ranges at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    size = end - start
    s = np.array([seed], np.uint64)
    h = np.broadcast_to(s + _P5, size.shape).copy()
    at = start.copy()
    long = np.flatnonzero(size >= 32)
    if len(long):
        v = [np.broadcast_to(x, long.shape).copy() for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
        left, place, live = size[long] // 32, at[long], np.arange(len(long))
        while len(live):
            for k in range(4):
                v[k][live] = _round(v[k][live], lanes[place[live] + 8 * k])
            place[live] += 32
            left[live] -= 1
            live = live[left[live] > 0]
        total = _turn(v[0], 1) + _turn(v[1], 7) + _turn(v[2], 12) + _turn(v[3], 18)
        for x in v:
            total = (total ^ _round(np.zeros_like(x), x)) * _P1 + _P4
        h[long], at[long] = total, place
    h += size.astype(np.uint64)
    left = end - at
    for _ in range(3):
        live = np.flatnonzero(left >= 8)
        if not len(live):
            break
        k = lanes[at[live]]
        h[live] = _turn(h[live] ^ _round(np.zeros_like(k), k), 27) * _P1 + _P4
        at[live] += 8
        left[live] -= 8
    live = np.flatnonzero(left >= 4)
    h[live] = _turn(h[live] ^ ((lanes[at[live]] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
    at[live] += 4
    left[live] -= 4
    for _ in range(3):
        live = np.flatnonzero(left > 0)
        if not len(live):
            break
        h[live] = _turn(h[live] ^ (padded[at[live]].astype(np.uint64) * _P5), 11) * _P1
        at[live] += 1
        left[live] -= 1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))
