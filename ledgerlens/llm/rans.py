"""Range asymmetric numeral system with static, shared frequencies, in numpy.

A block is coded by many interleaved lanes, each with a state of its own: symbol i belongs to lane
i mod LANES, and one numpy step codes a symbol of every lane. Blocks are independent.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

BITS = 20
"""Frequencies add up to 2^BITS, so at most that many different symbols can be coded."""
LANES = 512
LOW = np.uint64(1 << 31)
"""States stay in [2^31, 2^63) and move 32 bits at a time."""
HEAD = struct.Struct("<4sQQLL")
MAGIC = b"rANB"


class BadBlock(ValueError):
    """The bytes are no block, are cut off or damaged."""


@dataclass(frozen=True)
class Table:
    """Frequencies and their running sums for every symbol; slots for decoding."""

    frequency: np.ndarray
    start: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> Table:
        """Counts scaled to 2^BITS; every symbol that occurs keeps a frequency of one at least.

        What rounding leaves over or short goes to the most frequent symbols, in a fixed order.
        """
        counts = np.asarray(counts, np.float64)
        used = np.flatnonzero(counts)
        if len(used) > 1 << BITS:
            raise ValueError(f"more than {1 << BITS} symbols")
        scaled = np.zeros(len(counts), np.int64)
        if len(used):
            share = counts[used] / counts.sum()
            scaled[used] = np.maximum(1, np.floor(share * (1 << BITS)).astype(np.int64))
            order = used[np.lexsort((used, -scaled[used]))]
            rest = (1 << BITS) - int(scaled.sum())
            while rest:
                for s in order:
                    move = max(1, abs(rest) // 2)
                    if rest > 0:
                        scaled[s] += move
                        rest -= move
                    elif rest < 0 and scaled[s] > 1:
                        move = min(move, int(scaled[s]) - 1)
                        scaled[s] -= move
                        rest += move
                    if not rest:
                        break
        start = np.concatenate([[0], np.cumsum(scaled)[:-1]]) if len(scaled) else scaled
        return cls(scaled.astype(np.uint64), start.astype(np.uint64))

    def slots(self) -> np.ndarray:
        """The symbol of every slot."""
        return np.repeat(
            np.arange(len(self.frequency), dtype=np.uint32), self.frequency.astype(np.int64)
        )


def encode(ids: np.ndarray, table: Table) -> bytes:
    """One block: head with counts and CRC-32 of ids and content, lane states, 32-bit words."""
    n = len(ids)
    steps = -(-n // LANES)
    state = np.full(LANES, LOW, np.uint64)
    frequency, start = table.frequency[ids], table.start[ids]
    if n and not frequency.all():
        raise ValueError("a symbol has no frequency")
    words: list[np.ndarray] = []
    shift = np.uint64(63 - BITS)
    for step in range(steps - 1, -1, -1):
        f, c = frequency[step * LANES : (step + 1) * LANES], start[step * LANES : (step + 1) * LANES]
        x = state[: len(f)]
        full = x >= (f << shift)
        if full.any():
            # Lanes put their words last to first, as decoding takes them first to last.
            words.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4")[::-1])
            x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        state[: len(f)] = (q << np.uint64(BITS)) + (x - q * f) + c
    stream = np.concatenate(words)[::-1] if words else np.zeros(0, "<u4")
    body = state.astype("<u8").tobytes() + stream.astype("<u4").tobytes()
    return HEAD.pack(MAGIC, n, len(stream), _crc(ids), zlib.crc32(body)) + body


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


def decode(raw: bytes, table: Table, slots: np.ndarray) -> np.ndarray:
    """Ids of a block, after both checksums have been verified."""
    if len(raw) < HEAD.size:
        raise BadBlock("cut off")
    magic, n, count, ids_crc, body_crc = HEAD.unpack_from(raw)
    body = raw[HEAD.size :]
    if magic != MAGIC or len(body) != 8 * LANES + 4 * count or zlib.crc32(body) != body_crc:
        raise BadBlock("damaged")
    state = np.frombuffer(body, "<u8", LANES).copy()
    stream = np.frombuffer(body, "<u4", count, 8 * LANES).astype(np.uint64)
    out, at = np.empty(n, "<u4"), 0
    mask, bits = np.uint64((1 << BITS) - 1), np.uint64(BITS)
    for step in range(0, n, LANES):
        width = min(LANES, n - step)
        x = state[:width]
        slot = x & mask
        symbol = slots[slot.astype(np.int64)]
        out[step : step + width] = symbol
        x = table.frequency[symbol] * (x >> bits) + slot - table.start[symbol]
        empty = np.flatnonzero(x < LOW)
        if len(empty):
            x[empty] = (x[empty] << np.uint64(32)) | stream[at : at + len(empty)]
            at += len(empty)
        state[:width] = x
    if _crc(out) != ids_crc:
        raise BadBlock("ids do not match their checksum")
    return out
