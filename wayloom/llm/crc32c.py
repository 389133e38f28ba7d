"""CRC-32C (Castagnoli) of many records at once, and the mask that record files put on it.

A CRC is linear: leading zeros do not change it while the start value is zero, and the sum of two
adjoining pieces is the first one's sum carried over the second's length, xor the second's. So the
sums of all 8-byte words are looked up at once and combined in pairs, level by level.
"""

from __future__ import annotations

from functools import cache

import numpy as np

# The reversed Castagnoli polynomial and the mask of record files (fixed values).
POLYNOMIAL = 0x82F63B78
MASK_DELTA = 0xA282EAD8


@cache
def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> 1) ^ np.where(table & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    return table


@cache
def _carry(log_bytes: int) -> np.ndarray:
    """Four tables of 256: what 2**log_bytes zero bytes make of each byte of a sum."""
    if log_bytes == 0:
        step = _byte_table()
        low = np.arange(256, dtype=np.uint32)
        return np.stack([step[low], low, low << 8, low << 16]).astype(np.uint32)
    half = _carry(log_bytes - 1)
    return np.stack([_carried(half[k], half) for k in range(4)])


def _carried(sums: np.ndarray, tables: np.ndarray) -> np.ndarray:
    return (
        tables[0][sums & 255]
        ^ tables[1][(sums >> 8) & 255]
        ^ tables[2][(sums >> 16) & 255]
        ^ tables[3][sums >> 24]
    )


def _over(sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums carried over lengths of their own."""
    for bit in range(int(lengths.max(initial=0)).bit_length()):
        at = (lengths >> bit) & 1 == 1
        sums[at] = _carried(sums[at], _carry(bit))
    return sums


def crc32c_many(records: list[bytes]) -> np.ndarray:
    """The CRC-32C of each record, as unsigned 32-bit numbers."""
    lengths = np.array([len(r) for r in records], np.int64)
    out = np.zeros(len(records), np.uint32)
    # Records are padded in front to a power of two, equal sizes together.
    sizes = np.maximum(3, np.ceil(np.log2(np.maximum(lengths, 1))).astype(int))
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        for part in np.array_split(rows, max(1, (len(rows) << int(size)) >> 24)):
            width = 1 << int(size)
            data = np.frombuffer(b"".join(records[i].rjust(width, b"\0") for i in part), np.uint8)
            data = data.reshape(len(part), width // 8, 8)
            sums = np.zeros(data.shape[:2], np.uint32)
            for k in range(8):
                sums = _byte_table()[(sums ^ data[:, :, k]) & 255] ^ (sums >> 8)
            level = 3
            while sums.shape[1] > 1:
                sums = _carried(sums[:, ::2], _carry(level)) ^ sums[:, 1::2]
                level += 1
            out[part] = sums[:, 0]
    start = np.full(len(records), 0xFFFFFFFF, np.uint32)
    return out ^ _over(start, lengths) ^ np.uint32(0xFFFFFFFF)


def masked(sums: np.ndarray) -> np.ndarray:
    """Rotated right by 15 bits plus a constant, so that sums of sums do not degenerate."""
    return ((sums >> 15) | (sums << 17)) + np.uint32(MASK_DELTA)
