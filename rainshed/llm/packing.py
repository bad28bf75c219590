"""Compact bytes of integer arrays and word lists for what travels between tasks."""

from __future__ import annotations

import numpy as np
import zstandard


def pack_bytes(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unpack_bytes(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack(x: np.ndarray) -> bytes:
    """Integers, compressed byte plane by byte plane; as many planes as the greatest needs (signs are folded in)."""
    x = x.astype(np.int64)
    folded = ((x << 1) ^ (x >> 63)).view(np.uint64)
    planes = max((int(folded.max(initial=0)).bit_length() + 7) // 8, 1)
    flat = np.ascontiguousarray(folded.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()
    return bytes([planes]) + pack_bytes(flat)


def unpack(data: bytes) -> np.ndarray:
    planes = data[0]
    flat = np.frombuffer(unpack_bytes(data[1:]), np.uint8).reshape(planes, -1)
    wide = np.zeros((flat.shape[1], 8), dtype=np.uint8)
    wide[:, :planes] = flat.T
    folded = wide.view("<u8").reshape(-1)
    return (folded >> np.uint64(1)).astype(np.int64) ^ -(folded & np.uint64(1)).astype(np.int64)


def pack_ranked(x: np.ndarray) -> bytes:
    """Numbers from 0 on of which few are frequent: as ranks by frequency, after how often each occurs."""
    counts = np.bincount(x)
    rank = np.empty(len(counts), dtype=np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    head = pack(counts)
    return len(head).to_bytes(8, "little") + head + pack(rank[x])


def unpack_ranked(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.argsort(-unpack(data[8 : 8 + size]), kind="stable")[unpack(data[8 + size :])]
