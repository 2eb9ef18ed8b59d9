"""Directly addressable codes for token ids: ids are split into chunks, lowest chunk first; a
bitmap on each level says which ids go on, and a rank directory finds their place on the next.

File layout (little-endian): magic, header of four uint64 (documents, ids, levels, end id),
document ids int64, null flags uint8, starts int64 (documents + 1); then for each level the number
of chunks uint64, the chunks uint8 and, on all levels but the last, the bitmap (uint8, padded to
whole blocks) and the rank directory uint64, one entry a block of 512 bits.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"DACIDS1\0"
BITS, BLOCK = 8, 512


def build(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, end_id: int) -> bytes:
    """One file; ids holds all ids of the documents in order, end ids included."""
    ids = np.ascontiguousarray(ids, dtype=np.uint16 if ids.dtype == np.uint16 else np.uint32)
    top = int(ids.max()) if len(ids) else 0
    levels = max(1, -(-top.bit_length() // BITS))
    starts = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=starts[1:])
    out = [MAGIC, struct.pack("<4Q", len(doc_ids), len(ids), levels, end_id)]
    out += [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(), starts.astype("<i8").tobytes()]
    rest = ids
    for level in range(levels):
        out += [struct.pack("<Q", len(rest)), rest.astype(np.uint8).tobytes()]
        if level + 1 < levels:
            on = rest > 0xFF
            bits = np.packbits(on, bitorder="little")
            bits = np.pad(bits, (0, -len(bits) % (BLOCK // 8)))
            ranks = np.zeros(len(bits) * 8 // BLOCK + 1, np.uint64)
            np.cumsum(np.bitwise_count(bits).reshape(-1, BLOCK // 8).sum(axis=1), out=ranks[1:])
            out += [struct.pack("<Q", len(ranks)), bits.tobytes(), ranks.astype("<u8").tobytes()]
            rest = rest[on] >> BITS
    return b"".join(out)


class Dac:
    """Reads one file: any id, or any range of ids, without decoding what stands before it."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        self.docs, self.n, self.levels, self.end_id = struct.unpack_from("<4Q", data, 8)
        at = 40

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, n, at)
            at += got.nbytes
            return got

        self.doc_ids, self.null, self.starts = take("<i8", self.docs), take("u1", self.docs), take("<i8", self.docs + 1)
        self.chunks, self.bits, self.ranks = [], [], []
        for level in range(self.levels):
            self.chunks.append(take("u1", int(take("<u8", 1)[0])))
            if level + 1 < self.levels:
                blocks = int(take("<u8", 1)[0])
                self.bits.append(take("u1", (blocks - 1) * BLOCK // 8))
                self.ranks.append(take("<u8", blocks))

    def rank(self, level: int, i: int) -> int:
        """Set bits of a level before position i."""
        block, bits = i // BLOCK, self.bits[level]
        n = int(self.ranks[level][block])
        full = bits[block * BLOCK // 8 : i // 8]
        n += int(np.bitwise_count(full).sum())
        return n + (int(bits[i // 8]) & ((1 << i % 8) - 1)).bit_count() if i % 8 else n

    def get(self, i: int) -> int:
        """The id at position i."""
        value, level = int(self.chunks[0][i]), 0
        while level + 1 < self.levels and self.bits[level][i // 8] >> (i % 8) & 1:
            i = self.rank(level, i)
            level += 1
            value |= int(self.chunks[level][i]) << BITS * level
        return value

    def slice(self, a: int, b: int, level: int = 0) -> np.ndarray:
        """The ids at positions a to b - 1."""
        out = self.chunks[level][a:b].astype("<u4")
        if level + 1 < self.levels and b > a:
            bits = np.unpackbits(self.bits[level][a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a]
            on = np.flatnonzero(bits)
            if len(on):
                first = self.rank(level, a)
                out[on] |= self.slice(first, first + len(on), level + 1) << BITS
        return out

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.starts[k]), int(self.starts[k + 1]))
