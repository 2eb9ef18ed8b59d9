"""Score-aware anisotropic product quantisation with four-bit codes, for code inside tasks.

The residual of a vector is weighed by direction: its part parallel to the vector, which changes
inner products with the queries that score highest, costs `eta` times as much as the rest.
"""

from __future__ import annotations

import numpy as np

CENTRES, WIDTH = 16, 2


def eta_of(dims: int, threshold: float = 0.2) -> float:
    """Weight of the parallel part for queries that score above the threshold (unit vectors)."""
    return max(1.0, (dims - 1) * threshold**2 / (1.0 - threshold**2))


class Quantiser:
    """Codebooks of CENTRES centres for each WIDTH coordinates."""

    def __init__(self, dims: int, books: np.ndarray, eta: float):
        self.dims, self.books, self.eta = dims, books, eta

    @staticmethod
    def width() -> int:
        return WIDTH

    @staticmethod
    def pack(codes: np.ndarray) -> np.ndarray:
        """(n, subspaces) codes below 16 -> bytes of two codes each."""
        even = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2))).astype(np.uint8)
        return even[:, 0::2] | even[:, 1::2] << 4

    def unpack(self, packed: np.ndarray) -> np.ndarray:
        out = np.empty((len(packed), 2 * packed.shape[1]), np.uint8)
        out[:, 0::2], out[:, 1::2] = packed & 15, packed >> 4
        return out[:, : self.books.shape[0]]

    @staticmethod
    def split(x: np.ndarray) -> np.ndarray:
        """(n, dims) -> (n, subspaces, WIDTH), padded with zeros."""
        return np.pad(x, ((0, 0), (0, -x.shape[1] % WIDTH))).reshape(len(x), -1, WIDTH)

    @classmethod
    def fit(cls, x: np.ndarray, rounds: int = 6, seed: int = 11) -> Quantiser:
        x = x.astype(np.float64)
        parts, rng = cls.split(x), np.random.default_rng(seed)
        n, spaces = parts.shape[:2]
        start = rng.choice(n, CENTRES, replace=n < CENTRES)
        model = cls(x.shape[1], parts[start].transpose(1, 0, 2).copy(), eta_of(x.shape[1]))
        for s in range(spaces):  # plain k-means first
            for _ in range(8):
                near = ((parts[:, s, None] - model.books[s][None]) ** 2).sum(-1).argmin(1)
                for c in range(CENTRES):
                    if (near == c).any():
                        model.books[s, c] = parts[near == c, s].mean(0)
        unit = cls.split(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300))
        for _ in range(rounds):
            codes = model.encode(x)
            along = (unit * (parts - model.decode_parts(codes))).sum(-1)
            total = along.sum(1)
            for s in range(spaces):  # each centre by weighted least squares, the others held
                for c in range(CENTRES):
                    mine = codes[:, s] == c
                    if not mine.any():
                        continue
                    u, v, rest = unit[mine, s], parts[mine, s], total[mine] - along[mine, s]
                    left = mine.sum() * np.eye(WIDTH) + (model.eta - 1.0) * u.T @ u
                    right = v.sum(0) + (model.eta - 1.0) * (u * (rest + (u * v).sum(1))[:, None]).sum(0)
                    model.books[s, c] = np.linalg.solve(left, right)
                new = (unit[:, s] * (parts[:, s] - model.books[s][codes[:, s]])).sum(-1)
                total += new - along[:, s]
                along[:, s] = new
        return model

    def decode_parts(self, codes: np.ndarray) -> np.ndarray:
        return self.books[np.arange(codes.shape[1])[None], codes]

    def encode(self, x: np.ndarray, passes: int = 2) -> np.ndarray:
        """Codes (n, subspaces) by coordinate descent on the weighted residual."""
        parts = self.split(x.astype(np.float64))
        unit = self.split(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300))
        spaces = parts.shape[1]
        codes = np.empty(parts.shape[:2], np.int64)
        plain, along = np.empty((spaces, len(x), CENTRES)), np.empty((spaces, len(x), CENTRES))
        rows, total = np.arange(len(x)), np.zeros(len(x))
        for s in range(spaces):
            gap = parts[:, s, None] - self.books[s][None]
            plain[s], along[s] = (gap**2).sum(-1), (gap * unit[:, s, None]).sum(-1)
            codes[:, s] = plain[s].argmin(1)
            total += along[s][rows, codes[:, s]]
        for _ in range(passes):
            for s in range(spaces):
                rest = total - along[s][rows, codes[:, s]]
                codes[:, s] = (plain[s] + (self.eta - 1.0) * (rest[:, None] + along[s]) ** 2).argmin(1)
                total = rest + along[s][rows, codes[:, s]]
        return codes

    def scan(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Approximate inner products (queries, vectors) by one table look-up a subspace."""
        tables = np.einsum("qsw,scw->sqc", self.split(queries.astype(np.float64)), self.books).astype(np.float32)
        out = np.zeros((len(queries), len(codes)), np.float32)
        for s in range(codes.shape[1]):
            out += tables[s][:, codes[:, s]]
        return out
