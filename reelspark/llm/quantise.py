"""Score-aware anisotropic quantisation: four-bit codes for maximum inner product search.

The error of a code is split into its part along the vector and its part across it.  The part along the vector
changes the scores of exactly those queries that score high, so it weighs more (``eta`` times).
"""

from __future__ import annotations

from dataclasses import dataclass

WORDS = 16  # four bits


def eta_for(threshold: float, dim: int) -> float:
    """Weight of the parallel error for queries whose score is about ``threshold``."""
    return (dim - 1) * threshold**2 / max(1 - threshold**2, 1e-3)


@dataclass
class Codebook:
    words: object  # float32 [subspaces, 16, width]
    eta: float

    def encode(self, x, sweeps: int = 2):
        """Codes uint8 [n, subspaces] of unit rows by coordinate descent on the anisotropic loss."""
        import numpy as np

        m, _, w = self.words.shape
        parts = x.reshape(len(x), m, w)
        dots = np.einsum("nmw,mkw->nmk", parts, self.words)  # along the vector
        err = (self.words**2).sum(-1)[None] - 2 * dots  # squared error less a constant
        codes = err.argmin(-1)
        rows = np.arange(len(x))
        own = (parts**2).sum(-1)
        along = (own - np.take_along_axis(dots, codes[..., None], -1)[..., 0]).sum(1)
        for _ in range(sweeps):
            for j in range(m):
                rest = along - own[:, j] + dots[rows, j, codes[:, j]]
                cand = rest[:, None] + own[:, j, None] - dots[:, j]
                new = (err[:, j] + (self.eta - 1) * cand**2).argmin(1)
                along = cand[rows, new]
                codes[:, j] = new
        return codes.astype(np.uint8)

    def decode(self, codes):
        """Table look-up: float32 [n, dim]."""
        import numpy as np

        m = self.words.shape[0]
        return self.words[np.arange(m)[None], codes].reshape(len(codes), -1)


def pack(codes):
    return (codes[:, 0::2] << 4) | codes[:, 1::2]


def unpack(packed):
    import numpy as np

    out = np.empty((len(packed), packed.shape[1] * 2), np.uint8)
    out[:, 0::2], out[:, 1::2] = packed >> 4, packed & 15
    return out


def train_codebook(x, subspaces: int = 32, threshold: float = 0.92, rounds: int = 4, seed: int = 7) -> Codebook:
    """x: unit rows of a bounded sample."""
    import numpy as np

    n, dim = x.shape
    w = dim // subspaces
    rng = np.random.default_rng(seed)
    parts = x.reshape(n, subspaces, w).astype(np.float64)
    pick = rng.choice(n, WORDS, replace=n < WORDS)
    book = Codebook(np.ascontiguousarray(parts[pick].transpose(1, 0, 2)).astype(np.float32), eta_for(threshold, dim))
    for step in range(rounds):
        codes = book.encode(x.astype(np.float32), 0 if step == 0 else 1)
        back = book.decode(codes).astype(np.float64)
        along = (x * (x - back)).sum(1)
        words = book.words.astype(np.float64)
        for j in range(subspaces):
            pj, rest = parts[:, j], along - (parts[:, j] * (parts[:, j] - back.reshape(n, subspaces, w)[:, j])).sum(1)
            for k in range(WORDS):
                mine = codes[:, j] == k
                if not mine.any():
                    words[j, k] = pj[rng.integers(n)]
                    continue
                p, s = pj[mine], rest[mine]
                own = (p * p).sum(1)
                a = len(p) * np.eye(w) + (book.eta - 1) * (p.T @ p)
                words[j, k] = np.linalg.solve(a, p.sum(0) + (book.eta - 1) * (p * (s + own)[:, None]).sum(0))
        book = Codebook(words.astype(np.float32), book.eta)
    return book
