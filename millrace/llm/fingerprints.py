"""64-bit fingerprints of stretches of bytes, for all stretches of a text at once.

`Stretches` takes sums modulo 2**64, which is quick, but structured stretches collide: low bits of
powers repeat, and 184 bytes are enough for it. It is for sampling, and for names that only rule
out. `Names` takes sums modulo a prime at two bases, for names that say that stretches are equal.
"""

from __future__ import annotations

import numpy as np

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as far as they were needed."""

    base = 0xD6E8FEB86659FD93
    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, 1 << 16)
            steps = np.full(n, cls.base, np.uint64), np.full(n, pow(cls.base, -1, 1 << 64), np.uint64)
            for x in steps:
                x[0] = 1
            cls.up, cls.down = np.cumprod(steps[0]), np.cumprod(steps[1])
        return cls.up, cls.down


class Stretches:
    """of(start, end): a fingerprint of each data[start:end], from running sums of byte times power."""

    def __init__(self, data: np.ndarray):
        up, self.down = _Powers.to(len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64))


class _PrimePowers:
    """Powers of two primitive roots of the prime and of their inverses, as far as they were needed."""

    prime = 2**31 - 1
    bases = 742_938_285, 950_706_376
    up = down = tuple(np.ones(1, np.uint32) for _ in bases)

    @classmethod
    def to(cls, n: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
        if len(cls.up[0]) < n:
            cls.up, cls.down = tuple(cls.powers(b, max(n, 1 << 16)) for b in cls.bases), tuple(cls.powers(pow(b, -1, cls.prime), max(n, 1 << 16)) for b in cls.bases)
        return cls.up, cls.down

    @classmethod
    def powers(cls, base: int, n: int) -> np.ndarray:
        out = np.ones(n, np.uint32)
        m = 1
        while m < n:
            out[m : 2 * m] = out[: min(m, n - m)].astype(np.uint64) * np.uint64(pow(base, m, cls.prime)) % np.uint64(cls.prime)
            m *= 2
        return out


class Names:
    """of(start, end): a fingerprint of each data[start:end], from running sums of byte times power modulo a prime, at two bases."""

    def __init__(self, data: np.ndarray):
        p = np.uint64(_PrimePowers.prime)
        ups, self.downs = _PrimePowers.to(len(data) + 1)
        self.totals = []
        for up in ups:
            terms = (data.astype(np.uint64) + np.uint64(1)) * up[: len(data)]  # below 2**40
            total = np.zeros(len(data) + 1, np.uint32)
            total[1:] = np.cumsum(terms if len(data) < 1 << 24 else terms % p) % p
            self.totals.append(total)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        p = np.uint64(_PrimePowers.prime)
        one, two = ((p + total[end] - total[start]) * down[start] % p for total, down in zip(self.totals, self.downs, strict=True))
        return mixed((one << np.uint64(31)) + two + (end - start).astype(np.uint64) * MULTIPLIER)
