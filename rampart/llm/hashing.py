"""Polynomial hashes over bytes in numpy: prefix sums give the hash of any substring in one step.

A byte c at position i adds T[c] * B^i to a running sum, with T a fixed table of random
numbers. The sum between two positions, times B^-start, depends on the bytes alone.

Modulo 2^64 (`prefix`, `between`) this is quick, but whole families of strings (Thue-Morse
words of 1,024 bytes and their complements) have the same hash under every table and base.
It may order or narrow, where bytes or another hash decide. `Residues` works modulo two
primes, where strings of n bytes agree under at most n of 2^31 bases each; it is what
tells words and contexts apart.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
TABLES = np.random.Generator(np.random.PCG64(20240501)).integers(0, 1 << 63, (2, 256), dtype=np.uint64) * U64(2) + U64(1)
_powers = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """B^0 .. B^(n-1), or of its inverse, grown as needed and kept."""
    held = _powers.get(inverse)
    if held is None or len(held) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        held = np.full(size, _INVERSE if inverse else _BASE, dtype=np.uint64)
        held[0] = 1
        np.multiply.accumulate(held, out=held)
        _powers[inverse] = held
    return held[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a word's bits. One to one, so equal after is equal before."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix(codes: np.ndarray, which: int = 0) -> np.ndarray:
    """Running sums [len + 1] of bytes."""
    out = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(TABLES[which][codes] * powers(len(codes)), out=out[1:])
    return out


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of bytes start..end of each pair."""
    return mix((sums[end] - sums[start]) * powers(len(sums), inverse=True)[start])


#: The two largest primes under 2^31.
PRIMES = (2147483647, 2147483629)
_DRAWN = np.random.Generator(np.random.PCG64(20240917))
_PRIME_BASES = tuple(int(_DRAWN.integers(1 << 20, q - 1)) for q in PRIMES)
_PRIME_TABLES = tuple(_DRAWN.integers(1, q, 256, dtype=np.uint64) for q in PRIMES)
_residue_powers: dict[tuple[int, bool], np.ndarray] = {}


def _residues(k: int, n: int, inverse: bool) -> np.ndarray:
    held = _residue_powers.get((k, inverse))
    if held is None or len(held) < n:
        q = PRIMES[k]
        base = pow(_PRIME_BASES[k], -1 if inverse else 1, q)
        held = np.ones(1, dtype=np.uint64)
        while len(held) < max(n, 1 << 16):
            held = np.concatenate([held, held * U64(pow(base, len(held), q)) % U64(q)])
        _residue_powers[k, inverse] = held
    return held[:n]


class Residues:
    """Hashes of 62 bits of any substrings of some bytes (up to 2^32 of them)."""

    def __init__(self, codes: np.ndarray):
        self.sums = []
        for k, q in enumerate(PRIMES):
            out = np.zeros(len(codes) + 1, dtype=np.uint64)
            np.cumsum(_PRIME_TABLES[k][codes] * _residues(k, len(codes), False) % U64(q), out=out[1:])
            out %= U64(q)
            self.sums.append(out)

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of bytes start..end of each pair."""
        parts = []
        for k, q in enumerate(PRIMES):
            sums = self.sums[k]
            parts.append((sums[end] + U64(q) - sums[start]) % U64(q) * _residues(k, len(sums), True)[start] % U64(q))
        return mix(parts[0] << U64(31) | parts[1])
