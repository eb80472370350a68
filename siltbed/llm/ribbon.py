"""Ribbon filters: an approximate set stored as the solution of a banded linear system over bits.

Each key gives one equation: the XOR of the solution's rows chosen by a 64-bit coefficient, from a start row on, is
the key's fingerprint of R bits. Building solves the system once for a sealed batch (elimination that keeps the band,
then back substitution); a probe recomputes the equation. A key of the batch always satisfies it, another one with
probability 2^-R. Keys come as two 64-bit hashes, computed in the JVM, so no key text reaches Python.
"""

from __future__ import annotations

import numpy as np

W = 64  #: width of the band in bits
FREE = 1.18  #: rows of the system for each key; a smaller surplus needs more attempts
M64 = (1 << 64) - 1


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A finaliser that makes independent hashes of one hash (xor-shift and multiply, modulo 2^64)."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & M64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _equations(h: np.ndarray, seed: int, rows: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = _mix(h, 3 * seed)
    start = ((a >> np.uint64(32)) * np.uint64(rows - W + 1)) >> np.uint64(32)
    coeff = _mix(h, 3 * seed + 1) | np.uint64(1)
    print_ = _mix(h, 3 * seed + 2) & np.uint64((1 << bits) - 1)
    return start.astype(np.int64), coeff, print_


def _eliminate(start: list[int], coeff: list[int], prints: list[int], rows: int) -> tuple[list[int], list[int]] | None:
    c, f = [0] * rows, [0] * rows
    for s, x, y in zip(start, coeff, prints, strict=True):
        while True:
            have = c[s]
            if not have:
                c[s], f[s] = x, y
                break
            x ^= have
            y ^= f[s]
            if not x:
                if y:
                    return None  # contradiction: another seed
                break
            move = (x & -x).bit_length() - 1
            x >>= move
            s += move
    return c, f


def build(hashes: np.ndarray, bits: int = 12) -> tuple[int, int, bytes]:
    """(seed, rows, solution) of the set of hashes (int64); an empty set has rows 0."""
    h = np.unique(hashes.astype(np.int64)).view(np.uint64)
    if not len(h):
        return 0, 0, b""
    seed, rows = 0, max(2 * W, int(len(h) * FREE) + W)
    while True:
        start, coeff, prints = _equations(h, seed, rows, bits)
        by = np.argsort(start, kind="stable")
        got = _eliminate(start[by].tolist(), coeff[by].tolist(), prints[by].tolist(), rows)
        if got:
            break
        seed += 1
        if seed % 3 == 0:
            rows += max(W, rows // 20)
    return seed, rows, _solve(*got, bits)


def _solve(coeff: list[int], prints: list[int], bits: int) -> bytes:
    """Back substitution, from the last row up, for all bits of the fingerprints at once.

    The last 64 solved rows are one long integer with a lane of 64 bits for each bit of a fingerprint. A row's
    coefficient is copied into all lanes by a multiplication; the parity of each lane is folded into its lowest bit.
    """
    ones = sum(1 << (W * j) for j in range(bits))
    keep = ((1 << (W * bits)) - 1) ^ ones
    spread: dict[int, int] = {}
    state, width = 0, bits * W // 8
    out = []
    for x, y in zip(reversed(coeff), reversed(prints), strict=True):
        if x:
            want = spread.get(y)
            if want is None:
                want = spread[y] = sum(((y >> j) & 1) << (W * j) for j in range(bits))
            t = (state << 1) & keep & (x * ones)
            t ^= t >> 32
            t ^= t >> 16
            t ^= t >> 8
            t ^= t >> 4
            t ^= t >> 2
            row = ((t ^ (t >> 1)) & ones) ^ want
        else:
            row = 0  # no key has this row: any value solves the system
        state = ((state << 1) & keep) | row
        out.append(row.to_bytes(width, "little"))
    lanes = np.frombuffer(b"".join(out), np.uint8).reshape(len(out), bits, W // 8)[::-1, :, 0]
    return np.packbits(lanes.T, axis=1, bitorder="little").tobytes()


def probe(hashes: np.ndarray, seed: int, rows: int, solution: bytes, bits: int = 12) -> np.ndarray:
    """Whether each hash satisfies its equation: True for every key of the batch and for 2^-bits of all others."""
    if not rows or not len(hashes):
        return np.zeros(len(hashes), bool)
    start, coeff, prints = _equations(hashes.astype(np.int64).view(np.uint64), seed, rows, bits)
    width = (rows + 7) // 8
    packed = np.frombuffer(solution, np.uint8).reshape(bits, width)
    words = np.zeros((bits, width // 8 + 3), "<u8")
    words.view(np.uint8)[:, :width] = packed
    word, shift = start >> 6, (start & 63).astype(np.uint64)
    hit = np.ones(len(hashes), bool)
    for j in range(bits):
        low = words[j][word] >> shift
        high = np.where(shift == 0, np.uint64(0), words[j][word + 1] << ((np.uint64(64) - shift) & np.uint64(63)))
        parity = np.bitwise_count((low | high) & coeff).astype(np.uint64) & np.uint64(1)
        hit &= parity == ((prints >> np.uint64(j)) & np.uint64(1))
    return hit
