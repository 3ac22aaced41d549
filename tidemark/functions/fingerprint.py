"""The published 64-bit fingerprint of FarmHash, as an Arrow-batched function.

Spark has no such hash. Numbers of a fixed width, the usual case, are hashed a whole batch at once with numpy;
strings once per distinct value of a batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.workers import equip

#: The algorithm's constants.
K0, K1, K2 = 0xC3A5C85C97CB3127, 0xB492B66FBE98F273, 0x9AE16A3B2F90404F
M = (1 << 64) - 1


def _rotate(x: int, by: int) -> int:
    return ((x >> by) | (x << (64 - by))) & M


def _shift_mix(x: int) -> int:
    return x ^ (x >> 47)


def _mix(u: int, v: int, mul: int) -> int:
    a = _shift_mix(((u ^ v) * mul) & M)
    b = _shift_mix(((v ^ a) * mul) & M)
    return (b * mul) & M


def _word(b: bytes, at: int, size: int = 8) -> int:
    return int.from_bytes(b[at : at + size], "little")


def _weak(b: bytes, at: int, p: int, q: int) -> tuple[int, int]:
    w, x, y, z = (_word(b, at + 8 * i) for i in range(4))
    p = (p + w) & M
    q = _rotate((q + p + z) & M, 21)
    start = p
    p = (p + x + y) & M
    q = (q + _rotate(p, 44)) & M
    return (p + z) & M, (q + start) & M


def fingerprint(b: bytes) -> int:
    """Unsigned fingerprint of a byte string."""
    n = len(b)
    mul = (K2 + 2 * n) & M
    if n == 0:
        return K2
    if n < 4:
        y, z = b[0] + (b[n >> 1] << 8), n + (b[-1] << 2)
        return (_shift_mix(((y * K2) & M) ^ ((z * K0) & M)) * K2) & M
    if n < 8:
        return _mix((n + (_word(b, 0, 4) << 3)) & M, _word(b, n - 4, 4), mul)
    if n <= 16:
        p, q = (_word(b, 0) + K2) & M, _word(b, n - 8)
        return _mix((_rotate(q, 37) * mul + p) & M, ((_rotate(p, 25) + q) * mul) & M, mul)
    if n <= 32:
        p, q, r, s = (_word(b, 0) * K1) & M, _word(b, 8), (_word(b, n - 8) * mul) & M, (_word(b, n - 16) * K2) & M
        return _mix((_rotate((p + q) & M, 43) + _rotate(r, 30) + s) & M, (p + _rotate((q + K2) & M, 18) + r) & M, mul)
    if n <= 64:
        p, q, r, s = (_word(b, 0) * K2) & M, _word(b, 8), (_word(b, n - 8) * mul) & M, (_word(b, n - 16) * K2) & M
        y = (_rotate((p + q) & M, 43) + _rotate(r, 30) + s) & M
        z = _mix(y, (p + _rotate((q + K2) & M, 18) + r) & M, mul)
        e, f = (_word(b, 16) * mul) & M, _word(b, 24)
        g, h = ((y + _word(b, n - 32)) * mul) & M, ((z + _word(b, n - 24)) * mul) & M
        return _mix((_rotate((e + f) & M, 43) + _rotate(g, 30) + h) & M, (e + _rotate((f + p) & M, 18) + g) & M, mul)
    return _long(b)


def _long(b: bytes) -> int:
    n, seed = len(b), 81
    y = (seed * K1 + 113) & M
    z = (_shift_mix((y * K2 + 113) & M) * K2) & M
    v, w, x = (0, 0), (0, 0), (seed * K2 + _word(b, 0)) & M

    def block(at: int, mul: int, by: int) -> None:
        nonlocal v, w, x, y, z
        x = (_rotate((x + y + v[0] + _word(b, at + 8)) & M, 37) * mul) & M
        y = (_rotate((y + v[1] + _word(b, at + 48)) & M, 42) * mul) & M
        x ^= (w[1] * by) & M
        y = (y + v[0] * by + _word(b, at + 40)) & M
        z = (_rotate((z + w[0]) & M, 33) * mul) & M
        v = _weak(b, at, (v[1] * mul) & M, (x + w[0]) & M)
        w = _weak(b, at + 32, (z + w[1]) & M, (y + _word(b, at + 16)) & M)
        z, x = x, z

    for at in range(0, (n - 1) // 64 * 64, 64):
        block(at, K1, 1)
    mul = (K1 + ((z & 0xFF) << 1)) & M
    w = ((w[0] + ((n - 1) & 63)) & M, w[1])
    v = ((v[0] + w[0]) & M, v[1])
    w = ((w[0] + v[0]) & M, w[1])
    block(n - 64, mul, 9)
    return _mix((_mix(v[0], w[0], mul) + _shift_mix(y) * K0 + z) & M, (_mix(v[1], w[1], mul) + x) & M, mul)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(values: np.ndarray) -> np.ndarray:
    """Signed fingerprints of whole numbers by their bytes, little end first; 16, 32 or 64 bits wide."""
    size = values.dtype.itemsize
    if size < 4:
        known, back = np.unique(values, return_inverse=True)
        return np.array([signed(fingerprint(int(k).to_bytes(size, "little", signed=True))) for k in known], np.int64)[back]
    u, mul = np.uint64, np.uint64((K2 + 2 * size) & M)
    with np.errstate(over="ignore"):
        if size == 8:
            b = values.view(u)
            a = b + u(K2)
            turn = lambda x, by: (x >> u(by)) | (x << u(64 - by))
            x, y = turn(b, 37) * mul + a, (turn(a, 25) + b) * mul
        else:
            b = values.view(np.uint32).astype(u)
            x, y = u(4) + (b << u(3)), b
        a = (x ^ y) * mul
        a ^= a >> u(47)
        b = (y ^ a) * mul
        b ^= b >> u(47)
        return (b * mul).view(np.int64)


_DTYPES = {"smallint": np.int16, "int": np.int32, "bigint": np.int64}


def hash64(x: Column, kind: str) -> Column:
    """Signed fingerprint of a value of Spark type ``kind``: a whole number's bytes, or a string's; NULL gives NULL."""
    equip()
    if kind in _DTYPES:
        dtype = _DTYPES[kind]

        @F.pandas_udf("bigint")
        def of_numbers(s: pd.Series) -> pd.Series:
            out = pd.Series(pd.NA, index=s.index, dtype="Int64")
            known = s.notna()
            out[known] = fingerprints(s[known].to_numpy().astype(dtype))
            return out

        return of_numbers(x)

    @F.pandas_udf("bigint")
    def of_bytes(s: pd.Series) -> pd.Series:
        found = {v: signed(fingerprint(bytes(v))) for v in s.dropna().unique()}
        return s.map(found).astype("Int64")

    return of_bytes(x.cast("binary") if kind == "string" else x.cast("string").cast("binary"))
