"""The 64-bit string fingerprint of the public FarmHash family, on Python integers."""

from __future__ import annotations

import struct

# Fixed values of the published function.
K0, K1, K2 = 0xC3A5C85C97CB3127, 0xB492B66FBE98F273, 0x9AE16A3B2F90404F
M = (1 << 64) - 1


def _turn(v: int, n: int) -> int:
    v &= M
    return (v >> n | v << (64 - n)) & M


def _shift(v: int) -> int:
    return v ^ (v >> 47)


def _pair(u: int, v: int, by: int) -> int:
    a = _shift(((u ^ v) & M) * by & M)
    return _shift(((v ^ a) & M) * by & M) * by & M


def _long(s: bytes, n: int) -> int:
    word = lambda i: struct.unpack_from("<Q", s, i)[0]

    def weak(at: int, a: int, b: int) -> tuple[int, int]:
        w, x, y, z = struct.unpack_from("<4Q", s, at)
        a = (a + w) & M
        c = (a + x + y) & M
        return (c + z) & M, (_turn(b + a + z, 21) + _turn(c, 44) + a) & M

    x, y = 81, (81 * K1 + 113) & M
    z = _shift((y * K2 + 113) & M) * K2 & M
    v, w = (0, 0), (0, 0)
    x = (x * K2 + word(0)) & M
    for at in range(0, (n - 1) // 64 * 64, 64):
        x, y, z, v, w = _block(word, weak, at, x, y, z, v, w)
    by = (K1 + ((z & 0xFF) << 1)) & M
    at = n - 64
    w = ((w[0] + ((n - 1) & 63)) & M, w[1])
    v = ((v[0] + w[0]) & M, v[1])
    w = ((w[0] + v[0]) & M, w[1])
    x = _turn(x + y + v[0] + word(at + 8), 37) * by & M
    y = _turn(y + v[1] + word(at + 48), 42) * by & M
    x ^= w[1] * 9 & M
    y = (y + v[0] * 9 + word(at + 40)) & M
    z = _turn(z + w[0], 33) * by & M
    v, w = weak(at, v[1] * by, x + w[0]), weak(at + 32, z + w[1], y + word(at + 16))
    x, z = z, x
    return _pair((_pair(v[0], w[0], by) + _shift(y) * K0 + z) & M, (_pair(v[1], w[1], by) + x) & M, by)


def _block(word, weak, at, x, y, z, v, w):
    x = _turn(x + y + v[0] + word(at + 8), 37) * K1 & M
    y = _turn(y + v[1] + word(at + 48), 42) * K1 & M
    x ^= w[1]
    y = (y + v[0] + word(at + 40)) & M
    z = _turn(z + w[0], 33) * K1 & M
    v, w = weak(at, v[1] * K1, x + w[0]), weak(at + 32, z + w[1], y + word(at + 16))
    return z, y, x, v, w


def fingerprint64(s: bytes) -> int:
    n = len(s)
    word = lambda i: struct.unpack_from("<Q", s, i)[0]
    if n > 64:
        return _long(s, n)
    by = (K2 + n * 2) & M
    if n > 32:
        a, b, c, d = word(0) * K2 & M, word(8), word(n - 8) * by & M, word(n - 16) * K2 & M
        y = (_turn(a + b, 43) + _turn(c, 30) + d) & M
        z = _pair(y, (a + _turn(b + K2, 18) + c) & M, by)
        e, f = word(16) * by & M, word(24)
        g, h = (y + word(n - 32)) * by & M, (z + word(n - 24)) * by & M
        return _pair((_turn(e + f, 43) + _turn(g, 30) + h) & M, (e + _turn(f + a, 18) + g) & M, by)
    if n > 16:
        a, b, c, d = word(0) * K1 & M, word(8), word(n - 8) * by & M, word(n - 16) * K2 & M
        return _pair((_turn(a + b, 43) + _turn(c, 30) + d) & M, (a + _turn(b + K2, 18) + c) & M, by)
    if n >= 8:
        a, b = (word(0) + K2) & M, word(n - 8)
        return _pair((_turn(b, 37) * by + a) & M, (_turn(a, 25) + b) * by & M, by)
    if n >= 4:
        first, last = struct.unpack_from("<I", s)[0], struct.unpack_from("<I", s, n - 4)[0]
        return _pair((n + (first << 3)) & M, last, by)
    if n:
        y, z = s[0] + (s[n >> 1] << 8), n + (s[n - 1] << 2)
        return _shift((y * K2 ^ z * K0) & M) * K2 & M
    return K2
