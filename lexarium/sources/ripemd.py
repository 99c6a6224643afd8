"""RIPEMD-128, which MDict derives the key of its index from."""

from __future__ import annotations

import struct

_R1 = [*range(16), 7, 4, 13, 1, 10, 6, 15, 3, 12, 0, 9, 5, 2, 14, 11, 8, 3, 10, 14, 4, 9, 15, 8, 1, 2, 7, 0, 6, 13, 11, 5, 12, 1, 9, 11, 10, 0, 8, 12, 4, 13, 3, 7, 15, 14, 5, 6, 2]
_R2 = [5, 14, 7, 0, 9, 2, 11, 4, 13, 6, 15, 8, 1, 10, 3, 12, 6, 11, 3, 7, 0, 13, 5, 10, 14, 15, 8, 12, 4, 9, 1, 2, 15, 5, 1, 3, 7, 14, 6, 9, 11, 8, 12, 2, 10, 0, 4, 13, 8, 6, 4, 1, 3, 11, 15, 0, 5, 12, 2, 13, 9, 7, 10, 14]
_S1 = [11, 14, 15, 12, 5, 8, 7, 9, 11, 13, 14, 15, 6, 7, 9, 8, 7, 6, 8, 13, 11, 9, 7, 15, 7, 12, 15, 9, 11, 7, 13, 12, 11, 13, 6, 7, 14, 9, 13, 15, 14, 8, 13, 6, 5, 12, 7, 5, 11, 12, 14, 15, 14, 15, 9, 8, 9, 14, 5, 6, 8, 6, 5, 12]
_S2 = [8, 9, 9, 11, 13, 15, 15, 5, 7, 7, 8, 11, 14, 14, 12, 6, 9, 13, 15, 7, 12, 8, 9, 11, 7, 7, 12, 7, 6, 15, 13, 11, 9, 7, 15, 11, 8, 6, 6, 14, 12, 13, 5, 14, 13, 13, 7, 5, 15, 5, 8, 11, 14, 14, 6, 14, 6, 9, 12, 9, 12, 5, 15, 8]
_K1 = (0, 0x5A827999, 0x6ED9EBA1, 0x8F1BBCDC)
_K2 = (0x50A28BE6, 0x5C4DD124, 0x6D703EF3, 0)
_M = 0xFFFFFFFF


def _f(j: int, x: int, y: int, z: int) -> int:
    if j == 0:
        return x ^ y ^ z
    if j == 1:
        return (x & y) | (~x & z & _M)
    if j == 2:
        return (x | (~y & _M)) ^ z
    return (x & z) | (y & ~z & _M)


def ripemd128(data: bytes) -> bytes:
    h = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]
    padded = data + b"\x80" + b"\0" * (-(len(data) + 9) % 64) + struct.pack("<Q", len(data) * 8)
    for at in range(0, len(padded), 64):
        x = struct.unpack_from("<16I", padded, at)
        lines = []
        for order, shift, const, flip in ((_R1, _S1, _K1, False), (_R2, _S2, _K2, True)):
            a, b, c, d = h
            for i in range(64):
                j = i // 16
                t = (a + _f(3 - j if flip else j, b, c, d) + x[order[i]] + const[j]) & _M
                t = ((t << shift[i]) | (t >> (32 - shift[i]))) & _M
                a, b, c, d = d, t, b, c
            lines.append((a, b, c, d))
        (a, b, c, d), (e, f, g, k) = lines
        h = [(h[1] + c + k) & _M, (h[2] + d + e) & _M, (h[3] + a + f) & _M, (h[0] + b + g) & _M]
    return struct.pack("<4I", *h)
