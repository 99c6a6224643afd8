"""Decoder of LZO1X streams, after the published description of the stream format."""

from __future__ import annotations

from lexarium.errors import DecompressionFailed


def decompress(data: bytes, limit: int) -> bytes:
    """The bytes of a whole stream; raises where it is cut, points before its start, has a tail or grows beyond ``limit``."""
    out = bytearray()
    at = 0
    state = 0  # literals that the last instruction copied: 0 to 3, or 4 for a long run

    def byte() -> int:
        nonlocal at
        if at >= len(data):
            raise DecompressionFailed("the stream ends early")
        at += 1
        return data[at - 1]

    def length(first: int, mask: int) -> int:
        """A length in the low bits of an instruction, or, where they are 0, in the bytes that follow."""
        if first & mask:
            return first & mask
        total = mask
        while not (x := byte()):
            total += 255
            if total > limit:
                raise DecompressionFailed(f"more than {limit} bytes")
        return total + x

    def literals(n: int) -> None:
        nonlocal at
        if at + n > len(data):
            raise DecompressionFailed("the stream ends early")
        out.extend(data[at : at + n])
        at += n

    def match(distance: int, n: int) -> None:
        if distance > len(out):
            raise DecompressionFailed("a match before the start")
        for i in range(len(out) - distance, len(out) - distance + n):
            out.append(out[i])

    if data[:1] > b"\x11":
        n = byte() - 17
        literals(n)
        state = min(n, 4)
    while True:
        if len(out) > limit:
            raise DecompressionFailed(f"more than {limit} bytes")
        op = byte()
        if op >= 64:
            low = byte()
            match((low << 3) + (op >> 2 & 7) + 1, (op >> 5) + 1)
        elif op >= 32:
            n = length(op, 31) + 2
            op = byte()
            match((byte() << 6) + (op >> 2) + 1, n)
        elif op >= 16:
            n = length(op, 7) + 2
            far = (op & 8) << 11
            op = byte()
            distance = far + (byte() << 6) + (op >> 2)
            if not distance:
                break
            match(distance + 16384, n)
        elif state == 0:
            literals(length(op, 15) + 3)
            state = 4
            continue
        elif state == 4:
            match((byte() << 2) + (op >> 2) + 2049, 3)
        else:
            match((byte() << 2) + (op >> 2) + 1, 2)
        state = op & 3
        literals(state)
    if at != len(data):
        raise DecompressionFailed("bytes after the end of the stream")
    return bytes(out)
