"""SQL fragments that oracle queries of the training-data operators share."""

from __future__ import annotations


def crc32(text: str) -> str:
    """The unsigned crc32 of a text's UTF-8 bytes, bit by bit."""
    digits = f"hex(encode({text}))"
    octets = f"list_transform(range(0, CAST(length({digits}) / 2 AS BIGINT)), lambda i: CAST('0x' || substr({digits}, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))"
    step = "list_reduce(list_prepend(xor(c, o), [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda c, o: {step}), 4294967295)"
