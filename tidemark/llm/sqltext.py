"""Pieces of the operators' DuckDB SQL."""


def crc32(text: str) -> str:
    """The CRC-32 of a short ASCII text, bit by bit."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(substr({text}, CAST(i AS INT), 1)) AS BIGINT))"
    byte = "list_reduce(range(0, 8), lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), xor(r, b))"
    return f"xor(list_reduce({codes}, lambda r, b: {byte}, CAST(4294967295 AS BIGINT)), 4294967295)"
