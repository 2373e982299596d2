"""CRC-32 of a text's UTF-8 bytes in DuckDB SQL."""

#: A common table expression with the table of remainders, made by its rule: eight shifts per byte.
CRC32_TABLE = """crc_table AS (
    SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
        lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS remainders)"""

#: The checksum of ``{text}``, beside ``crc_table``.
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen({text}) + 1),
        lambda i: ('0x' || substr(hex({text}), 2 * i - 1, 2))::BIGINT)),
        lambda c, b: xor(c >> 8, remainders[(xor(c, b) & 255) + 1])))"""
