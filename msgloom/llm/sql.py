"""DuckDB SQL that several oracles share."""

from __future__ import annotations


def crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII string: SQL for an expression that gives one."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda p: ascii(substr({text}, p, 1))::BIGINT)"
    byte = "list_reduce(list_concat([xor(crc, code)], range(8)), lambda c, bit: xor(c >> 1, 3988292384 * (c & 1)))"
    return f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda crc, code: {byte}))"
