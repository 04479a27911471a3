"""Pieces of DuckDB SQL that several twins share."""

from __future__ import annotations


def _table() -> list[int]:
    out = []
    for value in range(256):
        for _ in range(8):
            value = (value >> 1) ^ (0xEDB88320 * (value & 1))
        out.append(value)
    return out


def crc32(expr: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of the text ``expr``, byte by byte."""
    table = "[" + ",".join(map(str, _table())) + "]::bigint[]"
    data = f"list_transform(regexp_extract_all(hex(encode({expr})), '..'), lambda x: ('0x' || x)::bigint)"
    return f"xor(4294967295::bigint, list_reduce({data}, lambda a, b: xor(a >> 8, ({table})[xor(a & 255, b) + 1]), 4294967295::bigint))"
