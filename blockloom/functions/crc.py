"""CRC-32C, the checksum of metadata, by a table made from its polynomial."""

from __future__ import annotations

POLYNOMIAL = 0x82F63B78


def _table() -> list[int]:
    out = []
    for b in range(256):
        for _ in range(8):
            b = b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
        out.append(b)
    return out


_TABLE = _table()


def crc32c(data: bytes, start: int = 0xFFFFFFFF) -> int:
    """The running checksum after ``data``, without the final inversion, as file systems keep it."""
    c, table = start, _TABLE
    for b in data:
        c = table[(c ^ b) & 0xFF] ^ c >> 8
    return c
