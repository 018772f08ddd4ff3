"""ASCII words of texts as bytes: letters A-Z lower-cased, digits, and all other characters beyond ASCII."""

from __future__ import annotations

#: Fixed value: every other byte separates words.
SIGNS = b"abcdefghijklmnopqrstuvwxyz0123456789" + bytes(range(0x80, 0x100))
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in SIGNS else 0x20 for b in range(256))


def byte_words(text: bytes | None) -> list[bytes]:
    """The words of a text in UTF-8; null has none. A word is never cut, however long."""
    return text.translate(_TABLE).split() if text else []
