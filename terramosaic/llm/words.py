"""Word splitting on UTF-8 bytes, shared by the word-based operators."""

from __future__ import annotations

#: A-Z to a-z; every ASCII byte but digits and letters becomes a space; other bytes stay.
WORD_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: A-Z to a-z, nothing else.
LOWER_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words(raw: bytes) -> list[bytes]:
    r"""Matches of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` in the lower-cased text."""
    return raw.translate(WORD_TABLE).split()


def space_words(raw: bytes) -> list[bytes]:
    r"""Matches of ``[^\x20\x09-\x0D]+`` in the lower-cased text."""
    return raw.translate(LOWER_TABLE).split()
