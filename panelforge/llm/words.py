"""Words of a text by one translation of its UTF-8 bytes: letters lowered and separators blanked at once, then cut at blanks."""

from __future__ import annotations

from collections.abc import Iterator

DIGITS = b"0123456789"
LETTERS = b"abcdefghijklmnopqrstuvwxyz"

#: Bytes that become a list of words at once.
SLICE = 1 << 20


def translation(kept: bytes) -> bytes:
    """A table for ``bytes.translate``: A to Z become small, ``kept`` and all characters beyond ASCII stay, the rest are blanks."""
    return bytes(b if b >= 0x80 or b in kept else 0x20 for b in bytes(range(256)).lower())


def slices(text: bytes, table: bytes, size: int = SLICE) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about ``size`` bytes that end between words: a long text never is one list."""
    text, at = text.translate(table), 0
    while at < len(text):
        end = text.find(b" ", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end
