"""Character encodings of whole files: names, byte order marks, decoding and encoding."""

from __future__ import annotations

import codecs
import itertools
from collections.abc import Iterator

from collatrix.errors import UsageError

# Names by canonical name, and byte order marks (UTF-32 before UTF-16, which starts alike).
NAMES = {
    "utf-8": ("utf8", "utf-8"),
    "utf-8-bom": ("utf8bom", "utf-8-bom", "utf-8-sig"),
    "latin-1": ("latin1", "latin-1", "iso-8859-1", "iso88591", "windows-1252", "cp1252"),
    "utf-16le": ("utf16le", "utf-16le", "utf-16-le", "utf16", "utf-16"),
    "utf-16be": ("utf16be", "utf-16be", "utf-16-be"),
    "utf-32le": ("utf32le", "utf-32le", "utf-32-le", "utf32", "utf-32"),
    "utf-32be": ("utf32be", "utf-32be", "utf-32-be"),
}
MARKS = (
    ("utf-32le", codecs.BOM_UTF32_LE),
    ("utf-32be", codecs.BOM_UTF32_BE),
    ("utf-8-bom", codecs.BOM_UTF8),
    ("utf-16le", codecs.BOM_UTF16_LE),
    ("utf-16be", codecs.BOM_UTF16_BE),
)
_PYTHON = {"utf-8-bom": "utf-8", "latin-1": "latin-1", "utf-16le": "utf-16-le", "utf-16be": "utf-16-be", "utf-32le": "utf-32-le", "utf-32be": "utf-32-be"}
_BY_ALIAS = {alias: name for name, aliases in NAMES.items() for alias in aliases}


def canonical(name: str) -> str:
    found = _BY_ALIAS.get(name.strip().lower().replace("_", "-"))
    if found is None:
        raise UsageError(f"unknown encoding {name!r}; known: {', '.join(NAMES)}")
    return found


def sniff(head: bytes) -> str | None:
    """The encoding that a byte order mark names."""
    return next((name for name, mark in MARKS if head.startswith(mark)), None)


def python_codec(name: str) -> str:
    return _PYTHON.get(name, name)


def mark_of(name: str) -> bytes:
    return dict(MARKS).get(name, b"")


def decode(raw: bytes, name: str) -> str:
    """Text without its byte order mark; wrong bytes become U+FFFD."""
    mark = mark_of(name)
    return raw.removeprefix(mark).decode(python_codec(name), "replace")


def decoded_blocks(blocks: Iterator[bytes], name: str) -> Iterator[str]:
    """Lines of a file's blocks, without byte order mark, newline and one carriage return before it. What
    follows the last newline is a line unless it is empty."""
    decoder = codecs.getincrementaldecoder(python_codec(name))("replace")
    mark, head, rest = mark_of(name), b"", ""
    for block in itertools.chain(blocks, [None]):
        if block is not None and mark and len(head) < len(mark):
            head += block
            if len(head) < len(mark):
                continue
            block = head.removeprefix(mark)
        elif block is None and head and len(head) < len(mark):
            rest = decoder.decode(head)
        *lines, rest = (rest + decoder.decode(block or b"", final=block is None)).split("\n")
        yield from (x.removesuffix("\r") for x in lines)
    if rest:
        yield rest.removesuffix("\r")


def encode(text: str, name: str) -> bytes:
    """Bytes without a mark; what the encoding lacks becomes ``?``."""
    return text.encode(python_codec(name), "replace")
