"""Sizes, counts and short texts for options and reports."""

from __future__ import annotations

import math
import re

from collatrix.errors import UsageError

_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30, "t": 1 << 40, "tb": 1 << 40}


def parse_size(text: str | int) -> int:
    """Bytes of ``1.5gb`` and the like, by 1024; fractions of a byte are dropped."""
    if isinstance(text, int):
        return text
    found = re.fullmatch(r"\s*(\d+(?:\.\d*)?|\.\d+)\s*([a-zA-Z]*)\s*", text)
    if not found or found[2].lower() not in _UNITS:
        raise UsageError(f"not a size: {text!r}")
    whole = math.floor(float(found[1]) * _UNITS[found[2].lower()]) if "." in found[1] else int(found[1]) * _UNITS[found[2].lower()]
    if whole >= 1 << 64:
        raise UsageError(f"size is too large: {text!r}")
    return whole


def human_size(n: int) -> str:
    value = float(n)
    for unit in ("B", "KB", "MB", "GB"):
        if value < 1024:
            return f"{n} B" if unit == "B" else f"{value:.1f} {unit}"
        value /= 1024
    return f"{value:.1f} TB"


def grouped(n: int) -> str:
    return f"{n:,}"


def shorten(text: str, most_bytes: int = 80) -> str:
    """At most so many bytes of UTF-8, never within a character, with an ellipsis if cut."""
    raw = text.encode()
    if len(raw) <= most_bytes:
        return text
    return raw[:most_bytes].decode("utf-8", "ignore") + "..."
