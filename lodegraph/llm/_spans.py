"""Base spans of text patterns, and the digest columns that queries derive from spans."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

Span = tuple[int, int, str]  # start, end (code points, end exclusive), kind


def found(text: str, kind: str, pattern: re.Pattern, fits: Callable[[re.Match], bool]) -> list[Span]:
    """Leftmost non-overlapping matches that fit; one that doesn't is dropped, its characters are not tried again."""
    return [(m.start(), m.end(), kind) for m in pattern.finditer(text) if fits(m)]


def joined(spans: list[Span], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda s: (s[0], kinds.index(s[2]), s[1])))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
