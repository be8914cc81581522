"""Words of a text as bytes, in blocks, so that a very long text needs little memory."""

from __future__ import annotations

import re
from collections.abc import Iterator

_GAP = re.compile(rb"[\x20\x09-\x0D]")
BLOCK = 1 << 20


def blocks(text: bytes, size: int = BLOCK) -> Iterator[bytes]:
    """`text` cut at white space into parts of about `size` bytes."""
    at = 0
    while len(text) - at > size:
        gap = _GAP.search(text, at + size)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def shingles(text: bytes, width: int) -> Iterator[list[bytes]]:
    """Space-joined runs of `width` words, repeats included, block by block; of fewer words, the whole sequence; A-Z lower-cased."""
    carry: list[bytes] = []
    some = False
    for part in blocks(text):
        words = carry + part.lower().split()
        if len(words) >= width:
            some = True
            yield list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))
            carry = words[len(words) - width + 1:] if width > 1 else []
        else:
            carry = words
    if not some and carry:
        yield [b" ".join(carry)]
