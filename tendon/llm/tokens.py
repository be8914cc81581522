"""Token ids of the public byte-level vocabulary."""

from __future__ import annotations

import base64
import json
import os
import re
from functools import lru_cache

import numpy as np

_TWO_GAPS = re.compile(r"\s\s")


def vocabulary_path() -> str:
    """The installed ranks file; it holds the vocabulary of byte_bpe_50k.json."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def _encoders(path: str):
    import public_tokenizers
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = public_tokenizers.PATTERN
    # Looking ahead only matters inside a run of two or more white-space characters, and costs a third of the time.
    plain = pattern.replace(r"|\s+(?!\S)", "")
    return tuple(tiktoken.Encoding(n, pat_str=p, mergeable_ranks=ranks, special_tokens={}) for n, p in (("full", pattern), ("plain", plain)))


def encode(text: str | None, path: str) -> list[int]:
    """Ids of the whole text, added tokens spelled out; null counts as empty."""
    if not text:
        return []
    full, plain = _encoders(path)
    return (full if _TWO_GAPS.search(text) else plain).encode_ordinary(text)


@lru_cache(maxsize=4)
def _added(path: str) -> tuple[re.Pattern | None, dict[str, int]]:
    """The tokens that the JSON file beside the ranks adds to the vocabulary; none without such a file."""
    name = os.path.splitext(path)[0] + ".json"
    if not os.path.exists(name):
        return None, {}
    with open(name, encoding="utf-8") as f:
        tokens = json.load(f).get("added_tokens") or []
    if any(t.get(k) for t in tokens for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{name}: added tokens that take white space, whole words or normalized text are not read here")
    ids = {t["content"]: t["id"] for t in tokens if t["content"]}
    return (re.compile("(" + "|".join(map(re.escape, sorted(ids, key=len, reverse=True))) + ")") if ids else None), ids


def ids_of(text: str | None, path: str) -> list[int]:
    """Ids of the whole text as `tokenizers` gives them: added tokens keep their own id, what lies between is encoded by itself. Null counts as empty."""
    pattern, ids = _added(path)
    if not text or pattern is None or not pattern.search(text):
        return encode(text, path)
    out: list[int] = []
    for i, part in enumerate(pattern.split(text)):
        out += [ids[part]] if i % 2 else encode(part, path)
    return out


def encode_array(text: str | None, path: str) -> np.ndarray:
    return np.array(ids_of(text, path), np.uint32)
