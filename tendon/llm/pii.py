"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby move the score."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import without

#: Kinds in the order of the output. The first four are always kept; the others need LEAST points.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = 4
# fixed values: points of a confirmed span, points that a word nearby adds, the least that an added kind needs, code points looked at before a span
POINTS = {"email": 90, "ip": 60, "card": 80, "phone": 60, "iban": 70, "ssn": 30}
WORD_POINTS = 30
LEAST = 50
NEAR = 40
# fixed values: words that speak for a kind, lower case
WORDS = {"email": r"\b(email|e-mail|mail|contact|write)\b", "ip": r"\b(ip|host|server|address)\b", "card": r"\b(card|visa|mastercard|amex|credit|payment)\b",
         "phone": r"\b(phone|tel|telephone|call|mobile|fax)\b", "iban": r"\b(iban|bank|account|konto|transfer)\b", "ssn": r"\b(ssn|social security)\b"}
#: The patterns as any engine without look-around reads them; `_FIND` has them so that the time is linear in a text.
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]", "iban": r"\b[A-Z]{2}[0-9]{2}( ?[A-Z0-9]){11,30}\b", "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_FIND = {"ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"), "card": re.compile(r"[0-9](?:[\x20-]?[0-9])++"), "phone": re.compile(PATTERNS["phone"]),
         "iban": re.compile(PATTERNS["iban"], re.ASCII), "ssn": re.compile(PATTERNS["ssn"], re.ASCII)}
_NEAR = {k: re.compile(w, re.ASCII) for k, w in WORDS.items()}
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
SPANS = "array<struct<kind:string,start:bigint,end:bigint,points:int>>"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping e-mail addresses. Each @ with a domain behind it looks back once over what no address before it took."""
    taken = 0
    for m in _DOMAIN.finditer(text):
        at = start = m.start()
        while start > taken and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            taken = m.end()
            yield start, taken


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def mod97(account: str) -> bool:
    """ISO 7064 check of an account number: first four signs last, letters as 10 to 35."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def confirmed(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) < 4 and int(p[-3:]) < 256 for p in found.split("."))
    if kind == "card":
        digits = found.replace(" ", "").replace("-", "")
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= sum(c.isdigit() for c in found) <= 15
    if kind == "iban":
        return mod97(found.replace(" ", ""))
    if kind == "ssn":
        return found[:3] not in ("000", "666") and found[0] != "9" and found[4:6] != "00" and found[7:] != "0000"
    return True


def points(kind: str, text: str, start: int) -> int:
    near = text[max(0, start - NEAR):start].translate(_LOWER)
    return min(100, POINTS[kind] + (WORD_POINTS if _NEAR[kind].search(near) else 0))


def find(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, points) by start, then kind. Spans of the added kinds need LEAST points and must not overlap one of the first four."""
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    for kind in KINDS[1:]:
        for m in _FIND[kind].finditer(text):
            if confirmed(kind, m.group()):
                out.append((kind, *m.span()))
    if not out:
        return out
    told = sorted((s, KINDS.index(k), e, points(k, text, s)) for k, s, e in out)
    starts = [s for s, k, *_ in told if k < BASE]
    ends = list(accumulate((e for _, k, e, _ in told if k < BASE), max))  # the furthest end of all base spans up to one

    def free(s: int, e: int) -> bool:
        before = bisect_left(starts, e)
        return not before or ends[before - 1] <= s

    return [(KINDS[k], s, e, p) for s, k, e, p in told if k < BASE or p >= LEAST and free(s, e)]


def find_spans(docs: DataFrame, text_col: str = "text", mask: bool = False) -> DataFrame:
    """`docs` with `spans`, an array of (kind, start, end, points), ordered by start, then kind; code points from 0, end exclusive.

    email, ip, card and phone are found leftmost and without overlap each for itself; matches that fail their check (parts up to 255, Luhn and 12 to
    19 digits, 9 to 15 digits) are dropped without another try. Added kinds: iban (mod 97) and ssn (number ranges, and a word such as
    "ssn" within 40 code points before). With `mask`, `masked` holds the text with every span replaced by its kind in angle brackets; of overlapping spans the first counts.

    A null text counts as empty (and stays null in `masked`). Very long texts are read whole, in linear time; memory is that of one text and its spans. Rows
    that repeat are found each for itself, null ids are nothing special, an empty table gives no rows. Nothing is shuffled. Input columns called `spans` or `masked` give way.
    """
    names = without(docs, "spans", "masked")
    source = docs.select(*names, F.col(text_col).cast("string").alias("__t"))
    at = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("points", pa.int32())]))
        for b in batches:
            spans, masked = [], []
            for t in b.column(at):
                text = t.as_py()
                found = find(text or "")
                spans.append([dict(zip(("kind", "start", "end", "points"), f, strict=True)) for f in found])
                if mask:
                    masked.append(None if text is None else hide(text, found))
            extra = [pa.array(masked, pa.string())] if mask else []
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(spans, shape), *extra], names=[*b.schema.names[:at], "spans", *(["masked"] if mask else [])])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:at]]
    return source.mapInArrow(run, ", ".join([*fields, f"spans {SPANS}", *(["masked string"] if mask else [])]))


def hide(text: str, found: list[tuple[str, int, int, int]]) -> str:
    parts, end = [], 0
    for kind, s, e, _ in found:
        if s >= end:
            parts += [text[end:s], f"<{kind}>"]
            end = e
    return "".join([*parts, text[end:]])
