"""Personal data against the patterns as they stand, and on odd input."""

from __future__ import annotations

import random
import re
import time

from pyspark.sql import functions as F

from tendon.llm import pii

SCHEMA = "doc_id long, text string, lang string, spans string, masked string"


def brute(text):
    """Base spans by Python's own search with the patterns of the contract."""
    out = []
    for k, kind in enumerate(pii.KINDS[:pii.BASE]):
        for m in re.finditer(pii.PATTERNS[kind], text):
            digits = re.sub(r"\D", "", m.group(), flags=re.ASCII)
            good = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True, "phone": 9 <= len(digits) <= 15,
                    "card": 12 <= len(digits) <= 19 and sum(int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(reversed(digits))) % 10 == 0}[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return [(pii.KINDS[k], s, e) for s, k, e in sorted(out)]


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(4)
    parts = ["a@b.c", "x.y@mail-1.example.com", "@", "@d.e", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "007.1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 555-3824", "+12", "+4930123456789", "é", " ",
             "-", ".", "0", "9 9", "ab", "%_", "\n", "\x0b", "5555555555554444", "++1 23 45 67 89 0 ", "٣", "😀"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        assert [f[:3] for f in pii.find(text) if f[0] in pii.KINDS[:pii.BASE]] == brute(text), text


def test_checks():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    assert pii.confirmed("ip", "0255.0.0.1") and not pii.confirmed("ip", "256.0.0.1") and not pii.confirmed("ip", "1." + "9" * 5000 + ".1.1")


def test_added_kinds_need_a_check_or_a_word():
    kinds = lambda t: [f[0] for f in pii.find(t)]
    assert kinds("pay to GB82 WEST 1234 5698 7654 32, thanks") == ["iban"]
    assert kinds("pay to GB82 WEST 1234 5698 7654 33, thanks") == []
    assert kinds("part 123-45-6789") == [] and kinds("his SSN: 123-45-6789") == ["ssn"] and kinds("ssn 000-45-6789") == []
    assert pii.find("card 4111111111111111")[0][3] > pii.find("code 4111111111111111")[0][3]
    assert kinds("ssn 123-45-6789@mail.example.com") == ["email"]  # a base span stays, what overlaps it goes


def test_long_texts_take_linear_time():
    for text in ("a" * 2_000_000, "1" * 2_000_000, "@a" * 500_000, "1.1." * 300_000, "+1" + " " * 1_000_000, "a@" + "b" * 1_000_000, "1 " * 600_000):
        t = time.time()
        pii.find(text)
        assert time.time() - t < 5, text[:4]


def test_tables(spark):
    rows = [(1, None, "en"), (2, "", None), (3, "mail a@b.cd now", "en"), (3, "mail a@b.cd now", "en"), (None, "é😀 10.0.0.1", "en"), (4, "x" * 3_000_000 + " +1 (555) 555-3824", "en")]
    df = spark.createDataFrame([(*r, "s", "m") for r in rows], SCHEMA)
    got = pii.find_spans(df, mask=True)
    assert got.columns == ["doc_id", "text", "lang", "spans", "masked"]
    found = {(r.doc_id, tuple((s["kind"], s["start"], s["end"]) for s in r.spans), r.masked if r.doc_id != 4 else r.masked[-9:]) for r in got.collect()}
    assert got.count() == 6
    assert found == {(1, (), None), (2, (), ""), (3, (("email", 5, 11),), "mail <email> now"), (None, (("ip", 3, 11),), "é😀 <ip>"), (4, (("phone", 3_000_001, 3_000_018),), "x <phone>")}
    assert pii.find_spans(df.limit(0)).count() == 0
    assert got.where(F.size("spans") > 0).count() == 4
