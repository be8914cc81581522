"""The near-duplicate stage against brute-force Jaccard on planted near copies."""

from __future__ import annotations

import random
from itertools import combinations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, width=5):
    w = (text or "").lower().split()
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def least_of(held):
    """Smallest id that each document reaches over pairs at 0.8 or more."""
    sets, root = {i: shingles(t) for i, t in held.items()}, {i: i for i in held}
    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    linked = 0
    for i, j in combinations(sorted(held), 2):
        a, b = sets[i], sets[j]
        if len(a & b) * 10 >= 8 * len(a | b):
            linked += 1
            i, j = sorted((top(i), top(j)))
            root[j] = i
    return {i: top(i) for i in held}, linked


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    for _ in range(60):
        base = [word() for _ in range(300)]
        texts.append(" ".join(base))
        for changed in (1, 2, 3, 5, 6, 9, 15):
            copy = list(base)
            for at in rng.sample(range(300), changed):
                copy[at] = word()
            texts.append(" ".join(copy))
    base = [word() for _ in range(120)]  # many near copies of one text, and many texts round one passage
    for _ in range(60):
        copy = list(base)
        copy[rng.randrange(120)] = word()
        texts.append(" ".join(copy))
        texts.append(" ".join(base[:60] + [word() for _ in range(40)]))
    texts += ["", None, " \t", "Two words", "two  WORDS", "other two words"]
    rng.shuffle(texts)
    return dict(enumerate(texts))


def test_stage_finds_near_copies(spark, planted):
    import corpus_pipeline
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in planted.items()], SCHEMA).repartition(6)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    want, linked = least_of(planted)
    assert linked > 300
    assert kept == sorted(set(want.values()))
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize("crowd", [2, 16])
def test_crowded_buckets_lose_nothing(spark, planted, crowd):
    from tendon.llm import near_copies
    few = {i: t for i, t in planted.items() if i % 2}
    docs = spark.createDataFrame([(i, t, "en", "src1", 0) for i, t in few.items()], SCHEMA)
    got = {r.doc_id: r.component_id for r in near_copies.groups(docs, crowd=crowd).collect()}
    assert got == least_of(few)[0]


def test_fingerprints_of_op5_find_candidates(spark, planted, monkeypatch):
    """Without any band, the pairs within two bits are found and verified."""
    from tendon.llm import near_copies
    from tendon.llm.simhash import fingerprint
    monkeypatch.setattr(near_copies, "_open", lambda batches: (b.select(["key", "n", "fp"]).slice(0, 0) for b in batches))
    prints = {i: fingerprint((t or "").encode(), 5, 42) for i, t in planted.items()}
    sets, root = {i: shingles(t) for i, t in planted.items()}, {i: i for i in planted}
    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    linked = 0
    for i, j in combinations(sorted(planted), 2):
        both = len(sets[i] & sets[j])
        if sets[i] == sets[j] or (prints[i] ^ prints[j]).bit_count() <= 2 and both * 10 >= 8 * len(sets[i] | sets[j]):
            linked += sets[i] != sets[j]
            i, j = sorted((top(i), top(j)))
            root[j] = i
    docs = spark.createDataFrame([(i, t, "en", "src1", 0) for i, t in planted.items()], SCHEMA)
    got = {r.doc_id: r.component_id for r in near_copies.groups(docs).collect()}
    assert linked > 10
    assert got == {i: top(i) for i in planted}
