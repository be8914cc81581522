"""The training-data operators against brute force, and on odd input."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tendon.llm import chat, exact_dedup, language_id, license_scan, line_dedup, mixing, neighbours, packing, queries, simhash, token_rollup
from tendon.llm.cuckoo import Cuckoo
from tendon.llm.tokens import encode, vocabulary_path

ROOT = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, epoch string, n string, ids string, text_sha256 string"


def docs_of(spark, texts, schema=SCHEMA):
    rows = [(i, t, "en", "src1", len(t or ""), "x", "x", "x", "x", "x", "x") for i, t in texts]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, a very long one, ties, repeated rows, a null id, null columns, clashing names."""
    rng = random.Random(1)
    long = " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(300_000)) + "\nshared line here"
    rows = [(1, None), (2, ""), (3, long), (4, "Shared line HERE \nown line of four"), (4, "Shared line HERE \nown line of four"), (5, "  \t\n"), (None, "no id at all"),
            (6, "shared line here"), (7, "Released under the MIT License."), (8, "été naïve œuvre ß"), (9, "12345 67890")]
    df = docs_of(spark, rows)
    return df.withColumn("lang", F.when(F.col("doc_id") != 6, F.col("lang"))).withColumn("source", F.when(F.col("doc_id") != 7, F.col("source"))).cache()


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{ROOT}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(real):
    return {r.doc_id: r.text or "" for r in real.select("doc_id", "text").collect()}


# Fixed names: queries with SQL.
@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n in queries.ORACLES])
def test_sql(spark, name):
    from oracle_check import compare, duck
    problem, rows, _, _ = compare(spark, duck(ROOT), name, queries.QUERIES[name], queries.ORACLES[name], ROOT)
    assert not problem
    assert rows > 0


def test_every_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))


# 1 license scan

def test_license_edits_and_gaps(spark):
    words = "permission is hereby granted free of charge to any person obtaining a copy of this work under these very terms and no other ones at all".split()
    notice = spark.createDataFrame([(0, "own", " ".join(words)), (1, "short", "four words are few"), (2, "none", None)], "template int, license string, text string")
    changed, cut, far = list(words), words[:14], list(words)
    changed[-1] = "whatsoever"
    far[12:12] = ["x"] * 60
    pad = [f"w{i}" for i in range(97)]
    df = docs_of(spark, [(1, " ".join(pad + words + pad)), (2, " ".join(pad + changed)), (3, " ".join(cut + pad)), (4, " ".join(far)), (5, " ".join(pad))])
    found = {(r.doc_id, r.template): (round(r.containment, 3), r.start_word) for r in license_scan.scan(df, notice).collect()}
    t = len(words) - 4
    assert found == {(1, 0): (1.0, 97), (2, 0): (round((t - 1) / t, 3), 97)}


def test_bands_keep_their_promise():
    for low, high in license_scan.CLASSES:
        n, window = license_scan.bands(low, high), license_scan.window_size(high)
        for size in range(low, high + 1):
            hits = -(-8 * size // 10)
            assert 1 - (1 - hits / (window + size - hits)) ** n >= license_scan.CERTAIN or hits == window == size


def test_license_odd(spark, odd):
    notices = queries.notices(spark)
    found = license_scan.scan(odd, notices).collect()
    assert [(r.doc_id, r.license, r.start_word) for r in found] == [(7, "MIT", 0)]
    assert license_scan.scan(odd.limit(0), notices).count() == 0
    assert license_scan.scan(odd, notices.limit(0)).count() == 0


# 2 mixing

def share(nodes, budget):
    """Water filling by repetition."""
    given, left = {}, dict(nodes)
    while left:
        weight = sum(w for w, _ in left.values())
        full = [k for k, (w, cap) in left.items() if cap * weight <= w * budget]
        if not full:
            return given | {k: w * budget // weight for k, (w, _) in left.items()}
        budget -= sum(left[k][1] for k in full)
        given |= {k: left.pop(k)[1] for k in full}
    return given


def test_mix_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["en", "de", None]), f"src{min(9, int(rng.expovariate(0.4)))}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    weights = spark.createDataFrame([("domain", "even", 3), ("lang", "en", 4), ("source", "src1", 5), ("source", "src4", 0)], "level string, name string, weight long")
    w = defaultdict(lambda: 1, {("even",): 3, ("lang", "en"): 4, ("source", "src1"): 5, ("source", "src4"): 0})
    domain = F.when(F.substring("source", 4, 1).cast("int") % 2 == 0, "even").otherwise("odd")
    got = Counter((r.doc_id, r.epoch) for r in mixing.mix(df, weights, domain, total=F.col("tokens") * 3 // 2 if False else F.floor(F.col("tokens") * 1.5), epochs=3, seed=9).collect())
    leaf = defaultdict(list)
    for i, t, lang, s in rows:
        leaf["even" if int(s[3]) % 2 == 0 else "odd", lang or "", s].append((i, len(t.split())))
    cap = {k: 3 * sum(n for _, n in v) for k, v in leaf.items()}
    total = int(1.5 * sum(cap.values()) / 3)
    name = {0: lambda d: w["even",] if d == "even" else 1, 1: lambda x: w["lang", x], 2: lambda x: w["source", x]}
    def level(prefix, depth, budget):
        kids = sorted({k[depth] for k in leaf if k[:depth] == prefix})
        nodes = {k: (name[depth](k), sum(c for p, c in cap.items() if p[:depth + 1] == (*prefix, k) and all(name[i](x) for i, x in enumerate(p)))) for k in kids}
        nodes = {k: v for k, v in nodes.items() if v[0]}
        return share(nodes, budget)
    want = Counter()
    for d, bd in level((), 0, total).items():
        for lang, bl in level((d,), 1, bd).items():
            for s, b in level((d, lang), 2, bl).items():
                rows_, t = leaf[d, lang, s], cap[d, lang, s] // 3
                whole, rest = divmod(b, t) if t else (0, 0)
                for e in range(whole):
                    want.update((i, e) for i, _ in rows_)
                at = 0
                for i, n in sorted(rows_, key=lambda x: hashlib.md5(f"9:{whole}:{x[0]}".encode()).hexdigest()):
                    at += n
                    if rest and at <= rest:
                        want[i, whole] += 1
    assert got == want


def test_mix_zero_weights_leave_room_for_others(spark):
    """What a zero weight takes from a language goes to its sibling, as its tokens count for no node above."""
    rows = [(i, "w " * 10, "en", "big" if i < 100 else "small") for i in range(105)] + [(i, "w " * 10, "de", "one") for i in range(200, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    weights = spark.createDataFrame([("source", "big", 0)], "level string, name string, weight long")
    got = mixing.mix(docs, weights, F.lit("all"), total=F.lit(1000), epochs=1)
    assert {(r.lang, r.source): r.s for r in got.groupBy("lang", "source").agg(F.sum("tokens").alias("s")).collect()} == {("en", "small"): 50, ("de", "one"): 950}
    none = spark.createDataFrame([("lang", "en", 0)], "level string, name string, weight long")
    assert {r.lang for r in mixing.mix(docs, none, F.lit("all"), epochs=1).collect()} == {"de"}


def test_mix_odd(spark, odd):
    weights = queries.mixture(spark)
    out = mixing.mix(odd, weights, queries.domain_of(), epochs=1)
    assert out.columns.count("epoch") == 1
    assert out.count() <= odd.count() and out.count() > 0
    assert mixing.mix(odd.limit(0), weights, queries.domain_of()).count() == 0


# 3 line dedup

def by_lines(held):
    """Kept text of each document of `held`, by the definition."""
    keys = defaultdict(set)
    split = {i: (t or "").split("\n") for i, t in held.items()}
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    for i, ls in split.items():
        for x in ls:
            keys[key(x)].add(i)
    return {i: "\n".join(x for x in ls if len(key(x)) < 10 or min(keys[key(x)]) == i) for i, ls in split.items()}


def test_lines_inserted_and_deleted_again(spark):
    rng = random.Random(2)
    pool = [f"{'Line' if n % 2 else 'LINE'} number {n % 40} é" + " " * (n % 3) for n in range(80)] + ["short", "", "éééééééééé"]
    held = {i: "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for i in range(120)}
    store = line_dedup.LineStore(spark, shards=4)
    frame = lambda ids: docs_of(spark, [(i, held[i]) for i in ids])

    def check(ids):
        got = {r.doc_id: r.kept_text for r in store.dedup(frame(ids)).collect()}
        assert got == by_lines({i: held[i] for i in ids})

    store.insert(frame(range(40, 80)))
    check(range(40, 80))
    store.insert(frame(range(80, 120)))
    store.insert(frame(range(0, 40)))
    check(range(120))
    store.delete(spark.createDataFrame([(i,) for i in [*range(30), 5000]], "doc_id long"))
    check(range(30, 120))
    store.insert(frame(range(10)))
    check([*range(10), *range(30, 120)])
    counts = store._read(store.counts).groupBy("k1", "k2").agg(F.sum("docs").alias("docs")).where("docs > 0")
    live = store.live().groupBy("k1", "k2").count()
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, live.collect()))
    # no live key is missing from its filter
    assert counts.select("k1", "k2").exceptAll(store.maybe(counts)).isEmpty()
    assert counts.select("k1", "k2").exceptAll(store.maybe(counts, 7)).isEmpty()


def test_many_loads_never_remake_a_filter(spark):
    rng = random.Random(6)
    held, all_ = {}, {i: "\n".join(f"line number {rng.randrange(300)} of some" for _ in range(rng.randint(1, 9))) for i in range(200)}
    store = line_dedup.LineStore(spark, shards=2)
    frame = lambda ids: docs_of(spark, [(i, all_[i]) for i in ids])
    for load in range(10):
        before = [(x.filters, x.bits) for x in store.loads]
        ids = range(20 * load, 20 * load + (20 if load else 1))
        store.insert(frame(ids))
        held |= {i: all_[i] for i in ids}
        assert [(x.filters, x.bits) for x in store.loads[:-1]] == before
        if load in (3, 6):
            gone = rng.sample(sorted(held), 15)
            store.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
            held = {i: t for i, t in held.items() if i not in gone}
    assert {r.doc_id: r.kept_text for r in store.dedup(frame(held)).collect()} == by_lines(held)
    live = store.live().select("k1", "k2").distinct()
    assert live.exceptAll(store.maybe(live)).isEmpty()


def test_cuckoo():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(-2**62, 2**62, 5000))
    c = Cuckoo.of(keys[:3000])
    assert c.might_hold(keys[:3000]).all()
    assert c.might_hold(keys[3000:]).mean() < 0.01
    c.remove(keys[:1500])
    assert c.might_hold(keys[1500:3000]).all() and c.might_hold(keys[:1500]).mean() < 0.01
    before = c.dump()
    assert not c.insert(rng.integers(-2**62, 2**62, 50_000)) and c.dump() == before


def test_lines_odd(spark, odd):
    out = {(r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(odd).collect() if r.doc_id != 3}
    assert {(1, "", 1, 0), (2, "", 1, 0), (4, "own line of four", 2, 1), (6, "", 1, 1), (None, "no id at all", 1, 0)} <= out
    assert line_dedup.dedup_lines(odd).count() == odd.count()
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


# 4 packing

def check_packing(rows, texts_by_id, capacity=1024):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts_by_id)
    for i, parts in by_doc.items():
        ids = np.array([*encode(texts_by_id[i], vocabulary_path()), 0], "<u4")
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert zlib.crc32(ids[at:at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    padding = 0
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding, sum(r.length for r in rows)


def test_packing(spark, real, texts):
    rows = packing.pack(real).collect()
    padding, total = check_packing(rows, texts)
    assert padding < 0.02 * total


def test_packing_keeps_ids(spark, real, texts):
    few = real.where("doc_id < 20")
    packed = packing.pack(few, capacity=256, with_ids=True).cache()
    whole = {r.sequence_id: r.input_ids for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r.sequence_id][r.offset:r.offset + r.length] == r.ids
    assert sum(map(len, whole.values())) == sum(len(encode(texts[i], vocabulary_path())) + 1 for i in range(20))


def test_ids_are_those_of_the_tokenizer_file(texts):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for x in [*list(texts.values())[:40], "a  b\n\n c \t", "<|endoftext|> x", "   y", "tail  ", " \x1c\x1d z", "日本語　　テスト 12³"]:
        assert encode(x, vocabulary_path()) == t.encode(x, add_special_tokens=False).ids


def test_fill_is_the_best_there_is():
    rng = random.Random(4)
    for _ in range(200):
        left = {n: rng.randint(1, 3) for n in rng.sample(range(1, 60), 6)}
        first = rng.randint(1, 60)
        sums = {0}
        for n, c in left.items():
            sums = {s + k * n for s in sums for k in range(c + 1)}
        counts = packing._fill(left, first, 64)
        assert all(counts[k] <= left[k] for k in counts)
        total = first + sum(k * n for k, n in counts.items())
        fits = [first + s for s in sums if first + s <= 64]
        slack = lambda t: 0 if t & (t - 1) == 0 else 64 - t
        assert total in fits and slack(total) == min(map(slack, fits))


def test_packing_odd(spark, odd):
    assert packing.pack(odd.limit(0)).count() == 0
    rows = packing.pack(odd).collect()
    assert sum(r.doc_id == 4 and r.start == 0 for r in rows) == 2
    assert [r.length for r in rows if r.doc_id in (1, 2)] == [1, 1]
    assert sum(r.doc_id is None for r in rows) == 1


# 5 SimHash

def print_of(text, width=3):
    import xxhash
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def reach(fps, bits=2):
    """Smallest id reachable, by breadth."""
    left, out = set(fps), {}
    while left:
        start = min(left)
        group, edge = {start}, [start]
        left.discard(start)
        while edge:
            a = edge.pop()
            near = [b for b in left if (fps[a] ^ fps[b]).bit_count() <= bits]
            left.difference_update(near)
            group.update(near)
            edge += near
        out |= dict.fromkeys(group, start)
    return out


def test_simhash(spark, real, texts):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_dedup(real).collect()}
    fps = {i: print_of(t) for i, t in texts.items()}
    least = reach(fps)
    assert got == {i: (f"{fps[i]:016x}", least[i]) for i in fps}


@pytest.mark.parametrize("crowd", [1, 8, 64])
def test_links_lose_nothing(spark, crowd):
    rng = random.Random(crowd)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    fps = {rng.choice(seeds) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(700)} | {0, 1, (1 << 64) - 1, (1 << 63) + 1}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    links = [(r.u, r.v) for r in simhash.links(df, 2, crowd).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in links)
    parent = {signed(x): signed(x) for x in fps}
    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    want = reach({signed(x): x for x in fps})
    assert {x: root(x) for x in parent} == want
    from tendon.llm.components import components
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(want[x] == got.get(x, x) for x in want)


def test_byte_sets_cover():
    for bits in (1, 2, 3):
        masks = simhash.byte_sets(bits)
        for pick in simhash.combinations(range(8), bits):
            hit = sum(255 << (8 * i) for i in pick)
            assert any(m & hit == 0 for m in masks)


def test_simhash_odd(spark, odd):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_dedup(odd).collect()]
    assert len(got) == odd.count()
    zero = "0" * 16
    assert {(1, zero, 1), (2, zero, 1), (5, zero, 1)} <= set(got) and sum(g[0] == 4 and g[2] == 4 for g in got) == 2
    assert simhash.near_dedup(odd.limit(0)).count() == 0
    kept = sorted(r.doc_id for r in simhash.keep_one(odd.where("doc_id IS NOT NULL"), width=5).collect())
    assert kept == [1, 3, 4, 4, 6, 7, 8, 9]


def test_block_shingles_equal_whole():
    from tendon.llm import words
    text = b"a bb ccc\t dd " * 1000
    old, words.BLOCK = words.BLOCK, 100
    try:
        parts = [x for p in words.shingles(text, 3) for x in p]
    finally:
        words.BLOCK = old
    w = text.split()
    assert parts == [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or len(parts) == len(w) - 2
    assert b"".join(words.blocks(text, 64)) == text


# 6 chat

def test_chat_round_trip(spark):
    rng = random.Random(6)
    bits = ["### ", "###\\ ", ": ", "</turn>", "</turn>\n", "\\", "#", "hi", "\n", " ", "<\\/turn>", "user", "é𝄞"]
    rows = [(c, t, rng.choice(["user", "assistant", "a: b", "### x", None, ""]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 6)))) for c in range(60) for t in range(rng.randint(1, 5))]
    rows += [(100, 0, "user", None), (100, 0, "user", None), (None, 1, "assistant", "lost"), (101, None, "assistant", "x"), (101, 2, "assistant", "y" * 300_000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_chats(df).withColumn("back", chat.parse(F.col("formatted"))).withColumn("under", chat.loss_text(F.col("formatted"), F.col("loss"))).collect()
    want = defaultdict(list)
    for c, t, role, text in rows:
        want[c].append((-1 if t is None else t, role or "", text or ""))
    assert len(out) == len(want)
    for r in out:
        turns = sorted(want[r.conv_id])
        assert [(t.role, t.text) for t in r.back] == [x[1:] for x in turns]
        assert r.under == "".join(x[2] for x in turns if x[1] == "assistant")
        for s in r.loss:
            assert "</turn>" not in r.formatted[s.start - 1:s.start - 1 + s.length]
    assert chat.format_chats(df.limit(0)).count() == 0


# 7 neighbours

def brute(x, ids, asked, count):
    out = {}
    for a in asked:
        s = x @ x[ids == a][0]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != a][:count]
        out[a] = [(int(ids[i]), float(s[i])) for i in order]
    return out


def test_neighbours_recall_and_copies(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 16)).astype(np.float32) * rng.uniform(0.2, 3, (900, 1)).astype(np.float32)
    x[300:600] = x[7]  # a third of all rows are one vector
    ids = np.arange(900) * 7 % 1009
    odd = [(5000, None, 0), (5020, [0.0] * 16, 0), (5040, [float("nan")] * 16, 0), (5060, [1.0, None] + [0.0] * 14, 0), (5080, [1.0] * 3, 0), (None, [1.0] * 16, 0), (5100, [], 0), (5120, [float("inf")] * 16, 0)]
    df = spark.createDataFrame([(int(i), [float(v) for v in r], 1) for i, r in zip(ids, x)] + odd, "vec_id long, embedding array<float>, score int").repartition(5)
    got = defaultdict(list)
    for r in neighbours.nearest(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    want = brute(x.astype(float), ids, [int(i) for i in ids if i % 20 == 0], 20)
    assert set(got) == set(want)
    hits = [len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.9
    for q in want:
        assert len(got[q]) == 20 and q not in dict(got[q])
        assert got[q] == sorted(got[q], key=lambda p: (-p[1], p[0]))
        at = {int(i): n for n, i in enumerate(ids)}
        assert np.allclose([s for _, s in got[q]], [x[at[a]].astype(float) @ x[at[q]].astype(float) for a, _ in got[q]], atol=1e-12)


def test_neighbours_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    rows = [tuple(r) for r in neighbours.nearest(df, df.where("vec_id % 20 = 0")).orderBy("rank").collect()]
    assert rows == [(0, 1, 2, 1.0), (0, 2, 1, 0.5)]
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0
    assert neighbours.nearest(df, df.where("vec_id = 9")).count() == 0


def test_probe_order_and_reach():
    sets = neighbours.probe_sets(4, 10_000)
    assert len({tuple(r) for r in sets}) == len(sets) == 3 ** 4
    h = neighbours.Hashes.draw(8, 4, 1.0)
    x = h.points(np.random.default_rng(1).normal(size=(50, 8)) / 9)
    for t in range(2):
        assert (h.visits(x, t, sets[:1])[:, 0] == h.codes(x, t)).all()


# 8 language

def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = queries.QUERIES["op8_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 150
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    for r in rows:
        assert zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and 0 <= r.score <= 1


def test_features_equal_a_plain_convolution():
    rng = np.random.default_rng(2)
    net = language_id.train([b"abcabc abc", b"xyzxyz xyz"] * 8, ["a", "x"] * 8, epochs=2)
    x = rng.integers(0, 256, (5, 40)).astype(np.uint8)
    got = net.features(x, net.tables())
    for i, (w, f) in enumerate(zip(language_id.WIDTHS, net.filters)):
        plain = np.array([[[sum(f[j][row[t + j]] for j in range(w))[c] for t in range(40 - w + 1)] for c in range(language_id.FILTERS)] for row in x]).max(2)
        part = slice(i * language_id.FILTERS, (i + 1) * language_id.FILTERS)
        assert np.allclose(got[:, part], np.maximum(plain + net.bias[part], 0), atol=1e-4)


def test_language_odd(spark, odd):
    net = language_id.train([b"the cat and the dog"] * 8 + [b"der hund und die katze"] * 8, ["en"] * 8 + ["de"] * 8)
    out = [(r.doc_id, r.lang_pred, r.score) for r in language_id.predict(odd, net).collect()]
    assert len(out) == odd.count()
    assert {(1, "und", 0.0), (2, "und", 0.0), (5, "und", 0.0), (9, "und", 0.0)} <= set(out)
    assert all(lang in ("en", "de") for i, lang, _ in out if i in (3, 4, 6, 7, 8))
    assert language_id.fit(odd.limit(0)) is None
    assert {r.lang_pred for r in language_id.predict(odd, None).collect()} == {"und"}
    assert language_id.predict(odd.limit(0), net).count() == 0


def test_language_sample_is_bounded(spark, monkeypatch):
    """Null ids, one id repeated and one row repeated cannot make the sample large, nor leave a language out."""
    rows = [(None, f"words number {i} here") for i in range(2000)] + [(7, f"zahl nummer {i} dort") for i in range(2000)] + [(8, "the same row again")] * 2000
    rows = [({7: 1, 8: 3}.get(i), t, {7: "de", 8: "fr"}.get(i, "en")) for i, t in rows]  # ids that are not held out
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(language_id, "train", lambda texts, labels: seen.append((texts, labels)))
    language_id.fit(docs, per_language=50)
    labels = seen[0][1]
    assert Counter(labels) == {"en": 50, "de": 50, "fr": 1}
    assert len(set(seen[0][0])) == len(labels)


# 9 exact dedup

def test_exact_odd(spark, odd):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(odd).collect() if r.doc_id != 3)
    assert got == [(-1, None, 1, True), (1, 1, 2, True), (2, 1, 2, False), (4, 4, 2, True), (4, 4, 2, True), (5, 5, 1, True), (6, 6, 1, True), (7, 7, 1, True), (8, 8, 1, True), (9, 9, 1, True)]
    assert exact_dedup.exact_dedup(odd.limit(0)).count() == 0
    assert exact_dedup.exact_dedup(odd).columns.count("kept") == 1


def test_a_full_filter_changes_nothing(spark, real):
    pick = ["doc_id", "keep_id", "group_size", "kept"]
    a = sorted(map(tuple, exact_dedup.exact_dedup(real).select(*pick).collect()))
    b = sorted(map(tuple, exact_dedup.exact_dedup(real, max_bits=1).select(*pick).collect()))
    assert a == b and any(not r[3] for r in a)


def test_the_filter_lets_few_single_rows_through(spark):
    df = spark.range(40_000).select(F.xxhash64("id").alias("__hash"))
    found, blocks = exact_dedup.repeated_filter(df, 40_000, 16, 2, 1 << 29)
    held = df.withColumn("__block", F.pmod("__hash", F.lit(blocks))).withColumn("__spots", exact_dedup._spots(2)).join(found, "__block", "left")
    assert held.where(" AND ".join(exact_dedup._test(i) for i in range(2))).count() < 0.03 * 40_000


# 10 token counts

def test_rollup_of_documents(spark, real, texts):
    got = {(r.source, r.lang): (r.docs, r.tokens) for r in token_rollup.count_documents(real).collect()}
    want = defaultdict(lambda: [0, 0])
    for r in real.collect():
        want[r.source, r.lang][0] += 1
        want[r.source, r.lang][1] += len(encode(texts[r.doc_id], vocabulary_path()))
    assert got == {k: tuple(v) for k, v in want.items()}


def test_rollup_batches(spark):
    def rows(*xs):
        return spark.createDataFrame([(s, la, "v1", n) for s, la, n in xs], "source string, lang string, tokenizer string, tokens long")

    def totals(r):
        return {(x.source, x.lang): (x.docs, x.tokens) for x in r.totals().collect()}

    r = token_rollup.TokenRollup(spark)
    assert totals(r) == {}
    assert r.commit("a", token_rollup.inserts(rows(("s", "en", 5), ("s", "en", 7), (None, None, 2))))
    assert not r.commit("a", token_rollup.inserts(rows(("s", "en", 1000))))
    assert totals(r) == {("s", "en"): (2, 12), (None, None): (1, 2)}
    assert r.commit("b", token_rollup.deletes(rows(("s", "en", 5))))
    r.compact()
    kind = "struct<source:string,lang:string,tokenizer:string,tokens:bigint>"
    pairs = spark.createDataFrame([(("s", "en", "v1", 7), ("s", "de", "v1", 9)), (None, ("t", "en", "v1", 3)), ((None, None, "v1", 2), None)], f"old {kind}, new {kind}")
    assert r.commit("c", token_rollup.revisions(pairs)) and not r.commit("b", token_rollup.deletes(rows(("s", "en", 5))))
    assert totals(r) == {("s", "de"): (1, 9), ("t", "en"): (1, 3)}
    broken = token_rollup.TokenRollup(spark, r.path)  # a batch that broke off has no mark
    import os
    os.remove(f"{r.path}/batches/c/_SUCCESS")
    assert "c" not in broken.batches() and broken.commit("c", token_rollup.revisions(pairs))
    assert totals(broken) == {("s", "de"): (1, 9), ("t", "en"): (1, 3)}


def test_rollup_odd(spark, odd):
    got = {(r.source, r.lang): r.docs for r in token_rollup.count_documents(odd).collect()}
    assert got == Counter((r.source, r.lang) for r in odd.select("source", "lang").collect())
    assert token_rollup.count_documents(odd.limit(0)).count() == 0
