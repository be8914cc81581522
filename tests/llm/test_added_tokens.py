"""Ids of texts that hold an added token of the JSON file, against `tokenizers` at its default settings."""

from __future__ import annotations

import zlib

import numpy as np

TEXTS = ["a b <|endoftext|> c", "<|endoftext|>", "<|endoftext|><|endoftext|>  x", "a  \n<|endoftext|>\n\n b", "<|endoftext|", "é<|endoftext|>日本語", "<|ENDOFTEXT|> it's", "plain  text ", ""]


def wanted():
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [t.encode(x, add_special_tokens=False).ids for x in TEXTS]


def test_ids():
    from tendon.llm.tokens import ids_of, vocabulary_path
    assert [ids_of(x, vocabulary_path()) for x in TEXTS] == wanted()
    assert wanted()[0] == [64, 275, 220, 50256, 269]


def test_windows_and_counts(spark):
    from tendon.llm import packing, token_rollup
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.start, r.doc_tokens, r.ids_crc32) for r in packing.pack(docs).collect()}
    assert got == {i: (0, len(x) + 1, zlib.crc32(np.array([*x, 0], "<u4").tobytes())) for i, x in enumerate(wanted())}
    assert [r.tokens for r in token_rollup.count_documents(docs).collect()] == [sum(map(len, wanted()))]
