from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstead.llm import packing
from loomstead.llm.queries import token_file


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_file())


def test_fast_encoder_gives_the_librarys_ids(tokenizer, texts):
    encode = packing.Encoder(token_file(), 1)
    assert encode.fast is not None and encode.width == "<u2"
    odd = ["", " ", "  a", "a \n b", "a\t b  c", "\n\n x", "x \n", "<|endoftext|> hi", "   b  c", "é 中文 字 😀", "it's  we'll 'S", "\u00a0 \u2003x y", "1234 ５６ ²", "\x00\x7f", "a" * 5000]
    for text in [*odd, *(r[1] or "" for r in texts)]:
        assert np.frombuffer(encode([text])[0], "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_special_tokens_have_their_own_ids(tokenizer):
    encode = packing.Encoder(token_file(), 1)
    for text in ["hello <|endoftext|> world", "<|endoftext|>", "<|endoftext|><|endoftext|>\n", "a <|endoftext|"]:
        assert np.frombuffer(encode([text])[0], "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encode(["hello <|endoftext|> world"])[0], "<u2").tolist() == [31373, 220, 50256, 995]


@pytest.mark.parametrize("char", [" ", "a", "1", "#", "\n", "\u3000", "é", "\u00a0"])
def test_very_long_runs(tokenizer, char):
    encode = packing.Encoder(token_file(), 1)
    for text in (f"some words {char * 100_000} and more", "x" + char * 4095 + "y"):
        assert np.frombuffer(encode([text])[0], "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert packing.has_long_run(char * 4096) and not packing.has_long_run("some words of a text " * 1000)
    assert len(encode([char * 1_000_000])[0]) > 0


def test_other_tokenizers_go_through_the_library():
    encode = packing.Encoder(token_file("word_bpe_49k.json"), 1)
    assert encode.fast is None
    assert np.frombuffer(encode(["Some words"])[0], encode.width).tolist() == encode.tokenizer.encode("Some words", add_special_tokens=False).ids


@pytest.mark.parametrize("window", [16, 2048])
def test_pieces_tile_the_documents_and_the_windows(docs, texts, tokenizer, window):
    rows = packing.pack(docs.withColumn("ids", F.lit(0)).withColumn("part", F.lit(0)), token_file(), window).collect()
    want = defaultdict(int)
    for r in texts:
        want[r[0], tuple(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1])] += 1
    by_place = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    found, ids, at = defaultdict(int), [], 0
    for r in by_place:
        own = np.frombuffer(r.ids, "<u4")
        assert r.sequence_id * window + r.offset == at and len(own) == r.length <= window - r.offset
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.start == len(ids)
        at += r.length
        ids += own.tolist()
        if len(ids) == r.doc_tokens:
            found[r.doc_id, tuple(ids)] += 1
            ids = []
    assert not ids and found == want
    full = [n for n in np.bincount([r.sequence_id for r in rows], [r.length for r in rows])]
    assert all(n == window for n in full[:-1])


def test_sequences_are_padded_unless_a_power_of_two(spark):
    docs = spark.createDataFrame([(i, "word " * 40) for i in range(3)], "doc_id long, text string")
    pieces = packing.pack(docs, token_file(), 64)
    out = {r.sequence_id: r for r in packing.sequences(pieces, 64).collect()}
    total = sum(r.n_tokens for r in out.values())
    assert total == pieces.agg(F.sum("length")).first()[0]
    for r in out.values():
        n = len(r.ids) // 4
        assert n == r.n_tokens + r.n_padded and (n == 64 or (r.n_padded == 0 and n & (n - 1) == 0))


def test_empty_table(no_docs):
    assert packing.pack(no_docs, token_file()).collect() == []


def test_digest_without_ids(docs):
    assert packing.pack(docs, token_file(), keep_ids=False).where("ids IS NOT NULL").count() == 0
