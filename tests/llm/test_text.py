from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa

from loomstead.llm._text import mix64, shingle_set, span_hashes, utf8_arrays, window_hashes, word_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def raw(text):
    return np.frombuffer(text.encode(), dtype=np.uint8)


def test_word_spans_are_those_of_the_pattern():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(" \t\n\r\x0b\x0cabcé字  ") for _ in range(rng.randrange(30)))
        starts, ends = word_spans(raw(text))
        data = text.encode()
        assert [data[a:b].decode() for a, b in zip(starts, ends, strict=True)] == WORD.findall(text)


def test_equal_words_have_equal_hashes_anywhere():
    text = "one two one twoone one " * 50
    buf = raw(text)
    starts, ends = word_spans(buf)
    hashes = span_hashes(buf, starts, ends)
    words = text.split()
    seen = {}
    for w, h in zip(words, hashes, strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(hashes.tolist())) == len(set(words))


def test_windows_depend_on_order():
    w = mix64(np.arange(1, 7, dtype=np.uint64))
    assert len(set(window_hashes(w, 5).tolist())) == 2
    assert window_hashes(w[[0, 1, 2, 3, 4]], 5)[0] != window_hashes(w[[1, 0, 2, 3, 4]], 5)[0]
    assert len(window_hashes(w, 7)) == 0


def test_shingle_sets_are_as_large_as_those_of_strings():
    rng = random.Random(2)
    for _ in range(200):
        words = [rng.choice(["a", "B", "b", "cé", "dd"]) for _ in range(rng.randrange(40))]
        low = [w.replace("B", "b") for w in words]
        want = {tuple(low[i : i + 5]) for i in range(len(low) - 4)} if len(low) >= 5 else ({tuple(low)} if low else set())
        assert len(shingle_set(raw(" ".join(words)))) == len(want)
    assert len(shingle_set(None)) == len(shingle_set(raw(""))) == len(shingle_set(raw(" \n"))) == 0
    assert shingle_set(raw("a b"))[0] != shingle_set(raw("b a"))[0]


def test_arrow_texts_with_nulls_and_slices():
    column = pa.array(["x", None, "", "yé"])
    assert [None if b is None else bytes(b) for b in utf8_arrays(column)] == [b"x", None, b"", "yé".encode()]
    assert [None if b is None else bytes(b) for b in utf8_arrays(column.slice(1, 3))] == [None, b"", "yé".encode()]
    assert list(utf8_arrays(pa.array([], pa.string()))) == []
