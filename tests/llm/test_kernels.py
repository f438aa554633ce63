"""Kernels against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from voxloom.llm import kernels as K

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbÉ \t\n\x0b\x85 ", max_size=30)), max_size=8))
def test_words_are_those_of_the_pattern(texts):
    known = {}
    for i, j, h, at in K.doc_words(pa.array(texts, type=pa.string())):
        for k in range(i, j):
            words = WORD.findall(lower(texts[k] or ""))
            got = h[at[k - i] : at[k - i + 1]]
            assert len(got) == len(words)
            for word, value in zip(words, got.tolist()):
                assert known.setdefault(word, value) == value
    assert len(set(known.values())) == len(known)


def test_long_texts_are_hashed_piece_by_piece():
    text = "word " * 400_000 + "x" * 3_000_000 + " end"
    (run,) = K.doc_words(pa.array([text]))
    assert len(run[2]) == 400_002
    assert run[2][-1] == K.words_of(np.frombuffer(b"end", dtype=np.uint8))[0]


def test_sketch_fills_every_coordinate_and_estimates_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for n in (1, 2, 5, 40, 500):
        a = rng.integers(0, 2**62, n).astype(np.uint64)
        b = np.concatenate([a[: n - n // 5], rng.integers(0, 2**62, n // 5).astype(np.uint64)])
        one, two = K.similarity_sketch([np.unique(a), np.unique(b)], 120)
        assert (one != np.iinfo(np.uint64).max).all()
        both = K.overlap(np.unique(a), np.unique(b))
        errors.append((one == two).mean() - both / (2 * n - both))
    assert max(map(abs, errors)) < 0.15
