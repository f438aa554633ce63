"""BPE against the tokenizers library."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from voxloom.llm import bpe
from voxloom.llm.queries import op10_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    with open(PATH, "rb") as f:
        return bpe.load(f.read()), Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="abcdefghilmnorstu' <|>endoftext1Σσİéß", max_size=80)))
def test_equals_the_library(both, text):
    mine, library = both
    ids = library.encode(text, add_special_tokens=False).ids
    assert mine.encode(text) == ids
    assert mine.decode(np.array(ids, dtype=np.int64)).decode() == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", " ", "a" * 30_000, "ab" * 9_000, "x<|endoftext|>y<|startoftext|>", "<|ENDOFTEXT|>", "it's I'LL", "\U00016ea0 ꟎ ࢏"])
def test_odd_texts(both, text):
    assert both[0].encode(text) == both[1].encode(text, add_special_tokens=False).ids


def test_every_vocabulary_entry(both):
    mine, library = both
    texts = [x.removesuffix("</w>") for x in mine.vocab]
    for text, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert mine.encode(text) == e.ids


def test_query(spark, sf, both):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = op10_bpe(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = both[1].encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(" ".join(map(str, ids))))
        assert r.decoded_sha256 == sha(both[1].decode(ids, skip_special_tokens=False))


def test_nulls_repeats_extra_columns_and_empty_table(spark):
    schema = "doc_id long, text string, token_ids string"
    rows = [(1, None, "x"), (1, None, "x"), (None, "hello", "y"), (2, "", "z"), (3, "  \n", None)]
    got = bpe.encode(spark.createDataFrame(rows, schema), PATH).collect()
    assert sorted((r.doc_id or 0, len(r.token_ids)) for r in got) == [(0, 1), (1, 0), (1, 0), (2, 0), (3, 0)]
    assert bpe.encode(spark.createDataFrame([], schema), PATH).count() == 0
    back = bpe.decode(spark.createDataFrame([(1, None), (2, []), (3, [49407])], "doc_id long, token_ids array<int>"), PATH)
    assert {r.doc_id: r.decoded for r in back.collect()} == {1: "", 2: "", 3: "<|endoftext|>"}
    with pytest.raises(ValueError):
        bpe.encode(spark.createDataFrame(rows, schema), PATH, keep=("token_ids",))


def test_decode_leaves_out_what_is_no_id(spark, both):
    rows = [(1, [320, 999_999, 321]), (2, [-1, 320, None]), (3, []), (4, None), (5, [None, 49_408]), (1, [320, 999_999, 321])]
    got = bpe.decode(spark.createDataFrame(rows, "doc_id long, token_ids array<int>"), PATH).collect()
    known = lambda ids: [i for i in ids or [] if i is not None and i >= 0]
    assert sorted((r.doc_id, r.decoded) for r in got) == sorted((i, both[1].decode(known(ids), skip_special_tokens=False)) for i, ids in rows)
