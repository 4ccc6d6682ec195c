import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quernel.llm.bpe import bpe_encode, codec_for
from quernel.llm.queries import TOKENIZERS

PATH = f"{TOKENIZERS}/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def pair():
    with open(PATH, "rb") as f:
        return codec_for(f.read()), Tokenizer.from_file(PATH)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_equal_to_the_library(pair, text):
    codec, library = pair
    ids = library.encode(text, add_special_tokens=False).ids
    assert codec.encode(text) == ids
    assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_cache_is_bounded(pair):
    with open(PATH, "rb") as f:
        small = type(pair[0])(f.read(), cached=3)
    text = "many different words in one text so the cache is emptied often " * 3
    assert small.encode(text) == pair[0].encode(text) and len(small.known) <= 3


def test_rows_and_edges(pair, odd_docs, odd_rows, no_docs):
    got = bpe_encode(odd_docs, PATH)
    assert {"size", "key", "ids"} <= set(got.columns)
    want = []
    for r in odd_rows:
        ids = pair[1].encode(r[1] or "", add_special_tokens=False).ids
        packed = np.array(ids, "<u4").tobytes()
        want.append((r[0], len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(pair[1].decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    rows = got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert bpe_encode(no_docs, PATH).count() == 0
