"""The codec against the tokenizers library, and its tree join against direct encoding."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.conftest import edge_rows, frame
from tokenizers import Tokenizer

from tracefuse.llm import bpe
from tracefuse.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def pair():
    return bpe.BpeCodec(tokenizer_path(), long_piece=8, leaf=5, window=3), Tokenizer.from_file(tokenizer_path())


def check(codec, lib, text):
    want = lib.encode(text, add_special_tokens=False).ids
    ids = codec.encode(text)
    assert ids.tolist() == want
    assert codec.decode(ids) == lib.decode(want, skip_special_tokens=False)


def test_special_and_odd_texts(pair):
    for t in ["", "<|endoftext|>", " <|startoftext|>a<|endoftext|>\n", "İSTANBUL ǅ ß Σας ΟΔΟΣ", " a\x1cb\x85c d　e",
              "é ́x", "don't I'LL they've", "<|endoftext|", "中" * 300, "a" * 1000, "\U0001f600" * 40, "x\x00y"]:
        check(*pair, t)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(pair, text):
    check(*pair, text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="thein", min_size=9, max_size=200))
def test_long_pieces(pair, text):
    check(*pair, text)


def test_tree_join_with_the_shipped_sizes():
    codec, lib = bpe.BpeCodec(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    rnd = random.Random(4)
    for n in (257, 300, 1000, 20000):
        for letters in ("ab", "tionthe", "a", "é中a", "!?.", "ing"):
            check(codec, lib, "".join(rnd.choice(letters) for _ in range(n)) + " end")


def test_documents(lspark):
    lib, rows = Tokenizer.from_file(tokenizer_path()), edge_rows()
    for clash in (False, True):
        got = bpe.encode_documents(frame(lspark, rows, clash), tokenizer_path()).collect()
        want = []
        for r in rows:
            ids = lib.encode(r[1] or "", add_special_tokens=False).ids
            want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                         hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest(), ids))
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert bpe.encode_documents(frame(lspark, []).limit(0), tokenizer_path()).count() == 0
