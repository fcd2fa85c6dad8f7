"""Cutting and encoding whole Arrow columns against the tokenizer libraries, text by text."""

import tracemalloc

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from tactus.llm import bpe, chunks, tokenstore

MULTI = P.path("byte_bpe_multi_50k.tiktoken")
SIGNS = " \n\t\x1c  　\u0085aéß.,'09$<|>endoftx日\U0001f642"


@pytest.fixture(scope="module")
def both():
    ranks = bpe.ranks_of(MULTI)
    own = tokenstore.Tokens(P.path("byte_bpe_50k.json"))
    return own, Tokenizer.from_file(P.path("byte_bpe_50k.json")), bpe.Bpe(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet=SIGNS, max_size=30), st.sampled_from(["", "a <|endoftext|> b", "<|endoftext|>", " <|endoftext|> <|endoftext|>\n"])), max_size=5))
def test_columns_of_texts(both, texts):
    own, library, tree, other = both
    column = pa.array(["before", *texts, "after"], pa.string()).slice(1, len(texts))
    if texts:
        ids, bounds = own.ids(column)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [[*library.encode(x, add_special_tokens=False).ids, 2] for x in texts]
    assert [x.tolist() for x in tree.encode_all(column)] == [other.encode_ordinary(x) for x in texts]


def test_added_token_is_one(both):
    ids, _ = both[0].ids(pa.array(["a <|endoftext|> b"]))
    assert ids.tolist() == [64, 220, 50256, 275, 2]


def test_a_stop_behind_letters_is_not_remembered(both):
    """A word is encoded and remembered once, whatever stop ends it."""
    texts = ["x moron. moron, moron! moron", "x moron; it's. a1. é. .. ,a. a b", "x it'. don't. . , A.B. U.S."]
    own, tree = tokenstore.Tokens(P.path("byte_bpe_50k.json")), bpe.Bpe(both[2].ranks, P.PATTERN)
    ids, bounds = own.ids(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [[*both[1].encode(x, add_special_tokens=False).ids, 2] for x in texts]
    assert [x.tolist() for x in tree.encode_all(texts)] == [both[3].encode_ordinary(x) for x in texts]
    for chunks_ in (own.chunks, tree.chunks):
        assert "moron" in chunks_.known and not any(w[:-1] == "moron" for w in chunks_.known)


def test_signs_and_line_breaks_are_not_remembered(both):
    """A word is encoded once, whatever signs or line break follow it, with letters beyond ASCII too."""
    texts = ["x moron&&& moron.%%% moron.\nVoilà", "x voilà. voilà, voilà\nmoron's", "Voilà!\nmoron.\n\nmoron \n a× ×a ÷. \u0283."]
    own, asked = tokenstore.Tokens(P.path("byte_bpe_50k.json")), []
    plain = own.chunks.encode_many
    own.chunks.encode_many = lambda chunks: asked.extend(chunks) or plain(chunks)
    ids, bounds = own.ids(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [[*both[1].encode(x, add_special_tokens=False).ids, 2] for x in texts]
    assert sorted(c for c in asked if "moron" in c) == [" moron", ".\n\nmoron", "moron"]
    assert sorted(c for c in asked if "oil" in c) == [" voilà", "Voilà"]


CUT_SIGNS = SIGNS + "\r\x0b\x00\u1680\u180e\u2009\u200b\u2028\u205f\u3001’”ÀĀ×÷ɐˇ\u0301ª٣²Ж"


@settings(max_examples=500, deadline=None)
@given(st.lists(st.text(alphabet=CUT_SIGNS, max_size=20), max_size=5))
def test_no_piece_crosses_a_cut(texts):
    """The pre-tokenizer finds in the chunks what it finds in the texts, also where no token of the vocabulary tells."""
    cut = ByteLevel(add_prefix_space=False, use_regex=True)
    found, bounds = chunks._pieces(pa.array(["a ", *texts, "b"], pa.string()).slice(1, len(texts)))
    assert len(bounds) == len(texts) + 1
    for text, a, b in zip(texts, bounds, bounds[1:]):
        assert "".join(found[a:b].to_pylist()) == text
        assert [x for c in found[a:b].to_pylist() for x, _ in cut.pre_tokenize_str(c)] == [x for x, _ in cut.pre_tokenize_str(text)]


def test_packed_bytes():
    """The bytes of the format: lengths less one in pairs of bits, low bits first, and the values' low bytes first."""
    assert tokenstore.pack(np.array([5, 0x102, 0x30201, 0x4030201, 255], "<u4")) == (b"\xe4\x00", b"\x05\x02\x01\x01\x02\x03\x01\x02\x03\x04\xff")
    assert tokenstore.pack(np.array([], "<u4")) == (b"", b"")


def test_megabytes(both, monkeypatch):
    monkeypatch.setattr(chunks, "GROUP_BYTES", 1 << 16)
    texts = ["word " * 300_000, "x" * 200_000, "", "the cat  sat\n\n on é " * 20_000]
    for got, text in zip(both[2].encode_all(texts), texts):
        assert np.array_equal(got, both[3].encode_ordinary(text))
    for got, text in zip(both[0].chunks.texts(pa.array(texts)), texts):
        assert got.tolist() == both[1].encode(text, add_special_tokens=False).ids


def test_memory_of_many_texts(both):
    """What the encoder holds for a moment depends on its groups, not on the size of an Arrow batch."""
    text = "the cat sat on it " * 120
    texts, expected = pa.array([text] * 4000), both[3].encode_ordinary(text)
    next(both[2].encode_all([text]))
    tracemalloc.start()
    try:
        for n, ids in enumerate(both[2].encode_all(texts)):
            assert n % 500 or ids.tolist() == expected
        assert n == 3999 and tracemalloc.get_traced_memory()[1] < 60e6
    finally:
        tracemalloc.stop()


def test_words_and_joins_are_held_once(both):
    """A chunk of one piece is remembered as a chunk only, and a join that changes nothing is its own key."""
    tree = bpe.Bpe(both[2].ranks, P.PATTERN)
    texts = ["a qzxlorvik wertzuiopq (plugh) x9y", "\u00e9 \u65e5\u672c qqqqqqqqqqxx"]
    assert [x.tolist() for x in tree.encode_all(texts)] == [both[3].encode_ordinary(x) for x in texts]
    assert "qzxlorvik" in tree.chunks.known and " qzxlorvik" not in tree.done
    same = [got is key for key, got in tree.joins.items() if got == key]
    assert same and all(same)
