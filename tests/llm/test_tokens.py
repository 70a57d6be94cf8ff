"""BPE by tree concatenation, and Simple-8b output."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.conftest import SF_SMALL
from tokenizers import Tokenizer

from fuelspark.llm import bpe, token_output
from fuelspark.llm.queries import QUERIES

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
CODER, PLAIN, WORD_PLAIN = bpe.coder(BYTES), Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)


def plain(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("aab1 '\n\t!é日😀st"), max_size=200), st.sampled_from([1, 2, 3, 7, 20]))
def test_any_cut_gives_the_whole_texts_tokens(text, leaf):
    ids = CODER.encode(text, leaf)
    assert ids == plain(text) and CODER.decode(ids) == text


@pytest.mark.parametrize("alphabet", ["abcdefghij", "0123456789", " ", "!?.,", "a", "日本語", "é"])
def test_long_unsplit_text(alphabet):
    random.seed(1)
    text = "x" + "".join(random.choice(alphabet) for _ in range(20_000)) + "y z"
    assert CODER.encode(text, 512) == plain(text)


def test_special_literal_over_a_cut():
    text = "a<|endoftext|>b " * 50
    for leaf in (1, 5, 16):
        assert CODER.encode(text, leaf) == plain(text)


def _digests(text):
    ids = plain(text)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("spread", [bpe.SPREAD_CHARS, 50])
def test_encode_awkward(awkward, spread):
    got = sorted(map(tuple, bpe.encode(awkward, BYTES, with_ids=False, spread_chars=spread).collect()), key=str)
    want = sorted([(r.doc_id, *_digests(r.text)) for r in awkward.collect()], key=str)
    assert got == want


def test_decode_awkward(awkward):
    ids = bpe.encode(awkward, BYTES).select("doc_id", "ids")
    got = sorted([(r.doc_id, r.text) for r in bpe.decode(ids, BYTES).collect()], key=str)
    assert got == sorted([(r.doc_id, r.text or "") for r in awkward.collect()], key=str)


def test_bpe_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    for r in QUERIES["op7_bpe"](spark, SF_SMALL).collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == _digests(docs[r.doc_id])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=300), st.integers(0, 300), st.integers(0, 300))
def test_simple8b_round_trip(ids, a, b):
    words, offsets, escapes = token_output.pack(np.array(ids, np.uint64))
    assert token_output.unpack(words, len(ids), escapes).tolist() == ids
    assert token_output.unpack_range(words, offsets, len(ids), escapes, a, b).tolist() == ids[a:b]


def test_simple8b_range_over_sub_blocks():
    ids = np.random.default_rng(0).integers(0, 1 << 62, 9_000, dtype=np.uint64)
    words, offsets, escapes = token_output.pack(ids)
    assert len(offsets) > 3
    assert (token_output.unpack_range(words, offsets, len(ids), escapes, 4_000, 8_500) == ids[4_000:8_500]).all()


@pytest.mark.parametrize("text", ["a.b,c Ünï.", "it's don't, we'LL.", ",, a.. .", "x̸ ≠ á. é,", "ΑΣ ΟΔΟΣ. Σ,", "日本語、テスト。 12.5", "tab\there \r\n\x0b\x1cx\x85y z", "<|endoftext|> x", "ſ ﬁ İi ẞ ªº", "Word%%% x&&&, (a) b) c]] d' e'. f\"'s it's. a.'s ñ!!! µ**"])
def test_pieces_encode_as_the_whole(text):
    got = np.frombuffer(token_output._piece_encoder(WORDS)([text], 1)[0], "<u4").tolist()
    assert got == [*WORD_PLAIN.encode(text, add_special_tokens=False).ids, 1]


def test_every_token_encodes_to_itself():
    """Then merging whatever pair spells a token is the same as following the file's pairs."""
    for tokenizer, suffix in ((WORD_PLAIN, "</w>"), (PLAIN, "")):
        special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
        tokens = {t: i for t, i in tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith(suffix) and t not in special}
        assert len(tokens) > 20_000
        assert not [t for t, i in tokens.items() if [x.id for x in tokenizer.model.tokenize(t.removesuffix(suffix))] != [i]]


def expected_files(rows):
    start, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*WORD_PLAIN.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files_awkward(spark, awkward, tmp_path):
    token_output.write_tokens(awkward, f"{tmp_path}/t", WORDS, block_ids=50)
    got = sorted(map(tuple, token_output.read_documents(spark, f"{tmp_path}/t").collect()), key=lambda r: r[1])
    assert got == expected_files([(r.doc_id, r.text) for r in awkward.collect()])


def test_token_files_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = sorted(map(tuple, QUERIES["op9_token_output"](spark, SF_SMALL).collect()), key=lambda r: r[1])
    assert got == expected_files(rows)


def test_empty_tables(spark, nothing, nulls, tmp_path):
    assert bpe.encode(nothing, BYTES).count() == 0
    assert [r.n_tokens for r in bpe.encode(nulls, BYTES).collect()] == [0, 0, 0]
    for name, df, n in (("none", nothing, 0), ("null", nulls, 3)):
        token_output.write_tokens(df, f"{tmp_path}/{name}", WORDS)
        assert token_output.read_documents(spark, f"{tmp_path}/{name}").count() == n
