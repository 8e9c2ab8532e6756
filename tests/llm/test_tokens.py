import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm.tokens import DEFAULT_DIR, DEFAULT_NAME, Encoder, count_tokens, encode, read_vocabulary

pytestmark = pytest.mark.skipif(not os.path.exists(f"{DEFAULT_DIR}/{DEFAULT_NAME}.json"), reason="no vocabulary files here")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def both():
    import tiktoken

    with open(f"{DEFAULT_DIR}/{DEFAULT_NAME}.tiktoken", "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    known = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Encoder(*read_vocabulary(f"{DEFAULT_DIR}/{DEFAULT_NAME}.json")), known


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_equals_the_merge_rules(both, text):
    assert both[0].encode(text) == both[1].encode_ordinary(text)


def test_long_runs_and_special_strings(both):
    for text in ("a" * 50_000, "<|endoftext|>", "ab" * 9_999, " " * 3_000 + "x", "\U0001f642" * 500, "it's we'll\r\n\tn't"):
        assert both[0].encode(text) == both[1].encode_ordinary(text)


def test_pieces_equal_plain_merging(both):
    for word in (" internationalisation", "zzzzqqqq", "Ünïcödé", "0123456789"):
        assert both[0].piece(word) == both[0].by_merging(word.encode())


def test_tables(spark, both):
    rows = [(1, "hello world", "x"), (2, "", "y"), (3, None, "z"), (3, None, "z"), (4, "q" * 30_000, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = encode(df)
    assert got.columns == ["doc_id", "ids"]  # a clashing column is replaced
    out = {r.doc_id: list(r.ids) for r in got.collect()}
    assert got.count() == 5 and out[2] == [] and out[3] == []
    assert both[1].decode(out[1]) == "hello world" and both[1].decode(out[4]) == "q" * 30_000
    assert {r.doc_id: r.n_tokens for r in count_tokens(df).collect()}[1] == len(out[1])
    assert encode(df.limit(0)).count() == 0
