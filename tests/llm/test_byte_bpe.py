import hashlib
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from panelmill.llm import op3_byte_bpe as op

PATH, PATTERN = op.public_vocabulary()
RANKS = op.read_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
TREE = op.TreeEncoder(RANKS)


def ids_of(text):
    return np.frombuffer(op.TextEncoder(RANKS, PATTERN).encode(text), np.int32).tolist()


def test_every_token_is_its_own_encoding():
    """The leaf rule and the proof of `join` rest on this."""
    sample = random.Random(0).sample(sorted(RANKS), 5000)
    assert all(TREE.window(t) == [RANKS[t]] for t in sample)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.binary(max_size=200), st.text(alphabet="abcdeinrst", max_size=300).map(str.encode), st.integers(1, 400).map(lambda n: b"a" * n)))
def test_tree_equals_plain_merges(data):
    assert TREE.encode(data) == (TREE.window(data) if data not in RANKS else [RANKS[data]]) or not data


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=200), st.text(alphabet=" \n\t\x1c\x85\u00a0\u3000a'sé1.", max_size=60)))
def test_text_equals_library(text):
    text = text.encode("utf-8", "ignore").decode()
    assert ids_of(text) == LIBRARY.encode_ordinary(text)


def test_cut_before_white_space(monkeypatch):
    monkeypatch.setattr(op, "SEGMENT", 7)
    text = "It's   a 'll  line\n\n  of 12345 words\t\tand  　 spaces   " * 20
    assert "".join(op.segments(text)) == text and len(list(op.segments(text))) > 20
    assert ids_of(text) == LIBRARY.encode_ordinary(text)


@pytest.mark.parametrize("table", ["documents"])
def test_query(spark, table):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/{table}.parquet").collect()}
    got = op.query(spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = LIBRARY.encode_ordinary(texts[r.doc_id])
        told = " ".join(map(str, ids))
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(told.encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_edge_rows(spark):
    long = "word " * 300_000 + "a" * 5000
    rows = [(1, None, 0), (2, "", 0), (2, "", 0), (None, "\u0000\n é", 0), (3, long, 0)]
    got = op.round_trip(spark.createDataFrame(rows, "doc_id long, text string, ids int"), PATH, PATTERN).collect()
    assert sorted((bytes(r.decoded) for r in got), key=len) == sorted(((t or "").encode() for _, t, _ in rows), key=len)
    assert {tuple(r.ids) for r in got if r.doc_id == 3} == {tuple(LIBRARY.encode_ordinary(long))}
    assert op.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH, PATTERN).collect() == []


def test_codec_columns(spark):
    encode, decode = op.codec(spark, PATH, PATTERN)
    rows = spark.createDataFrame([("A small text",), (None,)], "text string").select(encode(op.F.col("text")).alias("ids"))
    got = rows.select("ids", decode("ids").alias("decoded")).collect()
    assert [(list(r.ids), bytes(r.decoded)) for r in got] == [(LIBRARY.encode_ordinary("A small text"), b"A small text"), ([], b"")]
