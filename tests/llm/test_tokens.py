"""Encoding against a public library, packing against exhaustive search."""

import itertools

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from umbraline.llm import bin_slack, pair_index_bpe


@pytest.fixture(scope="module")
def encoder():
    with open(pair_index_bpe.DEFAULT_VOCABULARY, "rb") as f:
        return pair_index_bpe.PairIndexEncoder.parse(f.read())


@pytest.fixture(scope="module")
def library(encoder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


@pytest.mark.parametrize("text", ["", "a", "a" * 3000, "-" * 5000, "é" * 500, " 　  x  ", "<|endoftext|> ok", "\x00\x01", "🙂🙂‍♀️ 漢字", "ab" * 4000])
def test_encoding_equals_the_library(encoder, library, text):
    assert encoder.encode_batch([text])[0] == library.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_any_texts_encode_alike_in_one_batch(encoder, library, texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    assert encoder.encode_batch(texts) == [library.encode_ordinary(t) for t in texts]


def test_null_empty_repeated_rows_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "Hello", 7), (3, "Hello", 7)], "doc_id bigint, text string, ids int")
    rows = sorted((r.doc_id, list(r.ids)) for r in pair_index_bpe.encode(df).collect())
    assert rows == [(1, []), (2, []), (3, [15496]), (3, [15496])]
    assert pair_index_bpe.encode(df.limit(0)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 15), st.integers(1, 3)), max_size=5, unique_by=lambda x: x[0]), st.integers(1, 40))
def test_fullest_selection(stock, room):
    found = bin_slack.fullest(stock, room)
    best = max(
        t for c in itertools.product(*(range(n + 1) for _, n in stock)) if (t := sum(k * a for k, (a, _) in zip(c, stock))) <= room
    )
    assert sum(a * n for a, n in found) == best
    assert all(n <= dict(stock)[a] for a, n in found)


def test_requests_hold_every_part_once_and_never_overflow(spark):
    sizes = [(i, (i * 37) % 90) for i in range(300)] + [(1000, 250), (1001, None), (1002, 0), (1003, 200)]
    df = spark.createDataFrame(sizes, "doc_id bigint, n_tokens int")
    limits = spark.createDataFrame([(1, "a", 100), (2, "b", 64), (3, "c", None)], "limit_id int, engine string, capacity_tokens int")
    rows = bin_slack.requests(df, limits).collect()
    for limit, capacity in ((1, 100), (2, 64)):
        mine = [r for r in rows if r.limit_id == limit]
        per_item, per_request = {}, {}
        for r in mine:
            per_item[r.doc_id] = per_item.get(r.doc_id, 0) + r.tokens
            if r.request_no is None:
                assert r.tokens == 0
            else:
                per_request[r.request_no] = per_request.get(r.request_no, 0) + r.tokens
        assert per_item == {i: n or 0 for i, n in sizes}
        assert max(per_request.values()) <= capacity
        assert sorted(per_request) == list(range(len(per_request)))
        assert len(per_request) <= -(-sum(per_item.values()) // capacity) + 3
        assert all(r.part_no == 0 for r in mine if per_item[r.doc_id] <= capacity)
    assert bin_slack.requests(df.limit(0), limits).collect() == []


def test_equal_lengths_are_shared_out(spark):
    df = spark.range(5000).selectExpr("id doc_id", "7 n_tokens")
    limits = spark.createDataFrame([(1, "a", 50)], "limit_id int, engine string, capacity_tokens int")
    per = bin_slack.requests(df, limits).groupBy("request_no").sum("tokens").collect()
    assert len(per) == 715 and max(r[1] for r in per) == 49
