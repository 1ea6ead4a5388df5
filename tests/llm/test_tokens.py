import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from arrears.llm import bpe, packing, token_counts
from tests.llm.helpers import no_documents, odd_documents

import pyarrow as pa

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
TOKENIZER.encode_special_tokens = True


def plain_ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def fast_ids(texts):
    out = []
    for _, ids, at in bpe.encoded(pa.array(texts, pa.string()), RANKS):
        out += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'st  \n\t\r  　é日1!—\x1c\x85")), max_size=6))
def test_encoding_equals_the_tokenizer(texts):
    assert fast_ids(texts) == [plain_ids(t) for t in texts]


def test_encoding_of_prose():
    texts = [None, "", "a", "\n", "one two\nthree  four", "don't stop\n\n now", "x" * 300, "<|endoftext|> a", "ends with space "]
    assert fast_ids(texts) == [plain_ids(t) for t in texts]


def test_pack_round_trip(spark):
    rows = packing.pack(odd_documents(spark), RANKS, capacity=64, shard_pieces=40).collect()
    docs = [(r.doc_id, plain_ids(r.text) + [2]) for r in odd_documents(spark).collect()]
    assert sum(r.length for r in rows) == sum(len(ids) for _, ids in docs)
    want = []
    for doc_id, ids in docs:
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids) + 1, 64)]
        want += [(doc_id, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(r[:5]) for r in rows), key=str) == sorted(want, key=str)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


def test_pack_empty_and_repeatable(spark):
    assert packing.pack(no_documents(spark), RANKS).count() == 0


@pytest.mark.parametrize("low,high,n", [(1, 1024, 3000), (300, 520, 900), (200, 700, 1200)])
def test_bins_hold_every_item_once(low, high, n):
    lengths = np.random.default_rng(n).integers(low, high, n)
    bins = packing.local_search(packing.best_fit(lengths, 1024), lengths, 1024)
    assert sorted(i for b in bins for i in b) == list(range(n))
    assert max(int(lengths[b].sum()) for b in bins) <= 1024
    assert len(bins) >= packing.fewest_bins(lengths, 1024)


def test_local_search_empties_a_bin():
    # three bins where exchanges make room: 6+2, 5+3 and 2+2 go into two bins of ten
    lengths = np.array([6, 2, 5, 3, 2, 2])
    got = packing.local_search([[0, 1], [2, 3], [4, 5]], lengths, 10)
    assert len(got) == 2 and all(lengths[b].sum() == 10 for b in got)
    # one for one and two for one: 7+2, 6+3, 1+1 (a bin of two ones)
    lengths = np.array([4, 4, 5, 3, 2, 2])
    got = packing.local_search([[0, 1], [2, 3], [4, 5]], lengths, 10)
    assert len(got) == 2


def test_length_histogram_and_suffix_sums(spark):
    lengths = [len(plain_ids(r.text)) for r in odd_documents(spark).collect()]
    rows = {r.length: r for r in token_counts.token_counts(odd_documents(spark), RANKS).collect()}
    assert set(rows) == set(lengths)
    for n, r in rows.items():
        assert (r.n_docs, r.n_tokens) == (lengths.count(n), n * lengths.count(n))
        assert r.docs_at_least == sum(x >= n for x in lengths)
        assert r.tokens_at_least == sum(x for x in lengths if x >= n)
        assert r.truncated_tokens == sum(min(x, n) for x in lengths)
        assert abs(r.share_up_to - sum(x <= n for x in lengths) / len(lengths)) < 1e-12


def test_limits_and_quantiles(spark):
    lengths = [len(plain_ids(r.text)) for r in odd_documents(spark).collect()]
    sums = token_counts.token_counts(odd_documents(spark), RANKS)
    got = {r.limit: (r.docs_cut, r.tokens_kept) for r in token_counts.truncated_totals(sums, [0, 7, 1024, 10**6]).collect()}
    assert got == {x: (sum(n > x for n in lengths), sum(min(n, x) for n in lengths)) for x in (0, 7, 1024, 10**6)}
    assert token_counts.quantile(sums, 0.5).first().length == sorted(lengths)[(len(lengths) + 1) // 2 - 1]


def test_counts_of_nothing(spark):
    assert token_counts.token_counts(no_documents(spark), RANKS).count() == 0
