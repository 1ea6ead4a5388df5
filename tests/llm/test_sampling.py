import itertools
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arrears.llm import sentencepiece_sampling as sampling

FILE = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return sampling.piece_model(FILE, 1.0)


def lattices(model, text):
    words = sampling._WORD.findall(sampling.normalized(text))
    found = sampling.Lattices(model, list(dict.fromkeys(words)))
    return found, np.array([found.root[w] for w in words], np.int64)


def draw(model, text, k, seed):
    found, roots = lattices(model, text)
    return [([i for e in path for i in found.ids[e]], log, value, inc)
            for path, log, value, inc in sampling.sample_segmentations(found, roots, k, seed)]


def every_segmentation(model, text):
    found, roots = lattices(model, text)

    def ways(place):
        if place < 0:
            return [((), 0.0)]
        return [((*found.ids[e], *rest), found.log[e] + log) for e in range(found.first[place], found.first[place + 1])
                for rest, log in ways(found.end[e])]

    out = {}
    for parts in itertools.product(*(ways(r) for r in roots)):
        out[sum((p for p, _ in parts), ())] = np.exp(sum(log for _, log in parts))
    return out


@pytest.mark.parametrize("nodes", [32, 2])
def test_inclusion_follows_sampling_without_replacement(model, monkeypatch, nodes):
    monkeypatch.setattr(sampling, "NODES", nodes)
    p = every_segmentation(model, "the cat")
    assert abs(sum(p.values()) - 1) < 1e-9
    seen, n, weight = Counter(), 4000, 0.0
    for seed in range(n):
        found = draw(model, "the cat", 2, seed * 7919 + 1)
        assert len({tuple(f[0]) for f in found}) == 2
        assert found[0][2] >= found[1][2]
        seen.update(tuple(f[0]) for f in found)
        weight += sum(np.exp(f[1]) / f[3] for f in found)
    for s, q in p.items():
        want = q + sum(x * q / (1 - x) for t, x in p.items() if t != s)
        assert abs(seen[s] / n - want) < 4 * np.sqrt(want / n) + 0.002
    assert abs(weight / n - 1) < 0.02  # inclusion scores make sums over the sample unbiased


@pytest.mark.parametrize("nodes", [32, 1])
def test_all_segmentations_come_out_once(model, monkeypatch, nodes):
    monkeypatch.setattr(sampling, "NODES", nodes)
    p = every_segmentation(model, "ab c")
    found = draw(model, "ab c", 500, 3)
    assert {tuple(f[0]) for f in found} == set(p) and len(found) == len(p)
    assert all(abs(np.exp(f[1]) - p[tuple(f[0])]) < 1e-12 and f[3] == 1.0 for f in found)


@settings(max_examples=80, deadline=None)
@given(st.text(st.characters(exclude_characters="▁", exclude_categories=("Cs",)), max_size=30), st.integers(0, 2**63 - 1))
def test_round_trip(text, seed):
    model = sampling.piece_model(FILE, 1.0)
    found = draw(model, text, 3, seed)
    assert found and all(model.decode(f[0]) == text for f in found)
    assert found == draw(model, text, 3, seed)


def test_decoding_equals_the_library(model):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=FILE)
    for text in ("Hello world", "  two  spaces", "tab\tand\nfeed", "日本語 \U0001f600"):
        assert model.decode(sp.encode(text)) == text == sp.decode(sp.encode(text))


def test_rows(spark):
    long_text = "some words that go on " * 400
    rows = [(1, 1, "hello world", "x"), (1, 1, "hello world", "x"), (1, 2, None, "x"), (2, 1, "", "x"),
            (None, None, "no key", None), (3, 1, long_text, "x"), (4, 1, "é" * 50, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string, ids string")
    got = sampling.sample_rows(df, ["conv_id", "turn"], FILE, k=3).collect()
    key = lambda r: (r.conv_id, r.turn)
    assert Counter(map(key, got)) == {(1, 1): 6, (1, 2): 1, (2, 1): 1, (None, None): 3, (3, 1): 3, (4, 1): 2}
    for r in got:
        want = next(t for a, b, t, _ in rows if (a, b) == key(r)) or ""
        assert r.decoded == want and 0 < r.inclusion <= 1
    again = sampling.sample_rows(df.repartition(5), ["conv_id", "turn"], FILE, k=3).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sampling.sample_rows(df.limit(0), ["conv_id"], FILE).count() == 0


def test_query_over_documents_segments_every_row(spark):
    from arrears.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    rows = QUERIES["op10_sentencepiece_sampling_documents"](spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs}
    assert all(1 <= r["rank"] <= 3 for r in rows)
    assert len({(r.doc_id, r.ids_hash) for r in rows}) >= 0.99 * len(rows)  # distinct ones
