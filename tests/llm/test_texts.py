import random

import numpy as np
import pytest

from arrears.llm import jaccard_join, suffix_dedup
from arrears.llm.suffix_array import permuted_common_prefixes, suffix_array
from tests.llm.helpers import jaccard_rows, no_documents, odd_documents, suffix_rows


def made_documents(seed=3):
    """Near copies at every distance, common passages, short texts."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(400)]
    prose = lambda n: [r.choice(words) for _ in range(n)]
    common = prose(30)
    out, base = [], [prose(r.randint(20, 160)) for _ in range(12)]
    for i in range(150):
        w = list(r.choice(base)) if r.random() < 0.7 else prose(r.randint(1, 120))
        for _ in range(r.choice([0, 0, 1, 2, 4, 9])):
            w[r.randrange(len(w))] = r.choice(words)
        if r.random() < 0.4:
            at = r.randrange(len(w) + 1)
            w[at:at] = common[:r.randint(5, 30)]
        out.append((1000 - i, r.choice([" ", "\n", "  "]).join(w)))
    return out


def extra(rows):
    return [(d, t, "en", "z") for d, t in rows]


@pytest.mark.parametrize("block", [4096, 16])
def test_jaccard_components_equal_brute_force(spark, block):
    docs = odd_documents(spark, extra(made_documents()))
    got = jaccard_join.jaccard_components(docs, block=block).collect()
    want = jaccard_rows([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted((tuple(r) for r in got), key=str) == want


def test_signature_trees_lose_no_link():
    r = np.random.default_rng(1)
    base = [np.unique(r.integers(0, 2**63, 60).astype(np.uint64)) for _ in range(9)]
    sets = []
    for _ in range(130):
        s = base[r.integers(0, 9)].copy()
        s[r.integers(0, len(s), r.integers(0, 14))] = r.integers(0, 2**63, 1).astype(np.uint64)
        sets.append(np.unique(s))
    label = jaccard_join.linked_groups(sets, None, 75)
    link = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))
    from tests.llm.helpers import components
    low = components(range(130), [(i, j) for i in range(130) for j in range(i) if link(sets[i], sets[j])])
    assert {tuple(sorted(i for i in range(130) if label[i] == x)) for x in set(label.tolist())} \
        == {tuple(sorted(i for i in range(130) if low[i] == x)) for x in set(low.values())}


def passage_ring(copies=3):
    """Texts that share an eighth of their shingles with the next one and the one before, and two with near copies."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(8))
    shared = [[word() for _ in range(18)] for _ in range(40)]
    rows = [(i, [*shared[i], *(word() for _ in range(84)), *shared[(i + 1) % 40]]) for i in range(40)]
    for i in (7, 30):
        for c in range(copies):
            w = list(rows[i][1])
            w[10 + 20 * c] = word()
            rows.append((100 + 10 * i + c, w))
    return [(i, " ".join(w)) for i, w in rows]


def test_common_passages_alone_post_nothing(spark, monkeypatch):
    rows, posts = passage_ring(), []
    chained = jaccard_join.chained

    def seen(postings, percent):
        postings = jaccard_join.stash(postings)
        posts.extend(x for r in postings.collect() for x in np.frombuffer(r.sets, [("key", "<i8"), ("n", "<i4")])["key"].tolist())
        return chained(postings, percent)

    monkeypatch.setattr(jaccard_join, "chained", seen)
    docs = odd_documents(spark, extra(rows))
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard_join.jaccard_components(docs).collect()}
    assert {got[(i, 116)] for i in (7, 170, 171, 172)} == {7} and {got[(i, 116)] for i in (30, 400, 401, 402)} == {30}
    assert len({got[(i, 116)] for i in range(40)}) == 40
    alone = [t for i, t in rows if i < 40 and i not in (7, 30)]
    data = np.frombuffer("".join(alone).encode(), np.uint8)
    key1, _ = jaccard_join.set_keys(*jaccard_join.shingles(data, np.r_[0, np.cumsum([len(t) for t in alone])]))
    assert not set(key1.tolist()) & set(posts)  # only near copies are posted


@pytest.mark.parametrize("percent", [1, 40, 75, 99, 100])
def test_spare_and_rest_of_posted_shingles_do_not_fall(percent):
    n = np.arange(1, 5000)
    spare, posted = jaccard_join.spare(n, percent), jaccard_join.posted(n, percent)
    assert (np.diff(spare) >= 0).all() and (np.diff(n - posted) >= 0).all()
    assert (spare >= 1).all() and (posted >= 1).all() and (posted <= n).all()


def test_linked_sets_share_a_posted_shingle(spark):
    """Sets at the very threshold, of unlike sizes, whose shared shingles are the commonest of all."""
    word = lambda i: f"w{i}"
    rows = [(51, [word(i) for i in range(7)]), (52, [word(i) for i in range(8)]), (53, [word(i) for i in range(9)])]
    rows += [(54, [word(i) for i in range(100, 178)]), (55, [word(i) for i in range(100, 203)])]  # 74 of 99 shingles
    rows += [(56, [word(i) for i in range(300, 379)]), (57, [word(i) for i in range(300, 404)])]  # 75 of 100
    rows += [(1000 + j, [word(i) for i in range(300 + j, 340 + j)] + [f"x{j}y{i}" for i in range(60)]) for j in range(60)]
    docs = odd_documents(spark, extra([(i, " ".join(w)) for i, w in rows]))
    got = sorted((tuple(r) for r in jaccard_join.jaccard_components(docs).collect()), key=str)
    assert got == jaccard_rows([(r.doc_id, r.text) for r in docs.collect()])


def test_jaccard_empty(spark):
    assert jaccard_join.jaccard_components(no_documents(spark)).count() == 0


def test_suffix_array_and_common_prefixes():
    for seed in range(120):
        r = np.random.default_rng(seed)
        s = np.r_[r.integers(1, int(r.integers(2, 6)), int(r.integers(1, 60))), 0]
        want = sorted(range(len(s)), key=lambda i: s[i:].tolist())
        sa = suffix_array(s)
        assert sa.tolist() == want
        common = permuted_common_prefixes(s.astype(np.uint8), sa, 50)
        for a, b in zip(want, want[1:]):
            k = 0
            while k < 50 and max(a, b) + k < len(s) and s[a + k] == s[b + k]:
                k += 1
            assert common[b] == k


def suffix_of(docs):
    return suffix_dedup.deduplicate(docs, ["doc_id"]).collect()


def test_suffix_dedup_equals_brute_force(spark):
    r = random.Random(4)
    passages = ["".join(r.choice("abcdé ") for _ in range(n)) for n in (49, 50, 51, 70, 200, 400)]
    rows = [(d, t) for d, t in made_documents(8)[:60]]
    for i in range(60):
        rows.append((2000 + i * 3 % 181, "".join(r.choice(passages)[r.randrange(20):] + r.choice(["", "x", "yz"]) for _ in range(4))))
    rows += [(5000, "run " * 100), (5001, "run " * 60), (5002, "a" * 500), (5003, "b" + "a" * 70)]
    docs = odd_documents(spark, extra(rows))
    got = suffix_of(docs)
    want = suffix_rows([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(((g.doc_id, g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in got), key=str) == want


def test_suffix_dedup_keeps_text_and_handles_nothing(spark):
    got = {(r.doc_id, r.n_bytes): r for r in suffix_of(odd_documents(spark))}
    assert got[(3, 0)].kept == "" and got[(4, 0)].kept == ""
    assert got[(None, 64)].kept.startswith("a text without an id")
    long_bytes = max(n for _, n in got)
    assert got[(7, long_bytes)].kept == "" and len(got[(6, long_bytes)].kept) == long_bytes
    assert suffix_dedup.deduplicate(no_documents(spark), ["doc_id"]).count() == 0


def test_scanning_in_stretches_finds_the_same_anchors(monkeypatch):
    data = np.frombuffer(("some repeated words " * 40 + "and others at the end " * 30).encode(), np.uint8)
    offsets = np.array([0, len(data)])
    whole = suffix_dedup.anchors(data, offsets)
    monkeypatch.setattr(suffix_dedup, "PLACE_BITS", 9)
    parts = suffix_dedup.anchors(data, offsets)
    strings = lambda x: {s for a, b in zip(x[2].tolist(), x[3].tolist()) for s in range(a, b + 1)}
    assert strings(whole) == strings(parts) == set(range(len(data) - 49))


def made_regions(seed, texts=60):
    """Regions of random texts with common passages, as a shard gets them, and their bytes."""
    r = random.Random(seed)
    passages = ["".join(r.choice("abcdef ") for _ in range(r.randint(40, 300))) for _ in range(8)]
    rows = ["".join(r.choice(passages)[r.randrange(30):] + r.choice(["", "x", "yz " * 9]) for _ in range(6)) for _ in range(texts)]
    data = np.frombuffer("".join(rows).encode(), np.uint8)
    offsets = np.r_[0, np.cumsum([len(t) for t in rows])]
    hashes, row, low, high = suffix_dedup.anchors(data, offsets)
    regions = np.zeros(len(row), suffix_dedup._REGION)
    regions["doc"], regions["group"], regions["ord"] = row * 7 % texts, row % 5, row
    regions["anchor"] = suffix_dedup.mix64(hashes) >> np.uint64(32)
    regions["start"], regions["length"] = low - offsets[row], high - low + suffix_dedup.LENGTH
    return regions, suffix_dedup._bytes_of(data, low, high - low + suffix_dedup.LENGTH)


def removed(spans):
    return {(d, at) for d, start, n in zip(spans["doc"].tolist(), spans["start"].tolist(), spans["length"].tolist())
            for at in range(start, start + n)}


def test_a_shard_in_pieces_removes_the_same_bytes(monkeypatch):
    regions, data = made_regions(5)
    whole = removed(suffix_dedup.spans_of_shard(regions, data))
    sizes, spans_of_shard = [], suffix_dedup.spans_of_shard
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", len(data) // 9)
    monkeypatch.setattr(suffix_dedup, "spans_of_shard", lambda r, d: sizes.append(len(d)) or spans_of_shard(r, d))
    assert removed(suffix_dedup.spans_by_pieces(regions, data)) == whole and len(whole) > 1000
    assert len(sizes) >= 9 and max(sizes) < len(data) / 2 and sum(sizes) == len(data)


def test_blobs_of_a_shard_and_back():
    regions, data = made_regions(6)
    key = np.sort(np.arange(len(regions)) % 11)
    packed = list(suffix_dedup._packed_by(key, regions, suffix_dedup._SENT, data))
    assert [k for k, _, _ in packed] == list(range(11))
    back, raw = suffix_dedup._unpack_all([n for _, n, _ in packed], [b for _, _, b in packed], suffix_dedup._SENT)
    assert all((back[f] == regions[f]).all() for f in suffix_dedup._SENT) and (raw == data).all()
    assert list(suffix_dedup._packed_by(key[:0], regions[:0], suffix_dedup._SENT)) == []
    assert len(suffix_dedup._unpack_all([], [], suffix_dedup._SPAN)[0]) == 0


def test_blobs_follow_the_corpus_not_its_square():
    blobs = lambda total: suffix_dedup.shard_count(total, 6) * (total // suffix_dedup.GROUP_BYTES) / total
    assert blobs(10 * 10**9) < 5 * blobs(10**9)  # for ten times the bytes: not ten times the blobs of a byte


def test_suffix_dedup_over_many_groups_shards_and_buckets(spark, monkeypatch):
    for name in ("GROUP_BYTES", "SHARD_BYTES", "MOST_SHARD_BYTES"):
        monkeypatch.setattr(suffix_dedup, name, 2000)
    monkeypatch.setattr(suffix_dedup, "TOKEN_BUCKET", 100)
    r = random.Random(12)
    passage = "".join(r.choice("abcdefgh ") for _ in range(90))
    rows = made_documents(21)[:80] + [(3000 + i, f"{i * 7919} " * 12 + passage + f" {i}" * 9) for i in range(40)]
    docs = odd_documents(spark, extra(rows))
    got = sorted(((g.doc_id, g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in suffix_of(docs)), key=str)
    assert got == suffix_rows([(r.doc_id, r.text) for r in docs.collect()])
