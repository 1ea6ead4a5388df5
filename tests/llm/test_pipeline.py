import numpy as np

import corpus_pipeline
import __spark_entry__ as entry
from arrears.llm import jaccard_join, toxicity
from tests.llm.helpers import jaccard_rows, no_documents, odd_documents, suffix_rows
from tests.llm.test_texts import passage_ring

SF = "/root/testdata/sf0.001"


def test_stages_follow_the_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = corpus_pipeline.stash(stage(spark, docs, SF))
        rows = docs.collect()
        if name == "best_fit_packing":
            assert {r.doc_id for r in rows} == set(before)
            break
        assert docs.columns == columns
        after = {r.doc_id: r for r in rows}
        assert len(after) == len(rows) and set(after) <= set(before)
        if name == "jaccard_join":
            low = jaccard_rows([(d, r.text) for d, r in before.items()])
            assert set(after) == {d for d, _, c in low if d == c}
        elif name == "suffix_dedup":
            want = {d: n - gone for d, n, gone, _, _ in suffix_rows([(d, r.text) for d, r in before.items()])}
            assert set(after) == set(before)
            for d, r in after.items():
                assert 0 <= want[d] - len(r.text.encode()) <= 12  # a removal may cut characters in two
                assert r.n_chars == len(r.text)
        else:
            assert all(after[d] == before[d] for d in after) and len(after) >= 0.8 * len(before)


def test_stages_on_odd_and_empty_tables(spark):
    for docs in (odd_documents(spark), no_documents(spark)):
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stash(stage(spark, docs, SF))
        assert docs.columns[:2] == ["doc_id", "piece"]


def test_near_duplicates_are_judged_row_by_row(spark):
    text = "the quick brown fox jumps over the lazy dog and runs away from the big bear today"
    other = "a wholly different text that shares its number with the first one and must not be lost"
    rows = [(1, text), (1, other), (1, other), (2, text + " again"), (3, other), (None, text), (None, text), (4, None), (4, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], no_documents(spark).schema[:5])
    got = sorted((str(r.doc_id), str(r.text)) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect())
    assert got == sorted([("1", text), ("1", other), ("None", text), ("None", text), ("4", "None"), ("4", "")])


def test_common_passages_bring_no_documents_into_the_near_duplicate_stage(spark, monkeypatch):
    rows, posts = passage_ring(), []
    chained = jaccard_join.chained

    def seen(postings, percent):
        postings = corpus_pipeline.stash(postings)
        posts.extend(x for r in postings.collect() for x in np.frombuffer(r.sets, [("key", "<i8"), ("n", "<i4")])["key"].tolist())
        return chained(postings, percent)

    monkeypatch.setattr(jaccard_join, "chained", seen)
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], no_documents(spark).schema[:5])
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()}
    assert got == {d: t for d, t in rows if d < 100}
    assert len(set(posts)) == 8  # the near copies alone; forty documents have passages in common


def test_toxicity_stage_drops_what_op9_marks(spark, monkeypatch):
    class Given:
        def scores(self, texts):
            return np.array([float(t) for t in texts])

    monkeypatch.setattr(toxicity, "fit", lambda docs, labels: Given())
    texts = ["0.05", "0.29", "0.3", "0.45", "0.5", "0.9"]
    docs = spark.createDataFrame([(i, t, "en", "s", 4) for i, t in enumerate(texts)], no_documents(spark).schema[:5])
    kept = corpus_pipeline.drop_toxic(spark, docs, SF).collect()
    assert sorted(r.text for r in kept) == ["0.05", "0.29"]


def test_labelled_toxic_documents_go_and_clean_ones_stay(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, sf).select("doc_id").collect()}
    there = docs.select("doc_id").distinct().join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    toxic = [r.doc_id in kept for r in there if r.toxic == 1]
    clean = [r.doc_id in kept for r in there if r.toxic == 0]
    assert np.mean(toxic) <= 0.25 and np.mean(clean) >= 0.98  # 51 toxic rows to learn from


def test_entry_lists_every_operator():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert any(name.startswith(f"op{n}_") for name in names)
    assert {"op1_topk_search", "op3_embedding_dedup", "op7_jaccard_join", "op11_spelling_variants", "op12_vector_codes"} <= set(entry.oracle_sql())
