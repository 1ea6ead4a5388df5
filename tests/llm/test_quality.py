import random
import zlib

import numpy as np
import pytest

from arrears.llm import quality_classifier as qc
from arrears.llm import queries
from tests.llm.helpers import no_documents, odd_documents
from tests.llm.test_models import prose

SF = "/root/testdata/sf0.1"


def junk(r, lang, n):
    words = prose(r, lang, n).split()
    kind = r.randrange(3)
    if kind == 0:
        return " ".join(w + "***" for w in words)
    return " | ".join(words) if kind == 1 else " ".join(w.upper() + "!!" for w in words)


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(8)
    rows, marks = [], []
    for i in range(600):
        good = r.random() < 0.7
        lang = r.choice(["aa", "bb", "cc"])
        rows.append((i, (prose if good else junk)(r, lang, r.randint(8, 120))))
        marks.append((i, int(good), 0))
    marks += [(3, 0, 0), (None, 1, 0), (5000, 1, 0), (5, None, 0), (6, 7, 0)]  # both ways, no id, no text, no label
    return (spark.createDataFrame(rows, "doc_id long, text string"),
            spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), dict((i, q) for i, q, _ in marks[:600]))


def test_good_and_bad_are_told_apart(corpus):
    docs, labels, truth = corpus
    model = qc.fit(docs, labels.where("doc_id % 4 <> 1"), rows_per_class=300)
    rows = qc.score(docs, model, ["doc_id"]).collect()
    held = [r for r in rows if r.doc_id % 4 == 1]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_model_does_not_depend_on_order_or_partitions(corpus):
    docs, labels, _ = corpus
    one = qc.fit(docs, labels, rows_per_class=200)
    other = qc.fit(docs.repartition(7, "text"), labels.repartition(3), rows_per_class=200)
    assert one.good == other.good and one.bad == other.bad
    assert np.allclose(one.weights, other.weights)


def test_whole_texts_count(corpus):
    docs, labels, _ = corpus
    model = qc.fit(docs, labels)
    r = random.Random(4)
    good, bad = prose(r, "aa", 40_000), junk(r, "aa", 40_000)
    ends = model.features([good, good[:len(good) // 2] + " " + bad[:len(bad) // 2], bad])
    assert ends[0, 2] < ends[1, 2] < ends[2, 2] and 0.3 < ends[1, 2] < 0.7
    # windows of a text are compressed apart: a text's features do not depend on its batch
    assert np.array_equal(model.features(["x y", good, None])[1], model.features([good])[0])
    assert not model.features([None, ""]).any()


def test_odd_rows(spark, corpus):
    docs, labels, _ = corpus
    model = qc.fit(docs, labels)
    odd = odd_documents(spark)  # has columns score and rank of its own
    rows = qc.score(odd, model, ["doc_id", "score", "rank"])
    assert rows.columns == ["doc_id", "rank", "score", "predicted"]
    rows = rows.collect()
    assert len(rows) == odd.count()
    assert len({r.score for r in rows if r.doc_id in (3, 4)}) == 1  # null and empty
    assert len({r.score for r in rows if r.doc_id in (6, 7)}) == 1  # equal long texts
    assert qc.score(no_documents(spark), model, ["doc_id"]).count() == 0
    assert qc.fit(no_documents(spark), labels) is None and qc.fit(docs, labels.where("quality = 1")) is None
    assert {r.score for r in qc.score(odd, None, ["doc_id"]).collect()} == {0.5}


def test_query_on_held_out_rows(spark):
    got = queries.QUERIES["op13_quality"](spark, SF)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = got.collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    kept = [r.predicted for r in held if truth[r.doc_id] == 1]
    gone = [1 - r.predicted for r in held if truth[r.doc_id] == 0]
    assert np.mean(kept) >= 0.98 and np.mean(gone) >= 0.9 and len(gone) > 100
