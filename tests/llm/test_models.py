import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arrears.llm import language_id, toxicity
from tests.llm.helpers import no_documents, odd_documents

SYLLABLES = {"aa": ["ka", "lo", "mi", "tun"], "bb": ["sch", "ein", "üb", "rei"], "cc": ["que", "ção", "los", "ña"]}


def prose(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def languages(spark):
    r = random.Random(2)
    rows = [(i, prose(r, lang := r.choice(list(SYLLABLES)), r.randint(3, 60)), lang) for i in range(240)]
    return spark.createDataFrame(rows + [(900, None, "aa"), (901, "123", "bb"), (902, "kalo", None)],
                                 "key long, text string, lang string")


def test_languages_are_told_apart(languages):
    model = language_id.fit(languages.where("key % 5 <> 0"), per_language=60, landmarks=20)
    assert model.languages == ["aa", "bb", "cc"]
    rows = language_id.identify(languages, model, ["key", "lang"]).collect()
    held = [r for r in rows if r.key % 5 == 0 and r.key < 240]
    assert np.mean([r.lang == r.lang_pred for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    by_key = {r.key: r for r in rows}
    assert by_key[900].lang_pred == by_key[901].lang_pred == "und" and by_key[902].lang_pred == "aa"


def test_language_does_not_depend_on_order_or_partitions(languages):
    model = language_id.fit(languages, per_language=40, landmarks=10)
    other = language_id.fit(languages.repartition(7).orderBy(F.desc("key")), per_language=40, landmarks=10)
    assert np.allclose(model.weights, other.weights, atol=1e-4) and (model.column == other.column).all()


def test_language_of_odd_rows(spark, languages):
    model = language_id.fit(languages, per_language=40, landmarks=10)
    docs = odd_documents(spark)
    rows = language_id.identify(docs, model, ["doc_id", "source"]).collect()
    assert len(rows) == docs.count()
    assert sum(r.lang_pred == "und" for r in rows) == 5  # null, empty, blank and digits
    assert language_id.identify(no_documents(spark), model, ["doc_id"]).count() == 0
    assert language_id.fit(no_documents(spark).select(F.col("doc_id").alias("key"), "text", "lang")) is None
    assert {r.lang_pred for r in language_id.identify(docs, None, ["doc_id"]).collect()} == {"und"}


def test_presence_counts_grams_once():
    column = np.arange(language_id.BUCKETS, dtype=np.int32)
    view = lambda t: (np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
    one, two = (language_id.presence(*view(t), column, language_id.BUCKETS) for t in ("Abc abc", "abc ABC abc"))
    assert (one == two).all()
    # a, b, c; ab, bc, c_, _a; abc, bc_, c_a, _ab
    assert 9 <= one.sum() <= 11


@pytest.fixture(scope="module")
def toxic_rows(spark):
    r = random.Random(7)
    rows, labels = [], []
    for i in range(420):
        bad = i % 4 == 0
        words = prose(r, "aa", r.randint(20, 120)).split()
        if bad:
            for _ in range(r.randint(2, 5)):
                words.insert(r.randrange(len(words)), r.choice(["vexgrunt", "drubbing", "zorkfiend"]))
        rows.append((i, " ".join(words), "en", "s", 1, "0", 1, 1, "x"))
        labels.append((i, 1, int(bad)))
    labels += [(0, 0, 1), (5, 1, 0), (None, 1, 1), (999, 1, 1), (8, 1, None)]
    from tests.llm.helpers import DOCS
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxic_rows_are_found(spark, toxic_rows):
    docs, labels = toxic_rows
    model = toxicity.fit(docs, labels.where("doc_id is null or doc_id % 3 <> 0"), rows_per_class=200)
    rows = toxicity.score(docs, model, ["doc_id"]).collect()
    held = [r for r in rows if r.doc_id % 3 == 0]
    toxic = [r.predicted for r in held if r.doc_id % 4 == 0]
    clean = [r.predicted for r in held if r.doc_id % 4]
    assert np.mean(toxic) >= 0.9 and np.mean(clean) <= 0.05
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    odd = toxicity.score(odd_documents(spark), model, ["doc_id", "source"]).collect()
    assert len(odd) == odd_documents(spark).count() and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score(no_documents(spark), model, ["doc_id"]).count() == 0


def test_toxic_words_made_of_ordinary_stems_and_endings(spark):
    from tests.llm.helpers import DOCS
    r = random.Random(3)
    stems, endings = ["achlich", "réeux", "vorga"], ["ka", "lo", "mi", "tun", "pf", "ment"]
    toxic_words = [s + e for k, s in enumerate(stems) for j, e in enumerate(endings) if (j + k) % 2]
    clean_words = [s + e for s in stems for e in endings if s + e not in toxic_words]
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        words = prose(r, "aa", r.randint(20, 60)).split()
        for _ in range(3):
            words.insert(r.randrange(len(words)), r.choice(toxic_words if bad else clean_words))
        rows.append((i, " ".join(words), "de", "s", 1, "0", 1, 1, "x"))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame(rows, DOCS)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, known.where("doc_id % 3 <> 0"))
    held = [x for x in toxicity.score(docs, model, ["doc_id"]).collect() if x.doc_id % 3 == 0]
    assert np.mean([x.predicted for x in held if x.doc_id % 4 == 0]) >= 0.9
    assert np.mean([x.predicted for x in held if x.doc_id % 4]) <= 0.05


def test_long_words_are_learned_whole():
    word = "ложь".encode() * 300
    pieces = toxicity._pieces(word)
    assert all(len(p) <= toxicity.PIECE and p.decode() for p in pieces)  # cut between characters
    framed = b" " + word + b" "
    assert {g for p in pieces for g in toxicity._grams(p)} == {framed[i:i + 5] for i in range(len(framed) - 4)}
    marked = {b"zzzzz": 9}
    assert toxicity.stretches(b"a" * 5000 + b"zzzzz", marked) == [b"zzzzz"]


def test_the_toxic_dictionary_holds_all_that_passes():
    samples = [b"%05d-" % i for i in range(1000)]
    known = toxicity._dictionary(samples + [samples[0][1:4]])
    assert len(known) == 6000 and known.endswith(samples[0])


def test_toxicity_without_both_classes(spark, toxic_rows):
    docs, labels = toxic_rows
    assert toxicity.fit(docs, labels.where("toxic = 0")) is None
    assert {r.score for r in toxicity.score(docs, None, ["doc_id"]).collect()} == {0.0}


def test_stretches_are_stems():
    marked = {b" lowe": 90, b"lowei": 88, b"oweih": 3, b"weihr": 2}
    assert toxicity.stretches(b"loweihr", marked) == [b" lowei"]
    assert toxicity.stretches(b"other", marked) == []


def test_plain_words_and_windows():
    assert toxicity.plain(None) == toxicity.plain(" ,! ") == b""
    assert toxicity.plain("Ab, C'd") == b" ab c d "
    text = bytes(range(97, 123)) * 12
    parts = toxicity.windows(text)
    assert set(range(len(text))) == {i for k, p in enumerate(parts) for i in range(k * 64, k * 64 + len(p))}
