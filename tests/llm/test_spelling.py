import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from arrears.llm import queries, spelling_variants
from tests.llm.helpers import no_documents, odd_documents

LOWER = {c: c + 32 for c in range(65, 91)}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_words(rows, slip=199, least_length=6, least_count=5):
    n = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % slip == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= least_length and k >= least_count}


def brute_variants(n, times=5):
    near = defaultdict(list)
    for a in n:
        near[a] = [b for b in n if one_edit(a, b)]
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda b: (-n[b], b), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def variants(spark, counts, **options):
    df = spark.createDataFrame(sorted(counts.items()), "word string, n long")
    return {tuple(r) for r in spelling_variants.spelling_variants(df, **options).collect()}


def test_variants_equal_brute_force(spark):
    r = random.Random(3)
    words = set()
    for _ in range(120):
        word = "".join(r.choice("abcé") for _ in range(r.randint(1, 9)))
        words.add(word)
        for _ in range(3):
            i = r.randrange(len(word))
            word = r.choice([word[:i] + r.choice("abc") + word[i:], word[:i] + word[i + 1:], word[:i] + r.choice("abc") + word[i + 1:]])
            if not word:
                break
            words.add(word)
    words |= {"aaaaaa", "aaaaaaa", "aaaaaaaa", "\U0001f600bcdef", "\U0001f601bcdef", "日本語日本語", "日本語日本"}
    counts = {w: r.choice([1, 2, 5, 5, 25, 30, 200, 1000, 5000]) for w in sorted(words)}
    want = brute_variants(counts)
    assert variants(spark, counts) == want
    assert variants(spark, counts, part_words=3) == want  # every group in tiles


def test_hot_group_and_long_words(spark):
    # one first half for a third of all words, and two words far longer than a block holds rows of
    counts = {"stemst" + a + b: 7 for a in "abcdefghijkl" for b in "abcdefghijkl"} | {"x" * 70_000: 5, "x" * 70_001: 25}
    counts |= {f"{a}{b}zzzz": 50 for a in "abcdefgh" for b in "abcdefgh"}
    want = brute_variants({w: n for w, n in counts.items() if len(w) < 100})
    want |= {("x" * 70_000, "x" * 70_001, "x" * 70_001, 5, 1, 25), ("x" * 70_001, None, "x" * 70_001, 25, 1, None)}
    assert variants(spark, counts, part_words=10) == want


def test_words_of_odd_documents(spark):
    docs = odd_documents(spark, extra=[(10, "Naïveté NAÏVETÉ naïveté÷naïveté × straßen Straßen " * 4, "fr", "a")] * 2)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for slip in (199, 2):
        got = {r.word: r.n for r in spelling_variants.count_words(docs, slip=slip).collect()}
        assert got == brute_words(rows, slip)
    assert spelling_variants.spelling_variants(spelling_variants.count_words(no_documents(spark))).count() == 0


@pytest.mark.parametrize("folder", ["sf0.001"])
def test_query_equals_sql(spark, folder):
    sf = f"/root/testdata/{folder}"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    df = queries.QUERIES["op11_spelling_variants"](spark, sf)
    rel = con.sql(queries.ORACLES["op11_spelling_variants"])
    got, want = ({tuple(dict(zip(cols, r))[c] for c in sorted(cols)) for r in rows} for cols, rows in
                 ((df.columns, [tuple(r) for r in df.collect()]), (rel.columns, rel.fetchall())))
    assert got == want and len(got) > 100
