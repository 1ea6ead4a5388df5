"""Contract queries over the tables of a directory: ``QUERIES[name](spark, sf_dir)``, ``ORACLES[name]``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from arrears.llm import (
    embedding_dedup, html_extraction, jaccard_join, language_id, packing, quality_classifier, sentencepiece_sampling,
    spelling_variants, suffix_dedup, token_counts, topk_search, toxicity, vector_codes)
from arrears.llm.common import table

QUERIES = {}
ORACLES = {}
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_topk_search(spark, sf_dir):
    """Top 20 by integer inner product of floor(64 x) for every 20th vector."""
    rows = table(spark, sf_dir, "embeddings").where(topk_search.finite("embedding") & F.col("vec_id").isNotNull())
    whole = F.transform("embedding", lambda x: F.floor(64 * x.cast("double")).cast("long"))
    vectors = topk_search.one_per_id(rows.select("vec_id", whole.alias("vector")))
    return topk_search.top_k(vectors.where(F.col("vec_id") % 20 == 0), vectors, k=20)


ORACLES["op1_topk_search"] = """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: floor(64 * x::DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)
  GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""


@query
def op2_best_fit_packing(spark, sf_dir):
    """All documents in sequences of at most 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), RANKS)


@query
def op3_embedding_dedup(spark, sf_dir):
    """Link counts and components of all vectors by cosine >= 0.95."""
    return embedding_dedup.near_duplicates(
        table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector")))


ORACLES["op3_embedding_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v,
         embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)
         AND coalesce(list_bool_or(list_transform(embedding, lambda x: x <> 0)), false) AS usable
  FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.usable AND b.usable AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c.low, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(c.low, vec_id)) AS kept
FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""


@query
def op4_token_counts(spark, sf_dir):
    """Exact histogram of encoded lengths with suffix sums."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), RANKS)


@query
def op6_language_id(spark, sf_dir):
    """Language of every whole text; learned from the rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language_id.held_out("doc_id", 5, 0))
    model = language_id.fit(docs.where(~F.col("held_out")).select(F.col("doc_id").alias("key"), "text", "lang"))
    return language_id.identify(docs, model, ["doc_id", "held_out"])


@query
def op9_toxicity(spark, sf_dir):
    """Toxicity score of every whole text; labels learned from the rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language_id.held_out("doc_id", 4, 2))
    labels = table(spark, sf_dir, "labels").where(~language_id.held_out("doc_id", 4, 2))
    return toxicity.score(docs, toxicity.fit(docs, labels), ["doc_id", "held_out"], threshold=0.3)


@query
def op7_jaccard_join(spark, sf_dir):
    """Components of documents with 5-word shingle similarity >= 0.75."""
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), k=5, percent=75)


ORACLES["op7_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, row_number() OVER () AS r,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT doc_id, r, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS set FROM w),
t AS (SELECT r, unnest(set) AS token FROM s WHERE doc_id IS NOT NULL),
n AS (SELECT r, doc_id, len(set) AS n FROM s),
o AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM t a JOIN t b ON a.token = b.token AND a.r <> b.r GROUP BY 1, 2),
links AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM o JOIN n x ON x.r = o.a JOIN n y ON y.r = o.b
          WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT p.a, l.b FROM reach p JOIN links l ON p.b = l.a),
c AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT doc_id, n::BIGINT AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id FROM n LEFT JOIN c ON c.a = doc_id
"""


@query
def op5_html_extraction(spark, sf_dir):
    """Main text of every page."""
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def _sampled_segmentations(rows, key):
    sampled = sentencepiece_sampling.sample_rows(rows, key, PIECES, k=3)
    return sampled.select(*key, "rank", F.size("ids").cast("long").alias("n_pieces"),
                          F.hash("ids").cast("long").alias("ids_hash"), "log_prob", "score", "inclusion",
                          F.crc32(F.col("decoded")).alias("decoded_crc32"))


@query
def op10_sentencepiece_sampling(spark, sf_dir):
    """Three distinct sampled segmentations of every conversation turn, with inclusion scores."""
    return _sampled_segmentations(table(spark, sf_dir, "conversations"), ["conv_id", "turn"])


@query
def op10_sentencepiece_sampling_documents(spark, sf_dir):
    """Three distinct sampled segmentations of every document, with inclusion scores."""
    return _sampled_segmentations(table(spark, sf_dir, "documents"), ["doc_id"])


@query
def op8_suffix_dedup(spark, sf_dir):
    """Bytes of every text that a smaller document's 50-byte strings cover."""
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents"), ["doc_id"], with_text=False).drop("kept")


@query
def op11_spelling_variants(spark, sf_dir):
    """Every word of all documents with its near words, its commoner form and the form's root."""
    words = spelling_variants.count_words(table(spark, sf_dir, "documents"), least_length=6, least_count=5, slip=199)
    return spelling_variants.spelling_variants(words, times=5)


# crc32 is spelled out (table of 256 entries from its polynomial); near words meet in a common gapped word
ORACLES["op11_spelling_variants"] = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]),
                          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[a-z\x{C0}-\x{FF}]+')) AS run
  FROM documents),
counted AS (SELECT id, run, count(*) AS k FROM runs WHERE length(run) >= 6 GROUP BY id, run),
bytes AS (
  SELECT run, k, flatten(list_transform(string_split(id || ':' || run, ''), lambda c:
      CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [192 + (ord(c) >> 6), 128 + (ord(c) & 63)] END)) AS b
  FROM counted),
hashed AS (
  SELECT run, k, xor(list_reduce(list_prepend(4294967295::UBIGINT, b::UBIGINT[]),
                                 lambda c, x: xor(c >> 8, t[(xor(c, x) & 255)::BIGINT + 1])), 4294967295::UBIGINT) AS h
  FROM bytes, crc),
words AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word,
         sum(k)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND n >= 5),
gaps AS (SELECT word, n, i, left(word, i) AS head, substr(word, i + 2) AS tail FROM (
  SELECT word, n, unnest(range(length(word)))::INT AS i FROM words)),
pairs AS (
  SELECT a.word AS a, b.word AS b FROM gaps a JOIN gaps b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT g.word, w.word FROM gaps g JOIN words w ON w.word = g.head || g.tail
  UNION SELECT w.word, g.word FROM gaps g JOIN words w ON w.word = g.head || g.tail),
best AS (
  SELECT a AS word, count(*) AS n_near, first(b ORDER BY w.n DESC, b) AS near, max(w.n) AS near_n
  FROM pairs JOIN words w ON w.word = b GROUP BY a),
formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form,
         CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM words LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS place, 0 AS steps FROM formed
  UNION ALL SELECT c.word, f.form, steps + 1 FROM chain c JOIN formed f ON f.word = c.place WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(place, steps) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""


@query
def op12_vector_codes(spark, sf_dir):
    """16-byte codes of all vectors: 64 entries a part, two rounds."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")
    return vector_codes.compress(vectors, parts=16, entries=64, rounds=2, scale=256)


def _codes_sql(rounds=2):
    nearest = """
a{r} AS (
  SELECT r, label, p, x, min(struct_pack(d := d, e := e)).e AS e, min(d) AS d FROM (
    SELECT s.*, c.e, list_sum(list_transform(list_zip(x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM parts s JOIN c{r} c ON s.p = c.p) GROUP BY r, label, p, x)"""
    moved = """
m{r} AS (
  SELECT p, e, list(v ORDER BY i) AS c FROM (
    SELECT p, e, i, (sum(y) // count(*) - CASE WHEN sum(y) % count(*) < 0 THEN 1 ELSE 0 END)::BIGINT AS v FROM (
      SELECT p, e, generate_subscripts(x, 1) AS i, unnest(x) AS y FROM a{r}) GROUP BY p, e, i) GROUP BY p, e),
c{n} AS (SELECT p, e, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN m{r} m USING (p, e))"""
    steps = [part for r in range(rounds) for part in (nearest.format(r=r), moved.format(r=r, n=r + 1))]
    return """
WITH v AS (
  SELECT vec_id, label, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL
    AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
parts AS (
  SELECT r, label, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS x FROM v, range(16) g(p)),
first AS (
  SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (
    SELECT vec_id, arg_min(r, v) AS r FROM v WHERE vec_id IS NOT NULL GROUP BY vec_id ORDER BY vec_id LIMIT 64)),
c0 AS (SELECT p, e, x AS c FROM parts JOIN first USING (r)),""" + ",".join([*steps, nearest.format(r=rounds)]) + f""",
coded AS (
  SELECT r, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r, label),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY coded.label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN v USING (r), books
"""


ORACLES["op12_vector_codes"] = _codes_sql()


@query
def op13_quality(spark, sf_dir):
    """Quality score of every whole text; labels learned from the rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language_id.held_out("doc_id", 3, 1))
    labels = table(spark, sf_dir, "labels").where(~language_id.held_out("doc_id", 3, 1))
    return quality_classifier.score(docs, quality_classifier.fit(docs, labels), ["doc_id", "held_out"], threshold=0.5)
