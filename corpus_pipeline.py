"""Corpus pipeline: stages over ``documents``, each written as Parquet and reread by the next.

Every stage works on all that its predecessor kept and returns the columns of ``documents``; the
last returns packed pieces. Models are trained inside the stage, on the texts of its input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrears.llm import jaccard_join, language_id, packing, suffix_dedup, toxicity
from arrears.llm.common import ship_package, stash, table
from arrears.llm.queries import RANKS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_LANGUAGE_SCORE = 0.3  # of four languages; less sure than this is no known language
TOXIC_FROM = 0.3  # as op9_toxicity decides


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without letters or without a clear language go."""
    ship_package(spark)
    model = language_id.fit(docs.select(F.col("doc_id").alias("key"), "text", "lang"))
    found = language_id.identify(docs, model, COLUMNS)
    if model is None:  # nothing to learn from: nothing to reject
        return docs.select(*COLUMNS)
    least = max(LEAST_LANGUAGE_SCORE, 1.05 / len(model.languages)) if len(model.languages) > 1 else 0.0
    known = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= least)
    return found.where(known).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents whose score reaches TOXIC_FROM go."""
    labels = table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.fit(docs, labels), COLUMNS, threshold=TOXIC_FROM)
    return scored.where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of near duplicates the row with the smallest doc_id stays.

    Every row is judged by its own text, under a number made of all its columns (a 64-bit hash): rows that
    share an id with another text stay, of equal rows one. Documents without an id belong to no group and stay.
    """
    ship_package(spark)
    docs = docs.select(*COLUMNS)
    own = docs.where("doc_id is not null").withColumn("row_key", F.xxhash64(*COLUMNS))
    found = jaccard_join.jaccard_components(own.select(F.col("row_key").alias("doc_id"), "text"))
    groups = found.select(F.col("doc_id").alias("row_key"), F.col("component_id").alias("group")).distinct()
    first = (own.select("row_key", "doc_id").distinct().join(groups, "row_key")
             .groupBy("group").agg(F.min(F.struct("doc_id", "row_key")).alias("least")).select("least.row_key"))
    kept = own.join(first, "row_key", "left_semi").dropDuplicates(["row_key"]).select(*COLUMNS)
    return kept.unionByName(docs.where("doc_id is null"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: bytes of passages that a smaller document has go; all rows stay."""
    ship_package(spark)
    found = suffix_dedup.deduplicate(docs, ["doc_id", "lang", "source"])
    return found.select("doc_id", F.col("kept").alias("text"), "lang", "source",
                        F.length("kept").cast("long").alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of what is left into sequences of 1024 tokens."""
    ship_package(spark)
    return packing.pack(docs, RANKS)


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_passages),
    ("best_fit_packing", pack_sequences),
]
# trained models and a tokenizer cannot be expressed in SQL; tested against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the whole table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
