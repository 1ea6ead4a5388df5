"""Language identification with a string kernel, Nyström landmarks and kernel ridge regression.

Kernel: the blended spectrum of a text is the set of its letter n-grams (n = 1, 2, 3; letters lower
case, everything else a word border), hashed into 2**16 buckets; only presence counts, so a long
text weighs no more than a short one. k(x, y) = common grams / sqrt(grams of x * grams of y), over
the grams that occur in a landmark. Landmarks are training texts; the Nyström map turns kernel rows
against them into features, and one ridge regression per language against the rest is solved on
them. A score is linear in the kernel row, and that in the presence vector, so the landmarks fold
into one matrix (grams x languages) and a batch of texts is scored by one matrix product.

Scale: training reads a sample bounded per language (documented parameters); its presence vectors
(8 KB each) reach the driver, no texts. Scoring is a map over all rows with the folded matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arrears.llm.common import hash_sample, text_views

BITS = 16
BUCKETS = 1 << BITS
TRAIN_PER_LANGUAGE = 300
LANDMARKS_PER_LANGUAGE = 64
RIDGE = 1e-3
SHARPNESS = 4.0  # of the softmax over the languages' regression outputs
ROWS_AT_ONCE = 256
UNDETERMINED = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """For every code point its lower-case letter, or 0 where it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        char = chr(c)
        if char.isalpha():
            out[c] = ord(char.lower()[0])
    return out


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of every n-gram of the rows' texts, one pair of arrays for each n."""
    at_char = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offsets]
    chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    code = _letters()[chars].astype(np.uint64)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(at_char))
    key = np.zeros(len(code), np.uint64)
    for n in (1, 2, 3):
        if len(code) < n:
            return
        key = (key[:len(code) - n + 1] + code[n - 1:]) * np.uint64(0x9E3779B97F4A7C15)
        letter = (code[n - 1:] > 0) if n == 1 else (code[:len(code) - n + 1] > 0) | (code[n - 1:] > 0)
        whole = letter & (row[:len(row) - n + 1] == row[n - 1:])
        yield row[:len(row) - n + 1][whole], ((key + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)
                                              >> np.uint64(64 - BITS)).astype(np.int32)[whole]


def presence(data: np.ndarray, offsets: np.ndarray, column: np.ndarray, width: int) -> np.ndarray:
    """0/1 matrix: which of the ``width`` gram columns each row has (``column`` of a bucket, or -1)."""
    out = np.zeros((len(offsets) - 1, width + 1), np.uint8)  # the last column takes the others
    for row, bucket in grams(data, offsets):
        out[row, column[bucket]] = 1
    return out[:, :width]


def _row_groups(data: np.ndarray, offsets: np.ndarray):
    for a in range(0, len(offsets) - 1, ROWS_AT_ONCE):
        b = min(a + ROWS_AT_ONCE, len(offsets) - 1)
        yield a, data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]


@dataclass
class LanguageModel:
    languages: list[str]
    column: np.ndarray  # bucket -> column of weights, -1 where no landmark has the gram
    weights: np.ndarray  # grams x languages
    bias: np.ndarray

    def outputs(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Regression outputs, rows x languages."""
        x = presence(data, offsets, self.column, len(self.weights)).astype(np.float32)
        return x @ self.weights / np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None] + self.bias


def fit(labelled: DataFrame, per_language: int = TRAIN_PER_LANGUAGE,
        landmarks: int = LANDMARKS_PER_LANGUAGE, ridge: float = RIDGE) -> LanguageModel | None:
    """Learn from ``labelled(key, text, lang)``; rows without text, letters or lang are left out.

    None if nothing is left to learn from.
    """
    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.arange(BUCKETS, dtype=np.int32)
        for batch in batches:
            for first, data, offsets in text_views(batch.column(0)):
                for a, part, at in _row_groups(data, offsets):
                    packed = np.packbits(presence(part, at, every, BUCKETS), axis=1)
                    rows = slice(first + a, None)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(1)[rows][:len(packed)], batch.column(2)[rows][:len(packed)],
                         pa.array([p.tobytes() for p in packed], pa.binary())], ["lang", "place", "bits"])

    rows = labelled.where("text is not null and lang is not null")
    sample = (hash_sample(rows, "key", "lang", per_language).select("text", "lang", "place")
              .mapInArrow(bits, "lang string, place int, bits binary")
              .toArrow().sort_by([("lang", "ascending"), ("place", "ascending")]))
    if not len(sample):
        return None
    x = np.unpackbits(np.frombuffer(b"".join(sample["bits"].to_pylist()), np.uint8).reshape(len(sample), -1), axis=1)
    some = x.any(axis=1)
    x, lang, place = x[some], np.array(sample["lang"].to_pylist())[some], sample["place"].to_numpy()[some]
    if not len(x):
        return None
    languages = sorted(set(lang.tolist()))
    marks = place <= landmarks if (place <= landmarks).any() else np.ones(len(x), bool)
    used = np.flatnonzero(x[marks].any(axis=0))
    column = np.full(BUCKETS, -1, np.int32)
    column[used] = np.arange(len(used))
    x = x[:, used].astype(np.float64)
    x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
    values, vectors = np.linalg.eigh(x[marks] @ x[marks].T)
    strong = values > 1e-8 * values.max()
    to_features = vectors[:, strong] / np.sqrt(values[strong])
    features = np.hstack([x @ x[marks].T @ to_features, np.ones((len(x), 1))])
    target = np.where(lang[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    weight = (len(lang) / np.array([np.sum(lang == v) for v in lang]))[:, None]  # languages count alike
    penalty = np.eye(features.shape[1]) * ridge * len(x)
    penalty[-1, -1] = 1e-9
    solved = np.linalg.solve(features.T @ (features * weight) + penalty, features.T @ (target * weight))
    return LanguageModel(languages, column, (x[marks].T @ (to_features @ solved[:-1])).astype(np.float32),
                         solved[-1].astype(np.float32))


def identify(docs: DataFrame, model: LanguageModel | None, carry: list[str], text: str = "text") -> DataFrame:
    """The ``carry`` columns of ``docs`` with lang_pred and score (0 to 1), from each row's whole text.

    Texts that are null or have no letter, and all texts without a model, are ``und`` with score 0.
    """
    schema = T.StructType([docs.schema[c] for c in carry]).add("lang_pred", "string").add("score", "double")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for _, data, offsets in text_views(batch.column(0)):
                letter = _letters()
                for _, part, at in _row_groups(data, offsets):
                    chars = np.frombuffer(part.tobytes().decode().encode("utf-32-le"), np.uint32)
                    ends = np.r_[0, np.cumsum(letter[chars] > 0)][np.r_[0, np.cumsum((part & 0xC0) != 0x80)][at]]
                    some = np.diff(ends) > 0
                    if model is None:
                        some[:] = False
                        best, share = np.zeros(len(some), int), np.zeros(len(some))
                    else:
                        out = model.outputs(part, at).astype(float) * SHARPNESS
                        odds = np.exp(out - out.max(axis=1, keepdims=True))
                        best, share = odds.argmax(axis=1), odds.max(axis=1) / odds.sum(axis=1)
                    names += [model.languages[b] if s else UNDETERMINED for b, s in zip(best, some)]
                    scores.append(np.where(some, share, 0.0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(names, pa.string()), pa.array(np.concatenate(scores or [np.zeros(0)]))],
                schema.names)

    return docs.select(F.col(text).alias("_text"), *carry).mapInArrow(predict, schema)


def held_out(doc_id: str, folds: int, fold: int) -> F.Column:
    """True for rows of the fold, by crc32 of the id as text (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds == fold
