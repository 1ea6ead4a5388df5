"""Toxicity by compression distance with zstandard dictionaries.

Two dictionaries are trained: one on windows of ordinary text, one on the stretches of toxic text
that ordinary text lacks: runs of byte 5-grams inside words, and whole words, whose document
frequency among toxic rows is far above that among ordinary rows. A toxic word may be an ordinary
stem with an ordinary ending, none of whose bytes is rare in ordinary text; so every word of a text
is followed by a mark (6 bytes of a hash of the whole word), and whole words enter the dictionary
as their marks, which nothing but the same word matches. Every window of a text is compressed twice: with the
ordinary dictionary, and with the ordinary dictionary followed by the toxic one. The first is
followed by as many bytes that match nothing, so distances into the ordinary part cost the same
and the two lengths differ only by what the toxic dictionary saves. A logistic calibration turns a
text's largest and total savings into a score.

Scale: grams, stretches, windows and features are counted by Spark over a bounded sample of
labelled rows (documented parameters), whose texts are read whole; only grams and words that pass the test (each
stands in at least one of a hundred toxic rows, so their number does not grow with the table), the dictionaries
of groups of ordinary texts, and feature rows reach the driver. Scoring is a map over all whole texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arrears.llm.common import hash_sample, stash

WINDOW, STRIDE = 96, 64
GRAM = 5
MARK = 6  # not the length of a gram: both are counted together
ROWS_PER_CLASS = 8000  # labelled rows used for learning
ORDINARY_BYTES = 32_768
GROUP_BYTES = 1 << 21  # ordinary text that one group dictionary is trained on
PIECE, OVERLAP = 200, 48  # bytes; longer words (scripts without spaces) are learned in pieces
THRESHOLDS = (2, 4)  # savings in bytes from which a window counts
# ASCII white space and punctuation become spaces, A-Z lower case
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def plain(text: str | None) -> bytes:
    """Words of the text, lower case, with one space around each; empty for none."""
    words = (text or "").encode().translate(_PLAIN).split()
    return b" " + b" ".join(words) + b" " if words else b""


def word_mark(word: bytes) -> bytes:
    return xxhash.xxh3_64_digest(word)[:MARK]


class _Marked(dict):
    """Words with one space before them and their mark after them (long words are not kept)."""

    def __missing__(self, word: bytes) -> bytes:
        known = b" " + word + b" " + word_mark(word)
        if len(word) <= PIECE:
            self[word] = known
        return known


_with_mark = _Marked()


def marked_text(text: bytes) -> bytes:
    """Every word of a plain text with one space around it and its mark after it."""
    if len(_with_mark) >= 100_000:
        _with_mark.clear()
    return b"".join(map(_with_mark.__getitem__, text.split()))


def windows(text: bytes) -> list[bytes]:
    return [text[i:i + WINDOW] for i in range(0, max(1, len(text) - WINDOW + STRIDE), STRIDE)] if text else []


def _pieces(word: bytes) -> list[bytes]:
    """The word with the spaces around it; a long one in overlapping pieces that begin at characters."""
    framed = b" " + word + b" "
    if len(framed) <= PIECE:
        return [framed]
    out, at = [], 0
    while True:
        end = at + PIECE
        while end < len(framed) and framed[end] & 0xC0 == 0x80:
            end -= 1
        out.append(framed[at:end])
        if end >= len(framed):
            return out
        at = end - OVERLAP
        while framed[at] & 0xC0 == 0x80:
            at -= 1


def _grams(piece: bytes) -> list[bytes]:
    return [piece[i:i + GRAM] for i in range(len(piece) - GRAM + 1)]


def stretches(word: bytes, marked: dict[bytes, int]) -> list[bytes]:
    """Maximal parts of the word (with the spaces around it) covered by overlapping marked grams.

    Only grams at least half as common as the word's most common one count: a stem, not its endings.
    """
    out = []
    for framed in _pieces(word):
        strength = [marked.get(gram, 0) for gram in _grams(framed)]
        least = max(1, max(strength, default=0) / 2)
        begin = end = None
        for i, n in enumerate(strength):
            if n >= least:
                if begin is None:
                    begin = i
                end = i + GRAM
            elif begin is not None and i >= end:
                out.append(framed[begin:end])
                begin = None
        if begin is not None:
            out.append(framed[begin:end])
    return out


def _dictionary(samples: list[bytes]) -> bytes:
    """The samples, commonest first, laid end to end with the commonest last, where distances are shortest.

    Samples that stand inside another one are not repeated.
    """
    whole = b"\0".join(sorted(samples, key=lambda x: (-len(x), x)))
    return b"".join([sample for sample in samples if whole.count(sample) == 1][::-1])


@dataclass
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the scaled features, then the constant
    _compressors: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_compressors"} | {"_compressors": []}

    def savings(self, parts: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves on each window."""
        if not parts:
            return np.zeros(0)
        if not self._compressors:
            # distances reach back over both dictionaries and a window
            reach = len(self.ordinary) + len(self.toxic) + WINDOW
            params = zstandard.ZstdCompressionParameters(
                compression_level=6, window_log=max(17, reach.bit_length()), min_match=4, search_log=4, strategy=zstandard.STRATEGY_BTLAZY2,
                format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False,
                write_checksum=False)
            for content in (self.ordinary + b"\xff" * len(self.toxic), self.ordinary + self.toxic):
                known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                known.precompute_compress(compression_params=params)
                self._compressors.append(zstandard.ZstdCompressor(dict_data=known, compression_params=params))
        plain_len, toxic_len = (np.array([len(x) for x in c.multi_compress_to_buffer(parts)])
                                for c in self._compressors)
        return (plain_len - toxic_len).astype(float)

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Per text: largest saving, sum of the three largest, log of the total, mean, windows above each threshold."""
        split = [windows(marked_text(plain(t))) for t in texts]
        every = self.savings([w for s in split for w in s])
        out = np.zeros((len(texts), 4 + len(THRESHOLDS)))
        at = 0
        for row, parts in enumerate(split):
            if parts:
                saved = np.sort(every[at:at + len(parts)])[::-1]
                at += len(parts)
                out[row] = [saved[0], saved[:3].sum(), np.log1p(np.maximum(saved, 0).sum()), saved.mean(),
                            *(np.log1p((saved >= t).sum()) for t in THRESHOLDS)]
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        z = (self.features(texts) - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _trained(size: int, samples: list[bytes]) -> bytes:
    """A zstandard dictionary's bytes; too few samples to train on are used as they are."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.full(x.shape[1], penalty * weight.sum())
    ridge[-1] = 1e-9
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge), slope)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> ToxicityModel | None:
    """Learn from ``labels(doc_id, toxic)`` of 0 and 1 and the texts of ``docs(doc_id, text)``.

    Uses at most ``rows_per_class`` labelled ids of each class, by hash of the id; an id labelled
    more than once counts as toxic if any label is, and of several texts with one id the first in string
    order is learned from. None unless both classes have text.
    """
    known = (labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id")
             .agg(F.max("toxic").cast("int").alias("toxic")))
    wanted = hash_sample(known, "doc_id", "toxic", rows_per_class).select("doc_id", "toxic", "total")
    # at most 2 * rows_per_class rows of three numbers: a bounded broadcast
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(wanted), "doc_id")
    # one text of an id that many documents share
    rows = stash(rows.groupBy("doc_id", "toxic", "total").agg(F.min("text").alias("text")))
    sizes = {r["toxic"]: (r["n"], r["total"]) for r in
             rows.groupBy("toxic").agg(F.count("*").alias("n"), F.max("total").alias("total")).toLocalIterator()}
    if set(sizes) != {0, 1}:
        return None
    n_toxic, n_plain = sizes[1][0], sizes[0][0]

    def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        of_word: dict[bytes, list[bytes]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = set()
                for word in set(plain(text).split()):
                    if word not in of_word:
                        of_word[word] = [word_mark(word), *(g for p in _pieces(word) for g in _grams(p))]
                    found.update(of_word[word])
                seen[toxic].update(found)
                if len(of_word) > 200_000:
                    of_word.clear()
            if len(seen[0]) + len(seen[1]) > 500_000:
                yield gram_rows(seen)
                seen = (Counter(), Counter())
        yield gram_rows(seen)

    def gram_rows(seen) -> pa.RecordBatch:
        grams = list(set(seen[0]) | set(seen[1]))
        return pa.RecordBatch.from_arrays([pa.array(grams, pa.binary()),
                                           *(pa.array([s[g] for g in grams], pa.int64()) for s in seen)],
                                          ["gram", "plain", "toxic"])

    odds = (F.log((F.col("toxic") + 0.5) / F.lit(n_toxic + 1.0)) - F.log((F.col("plain") + 0.5) / F.lit(n_plain + 1.0)))
    least = max(3, n_toxic // 100)
    strong = (rows.select("text", "toxic").mapInArrow(gram_counts, "gram binary, plain long, toxic long")
              .groupBy("gram").agg(F.sum("plain").alias("plain"), F.sum("toxic").alias("toxic"))
              .where((F.col("toxic") >= least) & (odds > 3.0))
              .select("gram", "toxic").toArrow())
    marked = dict(zip(strong["gram"].to_pylist(), strong["toxic"].to_pylist()))

    def stretch_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = set(plain(text).split())
                seen.update({s for word in words for s in stretches(word, marked)})
                seen.update({m for word in words if (m := word_mark(word)) in marked})
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())],
                                         ["stretch", "n"])

    top = (rows.where("toxic = 1").select("text").mapInArrow(stretch_counts, "stretch binary, n long")
           .groupBy("stretch").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
           .orderBy(F.desc("n"), "stretch").toArrow())

    def ordinary_dictionary(group: pa.Table) -> pa.Table:
        texts = group.sort_by("doc_id")["text"].to_pylist()
        content = _trained(ORDINARY_BYTES, [w for t in texts for w in windows(marked_text(plain(t)))])
        return pa.table({"group": group["group"][:1], "content": pa.array([content], pa.binary())})

    # whole texts in groups dealt by id, so that the dictionary does not depend on the partitions
    ordinary = rows.where("toxic = 0")
    size = ordinary.agg(F.sum(F.octet_length("text"))).first()[0]
    group = F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(max(1, -(-size // GROUP_BYTES))))
    contents = sorted(ordinary.select("doc_id", "text", group.alias("group")).groupBy("group")
                      .applyInArrow(ordinary_dictionary, "group long, content binary").toArrow()["content"].to_pylist())
    trained = contents[0] if len(contents) == 1 else _trained(
        ORDINARY_BYTES, [c[k:k + WINDOW] for c in contents for k in range(0, len(c), WINDOW)])
    model = ToxicityModel(trained, _dictionary(top["stretch"].to_pylist()),
                          np.zeros(0), np.zeros(0), np.zeros(0))

    def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                x = model.features(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), part.column(1)],
                                                 ["x", "toxic"])

    learned = rows.select("text", "toxic").mapInArrow(feature_rows, "x array<double>, toxic int").toArrow()
    x, y = np.array(learned["x"].to_pylist()), learned["toxic"].to_numpy().astype(float)
    model.mean, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    # classes count as often as among all labelled rows
    weight = np.where(y == 1, sizes[1][1] / n_toxic, sizes[0][1] / n_plain)
    model.weights = _logistic((x - model.mean) / model.scale, y, weight / weight.mean())
    return model


def score(docs: DataFrame, model: ToxicityModel | None, carry: list[str], threshold: float = 0.3,
          text: str = "text") -> DataFrame:
    """The ``carry`` columns of ``docs`` with score (0 to 1) and predicted, from each row's whole text.

    Null and empty texts have no windows and get the score of savings of zero; without a model
    every score is 0.
    """
    schema = T.StructType([docs.schema[c] for c in carry]).add("score", "double").add("predicted", "integer")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                texts = part.column(0).to_pylist()
                s = np.zeros(len(texts)) if model is None else model.scores(texts)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.array(s), pa.array((s >= threshold).astype(np.int32))], schema.names)

    return docs.select(F.col(text).alias("_text"), *carry).mapInArrow(scored, schema)
