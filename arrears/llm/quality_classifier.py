"""Quality by compression: zstandard dictionaries of good and of bad text, and a calibrated difference.

Labelled rows are sampled by hash of their id. Half of the sample trains the dictionaries: the texts of
each class are dealt to groups, each group trains a dictionary on all windows of its whole texts,
and the class's dictionary is trained on those. Every window of a text is compressed with
both; (bad - good) / (bad + good) is the normalised difference of the two lengths. A text has this
difference over all its windows, its mean over the windows, the share of windows that the bad
dictionary fits better, and the better length against the text's. A logistic calibration on the other half
of the sample turns them into a score from 0 to 1.

Scale: the sample's size is a documented parameter; its texts are read whole, in groups. The driver
sees group dictionaries and feature rows of the sample. Scoring is a map over whole texts; windows
are compressed a megabyte at a time, so a very long text needs no more memory than its bytes.

Odd rows: null and empty texts have no windows and get the score of all features zero. Labels other
than 0 and 1 are not read; an id labelled both ways counts as bad; of several texts with
one labelled id, the first in string order is learned from. Repeated rows are scored alike. Input
columns named like the output (score, predicted) are left out of ``carry``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arrears.llm.common import stash

WINDOW = 512
SAMPLE_WINDOW = 256  # of dictionary training
DICTIONARY_BYTES = 65_536
ROWS_PER_CLASS = 4000  # expected size of the sample of each class
GROUP_BYTES = 1 << 21  # text of both classes that trains one pair of group dictionaries
STEP_WINDOWS = 2048  # compressed at once
LEVEL = 3
FEATURES = 4


def _windows(raw: bytes, size: int) -> list[bytes]:
    return [raw[i:i + size] for i in range(0, len(raw), size)]


def trained_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary's bytes; too few samples to train on are used as they are."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the scaled features, then the constant
    _compressors: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_compressors"} | {"_compressors": []}

    def lengths(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Compressed length of each window with the good and with the bad dictionary."""
        if not self._compressors:
            params = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False,
                write_checksum=False)
            for content in (self.good, self.bad):
                known = zstandard.ZstdCompressionDict(content)
                known.precompute_compress(compression_params=params)
                self._compressors.append(zstandard.ZstdCompressor(dict_data=known, compression_params=params))
        good, bad = (np.array([len(x) for x in c.multi_compress_to_buffer(parts)], float) for c in self._compressors)
        return good, bad

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Per text: difference over all windows, its mean, share of bad windows, log of the compression ratio."""
        sums = np.zeros((len(texts), 6))  # good, bad, difference, bad windows, windows, bytes
        held, rows = [], []

        def flush():
            if held:
                good, bad = self.lengths(held)
                gap = (bad - good) / (bad + good)
                columns = (good, bad, gap, gap < 0, np.ones(len(held)), [len(w) for w in held])
                np.add.at(sums, np.array(rows), np.column_stack(columns))
                held.clear()
                rows.clear()

        for row, text in enumerate(texts):
            raw = (text or "").encode()
            for at in range(0, len(raw), WINDOW):
                held.append(raw[at:at + WINDOW])
                rows.append(row)
                if len(held) >= STEP_WINDOWS:
                    flush()
        flush()
        good, bad, gap, worse, windows, size = sums.T
        some, out = windows > 0, np.zeros((len(texts), FEATURES))
        out[some] = np.column_stack([
            (bad - good)[some] / (bad + good)[some], gap[some] / windows[some], worse[some] / windows[some],
            np.log(np.minimum(good, bad)[some] / size[some])])
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        z = (self.features(texts) - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression of y on x, the constant last."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.full(x.shape[1], penalty * weight.sum())
    ridge[-1] = 1e-9
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge),
                               x.T @ (weight * (y - p)) - ridge * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _sample(docs: DataFrame, labels: DataFrame, rows_per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, quality, text, half) of about ``rows_per_class`` labelled ids of each class; all ids by class."""
    known = (labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id")
             .agg(F.min("quality").cast("int").alias("quality")))
    totals = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if set(totals) != {0, 1}:
        return known, totals
    place = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.when(F.col("quality") == 1, F.lit(rows_per_class / totals[1])).otherwise(F.lit(rows_per_class / totals[0]))
    half = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(2)).cast("int")
    wanted = known.where(place < share).withColumn("half", half)
    # about 2 * rows_per_class rows of three numbers: a bounded broadcast
    rows = docs.select("doc_id", "text").where("text is not null and text <> ''").join(F.broadcast(wanted), "doc_id")
    return stash(rows.groupBy("doc_id", "quality", "half").agg(F.min("text").alias("text"))), totals


def _dictionaries(rows: DataFrame) -> tuple[bytes, bytes]:
    """The good and the bad dictionary from (doc_id, text, quality); groups follow the id, not the partitions."""
    def train(group: pa.Table) -> pa.Table:
        texts = group.sort_by("doc_id")["text"].to_pylist()
        content = trained_dictionary([w for t in texts for w in _windows(t.encode(), SAMPLE_WINDOW)])
        return pa.table({"quality": group["quality"][:1], "content": pa.array([content], pa.binary())})

    size = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    group = F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(-(-size // GROUP_BYTES)))
    contents = (rows.withColumn("group", group).groupBy("quality", "group")
                .applyInArrow(train, "quality int, content binary").toArrow().to_pylist())
    made = []
    for quality in (1, 0):
        of_class = sorted(g["content"] for g in contents if g["quality"] == quality)
        made.append(of_class[0] if len(of_class) == 1 else
                    trained_dictionary([w for c in of_class for w in _windows(c, SAMPLE_WINDOW)]))
    return made[0], made[1]


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> QualityModel | None:
    """Learn from ``labels(doc_id, quality)`` and the texts of ``docs(doc_id, text)``.

    None unless both halves of the sample hold texts of both classes.
    """
    rows, totals = _sample(docs, labels, rows_per_class)
    if set(totals) != {0, 1}:
        return None
    sizes = {(r["half"], r["quality"]): r["n"] for r in rows.groupBy("half", "quality").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 4:
        return None
    good, bad = _dictionaries(rows.where("half = 0"))
    model = QualityModel(good, bad, np.zeros(0), np.zeros(0), np.zeros(0))

    def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = model.features(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), batch.column(1)],
                                             ["x", "quality"])

    learned = rows.where("half = 1").select("text", "quality").mapInArrow(feature_rows, "x array<double>, quality int").toArrow()
    x, y = np.array(learned["x"].to_pylist()), learned["quality"].to_numpy().astype(float)
    order = np.lexsort(x.T)  # the same sums however the rows came in
    x, y = x[order], y[order]
    model.mean, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    # classes count as often as among all labelled ids
    weight = np.where(y == 1, totals[1] / sizes[1, 1], totals[0] / sizes[1, 0])
    model.weights = calibrated((x - model.mean) / model.scale, y, weight / weight.mean())
    return model


def score(docs: DataFrame, model: QualityModel | None, carry: list[str], threshold: float = 0.5,
          text: str = "text") -> DataFrame:
    """The ``carry`` columns of ``docs`` with score (0 to 1, higher is better) and predicted.

    Without a model every score is 0.5.
    """
    carry = [c for c in carry if c not in ("score", "predicted")]
    schema = T.StructType([docs.schema[c] for c in carry]).add("score", "double").add("predicted", "integer")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = part.column(0).to_pylist()
                s = np.full(len(texts), 0.5) if model is None else model.scores(texts)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.array(s), pa.array((s >= threshold).astype(np.int32))], schema.names)

    return docs.select(F.col(text).alias("_text"), *carry).mapInArrow(scored, schema)
