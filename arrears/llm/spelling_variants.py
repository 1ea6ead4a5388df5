"""Spelling variant grouping by dense prefix-suffix tiling.

Two different words are one edit apart exactly when their common prefix plus their common suffix
reach the longer length minus one (and the lengths differ by at most one). So one of the two is at
least half as long as the word: near words share their first or their last half. Every word goes to
the groups of its halves; groups are laid out as padded code-point matrices, and blocks of rows are
compared with each other, column by column.

Scale: counting is a plain Spark aggregation over all runs. Groups are dealt to buckets whose number
follows the number of rows; a group beyond PART_WORDS words is dealt to tiles of two parts each, so no
task sees more than two parts of a hot group. Each bucket sends on one row per word, not its pairs.

Odd rows: null and empty texts have no runs; a null id counts as empty text; repeated rows count as
often as they stand there; other columns are not read. Ties between near words of equal count go to
the smaller word in code-point order. Words of any length are compared; a block of very long words
holds fewer rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrears.llm.common import stash

RUN = r"[A-Za-zÀ-ÿ]+"
PART_WORDS = 1024  # words of one part of a hot group
BUCKET_ROWS = 1 << 16
BLOCK_ROWS = 128
BLOCK_CELLS = 1 << 22  # code points of one block's matrix

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TALLY = "word string, n_near long, minus_n long, near string"


def count_words(docs: DataFrame, least_length: int = 6, least_count: int = 5, slip: int = 199,
                doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct words of the whole texts with their occurrences: (word, n).

    A run loses one code point where ``slip`` divides the crc32 of ``<doc_id>:<run>``.
    """
    runs = docs.select(
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), F.col("run")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    slipped = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run")))
    words = runs.where(F.char_length("run") >= least_length).withColumn("h", h).select(
        F.when(F.col("h") % slip == 0, slipped).otherwise(F.col("run")).alias("word"))
    return (words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
            .where(F.col("n") >= least_count))


def _grouped(words: DataFrame) -> DataFrame:
    """One row for each group of a word: class, side and shared half.

    Class 2 L holds words of length L, class 2 L + 1 those of lengths L and L + 1; the half is
    what one edit must leave at one end.
    """
    length = F.char_length("word")

    def half(cls, size, side):
        text = F.col("word").substr(F.lit(1), size) if side == 0 else F.col("word").substr(length - size + 1, size)
        return F.struct(cls.alias("cls"), F.lit(side).alias("side"), text.alias("half"))

    half_down, half_up = F.floor(length / 2).cast("int"), F.ceil(length / 2).cast("int")
    kinds = [(length * 2, half_down), (length * 2 + 1, half_up), (length * 2 - 1, half_down)]
    return words.select("word", "n", F.explode(F.array(*(half(c, s, side) for c, s in kinds for side in (0, 1))))
                        .alias("g")).select("word", "n", "g.*")


def _tiled(rows: DataFrame, n_rows: int, part_words: int) -> DataFrame:
    """Groups dealt to tiles (pairs of parts; most groups are one part) and tiles to buckets."""
    key = ["cls", "side", "half"]
    big = rows.groupBy(*key).agg(F.count("*").alias("size")).where(F.col("size") > 2 * part_words)
    parts = F.coalesce(F.ceil(F.col("size") / part_words).cast("int"), F.lit(1))
    dealt = (rows.join(big, key, "left").withColumn("parts", parts)
             .withColumn("part", F.pmod(F.xxhash64("word"), "parts").cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select(*key, F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "word", "n"))
    buckets = max(1, -(-n_rows // BUCKET_ROWS))
    return dealt.withColumn("bucket", F.pmod(F.xxhash64(*key, "i", "j"), F.lit(buckets)).cast("int"))


def _code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points, and the offsets of the words."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    return (points.astype(np.uint8) if len(points) and points.max() < 256 else points), offsets


def _matrix(points: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int, right: bool) -> np.ndarray:
    """Words as rows of code points, aligned left or right (then reversed), padded with zeros."""
    at = np.arange(width)
    place = end[:, None] - 1 - at if right else begin[:, None] + at
    inside = (place >= begin[:, None]) & (place < end[:, None])
    return np.where(inside, points[np.clip(place, 0, len(points) - 1)], 0)


def _common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of every row of a with every row of b, at most ``most``."""
    out = np.zeros(most.shape, np.int32)
    alive = most > 0
    for k in range(a.shape[1]):
        alive &= (a[:, k][:, None] == b[:, k][None, :]) & (most > k)
        if not alive.any():
            break
        out += alive
    return out


def near_pairs(words: list[str], group: np.ndarray, part: np.ndarray, across: np.ndarray, cls: np.ndarray,
               side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (a < b) one edit apart within groups; rows stand by group, groups by class and side.

    ``across`` rows are compared with those of the other part only. A pair that shares a prefix
    half is left out where the group shares a suffix half, as it is found in the other group.
    """
    points, offsets = _code_points(words)
    begin, end = offsets[:-1], offsets[1:]
    length = end - begin
    found = [(np.zeros(0, int), np.zeros(0, int))]
    segment = np.flatnonzero(np.r_[True, (cls[1:] != cls[:-1]) | (side[1:] != side[:-1]), True])
    for low, high in zip(segment[:-1], segment[1:]):
        width = int(length[low:high].max())
        of_pair = int(cls[low]) % 2 == 1  # lengths L and L + 1
        half = (int(cls[low]) // 2 + of_pair) // 2
        step = max(1, min(BLOCK_ROWS, BLOCK_CELLS // max(1, width)))
        for a in range(low, high, step):
            a_end = min(a + step, high)
            last = int(np.searchsorted(group[low:high], group[a_end - 1], "right")) + low
            left = [_matrix(points, begin[a:a_end], end[a:a_end], width, r) for r in (False, True)]
            for b in range(a, last, step):
                b_end = min(b + step, last)
                mask = group[a:a_end, None] == group[None, b:b_end]
                mask &= ~across[a:a_end, None] | (part[a:a_end, None] != part[None, b:b_end])
                la, lb = length[a:a_end, None], length[None, b:b_end]
                if of_pair:
                    mask &= la != lb
                if a == b:
                    mask = np.triu(mask, 1)
                if not mask.any():
                    continue
                right = left if a == b and a_end == b_end else [
                    _matrix(points, begin[b:b_end], end[b:b_end], width, r) for r in (False, True)]
                most = np.where(mask, np.minimum(la, lb), 0)
                prefix = _common(left[0], right[0], most)
                if side[low]:
                    mask &= prefix < half
                mask &= prefix + _common(left[1], right[1], most) >= np.maximum(la, lb) - 1
                i, j = np.nonzero(mask)
                found.append((i + a, j + b))
    return tuple(np.concatenate(x) for x in zip(*found))


def _tally(rows: pa.Table) -> pa.Table:
    """Per word of a bucket: near words found here, the largest count among them and its smallest word."""
    key = ["cls", "side", "half", "i", "j"]
    rows = rows.combine_chunks().sort_by([(k, "ascending") for k in (*key, "word")])
    names = rows["word"].to_pylist()
    codes = [rows["half"].combine_chunks().dictionary_encode().indices.to_numpy() if k == "half" else rows[k].to_numpy()
             for k in key]
    change = np.any([c[1:] != c[:-1] for c in codes], axis=0)
    group = np.concatenate([[0], np.cumsum(change)])
    a, b = near_pairs(names, group, rows["part"].to_numpy(), codes[3] != codes[4], codes[0], codes[1])
    one, other = np.concatenate([a, b]), np.concatenate([b, a])
    distinct, word_of = np.unique(np.array(names, dtype=object), return_inverse=True)  # in code-point order
    one, near = word_of[one], word_of[other]
    n = rows["n"].to_numpy()[other]
    order = np.lexsort((near, -n, one))
    one, near, n = one[order], near[order], n[order]
    first = np.flatnonzero(np.r_[True, one[1:] != one[:-1]]) if len(one) else np.zeros(0, int)
    return pa.table({"word": pa.array(distinct[one[first]], pa.string()),
                     "n_near": np.diff(np.r_[first, len(one)]).astype(np.int64),
                     "minus_n": -n[first], "near": pa.array(distinct[near[first]], pa.string())})


def near_words(words: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """Per word of ``words(word, n)`` (distinct words) that has near words: (word, n_near, near, near_n)."""
    rows = _grouped(words)
    tallies = _tiled(rows, 6 * words.count(), part_words).groupBy("bucket").applyInArrow(_tally, _TALLY)
    best = F.min(F.struct("minus_n", "near"))
    return (tallies.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
            .select("word", "n_near", "best.near", (-F.col("best.minus_n")).alias("near_n")))


def roots(forms: DataFrame) -> DataFrame:
    """Last word of every chain of ``forms(word, form)``: (word, root), by pointer doubling.

    Counts grow fivefold along a chain, so there are few rounds; each is written to the shared folder.
    """
    current = stash(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if current.join(ahead, "root", "left_semi").isEmpty():
            return current
        current = stash(current.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")))


def spelling_variants(words: DataFrame, times: int = 5, part_words: int = PART_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``words(word, n)``, distinct words with their counts.

    ``form`` is the near word of largest count if that is at least ``times`` the word's own.
    """
    words = stash(words)
    known = words.join(near_words(words, part_words), "word", "left")
    is_form = F.col("near_n") >= times * F.col("n")
    known = stash(known.select("word", F.when(is_form, F.col("near")).alias("form"), "n",
                               F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                               F.when(is_form, F.col("near_n")).alias("form_n")))
    ends = roots(known.where("form is not null").select("word", "form"))
    return known.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
