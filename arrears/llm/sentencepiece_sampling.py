"""SentencePiece segmentations sampled without replacement by a perturbed A* search.

A text's segmentations form a lattice of pieces; each has a weight, the product of its pieces'
weights (a piece counts 1 / (1 + rank) ** sharpness, by its rank in the model). Backward sums turn
the lattice into conditional probabilities. Every subtree of segmentations with a common beginning
gets the Gumbel-perturbed maximum of its members: the root's is drawn freely, the sampled child
inherits its parent's, and each sibling's is drawn below it. Taking subtrees off a queue by that
value yields distinct segmentations in order of perturbed score, which is a sample without
replacement; the value that comes after the last one gives each its inclusion probability.

Siblings are drawn one by one along the first NODES pieces after a branch; all that leaves the path
later is one entry with the remaining mass, taken apart in the same way when its turn comes.

Scale: a map over rows; random numbers are hashes of the row's key, so a row's samples are the same
in any partition and after any retry. Memory is bounded by a batch's distinct words and one row.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrears.llm.common import mix64

NODES = 32
CACHE_WORDS = 30_000
ROWS_AT_ONCE = 500
_SPACE = "▁"
_WORD = re.compile(f"\n|{_SPACE}*[^{_SPACE}\n]+|{_SPACE}+")
_models: dict[tuple[str, float], "PieceModel"] = {}


def normalized(text: str) -> str:
    """The model's form of a text: a space in front, spaces as U+2581; the empty text stays empty."""
    return _SPACE + text.replace(" ", _SPACE) if text else ""


class PieceModel:
    def __init__(self, model_file: str, sharpness: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = sp.get_piece_size()
        self.piece = [sp.id_to_piece(i) for i in range(size)]
        self.kind = ["byte" if sp.is_byte(i) else "control" if sp.is_control(i) or sp.is_unknown(i) else "text"
                     for i in range(size)]
        self.bytes = {int(self.piece[i][1:-1], 16): i for i in range(size) if self.kind[i] == "byte"}
        self.weight = {p: (i, -sharpness * float(np.log1p(-sp.get_score(i))))
                       for i, p in enumerate(self.piece) if self.kind[i] == "text"}
        self.byte_weight = -sharpness * float(np.log1p(size))
        self.longest = max(map(len, self.weight))
        self.words: dict[str, tuple] = {}

    def lattice(self, word: str) -> tuple:
        """(edges per place, end place, log of conditional probability, ids) of a word's lattice."""
        known = self.words.get(word)
        if known is not None:
            return known
        n = len(word)
        below = [0.0] * (n + 1)
        count, ends, logs, ids = [0] * n, [], [], []
        for at in range(n - 1, -1, -1):
            here = []
            for end in range(at + 1, min(n, at + self.longest) + 1):
                found = self.weight.get(word[at:end])
                if found is not None:
                    here.append((end, found[1] + below[end], (found[0],)))
            if not any(end == at + 1 for end, _, _ in here):  # no piece for this character: its bytes
                raw = word[at].encode()
                here.append((at + 1, self.byte_weight * len(raw) + below[at + 1], tuple(self.bytes[b] for b in raw)))
            top = max(w for _, w, _ in here)
            below[at] = top + float(np.log(sum(np.exp(w - top) for _, w, _ in here)))
            count[at] = len(here)
            for end, w, pieces in reversed(here):
                ends.append(end)
                logs.append(w - below[at])
                ids.append(pieces)
        known = (count, ends[::-1], logs[::-1], ids[::-1])
        if len(self.words) >= CACHE_WORDS:
            self.words.clear()
        if n <= 64:
            self.words[word] = known
        return known

    def decode(self, ids: list[int]) -> str:
        """Text of a sequence of ids; the space in front goes, bytes that are no UTF-8 become U+FFFD."""
        out, raw = [], bytearray()
        for i in ids:
            if self.kind[i] == "byte":
                raw.append(int(self.piece[i][1:-1], 16))
            else:
                out += [raw.decode(errors="replace"), self.piece[i]] if raw else [self.piece[i]]
                raw.clear()
        if raw:
            out.append(raw.decode(errors="replace"))
        text = "".join(out).replace(_SPACE, " ")
        return text[1:] if text[:1] == " " else text


def piece_model(model_file: str, sharpness: float) -> PieceModel:
    key = (model_file, sharpness)
    if key not in _models:
        _models[key] = PieceModel(model_file, sharpness)
    return _models[key]


class _Random:
    """Uniform numbers in (0, 1) from a 64-bit seed and a counter."""

    def __init__(self, seed: int):
        self.seed, self.drawn = np.uint64(seed & (2**64 - 1)), 0

    def __call__(self, n: int) -> np.ndarray:
        at = np.arange(self.drawn + 1, self.drawn + n + 1, dtype=np.uint64)
        self.drawn += n
        return ((mix64(self.seed + at * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(12)).astype(float) + 0.5) / 2.0**52


class Lattices:
    """The lattices of a batch's distinct words as arrays; place -1 is the end of a word."""

    def __init__(self, model: PieceModel, words: list[str]):
        counts, ends, logs, self.ids, roots = [], [], [], [], []
        base = 0
        for word in words:
            count, end, log, ids = model.lattice(word)
            n = len(count)
            roots.append(base)
            counts += count
            ends += [base + e if e < n else -1 for e in end]
            logs += log
            self.ids += ids
            base += n
        self.root = dict(zip(words, roots))
        self.first = np.r_[0, np.cumsum(counts)].astype(np.int64)
        self.end, self.log = np.array(ends, np.int64), np.array(logs)
        place = np.repeat(np.arange(base), counts)
        self.place = place
        share = np.exp(self.log)
        total = np.cumsum(share)
        before = np.r_[0.0, total][self.first[:-1]]
        # cumulative probability within a place, moved by the place's number: one search finds the edge
        self.cumulative = place + np.minimum((total - before[place]), 1.0)
        self.cumulative[self.first[1:] - 1] = np.arange(1, base + 1)

    def pick(self, places: np.ndarray, u: np.ndarray) -> np.ndarray:
        edge = np.searchsorted(self.cumulative, places + u, "right")
        return np.clip(edge, self.first[places], self.first[places + 1] - 1)

    def chain(self, place: int, random: _Random) -> np.ndarray:
        """The edges of one sampled way from the place to its word's end."""
        out = []
        while place >= 0:
            edge = self.pick(np.array([place]), random(1))[0]
            out.append(edge)
            place = int(self.end[edge])
        return np.array(out, np.int64)

    def chains(self, roots: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One sampled way through the word at each root: edges in order, and each way's offset (one more
        at the end). Every way draws from its own seed, one number a piece."""
        places, walker, edges, owners, step = roots, np.arange(len(roots)), [], [], 0
        while len(walker):
            step += 1
            u = mix64(seeds[walker] + np.full(1, step, np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(12)
            edge = self.pick(places, (u.astype(float) + 0.5) / 2.0**52)
            edges.append(edge)
            owners.append(walker)
            places = self.end[edge]
            go = places >= 0
            walker, places = walker[go], places[go]
        if not edges:
            return np.zeros(0, np.int64), np.zeros(len(roots) + 1, np.int64)
        edges, owners = np.concatenate(edges), np.concatenate(owners)
        return edges[np.argsort(owners, kind="stable")], np.r_[0, np.cumsum(np.bincount(owners, minlength=len(roots)))]


def chain_seeds(seed: int, samples: int, words: int) -> np.ndarray:
    """A seed for each (sample, word) of a row."""
    at = np.arange(1, samples * words + 1, dtype=np.uint64)
    return mix64(mix64(np.full(1, seed & (2**64 - 1), np.uint64)) + at * np.uint64(0xD1B54A32D192ED03))


def _below(location: np.ndarray, top: float, u: np.ndarray) -> np.ndarray:
    """Gumbel variables of these locations, given that they are below ``top``."""
    return -np.logaddexp(-top, np.log(-np.log(u)) - location)


def sample_segmentations(lattices: Lattices, roots: np.ndarray, k: int, seed: int, chains=None) -> list[tuple]:
    """At most ``k`` distinct segmentations: (edges, log probability, perturbed score, inclusion).

    ``roots`` are the words' first places. Fewer than ``k`` if the text has no more segmentations.
    ``chains``: ways through all words for k + 1 samples, where they are drawn already.
    """
    random = _Random(seed)
    words = len(roots)
    edges_of, cut = chains or lattices.chains(np.tile(roots, k + 1), chain_seeds(seed, k + 1, words))

    def tail(sample: int, word: int) -> np.ndarray:
        return edges_of[cut[sample * words + word]:cut[(sample + 1) * words]]

    def branches(path: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What leaves the path from its piece ``begin`` on: locations, depths, edges, words.

        Siblings along the next NODES pieces, and all later ones together (as edge -1).
        """
        logs = np.r_[0.0, np.cumsum(lattices.log[path])]
        word_of = np.cumsum(np.r_[True, lattices.end[path[:-1]] < 0]) - 1 if len(path) else np.zeros(0, np.int64)
        stop = min(len(path), begin + NODES)
        nodes = np.arange(begin, stop)
        first = lattices.first[lattices.place[path[nodes]]]
        widths = lattices.first[lattices.place[path[nodes]] + 1] - first
        depth = np.repeat(nodes, widths)
        edges = np.arange(widths.sum()) + np.repeat(first - np.cumsum(widths) + widths, widths)
        other = edges != path[depth]
        depth, edges = depth[other], edges[other]
        locations = logs[depth] + lattices.log[edges]
        word = word_of[depth]
        later = -np.expm1(min(0.0, logs[-1] - logs[stop]))  # mass that leaves the path after ``stop``
        if stop < len(path) and later > 0:
            locations = np.append(locations, logs[stop] + np.log(later))
            depth, edges, word = np.append(depth, stop), np.append(edges, -1), np.append(word, -1)
        return locations, depth, edges, word

    # queue: (-value, number, path, depth, edge, word): the subtree that leaves the path at this
    # depth by the edge, or, for edge -1, all that leaves it from there on
    number, out = 0, []
    queue: list[tuple] = [(-float(_below(np.zeros(1), np.inf, random(1))[0]), 0, None, 0, -1, -1)]
    while queue and len(out) <= k:
        value, _, path, depth, edge, word = heapq.heappop(queue)
        value = -value
        if path is not None and edge < 0:  # one of these branches holds the value, the others less
            left = path
            locations, *items = branches(path, depth)
            share = np.cumsum(np.exp(locations - locations.max()))
            best = min(int(np.searchsorted(share, random(1)[0] * share[-1])), len(locations) - 1)
            drawn = _below(locations, value, random(len(locations)))
            drawn[best] = value
        else:
            if path is None:
                found = tail(len(out), 0) if words else np.zeros(0, np.int64)
                begin = 0
            else:
                place = int(lattices.end[edge])
                found = np.concatenate([path[:depth], [edge], lattices.chain(place, random), tail(len(out), word + 1)])
                begin = depth + 1
            out.append((found, float(lattices.log[found].sum()), value))
            if len(out) > k:
                break
            left = found
            locations, *items = branches(found, begin)
            drawn = _below(locations, value, random(len(locations)))
        for i in np.argsort(-drawn)[:k + 1 - len(out)]:  # no more than these can be taken
            number += 1
            heapq.heappush(queue, (-float(drawn[i]), number, left, *(int(x[i]) for x in items)))
    after = out[k][2] if len(out) > k else -np.inf
    return [(path, log, value, float(-np.expm1(-np.exp(min(log - after, 700.0))))) for path, log, value in out[:k]]


def sample_rows(rows: DataFrame, key: list[str], model_file: str, k: int = 3, sharpness: float = 1.0,
                text: str = "text") -> DataFrame:
    """Sampled segmentations of every row: the key columns, rank, ids, log_prob, score, inclusion, decoded.

    ``decoded`` is the text that the ids decode to. Null counts as the empty text, which has the
    one empty segmentation. The random numbers depend on the key's values alone (and the place of
    the draw), so rows with equal keys and texts get equal samples. Empty table: no rows.
    """
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in key)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_file, sharpness)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                split = [_WORD.findall(normalized(t or "")) for t in part.column(0).to_pylist()]
                lattices = Lattices(model, list(dict.fromkeys(w for words in split for w in words)))
                out: list[list] = [[] for _ in range(7)]
                seeds = part.column(1).to_pylist()
                roots = [np.array([lattices.root[w] for w in words], np.int64) for words in split]
                # the ways through all words of all rows and samples at once
                edges, cut = lattices.chains(np.concatenate([np.tile(r, k + 1) for r in roots]),
                                             np.concatenate([chain_seeds(s, k + 1, len(r)) for s, r in zip(seeds, roots)]))
                first = 0
                for row, (own, seed) in enumerate(zip(roots, seeds)):
                    last = first + (k + 1) * len(own)
                    found = sample_segmentations(lattices, own, k, seed, (edges, cut[first:last + 1]))
                    first = last
                    for rank, (path, log, value, inclusion) in enumerate(found, 1):
                        ids = [i for e in path.tolist() for i in lattices.ids[e]]
                        for column, v in zip(out, (row, rank, ids, log, value, inclusion, model.decode(ids))):
                            column.append(v)
                picked = pa.array(out[0], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(picked) for c in part.columns[2:]), pa.array(out[1], pa.int32()),
                     pa.array(out[2], pa.list_(pa.int32())), pa.array(out[3], pa.float64()), pa.array(out[4], pa.float64()),
                     pa.array(out[5], pa.float64()), pa.array(out[6], pa.string())],
                    [*key, "rank", "ids", "log_prob", "score", "inclusion", "decoded"])

    return rows.select(F.col(text).alias("_text"), F.xxhash64(*key).alias("_seed"), *key).mapInArrow(
        scan, f"{schema}, rank int, ids array<int>, log_prob double, score double, inclusion double, decoded string")

