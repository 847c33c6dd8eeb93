"""Quality by histogram gradient-boosted trees over document statistics.

``features`` gives each text a row of statistics, by numpy over the bytes of a chunk of texts: sizes, shares of kinds of
characters and words, entropy, repetition of words, word pairs, fives and lines. Each statistic is binned at quantiles of
the sample; trees grow level by level on histograms of gradients and curvatures of the logistic loss. A trained forest is
flat arrays: nodes of complete trees in breadth-first order, whose children are found by arithmetic, so that all trees are
walked at once, one numpy step per level.

Fitting uses a bounded sample of labelled rows (``sample_good`` and ``sample_bad`` documents, the first of a hashed order),
weighted to the shares that the labels have; statistics and scores are of whole texts, in one narrow pass.

A null text is the empty text; it and texts without words have zeros for statistics, and are scored by the trees like any
other. With no labelled rows every text scores 0.5, with labels of one class 0 or 1. A document with several labels
takes the largest. Repeated rows and equal texts score alike; a value on a threshold goes to the lower side. A very long
text is held whole by one task, which needs memory in proportion to it. An empty table gives no rows. Other columns are not
read.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specmark.llm import textbytes as tb
from specmark.llm.common import first_by_hash

DEPTH = 4
TREES = 60
BINS = 64
RATE = 0.15
SHRINK = 1.0  # added to the curvature of a node
LEAST_WEIGHT = 3.0  # of rows in a leaf

NAMES = (
    "log_bytes", "log_words", "word_size", "word_size_spread", "log_longest_word", "different_words", "monotony", "top_word",
    "repeated_pairs", "repeated_fives", "log_lines", "line_size", "repeated_lines", "capitals", "digits", "spaces", "newlines",
    "sentence_signs", "other_signs", "beyond_ascii", "control", "entropy", "signed_words", "capital_words", "single_words",
)


def _kinds() -> np.ndarray:
    """Which bytes are of each kind, a column per kind."""
    kinds = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\x0b\x0c\r", b"\n", b".,;:!?'\"()-"]
    table = np.zeros((256, len(kinds) + 3), bool)
    for k, chars in enumerate(kinds):
        table[list(chars), k] = True
    letters = np.zeros(256, bool)
    letters[list(b"abcdefghijklmnopqrstuvwxyz")] = True
    code = np.arange(256)
    table[:, 6] = code >= 128
    table[:, 7] = ((code < 32) | (code == 127)) & ~table.any(1)
    table[:, 5] = ~table.any(1) & ~letters
    return table


_KINDS = _kinds()
#: For lines: every white space but the end of a line is taken for a part of it.
_LINES = np.arange(256, dtype=np.uint8)
_LINES[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 1


def _per_text(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums of consecutive values by text."""
    sums = np.concatenate(([0], np.cumsum(values)))
    return sums[firsts[1:]] - sums[firsts[:-1]]


def _repeats(hashes: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """By text: the number of different values, and how often the commonest occurs."""
    keys, at, count = np.unique(tb.mix(hashes ^ tb.mix(text.astype(np.uint64) + np.uint64(1))), return_index=True, return_counts=True)
    owner = text[at]
    most = np.zeros(n, np.int64)
    np.maximum.at(most, owner, count)
    return np.bincount(owner, minlength=n), most


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of statistics for each text of a chunk."""
    n, size = len(offsets) - 1, np.diff(offsets)
    letters = np.zeros((n, 256))
    for t in range(n):
        letters[t] = np.bincount(data[offsets[t] : offsets[t + 1]], minlength=256)
    kinds = letters @ _KINDS
    p = letters / np.maximum(size, 1)[:, None]
    entropy = -np.sum(p * np.log(np.where(p > 0, p, 1)), axis=1)
    w = tb.words(data, offsets)
    words, text, h = np.diff(w.firsts), w.text_of, w.hashes()
    sizes = (w.ends - w.starts).astype(np.float64)
    mean = _share(_per_text(sizes, w.firsts), words)
    spread = np.sqrt(np.maximum(0, _share(_per_text(sizes**2, w.firsts), words) - mean**2))
    longest = np.zeros(n)
    np.maximum.at(longest, text, sizes)
    different, most = _repeats(h, text, n)
    columns = [np.log1p(size), np.log1p(words), mean, spread, np.log1p(longest), _share(different, words)]
    columns += [1 - np.log(np.maximum(different, 1) + 1) / np.log(np.maximum(words, 1) + 1), _share(most, words)]
    for k in (2, 5):
        inside = tb.inside(w.firsts, k)
        grams, owner = tb.ngrams(h, k)[inside], text[: len(inside)][inside]
        total = np.bincount(owner, minlength=n)
        columns.append(_share(total - _repeats(grams, owner, n)[0], total))
    lines = tb.words(_LINES[data], offsets)
    n_lines = np.diff(lines.firsts)
    columns += [np.log1p(n_lines), np.log1p(_share(size, n_lines)), _share(n_lines - _repeats(lines.hashes(), lines.text_of, n)[0], n_lines)]
    columns += [_share(kinds[:, k], size) for k in range(kinds.shape[1])] + [entropy]
    last = w.data[w.ends - 1] if len(w.ends) else np.zeros(0, np.uint8)
    ends_so = lambda kind: _share(_per_text(_KINDS[last, kind].astype(np.float64), w.firsts), words)
    columns += [ends_so(5), ends_so(0), _share(_per_text((sizes == 1).astype(np.float64), w.firsts), words)]
    return np.column_stack(columns)


@dataclass
class Forest:
    """Complete trees: node k of a tree has children 2k + 1 and 2k + 2; a node that does not split sends all to the first."""

    base: float
    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, (1 << DEPTH) - 1), np.int64))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros((0, (1 << DEPTH) - 1)))
    leaf: np.ndarray = field(default_factory=lambda: np.zeros((0, 1 << DEPTH)))

    def logit(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.feature))
        at, rows = np.zeros((len(x), len(trees)), np.int64), np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.threshold[trees, at])
        return self.base + self.leaf[trees, at - ((1 << DEPTH) - 1)].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -700, 700)))


def bin_edges(x: np.ndarray) -> list[np.ndarray]:
    """Up to BINS - 1 inner edges of each column, halfway between values that the sample has."""
    edges = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > BINS:
            values = np.unique(np.quantile(column, np.linspace(0, 1, BINS), method="nearest"))
        edges.append((values[:-1] + values[1:]) / 2)
    return edges


def _grow(bins: np.ndarray, g: np.ndarray, h: np.ndarray, weight: np.ndarray, edges: list[np.ndarray]):
    """One tree: features and thresholds of its inner nodes, values of its leaves, and the leaf of each row."""
    n, width = bins.shape
    feature, threshold = np.zeros((1 << DEPTH) - 1, np.int64), np.full((1 << DEPTH) - 1, np.inf)
    node = np.zeros(n, np.int64)
    inner = np.array([[b < len(e) for b in range(BINS)] for e in edges])
    for level in range(DEPTH):
        first, nodes = (1 << level) - 1, 1 << level
        cell = ((node - first)[:, None] * width + np.arange(width)) * BINS + bins
        upto = []  # sums over the bins up to each, by node and feature
        for v in (g, h, weight):
            histogram = np.bincount(cell.ravel(), np.repeat(v, width), nodes * width * BINS).reshape(nodes, width, BINS)
            upto.append(histogram.cumsum(2))
        gl, hl, wl = upto
        gt, ht, wt = gl[:, :, -1:], hl[:, :, -1:], wl[:, :, -1:]
        gain = gl**2 / (hl + SHRINK) + (gt - gl) ** 2 / (ht - hl + SHRINK) - gt**2 / (ht + SHRINK)
        gain = np.where((wl >= LEAST_WEIGHT) & (wt - wl >= LEAST_WEIGHT) & inner, gain, 0).reshape(nodes, -1)
        best = gain.argmax(1)
        for k in np.nonzero(gain[np.arange(nodes), best] > 1e-9)[0]:
            f, b = divmod(int(best[k]), BINS)
            feature[first + k], threshold[first + k] = f, edges[f][b]
        split = np.array([np.searchsorted(edges[f], t) if np.isfinite(t) else BINS for f, t in zip(feature[first : first + nodes], threshold[first : first + nodes])])
        node = 2 * node + 1 + (bins[np.arange(n), feature[node]] > split[node - first])
    leaf = node - ((1 << DEPTH) - 1)
    total = lambda v: np.bincount(leaf, v, 1 << DEPTH)
    return feature, threshold, -RATE * total(g) / (total(h) + SHRINK), leaf


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES) -> Forest:
    if not len(y) or y.min() == y.max():
        return Forest(float(np.inf if y[0] else -np.inf) if len(y) else 0.0)
    share = float(np.average(y, weights=weight))
    edges = bin_edges(x)
    bins = np.column_stack([np.searchsorted(e, c) for e, c in zip(edges, x.T)])
    logit = np.full(len(y), np.log(share / (1 - share)))
    forest = Forest(float(logit[0]))
    grown = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        feature, threshold, leaf, at = _grow(bins, weight * (p - y), weight * p * (1 - p), weight, edges)
        grown.append((feature, threshold, leaf))
        logit += leaf[at]
    forest.feature, forest.threshold, forest.leaf = (np.stack(v) for v in zip(*grown))
    return forest


def _train(batches):
    table = pa.Table.from_batches(list(batches)).sort_by("_b_id")
    y, share = table["quality"].to_numpy().astype(np.float64), table["_b_weight"].to_numpy()
    x = [features(data, offsets) for _, _, data, offsets in tb.chunks(table["text"])]
    forest = train(np.concatenate(x), y, share * len(y) / share.sum())
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(forest)], pa.binary())], names=["forest"])


def fit(docs: DataFrame, labels: DataFrame, sample_good: int = 4000, sample_bad: int = 4000) -> Forest:
    """A forest from at most sample_good + sample_bad labelled rows of docs (doc_id, text)."""
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    present = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    shares = {r["quality"]: r["count"] for r in present.groupBy("quality").count().collect()}  # two rows
    chosen = {0: sample_bad, 1: sample_good}
    some = lambda k: first_by_hash(present.filter(F.col("quality") == k), "quality", [F.xxhash64("doc_id"), F.col("doc_id")], chosen[k])
    weight = F.when(F.col("quality") == 1, F.lit(shares.get(1, 0) / max(1, min(shares.get(1, 0), sample_good))))
    weight = weight.otherwise(F.lit(shares.get(0, 0) / max(1, min(shares.get(0, 0), sample_bad))))
    sample = some(1).unionByName(some(0)).select(F.col("doc_id").alias("_b_id"), "quality", weight.alias("_b_weight"))
    rows = docs.join(F.broadcast(sample), F.col("doc_id") == F.col("_b_id")).groupBy("_b_id", "quality", "_b_weight")
    # the sample is bounded, so that one task can hold and learn from it
    texts = rows.agg(F.min("text").cast("string").alias("text")).repartition(1)
    trained = texts.mapInArrow(_train, "forest binary").collect()
    return pickle.loads(trained[0][0]) if trained else Forest(0.0)


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id and score of every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for batch in batches:
            scores = [shared.value.score(features(data, offsets)) for _, _, data, offsets in tb.chunks(batch.column(1))]
            values = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Scores of all documents by a forest that learns from the labelled ones whose crc32(doc_id) mod 4 is not 2."""
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    forest = fit(docs.filter(~held), labels.filter(~held))
    return score(docs, forest).select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
