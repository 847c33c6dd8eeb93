"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The benchmark is a stated query set. It is taken in blocks of bounded size (``block_bytes`` of text, by a hash of the
item), which alone are sent to the executors; each block meets all documents in two narrow passes without a shuffle:

1. The document frequency of every benchmark n-gram of four, three and two words is counted over all documents, but for
   documents that share several n-grams of four words with its item: what a leak repeats says nothing of how common the
   n-gram is by itself.
2. An item's seeds are its rare n-grams, and the ``least_seeds`` rarest of each length in any case. Rare is what is in
   ``rare_share`` of the documents at most, or in ``rare_floor`` documents where that is more, but never in more than
   ``rare_ceiling``: the bounds in documents keep the seeds of small corpora from being few and those of large ones from
   being common. A document that holds a seed of three or four words of an item, or two of two words, is a candidate:
   an alignment that reaches the threshold without two words in a row is all gaps. Its seeds propose alignments by their
   diagonal; each proposed passage is aligned with the item by Smith-Waterman (match 2, mismatch and gap -1) unless the
   words they share cannot reach the threshold. The score is divided by that of the item with itself: an exact copy has
   1, and edited or paraphrased copies lose by what was changed. The span of words is that of the alignment, whose start
   is found by aligning backwards from its end.

Words are compared with case, punctuation and white space folded. Null and empty texts and items match nothing. Items
shorter than an n-gram are sought as a whole. Repeated documents or items give a row each time. Ties between passages go
to the first. Documents without a match give no row, an empty table on either side gives none at all. A very long text
is read whole, in time linear in its words but for its candidates. Other columns are unused by ``find_leaks`` and kept by
``drop_leaks``, whatever their names; rows go by id and text, so that neither a null id nor one that unlike texts share
misleads.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specmark.llm import textbytes as tb
from specmark.llm.common import materialize

GRAMS = (4, 3, 2)
LEAST_SCORE = 0.5
SEVERAL = 4
BLOCK_BYTES = 16 << 20


@dataclass
class Items:
    """A block of the benchmark: ids, words of each item, and its n-grams (hash, item, place, words), sorted by hash."""

    ids: list
    words: list[np.ndarray]
    gram: np.ndarray
    item: np.ndarray
    place: np.ndarray
    size: np.ndarray

    @property
    def whole(self) -> np.ndarray:
        """Which n-grams are of the longest length that the item has."""
        return self.size == np.minimum(GRAMS[0], np.fromiter(map(len, self.words), np.int64, len(self.words)))[self.item]

    def __post_init__(self):
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.gram & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def where(self, grams: np.ndarray) -> np.ndarray:
        """Places in grams that may be in this block, then those that are."""
        maybe = np.nonzero(self.filter[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)])[0]
        at = np.searchsorted(self.gram, grams[maybe])
        return maybe[self.gram[np.minimum(at, len(self.gram) - 1)] == grams[maybe]]

    def only(self, keep: np.ndarray) -> Items:
        return Items(self.ids, self.words, self.gram[keep], self.item[keep], self.place[keep], self.size[keep])


def build_items(rows: list) -> Items:
    """rows: (item_id, text)."""
    ids, words, gram, item, place, size = [], [], [], [], [], []
    for item_id, text in rows:
        data = np.frombuffer((text or "").encode(), np.uint8)
        w = tb.words(data, np.array([0, len(data)]), tb.FOLD).hashes()
        if len(w):
            for n in sorted({min(n, len(w)) for n in GRAMS}):
                g = tb.ngrams(w, n) + np.uint64(n)
                gram.append(g)
                item.append(np.full(len(g), len(ids)))
                place.append(np.arange(len(g)))
                size.append(np.full(len(g), n))
            ids.append(item_id)
            words.append(w)
    if not ids:
        none = np.zeros(0, np.int64)
        return Items([], [], none.astype(np.uint64), none, none, none)
    g, i, p, n = map(np.concatenate, (gram, item, place, size))
    order = np.argsort(g, kind="stable")
    return Items(ids, words, g[order], i[order], p[order], n[order])


def _hits(w: tb.Words, h: np.ndarray, items: Items):
    """(place, gram) of each n-gram of these texts that the block has."""
    places, grams = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for n in np.unique(items.size).tolist():
        g = tb.ngrams(h, n) + np.uint64(n)
        at = items.where(g)
        at = at[tb.inside(w.firsts, n)[at]]
        places.append(at)
        grams.append(g[at])
    return np.concatenate(places), np.concatenate(grams)


def _pairs(w: tb.Words, h: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, entry of the block, place) of each meeting of an n-gram with an item that has it."""
    place, gram = _hits(w, h, items)
    first = np.searchsorted(items.gram, gram, side="left")
    counts = np.searchsorted(items.gram, gram, side="right") - first
    entry = np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    place = np.repeat(place, counts)
    return np.searchsorted(w.firsts, place, side="right") - 1, entry, place


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """The best local score (match 2, mismatch and gap -1) and the word of the passage after its end."""
    slope = np.arange(1, len(passage) + 1)
    row = np.zeros(len(passage) + 1, np.int64)
    best, end = 0, 0
    for word in item:
        up = np.maximum(row[:-1] + np.where(passage == word, 2, -1), row[1:] - 1)
        # the gap along the row: a running maximum on a slope
        row[1:] = np.maximum(np.maximum.accumulate(np.maximum(up, 0) + slope) - slope, 0)
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def align(words: np.ndarray, item: np.ndarray, starts: np.ndarray, least: float) -> tuple[float, int, int] | None:
    """The best of the alignments that seeds propose (starts: where the item would begin), if it reaches least."""
    n, best = len(item), None
    starts = np.unique(starts)
    for group in np.split(starts, np.nonzero(np.diff(starts) > n)[0] + 1):
        low = max(0, int(group[0]) - n // 2 - 2)
        passage = words[low : int(group[-1]) + n + n // 2 + 2]
        exact = next((int(s) for s in group if s >= 0 and s + n <= len(words) and np.array_equal(words[s : s + n], item)), None)
        if exact is not None:
            return 1.0, exact, exact + n
        if np.isin(item, passage).sum() < least * n:
            continue
        score, end = smith_waterman(item, passage)
        if score >= least * 2 * n and (best is None or score / (2 * n) > best[0]):
            _, back = smith_waterman(item[::-1], passage[:end][::-1])
            best = (score / (2 * n), low + end - back, low + end)
    return best


def _frequencies(shared):
    def run(batches):
        items = shared.value
        whole = items.whole
        grams = np.bincount(items.item[whole], minlength=len(items.ids))
        for batch in batches:
            for _, n, data, offsets in tb.chunks(batch.column(1)):
                w = tb.words(data, offsets, tb.FOLD)
                text, entry, _ = _pairs(w, w.hashes(), items)
                once = np.unique(entry * n + text)
                entry, text = once // n, once % n
                pair, of = np.unique(text * len(items.ids) + items.item[entry], return_inverse=True)
                held = np.bincount(of, weights=whole[entry], minlength=len(pair))
                alone = held[of] < np.minimum(SEVERAL, grams[items.item[entry]])
                entries, counts = np.unique(entry[alone], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(entries.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["entry", "n"])

    return run


def _candidates(text: np.ndarray, entry: np.ndarray, place: np.ndarray, items: Items):
    """(text, item, entries, places) of each document and item with seeds enough, by text and item."""
    item = items.item[entry]
    order = np.lexsort((entry, item, text))
    text, item, entry, place = text[order], item[order], entry[order], place[order]
    new = np.ones(len(text), bool)
    new[1:] = (np.diff(text) != 0) | (np.diff(item) != 0)
    first = np.nonzero(new)[0]
    # a seed of two words counts half, and once; a short item is one n-gram
    fresh = new.copy()
    fresh[1:] |= np.diff(entry) != 0
    weight = np.where(fresh, np.where((items.size[entry] > 2) | items.whole[entry], 2, 1), 0)
    enough = np.add.reduceat(weight, first) >= 2 if len(first) else np.zeros(0, bool)
    ends = np.append(first[1:], len(text))
    for a, b in zip(first[enough].tolist(), ends[enough].tolist()):
        yield int(text[a]), int(item[a]), entry[a:b], place[a:b]


def _alignments(shared, least: float):
    def run(batches):
        items = shared.value
        for batch in batches:
            ids, keys = batch.column(0), batch.column(2)
            out = ([], [], [], [], [], [])
            for at, _, data, offsets in tb.chunks(batch.column(1)):
                w = tb.words(data, offsets, tb.FOLD)
                h = w.hashes()
                for t, i, entry, place in _candidates(*_pairs(w, h, items), items):
                    if found := align(h[w.firsts[t] : w.firsts[t + 1]], items.words[i], place - w.firsts[t] - items.place[entry], least):
                        for column, value in zip(out, (ids[at + t].as_py(), items.ids[i], *found, keys[at + t].as_py())):
                            column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "item_id", "score", "start_word", "end_word", "_key"],
            )

    return run


_LEAKS = "doc_id long, item_id long, score double, start_word long, end_word long, _key long"


def _key() -> Column:
    """What tells rows of one id, or of none, apart: the text, as its hash."""
    return F.xxhash64(F.col("text").cast("string"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE, **options) -> DataFrame:
    """doc_id, item_id, score and the word span (end exclusive) for each item that a document has a copy of."""
    return _keyed_leaks(docs, benchmark, least, **options).drop("_key")


def _keyed_leaks(
    docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE,
    rare_share: float = 1e-4, rare_floor: int = 50, rare_ceiling: int = 100_000, least_seeds: int = 8, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The leaks, with the key of their texts."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _key().alias("_key"))
    n_docs, size = rows.count(), benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rare = min(max(rare_share * n_docs, rare_floor), rare_ceiling)
    blocks = -(-size // block_bytes) or 1
    found = None
    for block in range(blocks):
        part = benchmark.select(F.col("item_id").cast("long"), "text").filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        items = build_items([tuple(r) for r in part.orderBy("item_id", "text").collect()])
        if not items.ids:
            continue
        counted = rows.mapInArrow(_frequencies(spark.sparkContext.broadcast(items)), "entry long, n long").groupBy("entry").agg(F.sum("n").alias("n"))
        table = counted.toArrow()  # at most the n-grams of the block
        df = np.zeros(len(items.gram), np.int64)
        df[table["entry"].to_numpy()] = table["n"].to_numpy()
        # the place of each n-gram among those of its item and length, the rarest first
        group = items.item * (GRAMS[0] + 1) + items.size
        by = np.lexsort((df, group))
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by)) - np.searchsorted(group[by], group[by])
        seeds = items.only((df <= rare) | (rank < least_seeds))
        one = rows.mapInArrow(_alignments(spark.sparkContext.broadcast(seeds), least), _LEAKS)
        found = one if found is None else found.unionByName(one)
    return spark.createDataFrame([], _LEAKS) if found is None else found


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a copy of a benchmark item."""
    leaked = materialize(_keyed_leaks(docs, benchmark), "leaks").select(F.col("doc_id").alias("_d_id"), F.col("_key").alias("_d_key")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(leaked["_d_id"]) & F.xxhash64(docs["text"].cast("string")).eqNullSafe(leaked["_d_key"])
    return docs.join(leaked, same, "left_anti")
