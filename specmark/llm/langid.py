"""Language identification by bit-sliced Bloom filters of n-grams.

Of each language, the most frequent byte n-grams (``per_lang`` of them, counted over the texts of a bounded sample of
labelled documents, ``sample_docs`` per language) enter one Bloom filter that all languages share: a slot holds a
bitmask of languages, an n-gram sets its language's bit in ``HASHES`` slots, and a look-up ANDs the slots to the mask of
all languages that contain the n-gram. With more than 64 languages a slot has more words.

A text asks for all its n-grams. The count of a language's bit over them is corrected for the false positives to
expect at its filter's fill, ``(share - fp) / (1 - fp)``; the language with the highest corrected share is the answer,
and its part of the sum of corrected shares is the score. A scan is one narrow pass with memory bounded by a chunk.

N-grams are of the letters only: ASCII and Latin-1 letters in lower case, other multi-byte characters as they are, all
else as one space. Null texts and texts without a letter are ``und`` with score 0, as is every text if nothing was learned.
Very long texts are read whole, a chunk of texts at a time. Ties go to the first language by name. Repeated rows are
answered alike, an empty table gives no rows; labels of null are not learned; other columns are unused, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specmark.llm import textbytes as tb
from specmark.llm.common import first_by_hash, materialize

GRAM = 4
HASHES = 3
UNKNOWN = "und"
_LETTERS = np.array([b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint8)


@dataclass
class Filters:
    """langs in order; slots[word, slot] has bit l % 64 for language l; expected[l]: false positives of its filter."""

    langs: list[str]
    slots: np.ndarray
    expected: np.ndarray


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, text) for each n-gram of letters and single spaces that has a letter; each text stands between spaces."""
    data = _LETTERS[data]
    second = np.nonzero(data[:-1] == 0xC3)[0] + 1
    data[second[(data[second] <= 0x9E) & (data[second] != 0x97)]] += 32
    n = len(offsets) - 1
    # a space before and after each text, then no two spaces in a row
    sizes = np.diff(offsets)
    text = np.repeat(np.arange(n), sizes + 2)
    at = offsets[:-1] + 2 * np.arange(n)
    spaced = np.full(len(data) + 2 * n, 32, np.uint8)
    inner = np.ones(len(spaced), bool)
    inner[at] = False
    inner[at + sizes + 1] = False
    spaced[inner] = data
    keep = np.ones(len(spaced), bool)
    keep[1:] = (spaced[1:] != 32) | (spaced[:-1] != 32) | (text[1:] != text[:-1])
    spaced, text = spaced[keep].astype(np.uint32), text[keep]
    m = len(spaced) - GRAM + 1
    if m <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    g = np.zeros(m, np.uint32)
    for k in range(GRAM):
        g = (g << np.uint32(8)) | spaced[k : k + m]
    ok = text[:m] == text[GRAM - 1 :]
    return g[ok], text[:m][ok]


def _slots(grams: np.ndarray, size: int) -> list[np.ndarray]:
    h = tb.mix(grams.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(k) * step) % np.uint64(size)).astype(np.int64) for k in range(HASHES)]


def build(grams_by_lang: dict[str, np.ndarray], bits_per_gram: int = 16) -> Filters:
    langs = sorted(grams_by_lang)
    size = max(1024, bits_per_gram * max((len(g) for g in grams_by_lang.values()), default=0))
    slots = np.zeros((max(1, -(-len(langs) // 64)), size), np.uint64)
    fills = []
    for i, lang in enumerate(langs):
        own = np.zeros(size, bool)
        for s in _slots(grams_by_lang[lang], size):
            own[s] = True
        slots[i // 64][own] |= np.uint64(1) << np.uint64(i % 64)
        fills.append(own.mean())
    return Filters(langs, slots, np.array(fills) ** HASHES)


def predict_chunk(data: np.ndarray, offsets: np.ndarray, filters: Filters) -> tuple[list[str], np.ndarray]:
    n, k = len(offsets) - 1, len(filters.langs)
    grams, text = _grams(data, offsets)
    total = np.bincount(text, minlength=n)
    share = np.zeros((k, n))
    at = _slots(grams, filters.slots.shape[1])
    for word in range(len(filters.slots)):
        mask = filters.slots[word][at[0]]
        for s in at[1:]:
            mask &= filters.slots[word][s]
        for i in range(word * 64, min(k, word * 64 + 64)):
            hit = (mask >> np.uint64(i % 64)) & np.uint64(1)
            share[i] = np.bincount(text, weights=hit.astype(np.float64), minlength=n) / np.maximum(total, 1)
    expected = filters.expected[:, None] if k else np.zeros((0, 1))
    corrected = np.maximum(0, (share - expected) / np.maximum(1e-9, 1 - expected)) + 1e-9
    scores = corrected.max(0) / corrected.sum(0) if k else np.zeros(n)
    best = corrected.argmax(0) if k else np.zeros(n, np.int64)
    names = []
    for i in range(n):
        piece = data[offsets[i] : offsets[i + 1]]
        ascii_letter = (((piece | 32) >= 97) & ((piece | 32) <= 122)).any()
        letter = ascii_letter or (len(piece) and piece.max() >= 128 and any(c.isalpha() for c in piece.tobytes().decode("utf-8", "replace")))
        if k and letter:
            names.append(filters.langs[best[i]])
        else:
            names.append(UNKNOWN)
            scores[i] = 0.0
    return names, scores


def _count(batches):
    """(lang, gram, n) by batch, from (lang, text)."""
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        for at, n, data, offsets in tb.chunks(batch.column(1)):
            grams, text = _grams(data, offsets)
            lang_of = langs[at : at + n]
            for lang in sorted(set(lang_of)):
                g, c = np.unique(grams[(lang_of == lang)[text]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.astype(np.int64)), pa.array(c)], names=["lang", "gram", "n"])


def fit(docs: DataFrame, per_lang: int = 2000, sample_docs: int = 2000, most_sent: int = 1_000_000) -> Filters:
    """Filters from doc_id, text and lang of docs: at most sample_docs documents of a language, the first by a hash."""
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL")
    hashed = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = first_by_hash(known.select("doc_id", "lang"), "lang", hashed, sample_docs).distinct()
    sample = materialize(sample, "language-sample")
    # at most sample_docs rows of a language: sent to all tasks unless languages are very many
    side = F.broadcast(sample) if sample.count() <= most_sent else sample
    texts = known.join(side, ["doc_id", "lang"], "left_semi").select(F.col("lang").cast("string"), F.col("text").cast("string"))
    counts = texts.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = W.partitionBy("lang").orderBy(F.desc("n"), "gram")
    table = counts.withColumn("_k", F.row_number().over(top)).filter(F.col("_k") <= per_lang).select("lang", "gram").toArrow()
    langs, grams = np.array(table["lang"].to_pylist(), dtype=object), table["gram"].to_numpy()
    return build({lang: np.unique(grams[langs == lang]).astype(np.uint32) for lang in sorted(set(langs))})


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred and score of every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        for batch in batches:
            for at, n, data, offsets in tb.chunks(batch.column(1)):
                names, scores = predict_chunk(data, offsets, shared.value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"]
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Predictions for all documents, learned from those whose crc32(doc_id) mod 4 is not 2."""
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    filters = fit(docs.filter(~held))
    return predict(docs, filters).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")
