"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints are 64-bit majorities over the XXH64 of word shingles. Equal fingerprints are collapsed before anything
is linked, so a group of copies is one node whatever its size. Two fingerprints that differ in at most four bits are
found by joins on keys, never by comparing all:

The fingerprint is cut into segments of 23, 23 and 18 bits. The perfect binary Golay code (23, 12, 7) has exactly one
codeword within three bits of any 23-bit word; a word at distance three has five more at distance four. Call the first
its near codeword and all six (or the one, at a smaller distance) its codewords. Then words that differ in one bit
share the near codeword of either, and words that differ in two bits share some codeword (the near one of a word
between them). By pigeonhole, at most four errors over three segments leave

* a segment without error, and another with at most two: key (exact segment, a codeword of the other), or
* no segment without error, hence two with exactly one: key (near codewords of both, parities flipped) against
  (codewords of both, parities).

Each link is verified on the whole fingerprints in the join condition, which also names one of the keys that a pair
shares as the one that reports it; dense groups thus do not multiply rows. Links join into components by
``components``.

Null texts count as empty and have fingerprint zero, linked like any other. Rows with a null doc_id are fingerprinted
and placed in a component, which the least non-null doc_id names. Repeated rows get a row each. Ties cannot be: links are a
matter of bits, and a component's name is its least id. A very long text takes time linear in its words. An empty table
gives no rows. Input columns other than doc_id and text are ignored by ``simhash_groups`` and kept by
``drop_near_duplicates``, whatever their names.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specmark.llm.common import materialize, packed, unpacked
from specmark.llm.components import components

SHINGLE = 4
MOST_BITS = 4
#: Where segments begin and how many bits they have; generator x^11+x^9+x^7+x^6+x^5+x+1 of the code.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
GENERATOR = 0b101011100011

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_CHUNK = 1 << 16


def fingerprint(text: bytes) -> int:
    """The fingerprint of a UTF-8 text as a signed 64-bit number."""
    from xxhash import xxh64_intdigest

    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - SHINGLE + 1)
    firsts, lasts = starts[:n].tolist(), ends[-n:].tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, n, _CHUNK):
        h = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(firsts[i : i + _CHUNK], lasts[i : i + _CHUNK])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def _fingerprints(batches):
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).cast(pa.large_binary())
        fps = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps, pa.int64())], names=[*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, *carry: Column) -> DataFrame:
    """The carried columns of longs (doc_id if there are none) and fp."""
    rows = docs.select(*(carry or [F.col("doc_id").cast("long")]), F.col("text").cast("string").alias("_s_text"))
    return rows.mapInArrow(_fingerprints, ", ".join(f"{c} long" for c in rows.columns[:-1]) + ", fp long")


@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the error within three bits; the five of four bits (or -1). And the syndromes of the upper 12 bits."""
    high = np.zeros(1 << 12, np.int64)
    for bit in range(12):
        rest = 1 << (bit + 11)
        for k in range(22, 10, -1):
            if rest >> k & 1:
                rest ^= GENERATOR << (k - 11)
        high[1 << bit : 2 << bit] = high[: 1 << bit] ^ rest
    single = [int(high[1 << (b - 11)]) if b >= 11 else 1 << b for b in range(23)]
    near, far = np.zeros(2048, np.int64), np.full((2048, 5), -1, np.int64)
    filled = np.zeros(2048, int)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            syndrome, error = 0, 0
            for b in bits:
                syndrome ^= single[b]
                error |= 1 << b
            if weight < 4:
                near[syndrome] = error
            else:
                far[syndrome, filled[syndrome]] = error
                filled[syndrome] += 1
    return near, far, high


def codewords(words: np.ndarray) -> np.ndarray:
    """An array of six columns: the number of the near codeword and of the five at distance four, -1 where there are none."""
    near, far, high = golay()
    syndrome = high[words >> 11] ^ (words & 2047)
    more = far[syndrome]
    return np.column_stack([(words ^ near[syndrome]) >> 11, np.where(more < 0, -1, (words[:, None] ^ more) >> 11)])


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    u = fp.view(np.uint64)
    return [((u >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]


def _key_batch(fp: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(role, rows, keys, is it from near codewords) for each kind of key. Roles: 0 both sides, 1 left, 2 right."""
    segments = _segments(fp)
    codes = [codewords(s) for s in segments]
    parity = [np.bitwise_count(s.astype(np.uint64)).astype(np.int64) & 1 for s in segments]
    rows = np.arange(len(fp))
    out = []
    for exact in range(3):
        for coded in range(3):
            if coded != exact:
                for k in range(6):
                    ok = codes[coded][:, k] >= 0
                    key = (np.int64(exact * 3 + coded) << 40) | (segments[exact] << 12) | codes[coded][:, k]
                    out.append((0, rows[ok], key[ok], np.full(ok.sum(), k == 0)))
    for pair, (a, b) in enumerate(combinations(range(3), 2)):
        tag = np.int64(16 + pair) << 40

        def key(i, j, flip, a=a, b=b, tag=tag):
            return tag | ((parity[a] ^ flip) << 25) | ((parity[b] ^ flip) << 24) | (codes[a][:, i] << 12) | codes[b][:, j]

        out.append((1, rows, key(0, 0, 1), np.ones(len(fp), bool)))
        for i in range(6):
            for j in range(6):
                ok = (codes[a][:, i] >= 0) & (codes[b][:, j] >= 0)
                out.append((2, rows[ok], key(i, j, 0)[ok], np.full(ok.sum(), i == j == 0)))
    return out


def _keys(role: int):
    def run(batches):
        for batch in batches:
            all_fp = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(all_fp), 4096):
                fp = all_fp[at : at + 4096]
                parts = [x for x in _key_batch(fp) if x[0] == role]
                rows, keys, near = (np.concatenate([x[i] for x in parts]) for i in (1, 2, 3))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows]), pa.array(near)], names=["key", "fp", "near"])

    return run


def _errors(i: int) -> Column:
    at, n = SEGMENTS[i]
    mask = (1 << n) - 1 << at
    return F.bit_count((F.col("a")).bitwiseXOR(F.col("b")).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """distinct (fp): all pairs (a, b) of fingerprints, a < b, that differ in at most four bits."""
    keyed = lambda role, name: distinct.mapInArrow(_keys(role), "key long, fp long, near boolean").select(
        F.col("key").alias(f"k{name}"), F.col("fp").alias(name), F.col("near").alias(f"n{name}")
    )
    # Spark takes the rows that Python makes to be as many as it was given, and would send the keys through the driver
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_BITS)
    e = [_errors(i) for i in range(3)]
    # the exact segment that reports a pair is the first, the coded one the first of the others within two bits
    exact = F.when(e[0] == 0, 0).when(e[1] == 0, 1).when(e[2] == 0, 2)
    coded = F.when(exact == 0, F.when(e[1] <= 2, 1).otherwise(2)).when(exact == 1, F.when(e[0] <= 2, 0).otherwise(2)).otherwise(F.when(e[0] <= 2, 0).otherwise(1))
    coded_errors = F.when(coded == 0, e[0]).when(coded == 1, e[1]).otherwise(e[2])
    kind = F.shiftright("ka", 40)
    first = (
        keyed(0, "a").join(keyed(0, "b").hint("merge"), (F.col("ka") == F.col("kb")) & close & (kind == exact * 3 + coded) & (F.col("na") | (coded_errors == 2)))
        .select("a", "b")
    )
    ones = F.when((e[0] == 1) & (e[1] == 1), 0).when((e[0] == 1) & (e[2] == 1), 1).when((e[1] == 1) & (e[2] == 1), 2)
    second = keyed(1, "a").join(keyed(2, "b").hint("merge"), (F.col("ka") == F.col("kb")) & close & exact.isNull() & (kind == 16 + ones)).select("a", "b")
    return first.unionByName(second)


def _labels(classes: DataFrame) -> DataFrame:
    """classes (fp, ...): with the label of each fingerprint's component."""
    spark = classes.sparkSession
    # a key per codeword makes a hundred rows of each: dealt out, however small the file is
    links = fingerprint_links(classes.select("fp").repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    labels = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    # merged, as all sides here and below grow with the table
    placed = classes.join(labels.hint("merge"), F.col("fp") == F.col("node"), "left").select(*classes.columns, F.coalesce("component", "fp").alias("label"))
    return materialize(placed, "simhash-labels")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    fps = materialize(fingerprints(docs), "simhash")
    placed = _labels(materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes"))
    # written, so that the join can split a component that holds a good part of all
    named = materialize(placed.groupBy("label").agg(F.min("least").alias("component_id")), "simhash-names")
    by_fp = materialize(placed.join(named.hint("merge"), "label").select(F.col("fp").alias("_fp"), "component_id"), "simhash-components")
    return fps.join(by_fp.hint("merge"), F.col("fp") == F.col("_fp")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of the least doc_id, rows without one coming last, and then of the text
    with the least hash. Rows go by id and text, so that unlike texts under one id, or under none, are judged apart."""
    # in order: without an id or not, the id, the text
    keys = [F.col("doc_id").isNull().cast("long").alias("_k_none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_k_id"), F.xxhash64("text").alias("_k_text")]
    names = ["_k_none", "_k_id", "_k_text"]
    fps = materialize(fingerprints(docs, *keys), "simhash")
    placed = _labels(materialize(fps.groupBy("fp").agg(F.min(F.struct(*names)).alias("least")), "simhash-classes"))
    stays = placed.groupBy("label").agg(F.min("least").alias("least")).select(*(F.col("least")[n].alias(f"{n}s") for n in names))
    # rows that repeat become one before the shuffle by key, which is the only one that texts take part in
    once = packed(docs, *keys).dropDuplicates(names)
    kept = once.join(materialize(stays, "simhash-stays").hint("merge"), [F.col(n) == F.col(f"{n}s") for n in names], "left_semi")
    return unpacked(kept, docs.columns)
