"""Incremental substring deduplication over a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words. Each window has an anchor, the least hash of the 8-word grams inside it, so
equal windows have equal anchors while a text has few different ones. The index holds fingerprints with the least and largest
doc_id that they were seen in, as immutable runs, bucketed and sorted by fingerprint. A batch of documents becomes a run, which
is merge-joined with each older run; fingerprints met in two documents are suspects. When ``fan_in`` runs of a level have
gathered, they are compacted into one of the next level.

Within one call all texts are at hand, so anchors are the fingerprints, and suspects are verified: one narrow pass over the
texts gives 96 bits of two independent hashes of each whole window with a suspect anchor (a bitmap of suspect anchors of fixed
size is sent to the executors; where it says yes too often, more windows are verified and the result is the same). An index
that is kept (``index_path``) holds those 96 bits of every window, so that later calls decide by it alone and never read
earlier texts again; it takes about twenty bytes a word. The least doc_id of each window owns it; every other document's words
under it go. Within a call, texts equal in all words are settled before, by a hash of the word sequence, so groups of copies
add nothing to the anchors.

Null texts count as empty. Texts of fewer than 50 words keep all. Rows without a doc_id are neither owners nor cut.
Rows with the same doc_id are one document as owners and are cut one by one. Very long texts are one document like others,
all their windows counted. Ties cannot be: of documents with a window, the least doc_id owns it. An empty table gives no
rows; other columns are unused, whatever their names.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specmark.llm import textbytes as tb
from specmark.llm.common import bitmap, in_bitmap, materialize, shared_dir
from specmark.sources import sinks

WINDOW, GRAM = 50, 8
_SECOND = 0xA0761D6478BD642F | 1
_PROFILE = "doc_id long, text_key long, text_key2 long, n_words long, anchors array<long>"


def _window_anchors(h: np.ndarray) -> np.ndarray:
    """For the window that starts at each word, the least 8-gram hash in it (windows across texts included)."""
    m, width, need = tb.ngrams(h, GRAM), 1, WINDOW - GRAM + 1
    if len(m) < need:
        return np.zeros(0, np.uint64)
    while 2 * width <= need:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    rest = need - width
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def _sequence_keys(h: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """A hash of each text's whole word sequence."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * tb.powers(len(h) + 1, 0xD1342543DE82EF95)[:-1])))
    inverse = tb.powers(len(h) + 1, pow(0xD1342543DE82EF95, -1, 1 << 64))
    return tb.mix((sums[firsts[1:]] - sums[firsts[:-1]]) * inverse[firsts[:-1]] + np.diff(firsts).astype(np.uint64))


def _profile_batches(batches):
    for batch in batches:
        for at, n, data, offsets in tb.chunks(batch.column(1)):
            w = tb.words(data, offsets)
            h, h2 = w.hashes(), w.hashes(_SECOND)
            ok = tb.inside(w.firsts, WINDOW)
            anchors, owner = _window_anchors(h)[ok], w.text_of[: len(ok)][ok]
            fresh = np.ones(len(anchors), bool)  # neighbours mostly share theirs
            fresh[1:] = (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1])
            anchors, owner = anchors[fresh].view(np.int64), owner[fresh]
            per = np.searchsorted(owner, np.arange(n + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(at, n),
                    pa.array(_sequence_keys(h, w.firsts).view(np.int64)),
                    pa.array(_sequence_keys(h2, w.firsts).view(np.int64)),
                    pa.array(np.diff(w.firsts).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(per.astype(np.int32)), pa.array(anchors)),
                ],
                names=["doc_id", "text_key", "text_key2", "n_words", "anchors"],
            )


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


class FingerprintIndex:
    """Immutable runs of (*keys, low, high): the least and the largest doc_id that a fingerprint was seen in.

    Runs lie below ``path``, bucketed and sorted by fingerprint: a batch is aggregated into buckets once, and after that runs
    meet, and two runs are compacted, without a shuffle. A hot fingerprint is one row of a run. A manifest names the live
    runs; each change writes the next manifest and only then deletes the runs that it no longer names, so a call that is
    lost leaves the index as it was. A path that holds an index opens it. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fan_in: int = 2, keys: dict[str, str] | None = None):
        self.spark, self.fan_in = spark, fan_in
        self.keys = keys or {"anchor": "bigint"}
        self.path = (path or f"{shared_dir(spark)}/index-{uuid.uuid4().hex}").rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._store = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.version, self.levels = 0, []
        self.buckets = min(100_000, int(spark.conf.get("spark.sql.shuffle.partitions")))
        found = sorted(f.getPath().toString() for f in self._store.globStatus(self._hadoop(f"{self.path}/manifest-*.json")) or [])
        if found:
            held = json.loads(spark.read.text(found[-1], wholetext=True).first()[0])
            if held["keys"] != self.keys:
                raise ValueError(f"the index at {self.path} has other fingerprints")
            self.version, self.buckets, self.levels = held["version"], held["buckets"], held["levels"]

    def _publish(self) -> None:
        """The levels as they are now, under the next number; a manifest is whole from when it has its name."""
        self.version += 1
        draft, name = f"{self.path}/draft-{uuid.uuid4().hex}", f"{self.path}/manifest-{self.version:09d}.json"
        sinks.write_text(self.spark, draft, json.dumps({"version": self.version, "buckets": self.buckets, "levels": self.levels, "keys": self.keys}))
        if not self._store.rename(self._hadoop(draft), self._hadoop(name)):
            raise RuntimeError(f"{name} is there already: another writer")
        self._store.delete(self._hadoop(f"{self.path}/manifest-{self.version - 1:09d}.json"), False)

    def _table(self, run: str) -> DataFrame:
        columns, keys = ", ".join(f"{k} {kind}" for k, kind in self.keys.items()), ", ".join(self.keys)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {run} ({columns}, low BIGINT, high BIGINT) USING parquet"
            f" CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{run}'"
        )
        return self.spark.table(run)

    def _write(self, rows: DataFrame) -> str:
        run, keys = f"run_{uuid.uuid4().hex}", list(self.keys)
        writer = rows.select(*keys, "low", "high").write.format("parquet").bucketBy(self.buckets, *keys).sortBy(*keys)
        writer.option("path", f"{self.path}/{run}").saveAsTable(run)
        return run

    def _delete(self, run: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run}")
        self._store.delete(self._hadoop(f"{self.path}/{run}"), True)

    def names(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def runs(self) -> list[DataFrame]:
        return [self._table(run) for run in self.names()]

    def ingest(self, postings: DataFrame) -> DataFrame:
        """postings (*keys, doc_id) of a batch; the fingerprints of the batch that now are in two documents or more, each with an
        owner, the least doc_id of those runs that met (several rows where several did)."""
        keys = list(self.keys)
        name = self._write(postings.groupBy(*keys).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")))
        run = self._table(name)
        suspects = run.filter("low < high").select(*keys, F.col("low").alias("owner"))
        for older in self.runs():
            met = run.join(older.toDF(*keys, "low2", "high2"), keys).filter("low2 < high2 OR low < high OR low <> low2")
            suspects = suspects.unionByName(met.select(*keys, F.least("low", "low2").alias("owner")))
        suspects = materialize(suspects, "suspects")
        gone = self._add(name, 0)
        self._publish()
        for run in gone:
            self._delete(run)
        return suspects

    def _add(self, run: str, level: int) -> list[str]:
        """Put a run into its level, compacting as levels fill; the runs that are live no more."""
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) < self.fan_in:
            return []
        full, self.levels[level] = self.levels[level], []
        merged = self._table(full[0])
        for other in full[1:]:
            keys = list(self.keys)
            both = merged.join(self._table(other).toDF(*keys, "low2", "high2"), keys, "full_outer")
            merged = both.select(*keys, F.least("low", "low2").alias("low"), F.greatest("high", "high2").alias("high"))
        return full + self._add(self._write(merged), level + 1)

    def drop(self) -> None:
        for run in self.names():
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")
        self._store.delete(self._hadoop(self.path), True)


_FOUND = "w1 long, w2 int, doc_id long, text_key long, start int"


def _windows(shared=None):
    """The windows whose anchor is suspect, or all."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for at, n, data, offsets in tb.chunks(batch.column(1)):
                w = tb.words(data, offsets)
                h = w.hashes()
                ok = tb.inside(w.firsts, WINDOW)
                if not ok.any():
                    continue
                if shared is not None:
                    ok &= in_bitmap(shared.value, _window_anchors(h).view(np.int64))
                starts = np.nonzero(ok)[0]
                h2 = w.hashes(_SECOND)
                owner = w.text_of[starts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(tb.ngrams(h, WINDOW)[starts].view(np.int64)),
                        pa.array((tb.ngrams(h2, WINDOW)[starts] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                        ids.slice(at, n).take(pa.array(owner)),
                        pa.array(_sequence_keys(h, w.firsts).view(np.int64)[owner]),
                        pa.array((starts - w.firsts[owner]).astype(np.int32)),
                    ],
                    names=["w1", "w2", "doc_id", "text_key", "start"],
                )

    return run


def _split(batch: pa.RecordBatch, held: np.ndarray, touched: bool) -> pa.RecordBatch:
    """The rows that a decision may be about, or the rest; a row without a doc_id is never touched."""
    ids = batch.column(0)
    hit = in_bitmap(held, ids.fill_null(0).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False)
    return batch.filter(pa.array(hit if touched else ~hit))


def _texts(shared):
    def run(batches):
        for batch in batches:
            some = _split(batch, shared.value, True)
            for at, n, data, offsets in tb.chunks(some.column(1)):
                w = tb.words(data, offsets)
                keys = _sequence_keys(w.hashes(), w.firsts).view(np.int64)
                yield pa.RecordBatch.from_arrays([some.column(0).slice(at, n), pa.array(keys), some.column(1).slice(at, n)], names=["doc_id", "text_key", "text"])

    return run


_KEPT = "doc_id long, n_words long, n_removed long, text string"


def _kept_batch(ids: pa.Array, words: list[list[bytes]], gone: list[np.ndarray | None]) -> pa.RecordBatch:
    left = [w if g is None else [x for x, out in zip(w, g.tolist()) if not out] for w, g in zip(words, gone)]
    return pa.RecordBatch.from_arrays(
        [
            ids,
            pa.array([len(w) for w in words], pa.int64()),
            pa.array([len(w) - len(k) for w, k in zip(words, left)], pa.int64()),
            pa.array([b" ".join(k) for k in left], pa.binary()).cast(pa.string()),
        ],
        names=["doc_id", "n_words", "n_removed", "text"],
    )


def _words_of(text: pa.Scalar) -> list[bytes]:
    return text.as_buffer().to_pybytes().split() if text.is_valid else []


def _untouched(shared):
    def run(batches):
        for batch in batches:
            rest = _split(batch, shared.value, False)
            for at in range(0, rest.num_rows, 256):
                part = rest.slice(at, 256)
                words = [_words_of(t) for t in part.column(1)]
                yield _kept_batch(part.column(0), words, [None] * len(words))

    return run


def _cut(batches):
    """(doc_id, text, starts of removed windows or null, is it removed whole or null)"""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            words, gone = [_words_of(t) for t in part.column(1)], []
            for w, starts, whole in zip(words, part.column(2), part.column(3)):
                cover = np.zeros(len(w) + 1, np.int64)
                if starts.is_valid:
                    first = starts.values.to_numpy(zero_copy_only=False)
                    np.add.at(cover, first, 1)
                    np.add.at(cover, first + WINDOW, -1)
                gone.append(np.ones(len(w), bool) if whole.as_py() else np.cumsum(cover[:-1]) > 0)
            yield _kept_batch(part.column(0), words, gone)


def _owners_by_anchors(rows: DataFrame, originals: DataFrame, profiles: DataFrame, batches: int, fan_in: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """The windows with suspect anchors, and the owner of each that is in two documents or more."""
    spark = rows.sparkSession
    postings = originals.select("doc_id", F.explode("anchors").alias("anchor"))
    index = FingerprintIndex(spark, None, fan_in)
    cuts = profiles.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)])).first()[0] or []
    bounds = [None, *sorted(set(cuts)), None]
    suspects = None
    for low, high in zip(bounds, bounds[1:]):
        batch = postings
        if low is not None:
            batch = batch.filter(F.col("doc_id") > low)
        if high is not None:
            batch = batch.filter(F.col("doc_id") <= high)
        met = index.ingest(batch).select("anchor")
        suspects = met if suspects is None else suspects.unionByName(met)
    index.drop()
    anchors = spark.sparkContext.broadcast(bitmap(suspects, bits))
    windows = materialize(rows.filter("doc_id IS NOT NULL").mapInArrow(_windows(anchors), _FOUND), "windows")
    seen = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
    return windows, seen.filter("owner < last").drop("last")


def deduplicate(docs: DataFrame, batches: int = 3, fan_in: int = 2, bits: int = 1 << 27, index_path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and text, the kept words joined by single spaces.

    With ``index_path`` the index there is opened, or made, and kept. Where ids grow from call to call, the calls together
    give what one pass over all documents gives; a document of an earlier call is not cut again for a smaller id that comes
    later.
    """
    spark = docs.sparkSession
    rows = _rows(docs)
    profiles = materialize(rows.mapInArrow(_profile_batches, _PROFILE), "profiles")
    long = profiles.filter((F.col("n_words") >= WINDOW) & F.col("doc_id").isNotNull())
    first = long.groupBy("text_key", "text_key2", "n_words").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    copied = materialize(first.filter("n > 1").select("text_key", "text_key2", "n_words", "first_id"), "copied")
    of_text = ["text_key", "text_key2", "n_words"]
    known = profiles.join(copied, of_text, "left").withColumn("is_copy", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)) & (F.col("n_words") >= WINDOW))
    originals = known.filter("NOT is_copy AND doc_id IS NOT NULL")
    originals = materialize(originals.select("doc_id", "anchors"), "originals") if copied.take(1) else originals
    if index_path is None:
        windows, owners = _owners_by_anchors(rows, originals, profiles, batches, fan_in, bits)
    else:
        windows = materialize(rows.filter("doc_id IS NOT NULL").mapInArrow(_windows(), _FOUND), "windows")
        index = FingerprintIndex(spark, index_path, fan_in, {"w1": "bigint", "w2": "int"})
        owners = index.ingest(windows.select("w1", "w2", "doc_id")).groupBy("w1", "w2").agg(F.min("owner").alias("owner"))
    # written, so that the join can split a passage that a good part of all documents repeat
    owners = materialize(owners, "owners")
    starts = windows.join(owners, ["w1", "w2"]).filter("doc_id > owner").groupBy("doc_id", "text_key").agg(F.collect_set("start").alias("starts"))
    # a copy of a whole text is settled already
    copies = known.filter("is_copy").select("doc_id", "text_key")
    cut = materialize(starts.join(copies, ["doc_id", "text_key"], "left_anti"), "cuts")
    none = F.array().cast("array<int>")
    decisions = cut.select("doc_id", "text_key", "starts", F.lit(False).alias("whole")).unionByName(
        copies.distinct().select("doc_id", "text_key", none.alias("starts"), F.lit(True).alias("whole"))
    )
    # texts that no decision can be about pass straight through; the others meet the decisions
    touched = spark.sparkContext.broadcast(bitmap(cut.select("doc_id").unionByName(copies.select("doc_id")), bits))
    met = rows.mapInArrow(_texts(touched), "doc_id long, text_key long, text string").join(decisions, ["doc_id", "text_key"], "left")
    done = met.select("doc_id", "text", "starts", "whole").mapInArrow(_cut, _KEPT)
    return rows.mapInArrow(_untouched(touched), _KEPT).unionByName(done)
