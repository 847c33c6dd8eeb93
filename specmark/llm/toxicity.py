"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Inputs: the words of a text, letters folded. A word enters as its own (hashed) embedding and as the sum of the
embeddings of its character n-grams, so that unseen words are read by their characters. Two GRUs read a window of words
in both directions, attention pools their states, and a linear layer gives the window's logit. All overlapping windows
of the whole text are scored; a text scores as its highest window.

Fitting uses a bounded sample of labelled rows (``sample_toxic`` and ``sample_clean`` documents, the first of a hashed
order; all windows of each). One column of the embeddings starts as the log odds of a word or
n-gram between toxic and clean documents of the sample; everything is then trained together by Adam on the highest
windows of each text, so that clean texts give their hardest windows. Scoring is one narrow pass, with memory bounded
by a chunk of texts.

A null or empty text, or one without words, scores the share of toxic rows in the sample, 0.49 at most. With no
labelled rows, or of one class only, every text scores that share. Very long texts are scored in all their windows; where
windows tie, any of them gives the text's score. Rows of the sample tie in the hashed order by doc_id. Repeated rows score
alike, an empty table gives no rows; a null doc_id is kept and learned from nowhere; other columns are unused.
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

BUCKETS = 1 << 13
DIM, HIDDEN = 8, 8
GRAMS = (3, 5)
F32 = np.float32


@dataclass
class Model:
    share: float
    p: dict = field(default_factory=dict)
    window: int = 64
    stride: int = 48


@dataclass
class Tokens:
    """Distinct words (hash, bucket, n-gram buckets laid end to end) and the texts as numbers of distinct words."""

    word: np.ndarray
    bucket: np.ndarray
    grams: np.ndarray
    gram_starts: np.ndarray
    ids: np.ndarray
    firsts: np.ndarray


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    w = tb.words(data, offsets, tb.FOLD)
    h = w.hashes()
    distinct, at, ids = np.unique(h, return_index=True, return_inverse=True)
    n = len(distinct)
    starts, sizes = w.starts[at], w.ends[at] - w.starts[at]
    # each word between two marks, end to end
    padded = np.concatenate(([0], np.cumsum(sizes + 2)))
    place = np.arange(padded[-1]) - np.repeat(padded[:-1], sizes + 2)
    inner = (place > 0) & (place <= np.repeat(sizes, sizes + 2))
    text = np.full(padded[-1], 94, np.uint64)
    source = np.repeat(starts, sizes + 2) + place - 1
    text[inner] = w.data[source[inner]]
    owner = np.repeat(np.arange(n), sizes + 2)
    grams, owners = [], []
    for size in GRAMS:
        if len(text) >= size:
            g = tb.ngrams(text, size) + np.uint64(size)
            ok = place[: len(g)] + size <= np.repeat(sizes + 2, sizes + 2)[: len(g)]
            grams.append(g[ok])
            owners.append(owner[: len(g)][ok])
    grams = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
    owners = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    order = np.argsort(owners, kind="stable")  # a word has a gram at least: the marks make it three bytes long
    return Tokens(
        distinct,
        (distinct % np.uint64(BUCKETS)).astype(np.int64),
        (tb.mix(grams[order]) % np.uint64(BUCKETS)).astype(np.int16),
        np.searchsorted(owners[order], np.arange(n)),
        ids.astype(np.int64),
        w.firsts,
    )


def _grams_of(t: Tokens, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of some distinct words, laid end to end, and where each word's begin."""
    sizes = np.append(t.gram_starts[1:], len(t.grams))[which] - t.gram_starts[which]
    starts = np.cumsum(sizes) - sizes
    return t.grams[np.repeat(t.gram_starts[which] - starts, sizes) + np.arange(sizes.sum())], starts


def merged(parts: list[Tokens]) -> Tokens:
    """The tokens of consecutive chunks as those of one."""
    every = np.concatenate([t.word for t in parts])
    word, at, number = np.unique(every, return_index=True, return_inverse=True)
    bases = np.cumsum([0] + [len(t.word) for t in parts])
    grams, starts, shift = [], np.zeros(len(word), np.int64), 0
    for t, base in zip(parts, bases):
        new = np.nonzero((at >= base) & (at < base + len(t.word)))[0]
        g, s = _grams_of(t, at[new] - base)
        grams.append(g)
        starts[new] = s + shift
        shift += len(g)
    # words in order of their hash: lay the n-grams out in that order
    order = np.argsort(starts, kind="stable")
    sizes = np.empty(len(word), np.int64)
    sizes[order] = np.diff(np.append(starts[order], shift))
    begin = np.cumsum(sizes) - sizes
    laid = np.concatenate(grams)[np.repeat(starts - begin, sizes) + np.arange(sizes.sum())]
    ids = np.concatenate([number[base : base + len(t.word)][t.ids] for t, base in zip(parts, bases)])
    ends = np.cumsum([0] + [len(t.ids) for t in parts])
    firsts = np.concatenate([t.firsts[:-1] + e for t, e in zip(parts, ends)] + [ends[-1:]])
    return Tokens(word, (word % np.uint64(BUCKETS)).astype(np.int64), laid, begin, ids, firsts)


def windows(firsts: np.ndarray, window: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, text) of the overlapping windows of each text that has words."""
    sizes = np.diff(firsts)
    counts = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - window) // stride)), 0)
    text = np.repeat(np.arange(len(sizes)), counts)
    k = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    start = k * stride
    return firsts[:-1][text] + start, np.minimum(window, sizes[text] - start), text


def _sigmoid(x):
    return np.tanh(x * F32(0.5)) * F32(0.5) + F32(0.5)


def _inputs(t: Tokens, p: dict) -> np.ndarray:
    if not len(t.bucket):
        return np.zeros((0, 2 * DIM), F32)
    return np.concatenate([p["word"][t.bucket], np.add.reduceat(p["char"][t.grams], t.gram_starts, axis=0)], axis=1)


def _gru(projected: np.ndarray, seq: np.ndarray, lengths: np.ndarray, wh: np.ndarray, keep: list | None) -> np.ndarray:
    """States (steps, windows, hidden). projected: input part of the gates by distinct word; keep: gets what backward needs."""
    steps, n = seq.shape
    h = np.zeros((n, HIDDEN), F32)
    out = np.empty((steps, n, HIDDEN), F32)
    shortest = int(lengths.min()) if n else 0
    for s in range(steps):
        x = projected[seq[s]]
        a = h @ wh
        zr = _sigmoid(x[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = np.tanh(x[:, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
        new = c + z * (h - c)
        if s >= shortest:
            new = np.where((s < lengths)[:, None], new, h)
        if keep is not None:
            keep.append((h, z, r, c, a[:, 2 * HIDDEN :]))
        h = out[s] = new
    return out


def _gru_back(d_out: np.ndarray, keep: list, lengths: np.ndarray, wh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs (steps, windows, 3 hidden) and of wh."""
    steps, n, _ = d_out.shape
    dx, dwh, dh = np.zeros((steps, n, 3 * HIDDEN), F32), np.zeros_like(wh), np.zeros((n, HIDDEN), F32)
    for s in range(steps - 1, -1, -1):
        h, z, r, c, ac = keep[s]
        live = (s < lengths)[:, None].astype(F32)
        g = (dh + d_out[s]) * live
        rest = dh * (1 - live)
        dc = g * (1 - z) * (1 - c * c)
        dz = g * (h - c) * z * (1 - z)
        dr = dc * ac * r * (1 - r)
        da = np.concatenate([dz, dr, dc * r], axis=1)
        dx[s] = np.concatenate([dz, dr, dc], axis=1)
        dwh += h.T @ da
        dh = g * z + da @ wh.T + rest
    return dx, dwh


def _sequences(t: Tokens, start: np.ndarray, length: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct-word numbers (steps, windows), forwards and from the end; beyond the end any word stands in."""
    k = np.arange(steps)[:, None]
    ahead = t.ids[start + np.minimum(k, length - 1)]
    back = t.ids[start + np.maximum(length - 1 - k, 0)]
    return ahead, back


def _flip(states: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Reverse each window in its own length (an involution on the live steps)."""
    k = np.arange(states.shape[0])[:, None]
    return states[np.maximum(length - 1 - k, 0), np.arange(states.shape[1])]


def _forward(x: np.ndarray, t: Tokens, start, length, p: dict, steps: int, kept: dict | None = None) -> np.ndarray:
    ahead, back = _sequences(t, start, length, steps)
    kf, kb = ([], []) if kept is not None else (None, None)
    hf = _gru(x @ p["xf"] + p["bf"], ahead, length, p["hf"], kf)
    hb = _flip(_gru(x @ p["xb"] + p["bb"], back, length, p["hb"], kb), length)
    h = np.concatenate([hf, hb], axis=2)
    live = np.arange(steps)[:, None] < length
    e = np.where(live, h @ p["att"], F32(-1e9))
    e = np.exp(e - e.max(0))
    a = e / e.sum(0)
    pooled = (a[:, :, None] * h).sum(0)
    if kept is not None:
        kept |= {"ahead": ahead, "back": back, "kf": kf, "kb": kb, "h": h, "a": a, "pooled": pooled}
    return pooled @ p["out"] + p["bias"]


def _gradients(x, t: Tokens, start, length, y, p: dict, steps: int) -> dict:
    k: dict = {}
    logit = _forward(x, t, start, length, p, steps, k)
    d = ((_sigmoid(logit) - y) / len(y)).astype(F32)
    g = {"out": k["pooled"].T @ d, "bias": np.array(d.sum(), F32)}
    dp = d[:, None] * p["out"]
    da = (k["h"] * dp).sum(2)
    de = k["a"] * (da - (k["a"] * da).sum(0))
    g["att"] = np.einsum("snh,sn->h", k["h"], de).astype(F32)
    dh = k["a"][:, :, None] * dp + de[:, :, None] * p["att"]
    dh *= (np.arange(steps)[:, None] < length)[:, :, None]
    dxs = np.zeros_like(x)
    for side, seq, keep, dout in (("f", k["ahead"], k["kf"], dh[:, :, :HIDDEN]), ("b", k["back"], k["kb"], _flip(dh[:, :, HIDDEN:], length))):
        dproj, g["h" + side] = _gru_back(dout, keep, length, p["h" + side])
        flat = np.zeros((len(x), 3 * HIDDEN), F32)
        np.add.at(flat, seq.ravel(), dproj.reshape(-1, 3 * HIDDEN))
        g["x" + side], g["b" + side] = x.T @ flat, flat.sum(0)
        dxs += flat @ p["x" + side].T
    g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
    np.add.at(g["word"], t.bucket, dxs[:, :DIM])
    per = np.diff(np.append(t.gram_starts, len(t.grams)))
    np.add.at(g["char"], t.grams, np.repeat(dxs[:, DIM:], per, axis=0))
    return g


def _log_odds(buckets: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Shrunk log odds of a bucket between toxic and clean texts, by the number of texts that have it."""
    hits = np.zeros((2, BUCKETS))
    for b, label in zip(buckets, y):
        hits[int(label), np.unique(b)] += 1
    toxic, clean = y.sum(), len(y) - y.sum()
    odds = np.log((hits[1] + 0.5) / (toxic + 1)) - np.log((hits[0] + 0.5) / (clean + 1))
    seen = hits.sum(0)
    return (odds * seen / (seen + 5)).astype(F32)


def train(texts: pa.Array, labels: list[int], epochs: int = 8, seed: int = 7) -> Model:
    y = np.array(labels, np.int64)
    share = float(y.mean()) if len(y) else 0.0
    model = Model(min(share, 0.49))
    if not len(y) or y.min() == y.max():
        return model
    t = merged([tokens(data, offsets) for _, _, data, offsets in tb.chunks(texts)])
    if not len(t.ids):
        return model
    rng = np.random.default_rng(seed)
    d = lambda *s: rng.normal(0, 0.3 / np.sqrt(s[0]) if len(s) > 1 and s[0] < BUCKETS else 0.05, s).astype(F32)
    p = {
        "word": d(BUCKETS, DIM), "char": d(BUCKETS, DIM), "xf": d(2 * DIM, 3 * HIDDEN), "xb": d(2 * DIM, 3 * HIDDEN),
        "hf": d(HIDDEN, 3 * HIDDEN), "hb": d(HIDDEN, 3 * HIDDEN), "bf": np.zeros(3 * HIDDEN, F32), "bb": np.zeros(3 * HIDDEN, F32),
        "att": d(2 * HIDDEN), "out": d(2 * HIDDEN), "bias": np.array(-1.0, F32),
    }
    per_text = [t.ids[a:b] for a, b in zip(t.firsts, t.firsts[1:])]
    p["word"][:, 0] = _log_odds([t.bucket[i] for i in per_text], y) / 2
    gram_of = [_grams_of(t, np.unique(i))[0] for i in per_text]
    p["char"][:, 0] = _log_odds(gram_of, y) / 8
    # start from a reader of those two columns: the candidate state follows them
    for side in "fb":
        p["x" + side][[0, DIM], 2 * HIDDEN] += 1.0
    p["out"][[0, HIDDEN]] += 2.0
    p["att"][[0, HIDDEN]] += 2.0
    start, length, owner = windows(t.firsts, model.window, model.stride)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
    step = 0
    for epoch in range(epochs):
        logit = _score(t, start, length, p, model.window)
        # the two highest windows of each text, and one more of clean texts
        order = np.lexsort((-logit, owner))
        rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        chosen = order[(rank < np.where(y[owner[order]] == 1, 1, 2)) | ((y[owner[order]] == 0) & (rng.random(len(order)) < 0.02))]
        rng.shuffle(chosen)
        size = min(256, max(32, len(chosen) // 10))
        for at in range(0, len(chosen), size):
            own = chosen[at : at + size]
            # only the distinct words of the batch
            words, back = np.unique(np.concatenate([t.ids[s : s + n] for s, n in zip(start[own], length[own])]), return_inverse=True)
            part = Tokens(t.word[words], t.bucket[words], *_grams_of(t, words), back, t.firsts)
            first = np.cumsum(length[own]) - length[own]
            g = _gradients(_inputs(part, p), part, first, length[own], y[owner[own]].astype(F32), p, model.window)
            step += 1
            rate = 0.02 * (1 - epoch / epochs) + 0.001
            for k, v in p.items():
                m, s = moments[k]
                m += 0.1 * (g[k] - m)
                s += 0.01 * (g[k] ** 2 - s)
                v -= (rate if k not in ("word", "char") else rate / 2) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    model.p = p
    return model


def _score(t: Tokens, start, length, p: dict, steps: int, batch: int = 4096) -> np.ndarray:
    x = _inputs(t, p)
    out = [np.zeros(0, F32)]
    for at in range(0, len(start), batch):
        n = length[at : at + batch]
        out.append(_forward(x, t, start[at : at + batch], n, p, min(steps, int(n.max()))))
    return np.concatenate(out)


def score_chunk(data: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    """One score per text: the highest of all its windows."""
    scores = np.full(len(offsets) - 1, model.share)
    if model.p:
        t = tokens(data, offsets)
        start, length, text = windows(t.firsts, model.window, model.stride)
        if len(start):
            order = np.argsort(length, kind="stable")  # windows of a batch are of one length, as nearly as can be
            logit = np.empty(len(start), F32)
            logit[order] = _score(t, start[order], length[order], model.p, model.window)
            which, first = np.unique(text, return_index=True)
            scores[which] = 1 / (1 + np.exp(-np.maximum.reduceat(logit, first).astype(np.float64)))
    return scores


def fit(docs: DataFrame, labels: DataFrame, sample_toxic: int = 1500, sample_clean: int = 3000) -> Model:
    """A model from at most sample_toxic + sample_clean labelled rows of docs (doc_id, text)."""
    known = labels.select("doc_id", "toxic").filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    present = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    some = lambda label, n: first_by_hash(present.filter(F.col("toxic") == label), "toxic", [F.xxhash64("doc_id"), F.col("doc_id")], n)
    sample = some(1, sample_toxic).unionByName(some(0, sample_clean)).select(F.col("doc_id").alias("_t_id"), "toxic")
    rows = (
        docs.join(F.broadcast(sample), F.col("doc_id") == F.col("_t_id"))
        .groupBy("_t_id").agg(F.min("text").cast("string").alias("text"), F.min("toxic").cast("int").alias("toxic"))
    )
    # the sample is bounded, so that one task can hold and learn from it
    trained = rows.repartition(1).mapInArrow(_train, "model binary").collect()
    return pickle.loads(trained[0][0]) if trained else Model(0.0)


def _train(batches):
    table = pa.Table.from_batches(list(batches), pa.schema([("_t_id", pa.int64()), ("text", pa.string()), ("toxic", pa.int32())])).sort_by("_t_id")
    model = train(table["text"], table["toxic"].to_pylist())
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            scores = [score_chunk(data, offsets, shared.value) for _, _, data, offsets in tb.chunks(batch.column(1))]
            values = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model that learns from the labelled ones whose crc32(doc_id) mod 5 is not 0."""
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = fit(docs.filter(~held), labels.filter(~held))
    return score(docs, model).select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
