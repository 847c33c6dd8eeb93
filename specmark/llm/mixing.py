"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (native).

1. Sizes (words) are summed per source; the targets solve ``target = min(2 * size, level * weight)`` for the one level
   at which they add up to the budget.
2. A source's documents are dealt by hash into blocks of about ``block_docs`` documents. The blocks are put in a
   hashed order, and prefix sums (over groups of blocks, then inside each group) say which blocks a source draws once
   more than the whole number of copies that its target holds. In the one block at the border, documents are taken in
   hashed order and the last one is cut, so that a source meets its target to the word.
3. The block draws of all sources are divided among ``shards`` output shards by a binary tree. At each node, half of
   the draws go left; how many of them come from each source is drawn from the multivariate hypergeometric
   distribution, as univariate draws conditioned on what went before, by inverting the distribution function with
   hashed uniforms. The quotas are exact: at each node the two halves add up to the node.
4. Each draw takes the next place in its source's permuted sequence and so belongs to one shard, disjoint from all
   others; ``mixed_rows`` orders rows inside a shard by a hash.

Work that grows with the corpus is keyed by (source, block), which no hot source can unbalance. Sources themselves are
few (they are what weights are given for); their table has one row each. All choices are hashes of ids and the seed,
so reruns agree.

Rows go by their id and text, so unlike texts under one id, or under none, are dealt apart. Null texts and texts without
words have size 0 and are never taken. A null source is a source of its own, last in order. Repeated rows have one place
in the order and each counts its own size; which of them a border cuts makes no difference. A very long text is one
document like others. An empty table gives no rows. Other columns are unused by ``mix`` and kept by ``mixed_rows``, but
for those of the names that it adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specmark.llm.common import WORD, materialize, text_of, words_of

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST_COPIES = 2


def _same_source(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def sized(docs: DataFrame, *carry: Column) -> DataFrame:
    return docs.select(
        F.col("doc_id").alias("_m_id"),
        F.col("source").cast("string").alias("_m_source"),
        F.xxhash64(F.col("doc_id"), F.col("text")).alias("_m_key"),
        F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("_m_size"),
        *carry,
    )


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row per source: documents, words, weight and target. Only this table of sources is ordered in one task."""
    per = sizes.groupBy("_m_source").agg(F.sum("_m_size").alias("_t_size"), F.count(F.lit(1)).alias("_t_docs"))
    whole = W.partitionBy()
    ranked = per.withColumn("_t_rank", F.row_number().over(whole.orderBy(F.col("_m_source").asc_nulls_last())))
    ranked = ranked.withColumn("_t_weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("_t_rank") - 1) % len(WEIGHTS)).cast("int") + 1).cast("double"))
    cap = F.col("_t_size") * float(MOST_COPIES)
    # sources in the order in which a rising level would stop them; before: those stopped earlier
    before = whole.orderBy(cap / F.col("_t_weight"), "_t_rank").rowsBetween(W.unboundedPreceding, -1)
    budget = F.sum("_t_size").over(whole) * (SHARE_PERCENT / 100.0)
    level = F.try_divide(
        budget - F.coalesce(F.sum(cap).over(before), F.lit(0.0)),
        F.sum("_t_weight").over(whole) - F.coalesce(F.sum("_t_weight").over(before), F.lit(0.0)),
    )
    leveled = ranked.withColumn("_t_level", level)
    # the first source that the level leaves below its cap fixes the level of all the rest
    open_level = F.min(F.when(cap / F.col("_t_weight") > F.col("_t_level"), F.struct(cap / F.col("_t_weight"), F.col("_t_level").alias("level")))).over(whole)
    target = F.least(cap, F.coalesce(open_level["level"] * F.col("_t_weight"), cap))
    return leveled.select(
        F.col("_m_source").alias("_t_source"),
        "_t_size",
        "_t_docs",
        "_t_rank",
        target.alias("_t_target"),
        F.when(F.col("_t_size") > 0, F.least(F.floor(target / F.col("_t_size")), F.lit(MOST_COPIES))).otherwise(0).cast("int").alias("_t_copies"),
    ).withColumn("_t_extra", F.round(F.col("_t_target")).cast("long") - F.col("_t_copies") * F.col("_t_size"))


def _let(f, **values: Column) -> Column:
    """f of a struct of values, each of which is computed once however often f names it."""
    bound = F.struct(*(v.alias(k) for k, v in values.items()))
    return F.transform(F.array(bound), f)[0]


def _lgamma(x: Column) -> Column:
    """Log gamma for x >= 1: Stirling's series, moved up by eight steps of the recurrence."""

    def series(v: Column) -> Column:
        x, y = v["x"], v["y"]
        shift = F.ln(x * (x + 1.0) * (x + 2.0) * (x + 3.0)) + F.ln((x + 4.0) * (x + 5.0) * (x + 6.0) * (x + 7.0))
        return (y - 0.5) * F.ln(y) - y + 0.9189385332046728 + 1.0 / (12.0 * y) - 1.0 / (360.0 * y * y * y) + 1.0 / (1260.0 * F.pow(y, F.lit(5.0))) - shift

    return _let(lambda v: _let(series, x=v["x"], y=v["x"] + 8.0), x=x)


def hypergeometric(total: Column, marked: Column, drawn: Column, uniform: Column) -> Column:
    """How many of ``drawn`` out of ``total`` are among the ``marked``: the inverse of the distribution at uniform.

    The support within twelve standard deviations of the mean is walked once, with probabilities by the ratio of
    neighbours; it holds all but a part below 1e-30.
    """

    def moments(v: Column) -> Column:
        share = v["k"] / F.greatest(v["n"], F.lit(1.0))
        variance = v["m"] * share * (1.0 - share) * (v["n"] - v["m"]) / F.greatest(v["n"] - 1.0, F.lit(1.0))
        return _let(bounds, n=v["n"], k=v["k"], m=v["m"], u=v["u"], mean=v["m"] * share, wide=12.0 * F.sqrt(F.greatest(variance, F.lit(0.0))) + 12.0)

    def bounds(v: Column) -> Column:
        low = F.greatest(F.lit(0.0), v["m"] + v["k"] - v["n"], F.floor(v["mean"] - v["wide"]).cast("double"))
        return _let(walk, n=v["n"], k=v["k"], m=v["m"], u=v["u"], low=low, high=F.least(v["k"], v["m"], F.ceil(v["mean"] + v["wide"]).cast("double")))

    def walk(v: Column) -> Column:
        n, k, m, low = v["n"], v["k"], v["m"], v["low"]
        # log of the first probability: nine log factorials, by their signs
        plus = F.array(k, n - k, m, n - m)
        minus = F.array(low, k - low, m - low, n - k - m + low, n)
        total_of = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + _lgamma(x + 1.0))

        def step(acc: Column, x: Column) -> Column:
            ratio = (k - x) * (m - x) / ((x + 1.0) * F.greatest(n - k - m + x + 1.0, F.lit(1.0)))
            return F.struct(
                F.when(ratio > 0, acc["p"] + F.ln(ratio)).otherwise(F.lit(-1e9)).alias("p"),
                (acc["cdf"] + F.exp(acc["p"])).alias("cdf"),
                F.when(acc["cdf"] < v["u"], x).otherwise(acc["at"]).alias("at"),
            )

        places = F.transform(F.sequence(low.cast("long"), v["high"].cast("long")), lambda x: x.cast("double"))
        start = F.struct((total_of(plus) - total_of(minus)).alias("p"), F.lit(0.0).alias("cdf"), low.alias("at"))
        return F.aggregate(places, start, step, lambda acc: acc["at"].cast("long"))

    inner = _let(moments, n=total.cast("double"), k=marked.cast("double"), m=drawn.cast("double"), u=uniform)
    return F.when((drawn <= 0) | (marked <= 0), F.lit(0).cast("long")).when(drawn >= total, marked.cast("long")).otherwise(inner)


def _uniform(*parts) -> Column:
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def shard_quotas(draws: DataFrame, shards: int, seed: int) -> DataFrame:
    """draws: one row per source with ``_t_rank`` and ``_t_draws``. Per source: draws before the end of each shard.

    One row is a node: its shard range and the draws each source has in it (exact quotas).
    """
    node = draws.groupBy().agg(
        F.sort_array(F.collect_list(F.struct(F.col("_t_rank").alias("rank"), F.col("_t_draws").alias("n")))).alias("quota")
    ).select(F.lit(0).alias("first"), F.lit(shards).alias("width"), "quota")
    width = shards
    while width > 1:
        total = F.aggregate("quota", F.lit(0).cast("long"), lambda a, q: a + q["n"])
        half = F.floor((F.col("width") / 2)).cast("int")
        node = node.withColumn("_total", total).withColumn("_left", F.floor(F.col("_total") * half / F.col("width")).cast("long"))

        def split(acc: Column, q: Column) -> Column:
            u = _uniform(F.col("first"), F.col("width"), q["rank"], F.lit(seed))
            got = hypergeometric(acc["total"], q["n"], acc["left"], u)
            return F.struct(
                (acc["total"] - q["n"]).alias("total"),
                (acc["left"] - got).alias("left"),
                F.concat(acc["got"], F.array(got)).alias("got"),
            )

        got = F.aggregate(
            "quota",
            F.struct(F.col("_total").alias("total"), F.col("_left").alias("left"), F.array().cast("array<bigint>").alias("got")),
            split,
            lambda acc: acc["got"],
        )
        node = node.withColumn("_got", F.when(F.col("width") > 1, got).otherwise(F.transform("quota", lambda q: q["n"])))
        # a generator stands between levels, so that no level is computed again inside the next
        part = lambda first, w, n: F.struct(first.alias("first"), w.alias("width"), F.zip_with("quota", "_got", n).alias("quota"))
        left = part(F.col("first"), F.greatest(half, F.lit(1)), lambda q, g: F.struct(q["rank"].alias("rank"), g.alias("n")))
        right = part(F.col("first") + half, F.col("width") - half, lambda q, g: F.struct(q["rank"].alias("rank"), (q["n"] - g).alias("n")))
        node = node.select(F.inline(F.when(F.col("width") > 1, F.array(left, right)).otherwise(F.array(left))))
        width = (width + 1) // 2
    per = node.select("first", F.inline("quota"))
    ends = F.sort_array(F.collect_list(F.struct(F.col("first"), F.col("n"))))
    return per.groupBy("rank").agg(ends.alias("parts")).select(
        F.col("rank").alias("_s_rank"),
        F.transform("parts", lambda x, i: F.aggregate(F.slice("parts", 1, i + 1), F.lit(0).cast("long"), lambda a, y: a + y["n"])).alias("_s_ends"),
    )


def _mix(docs: DataFrame, shards: int, block_docs: int, seed: int, with_rows: bool) -> DataFrame:
    """One row per document: _m_id, _m_key, _m_size, its source's size and target, _taken words, the _shards of the copies
    taken and, if asked for, _row."""
    sizes = materialize(sized(docs), "mix-sizes")
    targets = materialize(source_targets(sizes), "mix-targets")
    # ids are hashed alike everywhere: block, order of blocks, order in a block
    n_blocks = F.ceil(F.col("_t_docs") / block_docs).cast("long")
    def placed_in(rows: DataFrame) -> DataFrame:
        own = [c for c in rows.columns if c != "_m_source"]
        return rows.join(targets, _same_source("_m_source", "_t_source")).select(*own, "_t_rank", F.pmod(F.xxhash64("_m_key", F.lit(seed)), n_blocks).alias("_b"))

    placed = placed_in(sizes)
    blocks = placed.groupBy("_t_rank", "_b").agg(F.sum("_m_size").alias("_b_size")).withColumn("_b_hash", F.xxhash64("_b", "_t_rank", F.lit(seed + 1)))
    blocks = materialize(blocks, "mix-blocks")
    # prefix sums and ranks of blocks in hashed order: first over 4096 ranges of the hash, then inside each
    ranged = blocks.withColumn("_r", F.shiftright("_b_hash", 52))
    w_ranges = W.partitionBy("_t_rank").orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    ranges = (
        ranged.groupBy("_t_rank", "_r")
        .agg(F.sum("_b_size").alias("_r_size"), F.count(F.lit(1)).alias("_r_n"))
        .select(
            F.col("_t_rank").alias("_r_rank"),
            F.col("_r").alias("_r_r"),
            F.coalesce(F.sum("_r_size").over(w_ranges), F.lit(0)).alias("_r_before"),
            F.coalesce(F.sum("_r_n").over(w_ranges), F.lit(0)).alias("_r_index"),
        )
    )
    w_in = W.partitionBy("_t_rank", "_r").orderBy("_b_hash", "_b").rowsBetween(W.unboundedPreceding, -1)
    ordered = (
        ranged.withColumn("_in_before", F.coalesce(F.sum("_b_size").over(w_in), F.lit(0)))
        .withColumn("_in_index", F.coalesce(F.count(F.lit(1)).over(w_in), F.lit(0)))
        .join(ranges, (F.col("_t_rank") == F.col("_r_rank")) & (F.col("_r") == F.col("_r_r")))
        .select(
            F.col("_t_rank").alias("_o_rank"),
            F.col("_b").alias("_o_b"),
            "_b_size",
            (F.col("_r_before") + F.col("_in_before")).alias("_o_before"),
            (F.col("_r_index") + F.col("_in_index")).alias("_o_index"),
        )
        .join(targets, F.col("_o_rank") == F.col("_t_rank"))
    )
    drawn = F.when(F.col("_o_before") < F.col("_t_extra"), 1).otherwise(0)
    # what the block gives once more: all of it, or the words that are missing at the border
    room = F.greatest(F.lit(0).cast("long"), F.least(F.col("_b_size"), F.col("_t_extra") - F.col("_o_before")))
    ordered = materialize(
        ordered.select(
            "_o_rank", "_o_b", "_b_size", "_o_index", "_t_copies", "_t_target", drawn.alias("_o_drawn"), room.alias("_o_room"),
            F.col("_t_size").alias("_o_source_size"), F.ceil(F.col("_t_docs") / block_docs).cast("long").alias("_o_blocks"),
        ),
        "mix-order",
    )
    draws = ordered.groupBy(F.col("_o_rank").alias("_t_rank")).agg(
        F.sum(F.col("_t_copies") + F.col("_o_drawn")).alias("_t_draws"), F.count(F.lit(1)).alias("_t_held")
    )
    quotas = shard_quotas(draws, shards, seed).join(
        draws.select(F.col("_t_rank").alias("_h_rank"), "_t_held"), F.col("_s_rank") == F.col("_h_rank")
    )
    shard_of = lambda copy: F.size(F.filter("_s_ends", lambda e: e <= copy * F.col("_t_held") + F.col("_o_index")))
    dealt = materialize(
        ordered.join(quotas, F.col("_o_rank") == F.col("_s_rank")).select(
            "_o_rank", "_o_b", "_b_size", "_o_room", "_t_copies", "_t_target", "_o_source_size",
            F.when(F.col("_t_copies") + F.col("_o_drawn") > 0, F.transform(F.sequence(F.lit(0), F.col("_t_copies") + F.col("_o_drawn") - 1), shard_of))
            .otherwise(F.array().cast("array<int>")).alias("_o_shards"),
        ),
        "mix-shards",
    )
    if with_rows:
        placed = placed_in(sized(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")))
    joined = placed.join(dealt, (F.col("_t_rank") == F.col("_o_rank")) & (F.col("_b") == F.col("_o_b")))
    at_border = (F.col("_o_room") > 0) & (F.col("_o_room") < F.col("_b_size"))
    w_docs = W.partitionBy("_o_rank", "_o_b").orderBy(F.xxhash64("_m_key", F.lit(seed + 2)), "_m_key", "_m_id", "_m_size")
    inside = joined.filter(at_border).withColumn(
        "_once_more",
        F.greatest(
            F.lit(0).cast("long"),
            F.least(
                F.col("_m_size"),
                F.col("_o_room") - F.coalesce(F.sum("_m_size").over(w_docs.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
            ),
        ),
    )
    outside = joined.filter(~at_border).withColumn("_once_more", F.when(F.col("_o_room") > 0, F.col("_m_size")).otherwise(F.lit(0).cast("long")))
    return outside.unionByName(inside).select(
        "_m_id",
        "_m_key",
        "_m_size",
        "_o_source_size",
        "_t_target",
        (F.col("_t_copies") * F.col("_m_size") + F.col("_once_more")).alias("_taken"),
        F.when(F.col("_once_more") > 0, F.col("_o_shards")).otherwise(F.slice("_o_shards", 1, F.col("_t_copies"))).alias("_shards"),
        *(["_row"] if with_rows else []),
    )


def mix(docs: DataFrame, shards: int = 16, block_docs: int = 1024, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and the shard of each copy taken."""
    names = {"_m_id": "doc_id", "_m_size": "size", "_o_source_size": "source_size", "_t_target": "target", "_taken": "taken", "_shards": "shards"}
    return _mix(docs, shards, block_docs, seed, False).select(*(F.col(c).alias(n) for c, n in names.items()))


ADDED = ("copy", "shard", "words", "local_order")


def mixed_rows(docs: DataFrame, shards: int = 16, block_docs: int = 1024, seed: int = 42) -> DataFrame:
    """The mix: a row of docs' columns for each copy that it takes, and its copy, shard, words and local_order, by which a
    shard is shuffled. A document that the border of its source cuts keeps its first words, and n_chars follows. Texts move once, to the blocks'
    table where that is too large to be sent to them."""
    taken = _mix(docs, shards, block_docs, seed, True).filter("_taken > 0")
    whole = F.least(F.col("_m_size"), F.col("_taken") - F.col("_copy") * F.col("_m_size"))
    copies = taken.select("_row", "_m_id", "_m_key", "_m_size", "_taken", F.posexplode("_shards").alias("_copy", "_shard")).withColumn("_words", whole).filter("_words > 0")
    cut = F.array_join(F.slice(words_of(F.col("_row.text")), F.lit(1), F.col("_words").cast("int")), " ")
    text = F.when(F.col("_words") < F.col("_m_size"), cut).otherwise(F.col("_row.text"))
    added = (F.col("_copy"), F.col("_shard"), F.col("_words"), F.xxhash64("_m_key", "_copy", F.lit(seed + 3)))
    renewed = {"text": text}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        renewed["n_chars"] = F.when(F.col("_words") < F.col("_m_size"), F.length(cut).cast(kind)).otherwise(F.col("_row.n_chars"))
    kept = (renewed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns if c not in ADDED)
    return copies.select(*kept, *(c.alias(n) for c, n in zip(added, ADDED)))


def write_shards(docs: DataFrame, path: str, shards: int = 16, block_docs: int = 1024, seed: int = 42) -> None:
    """The mix as files: docs' columns for each copy taken, in one folder per shard, in the shard's shuffled order.

    Rows are dealt by ranges of (shard, order), so that a shard is as many sorted files as its size needs.
    """
    rows = mixed_rows(docs, shards, block_docs, seed).drop("copy", "words").withColumnRenamed("shard", "_shard")
    out = rows.repartitionByRange("_shard", "local_order").sortWithinPartitions("_shard", "local_order")
    out.drop("local_order").write.mode("overwrite").partitionBy("_shard").parquet(path)
