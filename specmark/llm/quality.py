"""Quality rules with adaptive thresholds (native).

Per document, signals come from built-in expressions alone. Per (lang, source) group, each signal has a mergeable
quantile sketch: counts of documents in logarithmic buckets, which give every quantile within ``ACCURACY`` of its value
(DDSketch: Masson, Rim & Lee, 2019). A sketch is rows of integers, so it is merged by adding and does not depend on how
the documents are dealt or in which order they are read: reruns give the same fences. Sketches are built with partial
aggregation, so a hot source costs a few hundred rows per task; a text counts once in its group however many copies it
has, so that a group of copies does not set the thresholds, and texts that fail the base rule do not count. The fence of
a signal lies beyond the upper quartile of the group,

    fence = upper quartile + REACH * spread,    spread = upper - lower quartile

and a document is rejected if a signal lies above its fence by more than ``NOISE`` standard errors of its count, which
spares short texts. No cutoff is fixed: the signals are chosen so that they are spread out in ordinary text. Groups of
fewer than ``min_group`` texts take the sketch of their language, merged from those of its groups, or else that of the
corpus. A spread is taken to be half the usual one at least (the median over groups, from a sketch of their spreads), so
that a group of much alike texts does not reject what is ordinary elsewhere. The thresholds (one row per group) are
joined back.

Null and empty texts, and texts of white space, have no words and fail the base rule. Null languages and sources are
groups of their own. Repeated rows and equal texts of a group are judged alike, one result each. A value on its fence is
kept. A very long text costs n log n in its words. An empty table gives no rows. Columns of the input other than those
named are carried through by ``filter_quality``, whatever their names, and ignored elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specmark.llm.common import SPACE, computed_once, materialize, packed, text_of, unpacked, words_of

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
GRAM = 5

#: Relative error of the sketches' quantiles; values below LEAST share the bucket of zero.
ACCURACY = 0.01
LEAST = 1e-4
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)

REACH = 4.0
NOISE = 2.0
#: What a spread is at least, as a share of the usual spread of a group.
LEAST_SHARE = 0.5


@dataclass(frozen=True)
class Signal:
    """A value that high values of speak against a document. count: the counter of a ratio, whose noise is known."""

    name: str
    count: str | None = None


SIGNALS = (
    Signal("sign_ratio", "n_signs"),  # signs that are neither letters nor digits
    Signal("upper_ratio", "n_upper"),
    Signal("monotony", None),  # 1 - ln(different words + 1) / ln(words + 1), which hardly depends on the length
)


def _left_of(text: Column, keep: str) -> Column:
    """Code points that are left when everything but the class is cut out."""
    return F.length(F.regexp_replace(text, keep, ""))


def _repeat_words(hashes: str) -> Column:
    """Words in windows whose hash occurs twice; n log n in the windows of one text, and free where all differ."""
    # walk the (hash, place) pairs in order and note both places wherever a hash meets its equal
    pairs = F.sort_array(F.transform(F.col(hashes), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.lit(None).cast("struct<h:bigint,i:int>")
    pairs_of = F.zip_with(
        F.concat(F.array(none), pairs),
        F.concat(pairs, F.array(none)),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
    )
    starts = F.sort_array(F.array_distinct(F.flatten(pairs_of)))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-GRAM).alias("last")),
        lambda acc, x: F.struct((acc["n"] + F.least(x - acc["last"], F.lit(GRAM))).alias("n"), x.alias("last")),
        lambda acc: acc["n"],
    )
    return F.when(F.size(F.array_distinct(F.col(hashes))) == F.size(F.col(hashes)), F.lit(0)).otherwise(covered)


def quality_signals(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The carried columns, the counts of the base rule and the signals (prefixed ``_q_``) that the method judges."""
    text = text_of("_q_text")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    gram = "xxhash64(" + ", ".join(f"_q_words[i + {k}]" for k in range(GRAM)) + ")"
    parts = docs.select(*carry, F.col("text").cast("string").alias("_q_text")).select(
        *carry, text.alias("_q_text"), words_of(text).alias("_q_words"), lines.alias("_q_lines")
    )
    hashed = parts.select(
        *carry,
        "_q_text",
        "_q_lines",
        F.size("_q_words").alias("_q_size"),
        F.size(F.array_distinct("_q_words")).alias("_q_different"),
        F.expr(
            f"CASE WHEN size(_q_words) < {GRAM} THEN cast(array() AS array<bigint>)"
            f" ELSE transform(sequence(0, size(_q_words) - {GRAM}), i -> {gram}) END"
        ).alias("_q_hashes"),
    )
    counted = computed_once(
        hashed,
        carry,
        [
            F.xxhash64("_q_text").alias("_q_key"),
            F.col("_q_size").cast("long").alias("_q_n_words"),
            (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long").alias("_q_n_dup_lines"),
            _left_of(F.col("_q_text"), SPACE).cast("long").alias("_q_word_chars"),
            _left_of(F.col("_q_text"), r"[^#*$%&|<>]+").cast("long").alias("_q_n_symbols"),
            _left_of(F.col("_q_text"), r"[\p{L}\p{M}\p{N}\s]+").cast("long").alias("_q_n_signs"),
            _left_of(F.col("_q_text"), r"[^\p{Lu}]+").cast("long").alias("_q_n_upper"),
            _repeat_words("_q_hashes").cast("long").alias("_q_n_repeat_words"),
            (1 - F.log(F.col("_q_different") + 1.0) / F.log(F.greatest("_q_size", F.lit(1)) + 1.0)).alias("_q_monotony"),
        ],
    )

    def ratio(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))

    return counted.select(
        "*",
        *(ratio(f"_q_{s.count}", "_q_word_chars").alias(f"_q_{s.name}") for s in SIGNALS if s.count),
        (
            (F.col("_q_n_words") < MIN_WORDS)
            | (100 * F.col("_q_n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_q_n_words"))
        ).alias("_q_base_failed"),
    )


def _bucket(value: Column) -> Column:
    return F.when(value < LEAST, F.lit(-1)).otherwise(F.ceil(F.log(value / LEAST) / log(GAMMA)).cast("int"))


def _value(bucket: Column) -> Column:
    return F.when(bucket < 0, F.lit(0.0)).otherwise(F.lit(LEAST) * F.pow(F.lit(GAMMA), bucket) * (2 / (GAMMA + 1)))


def sketch_groups(signals: DataFrame) -> DataFrame:
    """The sketches: lang, source, _q_signal, _q_bucket and _q_n, the number of different texts. Sketches of batches without
    a text in common are merged by adding (``merge_sketches``)."""
    buckets = [_bucket(F.col(f"_q_{s.name}")).alias(f"_q_b{i}") for i, s in enumerate(SIGNALS)]
    texts = signals.filter(~F.col("_q_base_failed")).select("lang", "source", "_q_key", *buckets).distinct()
    pairs = F.array(*(F.struct(F.lit(i).alias("_q_signal"), F.col(f"_q_b{i}").alias("_q_bucket")) for i in range(len(SIGNALS))))
    return texts.select("lang", "source", F.inline(pairs)).groupBy("lang", "source", "_q_signal", "_q_bucket").agg(F.count(F.lit(1)).alias("_q_n"))


def merge_sketches(sketches: DataFrame, *keys: str) -> DataFrame:
    """Sketches of coarser groups from those of finer ones, without another look at the documents."""
    return sketches.groupBy(*keys, "_q_signal", "_q_bucket").agg(F.sum("_q_n").alias("_q_n"))


def sketch_quantiles(sketches: DataFrame, *keys: str, quantiles: dict[str, float]) -> DataFrame:
    """One row per group: _q_n texts, and for each signal i and quantile by name _q_<name><i>."""
    by = W.partitionBy(*keys, "_q_signal")
    upto = F.sum("_q_n").over(by.orderBy("_q_bucket").rowsBetween(W.unboundedPreceding, 0))
    placed = sketches.withColumn("_q_upto", upto).withColumn("_q_all", F.sum("_q_n").over(by))

    def value(i: int, q: float) -> Column:
        within = (F.col("_q_signal") == i) & (F.col("_q_upto") > F.floor(q * (F.col("_q_all") - 1)))
        return _value(F.min(F.when(within, F.col("_q_bucket"))))

    columns = [value(i, q).alias(f"_q_{name}{i}") for i in range(len(SIGNALS)) for name, q in quantiles.items()]
    return placed.groupBy(*keys).agg(F.max("_q_all").alias("_q_n"), *columns)


def adaptive_thresholds(sketches: DataFrame, min_group: int = 50) -> DataFrame:
    """_q_lang, _q_source and a fence _q_f_<signal> for each signal, from the finest of (lang, source), lang and corpus with
    min_group texts. The corpus takes its own, however few there are."""
    signals = range(len(SIGNALS))
    # prefixed by the level: the texts, the upper quartile and the spread of each signal
    def level(df: DataFrame, name: str, *keys: str) -> DataFrame:
        quartiles = sketch_quantiles(df, *keys, quantiles={"low": 0.25, "high": 0.75})
        spread = [(F.col(f"_q_high{i}") - F.col(f"_q_low{i}")).alias(f"_q_{name}_spread{i}") for i in signals]
        return quartiles.select(*keys, F.col("_q_n").alias(f"_q_{name}_n"), *(F.col(f"_q_high{i}").alias(f"_q_{name}_high{i}") for i in signals), *spread)

    groups = level(sketches, "g", "lang", "source")
    langs = level(merge_sketches(sketches, "lang"), "l", "lang").withColumnRenamed("lang", "_q_of")
    whole = level(merge_sketches(sketches), "w").first()  # one row, of nulls where the table is empty
    # the spreads of the groups have a sketch too, each with the weight of its texts
    pairs = F.array(*(F.struct(F.lit(i).alias("_q_signal"), _bucket(F.col(f"_q_g_spread{i}")).alias("_q_bucket")) for i in signals))
    spreads = groups.filter(F.col("_q_g_n") >= min_group).select(F.col("_q_g_n").alias("_q_n"), F.inline(pairs))
    usual = sketch_quantiles(merge_sketches(spreads), quantiles={"usual": 0.5}).first()

    def fence(i: int) -> Column:
        def at(name: str) -> Column:
            high, spread = F.col(f"_q_{name}_high{i}"), F.col(f"_q_{name}_spread{i}")
            return high + REACH * F.greatest(spread, F.lit(LEAST_SHARE * (usual[f"_q_usual{i}"] or 0.0)), 2 * ACCURACY * high)

        of_whole = F.lit(None).cast("double")
        if whole["_q_w_n"]:
            high, spread = whole[f"_q_w_high{i}"], whole[f"_q_w_spread{i}"]
            of_whole = F.lit(high + REACH * max(spread, 2 * ACCURACY * high))
        return F.when(F.col("_q_g_n") >= min_group, at("g")).when(F.col("_q_l_n") >= min_group, at("l")).otherwise(of_whole)

    joined = groups.join(langs, F.col("lang").eqNullSafe(F.col("_q_of")))
    return joined.select(
        F.col("lang").alias("_q_lang"), F.col("source").alias("_q_source"), *(fence(i).alias(f"_q_f_{s.name}") for i, s in enumerate(SIGNALS))
    )


def judge(signals: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Adds ``_q_kept``: false where the base rule fails or a signal lies above its fence. All texts of a group without
    fences fail the base rule."""
    same = F.col("lang").eqNullSafe(F.col("_q_lang")) & F.col("source").eqNullSafe(F.col("_q_source"))
    within = ~F.col("_q_base_failed")
    for s in SIGNALS:
        fence, value = F.coalesce(F.col(f"_q_f_{s.name}"), F.lit(float("inf"))), F.col(f"_q_{s.name}")
        if s.count:
            n = F.col(f"_q_{s.count}").cast("double")
            value = F.coalesce(F.try_divide(n - NOISE * F.sqrt(n), F.col("_q_word_chars").cast("double")), F.lit(0.0))
        within = within & (value <= fence)
    return signals.join(thresholds, same, "left").withColumn("_q_kept", within)


def quality_report(docs: DataFrame, min_group: int = 50) -> DataFrame:
    """One row per document: the counts of the base rule and both verdicts."""
    signals = materialize(quality_signals(docs.select("doc_id", "lang", "source", "text"), ["doc_id", "lang", "source"]), "quality-signals")
    judged = judge(signals, materialize(adaptive_thresholds(sketch_groups(signals), min_group), "quality-fences"))
    return judged.select(
        "doc_id",
        *(F.col(f"_q_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")),
        F.col("_q_kept").alias("kept"),
        *(F.col(f"_q_{s.name}").alias(s.name) for s in SIGNALS),
    )


def filter_quality(docs: DataFrame, min_group: int = 50) -> DataFrame:
    """The documents that pass, with their own columns. Texts are read twice and never shuffled by group."""
    signals = quality_signals(docs.select("lang", "source", "text"), ["lang", "source"])
    sketches = materialize(sketch_groups(signals), "quality-sketches")  # read three times
    thresholds = materialize(adaptive_thresholds(sketches, min_group), "quality-fences")
    rows = packed(docs, F.col("lang").alias("lang"), F.col("source").alias("source"), F.col("text").alias("text"))
    carried = quality_signals(rows, ["_row", "lang", "source"])
    return unpacked(judge(carried, thresholds).filter("_q_kept"), docs.columns)
