"""From annotated spans to markers: one narrow pass, exploded before anything is shuffled."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specmark.functions.domains import (
    ACTIVE_COLUMN, CONTEXT_COLUMNS, EMOTION_COLUMNS, LINGUISTIC_COLUMNS, META_COLUMNS, MODE_COLUMNS, OTHER, REQUIRED_COLUMNS, STOPWORDS,
)
from specmark.functions.lemma import lemmas
from specmark.functions.numbers import float_text
from specmark.functions.text import is_blank, punctuation, words


def keep_annotations(annotations: DataFrame, include_empty: bool = False) -> DataFrame:
    """emotion units need a mode unless include_empty; other units stay; blank spans go."""
    kept = F.col("type") == OTHER
    kept = kept | ((F.col("type") == "SitEmo") & (F.lit(True) if include_empty else F.col("mode").isNotNull()))
    return annotations.filter(kept & ~is_blank(F.col("text_span")))


def explode_markers(
    df: DataFrame, text: str, use_lemma: bool = True, lemmatizer: str = "spacy", batch_size: int = 256, remove_stopwords: bool = False
) -> DataFrame:
    """Df with a row per marker: marker_type (word, punctuation, lemma) and marker_value."""

    def typed(values: Column, kind: str) -> Column:
        if remove_stopwords and kind != "punctuation":
            values = F.filter(values, lambda v: ~v.isin(*STOPWORDS))  # looked up in a hash set
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("marker_type"), v.alias("marker_value")))

    source = F.col(f"`{text}`")
    parts = [typed(words(source), "word"), typed(punctuation(source), "punctuation")]
    columns = [F.col(f"`{c}`") for c in df.columns]
    if use_lemma:
        df = df.withColumn("_lemmas", lemmas(source, lemmatizer, batch_size))
        parts.append(typed(F.col("_lemmas"), "lemma"))
    return df.select(*columns, F.inline(F.concat(*parts)))


def markers_of_annotations(annotations: DataFrame, include_empty: bool = False, narrow: bool = False, **options) -> DataFrame:
    """Markers of stand-off annotations. narrow: keys and classes only, without the text of the span in each row."""
    kept = keep_annotations(annotations, include_empty)
    marked = explode_markers(kept, "text_span", **options)
    return marked.select("corpus", "file_id", "unit_id", "type", "mode", "categorie1", "marker_type", "marker_value") if narrow else marked


def check_required(df: DataFrame) -> None:
    """F8."""
    missing = [c for c in REQUIRED_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def active_rows(df: DataFrame, include_empty: bool = False) -> DataFrame:
    """rows that carry an emotion, by the filter column or else by any one-hot; all rows if neither is there."""
    present = [c for c in EMOTION_COLUMNS if c in df.columns]
    if include_empty or not (ACTIVE_COLUMN in df.columns or present):
        return df
    if ACTIVE_COLUMN in df.columns:
        return df.filter(F.col(ACTIVE_COLUMN) == 1)
    return df.filter(reduce(lambda a, b: a + b, (F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in present)) > 0)


def propagated(df: DataFrame) -> list[str]:
    """the columns that go with each marker, as far as they are there."""
    wanted = (*REQUIRED_COLUMNS, *EMOTION_COLUMNS, *MODE_COLUMNS, *META_COLUMNS, ACTIVE_COLUMN, *LINGUISTIC_COLUMNS, *CONTEXT_COLUMNS, "source_file")
    return [c for c in wanted if c in df.columns]


def as_text(df: DataFrame, column: str) -> Column:
    """numbers and truth values as Python writes them."""
    kind, value = df.schema[column].dataType.typeName(), F.col(f"`{column}`")
    if kind in ("double", "float"):
        return float_text(value.cast("double"))
    return F.initcap(value.cast("string")) if kind == "boolean" else value.cast("string")


def markers_of_table(table: DataFrame, include_empty: bool = False, **options) -> DataFrame:
    """Markers of a one-hot table."""
    check_required(table)
    kept = active_rows(table, include_empty).select(*(F.col(f"`{c}`") for c in propagated(table)))
    kept = kept.withColumn("TEXT", as_text(kept, "TEXT")).filter(~is_blank(F.col("TEXT")))
    return explode_markers(kept, "TEXT", **options)


def active_names(df: DataFrame, names: dict[str, str]) -> Column:
    """The classes whose one-hot column is the number 1, in the order of the map."""
    flags = [F.when(F.col(f"`{c}`") == 1, F.lit(name)) for c, name in names.items() if c in df.columns and df.schema[c].dataType.typeName() != "string"]
    return F.array_compact(F.array(*flags)) if flags else F.array().cast("array<string>")


def onehot_to_classes(df: DataFrame) -> DataFrame:
    """A row per active emotion (Autre if none) and mode (null if none); counts grow with both, as intended."""
    emotions, modes = active_names(df, EMOTION_COLUMNS), active_names(df, MODE_COLUMNS)
    crossed = df.withColumn("categorie1", F.explode(F.when(F.size(emotions) == 0, F.array(F.lit(OTHER))).otherwise(emotions)))
    return crossed.withColumn("mode", F.explode_outer(modes)).withColumn("type", F.lit("SitEmo"))
