"""The stages as an API: parse, markers, specificity, for stand-off annotations and for one-hot tables.

Stages are independent; what passes between them is a DataFrame, or Parquet where a directory is given.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from specmark.functions.domains import EMOTIONS, MODES
from specmark.operators import comparison as C
from specmark.operators import entropy as E
from specmark.operators import markers as M
from specmark.operators import ranking as R
from specmark.plans.report import hypothesis_report
from specmark.sources import glozz, sinks, tabular
from specmark.sources.store import exists


@dataclass
class Specificity:
    """What one run of the last stage gives."""

    by_emotion: DataFrame
    by_mode: DataFrame
    summary: DataFrame
    of_modes: DataFrame
    figures: dict[str, int] | None = None  # of the stage that parses, where it ran

    def report(self) -> str:
        return hypothesis_report(self.of_modes)

    def write(self, directory: str, with_report: bool = True, summary_name: str = "entropy_by_mode_summary.csv") -> None:
        """K3, K4: the tables per marker as folders of CSV parts in order, the summary as one file."""
        sinks.write_csv(E.by_entropy(self.by_emotion), f"{directory}/entropy_per_marker_emotion.csv")
        sinks.write_csv(E.by_entropy(self.by_mode), f"{directory}/entropy_per_marker_mode.csv")
        sinks.write_summary(self.summary, f"{directory}/{summary_name}")
        if with_report:
            sinks.write_text(self.summary.sparkSession, f"{directory}/hypothesis_report.txt", self.report())


def parse(
    spark: SparkSession, directories: dict[str, str], only: str | None = None, ordered: bool = True, figures: Observation | None = None
) -> DataFrame:
    return glozz.read_corpora(spark, directories, only, ordered, figures)


def write_annotations(spark: SparkSession, directories: dict[str, str], path: str, only: str | None = None) -> dict[str, int]:
    """A folder per corpus; returns the figures, which are taken while the rows are written."""
    figures = Observation("annotations")
    sinks.write_table(parse(spark, directories, only, ordered=False, figures=figures), path, "corpus")  # what follows only counts
    return figures.get


def read_stage(spark: SparkSession, path: str, only: str | None = None) -> DataFrame:
    """What a stage has written, of all corpora or of one, whose folder alone is read then. Names of folders are texts."""
    found = spark.read.parquet(path).schema
    texts = StructType([StructField(f.name, StringType()) if f.name in ("corpus", "marker_type") else f for f in found])
    rows = spark.read.schema(texts).parquet(path)
    return rows.filter(F.col("corpus") == only) if only else rows


def markers(annotations: DataFrame, use_lemma: bool = True, lemmatizer: str = "spacy", batch_size: int = 256, include_empty: bool = False, remove_stopwords: bool = False) -> DataFrame:
    return M.markers_of_annotations(
        annotations, include_empty, use_lemma=use_lemma, lemmatizer=lemmatizer, batch_size=batch_size, remove_stopwords=remove_stopwords
    )


def specificity(marked: DataFrame, min_freq: int = 3, marker_type: str = "all") -> Specificity:
    """F13 and the entropy stage. marked is read several times: persist it, or read it from where it was written."""
    rows = marked if marker_type == "all" else marked.filter(marked["marker_type"] == marker_type)
    by_emotion = E.conditional_entropy(rows, "categorie1", EMOTIONS, min_freq)
    by_mode = E.conditional_entropy(rows, "mode", MODES, min_freq)
    of_modes = E.entropy_of_modes(rows, "categorie1", EMOTIONS, min_freq)
    return Specificity(by_emotion, by_mode, E.summarise_modes(of_modes), of_modes)


def markers_of_folder(spark: SparkSession, folder: str, use_lemma: bool = True, lemmatizer: str = "spacy") -> DataFrame:
    """The one-hot path: all workbooks, with rows without emotion, then classes."""
    return M.onehot_to_classes(M.markers_of_table(tabular.read_folder(spark, folder), include_empty=True, use_lemma=use_lemma, lemmatizer=lemmatizer))


def run_annotations(spark: SparkSession, directories: dict[str, str], output: str, min_freq: int = 3, marker_type: str = "all", only: str | None = None, **options) -> Specificity:
    """All stages over stand-off annotations; Parquet between them, by corpus."""
    figures = write_annotations(spark, directories, f"{output}/annotations", only)
    sinks.write_table(markers(read_stage(spark, f"{output}/annotations"), **options), f"{output}/markers", "corpus", "marker_type")
    result = specificity(read_stage(spark, f"{output}/markers"), min_freq, marker_type)
    result.figures = figures
    result.write(f"{output}/specificity_results")
    return result


def run_tables(spark: SparkSession, folder: str, output: str, min_freq: int = 5, use_lemma: bool = True, lemmatizer: str = "spacy") -> Specificity:
    """All stages over one-hot tables. No report is written for these."""
    sinks.write_table(markers_of_folder(spark, folder, use_lemma, lemmatizer), f"{output}/markers", "marker_type")
    result = specificity(spark.read.parquet(f"{output}/markers"), min_freq)
    result.write(f"{output}/specificity_results", with_report=False, summary_name="mean_entropy_by_mode.csv")
    return result


def top_markers(result: Specificity, n: int = 20) -> dict[str, DataFrame]:
    return {"emotion": R.top_markers(result.by_emotion, n), "mode": R.top_markers(result.by_mode, n)}


def read_markers(spark: SparkSession, path: str) -> DataFrame | None:
    """Markers that a run has written (Parquet folder, or CSV); None if there are none."""
    if not exists(spark, path):
        return None
    return tabular.read_csv(spark, path) if path.lower().endswith(".csv") else spark.read.parquet(path)


def designated(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The designated markers of one corpus, over all runs named (one per lemmatiser, say); missing runs have none."""
    found = []
    for path in paths:
        marked = read_markers(spark, path)
        if marked is not None:
            rows = marked.filter(marked["`Désignée`"] == 1) if "Désignée" in marked.columns else marked.filter(C.is_designee(marked["mode"]))
            found.append(C.marker_set(rows))
    return reduce(lambda a, b: a.union(b), found).distinct() if found else spark.createDataFrame([], "marker string")


def dashboard(spark: SparkSession, annotation_paths: list[str], table_paths: list[str]) -> DataFrame:
    """A13 over the markers that runs have written."""
    items = [C.items_of_annotations(m) for p in annotation_paths if (m := read_markers(spark, p)) is not None]
    items += [C.items_of_table(m) for p in table_paths if (m := read_markers(spark, p)) is not None and "Désignée" in m.columns]
    return C.dashboard_sets(*items) if items else spark.createDataFrame([], "marker string, corpora array<string>, emotions array<string>")
