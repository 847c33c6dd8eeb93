"""Command line: python -m specmark {annotations,tables,top,compare,dashboard} ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from specmark.operators import comparison as C
from specmark.operators import ranking as R
from specmark.plans import analysis
from specmark.sources import sinks, tabular


def _corpora(values: list[str]) -> dict[str, str]:
    """name=directory pairs; a bare directory is named by its last part."""
    return {v.split("=", 1)[0] if "=" in v else v.rstrip("/").rsplit("/", 1)[-1]: v.split("=", 1)[-1] for v in values}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="specmark", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("annotations", help="stand-off annotations: parse, mark, measure")
    a.add_argument("corpora", nargs="+", help="directories with aa/ and ac/, or name=directory")
    a.add_argument("--step", choices=("all", "parse", "markers", "specificity"), default="all")
    a.add_argument("--corpus", help="only this one")
    a.add_argument("--batch-size", type=int, default=256)
    a.add_argument("--include-empty", action="store_true")
    a.add_argument("--remove-stopwords", action="store_true")
    a.add_argument("--marker-type", choices=("word", "lemma", "punctuation", "all"), default="all")
    a.add_argument("--min-freq", type=int, default=3)
    t = sub.add_parser("tables", help="one-hot workbooks of a folder")
    t.add_argument("input_dir")
    t.add_argument("--min-freq", type=int, default=5)
    for x in (a, t):
        x.add_argument("--output-dir", required=True)
        x.add_argument("--no-lemma", action="store_true")
        x.add_argument("--lemmatizer", default="spacy")
    top = sub.add_parser("top", help="the most specific markers per class of an entropy table")
    top.add_argument("table")
    top.add_argument("--top", type=int, default=20)
    top.add_argument("--export")
    for name in ("compare", "dashboard"):
        c = sub.add_parser(name)
        c.add_argument("--annotations", nargs="*", default=[], help="markers of annotated corpora")
        c.add_argument("--tables", nargs="*", default=[], help="markers of one-hot tables")
        if name == "dashboard":
            c.add_argument("--output", required=True)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    o = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("specmark").getOrCreate()
    if o.command == "annotations":
        out = o.output_dir
        if o.step in ("all", "parse"):
            for name, n in analysis.write_annotations(spark, _corpora(o.corpora), f"{out}/annotations", o.corpus).items():
                print(f"{name}: {n}")
        if o.step in ("all", "markers"):
            marked = analysis.markers(
                analysis.read_stage(spark, f"{out}/annotations", o.corpus), not o.no_lemma, o.lemmatizer, o.batch_size, o.include_empty, o.remove_stopwords
            )
            sinks.write_table(marked, f"{out}/markers", "corpus", "marker_type")
        if o.step in ("all", "specificity"):
            analysis.specificity(analysis.read_stage(spark, f"{out}/markers", o.corpus), o.min_freq, o.marker_type).write(f"{out}/specificity_results")
    elif o.command == "tables":
        analysis.run_tables(spark, o.input_dir, o.output_dir, o.min_freq, not o.no_lemma, o.lemmatizer)
    elif o.command == "top":
        rows = R.top_markers(tabular.read_csv(spark, o.table), o.top)
        sinks.show(rows, 1000)
        if o.export:
            sinks.write_summary(rows, o.export)
    elif o.command == "compare":
        left, right = analysis.designated(spark, o.tables), analysis.designated(spark, o.annotations)
        sinks.show(C.set_sizes(left, right))
        for name, rows in C.compare(left, right).items():
            print(name)
            sinks.show(C.sample_markers(rows), 30)
    else:
        sinks.write_dashboard(analysis.dashboard(spark, o.annotations, o.tables), o.output)


if __name__ == "__main__":
    main()
