"""Stand-off annotations: XML units beside raw texts.

Both file sets are read by Spark's own source for binary files, so any store that Spark reads will do, and are joined on the
basename, a row per file. An annotation file is read by events: units are found at any depth and sent on one by one. Spark's
XML source can neither tell an empty element from a missing one nor drop a file for an error further on; here a file is
checked to its end first, which keeps nothing, and is dropped whole at its first error. A text that is not UTF-8 is dropped
with its annotations. Offsets count code points, so spans are cut where the whole text is at hand.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from specmark.functions.domains import MODES, UNIT_TYPES
from specmark.sources.store import exists

_UNIT = "unit_id string, type string, start_idx int, end_idx int, text_span string, mode string, categorie1 string, categorie2 string, remarque string"
ANNOTATIONS = f"corpus string, file_id string, {_UNIT}"
_COLUMNS = [c.split()[0] for c in _UNIT.split(", ")]
#: Features that a unit of each type carries, by column.
_FEATURES = {"mode": ("SitEmo", "Mode"), "categorie1": ("SitEmo", "Categorie"), "categorie2": ("SitEmo", "Categorie2"), "remarque": ("Autre", "Remarque")}
_MOST = 2**31 - 1
_BATCH = 4096


def _file_id(suffix: str) -> Column:
    """The basename without suffix; paths come percent-encoded, with a plus as itself."""
    name = F.regexp_replace(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1), r"\+", "%2B")
    return F.regexp_replace(F.url_decode(name), rf"\{suffix}$", "")


def is_well_formed(content: bytes) -> bool:
    try:
        expat.ParserCreate(None, "}").Parse(content, True)
    except expat.ExpatError:
        return False
    return True


def elements(content: bytes, tag: str) -> Iterator[tuple[int, ElementTree.Element]]:
    """(place in the document, element) of each element of that name below the root; what is behind them is let go."""
    at, depth, within, root = -1, 0, [], None
    for event, node in ElementTree.iterparse(io.BytesIO(content), ("start", "end")):
        if event == "start":
            if root is None:
                root = node
            elif node.tag == tag:
                at += 1
                within.append(at)
            depth += 1
            continue
        depth -= 1
        if node.tag == tag and depth:
            yield within.pop(), node
        if depth == 1:
            root.clear()
        elif not within and depth:
            node.clear()


def _offset(unit: ElementTree.Element, side: str) -> int | None:
    """-1 without the attribute; None, for which the unit goes, without the element or where it is no number."""
    place = unit.find(f"./positioning/{side}/singlePosition")
    if place is None:
        return None
    try:
        number = int(place.get("index", "-1"))
    except ValueError:
        return None
    return max(-_MOST, min(_MOST, number))  # no text has offsets beyond


def unit_of(node: ElementTree.Element) -> dict | None:
    """what is kept of a unit, or None."""
    kind = (node.findtext("./characterisation/type") or "").strip()
    start, end = _offset(node, "start"), _offset(node, "end")
    if kind not in UNIT_TYPES or start is None or end is None:
        return None
    written = {f.get("name", ""): (f.text or "").strip() or None for f in node.iterfind("./characterisation/featureSet/feature")}  # the last of a name
    features = {c: written.get(name) if kind == of else None for c, (of, name) in _FEATURES.items()}
    return {"unit_id": node.get("id", ""), "type": kind, "start_idx": start, "end_idx": end, **features}


def text_of(content: bytes) -> str | None:
    """UTF-8 with a leading BOM kept, line ends as one line feed; None where it is not UTF-8."""
    try:
        return content.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")
    except UnicodeDecodeError:
        return None


def _files(spark: SparkSession, path: str, suffix: str, column: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path)
    return files.select(_file_id(suffix).alias("file_id"), F.col("content").alias(column))


def span_of(text: Column, start: Column, end: Column) -> Column:
    """the span by code-point offsets, line ends as blanks; empty where the offsets do not fit."""
    fits = (start >= 0) & (start <= end) & (end <= F.length(text))
    return F.translate(F.when(fits, F.substring(text, start + 1, end - start)).otherwise(""), "\n\r", "  ")


def _annotate(batches):
    """Units and their spans from pairs of files (file_id, aa, ac), a few thousand rows at a time; a row of its own tells why a
    file is skipped."""
    schema = pa.schema([("file_id", pa.string()), *((c, pa.int32() if c.endswith("_idx") else pa.string()) for c in _COLUMNS), ("_at", pa.int64()), ("_skipped", pa.string())])
    rows: list[dict] = []
    for batch in batches:
        for k in range(batch.num_rows):
            file_id, aa, ac = (batch.column(j)[k].as_py() for j in range(3))
            text = None if ac is None else text_of(ac)
            skipped = "no_text" if ac is None else "not_utf8" if text is None else None if is_well_formed(aa) else "malformed"
            if skipped:
                rows.append({"file_id": file_id, "_skipped": skipped})
                continue
            for at, node in elements(aa, "unit"):
                unit = unit_of(node)
                if unit is None:
                    continue
                start, end = unit["start_idx"], unit["end_idx"]
                fits = 0 <= start <= end <= len(text)
                rows.append(unit | {"file_id": file_id, "text_span": text[start:end].replace("\n", " ") if fits else "", "_at": at})
                if len(rows) == _BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
    yield pa.RecordBatch.from_pylist(rows, schema)


def read_corpus(spark: SparkSession, directory: str, corpus: str) -> DataFrame | None:
    """The annotations of one corpus directory (aa/ and ac/), with their place in the file, and a row for each file that is
    skipped, with the reason; None if the directory is not there (S7)."""
    aa, ac = f"{directory}/aa", f"{directory}/ac"
    if not (exists(spark, aa) and exists(spark, ac)):
        return None
    pairs = _files(spark, aa, ".aa", "aa").join(_files(spark, ac, ".ac", "ac"), "file_id", "left")
    return pairs.mapInArrow(_annotate, f"file_id string, {_UNIT}, _at long, _skipped string").select(F.lit(corpus).alias("corpus"), "*")


def figures_of(rows: DataFrame) -> list[Column]:
    """How many units there are of each type and mode, and how many files are skipped for each reason."""
    of = lambda c, v: F.count_if(F.col(c) == v)
    situation = F.col("type") == UNIT_TYPES[0]
    return [
        *(of("type", t).alias(f"type {t}") for t in UNIT_TYPES), *(of("mode", m).alias(f"mode {m}") for m in MODES),
        F.count_if(situation & F.col("mode").isNull()).alias("mode none"), F.count_if(situation & ~F.col("mode").isin(*MODES)).alias("mode other"),
        *(of("_skipped", r).alias(f"skipped {r}") for r in ("no_text", "not_utf8", "malformed")),
    ]


def read_corpora(
    spark: SparkSession, directories: dict[str, str], only: str | None = None, ordered: bool = True, figures: Observation | None = None
) -> DataFrame:
    """All corpora, or one; rows in order of corpus, file and unit, unless their order does not matter.

    figures takes the counts of ``figures_of`` while the rows are first written or counted, without a job of its own.
    """
    chosen = {k: v for k, v in directories.items() if only in (None, k)}
    found = [df for name, path in chosen.items() if (df := read_corpus(spark, path, name)) is not None]
    if not found:
        empty = spark.createDataFrame([], f"{ANNOTATIONS}, _skipped string")
        return (empty.observe(figures, *figures_of(empty)) if figures else empty).drop("_skipped")
    rows = reduce(lambda a, b: a.unionByName(b), found)
    if figures:
        rows = rows.observe(figures, *figures_of(rows))
    rows = rows.filter("_skipped IS NULL").drop("_skipped")
    if not ordered:
        return rows.drop("_at")
    place = F.array_position(F.array(*(F.lit(c) for c in chosen)), F.col("corpus"))
    return rows.orderBy(place, "file_id", "_at").drop("_at")


def unpaired(spark: SparkSession, directory: str) -> DataFrame:
    """Basenames of .aa files that have no text and are skipped."""
    texts = _files(spark, f"{directory}/ac", ".ac", "ac").filter(F.is_valid_utf8(F.col("ac").cast("string"))).select("file_id")
    return _files(spark, f"{directory}/aa", ".aa", "aa").select("file_id").join(texts, "file_id", "left_anti")
