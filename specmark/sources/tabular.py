"""One-hot tables from CSV and Excel files (S9-S14, F7 input, F10).

Excel files are read as binary files, so from any store that Spark reads, which a data source in Python could not open; they
are unpacked on the executors with the standard library: a workbook is a ZIP of XML parts. One look at the first rows names
the columns of all workbooks; then each is opened once, whatever its layout, and its sheet is read by events and sent on row
by row, as cells by column name. One-hot columns keep numbers only, as a text "1" does not mark a class.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from itertools import batched
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specmark.functions.domains import ACTIVE_COLUMN, EMOTION_COLUMNS, META_COLUMNS, MODE_COLUMNS
from specmark.sources.store import kept

NUMERIC = (*EMOTION_COLUMNS, *MODE_COLUMNS, *META_COLUMNS, ACTIVE_COLUMN)
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _column_number(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _string(node) -> str:
    """The runs of a string, without phonetic guides."""
    return "".join(t.text or "" for child in node for t in ([child] if child.tag == f"{_NS}t" else child.findall(f"{_NS}t") if child.tag == f"{_NS}r" else []))


def _elements(part, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of that name, one at a time; each is let go when the next is asked for."""
    parents: list[ElementTree.Element] = []
    for event, node in ElementTree.iterparse(part, ("start", "end")):
        if event == "start":
            parents.append(node)
            continue
        parents.pop()
        if node.tag == tag:
            yield node
            if parents:
                parents[-1].clear()


def _first_sheet(z: zipfile.ZipFile) -> str:
    names = z.namelist()
    if "xl/workbook.xml" in names and "xl/_rels/workbook.xml.rels" in names:
        sheets = ElementTree.fromstring(z.read("xl/workbook.xml")).find(f"{_NS}sheets")
        rid = sheets[0].get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id")
        for rel in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")):
            if rel.get("Id") == rid:
                return "xl/" + rel.get("Target").removeprefix("/xl/").removeprefix("xl/")
    return "xl/worksheets/sheet1.xml"


def workbook_rows(content: bytes) -> Iterator[list[tuple[float | None, str] | None]]:
    """Rows of the first sheet, one by one; a cell is (number, text) or None."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as part:
                shared = [_string(si) for si in _elements(part, f"{_NS}si")]
        with z.open(_first_sheet(z)) as part:
            for row in _elements(part, f"{_NS}row"):
                cells: list[tuple[float | None, str] | None] = []
                for cell in row.findall(f"{_NS}c"):
                    at = _column_number(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    kind, value = cell.get("t", "n"), cell.findtext(f"{_NS}v")
                    if kind == "inlineStr":
                        cells[at] = (None, _string(cell.find(f"{_NS}is")))
                    elif value is None or kind == "e":
                        continue
                    elif kind == "s":
                        cells[at] = (None, shared[int(value)])
                    elif kind == "b":
                        cells[at] = (float(value), "True" if value == "1" else "False")
                    elif kind == "n":
                        number = float(value)
                        cells[at] = (number, str(int(number)) if number.is_integer() else repr(number))
                    else:
                        cells[at] = (None, value)
                yield cells


def _header(rows: Iterator[list]) -> list[str | None]:
    """Names by place, from the first row; a name that occurs again is numbered, and a blank one is None."""
    names: list[str | None] = []
    for cell in next(rows, []):
        name = cell[1] if cell and cell[1] else None
        again = 0
        while name is not None and (name if not again else f"{name}.{again}") in names:
            again += 1
        names.append(f"{name}.{again}" if again else name)
    return names


def _headers(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            names = [n for n in _header(workbook_rows(batch.column(1)[k].as_py())) if n]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([names], pa.list_(pa.string()))], names=["source_file", "header"])


_CELLS = pa.map_(pa.string(), pa.struct([("number", pa.float64()), ("text", pa.string()), ("pointed", pa.string())]))


def _rows(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            rows = workbook_rows(batch.column(1)[k].as_py())
            names = _header(rows)
            for part in batched(rows, 2048):
                cells = [[(n, {"number": c[0], "text": c[1], "pointed": c[1] if c[0] is None else repr(c[0])}) for n, c in zip(names, row) if n and c] for row in part]
                files = pa.array([batch.column(0)[k].as_py()] * len(part))
                yield pa.RecordBatch.from_arrays([files, pa.array(cells, _CELLS)], names=["source_file", "cells"])


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """All workbooks of a path or glob, one schema over the union of their columns, with source_file."""
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("source_file"), "content")
    headers = files.mapInArrow(_headers, "source_file string, header array<string>")
    layouts = headers.groupBy("header").agg(F.min("source_file").alias("first")).orderBy("first").collect()  # a row per layout
    names = list(dict.fromkeys(n for layout in layouts for n in layout.header))
    if not names:
        raise ValueError(f"no rows in {path}")
    rows = files.mapInArrow(_rows, "source_file string, cells map<string, struct<number:double,text:string,pointed:string>>")
    texts = [n for n in names if n not in NUMERIC]
    rows, pointed = _with_points(kept(rows, "workbook-rows"), texts)
    cell = lambda n: F.col("cells")[n]
    shown = {n: F.when(pointed[n], cell(n)["pointed"]).otherwise(cell(n)["text"]) for n in texts}
    return rows.select(*((shown[n] if n in shown else cell(n)["number"]).alias(n) for n in names), "source_file")


def _with_points(rows: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """rows, and of each column whether its numbers are written with a point: where a file has nothing but numbers there, and
    one has a fraction or is missing. If no file has a text there, a point in one is a point in all."""
    cell = lambda n: F.col("cells")[n]
    is_text = lambda n: cell(n).isNotNull() & cell(n)["number"].isNull()
    pointed = lambda n: cell(n).isNull() | (cell(n)["number"] != F.floor(cell(n)["number"]))
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    per = rows.groupBy(F.col("source_file").alias("_file")).agg(
        *(x for i, n in enumerate(names) for x in (any_of(is_text(n)).alias(f"_text{i}"), any_of(pointed(n)).alias(f"_point{i}")))
    )
    per = kept(per, "workbook-kinds")  # a row per file
    every = per.agg(*(any_of(F.col(f"{c}{i}")).alias(f"{c}{i}") for i in range(len(names)) for c in ("_text", "_point"))).first()
    joined = rows.join(per, F.col("source_file") == F.col("_file"))
    return joined, {
        n: (~F.col(f"_text{i}") & F.col(f"_point{i}")) | F.lit(not every[f"_text{i}"] and every[f"_point{i}"]) for i, n in enumerate(names)
    }


def read_table_csv(spark: SparkSession, path: str) -> DataFrame:
    """UTF-8 with or without a BOM; empty fields stay empty strings, one-hot columns become numbers."""
    raw = spark.read.csv(path, header=True, escape='"', multiLine=True, encoding="UTF-8")
    # the reader makes empty fields null; only they become null, so each null was empty
    return raw.select(*((F.expr(f"try_cast(`{c}` AS DOUBLE)") if c in NUMERIC else F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c) for c in raw.columns))


def _is_zip(spark: SparkSession, path: str) -> bool:
    """Whether the first file of a path begins as workbooks do."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f for f in store.globStatus(hadoop) or [] if f.isFile() and f.getLen() >= 4]
    if not found:
        return False
    stream = store.open(found[0].getPath())
    try:
        return stream.readInt() == 0x504B0304
    finally:
        stream.close()


def read_input(spark: SparkSession, path: str) -> DataFrame:
    """By extension; a file of an unknown one is Excel where it begins as a ZIP, and CSV else."""
    lower = path.lower()
    if lower.endswith((".xlsx", ".xls")):
        return read_excel(spark, path)
    if lower.endswith(".csv"):
        return read_table_csv(spark, path)
    return read_excel(spark, path) if _is_zip(spark, path) else read_table_csv(spark, path)


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All workbooks of a folder, with source_file."""
    return read_excel(spark, f"{folder}/*.xlsx")


#: Texts of a field that mean that it is missing.
NA_VALUES = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
#: Texts that are truth values.
TRUE, FALSE = ("True", "TRUE", "true"), ("False", "FALSE", "false")
_WHOLE = r"^\s*[+-]?[0-9]{1,18}\s*$"
_NUMBER = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|(?i:inf(?:inity)?))\s*$"


def _present(name: str, na_values: Sequence[str]) -> Column:
    """A field, null where it is missing. Empty fields are null already."""
    field = F.col(f"`{name}`")
    return F.when(~field.isin(*na_values), field) if na_values else field


def column_counts(raw: DataFrame, na_values: Sequence[str] = NA_VALUES) -> DataFrame:
    """Of each column of texts: name, n, missing, whole, numbers and truths, the numbers of its fields of a kind. One pass; counts
    of parts of a table add up to those of the whole."""

    def counts(name: str) -> Column:
        field = _present(name, na_values)
        kinds = {"missing": field.isNull(), "whole": field.rlike(_WHOLE), "numbers": field.rlike(_NUMBER), "truths": field.isin(*TRUE, *FALSE)}
        return F.struct(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(k) for k, c in kinds.items()))

    found = raw.agg(*(counts(c).alias(f"_{i}") for i, c in enumerate(raw.columns)))
    return found.select(F.inline(F.array(*(F.col(f"_{i}") for i in range(len(raw.columns))))))


def column_kinds(counts: DataFrame) -> dict[str, str]:
    """The type of each column: whole numbers are numbers with a point where any field is missing, and text is text."""

    def kind(r) -> str:
        present = r.n - r.missing
        if present == r.numbers:
            return "long" if present == r.whole and not r.missing and r.n else "double"
        return "boolean" if r.truths == r.n else "string"

    return {r.name: kind(r) for r in counts.collect()}  # a row per column


def typed(raw: DataFrame, kinds: dict[str, str], na_values: Sequence[str] = NA_VALUES) -> DataFrame:
    """A table of texts as values of these types."""

    def value(name: str) -> Column:
        field, kind = _present(name, na_values), kinds[name]
        if kind == "boolean":
            return field.isin(*TRUE)
        if kind == "double":
            field = F.regexp_replace(F.trim(field), r"(?i)^([+-]?)inf$", "$1Infinity")
        return field if kind == "string" else F.trim(field).cast(kind)

    return raw.select(*(value(c).alias(c) for c in raw.columns))


def read_csv(spark: SparkSession, path: str, schema: str | None = None, na_values: Sequence[str] | None = None) -> DataFrame:
    """A table that a stage has written; with an explicit schema where one is known.

    na_values (``NA_VALUES``, say): fields that are such texts are null, and types are those of the fields that are left.
    """
    reader = spark.read.option("escape", '"').option("multiLine", True).option("encoding", "UTF-8")
    if schema:
        return reader.schema(schema).csv(path, header=True)
    if na_values is None:
        return reader.csv(path, header=True, inferSchema=True)
    raw = reader.csv(path, header=True)
    return typed(raw, column_kinds(column_counts(raw, na_values)), na_values)
