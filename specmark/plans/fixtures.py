"""Files made from the driver's tables, for the queries that read and write files: annotations beside texts, workbooks.

Texts and units are written by Spark, one file per value of ``file``; the driver only renames the parts, and writes the
few broken files itself. All lies below the folder that executors share.
"""

from __future__ import annotations

import io
import zipfile
from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specmark.sources import sinks
from specmark.sources.store import shared_folder

#: Of each sixteen files, three are malformed, not UTF-8 and without a text.
SET, MALFORMED, NOT_UTF8, ALONE = 16, 13, 14, 15
#: Documents of a file, on average; so the number of files grows with the table, and a file's task does not.
PER_FILE = 1000


def _write_files(lines: DataFrame, folder: str, suffix: str) -> None:
    """lines (file, at, line): a text file for each file, its lines in the order of at."""
    spark = lines.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    lines.repartition("file").sortWithinPartitions("file", "at").select("file", "line").write.partitionBy("file").text(f"{folder}-parts")
    store = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(path(folder))
    for part in store.globStatus(path(f"{folder}-parts/file=*/part-*")):
        name = part.getPath().getParent().getName().removeprefix("file=")
        store.rename(part.getPath(), path(f"{folder}/{name}{suffix}"))
    store.delete(path(f"{folder}-parts"), True)


def _side(name: str, index: Column) -> Column:
    return F.concat(F.lit(f"<{name}><singlePosition"), F.coalesce(F.concat(F.lit(' index="'), index, F.lit('"')), F.lit("")), F.lit(f"/></{name}>"))


def _feature(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'<feature name="{name}">'), value, F.lit("</feature>"))


def write_annotations(documents: DataFrame) -> dict[str, str]:
    """A unit per document over texts of many documents; corpus A has the files of even number, B the others.

    Some units lie in other elements or in other units, some have an empty side, a position without an index or one that is no
    number, or no position at all.
    """
    spark = documents.sparkSession
    base = shared_folder(spark, "annotations")
    doc, blank = F.col("doc_id"), F.lit("")
    files = max(SET, -(-documents.count() // PER_FILE))
    number = doc % files
    docs = documents.select(
        "doc_id", "lang", "source", F.translate(F.coalesce("text", blank), "\r", " ").alias("t"),
        F.when(number % 2 == 0, "A").otherwise("B").alias("corpus"), F.concat(F.lit("f"), number).alias("file"), number.alias("number"),
    )
    before = W.partitionBy("file").orderBy("doc_id").rowsBetween(W.unboundedPreceding, -1)
    placed = docs.withColumn("offset", F.coalesce(F.sum(F.length("t") + 1).over(before), F.lit(0)))
    start = F.when(doc % 11 == 0, F.lit("x")).when(doc % 7 != 0, (F.col("offset") + doc % 5).cast("string"))
    first = F.when(doc % 13 == 0, F.lit("<start/>")).when(doc % 17 == 0, F.lit("")).otherwise(_side("start", start))
    end = (F.col("offset") + F.least(doc % 37, F.length("t"))).cast("string")
    kind = F.when(doc % 5 == 0, "paragraph").when(doc % 5 == 1, "Autre").otherwise(" SitEmo ")
    features = F.concat(
        _feature("Mode", F.lit("first")), _feature("Mode", F.concat(F.lit(" "), F.coalesce("lang", blank), F.lit(" "))),
        _feature("Categorie", F.coalesce("source", blank)), F.lit('<feature name="Categorie2"/>'), _feature("Remarque", F.concat(F.lit("r"), doc)),
    )
    unit = F.concat(
        F.lit('<unit id="u'), doc, F.lit('"><metadata/><characterisation><type>'), kind, F.lit("</type><featureSet>"), features,
        F.lit("</featureSet></characterisation><positioning>"), first, _side("end", end), F.lit("</positioning></unit>"),
    )
    inner = F.when(doc % 3 == 0, F.concat(F.lit("<group><part>"), unit, F.lit("</part></group>"))).when(doc % 4 == 0, F.concat(F.lit("<unit>"), unit, F.lit("</unit>"))).otherwise(unit)
    heads = placed.groupBy("corpus", "file", "number").agg(F.max("doc_id").alias("last"))
    ends = heads.select("corpus", "file", F.inline(F.array(
        F.struct(F.lit(-1).cast("long").alias("at"), F.lit("<annotations>").alias("line")),
        F.struct((F.col("last") + 1).alias("at"), F.when(F.col("number") % SET == MALFORMED, "<open>").otherwise("</annotations>").alias("line")),
    )))
    units = placed.select("corpus", "file", doc.alias("at"), inner.alias("line")).unionByName(ends)
    texts = placed.filter(~(F.col("number") % SET).isin(NOT_UTF8, ALONE)).select("corpus", "file", doc.alias("at"), F.col("t").alias("line"))
    for corpus in "AB":
        own = F.col("corpus") == corpus
        _write_files(units.filter(own).drop("corpus"), f"{base}/{corpus}/aa", ".aa")
        _write_files(texts.filter(own).drop("corpus"), f"{base}/{corpus}/ac", ".ac")
    for k in range(NOT_UTF8, files, SET):
        sinks.write_bytes(spark, f"{base}/{'AB'[k % 2]}/ac/f{k}.ac", "été".encode("latin-1"))
    return {"A": f"{base}/A", "B": f"{base}/B", "missing": f"{base}/none"}


def workbook(rows: list[list]) -> bytes:
    """A workbook of one sheet; texts are shared strings, numbers are numbers, None leaves a cell out."""
    namespace = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    texts = sorted({v for row in rows for v in row if isinstance(v, str)})
    place = {t: i for i, t in enumerate(texts)}
    cell = lambda v, at: "" if v is None else f'<c r="{at}" t="s"><v>{place[v]}</v></c>' if isinstance(v, str) else f'<c r="{at}"><v>{v}</v></c>'
    lines = "".join(f'<row r="{i}">{"".join(cell(v, f"{chr(65 + j)}{i}") for j, v in enumerate(row))}</row>' for i, row in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {namespace}><sheetData>{lines}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {namespace}>{''.join(f'<si><t>{escape(t)}</t></si>' for t in texts)}</sst>")
    return out.getvalue()


def write_workbooks(nation: DataFrame) -> str:
    """A workbook per parity of the region of a table of fixed size, with unlike columns; the folder."""
    folder = shared_folder(nation.sparkSession, "workbooks")
    rows = nation.select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()  # 25 rows at any size
    for side, columns in enumerate((("Joie", "Désignée"), ("Peur", "Montrée"))):
        body = [[r.n_nationkey, f"i{r.n_nationkey}", r.n_name, f"{r.n_name} & Co", 1 if r.n_nationkey % 3 else None, "1" if r.n_nationkey % 2 else 1] for r in rows if r.n_regionkey % 2 == side]
        sinks.write_bytes(nation.sparkSession, f"{folder}/w{side}.xlsx", workbook([["idx", "ID", "NAME", "TEXT", *columns], *body]))
    return folder
