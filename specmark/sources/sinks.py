"""Where results go (K1-K7). Tables are written by Spark; only reports of a fixed number of lines are made in the driver."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specmark.functions.numbers import float_text
from specmark.operators.comparison import french_order
from specmark.sources.store import kept, shared_folder

BOM = "\ufeff"


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """One file, in whatever store the path names."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(hadoop, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One UTF-8 file."""
    write_bytes(spark, path, text.encode())


def write_table(df: DataFrame, path: str, *partition_by: str) -> None:
    """K2, the native form of large results."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """K1, for tables of any size: a folder of CSV parts, each with a BOM and a header, in the order of df."""
    named = df.toDF(BOM + df.columns[0], *df.columns[1:])  # the header's first name carries the BOM into each part
    # blanks at the ends of a text are part of it
    named.write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def join_parts(spark: SparkSession, folder: str, path: str, head: bytes = b"", tail: bytes = b"") -> None:
    """The parts of a folder, in order, as one file between head and tail. The store's own streams copy them; the folder is removed."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop, spark.sparkContext._jsc.hadoopConfiguration()
    target = hadoop.fs.Path(path)
    store = hadoop.fs.Path(folder).getFileSystem(conf)
    parts = sorted((f.getPath() for f in store.globStatus(hadoop.fs.Path(f"{folder}/part-*")) or []), key=lambda p: p.getName())
    out = target.getFileSystem(conf).create(target, True)
    try:
        out.write(bytearray(head))
        for part in parts:
            stream = store.open(part)
            try:
                hadoop.io.IOUtils.copyBytes(stream, out, conf, False)
            finally:
                stream.close()
        out.write(bytearray(tail))
    finally:
        out.close()
    store.delete(hadoop.fs.Path(folder), True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"' if any(c in name for c in ',"\r\n') else name


def write_summary(df: DataFrame, path: str) -> None:
    """K1, K3, K5: one CSV file with a BOM, in the order of df, at any size; no row comes to the driver."""
    shown = df.select(*(float_text(F.col(f"`{c}`")).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes))
    folder = shared_folder(df.sparkSession, "csv")
    shown.write.csv(folder, header=False, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    join_parts(df.sparkSession, folder, path, (BOM + ",".join(map(_quoted, df.columns)) + "\n").encode())


_PAGE = """<!DOCTYPE html>
<html lang="fr"><head><meta charset="utf-8"><title>{title}</title>
<style>body{{font-family:sans-serif;margin:2em}}td,th{{padding:.2em .8em;text-align:left}}select{{margin-right:1em}}</style></head>
<body><h1>{title}</h1>
<label>Corpus <select id="corpus"><option value="all">tous</option>{corpora}<option value="both">les deux</option></select></label>
<label>Émotion <select id="emotion"><option value="">toutes</option>{emotions}</select></label> <span id="count"></span>
<table><thead><tr><th>Marqueur</th><th>Corpus</th><th>Émotions</th></tr></thead><tbody id="rows"></tbody></table>
<button id="more" hidden>suite</button>
<script type="application/json" id="data">{data}</script>
<script>
const shards = JSON.parse(document.getElementById("data").textContent);
const corpus = document.getElementById("corpus"), emotion = document.getElementById("emotion"), body = document.getElementById("rows");
const more = document.getElementById("more"), count = document.getElementById("count");
let next = 0, shown = 0, run = 0;
function fits(item) {{
  const c = corpus.value, e = emotion.value;
  if (e && !item.emotions.includes(e)) return false;
  if (c === "all") return true;
  if (c === "both") return item.corpora.length === 2;
  if (c.startsWith("only:")) return item.corpora.length === 1 && item.corpora[0] === c.slice(5);
  return item.corpora.includes(c);
}}
function mayFit(shard) {{
  const c = corpus.value.replace("only:", ""), e = emotion.value;
  return (!e || shard.emotions.includes(e)) && (c === "all" || c === "both" || shard.corpora.includes(c));
}}
async function itemsOf(shard) {{
  if (shard.items) return shard.items;
  const text = await (await fetch("{base}" + encodeURIComponent(shard.file))).text();
  return text.split("\\n").filter(line => line).map(line => JSON.parse(line));
}}
async function show(wanted) {{
  const own = run;
  while (next < shards.length && shown < wanted) {{
    const shard = shards[next++];
    if (!mayFit(shard)) continue;
    const items = (await itemsOf(shard)).filter(fits);
    if (own !== run) return;
    shown += items.length;
    for (const item of items) {{
      const row = body.insertRow();
      for (const value of [item.marker, item.corpora.join(", "), item.emotions.join(", ")]) row.insertCell().textContent = value;
    }}
  }}
  more.hidden = next >= shards.length;
  count.textContent = shown + (more.hidden ? "" : " +");
}}
function start() {{ run++; next = shown = 0; body.replaceChildren(); show(2000); }}
more.onclick = () => show(shown + 2000);
corpus.onchange = emotion.onchange = start;
start();
</script></body></html>
"""


def write_shards(sets: DataFrame, folder: str, per_shard: int = 2000) -> DataFrame:
    """K6: the items as files of JSON lines, ranges of the French order; returns their index: file, first marker, number of items,
    corpora and emotions of each, a row per file."""
    spark = sets.sparkSession
    items = kept(sets.select("marker", "corpora", "emotions"), "dashboard-items")
    ranges = max(1, -(-items.count() // per_shard))
    ranged = items.repartitionByRange(ranges, *french_order()).sortWithinPartitions(*french_order())
    ranged.select(F.to_json(F.struct("marker", "corpora", "emotions")).alias("value")).write.mode("overwrite").text(folder)
    read = spark.read.schema(items.schema).json(folder).select("*", F.col("_metadata.file_name").alias("file"))
    facets = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    first = F.min(F.struct(F.collate("marker", "fr").alias("order"), F.col("marker")))["marker"].alias("first")
    return read.groupBy("file").agg(first, F.count(F.lit(1)).alias("n"), facets("corpora"), facets("emotions"))


def write_dashboard(sets: DataFrame, path: str, title: str = "Marqueurs désignés", per_shard: int = 2000, inline: int = 20_000) -> None:
    """K6, at any size: a page with up to ``inline`` items in itself, and else with the index of their shards, which lie in
    ``<path>.data`` beside it and which the page loads as they are looked at. The index has a line per ``per_shard`` items."""
    folder = f"{path}.data"
    index = kept(write_shards(sets, folder, per_shard), "dashboard-index")
    names = index.agg(*(F.sort_array(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in ("corpora", "emotions")), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    whole = names.n <= inline
    if whole:
        lines = sets.sparkSession.read.text(folder).orderBy(F.col("_metadata.file_name"), F.monotonically_increasing_id())
        data = [{"corpora": names.corpora, "emotions": names.emotions, "items": [json.loads(r.value) for r in lines.collect()]}]
        shards = json.dumps(data, ensure_ascii=False)
    option = lambda value, label: f'<option value="{html.escape(value)}">{html.escape(label)}</option>'
    head, tail = _PAGE.format(
        title=html.escape(title),
        corpora="".join(option(n, f"contient {n}") + option(f"only:{n}", f"seulement {n}") for n in names.corpora),
        emotions="".join(option(e, e) for e in names.emotions),
        base=html.escape(path.rstrip("/").rsplit("/", 1)[-1] + ".data/"),
        data="\0",
    ).split("\0")
    if whole:
        write_text(sets.sparkSession, path, head + shards.replace("<", "\\u003c") + tail)
        return
    # the index goes from Spark's part into the page, without the driver's Python
    entry = F.regexp_replace(F.to_json(F.struct("file", "first", "n", "corpora", "emotions")), "<", "\\\\u003c")
    lines = index.repartition(1).sortWithinPartitions("file").select(F.concat(entry, F.lit(",")).alias("value"))
    parts = shared_folder(sets.sparkSession, "dashboard-page")
    lines.write.text(parts)
    join_parts(sets.sparkSession, parts, path, (head + "[").encode(), ('{"corpora": [], "emotions": [], "items": []}]' + tail).encode())


def show(df: DataFrame, n: int = 20) -> None:
    """K7."""
    df.show(n, truncate=False)
