"""Queries over the driver's tables, one or more for each operator, and DuckDB SQL for those that SQL can express.

The tables stand in for annotated corpora: a document is an annotated span, its language the mode and its source the
category, of which src0 to src10 are valid. All queries read whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specmark.functions.domains import STOPWORDS
from specmark.functions.lemma import lemmas
from specmark.functions.text import is_blank, punctuation, trim_all, words
from specmark.operators import comparison as C
from specmark.operators import entropy as E
from specmark.operators import markers as M
from specmark.operators import ranking as R
from specmark.operators import stats as S
from specmark.plans import analysis, fixtures
from specmark.plans.report import hypothesis_report
from specmark.sources import glozz, sinks, store, tabular

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CLASSES = tuple(f"src{i}" for i in range(11))
LANGS = ("de", "en", "es", "fr")
HIGH, LOW = ("es", "fr"), ("de", "en")


def _query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- inputs ---
def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; where its files have fewer parts than there are cores (one small file, say), dealt out over all."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return table.repartition(cores) if name in _TEXTS and 4 * table.rdd.getNumPartitions() <= cores else table


_TEXTS = ("documents", "conversations")


def _annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as annotations: only the columns that markers need."""
    return _table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("corpus"), F.col("doc_id").cast("string").alias("file_id"), F.lit("").alias("unit_id"),
        F.lit("SitEmo").alias("type"), F.col("text").alias("text_span"), F.col("lang").alias("mode"), F.col("source").alias("categorie1"),
    )


def _markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.markers_of_annotations(_annotations(spark, sf_dir), narrow=True, use_lemma=False)


def _entropy(spark: SparkSession, sf_dir: str, condition: str = "categorie1", valid=CLASSES) -> DataFrame:
    return E.conditional_entropy(_markers(spark, sf_dir), condition, valid)


def _of_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.entropy_of_modes(_markers(spark, sf_dir), "categorie1", CLASSES, modes=LANGS)


def _rounded(df: DataFrame, *columns: str, to: int = 6) -> DataFrame:
    return df.select(*(F.round(F.col(f"`{c}`"), to).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns))


def _onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A one-hot table: two labels as emotions, three languages as modes; text and filter column as the scheme names them."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    flag = lambda c: c.cast("double")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("idx"), F.col("doc_id").alias("ID"), F.col("source").alias("NAME"), F.col("text").alias("TEXT"),
        flag(F.col("quality")).alias("Joie"), flag(F.col("toxic")).alias("Colère"),
        flag(F.col("lang") == "de").alias("Désignée"), flag(F.col("lang").isin("de", "en")).alias("Montrée"), flag(F.col("lang") == "fr").alias("Suggérée"),
    )


def _different_words():
    """Where only sets are asked for: a word once for each text that has it."""
    return F.array_distinct(words(F.col("text")))


def _marker_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    side = lambda name: C.marker_set(_table(spark, sf_dir, name).select(F.explode(_different_words()).alias("marker_value")))
    return side("documents"), side("conversations")


# --- SQL ---
_L = "a-zA-ZÀ-ÖØ-öø-ÿœŒæÆ"
_SIGNS = "[!?.,;:…\\-—–\"''«»()\\[\\]]"


def _words_sql(text: str = "coalesce(text, '')") -> str:
    # a run that touches a digit or an underscore is no word
    return f"list_transform(regexp_extract_all(regexp_replace({text}, '[{_L}0-9_]*[0-9_][{_L}0-9_]*', ' ', 'g'), '[{_L}]+(?:[''-][{_L}]+)*'), lambda w: lower(w))"


_MARKERS_SQL = f"""
m AS (
  SELECT doc_id, lang, source, 'word' AS marker_type, unnest({_words_sql()}) AS marker_value FROM documents WHERE lang IS NOT NULL
  UNION ALL
  SELECT doc_id, lang, source, 'punctuation', unnest(regexp_extract_all(coalesce(text, ''), '{_SIGNS}')) FROM documents WHERE lang IS NOT NULL)"""


def _counts_sql(column: str, valid: tuple[str, ...], least: int = 3) -> str:
    per = ", ".join(f"count(*) FILTER (WHERE {column} = '{c}') AS \"{c}\"" for c in valid)
    listed = ", ".join(f"'{c}'" for c in valid)
    return f"""
n AS (SELECT marker_value, marker_type, {per}, count(*) AS total_count FROM m WHERE {column} IN ({listed}) GROUP BY ALL HAVING count(*) >= {least})"""


def _entropy_sql(column: str, valid: tuple[str, ...]) -> str:
    terms = " + ".join(f'CASE WHEN "{c}" > 0 THEN ("{c}" / total_count) * log2("{c}" / total_count) ELSE 0 END' for c in valid)
    return f"{_counts_sql(column, valid)},\ne AS (SELECT *, 0.0 - ({terms}) AS entropy FROM n)"


def _p_sql(valid: tuple[str, ...]) -> str:
    return ", ".join(f'round("{c}" / total_count, 6) AS "P({c})"' for c in valid)


_OF_MODES_SQL = f"""{_MARKERS_SQL},{_entropy_sql("source", CLASSES)},
o AS (SELECT d.lang AS mode, round(e.entropy, 9) AS entropy FROM (SELECT DISTINCT lang, marker_value, marker_type FROM m) d JOIN e USING (marker_value, marker_type) WHERE d.lang IN ('de', 'en', 'es', 'fr'))"""


# --- tokens (T1, T2, T3, F6, F11) ---
@_query(f"SELECT w AS marker, count(*) AS n FROM (SELECT unnest({_words_sql()}) AS w FROM documents) GROUP BY w")
def words_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _table(spark, sf_dir, "documents").select(F.explode(words(F.col("text"))).alias("marker"))
    return tokens.groupBy("marker").agg(F.count(F.lit(1)).alias("n"))


@_query(f"SELECT p AS marker, count(*) AS n FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), '{_SIGNS}')) AS p FROM documents) GROUP BY p")
def punct_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _table(spark, sf_dir, "documents").select(F.explode(punctuation(F.col("text"))).alias("marker"))
    return tokens.groupBy("marker").agg(F.count(F.lit(1)).alias("n"))


_DOTTED_SQL = "replace(replace(replace(coalesce(text, ''), ', ', '…., '), '. ', '..... '), ' a', ' (....…)! a')"


@_query(
    f"""WITH r AS (SELECT unnest(regexp_extract_all({_DOTTED_SQL}, '{_SIGNS}+')) AS run FROM documents),
d AS (SELECT run, replace(run, '…', '') AS dots, regexp_replace(replace(run, '…', ''), '\\.{{3}}', '', 'g') AS rest FROM r),
s AS (SELECT unnest(string_split(repeat('…', CAST(contains(run, '…') AS INT) + (length(dots) - length(rest)) // 3) || rest, '')) AS marker FROM d)
SELECT marker, count(*) AS n FROM s WHERE marker <> '' GROUP BY marker"""
)
def punct_ellipsis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with runs of dots and ellipses put in."""
    dotted = F.expr(_DOTTED_SQL)
    found = _table(spark, sf_dir, "documents").select(F.explode(punctuation(dotted)).alias("marker"))
    return found.groupBy("marker").agg(F.count(F.lit(1)).alias("n"))


@_query(
    f"SELECT w AS marker, count(*) AS n FROM (SELECT unnest({_words_sql()}) AS w FROM documents) WHERE w NOT IN ("
    + ", ".join(f"'{w}'" for w in STOPWORDS)
    + ") GROUP BY w"
)
def stopword_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = M.explode_markers(_table(spark, sf_dir, "documents").select("text"), "text", use_lemma=False, remove_stopwords=True)
    return marked.filter("marker_type = 'word'").groupBy(F.col("marker_value").alias("marker")).agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT w AS marker, count(*) AS n FROM (SELECT unnest(list_transform(regexp_extract_all(coalesce(text, ''), '\\p{L}+'), lambda w: lower(w))) AS w FROM documents) GROUP BY w")
def lemma_identity_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The UDF path with the stand-in backend; no lemmatisation model is needed."""
    found = _table(spark, sf_dir, "documents").select(F.explode(lemmas(F.col("text"), "identity")).alias("marker"))
    return found.groupBy("marker").agg(F.count(F.lit(1)).alias("n"))


#: What is put around texts, by doc_id.
_AROUND = ("", " \t", "\u00a0\u2003\n", "\x1c\x0b", "\u3000\u0085", "\ufeff")
_AROUND_SQL = "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_AROUND)) + " END"
_BLANK_SQL = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@_query(
    f"""WITH x AS (SELECT doc_id, {_AROUND_SQL} || CASE WHEN doc_id % 5 = 0 THEN '' ELSE coalesce(text, '') END || {_AROUND_SQL} AS x FROM documents)
SELECT doc_id, md5(regexp_replace(x, '^{_BLANK_SQL}|{_BLANK_SQL}$', '', 'g')) AS trimmed, regexp_replace(x, '{_BLANK_SQL}', '', 'g') = '' AS blank FROM x"""
)
def trim_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whole texts, and none for each fifth, with white space of several kinds put around them."""
    doc = F.col("doc_id")
    around = F.get(F.array(*(F.lit(x) for x in _AROUND)), (doc % 6).cast("int"))
    x = F.concat(around, F.when(doc % 5 == 0, "").otherwise(F.coalesce("text", F.lit(""))), around)
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(trim_all(x)).alias("trimmed"), is_blank(x).alias("blank"))


@_query(
    "SELECT doc_id, CASE WHEN s <= e AND e <= length(t) THEN replace(replace(substring(t, s + 1, e - s), chr(10), ' '), chr(13), ' ') ELSE '' END AS text_span"
    " FROM (SELECT doc_id, coalesce(text, '') AS t, CAST(doc_id % 40 AS INT) AS s, CAST(doc_id % 97 AS INT) AS e FROM documents)"
)
def annotation_span_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a span by code-point offsets, empty where they do not fit."""
    rows = _table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("t"), (F.col("doc_id") % 40).cast("int").alias("s"), (F.col("doc_id") % 97).cast("int").alias("e")
    )
    return rows.select("doc_id", glozz.span_of(F.col("t"), F.col("s"), F.col("e")).alias("text_span"))


# --- entropy (F12-F14, A1-A12, J1, O1, O2) ---
@_query(f"WITH {_MARKERS_SQL},{_counts_sql('source', CLASSES, 1)} SELECT * FROM n")
def marker_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.class_counts(_markers(spark, sf_dir), "categorie1", CLASSES)


def _conditional_sql(column: str, valid: tuple[str, ...]) -> str:
    return f"""WITH {_MARKERS_SQL},{_entropy_sql(column, valid)}
SELECT * EXCLUDE (entropy), {_p_sql(valid)}, round(entropy, 6) AS entropy, round(entropy / log2({len(valid)}), 6) AS normalized_entropy FROM e"""


def _rounded_entropy(df: DataFrame, valid: tuple[str, ...]) -> DataFrame:
    return _rounded(df, *(f"P({c})" for c in valid), "entropy", "normalized_entropy")


@_query(_conditional_sql("source", CLASSES))
def cond_entropy_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_entropy(_entropy(spark, sf_dir), CLASSES)


@_query(_conditional_sql("lang", LANGS))
def cond_entropy_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_entropy(_entropy(spark, sf_dir, "mode", LANGS), LANGS)


@_query(
    f"WITH {_MARKERS_SQL.replace('m AS', 'a AS', 1)}, m AS (SELECT * FROM a WHERE marker_type = 'word'),{_entropy_sql('source', CLASSES)}"
    " SELECT count(*) AS n_markers, round(avg(entropy), 6) AS mean_entropy FROM e"
)
def mean_entropy_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One marker type alone."""
    marked = _markers(spark, sf_dir).filter("marker_type = 'word'")
    return _rounded(E.mean_entropy(E.conditional_entropy(marked, "categorie1", CLASSES)), "mean_entropy")


def _summary_sql(spread: str) -> str:
    return f"""WITH {_OF_MODES_SQL}
SELECT l.mode, count(o.mode) AS n_markers, round(avg(entropy), 6) AS mean_entropy, round(median(entropy), 6) AS median_entropy, round({spread}(entropy), 6) AS std_entropy
FROM (VALUES ('de'), ('en'), ('es'), ('fr')) l(mode) LEFT JOIN o ON l.mode = o.mode GROUP BY l.mode"""


@_query(_summary_sql("stddev_samp"))
def entropy_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(E.summarise_modes(_of_modes(spark, sf_dir), LANGS), "mean_entropy", "median_entropy", "std_entropy")


@_query(_summary_sql("stddev_pop"))
def entropy_report_pop_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(E.summarise_modes(_of_modes(spark, sf_dir), LANGS, population=True), "mean_entropy", "median_entropy", "std_entropy")


def _extreme_sql(order: str) -> str:
    return f"""WITH {_MARKERS_SQL},{_entropy_sql("source", CLASSES)}
SELECT marker_value, marker_type, total_count, round(entropy, 6) AS entropy FROM e ORDER BY round(e.entropy, 6) {order}, marker_value, marker_type LIMIT 10"""


def _extreme(spark: SparkSession, sf_dir: str, highest: bool) -> DataFrame:
    rows = _rounded(_entropy(spark, sf_dir), "entropy").select("marker_value", "marker_type", "total_count", "entropy")
    return E.extreme(rows, 10, highest)


@_query(_extreme_sql("ASC"))
def bottom10_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extreme(spark, sf_dir, False)


@_query(_extreme_sql("DESC"))
def top10_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extreme(spark, sf_dir, True)


@_query("SELECT lang, count(*) AS count FROM documents GROUP BY lang")
def value_counts_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.value_counts(_table(spark, sf_dir, "documents"), "lang")


# --- ranking (O3, F15, F18) ---
_LONG_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"Classe\", marker_value, marker_type, round(\"{c}\" / total_count, 6) AS p, total_count, round(entropy, 6) AS entropy FROM e WHERE \"{c}\" > 0" for c in CLASSES
)


@_query(
    f"""WITH {_MARKERS_SQL},{_entropy_sql("source", CLASSES)}, l AS ({_LONG_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY "Classe" ORDER BY p DESC, total_count DESC, entropy, marker_value, marker_type) AS k FROM l)
SELECT "Classe", marker_value AS "Marqueur", marker_type AS "Type", p AS "P(Classe)", total_count AS "Freq_Globale", entropy AS "Entropie" FROM r WHERE k <= 20"""
)
def top_markers_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_markers(_rounded_entropy(_entropy(spark, sf_dir), CLASSES), 20)


# --- sets (U1-U4, F17, A15, O4, A13, F19) ---
_SETS_SQL = ", ".join(
    f"{side} AS (SELECT DISTINCT w AS marker FROM (SELECT unnest({_words_sql()}) AS w FROM {name}) WHERE length(w) > 2)"
    for side, name in (("a", "documents"), ("b", "conversations"))
)


@_query(f"WITH {_SETS_SQL} SELECT marker FROM a INTERSECT SELECT marker FROM b")
def marker_sets_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.compare(*_marker_sets(spark, sf_dir))["intersect"]


@_query(f"WITH {_SETS_SQL} SELECT marker FROM a EXCEPT SELECT marker FROM b")
def marker_sets_except_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.compare(*_marker_sets(spark, sf_dir))["except_left"]


@_query(f"WITH {_SETS_SQL} SELECT marker FROM b EXCEPT SELECT marker FROM a")
def marker_sets_except_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.compare(*_marker_sets(spark, sf_dir))["except_right"]


@_query(f"WITH {_SETS_SQL} SELECT marker FROM a UNION SELECT marker FROM b")
def marker_sets_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.compare(*_marker_sets(spark, sf_dir))["union"]


@_query(
    f"""WITH {_SETS_SQL}, i AS (SELECT marker FROM a INTERSECT SELECT marker FROM b)
SELECT (SELECT count(*) FROM a) AS n_left, (SELECT count(*) FROM b) AS n_right, (SELECT count(*) FROM i) AS n_both,
  (SELECT count(*) FROM a) - (SELECT count(*) FROM i) AS n_left_only, (SELECT count(*) FROM b) - (SELECT count(*) FROM i) AS n_right_only,
  (SELECT count(*) FROM a) + (SELECT count(*) FROM b) - (SELECT count(*) FROM i) AS n_all"""
)
def marker_set_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.set_sizes(*_marker_sets(spark, sf_dir))


@_query(f"WITH {_SETS_SQL} SELECT marker FROM (SELECT marker FROM a INTERSECT SELECT marker FROM b) ORDER BY marker LIMIT 30")
def marker_sets_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sample_markers(C.compare(*_marker_sets(spark, sf_dir))["intersect"])


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dashboard items of both corpora: documents by language as what an annotator wrote, conversations by role."""
    docs = _table(spark, sf_dir, "documents").select(
        F.lit(" Designee ").alias("mode"), F.col("lang").alias("categorie1"), F.when(F.col("lang") == "de", "joie").alias("categorie2"), F.explode(_different_words()).alias("marker_value")
    )
    talk = _table(spark, sf_dir, "conversations").select(
        F.lit(1.0).alias("Désignée"), (F.col("role") == "user").cast("double").alias("Peur"), (F.col("role") != "assistant").cast("double").alias("Joie"), F.explode(_different_words()).alias("marker_value")
    )
    return C.dashboard_sets(C.items_of_annotations(docs), C.items_of_table(talk))


_ITEMS_SQL = f"""
i AS (
  SELECT w AS marker, 'Glozz' AS corpus, unnest(CASE WHEN lang = 'de' THEN ['Autre', 'Joie'] ELSE ['Autre'] END) AS emotion FROM (SELECT lang, unnest({_words_sql()}) AS w FROM documents)
  UNION SELECT w, 'XLSX', unnest(CASE role WHEN 'user' THEN ['Peur', 'Joie'] WHEN 'assistant' THEN ['Autre'] ELSE ['Joie'] END) FROM (SELECT role, unnest({_words_sql()}) AS w FROM conversations)),
s AS (SELECT marker, array_to_string(list_sort(list_distinct(list(corpus))), '|') AS corpora, array_to_string(list_sort(list_distinct(list(emotion))), '|') AS emotions
  FROM i WHERE length(marker) > 2 AND marker <> 'nan' GROUP BY marker)"""


def _joined_sets(df: DataFrame) -> DataFrame:
    return df.select("marker", F.array_join("corpora", "|").alias("corpora"), F.array_join("emotions", "|").alias("emotions"))


@_query(f"WITH {_ITEMS_SQL} SELECT * FROM s")
def dashboard_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined_sets(_items(spark, sf_dir))


@_query(f"WITH {_ITEMS_SQL} SELECT * FROM s WHERE corpora = 'Glozz|XLSX' AND emotions LIKE '%Peur%'")
def dashboard_filter_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined_sets(C.dashboard_filter(_items(spark, sf_dir), "both", "Peur"))


@_query(f"WITH {_ITEMS_SQL} SELECT * FROM s WHERE corpora = 'XLSX'")
def dashboard_filter_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined_sets(C.dashboard_filter(_items(spark, sf_dir), "only:XLSX"))


_WRITTEN_SQL = "CASE doc_id % 7 WHEN 0 THEN 'Colere' WHEN 1 THEN ' dégoût' WHEN 2 THEN 'AUCUN ' WHEN 3 THEN '' WHEN 4 THEN source WHEN 5 THEN 'FIERTÉ' ELSE lang END"


@_query(
    f"""WITH w AS (SELECT {_WRITTEN_SQL} AS written FROM documents)
SELECT written, CASE written WHEN 'Colere' THEN 'Colère' WHEN ' dégoût' THEN 'Dégoût' WHEN 'FIERTÉ' THEN 'Fierté' WHEN 'AUCUN ' THEN NULL WHEN '' THEN NULL
  ELSE upper(written[1]) || lower(written[2:]) END AS label, count(*) AS n FROM w GROUP BY ALL"""
)
def dashboard_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What annotators may have written, from the columns of documents."""
    written = _table(spark, sf_dir, "documents").select(F.expr(_WRITTEN_SQL).alias("written"))
    return written.groupBy("written", C.dashboard_label(F.col("written")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


_CHOICES = ("all", "Glozz", "XLSX", "both", "only:Glozz", "only:XLSX")


@_query(
    f"""WITH {_ITEMS_SQL}, c AS (SELECT unnest([{", ".join(f"'{c}'" for c in _CHOICES)}]) AS choice), e AS (SELECT unnest(['', 'Autre', 'Joie', 'Peur']) AS emotion)
SELECT choice, emotion, count(*) AS n FROM c, e, s WHERE (emotion = '' OR contains(emotions, emotion)) AND CASE choice WHEN 'all' THEN true WHEN 'both' THEN corpora = 'Glozz|XLSX'
  WHEN 'only:Glozz' THEN corpora = 'Glozz' WHEN 'only:XLSX' THEN corpora = 'XLSX' ELSE contains(corpora, choice) END GROUP BY ALL"""
)
def dashboard_filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the number of items that each choice of corpora and emotion leaves."""
    items = store.kept(_items(spark, sf_dir), "items")
    pairs = [(c, e) for c in _CHOICES for e in ("", "Autre", "Joie", "Peur")]
    counts = [C.dashboard_filter(items, c, e or None).select(F.lit(c).alias("choice"), F.lit(e).alias("emotion")) for c, e in pairs]
    return reduce(lambda a, b: a.unionByName(b), counts).groupBy("choice", "emotion").agg(F.count(F.lit(1)).alias("n"))


@_query(f"WITH {_ITEMS_SQL} SELECT * FROM s")
def dashboard_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: all items, read back from the shards of the page."""
    path = f"{store.shared_folder(spark, 'dashboard')}.html"
    sinks.write_dashboard(_items(spark, sf_dir), path, inline=0)
    return _joined_sets(spark.read.schema("marker string, corpora array<string>, emotions array<string>").json(f"{path}.data"))


@_query(f"WITH {_SETS_SQL} SELECT marker, row_number() OVER (ORDER BY marker COLLATE fr, marker) AS place FROM a")
def markers_french_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each marker of the documents in a French dictionary."""
    return R.places(_marker_sets(spark, sf_dir)[0].orderBy(*C.french_order()))


# --- one-hot tables (R1-R4, F7) ---
_ONEHOT_SQL = """
h AS (SELECT d.doc_id, coalesce(quality = 1, false) AS joie, coalesce(toxic = 1, false) AS colere, lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
c AS (SELECT doc_id, lang, unnest(CASE WHEN colere AND joie THEN ['Colere', 'Joie'] WHEN colere THEN ['Colere'] WHEN joie THEN ['Joie'] ELSE ['Autre'] END) AS categorie1 FROM h),
x AS (SELECT doc_id, categorie1, unnest(CASE lang WHEN 'de' THEN ['Designee', 'Montree'] WHEN 'en' THEN ['Montree'] WHEN 'fr' THEN ['Suggeree'] ELSE [NULL] END) AS mode FROM c)"""


@_query(f"WITH {_ONEHOT_SQL} SELECT categorie1, mode, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM x GROUP BY categorie1, mode")
def onehot_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.onehot_to_classes(_onehot(spark, sf_dir).drop("TEXT"))
    return rows.groupBy("categorie1", "mode").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("idx").alias("n_docs"))


@_query(
    f"""WITH h AS (SELECT d.doc_id, text, quality, toxic, lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE coalesce(quality, 0) + coalesce(toxic, 0) > 0)
SELECT w AS marker, count(*) AS n FROM (SELECT unnest({_words_sql()}) AS w FROM h) GROUP BY w"""
)
def onehot_active_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the filter column, rows with any one-hot are active."""
    marked = M.markers_of_table(_onehot(spark, sf_dir), use_lemma=False)
    return marked.filter("marker_type = 'word'").groupBy(F.col("marker_value").alias("marker")).agg(F.count(F.lit(1)).alias("n"))


# --- files (S1-S14, K1, K2, F1, F2, F4, J3, U1) ---
_UNITS_SQL = f"""
q AS (SELECT greatest({fixtures.SET}, CAST(ceil(count(*) / {fixtures.PER_FILE}.0) AS BIGINT)) AS files FROM documents),
d AS (SELECT doc_id, lang, source, replace(coalesce(text, ''), chr(13), ' ') AS t, doc_id % files AS b FROM documents, q),
o AS (SELECT *, coalesce(sum(length(t) + 1) OVER (PARTITION BY b ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM d),
u AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN -1 ELSE off + doc_id % 5 END AS s, off + least(doc_id % 37, length(t)) AS e, doc_id % 5 <> 1 AS situation
  FROM o WHERE b % {fixtures.SET} < {fixtures.MALFORMED} AND doc_id % 5 <> 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0 AND doc_id % 17 <> 0)"""


@_query(
    f"""WITH {_UNITS_SQL}
SELECT CASE WHEN b % 2 = 0 THEN 'A' ELSE 'B' END AS corpus, 'f' || b AS file_id, 'u' || doc_id AS unit_id, CASE WHEN situation THEN 'SitEmo' ELSE 'Autre' END AS type,
  CAST(s AS INT) AS start_idx, CAST(e AS INT) AS end_idx, CASE WHEN s >= 0 AND s <= e THEN replace(substring(t, CAST(s - off + 1 AS BIGINT), CAST(e - s AS BIGINT)), chr(10), ' ') ELSE '' END AS text_span,
  CASE WHEN situation THEN lang END AS mode, CASE WHEN situation THEN source END AS categorie1, CAST(NULL AS VARCHAR) AS categorie2, CASE WHEN NOT situation THEN 'r' || doc_id END AS remarque FROM u"""
)
def annotation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as texts with units beside them, among broken and unpaired files, and read back."""
    return glozz.read_corpora(spark, fixtures.write_annotations(_table(spark, sf_dir, "documents")), ordered=False)


@_query(
    f"""WITH {_UNITS_SQL}
SELECT 'u' || doc_id AS unit_id, row_number() OVER (ORDER BY 'f' || b, doc_id) AS place FROM u WHERE b % 2 = 0"""
)
def annotation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each unit of one corpus, by file and unit."""
    rows = glozz.read_corpora(spark, fixtures.write_annotations(_table(spark, sf_dir, "documents")), only="A")
    return R.places(rows.select("unit_id"))


@_query(
    f"""WITH {_UNITS_SQL}, f AS (SELECT DISTINCT b % {fixtures.SET} AS kind, b FROM d),
n AS (SELECT count(*) FILTER (WHERE situation) AS situations, count(*) FILTER (WHERE NOT situation) AS others,
  count(*) FILTER (WHERE situation AND lang IS NULL) AS none, count(*) FILTER (WHERE situation AND lang IS NOT NULL) AS other FROM u)
SELECT unnest(['type SitEmo', 'type Autre', 'mode Comportementale', 'mode Designee', 'mode Montree', 'mode Suggeree', 'mode none', 'mode other', 'skipped no_text', 'skipped not_utf8', 'skipped malformed']) AS name,
  unnest([situations, others, 0, 0, 0, 0, none, other, (SELECT count(*) FROM f WHERE kind = {fixtures.ALONE}), (SELECT count(*) FROM f WHERE kind = {fixtures.NOT_UTF8}), (SELECT count(*) FROM f WHERE kind = {fixtures.MALFORMED})]) AS n FROM n"""
)
def annotation_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is counted while annotations are written."""
    folders = fixtures.write_annotations(_table(spark, sf_dir, "documents"))
    figures = analysis.write_annotations(spark, folders, store.shared_folder(spark, "annotations"))
    return spark.createDataFrame(sorted(figures.items()), "name string, n long")


@_query(f"WITH {_UNITS_SQL} SELECT 'B' AS corpus, 'f' || b AS file_id, 'u' || doc_id AS unit_id FROM u WHERE b % 2 = 1")
def annotation_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations laid out by corpus; the folder of one is read."""
    path = store.shared_folder(spark, "annotations")
    analysis.write_annotations(spark, fixtures.write_annotations(_table(spark, sf_dir, "documents")), path)
    return analysis.read_stage(spark, path, "B").select("corpus", "file_id", "unit_id")


@_query(f"WITH {_UNITS_SQL} SELECT DISTINCT CASE WHEN b % 2 = 0 THEN 'A' ELSE 'B' END AS corpus, 'f' || b AS file_id FROM d WHERE b % {fixtures.SET} >= {fixtures.NOT_UTF8}")
def annotation_unpaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose text is missing or not UTF-8."""
    folders = fixtures.write_annotations(_table(spark, sf_dir, "documents"))
    found = [glozz.unpaired(spark, folders[c]).select(F.lit(c).alias("corpus"), "file_id") for c in "AB"]
    return reduce(lambda a, b: a.unionByName(b), found)


@_query("SELECT CAST(doc_id AS VARCHAR) AS \"ID\", coalesce(source, '') AS \"NAME\", coalesce(text, '') AS \"TEXT\", CAST(CASE lang WHEN 'fr' THEN 1 END AS DOUBLE) AS \"Joie\" FROM documents")
def csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts through CSV parts with a BOM, with quotes, line ends and blanks as they were."""
    path = f"{store.shared_folder(spark, 'table')}.csv"
    docs = _table(spark, sf_dir, "documents")
    sinks.write_csv(docs.select(F.col("doc_id").cast("string").alias("ID"), F.col("source").alias("NAME"), F.col("text").alias("TEXT"), F.when(F.col("lang") == "fr", 1).alias("Joie")), path)
    return tabular.read_input(spark, path)


@_query(f"WITH {_MARKERS_SQL},{_counts_sql('source', CLASSES)} SELECT marker_value, marker_type, total_count, src0 FROM n")
def marker_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers through Parquet by type, their counts through CSV parts."""
    folder = store.shared_folder(spark, "markers")
    sinks.write_table(_markers(spark, sf_dir).select("marker_value", "marker_type", "categorie1"), f"{folder}/markers", "marker_type")
    counts = E.class_counts(analysis.read_markers(spark, f"{folder}/markers"), "categorie1", CLASSES).filter("total_count >= 3")
    sinks.write_csv(counts.select("marker_value", "marker_type", "total_count", "src0"), f"{folder}/counts.csv")
    return tabular.read_csv(spark, f"{folder}/counts.csv", "marker_value string, marker_type string, total_count long, src0 long")


@_query(
    """SELECT CAST(n_nationkey AS VARCHAR) AS idx, 'i' || n_nationkey AS "ID", n_name AS "NAME", n_name || ' & Co' AS "TEXT", 'w' || (n_regionkey % 2) || '.xlsx' AS source_file,
  CAST(CASE WHEN n_regionkey % 2 = 0 AND n_nationkey % 3 > 0 THEN 1 END AS DOUBLE) AS "Joie", CAST(CASE WHEN n_regionkey % 2 = 0 AND n_nationkey % 2 = 0 THEN 1 END AS DOUBLE) AS "Désignée",
  CAST(CASE WHEN n_regionkey % 2 = 1 AND n_nationkey % 3 > 0 THEN 1 END AS DOUBLE) AS "Peur", CAST(CASE WHEN n_regionkey % 2 = 1 AND n_nationkey % 2 = 0 THEN 1 END AS DOUBLE) AS "Montrée" FROM nation"""
)
def workbook_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbooks of unlike columns, read as one table."""
    return tabular.read_folder(spark, fixtures.write_workbooks(_table(spark, sf_dir, "nation")))


@_query(
    """SELECT doc_id, CASE WHEN doc_id % 7 > 0 THEN n_chars / 4 END AS size, CASE WHEN doc_id % 3 > 0 THEN lang END AS lang, doc_id % 2 = 0 AS even,
  CASE WHEN doc_id % 7 > 0 THEN 'x' || (n_chars // 4) END AS code FROM documents"""
)
def csv_missing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of columns found from their fields, with texts that mean a missing one."""
    doc, path = F.col("doc_id"), f"{store.shared_folder(spark, 'typed')}.csv"
    missing = F.get(F.array(*(F.lit(x) for x in ("NA", "null", "nan", "None", "n/a"))), (doc % 5).cast("int"))
    rows = _table(spark, sf_dir, "documents").select(
        "doc_id", F.when(doc % 7 > 0, (F.col("n_chars") / 4).cast("string")).otherwise(missing).alias("size"), F.when(doc % 3 > 0, F.col("lang")).otherwise(missing).alias("lang"),
        F.when(doc % 2 == 0, "True").otherwise("False").alias("even"), F.when(doc % 7 > 0, F.concat(F.lit("x"), F.floor(F.col("n_chars") / 4))).otherwise(missing).alias("code"),
    )
    sinks.write_csv(rows, path)
    return tabular.read_csv(spark, path, na_values=tabular.NA_VALUES)


# --- results read back (K1, K3, K4, K5, H7, O1) ---
@_query(_summary_sql("stddev_samp"))
def summary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: the summary as one CSV file."""
    path = f"{store.shared_folder(spark, 'summary')}.csv"
    sinks.write_summary(E.summarise_modes(_of_modes(spark, sf_dir), LANGS), path)
    read = tabular.read_csv(spark, path, "mode string, n_markers long, mean_entropy double, median_entropy double, std_entropy double")
    return _rounded(read, "mean_entropy", "median_entropy", "std_entropy")


@_query(
    f"""WITH {_MARKERS_SQL},{_entropy_sql("source", CLASSES)}
SELECT marker_value, marker_type, round(entropy, 6) AS entropy, row_number() OVER (ORDER BY round(e.entropy, 6) DESC, marker_value, marker_type) AS place FROM e"""
)
def entropy_file_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, O1: one file of all markers by falling entropy; the place of a marker is its line."""
    path = f"{store.shared_folder(spark, 'entropy')}.csv"
    sinks.write_summary(E.by_entropy(_rounded(_entropy(spark, sf_dir), "entropy")).select("marker_value", "marker_type", "entropy"), path)
    lines = R.places(spark.read.text(path).orderBy(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    fields = F.from_csv(F.col("value"), F.lit("marker_value string, marker_type string, entropy double"), {"escape": '"'})
    return lines.filter("place > 1").select(fields.alias("_f"), (F.col("place") - 1).alias("place")).select("_f.*", "place")


@_query(ORACLES["top_markers_per_class"])
def top_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: the ranking as one CSV file."""
    path = f"{store.shared_folder(spark, 'top')}.csv"
    sinks.write_summary(top_markers_per_class(spark, sf_dir), path)
    return tabular.read_csv(spark, path, "Classe string, Marqueur string, Type string, `P(Classe)` double, Freq_Globale long, Entropie double")


# --- tests (H1-H6, A14) ---
def _u_sql(source: str, keys: str = "") -> str:
    by, part = (f"{keys}, ", f"PARTITION BY {keys} ") if keys else ("", "")
    group = f"GROUP BY {keys}" if keys else ""
    return f"""
g AS (SELECT {by}entropy, sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) AS c1, count(*) AS c FROM {source} GROUP BY {by}entropy),
k AS (SELECT *, sum(c) OVER ({part}ORDER BY entropy ROWS UNBOUNDED PRECEDING) - (c - 1) / 2 AS rank FROM g),
u AS (SELECT {by}CAST(sum(c1) AS BIGINT) AS n1, CAST(sum(c) - sum(c1) AS BIGINT) AS n2, CAST(sum(c1 * rank) - sum(c1) * (sum(c1) + 1) / 2 AS DOUBLE) AS u,
  CAST(sum(CAST(c AS DOUBLE) * c * c - c) AS DOUBLE) AS ties FROM k {group})"""


@_query(
    f"""WITH {_OF_MODES_SQL}, v AS (SELECT CASE WHEN mode IN ('es', 'fr') THEN 1 ELSE 2 END AS side, entropy FROM o), {_u_sql("v")},
a AS (SELECT avg(entropy) FILTER (WHERE side = 1) AS h, avg(entropy) FILTER (WHERE side = 2) AS l FROM v)
SELECT n1, n2, u, ties, round(1 - 2 * u / (CAST(n1 AS DOUBLE) * n2), 6) AS r, round(h, 6) AS mean_high, round(l, 6) AS mean_low, round(h - l, 6) AS difference FROM u, a WHERE n1 > 0 AND n2 > 0"""
)
def mann_whitney_u(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.mann_whitney(_of_modes(spark, sf_dir), HIGH, LOW).drop("p", "verdict"), "r", "mean_high", "mean_low", "difference")


@_query(
    f"""WITH {_OF_MODES_SQL}, q AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for i, a in enumerate(LANGS) for b in LANGS[i + 1:])}) t(mode1, mode2)),
v AS (SELECT mode1, mode2, CASE WHEN mode = mode1 THEN 1 ELSE 2 END AS side, entropy FROM o JOIN q ON mode = mode1 OR mode = mode2), {_u_sql("v", "mode1, mode2")}
SELECT mode1, mode2, n1, n2, u FROM u WHERE n1 > 0 AND n2 > 0"""
)
def mann_whitney_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.mann_whitney_pairs(_of_modes(spark, sf_dir), LANGS).drop("p", "stars")


_KW = [f"CAST(sum(CASE WHEN mode = '{m}' THEN 1 ELSE 0 END) AS DOUBLE) AS c{i}" for i, m in enumerate(LANGS)]


@_query(
    f"""WITH {_OF_MODES_SQL}, g AS (SELECT entropy, {", ".join(_KW)}, CAST(count(*) AS DOUBLE) AS c FROM o GROUP BY entropy),
k AS (SELECT *, sum(c) OVER (ORDER BY entropy ROWS UNBOUNDED PRECEDING) - (c - 1) / 2 AS rank FROM g),
t AS (SELECT sum(c) AS n, sum(c * c * c - c) AS ties, {" + ".join(f"coalesce(sum(c{i} * rank) * sum(c{i} * rank) / nullif(sum(c{i}), 0), 0)" for i in range(4))} AS terms,
  {" + ".join(f"CAST(sum(c{i}) > 0 AS INT)" for i in range(4))} AS groups FROM k)
SELECT CAST(n AS BIGINT) AS n, groups, round((12 / (n * (n + 1)) * terms - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 4) AS h FROM t"""
)
def kruskal_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.kruskal_wallis(_of_modes(spark, sf_dir), LANGS).drop("p"), "h", to=4)


def _tail_sql(z: str) -> str:
    """The upper tail of the normal distribution, by Simpson's rule over 2,000 steps from zero."""
    point = f"({z}) * i / 2000"
    weight = "CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"(0.5 - (SELECT sum({weight} * exp(-({point}) * ({point}) / 2)) FROM range(2001) r(i)) * ({z}) / 6000 / sqrt(2 * pi()))"


_Z_SQL = "sqrt(CAST(n1 AS DOUBLE) * n2 / 12 * (n1 + n2 + 1 - ties / (CAST(n1 + n2 AS DOUBLE) * (n1 + n2 - 1))))"


@_query(
    f"""WITH {_OF_MODES_SQL}, q AS (SELECT * FROM (VALUES {", ".join(f"('{a} vs {b}', '{a}', '{b}')" for i, a in enumerate(LANGS) for b in LANGS[i + 1:])}) t(test, mode1, mode2)),
v AS (SELECT test, CASE WHEN mode = mode1 THEN 1 ELSE 2 END AS side, entropy FROM o JOIN q ON mode = mode1 OR mode = mode2
  UNION ALL SELECT 'mann-whitney greater', CASE WHEN mode IN ('es', 'fr') THEN 1 ELSE 2 END, entropy FROM o), {_u_sql("v", "test")},
z AS (SELECT test, test LIKE '% vs %' AS two_sided, (CASE WHEN test LIKE '% vs %' THEN greatest(u, CAST(n1 AS DOUBLE) * n2 - u) ELSE u END - CAST(n1 AS DOUBLE) * n2 / 2 - 0.5) / {_Z_SQL} AS z FROM u WHERE n1 > 0 AND n2 > 0),
w AS (SELECT test, least(1.0, CASE WHEN two_sided THEN 2 ELSE 1 END * {_tail_sql("z")}) AS p FROM z),
kg AS (SELECT entropy, {", ".join(_KW)}, CAST(count(*) AS DOUBLE) AS c FROM o GROUP BY entropy),
kk AS (SELECT *, sum(c) OVER (ORDER BY entropy ROWS UNBOUNDED PRECEDING) - (c - 1) / 2 AS rank FROM kg),
kt AS (SELECT sum(c) AS n, sum(c * c * c - c) AS ties, {" + ".join(f"sum(c{i} * rank) * sum(c{i} * rank) / sum(c{i})" for i in range(4))} AS terms FROM kk),
kh AS (SELECT (12 / (n * (n + 1)) * terms - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h FROM kt),
r AS (SELECT test, p FROM w UNION ALL SELECT 'kruskal-wallis', 2 * {_tail_sql("sqrt(h)")} + sqrt(2 * h / pi()) * exp(-h / 2) FROM kh)
SELECT test, abs(round(p, 6)) AS p, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars FROM r"""
)
def rank_test_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1, H2, H4, H5: the p-values of all tests, from one spectrum. The SQL sums the tails up; four languages have three degrees of freedom."""
    spectrum = E.spectrum(_of_modes(spark, sf_dir), LANGS)
    parts = [
        S.kruskal_wallis_of(spectrum, LANGS).select(F.lit("kruskal-wallis").alias("test"), "p"),
        S.mann_whitney_of(spectrum, LANGS, HIGH, LOW).select(F.lit("mann-whitney greater").alias("test"), "p"),
        S.mann_whitney_pairs_of(spectrum, LANGS).select(F.concat_ws(" vs ", "mode1", "mode2").alias("test"), "p"),
    ]
    every = reduce(lambda a, b: a.unionByName(b), parts)
    return every.select("test", F.abs(F.round("p", 6)).alias("p"), S.stars(F.col("p")).alias("stars"))


@_query(
    f"""WITH {_OF_MODES_SQL}, q AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for i, a in enumerate(LANGS) for b in LANGS[i + 1:])}) t(mode1, mode2)),
v AS (SELECT mode1, mode2, CASE WHEN mode = mode1 THEN 1 ELSE 2 END AS side, entropy FROM o JOIN q ON mode = mode1 OR mode = mode2), {_u_sql("v", "mode1, mode2")}
SELECT printf('  %-20s : n=%5d, moy=%.4f, méd=%.4f, σ=%.4f', mode, count(*), avg(entropy), median(entropy), stddev_pop(entropy)) AS line FROM o GROUP BY mode
UNION ALL SELECT printf('  %s vs %s : U=%.1f', mode1, mode2, u) FROM u WHERE n1 > 0 AND n2 > 0"""
)
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4, H7: the lines of the written report that describe each mode and compare each pair, without their p-values."""
    path = f"{store.shared_folder(spark, 'report')}.txt"
    sinks.write_text(spark, path, hypothesis_report(_of_modes(spark, sf_dir), LANGS))
    lines = spark.read.text(path).filter(F.col("value").rlike("^  [a-z]+ +(vs [a-z]+ )?: (n|U)="))
    return lines.select(F.regexp_replace("value", ", p=.*", "").alias("line"))


@_query(
    ORACLES["rank_test_p_values"].rsplit("SELECT test,", 1)[0]
    + "SELECT CASE WHEN p < 0.001 THEN 'p < 0.001' WHEN p < 0.01 THEN 'p < 0.01' WHEN p < 0.05 THEN 'p < 0.05' ELSE 'p >= 0.05' END AS verdict FROM r WHERE test = 'mann-whitney greater'"
)
def mann_whitney_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H5: what the one-sided test says."""
    return S.mann_whitney(_of_modes(spark, sf_dir), HIGH, LOW).select("verdict")
