import csv
import json
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from specmark.operators import markers as M
from specmark.plans import analysis
from specmark.sources import glozz, sinks, tabular

UNIT = """<unit id="{id}"><metadata/><characterisation><type>{type}</type><featureSet>{features}</featureSet></characterisation>
<positioning>{start}{end}</positioning></unit>"""
AT = '<{side}><singlePosition index="{i}"/></{side}>'


def _unit(id, type="SitEmo", features="", start=0, end=4):
    side = lambda name, i: "" if i is None else f"<{name}><singlePosition/></{name}>" if i == "" else AT.format(side=name, i=i)
    return UNIT.format(id=id, type=type, features=features, start=side("start", start), end=side("end", end))


@pytest.fixture
def corpus(tmp_path):
    aa, ac = tmp_path / "C" / "aa", tmp_path / "C" / "ac"
    aa.mkdir(parents=True), ac.mkdir()

    def put(name, units, text):
        (aa / f"{name}.aa").write_text(f'<?xml version="1.0" encoding="UTF-8"?>\n<annotations>{units}<relation id="r"/></annotations>', "utf-8")
        if text is not None:
            (ac / f"{name}.ac").write_bytes(text if isinstance(text, bytes) else text.encode())

    feature = '<feature name="Mode">{}</feature><feature name="Categorie">Joie</feature><feature name="Categorie2"/>'
    put(
        "b é+1",
        _unit("p", "paragraph")
        + _unit("u1", features=feature.format("Montree"), start=1, end=5)
        + _unit("u2", " SitEmo ", '<feature name="Mode">A</feature><feature name="Mode"> B </feature>')
        + _unit("u3", features='<feature name="Mode" />', end="")
        + _unit("u4", end=None)
        + _unit("u5", end="x")
        + _unit("u6", end=999)
        + _unit("u7", start=5, end=2)
        + _unit("u8", "Autre", '<feature name="Remarque">ici</feature><feature name="Mode">Montree</feature>', 6, 10),
        "﻿😀été\r\nlong texte",
    )
    put("a", _unit("v1", features=feature.format("")), "texte")
    put("bad", "<unit id='x'><oops>", "texte")
    put("alone", _unit("w"), None)
    put("latin", _unit("w"), "été".encode("latin-1"))
    (ac / "extra.ac").write_text("x")
    return tmp_path


def test_annotations(spark, corpus):
    df = glozz.read_corpora(spark, {"C": str(corpus / "C"), "missing": str(corpus / "none")})
    rows = {r.unit_id: r for r in df.collect()}
    assert [r.unit_id for r in df.collect()] == ["v1", "u1", "u2", "u3", "u6", "u7", "u8"]
    assert rows["u1"].file_id == "b é+1" and rows["u1"].text_span == "😀été" and rows["u1"].categorie1 == "Joie" and rows["u1"].categorie2 is None
    assert rows["u2"].mode == "B" and rows["u2"].text_span == "﻿😀ét"
    assert (rows["u3"].mode, rows["u3"].end_idx, rows["u3"].text_span) == (None, -1, "")
    assert rows["u6"].text_span == "" and rows["u7"].text_span == ""
    assert rows["u8"].remarque == "ici" and rows["u8"].mode is None and rows["u8"].text_span == "long"
    assert rows["v1"].mode is None and rows["v1"].remarque is None
    assert {r.file_id for r in glozz.unpaired(spark, str(corpus / "C")).collect()} == {"alone", "latin"}
    assert glozz.read_corpora(spark, {"missing": str(corpus / "none")}).count() == 0


def test_units_at_any_depth_and_positions(spark, tmp_path):
    aa, ac = tmp_path / "C" / "aa", tmp_path / "C" / "ac"
    aa.mkdir(parents=True), ac.mkdir()
    bare = lambda id, start: _unit(id, start=None).replace("<positioning>", f"<positioning>{start}")
    units = (
        "<group><deep>" + _unit("in group", start=1) + "</deep></group>"
        + _unit("outer", start=2).replace("</unit>", _unit("in unit", start=3) + "</unit>")
        + bare("empty side", "<start/>") + bare("no side", "") + bare("other child", "<start><position index='1'/></start>")
        + bare("no index", "<start><singlePosition/></start>") + bare("spaced", '<start><singlePosition index=" +1 "/></start>')
        + bare("half", '<start><singlePosition index="1.5"/></start>') + bare("beyond", '<start><singlePosition index="99999999999"/></start>')
        + '<unit id="no kind"><positioning/></unit>'
    )
    (aa / "a.aa").write_text(f"<annotations>{units}</annotations>")
    (ac / "a.ac").write_text("0123456789")
    (aa / "late.aa").write_text("<annotations>" + _unit("lost") * 500 + "</annotation>")  # an error at the very end
    (ac / "late.ac").write_text("0123456789")
    rows = glozz.read_corpora(spark, {"C": str(tmp_path / "C")}).collect()
    assert [(r.unit_id, r.start_idx, r.text_span) for r in rows] == [
        ("in group", 1, "123"), ("outer", 2, "23"), ("in unit", 3, "3"), ("no index", -1, ""), ("spaced", 1, "123"), ("beyond", 2**31 - 1, ""),
    ]
    assert not glozz.is_well_formed(b"<a><x:b/></a>") and not glozz.is_well_formed(b"") and glozz.is_well_formed("<a>é</a>".encode())
    big = b"<r>" + b"<g><unit id='1'><x/></unit></g>" * 20000 + b"</r>"
    assert [k for k, _ in glozz.elements(big, "unit")] == list(range(20000))


def test_run_writes_all_results(spark, corpus, tmp_path):
    out = tmp_path / "out"
    analysis.run_annotations(spark, {"C": str(corpus / "C")}, str(out), min_freq=1, lemmatizer="identity")
    results = out / "specificity_results"
    head = (results / "entropy_by_mode_summary.csv").read_bytes()
    assert head.startswith(b"\xef\xbb\xbfmode,n_markers,mean_entropy,median_entropy,std_entropy\n") and head.count(b"\n") == 5
    assert "RAPPORT" in (results / "hypothesis_report.txt").read_text("utf-8")
    assert spark.read.parquet(str(out / "markers")).filter("marker_type = 'lemma'").count() > 0


def _workbook(path, rows):
    """rows of values: None, number, or text (shared and inline in turn)."""
    shared, lines = [], []
    for i, row in enumerate(rows, 1):
        cells = []
        for j, v in enumerate(row):
            at = f"{chr(65 + j)}{i}"
            if isinstance(v, str) and (i + j) % 2:
                cells.append(f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>')
            elif isinstance(v, str):
                shared.append(v)
                cells.append(f'<c r="{at}" t="s"><v>{len(shared) - 1}</v></c>')
            elif v is not None:
                cells.append(f'<c r="{at}"><v>{v}</v></c>')
        lines.append(f'<row r="{i}">{"".join(cells)}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{''.join(lines)}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{''.join(f'<si><t>{s}</t></si>' for s in shared)}</sst>")


def test_workbooks(spark, tmp_path):
    _workbook(tmp_path / "a.xlsx", [["idx", "ID", "NAME", "TEXT", "Joie", "Désignée"], [1, "i", "n", "un texte", 1, 1], [2, "j", "n", 12, "1", None]])
    _workbook(tmp_path / "b.xlsx", [["idx", "ID", "NAME", "TEXT", "Peur"], [3, "k", "n", "autre", 1.0]])
    df = tabular.read_folder(spark, str(tmp_path))
    rows = {r.ID: r for r in df.collect()}
    assert rows["i"].source_file == "a.xlsx" and rows["i"].Joie == 1.0 and rows["i"].Peur is None and rows["k"].Peur == 1.0
    assert rows["j"].TEXT == "12" and rows["j"].Joie is None  # a text is not the number one
    marked = analysis.markers_of_folder(spark, str(tmp_path), use_lemma=False)
    assert {(r.ID, r.categorie1, r.mode, r.marker_value) for r in marked.collect()} == {
        ("i", "Joie", "Designee", "un"), ("i", "Joie", "Designee", "texte"), ("k", "Peur", None, "autre"),
    }
    analysis.run_tables(spark, str(tmp_path), str(tmp_path / "out"), min_freq=1, use_lemma=False)
    assert not (tmp_path / "out/specificity_results/hypothesis_report.txt").exists()


def test_many_layouts_in_one_pass(spark, tmp_path):
    names = ["idx", "ID", "NAME", "TEXT"]
    for k, extra in enumerate((["Joie"], ["Peur", "Peur"], [None, "Joie", "Base"], [])):
        _workbook(tmp_path / f"w{k}.xlsx", [[*names, *extra], [1, f"i{k}", "n", "t", *([1] * len(extra))], [], [2, f"j{k}", "n", None]])
    df = tabular.read_folder(spark, str(tmp_path))
    assert df.columns == [*names, "Joie", "Peur", "Peur.1", "Base", "source_file"]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "binaryfile" not in plan.lower()  # the rows of all layouts were unpacked in one pass, and are read back
    rows = {r.ID: r for r in df.collect()}
    assert len(df.collect()) == 12 and rows["i1"].Peur == 1.0 and rows["i1"]["Peur.1"] == "1.0" and rows["i2"].Joie == 1.0 and rows["j3"].TEXT is None
    with pytest.raises(ValueError):
        _workbook(tmp_path / "x" / "none.xlsx", []) if (tmp_path / "x").mkdir() is None else None
        tabular.read_folder(spark, str(tmp_path / "x"))
    with zipfile.ZipFile(tmp_path / "w0.xlsx") as z, z.open("xl/worksheets/sheet1.xml") as part:
        seen = [len(row) for row in tabular._elements(part, f"{tabular._NS}row")]  # rows come one by one, with their cells
    assert seen == [5, 5, 0, 3]


def test_csv_and_dispatch(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes('﻿idx,ID,NAME,TEXT,Joie\n1,a,n,"dit ""oui""\nencore",1\n2,b,,NA,\n'.encode())
    for name in ("t.csv", "t.dat"):
        (tmp_path / name).write_bytes(path.read_bytes())
        rows = {r.ID: r for r in tabular.read_input(spark, str(tmp_path / name)).collect()}
        assert rows["a"].TEXT == 'dit "oui"\nencore' and rows["a"].Joie == 1.0
        assert rows["b"].NAME == "" and rows["b"].TEXT == "NA" and rows["b"].Joie is None
    M.check_required(tabular.read_input(spark, str(path)))


def _sets(spark, rows):
    return spark.createDataFrame(rows, "marker string, corpora array<string>, emotions array<string>")


def test_dashboard_page(spark, tmp_path):
    sinks.write_dashboard(_sets(spark, [("</script><b>", ["XLSX"], ["Joie"]), ("été", ["Glozz"], ["Peur"]), ("etat", ["Glozz", "XLSX"], ["Joie", "Peur"])]), str(tmp_path / "d.html"))
    page = (tmp_path / "d.html").read_text("utf-8")
    assert "</script><b>" not in page and '<option value="only:Glozz">' in page
    shards = json.loads(page.split('id="data">')[1].split("</script>")[0])
    assert [i["marker"] for s in shards for i in s["items"]] == ["</script><b>", "etat", "été"]
    sinks.write_dashboard(_sets(spark, []), str(tmp_path / "none.html"))
    assert "Marqueurs" in (tmp_path / "none.html").read_text("utf-8")


def test_dashboard_in_shards(spark, tmp_path):
    rows = [(f"{'aàâeéz'[k % 6]}{'<b>' if k % 50 == 0 else ''}{k // 6:03d}", ["Glozz", "XLSX"] if k % 2 else ["XLSX"], ["Joie"] if k % 3 else ["Joie", "Peur"]) for k in range(600)]
    sinks.write_dashboard(_sets(spark, rows).repartition(5), str(tmp_path / "d.html"), per_shard=40, inline=100)
    page = (tmp_path / "d.html").read_text("utf-8")
    index = json.loads(page.split('id="data">')[1].split("</script>")[0])[:-1]
    assert len(index) > 10 and sum(s["n"] for s in index) == 600 and "d.html.data/" in page and "<b>" not in page.split('id="data">')[1]
    found = []
    for shard in index:
        items = [json.loads(x) for x in (tmp_path / "d.html.data" / shard["file"]).read_text("utf-8").split("\n") if x]
        assert len(items) == shard["n"] and items[0]["marker"] == shard["first"]
        assert shard["corpora"] == sorted({c for i in items for c in i["corpora"]}) and shard["emotions"] == sorted({e for i in items for e in i["emotions"]})
        found += items
    assert sorted((i["marker"], i["corpora"], i["emotions"]) for i in found) == sorted(rows)
    letters = [re.sub("<b>", "", i["marker"]).translate(str.maketrans("àâé", "aae")) for i in found if "<b>" not in i["marker"]]
    assert letters == sorted(letters)


def test_summary_csv(spark, tmp_path):
    df = spark.range(3).withColumn("x", F.when(F.col("id") > 0, F.lit('a "b", c')))
    sinks.write_summary(df.orderBy("id"), str(tmp_path / "s.csv"))
    assert (tmp_path / "s.csv").read_text("utf-8-sig") == 'id,x\n0,\n1,"a ""b"", c"\n2,"a ""b"", c"\n'
    parts = spark.range(5000, numPartitions=7).select(F.col("id").alias("n,m"), (F.col("id") / 8).alias("x"), F.concat(F.lit("é\n"), "id").alias("t"))
    sinks.write_summary(parts, str(tmp_path / "many.csv"))  # several parts, one file, in order
    with open(tmp_path / "many.csv", encoding="utf-8-sig", newline="") as f:
        assert list(csv.reader(f)) == [["n,m", "x", "t"], *([str(i), repr(i / 8), f"é\n{i}"] for i in range(5000))]
    sinks.write_csv(df.repartitionByRange(3, "id"), str(tmp_path / "parts.csv"))
    parts = [p.read_text("utf-8") for p in (tmp_path / "parts.csv").glob("part-*")]
    assert len(parts) == 3 and all(p.startswith("\ufeffid,x\n") for p in parts)
    again = tabular.read_csv(spark, str(tmp_path / "parts.csv"))
    assert again.columns == ["id", "x"] and sorted((r.id, r.x) for r in again.collect()) == [(0, None), (1, 'a "b", c'), (2, 'a "b", c')]


def test_command_line(spark, corpus, tmp_path, capsys):
    from specmark.__main__ import main

    out, tables = str(tmp_path / "o"), tmp_path / "x"
    tables.mkdir()
    _workbook(tables / "a.xlsx", [["idx", "ID", "NAME", "TEXT", "Joie", "Désignée"], [1, "i", "n", "été long", 1, 1]])
    for step in ("parse", "markers", "specificity"):
        main(["annotations", str(corpus / "C"), "--step", step, "--output-dir", out, "--lemmatizer", "identity", "--min-freq", "1", "--include-empty"], spark)
    main(["tables", str(tables), "--output-dir", f"{out}/t", "--no-lemma", "--min-freq", "1"], spark)
    main(["top", f"{out}/specificity_results/entropy_per_marker_emotion.csv", "--top", "3", "--export", f"{out}/top.csv"], spark)
    assert (tmp_path / "o/top.csv").read_text("utf-8-sig").startswith("Classe,Marqueur,Type,P(Classe),Freq_Globale,Entropie\nJoie,text,lemma,1.0,1,0.0\n")
    main(["compare", "--annotations", f"{out}/markers", f"{out}/none", "--tables", f"{out}/t/markers"], spark)
    assert "été" in capsys.readouterr().out
    main(["dashboard", "--annotations", f"{out}/markers", "--tables", f"{out}/t/markers", "--output", f"{out}/d.html"], spark)
    assert '"marker": "long"' in (tmp_path / "o/d.html").read_text("utf-8")


def test_types_without_missing_fields(spark, tmp_path):
    rows = ["i,f,m,t,b,bm,e,inf,w,q", "1,1.0,1,x,True,true,,inf,+1, NA ", "2,2e3,NA,null,FALSE,nan,NA,-1.5,-07,a", '3,.5,n/a,"NA",true,False,,1.,12,"a ""b"""']
    (tmp_path / "t.csv").write_text("\n".join(rows) + "\n")
    df = tabular.read_csv(spark, str(tmp_path / "t.csv"), na_values=tabular.NA_VALUES)
    assert dict(df.dtypes) == {"i": "bigint", "f": "double", "m": "double", "t": "string", "b": "boolean", "bm": "string", "e": "double", "inf": "double", "w": "bigint", "q": "string"}
    a, b, c = sorted(df.collect(), key=lambda r: r.i)
    assert (a.f, b.f, c.f, a.m, b.m) == (1.0, 2000.0, 0.5, 1.0, None) and (a.t, b.t, c.t) == ("x", None, None)
    assert (a.b, b.b, c.b) == (True, False, True) and (a.bm, b.bm) == ("true", None) and a.inf == float("inf") and (a.w, b.w) == (1, -7)
    assert (a.q, c.q) == (" NA ", 'a "b"')
    as_is = tabular.read_csv(spark, str(tmp_path / "t.csv"), na_values=())
    assert dict(as_is.dtypes)["m"] == "string" and dict(as_is.dtypes)["e"] == "string"
    raw = spark.read.csv(str(tmp_path / "t.csv"), header=True)
    total = {r.name: r[1:] for r in tabular.column_counts(raw).collect()}  # counts of two parts add up
    parts = [{r.name: r[1:] for r in tabular.column_counts(raw.filter(c)).collect()} for c in ("i < 2", "i >= 2")]
    assert all(total[k] == tuple(x + y for x, y in zip(parts[0][k], parts[1][k])) for k in total)
    texts = [r.TEXT for r in df.select(M.as_text(df, "m").alias("TEXT")).union(df.select(M.as_text(df, "b"))).union(df.select(M.as_text(df, "i"))).collect()]
    assert texts == ["1.0", None, None, "True", "False", "True", "1", "2", "3"]


def test_numbers_as_texts_of_workbooks(spark, tmp_path):
    head = ["idx", "ID", "NAME", "TEXT"]
    write = lambda name, texts: _workbook(tmp_path / name, [head, *([k, f"{name}{k}", "n", t] for k, t in enumerate(texts))])
    texts = lambda: {r.ID: r.TEXT for r in tabular.read_folder(spark, str(tmp_path)).collect()}
    write("a.xlsx", [12, 7])
    assert texts() == {"a.xlsx0": "12", "a.xlsx1": "7"}
    write("b.xlsx", [5, None])
    assert texts() == {"a.xlsx0": "12.0", "a.xlsx1": "7.0", "b.xlsx0": "5.0", "b.xlsx1": None}
    write("c.xlsx", ["mot", 3, 2.5])
    assert texts() == {"a.xlsx0": "12", "a.xlsx1": "7", "b.xlsx0": "5.0", "b.xlsx1": None, "c.xlsx0": "mot", "c.xlsx1": "3", "c.xlsx2": "2.5"}


def test_figures_are_taken_while_writing(spark, corpus, tmp_path):
    figures = analysis.write_annotations(spark, {"C": str(corpus / "C"), "missing": str(corpus / "none")}, str(tmp_path / "annotations"))
    rows = analysis.read_stage(spark, str(tmp_path / "annotations"))
    for name in ("SitEmo", "Autre"):
        assert figures[f"type {name}"] == rows.filter(F.col("type") == name).count() > 0
    assert figures["mode Montree"] == rows.filter("mode = 'Montree'").count() == 1 and figures["mode Suggeree"] == 0
    assert figures["mode none"] == rows.filter("type = 'SitEmo' AND mode IS NULL").count() > 0 and figures["mode other"] == 1
    assert (figures["skipped no_text"], figures["skipped not_utf8"], figures["skipped malformed"]) == (1, 1, 1)
    assert set(analysis.write_annotations(spark, {}, str(tmp_path / "none")).values()) == {0}


def test_one_corpus_reads_its_folder_alone(spark, corpus, tmp_path):
    where = {name: str(corpus / "C") for name in ("A", "01", "1")}
    analysis.run_annotations(spark, where, str(tmp_path / "o"), min_freq=1, lemmatizer="identity")
    for stage in ("annotations", "markers"):
        every, one = analysis.read_stage(spark, str(tmp_path / "o" / stage)), analysis.read_stage(spark, str(tmp_path / "o" / stage), "01")
        assert {r.corpus for r in every.select("corpus").distinct().collect()} == set(where)
        files = one._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(corpus" in files and "01" in files.split("PartitionFilters")[1][:60]
        one.count()
        read = one.select(F.input_file_name().alias("f")).distinct().collect()
        assert read and all("/corpus=01/" in r.f for r in read) and one.count() * 3 == every.count()
