import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from deskmill.sources import files, markup
from deskmill.streaming import ingest as stream

PAGE = """<html><body><nav>меню</nav><ul class="b-breadCrumbs__items"><li>А</li><li>Б</li></ul><article><h1>Заголовок</h1><script>var a = "</p>";</script><div id="left_sidebar">мусор</div>
<strong>Релиз 1.2</strong><p>Первый<p>Второй<ul><li>раз<ul><li>вложен</li></ul></li><li>два</li></ul><ol><li>один</li></ol>
<table><tr><th>К</th><th>В</th></tr><tr><td rowspan="2">а</td><td>1</td></tr><tr><td>2 &#xf05a;</td></tr></table><a title="Следующая" href="n.htm">дальше</a></article></body></html>"""


def test_html_fields():
    d = markup.html_document("p.htm", PAGE)
    assert (d["page_title"], d["breadcrumb_raw"], d["release_version"], d["next_file"]) == ("Заголовок", "А > Б", "1.2", "n.htm")
    body = d["page_content"]
    assert "мусор" not in body and "var a" not in body and "меню" not in body
    assert "- \nраз\n- \nвложен" in body.replace("-\n", "- \n") and "1.\nодин" in body
    assert "| К | В |\n|---|---|\n| а | 1 |\n| а | 2 ℹ️ **ИНФОРМАЦИЯ:** |" in body


@pytest.mark.parametrize("n, kept", [(19, False), (20, True)])
def test_html_least_length(n, kept):
    d = markup.html_document("name.html", f"<body>{'x' * n}</body>")
    assert (d is not None) == kept and (not kept or (d["page_title"], d["breadcrumb_raw"], d["release_version"]) == ("name", markup.NO_SECTION, None))
    assert markup.html_document("n.htm", "") is None and markup.html_document("n.htm", "<p><b>" * 3000 + "z" * 30) is not None


def test_rowspans():
    grid = markup.table_markdown([[("a", 1), ("b", 2), ("c", 1)], [("d", 1), ("e", 1)], [("f", 1), ("g", 1), ("h", 1)]])
    assert grid.split("\n") == ["| a | b | c |", "|---|---|---|", "| d | b | e |", "| f | g | h |"]
    assert markup.table_markdown([[("a", 3), ("b", 1)], [("c", 1)], [("d", 1)]]).split("\n")[2:] == ["| a | c |", "| a | d |"]


def docx(paragraphs, table=None):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:pPr>{f'<w:pStyle w:val={chr(34)}{s}{chr(34)}/>' if s else ''}{'<w:numPr/>' if s == 'L' else ''}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>" for s, t in paragraphs)
    if table:
        body += "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in r) + "</w:tr>" for r in table) + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="X2"><w:name w:val="Заголовок 2"/></w:style><w:style w:styleId="Z"><w:name w:val="Глава"/></w:style></w:styles>')
    return out.getvalue()


def test_docx_sections():
    data = docx([("1", "Содержание"), ("", "стр. 1"), ("1", "Монтаж"), ("", "к" * 21), ("X2", "Питание"), ("L", "пункт"), ("1", "Пусто"), ("Z", "Особая")], [["a", "b"], ["c", "d"]])
    got = markup.sections(markup.docx_elements(data, {"Глава": 1}), "f.docx")
    assert [(s["breadcrumb_raw"], s["page_content"]) for s in got] == [("Монтаж", "к" * 21), ("Монтаж > Питание", "к" * 21 + "\n- пункт"), ("Особая", "| a | b |\n|---|---|\n| c | d |")]


def test_styles_of_a_source_type_and_cell_call_outs(spark):
    data = docx([("Z", "Глава"), ("", "до"), ("1", "Раздел"), ("", "после")], [["Важно: стоп", "b"]])
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        parts = {n: z.read(n).decode() for n in z.namelist()}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, body in parts.items():
            z.writestr(n, body.replace('w:val="Глава"', 'w:val="ps2_Заголовок 2"'))
    rows = [(kind, "p", "f.docx", out.getvalue()) for kind in ("r500_docx", "other_docx")]
    got = markup.documents(spark.createDataFrame(rows, "source_type STRING, path STRING, name STRING, content BINARY")).collect()
    titles = lambda kind: [r.page_title for r in got if r.source_type == kind]
    assert titles("r500_docx") == ["Глава", "Раздел"] and titles("other_docx") == ["f", "Раздел"]
    assert any("| ⚠️ **Важно:** стоп | b |" in r.page_content for r in got)


@pytest.mark.parametrize("n, carried", [(20, False), (21, True), (499, True), (500, False)])
def test_section_overlap(n, carried):
    got = markup.sections([(1, "A"), (0, "y" * n), (1, "B"), (0, "z")], "f.docx")
    assert got[1]["page_content"] == ("y" * n + "\nz" if carried else "z")


def test_scan_and_documents(spark, tmp_path):
    d = tmp_path / "html" / "deep"
    d.mkdir(parents=True)
    (d / "a b.htm").write_text(PAGE, encoding="utf-8")
    (d / "a_print.htm").write_text(PAGE, encoding="utf-8")
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "m.docx").write_bytes(docx([("1", "Раздел"), ("", "текст")]))
    (tmp_path / "docs" / "~$m.docx").write_bytes(b"lock")
    (tmp_path / "docs" / "broken.docx").write_bytes(b"no zip")
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "[RL-1] x.json").write_text(json.dumps({"result": [{"comments_list": [{"id": 1}]}]}), encoding="utf-8")
    found = files.scan(spark, {"x_html": str(tmp_path / "html"), "m_docx": str(tmp_path / "docs"), "support_tickets": str(tmp_path / "t"), "none_html": str(tmp_path / "gone")})
    assert {(r.source_type, r.name) for r in found.collect()} == {("x_html", "a b.htm"), ("m_docx", "m.docx"), ("m_docx", "broken.docx"), ("support_tickets", "[RL-1] x.json")}
    docs = {r.source_file: r for r in markup.documents(found.filter("source_type <> 'support_tickets'")).collect()}
    assert docs["a b.htm"].format == "html" and docs["m.docx"].page_title == "Раздел" and len(docs) == 2 and docs["m.docx"].keywords is None
    assert files.ticket_nodes(found.filter("source_type = 'support_tickets'")).first().node_id == "1"
    assert files.scan(spark, {"none_html": str(tmp_path / "gone")}).count() == 0


def test_csv_json_and_sinks(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Код;Создано\nRL-1;05.03.2024 10:00:00\nrl-2;когда-то\nRL-3;2024-03-05 10:00:00\n", encoding="utf-8")
    rows = files.portal_csv(spark, str(tmp_path / "p.csv"), "Создано").collect()
    assert [r["Создано"] is None for r in rows] == [False, True, False] and rows[0]["Создано"] == rows[2]["Создано"]
    j = tmp_path / "j"
    j.mkdir()
    (j / "a.json").write_text('\n [{"q": "x", "n": 1}, {"q": null}]', encoding="utf-8")
    for skipped, body in (("summary.json", "[{}]"), ("_errors.json", "[{}]"), ("full_report_1.json", "[{}]"), ("obj.json", "{}"), ("bad.json", "[{")):
        (j / skipped).write_text(body, encoding="utf-8")
    got = files.json_arrays(spark, str(j), "q: STRING, n: INT").filter(F.col("q").isNotNull() | (F.col("file") == "a.json"))
    assert [(r.file, r.ord, r.q, r.n) for r in got.orderBy("file", "ord").collect()] == [("a.json", 0, "x", 1), ("a.json", 1, None, None)]
    store, df = str(tmp_path / "s"), spark.createDataFrame([(1, "a"), (2, "b")], "k INT, source_type STRING")
    assert files.append_missing(df, store, "k").count() in (0, 2) and files.append_missing(df, store, "k").count() == 0
    assert spark.read.parquet(store).count() == 2
    files.write_new(df, str(tmp_path / "v1"))
    with pytest.raises(Exception, match="(?i)exists"):
        files.write_new(df, str(tmp_path / "v1"))
    files.write_partitions(df, str(tmp_path / "p"))
    files.write_partitions(spark.createDataFrame([(9, "a")], "k INT, source_type STRING"), str(tmp_path / "p"))
    assert {(r.k, r.source_type) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {(9, "a"), (2, "b")}


def test_stream_ingest_replaces_and_removes(spark, tmp_path):
    src, store = str(tmp_path / "in"), str(tmp_path / "store")
    write = lambda rows: spark.createDataFrame(rows, "doc_id BIGINT, text STRING, at INT, ord STRING").coalesce(1).write.mode("append").parquet(src)
    read = lambda: spark.readStream.schema("doc_id BIGINT, text STRING, at INT").parquet(src)
    go = lambda c: stream.ingest(read(), store, str(tmp_path / c), order_col="at").awaitTermination(90)
    have = lambda: sorted((r.doc_id, r.ord, len(r.text)) for r in stream.stored_chunks(spark, store).collect())
    write([(1, "x" * 500, 1, "a"), (2, None, 1, "a"), (3, "old", 1, "a")])
    go("c1")
    assert have() == [(1, 0, 400), (1, 1, 150), (3, 0, 3)]
    write([(1, "y" * 10, 2, "a"), (1, "z" * 9, 3, "a"), (3, None, 2, "a"), (4, "new", 2, "a")])
    go("c1")
    assert have() == [(1, 0, 9), (4, 0, 3)]
    go("c2")  # everything once more, in one batch
    assert have() == [(1, 0, 9), (4, 0, 3)]


def test_ingest_run(spark, tmp_path):
    from deskmill.operators import ingest

    store, registry, schema = str(tmp_path / "store"), str(tmp_path / "reg"), "parent_id STRING, source_type STRING, path STRING, body STRING"

    def parse(files):
        return files.select(ingest.parent_id("source_type", "path", "ord").alias("parent_id"), "source_type", "path", F.col("content").alias("body"))

    def go(rows, **more):
        files = ingest.hashed(spark.createDataFrame(rows, "source_type STRING, path STRING, content STRING, ord INT"))
        return {r.state: r.n for r in ingest.run(files, store, registry, parse, schema, **more).collect()}

    def have():
        return sorted((r.path, r.body) for r in files.latest_version(spark, store, schema)[0].collect())

    assert go([("d", "a", "1", 0), ("d", "b", "1", 0)]) == {"new": 2}
    assert go([("d", "a", "1", 0), ("d", "b", "1", 0)]) == {"same": 2} and files.latest_version(spark, store, schema)[1] == 1
    assert go([("d", "a", "2", 0), ("d", "c", "1", 0)]) == {"changed": 1, "deleted": 1, "new": 1} and have() == [("a", "2"), ("c", "1")]
    assert go([("d", "e", "1", 0)], complete=False) == {"new": 1, "same": 2} and have() == [("a", "2"), ("c", "1"), ("e", "1")]
    known = {r.path: r.parent_ids for r in files.latest_version(spark, registry, ingest.REGISTRY)[0].collect()}
    assert set(known) == {"a", "c", "e"} and all(len(x) == 1 for x in known.values())
    assert go([]) == {"deleted": 3} and have() == []


def test_unreadable_store_is_an_error(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "x.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception):  # noqa: B017
        files.append_missing(spark.createDataFrame([(1,)], "k INT"), str(tmp_path / "s"), "k")


def test_audit_log(spark, tmp_path):
    from deskmill.operators.answers import AUDIT

    log = str(tmp_path / "audit")
    rows = spark.createDataFrame([(1, "q", 0)], "query_id BIGINT, query STRING, n_docs_retrieved INT")
    files.append_audit(rows, log)
    files.append_audit(rows, log)
    (tmp_path / "audit" / "z.json").write_text('{"query_id": 7}\n\nbroken {\n{"query_id": 8}\n')
    good, bad = files.audit_records(spark, log, AUDIT)
    assert sorted(r.query_id for r in good.collect()) == [1, 1, 7, 8]
    assert [(r.file, r.line_no, r.line) for r in bad.collect()] == [("z.json", 3, "broken {")]


def test_audit_windows(spark, tmp_path):
    src = str(tmp_path / "e")
    spark.sql("SELECT timestamp'2024-01-01 00:03:00' AS ts, 'a' AS event_type, 2.0D AS value UNION ALL SELECT timestamp'2024-01-01 00:07:00', 'a', 4.0D UNION ALL SELECT timestamp'2024-01-01 00:12:00', 'a', 6.0D").write.parquet(src)
    live = stream.audit_windows(spark.readStream.schema("ts TIMESTAMP, event_type STRING, value DOUBLE").parquet(src))
    q = live.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.n, r["mean"]) for r in spark.table("w").collect()) == [(1, 6.0), (2, 3.0)]
