"""Store operations on quads, files written and read, streams, hooks for models, and small tables' edges."""

import json
import struct

import duckdb
import pytest
from pyspark.sql import functions as F

from lectern.operators import chunking, enrich, sequence, tables, validate
from lectern.plans import export
from lectern.plans.catalog import ORACLES, QUERIES
from lectern.plans.catalog_documents import MAKERS
from lectern.plans.quads import QuadStore, to_quads
from lectern.plans.registry import table
from lectern.sources import delimited, detect, office
from lectern.sources.reader import convert, parse_one, read_files
from lectern.storage import shared_dir, stored
from lectern.streaming.ingest import ingest

NATIONS = [(k, f"Nation {k}") for k in range(4)]


def frames(spark, files):
    return convert(spark.createDataFrame([(n, bytearray(b)) for n, b in files], "name string, content binary"), store=True)


def test_quad_store(spark):
    s = QuadStore.empty(spark).insert("s:1", "p:a", "o:1", "g:1").insert_literal("s:1", "p:n", "7", "integer", "g:1")
    s = s.insert_lang("s:2", "p:t", "hé", "fr", "g:2").insert_lang("s:2", "p:t", "hé", "fr", "g:2")
    assert s.count() == 3 and s.count("g:1") == 2
    with pytest.raises(ValueError):
        s.insert_lang("s:2", "p:t", "x", "not a tag")
    copied = s.copy("g:1", "g:3")
    assert copied.count() == 5 and {r["subject"] for r in copied.scan("g:3").collect()} == {"s:1"}
    assert s.clear("g:1").count() == 1 and s.clear().count() == 0
    assert s.ask("ASK { ?s <p:t> ?t FILTER(LANG(?t) = 'fr') }") and not s.ask("ASK { <s:9> ?p ?o }")
    assert s.query("SELECT ?o { <s:1> <p:n> ?o }", "g:1").collect()[0]["o"] == "7"
    assert s.query("SELECT ?o { <s:1> <p:n> ?o }", "g:2").count() == 0
    lines = {r["line"] for r in s.serialize("ntriples").collect()}
    assert '<s:2> <p:t> "hé"@fr .' in lines and '<s:1> <p:n> "7"^^<http://www.w3.org/2001/XMLSchema#integer> .' in lines
    assert s.serialize("turtle", "g:1").count() == 1
    with pytest.raises(ValueError):
        s.serialize("other")


def test_optional_then_join_takes_every_customer(spark, sf):
    rows = QUERIES["sparql_optional_then_join"](spark, sf)
    assert rows.select("c").distinct().count() == table(spark, sf, "customer").count()


def test_products_of_small_parts_are_broadcast(spark, sf):
    plan = QUERIES["sparql_optional_then_join"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin BuildLeft" in plan


def test_equal_files_are_one_document(spark):
    page = MAKERS["html"][1](1, "EUROPE", NATIONS)
    f = frames(spark, [("a.html", page), ("b.html", page), ("c.html", page + b"<p>more</p>")])
    assert {r["file_name"] for r in f.docs.collect()} == {"a.html", "b.html", "c.html"} and f.docs.select("doc").distinct().count() == 2
    assert f.elements.count() == f.elements.select("el").distinct().count()
    quads = to_quads(f)
    assert quads.count() == quads.distinct().count()
    assert quads.filter("predicate like '%nextElement' and subject = object").isEmpty()
    assert validate.validate(f).isEmpty()


def test_one_parser_pass(spark):
    """What is read of stored rows holds no parser."""
    f = frames(spark, [("a.md", MAKERS["markdown"][1](1, "ASIA", NATIONS))])
    for made in (to_quads(f), export.markdown(f), chunking.candidates(f, chunking.Options()), validate.validate(f)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan and "Python" not in plan


def test_files_of_every_format_are_read(spark, tmp_path):
    for kind, (ending, make) in MAKERS.items():
        (tmp_path / f"{kind}.{ending}").write_bytes(make(0, "AFRICA", NATIONS))
    f = read_files(spark, str(tmp_path))
    docs = {r["file_name"]: r for r in f.docs.collect()}
    assert len(docs) == len(MAKERS) and all(r["status"] == "Success" for r in docs.values())
    said = {r["file_name"] for r in f.docs.join(f.elements.filter("text like '%AFRICA%'"), "doc").select("file_name").distinct().collect()}
    assert said >= {f"{k}.{e}" for k, (e, _) in MAKERS.items() if k not in ("csv", "image", "webvtt")}


def test_written_exports(spark, tmp_path):
    f = frames(spark, [(f"{k}.md", f"# H{k}\n\ntext {k}\n".encode()) for k in range(40)])
    export.write(f, "markdown", str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == 40 and all(r["file_name"].endswith(".md") and r["text"].startswith("# H") for r in rows)
    assert all(r["file_name"].startswith(str(r["part"])) or str(r["part"]).isdigit() for r in rows)


def test_streaming_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.md").write_text(f"# H{k}\n\n| a |\n|---|\n| {k} |\n")
    args = [str(tmp_path / x) for x in ("in", "out", "state")]
    ingest(spark, *args).awaitTermination()
    (tmp_path / "in" / "3.html").write_text("<h1>H3</h1>")
    ingest(spark, *args).awaitTermination()
    docs = spark.read.parquet(f"{args[1]}/docs")
    assert sorted(r["file_name"] for r in docs.collect()) == ["0.md", "1.md", "2.md", "3.html"]
    assert {r["text"] for r in spark.read.parquet(f"{args[1]}/elements").filter("cls = 'SectionHeader'").collect()} == {f"H{k}" for k in range(4)}
    assert spark.read.parquet(f"{args[1]}/cells").count() == 6


def test_merged_chunks_are_not_cut(spark, tmp_path):
    said = [(0, "system", "Rules"), (1, "user", "word " * 600), (2, "assistant", "yes"), (3, "user", "no")]
    spark.createDataFrame([(1, *x) for x in said], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    got = QUERIES["chunks_merged"](spark, str(tmp_path)).select("doc", "chunk_index", "text").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(ORACLES["chunks_merged"]).fetchall()) and len(got) == 3


def test_font_runs_of_words_at_one_place(spark):
    words = [("d", 1, 0.0, 0.0, "a", 20.0), ("d", 1, 0.0, 0.0, "b", 30.0), ("d", 1, 0.0, 0.0, "c", 20.0), *(("d", 1, 9.0, float(k), "x", 10.0) for k in range(5))]
    made = lambda rows: spark.createDataFrame(rows, "doc string, page int, top double, left double, text string, font_size double").coalesce(1)
    found = [sorted((r["run"], r["text"]) for r in sequence.font_runs(made(rows)).collect()) for rows in (words, [words[k] for k in (2, 0, 1, 3, 4, 5, 6, 7)])]
    assert found[0] == found[1] == [(1, "a"), (2, "b"), (3, "c")]


def test_markdown_cells_with_bars(spark):
    f = frames(spark, [("a.csv", b"h;w\na|b;x\n\xc3\xa9;y\n")])
    lines = export.markdown(f).collect()[0]["text"].splitlines()
    assert lines == ["| h    | w   |", "| ---- | --- |", "| a\\|b | x   |", "| é    | y   |"]


def test_titles_are_not_printed(spark):
    f = frames(spark, [("a.html", b"<html><head><title>Shown once</title></head><body><p>x</p></body></html>")])
    assert export.markdown(f).collect()[0]["text"] == "x\n"
    assert "<h1>" not in export.html(f).collect()[0]["text"]


def test_wide_sheets_and_long_cells():
    cell = lambda ref, v: f'<c r="{ref}"><v>{v}</v></c>'
    from lectern.plans.catalog_documents import archive, relations

    sheet = f'<worksheet><sheetData><row r="1">{cell("A1", 1)}</row><row r="1048576">{cell("XFD1048576", 2)}</row></sheetData></worksheet>'
    book = archive({
        "xl/workbook.xml": '<workbook xmlns:r="http://x/r"><sheets><sheet name="s" r:id="a"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": relations(a=("worksheet", "worksheets/s.xml")), "xl/worksheets/s.xml": sheet,
    })
    cells = [(r["row"], r["col"], r["text"]) for r in office.parse_xlsx("a.xlsx", book) if r["kind"] == "cell"]
    assert cells == [(0, 0, "1"), (1048575, 16383, "2")]
    rows = delimited.parse("a.csv", f"a,b\n{'x' * 140_000},y\n".encode())
    assert max(len(r["text"]) for r in rows if r["kind"] == "cell") == 140_000


def test_archives_have_a_bound(monkeypatch):
    monkeypatch.setattr(office, "LARGEST", 100)
    rows = parse_one("a.docx", MAKERS["docx"][1](1, "A", NATIONS), "docx", None)
    assert rows[0]["status"] == "Failure" and "unpacked" in rows[0]["error"]


def test_pictures():
    for key, kind in enumerate(("png", "gif", "bmp", "jpeg", "tiff")):
        row = parse_one("x", MAKERS["image"][1](key, "A", NATIONS), "image", None)[1]
        assert (row["pic_format"], row["img_w"], row["img_h"]) == (kind, 100 + key, 14)
    webp = b"RIFF" + bytes(4) + b"WEBPVP8X" + bytes(8) + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    assert parse_one("x", webp, "image", None)[1]["img_w"] == 100
    assert parse_one("x", struct.pack("<I", 1), "image", None)[0]["status"] == "Failure"


def test_model_stage_and_presets(spark):
    f = frames(spark, [("a.md", b"# H\n\npara\n")])
    boxed = f.with_(elements=f.elements.withColumn("bbox", F.when(F.col("cls") == "Paragraph", F.struct(F.lit(1.0).alias("top"), F.lit(2.0).alias("left")))))

    def model(batches):
        for b in batches:
            yield b.assign(text=b["text"].str.upper())[["el", "text"]]

    def merge(f, rows):
        new = rows.select("el", F.col("text").alias("_t"))
        return f.with_(elements=f.elements.join(new, "el", "left").withColumn("text", F.coalesce("_t", "text")).drop("_t"))

    stage = enrich.model_stage(lambda f: f.elements.filter("cls = 'Paragraph'").select("el", "text"), model, "el string, text string", merge)
    out = enrich.enrich(boxed, "ocr_only", {"ocr": stage})
    rows = {r["cls"]: r for r in out.elements.collect()}
    assert rows["Paragraph"]["text"] == "PARA" and sorted(r["ord"] for r in rows.values()) == [0, 1] and rows["Paragraph"]["ord"] == 0
    assert set(enrich.PRESETS) == {"standard_pdf", "simple", "ocr_only", "vlm"}
    assert enrich.missing_structure(f).isEmpty() and enrich.missing_text(boxed).isEmpty()


def test_languages_groups_and_totals(spark):
    f = frames(spark, [("a.md", b"# A\n"), ("b.md", b"# B\n"), ("bad.zz", b"\0")])
    rows = enrich.manifest(spark, '[[translations]]\ngroup = "g"\nlanguage = "fr"\nsource = "a.md"\n[[translations]]\ngroup = "g"\nlanguage = "de"\nsource = "b.md"\n')
    groups = enrich.translation_groups(rows, f.docs).orderBy("language").collect()
    assert [(r["language"], r["first"]) for r in groups] == [("de", False), ("fr", True)]
    docs = enrich.set_language(f.docs, enrich.translation_groups(rows, f.docs).select("doc", "language"))
    assert {r["language"] for r in docs.collect()} == {"fr", "de", None}
    assert tuple(enrich.tallies(f.docs).first()) == (2, 1, 1)
    results = spark.createDataFrame([(1, 2, 3), (10, 20, 30)], "added long, modified long, duration_ms long")
    assert tuple(enrich.stage_totals(results).first()) == (11, 22, 33)


def test_json_exports_are_valid(spark):
    f = frames(spark, [("a.md", MAKERS["markdown"][1](1, "ASIA", NATIONS))])
    text = export.export(f, "json").collect()[0]["text"]
    assert validate.json_problems(text) == [] and len(json.loads(text)["tables"][0]["cells"]) == 10
    assert validate.json_problems("{") and validate.json_problems("{}")
    assert {r["doc"] for r in chunking.chunks_json(chunking.chunks(f)).collect()} == {r["doc"] for r in f.docs.collect()}


def test_sections_references_and_formats(spark):
    f = frames(spark, [("a.tex", rb"\begin{document}\section{One}Body \ref{e}.\subsection{In}inner\section{Two}last\begin{equation}x\label{e}\end{equation}\end{document}")])
    inside = sequence.section_text(f.elements, F.col("text") == "One").filter("cls = 'Paragraph'").collect()
    assert [r["text"] for r in sorted(inside, key=lambda r: r["ord"])][-1] == "inner"
    refs = tables.resolve_references(f.elements).collect()
    formula = f.elements.filter("cls = 'Formula'").first()["el"]
    assert [r["refers_to"] for r in refs] == [formula]
    assert detect.formats(spark).filter("supported").count() == 13
    assert detect.file_info(spark.createDataFrame([("a.md", bytearray(b"x"))], "name string, content binary")).first()["format"] == "markdown"


def test_stored_tables_are_pruned(spark):
    rows = stored(spark.createDataFrame([(1, "a"), (2, "b")], "x int, kind string"), "kind")
    assert rows.filter("kind = 'a'").count() == 1 and rows.columns == ["x", "kind"]
    assert shared_dir(spark)


def test_pdf_with_object_streams_and_tounicode():
    import zlib

    from lectern.sources import pdf

    codes = {c: 0x100 + i for i, c in enumerate(sorted(set("Größe und Maß: ΑΒΓ")))}
    table = b"1 begincodespacerange <0000> <FFFF> endcodespacerange\n%d beginbfchar\n" % len(codes)
    table += b"".join(b"<%04X> <%s>\n" % (n, c.encode("utf-16-be").hex().encode()) for c, n in codes.items()) + b"endbfchar\n"
    table += b"1 beginbfrange <0041> <0043> <0061> endbfrange"
    coded = lambda t: "".join(f"{codes[c]:04X}" for c in t).encode()
    content = b"BT /F1 10 Tf <%s> Tj 0 -30 Td [<%s> -300 <00410042>] TJ ET" % (coded("Größe und Maß: ΑΒΓ"), coded("und"))
    inner = [
        (1, b"<</Type /Catalog /Pages 2 0 R>>"), (2, b"<</Type /Pages /Kids [3 0 R] /Count 1>>"),
        (3, b"<</Type /Page /MediaBox [0 0 100 200] /Contents 6 0 R /Resources <</Font <</F1 4 0 R>>>>>>"), (4, b"<</Type /Font /ToUnicode 5 0 R>>"),
    ]
    heads, at = [], 0
    for n, body in inner:
        heads += [b"%d %d" % (n, at)]
        at += len(body) + 1
    head = b" ".join(heads) + b" "
    packed = zlib.compress(head + b" ".join(x for _, x in inner))
    stream = lambda n, keys, raw: b"%d 0 obj <<%s /Length %d /Filter /FlateDecode>> stream\n" % (n, keys, len(raw)) + raw + b"\nendstream endobj\n"
    data = b"%PDF-1.5\n" + stream(5, b"", zlib.compress(table)) + stream(6, b"", zlib.compress(content))
    data += stream(7, b"/Type /ObjStm /N 4 /First %d" % len(head), packed)
    rows = pdf.parse("a.pdf", data)
    assert [r["text"] for r in rows if r["kind"] == "element"] == ["Größe und Maß: ΑΒΓ", "und ab"]
    assert [(r["width"], r["height"]) for r in rows if r["kind"] == "page"] == [(100.0, 200.0)]


def test_http_routes(spark, tmp_path):
    import threading
    import urllib.error
    import urllib.request

    from lectern.engine import Engine
    from lectern.server import server

    (tmp_path / "a.md").write_bytes(MAKERS["markdown"][1](1, "ASIA", NATIONS))
    made = server(Engine(spark))
    threading.Thread(target=made.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{made.server_port}"

    def call(path, body=None):
        request = urllib.request.Request(base + path, None if body is None else json.dumps(body).encode())
        try:
            with urllib.request.urlopen(request, timeout=60) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    assert call("/health") == (200, {"status": "ok", "documents": 0}) and call("/documents") == (200, [])
    status, answer = call("/convert", {"source": str(tmp_path), "preset": "simple"})
    assert status == 201 and answer["documents"] == 1
    key = answer["id"]
    assert call(f"/documents/{key}")[1]["documents"][0]["file_name"] == "a.md" and len(call("/documents")[1]) == 1
    assert call(f"/documents/{key}/export?format=markdown")[1][0]["text"].startswith("# ASIA")
    assert call(f"/documents/{key}/query", {"sparql": "SELECT ?t { ?e a :SectionHeader ; :textContent ?t }"}) == (200, [{"t": "ASIA"}])
    assert [r["text"] for r in call(f"/documents/{key}/elements?type=ListItem&limit=2&offset=1")[1]] == ["Nation 1", "Nation 2"]
    assert call(f"/documents/{key}/chunks?max_tokens=64")[1][0]["text"] == "ASIA"
    assert call("/documents/none/chunks")[0] == 404 and call("/nowhere")[0] == 404
    assert call(f"/documents/{key}/export?format=pdf")[0] == 400 and call(f"/documents/{key}/query", {"sparql": "SELECT"})[0] == 400
    assert call("/convert", {})[0] == 400 and len(call("/tools")[1]) == 7
    made.shutdown()


def onnx_double():
    """A model that adds its input to itself, written by hand: field numbers of the format's own description."""

    def field(number, value):
        if isinstance(value, int):
            return bytes([number << 3]) + (bytes([value]) if value < 128 else bytes([value & 127 | 128, value >> 7]))
        value = value.encode() if isinstance(value, str) else value
        return bytes([number << 3 | 2, len(value)]) + value

    tensor = lambda name: field(1, name) + field(2, field(1, field(1, 1) + field(2, field(1, field(2, "n")) + field(1, field(1, 3)))))
    node = field(1, "x") + field(1, "x") + field(2, "y") + field(4, "Add")
    graph = field(1, node) + field(2, "g") + field(11, tensor("x")) + field(12, tensor("y"))
    return field(1, 8) + field(7, graph) + field(8, field(2, 13))


def test_models(spark, tmp_path):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from lectern import models

    (tmp_path / "ocr.onnx").write_bytes(onnx_double())
    (tmp_path / "other.onnx").write_bytes(b"")
    registry = models.Registry()
    assert registry.scan(str(tmp_path)) == ["ocr"]
    with pytest.raises(KeyError):
        registry.path("vlm")
    with pytest.raises(ValueError):
        registry.register("cooking", "x")
    rows = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, None), (3, [0.5, 0.0, -1.0])], "k int, image array<float>")
    with open(registry.path("ocr"), "rb") as f:
        out = models.infer(rows, f.read(), "image", (3,)).collect()
    assert {r["k"]: r["output"] for r in out} == {1: [2.0, 4.0, 6.0], 2: None, 3: [1.0, 0.0, -2.0]}

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(500 if "fail" in asked["said"] else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"answer": asked["said"] + "!"}).encode())

        def log_message(self, *args):
            pass

    web = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    f = frames(spark, [("a.md", b"# H\n\none\n\nfail\n")])
    ask = models.described(f"http://127.0.0.1:{web.server_port}", lambda r: {"said": r["text"]}, lambda a: a["answer"])
    stage = models.text_stage(lambda f: f.elements.filter("cls = 'Paragraph'").select("el", "text"), ask)
    texts = {r["text"] for r in enrich.enrich(f, "vlm", {"vlm": stage}).elements.collect()}
    assert texts == {"H", "one!", "fail"}
    web.shutdown()
