"""Readers, chunks, exports and sequence operators on small documents."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.engine import Engine
from lectern.operators import chunking, sequence, validate
from lectern.plans import export
from lectern.plans.quads import to_quads
from lectern.plans.sparql import query
from lectern.sources.reader import convert

SAMPLES = {
    "a.md": "# Title\n\nSome *text* here\nsecond line.\n\n## Part\n\n- one\n- two\n\n```python\nx = 1\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n> said\n\n1. x\n2. y\n",
    "b.html": "<html lang='en'><head><title>T</title></head><body><h1>Top</h1><p>Hello <a href='x.html'>link</a></p><ul><li>one</li><li>two</li></ul><table><tr><th>h</th></tr><tr><td>v</td></tr></table></body></html>",
    "c.csv": "name,age\nAnn,3\n\"Bo, Jr\",\n",
    "d.vtt": "WEBVTT\n\nNOTE x\n\n1\n00:01.000 --> 00:02.500\nHi <b>there</b>\n\n00:00:03.000 --> 00:00:04.000\nBye\n",
    "e.adoc": "= Doc\n\nIntro.\n\n== Sec\n\n* a\n* b\n\n[source,rust]\n----\nfn main() {}\n----\n\n|===\n|h1 |h2\n|1 |2\n|===\n",
    "f.tex": "\\documentclass{article}\n\\title{Tt}\n\\begin{document}\n\\section{One}\nBody text.\n\\begin{itemize}\n\\item a\n\\item b\n\\end{itemize}\n\\begin{equation}x=1\\label{e}\\end{equation}\nSee \\ref{e}.\n\\end{document}\n",
    "g.xml": "<?xml version='1.0'?><article><front><article-meta><title-group><article-title>Jt</article-title></title-group></article-meta></front><body><sec><title>S</title><p>Para.</p></sec></body></article>",
    "h.dt": "<doctag><page><section_header_level_1>Head</section_header_level_1><text>Words</text></page></doctag>",
}


@pytest.fixture(scope="module")
def frames(spark):
    rows = [(n, bytearray(t.encode())) for n, t in SAMPLES.items()] + [("bad.zzz", bytearray(b"\x00\x01")), ("bad.docx", bytearray(b"PK\x03\x04 no zip")), ("empty.md", bytearray())]
    return convert(spark.createDataFrame(rows, "name string, content binary"), store=True)


def test_every_format_is_read(frames):
    docs = {r["file_name"]: r for r in frames.docs.collect()}
    assert docs.keys() == {*SAMPLES, "bad.zzz", "bad.docx", "empty.md"}
    assert all(docs[n]["status"] == "Success" for n in SAMPLES)
    assert docs["bad.zzz"]["status"] == docs["bad.docx"]["status"] == "Failure"
    kinds = {}
    for r in frames.elements.join(frames.docs.select("doc", "file_name"), "doc").collect():
        kinds.setdefault(r["file_name"], set()).add(r["cls"])
    assert {"SectionHeader", "Paragraph", "ListItem", "Code", "TableElement"} <= kinds["a.md"]
    assert {"SectionHeader", "Paragraph", "Hyperlink", "ListItem", "TableElement"} <= kinds["b.html"]
    assert kinds["c.csv"] == {"TableElement"} and {"Paragraph"} <= kinds["d.vtt"]
    assert {"Code", "TableElement", "ListItem"} <= kinds["e.adoc"] and {"Formula", "ListItem", "SectionHeader"} <= kinds["f.tex"]
    assert {"SectionHeader", "Paragraph"} <= kinds["g.xml"] and {"SectionHeader", "Paragraph"} <= kinds["h.dt"]


def test_structure_is_valid(frames):
    assert validate.structure(frames).collect() == []


def test_exports_name_every_document(frames):
    good = frames.docs.filter("status = 'Success'").count()
    for kind in ("text", "markdown", "html", "json", "jsonld", "doctags", "webvtt"):
        rows = export.export(frames, kind).collect()
        assert len({r["doc"] for r in rows}) >= good - 1, kind


def test_quads_answer_sparql(frames):
    out = query(to_quads(frames), "SELECT ?t { ?e a :SectionHeader ; :textContent ?t }")
    said = {r["t"] for r in out.collect()}
    assert {"Part", "Top", "One", "S", "Head"} <= said


def test_chunks_keep_the_budget(frames):
    for most in (5, 20, 512):
        o = chunking.Options(max_tokens=most, overlap=2)
        rows = chunking.chunks(frames, o).collect()
        assert rows and all(o.tokens(r["text"]) <= most for r in rows)
        by_doc = {}
        for r in rows:
            by_doc.setdefault(r["doc"], []).append(r["chunk_index"])
        assert all(sorted(x) == list(range(len(x))) for x in by_doc.values())


def test_engine(spark):
    e = Engine(spark)
    key = e.convert(spark.createDataFrame([("a.md", bytearray(SAMPLES["a.md"].encode()))], "name string, content binary"), preset="simple")
    assert e.health()["documents"] == 1 and e.documents().count() == 1
    assert e.query("SELECT ?t { ?e :textContent ?t } ORDER BY ?t", key, limit=2).count() == 2
    assert e.elements(key, "SectionHeader").count() >= 1 and e.chunks(key, max_tokens=64).count() >= 1


@pytest.fixture(scope="module")
def boxes(spark):
    rng = random.Random(1)
    rows = []
    for doc in ("x", "y"):
        for k in range(40):
            left, top = rng.randrange(0, 200), rng.randrange(0, 60)
            rows.append((doc, 1 + k % 2, float(left), float(top), left + 30.0, top + 10.0, rng.random(), f"w{k}", 10.0))
    return rows, spark.createDataFrame(rows, "doc string, page int, left double, top double, right double, bottom double, confidence double, text string, font_size double")


def test_suppression_against_brute_force(boxes):
    rows, frame = boxes
    want = set()
    for doc, page in {(r[0], r[1]) for r in rows}:
        chosen = []
        for r in sorted((r for r in rows if r[:2] == (doc, page)), key=lambda r: (-r[6], r[2], r[3])):
            over = [max(0, min(r[4], s[4]) - max(r[2], s[2])) * max(0, min(r[5], s[5]) - max(r[3], s[3])) for s in chosen]
            if all(x / (600 - x) <= 0.3 for x in over):
                chosen.append(r)
        want |= {(doc, page, r[7]) for r in chosen}
    assert {(r["doc"], r["page"], r["text"]) for r in sequence.suppress(frame, 0.3).collect()} == want


def test_lines_and_bands_hold_every_word(boxes):
    rows, frame = boxes
    lines = sequence.words_to_lines(frame).collect()
    assert sum(len(r["text"].split()) for r in lines) == len(rows)
    ranked = sequence.band_order(frame).groupBy("doc", "page").agg(F.array_sort(F.collect_list("ord")).alias("o")).collect()
    assert all(r["o"] == list(range(20)) for r in ranked)
