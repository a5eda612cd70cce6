"""Documents of every format, made from the tables, and what the readers make of them.

Each region is a document: its name is a heading, its nations are list items or paragraphs, and a table lists them.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import enrich
from lectern.plans.quads import QuadStore, to_quads
from lectern.plans.registry import register, table
from lectern.sources.reader import DocFrames, convert

Nations = list[tuple[int, str]]


def archive(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            # without the time of day, for equal parts are to be equal bytes
            z.writestr(zipfile.ZipInfo(name), body, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def relations(**targets: tuple[str, str]) -> str:
    made = "".join(f'<Relationship Id="{k}" Type="http://x/{kind}" Target="{to}"/>' for k, (kind, to) in targets.items())
    return f'<Relationships xmlns="http://x/rels">{made}</Relationships>'


def markdown(key: int, name: str, nations: Nations) -> bytes:
    rows = "".join(f"| {k} | {n} |\n" for k, n in nations)
    return f"# {name}\n\n{''.join(f'- {n}{chr(10)}' for _, n in nations)}\n| key | name |\n|---|---|\n{rows}".encode()


def html(key: int, name: str, nations: Nations) -> bytes:
    items = "".join(f"<li>{n}" for _, n in nations)
    rows = "".join(f"<tr><td>{k}<td>{n}" for k, n in nations)
    deep = "<div>" * 1500
    return f"<html><body>{deep}<h1>{name}</h1><ul>{items}</ul><table><tr><th>key<th>name{rows}</table></body></html>".encode()


def asciidoc(key: int, name: str, nations: Nations) -> bytes:
    items = "".join(f"* {n}\n" for _, n in nations)
    rows = "".join(f"|{k} |{n}\n" for k, n in nations)
    return f"== {name}\n\n{items}\n|===\n|key |name\n{rows}|===\n".encode()


def latex(key: int, name: str, nations: Nations) -> bytes:
    items = "".join(rf"\item {n} " for _, n in nations)
    rows = "".join(rf"{k} & {n} \\ " for k, n in nations)
    body = rf"\section{{{name}}} \begin{{itemize}}{items}\end{{itemize}} \begin{{tabular}}{{ll}}key & name \\ {rows}\end{{tabular}}"
    return rf"\documentclass{{article}} \begin{{document}} {body} \end{{document}}".encode()


def jats(key: int, name: str, nations: Nations) -> bytes:
    items = "".join(f"<list-item><p>{n}</p></list-item>" for _, n in nations)
    rows = "".join(f"<tr><td>{k}</td><td>{n}</td></tr>" for k, n in nations)
    cells = f"<table><thead><tr><th>key</th><th>name</th></tr></thead><tbody>{rows}</tbody></table>"
    body = f"<sec><title>{name}</title><list list-type='bullet'>{items}</list><table-wrap>{cells}</table-wrap></sec>"
    return f"<?xml version='1.0'?><article><body>{body}</body></article>".encode()


def uspto(key: int, name: str, nations: Nations) -> bytes:
    said = "".join(f"<p>{n}</p>" for _, n in nations)
    rows = "".join(f"<row><entry>{k}</entry><entry>{n}</entry></row>" for k, n in nations)
    cells = f"<tables><table><thead><row><entry>key</entry><entry>name</entry></row></thead>{rows}</table></tables>"
    inside = f"<description><heading level='1'>{name}</heading>{said}{cells}</description>"
    return f"<?xml version='1.0'?><us-patent-grant>{inside}</us-patent-grant>".encode()


def generic_xml(key: int, name: str, nations: Nations) -> bytes:
    return f"<?xml version='1.0'?><region><name>{name}</name>{''.join(f'<nation>{n}</nation>' for _, n in nations)}</region>".encode()


def webvtt(key: int, name: str, nations: Nations) -> bytes:
    cues = "".join(f"\n{k}\n00:{i:02d}.000 --> 00:{i + 1:02d}.500\n<v {name}>{n}\n" for i, (k, n) in enumerate(nations))
    return f"WEBVTT\n\nNOTE {name}\n{cues}".encode()


def doctags(key: int, name: str, nations: Nations) -> bytes:
    items = "".join(f"<list_item>{n}</list_item>" for _, n in nations)
    rows = "".join(f"<fcel>{k}<fcel>{n}<nl>" for k, n in nations)
    head = f"<section_header_level_1>{name}</section_header_level_1>"
    return f"<doctag><page>{head}{items}<otsl><ched>key<ched>name<nl>{rows}</otsl></page></doctag>".encode()


def csv(key: int, name: str, nations: Nations) -> bytes:
    return ("key;name\n" + "".join(f'{k};"{n}"\n' for k, n in nations)).encode()


def xlsx(key: int, name: str, nations: Nations) -> bytes:
    head = '<row r="3"><c r="B3" t="inlineStr"><is><t>key</t></is></c><c r="C3" t="s"><v>0</v></c></row>'
    rows = "".join(f'<row r="{i}"><c r="B{i}"><v>{k}</v></c><c r="C{i}" t="inlineStr"><is><t>{n}</t></is></c></row>' for i, (k, n) in enumerate(nations, 4))
    return archive({
        "xl/workbook.xml": f'<workbook xmlns:r="http://x/r"><sheets><sheet name="{name}" sheetId="1" r:id="a"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": relations(a=("worksheet", "worksheets/sheet1.xml")),
        "xl/sharedStrings.xml": "<sst><si><t>name</t></si></sst>",
        "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{head}{rows}</sheetData></worksheet>",
    })


def docx(key: int, name: str, nations: Nations) -> bytes:
    para = lambda text, props: f'<w:p><w:pPr>{props}</w:pPr><w:r><w:t xml:space="preserve">{text}</w:t></w:r></w:p>'
    bullet = '<w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr>'
    cell = lambda text: f"<w:tc>{para(text, '')}</w:tc>"
    rows = "".join(f"<w:tr>{cell(a)}{cell(b)}</w:tr>" for a, b in [("key", "name"), *nations])
    body = para(name, '<w:pStyle w:val="H1"/>') + "".join(para(n, bullet) for _, n in nations) + f"<w:tbl>{rows}</w:tbl>"
    space = 'xmlns:w="http://x/w"'
    level = '<w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/></w:lvl>'
    return archive({
        "word/document.xml": f"<w:document {space}><w:body>{body}</w:body></w:document>",
        "word/styles.xml": f'<w:styles {space}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>',
        "word/numbering.xml": f'<w:numbering {space}><w:abstractNum w:abstractNumId="7">{level}</w:abstractNum>'
        '<w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num></w:numbering>',
    })


def pptx(key: int, name: str, nations: Nations) -> bytes:
    para = lambda text: f"<a:p><a:r><a:t>{text}</a:t></a:r></a:p>"
    shape = lambda kind, body: f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:txBody>{body}</p:txBody></p:sp>'
    cell = lambda text: f"<a:tc><a:txBody>{para(text)}</a:txBody></a:tc>"
    rows = "".join(f"<a:tr>{cell(a)}{cell(b)}</a:tr>" for a, b in [("key", "name"), *nations])
    shapes = shape("title", para(name)) + shape("body", "".join(para(n) for _, n in nations)) + f"<p:graphicFrame><a:tbl>{rows}</a:tbl></p:graphicFrame>"
    space = 'xmlns:p="http://x/p" xmlns:a="http://x/a" xmlns:r="http://x/r"'
    return archive({
        "ppt/presentation.xml": f'<p:presentation {space}><p:sldIdLst><p:sldId id="256" r:id="a"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": relations(a=("slide", "slides/slide1.xml")),
        "ppt/slides/slide1.xml": f"<p:sld {space}><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>",
    })


def pdf(key: int, name: str, nations: Nations) -> bytes:
    lines = [name, *(f"the nation of {n.lower()}." for _, n in nations)]
    shown = "\n".join(f"0 -30 Td ({x}) Tj" for x in lines)
    data = zlib.compress(f"BT /F1 12 Tf {shown} ET".encode())
    head = f"1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj 2 0 obj <</Type /Pages /Kids [3 0 R] /Count 1>> endobj 3 0 obj <</Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents 4 0 R>> endobj 4 0 obj <</Length {len(data)} /Filter /FlateDecode>> stream\n"
    return b"%PDF-1.4\n" + head.encode() + data + b"\nendstream endobj trailer <</Root 1 0 R>>\n%%EOF"


def image(key: int, name: str, nations: Nations) -> bytes:
    """A header of a format that goes by the region's key; as wide as the key says, as high as it has nations."""
    w, h = 100 + key, 10 + len(nations)
    return [
        b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", w, h),
        b"GIF89a" + struct.pack("<HH", w, h),
        b"BM" + bytes(16) + struct.pack("<ii", w, -h),
        b"\xff\xd8\xff\xe0\x00\x04\x00\x00\xff\xc0\x00\x11\x08" + struct.pack(">HH", h, w) + bytes(4),
        b"II*\0" + struct.pack("<IHHHIIHHII", 8, 2, 256, 4, 1, w, 257, 4, 1, h),
    ][key % 5]


MAKERS: dict[str, tuple[str, Callable[[int, str, Nations], bytes]]] = {
    "markdown": ("md", markdown), "html": ("html", html), "asciidoc": ("adoc", asciidoc), "latex": ("tex", latex),
    "jats": ("nxml", jats), "uspto": ("xml", uspto), "generic_xml": ("xml", generic_xml), "webvtt": ("vtt", webvtt),
    "doctags": ("dt", doctags), "csv": ("csv", csv), "xlsx": ("xlsx", xlsx), "docx": ("docx", docx), "pptx": ("pptx", pptx),
    "pdf": ("pdf", pdf), "image": ("png", image),
}


def region_documents(spark, d, kind: str) -> DataFrame:
    """(name, content): the regions as files of a format, at most as many as there are regions."""
    ending, make = MAKERS[kind]
    own = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("nations")
    nations = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(own)
    rows = table(spark, d, "region").join(nations, "r_regionkey").select("r_regionkey", "r_name", "nations")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(f"{r['r_regionkey']}.{ending}", make(r["r_regionkey"], r["r_name"], [tuple(x.values()) for x in r["nations"]])) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in made], t) for i, t in enumerate((pa.string(), pa.binary()))], ["name", "content"])

    return rows.mapInArrow(run, "name string, content binary")


def region_frames(spark, d, kind: str) -> DocFrames:
    return convert(region_documents(spark, d, kind), store=True)


def read(kind: str) -> Callable:
    """(region, what, a, b, text): elements with order and level (-1: none), cells with row and column."""

    def run(spark, d):
        f = region_frames(spark, d, kind)
        docs = f.docs.select("doc", F.substring_index("file_name", ".", 1).cast("int").alias("region"))
        level = F.coalesce("level", F.lit(-1)).alias("b")
        elements = f.elements.select("doc", F.col("cls").alias("what"), F.col("ord").cast("int").alias("a"), level, "text")
        head = F.when(F.coalesce("is_header", F.lit(False)), "head").otherwise("cell").alias("what")
        cells = f.cells.select("doc", head, F.col("row").alias("a"), F.col("col").alias("b"), "text")
        return docs.join(elements.unionByName(cells), "doc").drop("doc")

    run.__name__ = f"read_{kind}"
    return run


NATIONS = """n as (select n_regionkey as region, n_nationkey as k, n_name as name, (row_number() over w - 1)::int as i,
    count(*) over (partition by n_regionkey)::int as n from nation window w as (partition by n_regionkey order by n_nationkey))"""


def expected(before: list[str] = (), head: tuple[str, str] | None = ("SectionHeader", "1"), group: str | None = "UnorderedList", item: str | None = "ListItem", said: str = "name", cells: str | None = "head", title: str = "null") -> str:
    """The rows of ``read``: elements ``before``, a heading, a list, its items, and a table whose first row is of kind ``cells``."""
    rows, at = [], 0
    one = "select r_regionkey::int as region, '{}' as what, {} as a, {}::int as b, {}::varchar as text from region"
    for what in before:
        rows.append(one.format(what, at, -1, "null"))
        at += 1
    if head:
        rows.append(one.format(head[0], at, head[1], "r_name"))
        at += 1
    if group:
        rows.append(one.format(group, at, -1, "null"))
        at += 1
    if item:
        rows.append(f"select region::int as region, '{item}' as what, {at} + i as a, -1 as b, {said} as text from n")
    if cells:
        end = f"{at} + (select max(n.n) from n where n.region = r_regionkey)" if item else at
        rows.append(one.format("TableElement", end, -1, title))
        rows.append(f"select r_regionkey, '{cells}', 0, unnest([0, 1]), unnest(['key', 'name']) from region")
        rows.append("select region, 'cell', i + 1, unnest([0, 1]), unnest([k::varchar, name]) from n")
    return f"with {NATIONS} {' union all '.join(rows)}"


GENERIC = f"""with {NATIONS}
select r_regionkey::int as region, 'Group' as what, unnest([0, 1])::int as a, -1 as b, null::varchar as text from region
union all select r_regionkey, 'Paragraph', 2, -1, r_name from region
union all select region, 'Group', 3 + 2 * i, -1, null from n
union all select region, 'Paragraph', 4 + 2 * i, -1, name from n"""

for kind, sql in {
    "markdown": expected(),
    "html": expected(),
    "asciidoc": expected(),
    "latex": expected(),
    "jats": expected(["Group"]),
    "uspto": expected(["Group"], group=None, item="Paragraph"),
    "generic_xml": GENERIC,
    "webvtt": expected(head=None, group=None, item="Paragraph", cells=None),
    "doctags": expected(group=None),
    "csv": expected(head=None, group=None, item=None),
    "xlsx": expected(head=None, group=None, item=None, title="r_name"),
    "docx": expected(cells="cell"),
    "pptx": expected(group=None, item="Paragraph"),
    "pdf": expected(group=None, item="Paragraph", said="'the nation of ' || lower(name) || '.'", cells=None),
}.items():
    register(sql)(read(kind))


@register(f"with {NATIONS} select r_regionkey::int as region, ['png', 'gif', 'bmp', 'jpeg', 'tiff'][r_regionkey % 5 + 1] as format, (100 + r_regionkey)::int as width, (10 + (select max(n.n) from n where n.region = r_regionkey))::int as height from region")
def read_image(spark, d):
    f = region_frames(spark, d, "image")
    docs = f.docs.select("doc", F.substring_index("file_name", ".", 1).cast("int").alias("region"))
    return docs.join(f.elements, "doc").select("region", F.col("pic_format").alias("format"), F.col("img_w").alias("width"), F.col("img_h").alias("height"))


@register(f"with {NATIONS} select r_regionkey::int as region, 'x' || printf('%02d', i) as at, n.name as text from n join region on region = r_regionkey")
def webvtt_times(spark, d):
    f = region_frames(spark, d, "webvtt")
    docs = f.docs.select("doc", F.substring_index("file_name", ".", 1).cast("int").alias("region"))
    return docs.join(f.elements, "doc").select("region", F.concat(F.lit("x"), F.substring("start_time", 4, 2)).alias("at"), "text")


@register("select n, case n when 'zip' then 'docx' when 'sheet' then 'xlsx' when 'deck' then 'pptx' when 'none' then null end as format from (values ('zip'), ('sheet'), ('deck'), ('none')) t(n)")
def detect_archives(spark, d):
    from lectern.sources import detect

    made = [("zip", docx(1, "A", [])), ("sheet", xlsx(1, "A", [])), ("deck", pptx(1, "A", [])), ("none", archive({"a.txt": "x"}))]
    files = spark.createDataFrame([(n, bytearray(b)) for n, b in made], "name string, content binary")
    return files.select(F.col("name").alias("n"), detect.detected("name", "content", "stream").alias("format"))
