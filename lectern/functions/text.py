"""Scalar functions as Column expressions; Python only where Spark has no expression for them."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lectern.schema import DOC, NS
from lectern.sources.base import PICTURES


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# identifiers


def content_hash(content: str | Column) -> Column:
    return F.sha2(col(content), 256)


def doc_iri(content: str | Column) -> Column:
    return F.concat(F.lit(DOC), content_hash(content))


def element_iri(doc: str | Column, local: str | Column) -> Column:
    return F.concat(col(doc), F.lit("/"), col(local))


def class_iri(name: str | Column) -> Column:
    return F.concat(F.lit(NS), col(name))


def local_name(iri: str | Column) -> Column:
    """What follows the last # or /."""
    return F.regexp_extract(col(iri), r"([^#/]*)$", 1)


def iri_escape(iri: str | Column) -> Column:
    """Percent-encode every byte but ASCII letters, digits and ``-._~:@!$&'()*+,;=/?#``.

    Form encoding differs in what it leaves alone, so its escapes of the other safe signs are taken back.
    """
    out = F.regexp_replace(F.url_encode(col(iri)), r"\+", "%20")
    for sign in "~:@!$&'()+,;=/?#":
        out = F.replace(out, F.lit(f"%{ord(sign):02X}"), F.lit(sign))
    return out


def parse_int(text: str | Column) -> Column:
    return F.coalesce(F.expr(f"try_cast(`{text}` as bigint)") if isinstance(text, str) else text.try_cast("bigint"), F.lit(0))


def parse_bool(text: str | Column) -> Column:
    return F.coalesce(col(text).isin("true", "1"), F.lit(False))


def parse_literal(term: str | Column) -> Column:
    """(value, datatype) of a serialized typed literal; anything else is its own value."""
    t = col(term)
    typed = F.regexp_extract(t, r'^"(.*)"\^\^<(?:[^>]*#)?([^>]*)>$', 1)
    hit = t.rlike(r'^"(?s:.*)"\^\^<[^>]*>$')
    return F.struct(F.when(hit, typed).otherwise(t).alias("value"), F.when(hit, F.regexp_extract(t, r'\^\^<(?:[^>]*#)?([^>]*)>$', 1)).alias("datatype"))


# text


#: Blocks of combining marks.
MARKS = [(0x300, 0x36F), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0xFE20, 0xFE2F)]


def _by_text(f: Callable[[str], str], text: str | Column) -> Column:
    """``f`` over all texts but ASCII ones; the function is made on use, for workers import this module too."""

    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: t if t is None or t.isascii() else f(t))

    return pandas_udf(run, "string")(col(text))


def ascii_fold(text: str | Column) -> Column:
    """Compatibility decomposition without combining marks."""
    drop = {c: None for a, b in MARKS for c in range(a, b + 1)}
    return _by_text(lambda t: unicodedata.normalize("NFKD", t).translate(drop), text)


def normalize_text(text: str | Column) -> Column:
    """Composed form, runs of white space as one space."""
    return F.trim(F.regexp_replace(_by_text(lambda t: unicodedata.normalize("NFC", t), text), r"\s+", " "))


def estimate_tokens(text: str | Column, chars_per_token: float = 4.0) -> Column:
    """Bytes over bytes per token, rounded up; a rate of zero or less counts bytes."""
    size = F.octet_length(col(text))
    return size.cast("long") if chars_per_token <= 0 else F.ceil(size / F.lit(chars_per_token)).cast("long")


def contextualize(headings: str | Column, text: str | Column) -> Column:
    """Headings as lines of rising depth before the text."""
    lines = F.array_join(F.transform(col(headings), lambda h, i: F.concat(F.repeat(F.lit("#"), i + 1), F.lit(" "), h, F.lit("\n"))), "")
    return F.when(F.size(col(headings)) > 0, F.concat(lines, F.lit("\n"), col(text))).otherwise(col(text))


def paragraphs(text: str | Column) -> Column:
    """Blocks between blank lines, lines trimmed and joined by spaces."""
    block = lambda b: F.array_join(F.filter(F.transform(F.split(b, "\n"), lambda x: F.trim(x)), lambda x: x != ""), " ")
    return F.filter(F.transform(F.split(F.regexp_replace(col(text), r"\n[ \t]*\n|\n(?=[ \t]{4,}\S)", "\n\n"), "\n\n"), block), lambda x: x != "")


def numbered_heading_level(text: str | Column) -> Column:
    """Digit groups of a numbered heading, 6 at most; null if it is none."""
    t = F.trim(col(text))
    number = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)*\.?)[ \t]+\S", 1)
    rest = F.regexp_replace(t, r"^[0-9.]+[ \t]+", "")
    ok = number.contains(".") & (F.octet_length(rest) <= 100)
    return F.when(ok, F.least(F.size(F.filter(F.split(number, r"\."), lambda x: x != "")), F.lit(6)))


def is_all_caps(text: str | Column) -> Column:
    letters = F.regexp_replace(col(text), r"[^\p{L}]", "")
    return (F.length(letters) >= 2) & ~letters.rlike(r"[^\p{Lu}]")


def is_short_heading(text: str | Column, on_page: str | Column) -> Column:
    t = col(text)
    return (col(on_page) >= 3) & (F.octet_length(t) < 60) & ~t.rlike(r"[.,;:]$") & (F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")) <= 8) & t.rlike(r"^\p{Lu}")


def heading_level(text: str | Column, on_page: str | Column) -> Column:
    caps = is_all_caps(text) & (F.octet_length(col(text)) < 80)
    return F.coalesce(numbered_heading_level(text), F.when(caps, 1), F.when(is_short_heading(text, on_page), 2))


def font_heading_level(size: str | Column, body: str | Column) -> Column:
    ratio = col(size) / col(body)
    levels = F.when(ratio >= 2.0, 1).when(ratio >= 1.6, 2).when(ratio >= 1.4, 3).when(ratio >= 1.3, 4).when(ratio >= 1.2, 5).otherwise(6)
    return F.when(col(body) <= 0, 2).otherwise(levels)


def pdf_date(text: str | Column) -> Column:
    return F.regexp_replace(col(text), r"^D:(\d{4})(\d{2})(\d{2}).*$", "$1-$2-$3")


def build_date(year: str | Column, month: str | Column, day: str | Column) -> Column:
    m = col(month)
    return F.concat_ws("-", col(year), F.lpad(m, 2, "0"), F.when(m.isNotNull(), F.lpad(col(day), 2, "0")))


def strip_tags(text: str | Column) -> Column:
    return F.regexp_replace(col(text), r"<[^>]*>?", "")


def strip_ties(text: str | Column) -> Column:
    return F.replace(col(text), F.lit("~"), F.lit(" "))


def escape_html(text: str | Column) -> Column:
    out = col(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def escape_doctag(text: str | Column) -> Column:
    return F.replace(F.replace(col(text), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def image_format(link: str | Column) -> Column:
    ext = F.lower(F.regexp_extract(F.regexp_extract(col(link), r"^([^?#]*)", 1), r"\.([^.]*)$", 1))
    return F.when(ext.isin(*PICTURES), ext)


def tabular_rows(body: str | Column) -> Column:
    """LaTeX table body: rows of trimmed cells."""
    rows = F.split(F.replace(col(body), F.lit("\\hline"), F.lit("")), r"\\\\")
    return F.transform(F.filter(rows, lambda r: F.trim(r) != ""), lambda r: F.transform(F.split(r, "&"), lambda x: F.trim(x)))


def bar_cells(line: str | Column) -> Column:
    """AsciiDoc table line: cells after the first bar; empty ones only if the line ends with a bar."""
    cells = F.transform(F.slice(F.split(col(line), r"\|"), 2, 1 << 20), lambda x: F.trim(x))
    return F.when(F.rtrim(col(line)).endswith("|"), cells).otherwise(F.filter(cells, lambda c: c != ""))


# times


def timestamp(seconds: str | Column) -> Column:
    """HH:MM:SS.mmm of seconds, rounded to milliseconds."""
    ms = F.round(col(seconds) * 1000).cast("long")
    part = lambda div, mod: (F.expr("1L") * F.floor(ms / div) % mod).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000).cast("long"), part(60000, 60), part(1000, 60), (ms % 1000).cast("long"))


def duration_seconds(text: str | Column) -> Column:
    """Seconds of an ISO duration PTnHnMnS, of clock time, or of a plain number."""
    t = col(text)
    number = lambda unit: F.coalesce(F.regexp_extract(t, rf"([\d.]+){unit}", 1).try_cast("double"), F.lit(0.0))
    parts = F.reverse(F.split(t, ":"))
    clock = sum((F.coalesce(F.get(parts, F.lit(i)).try_cast("double"), F.lit(0.0)) * w for i, w in ((0, 1), (1, 60), (2, 3600))), F.lit(0.0))
    return F.when(t.startswith("PT"), number("H") * 3600 + number("M") * 60 + number("S")).when(t.contains(":"), clock).otherwise(t.try_cast("double"))


def format_timestamp(text: str | Column) -> Column:
    return F.when(col(text).contains(":"), col(text)).otherwise(timestamp(duration_seconds(text)))


def is_timestamp(text: str | Column) -> Column:
    return col(text).rlike(r"^(\d+:)?\d{1,2}:\d{2}\.\d{1,3}$")


# boxes and images


def iou(a: str, b: str) -> Column:
    """Overlap of two box structs over their union."""
    x, y = F.col(a), F.col(b)
    wide = F.greatest(F.lit(0.0), F.least(x["right"], y["right"]) - F.greatest(x["left"], y["left"]))
    high = F.greatest(F.lit(0.0), F.least(x["bottom"], y["bottom"]) - F.greatest(x["top"], y["top"]))
    area = lambda r: (r["right"] - r["left"]) * (r["bottom"] - r["top"])
    union = area(x) + area(y) - wide * high
    return F.when(union > 0, wide * high / union).otherwise(F.lit(0.0)).cast("float")


REGION_CLASSES = {"title": "Title", "section_header": "SectionHeader", "text": "Paragraph", "paragraph": "Paragraph", "list_item": "ListItem", "list": "UnorderedList", "table": "TableElement", "picture": "PictureElement", "figure": "PictureElement", "code": "Code", "formula": "Formula", "caption": "Caption", "footnote": "Footnote", "page_header": "PageHeader", "page_footer": "PageFooter"}


def region_class(label: str | Column) -> Column:
    key = F.replace(F.replace(F.lower(col(label)), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))
    table = F.create_map(*(F.lit(x) for pair in REGION_CLASSES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, key), F.lit("Paragraph"))


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, corners aligned; image: height x width x channels."""
    h, w = image.shape[:2]
    ys = np.linspace(0, h - 1, height) if height > 1 else np.zeros(1)
    xs = np.linspace(0, w - 1, width) if width > 1 else np.zeros(1)
    y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (ys - y0)[:, None, None], (xs - x0)[None, :, None]
    im = image.astype(np.float32)
    top = im[y0][:, x0] * (1 - fx) + im[y0][:, x1] * fx
    low = im[y1][:, x0] * (1 - fx) + im[y1][:, x1] * fx
    return top * (1 - fy) + low * fy


def tensor(image: np.ndarray, mean: tuple = (0.485, 0.456, 0.406), std: tuple = (0.229, 0.224, 0.225)) -> np.ndarray:
    """Channels first, scaled to 0..1 and normalised."""
    return ((image.astype(np.float32) / 255 - np.array(mean, np.float32)) / np.array(std, np.float32)).transpose(2, 0, 1)


def vision_request(model: str, prompt: Column | str, image: Column | str, max_tokens: int = 4096) -> Column:
    """JSON body of a chat request with one image."""
    url = F.concat(F.lit("data:image/png;base64,"), F.base64(col(image)))
    content = F.to_json(F.array(F.struct(F.lit("text").alias("type"), col(prompt).alias("text"), F.lit(None).cast("struct<url:string>").alias("image_url")), F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), F.struct(url.alias("url")).alias("image_url"))))
    return F.concat(F.lit(f'{{"model":"{model}","max_tokens":{max_tokens},"messages":[{{"role":"user","content":'), content, F.lit("}]}"))


def vision_response(body: Column | str) -> Column:
    """(text of the first choice, completion tokens or 0)."""
    b = col(body)
    return F.struct(F.get_json_object(b, "$.choices[0].message.content").alias("text"), F.coalesce(F.get_json_object(b, "$.usage.completion_tokens").cast("long"), F.lit(0)).alias("tokens"))
