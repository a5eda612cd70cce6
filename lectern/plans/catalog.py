"""Queries over the driver's tables, one or more for each operator of the inventory, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as T
from lectern.operators import chunking, enrich, sequence, tables, validate
from lectern.plans import export
from lectern.plans.quads import ntriples, rdfxml, to_quads, turtle
from lectern.plans.registry import ORACLES, QUERIES, register, table  # noqa: F401
from lectern.plans.sparql import ask, query
from lectern.schema import NS, XSD
from lectern.sources import detect
from lectern.sources.reader import DocFrames, convert

# sources: raw pages through the HTML reader


def page_sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit(".html")).alias("name"), F.encode("html", "UTF-8").alias("content"), F.lit("html").alias("format"))


def pages(spark: SparkSession, d: str, store: bool = True) -> DocFrames:
    """The pages, parsed once; without ``store`` for a query that uses one frame only."""
    return convert(page_sources(spark, d), store=store)


def page_id():
    """Made on use: the catalog is read without a session too."""
    return F.regexp_extract("file_name", r"(\d+)", 1).cast("long").alias("page_id")


#: Entities of the driver's pages in a piece of text, and its white space, as a reader leaves them.
def said(piece: str) -> str:
    out = piece
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


#: Elements before the heading: the title, the list, two for each of its links, and the article.
HEADINGS = f"""
select 'urn:lectern:doc:' || sha256(html) as doc, (3 + 2 * len(regexp_extract_all(split_part(html, '<article>', 1), '<li>')))::bigint as ord,
    1 as level, {said("regexp_extract(html, '<h1>(.*?)</h1>', 1)")} as text, len(regexp_extract_all(html, '<a href='))::bigint as n_links
from pages
"""


@register(HEADINGS)
def html_headings(spark, d):
    """Headings in reading order with the number of links of their page, in one pass over the parsed rows."""
    el = pages(spark, d, store=False).elements
    w = Window.partitionBy("doc")
    counted = el.filter(F.col("cls").isin("SectionHeader", "Hyperlink")).withColumn("n_links", F.count_if(F.col("cls") == "Hyperlink").over(w))
    return counted.filter("cls = 'SectionHeader'").select("doc", "ord", "level", "text", "n_links")


@register("select page_id, nullif(regexp_extract(html, '<html lang=\"([^\"]*)\"', 1), '') as language, octet_length(encode(html))::bigint as file_size, sha256(html) as document_hash from pages")
def html_title_lang(spark, d):
    docs = pages(spark, d, store=False).docs
    return docs.select(page_id(), "language", "file_size", "document_hash")


@register("select page_id, len(regexp_extract_all(html, '<li>'))::bigint as n_items, len(regexp_extract_all(html, '<a href='))::bigint as n_links, len(regexp_extract_all(html, '<h1>'))::bigint as n_headings from pages")
def html_element_counts(spark, d):
    f = pages(spark, d)
    n = lambda c: F.count_if(F.col("cls") == c)
    counts = f.elements.groupBy("doc").agg(n("ListItem").alias("n_items"), n("Hyperlink").alias("n_links"), n("SectionHeader").alias("n_headings"))
    # parsed rows and their document rows come from one scan each; equal pages share a document
    return f.docs.select("doc", page_id()).join(counts.withColumn("_copies", F.lit(1)), "doc", "left").select("page_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_items", "n_links", "n_headings")))


@register("select page_id, t.i - 1 as pos, regexp_extract(t.x, 'href=\"([^\"]*)\"', 1) as link_target from (select page_id, unnest(regexp_extract_all(html, '<a href=\"[^\"]*\"')) as x, generate_subscripts(regexp_extract_all(html, '<a href=\"[^\"]*\"'), 1) as i from pages) t")
def html_links(spark, d):
    f = pages(spark, d)
    links = f.elements.filter("cls = 'Hyperlink'")
    w = Window.partitionBy("doc").orderBy("ord")
    numbered = links.withColumn("pos", (F.row_number().over(w) - 1).cast("long")).select("doc", "pos", "link_target")
    return f.docs.select("doc", page_id()).join(numbered, "doc").select("page_id", "pos", "link_target")


@register(
    """
    with p as (select html, page_id from pages union all select html, page_id + 1000000 from pages)
    select page_id, len(regexp_extract_all(html, '<li>'))::bigint as n_items, len(regexp_extract_all(html, '<a href='))::bigint as n_links from p
    """
)
def html_copies(spark, d):
    """Every page twice, under two names: each content is parsed once and is one document with two rows."""
    p = page_sources(spark, d)
    again = F.concat(F.lit("page-"), (F.regexp_extract("name", r"(\d+)", 1).cast("long") + 1_000_000).cast("string"), F.lit(".html"))
    f = convert(p.unionByName(p.withColumn("name", again)), store=True)
    n = lambda c: F.count_if(F.col("cls") == c)
    counts = f.elements.groupBy("doc").agg(n("ListItem").alias("n_items"), n("Hyperlink").alias("n_links"))
    return f.docs.select("doc", page_id()).join(counts, "doc").select("page_id", "n_items", "n_links")


# sources: detection


@register("select page_id, case when starts_with(lower(ltrim(html)), '<!doctype html') or starts_with(lower(ltrim(html)), '<html') then 'html' when starts_with(ltrim(html), '<?xml') then 'xml' end as format, octet_length(encode(html))::bigint as size, sha256(html) as sha256 from pages")
def detect_format_pages(spark, d):
    p = table(spark, d, "pages").select("page_id", F.encode("html", "UTF-8").alias("content"), F.lit("download").alias("name"))
    return p.select("page_id", detect.detected("name", "content", "stream").alias("format"), F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


CSV_ORACLE = """
with l as (select doc_id, [x for x in list_slice(string_split(text, chr(10)), 1, 10) if trim(regexp_replace(x, '\\s', '', 'g')) <> ''] as ls from documents),
c as (select doc_id, len(ls) as n, list_distinct([length(x) - length(replace(x, ',', '')) for x in ls]) as a, list_distinct([length(x) - length(replace(x, chr(9), '')) for x in ls]) as b from l)
select doc_id, n >= 2 and ((len(a) = 1 and a[1] > 0) or (len(b) = 1 and b[1] > 0)) as csv_like from c
"""


@register(CSV_ORACLE)
def detect_csv_heuristic(spark, d):
    return table(spark, d, "documents").select("doc_id", detect.csv_like(F.col("text")).alias("csv_like"))


@register("select n_nationkey, case n_nationkey % 6 when 0 then 'markdown' when 1 then 'html' when 2 then 'docx' when 3 then 'image' when 4 then null else 'webvtt' end as by_name, case n_nationkey % 3 when 0 then 'pdf' when 1 then 'csv' else null end as by_mime from nation")
def detect_names(spark, d):
    n = table(spark, d, "nation")
    name = F.element_at(F.array(*map(F.lit, ["a.MD", "b/c.Html", "x.y.docx", "p.JPEG", "noext", "t.vtt"])), (F.col("n_nationkey") % 6 + 1).cast("int"))
    mime = F.element_at(F.array(*map(F.lit, ["application/PDF", "text/csv; charset=utf-8", "x/unknown"])), (F.col("n_nationkey") % 3 + 1).cast("int"))
    return n.select("n_nationkey", detect.by_extension(name).alias("by_name"), detect.by_mime(mime).alias("by_mime"))


@register("select n_nationkey, case n_nationkey % 7 when 0 then 'pdf' when 6 then null else 'image' end as format from nation")
def detect_magic(spark, d):
    heads = ["255044462D", "89504E470D0A1A0A", "FFD8FFE0", "49492A0008", "474946383961", "524946460000000057454250", "504B"]
    head = F.element_at(F.array(*map(F.lit, heads)), (F.col("n_nationkey") % 7 + 1).cast("int"))
    return table(spark, d, "nation").withColumn("content", F.unhex(head)).select("n_nationkey", detect.by_magic("content").alias("format"))


@register("select doc_id, octet_length(encode(text)) <= 2000 as accepted from documents")
def size_guard(spark, d):
    docs = table(spark, d, "documents").withColumn("content", F.encode("text", "UTF-8"))
    yes, no = detect.within_size(docs, 2000)
    return yes.select("doc_id", F.lit(True).alias("accepted")).unionByName(no.select("doc_id", F.lit(False).alias("accepted")))


# identifiers and scalar functions


@register("select doc_id, sha256(text) as document_hash, 'urn:lectern:doc:' || sha256(text) as doc, octet_length(encode(text))::bigint as file_size from documents")
def doc_meta_hash(spark, d):
    c = F.encode("text", "UTF-8")
    return table(spark, d, "documents").select("doc_id", T.content_hash(c).alias("document_hash"), T.doc_iri(c).alias("doc"), F.length(c).cast("long").alias("file_size"))


@register("select r_regionkey, 'urn:lectern:ontology#' || r_name as iri, r_name as local from region")
def iri_local_name(spark, d):
    return table(spark, d, "region").select("r_regionkey", T.class_iri("r_name").alias("iri"), T.local_name(T.class_iri("r_name")).alias("local"))


@register("select c_custkey, 'a%20b/' || replace(c_name, '#', '#') || '%25%C3%A9' as iri from customer")
def iri_escape(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.iri_escape(F.concat(F.lit("a b/"), "c_name", F.lit("%é"))).alias("iri"))


@register("select doc_id, ceil(octet_length(encode(text)) / 4.0)::bigint as tokens from documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", T.estimate_tokens("text").alias("tokens"))


@register("select doc_id, strip_accents(text) <> text as changed from documents")
def normalized_text_changed(spark, d):
    return table(spark, d, "documents").select("doc_id", (T.ascii_fold("text") != F.col("text")).alias("changed"))


LINES = "select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents"


def lines(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("pos", (F.col("pos") + 1).cast("long"))


@register(f"select doc_id, pos::bigint as pos, trim(line) as text from ({LINES}) where trim(line) <> ''")
def paragraphs_lines(spark, d):
    return lines(spark, d).filter(F.trim("line") != "").select("doc_id", "pos", F.trim("line").alias("text"))


@register(f"select doc_id, pos::bigint as pos, line as text from ({LINES}) where length(regexp_replace(line, '[^\\p{{L}}]', '', 'g')) >= 2 and not regexp_matches(regexp_replace(line, '[^\\p{{L}}]', '', 'g'), '[^\\p{{Lu}}]') and octet_length(encode(line)) < 80")
def heading_all_caps(spark, d):
    return lines(spark, d).filter(T.is_all_caps("line") & (F.octet_length("line") < 80)).select("doc_id", "pos", F.col("line").alias("text"))


@register(f"select doc_id, pos::bigint as pos, line as text from ({LINES}) where octet_length(encode(line)) < 60 and not regexp_matches(line, '[.,;:]$') and regexp_matches(line, '^\\p{{Lu}}') and len([x for x in regexp_split_to_array(line, '\\s+') if x <> '']) <= 8")
def heading_short_line(spark, d):
    return lines(spark, d).filter(T.is_short_heading("line", F.lit(3))).select("doc_id", "pos", F.col("line").alias("text"))


@register(f"select doc_id, pos::bigint as pos, case when octet_length(encode(ltrim(line))) <= 100 and trim(line) <> '' then least(6, 2 + (pos % 2))::int end as level from ({LINES})")
def heading_numbered(spark, d):
    numbered = F.concat("pos", F.lit("."), F.when(F.col("pos") % 2 == 1, "7.1").otherwise("2"), F.lit(" "), "line")
    return lines(spark, d).select("doc_id", "pos", T.numbered_heading_level(numbered).cast("int").alias("level"))


@register("select event_id, case when value >= 0 then printf('%02d:%02d:%02d.%03d', (round(value * 1000)::bigint // 3600000), (round(value * 1000)::bigint // 60000) % 60, (round(value * 1000)::bigint // 1000) % 60, round(value * 1000)::bigint % 1000) end as start_time from events")
def timestamps(spark, d):
    return table(spark, d, "events").select("event_id", F.when(F.col("value") >= 0, T.timestamp("value")).alias("start_time"))


@register("select p_partkey, replace(replace(replace(replace('<' || p_name || '> & \"x\"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') as html, replace(replace('<' || p_name || '>', '<', '&lt;'), '>', '&gt;') as doctag from part")
def escapes(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", T.escape_html(F.concat(F.lit("<"), "p_name", F.lit('> & "x"'))).alias("html"), T.escape_doctag(F.concat(F.lit("<"), "p_name", F.lit(">"))).alias("doctag"))


@register("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as iso, strftime(o_orderdate, '%Y-%m') as month from orders")
def dates(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", T.pdf_date(F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("120000Z"))).alias("iso"), T.build_date(F.year("o_orderdate").cast("string"), F.month("o_orderdate").cast("string"), F.lit(None).cast("string")).alias("month"))


@register("select p_partkey, case p_partkey % 4 when 0 then 'png' when 1 then 'jpeg' when 2 then null else 'svg' end as format from part")
def image_formats(spark, d):
    link = F.element_at(F.array(*map(F.lit, ["/a/b.PNG?x=1.pdf", "c.jpeg#f", "d.exe", "e.f.svg"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", T.image_format(link).alias("format"))


@register("select l_orderkey, l_linenumber, case when l_quantity / 20.0 >= 2.0 then 1 when l_quantity / 20.0 >= 1.6 then 2 when l_quantity / 20.0 >= 1.4 then 3 when l_quantity / 20.0 >= 1.3 then 4 when l_quantity / 20.0 >= 1.2 then 5 else 6 end as level from lineitem")
def font_levels(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.font_heading_level("l_quantity", F.lit(20.0)).alias("level"))


IOU = """
with b as (select l_orderkey, l_linenumber, l_quantity as l1, l_quantity + 10 as r1, 20.0 as l2, 30.0 as r2 from lineitem),
c as (select *, greatest(0.0, least(r1, r2) - greatest(l1, l2)) * 10 as i from b)
select l_orderkey, l_linenumber, round(i / (200 - i), 4) as iou from c
"""


@register(IOU)
def box_overlap(spark, d):
    box = lambda l: F.struct(l.alias("left"), F.lit(0.0).alias("top"), (l + 10).alias("right"), F.lit(10.0).alias("bottom"))  # noqa: E731, E741
    li = table(spark, d, "lineitem").withColumn("a", box(F.col("l_quantity"))).withColumn("b", box(F.lit(20.0)))
    return li.select("l_orderkey", "l_linenumber", F.round(T.iou("a", "b").cast("double"), 4).alias("iou"))


# sequence operators


@register("select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_quantity, l_linenumber) - 1 as ord from lineitem")
def reading_order_rank(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return sequence.reading_order(li, ["l_orderkey"], ["l_quantity", "l_linenumber"]).select("l_orderkey", "l_linenumber", "ord")


def turns(spark, d) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("doc"), F.concat_ws("-", "conv_id", "turn").alias("el"), F.col("turn").alias("ord"), F.col("role").alias("cls"), "text")


@register("select conv_id || '-' || turn as el, lag(conv_id || '-' || turn) over w as prev, lead(conv_id || '-' || turn) over w as next from conversations window w as (partition by conv_id order by turn)")
def sibling_links(spark, d):
    return sequence.siblings(turns(spark, d)).select("el", "prev", "next")


CRUMB = """
with t as (select conv_id, turn, case role when 'system' then 1 when 'user' then 2 end as lvl, role || ' ' || turn as h from conversations),
w as (select conv_id, turn, last_value(case when lvl = 1 then h end ignore nulls) over x as a, last_value(case when lvl = 2 then h end ignore nulls) over x as b, max(case when lvl = 2 then turn end) over x as tb, max(case when lvl = 1 then turn end) over x as ta from t window x as (partition by conv_id order by turn rows between unbounded preceding and current row))
select conv_id, turn, concat_ws(' > ', a, case when ta is null or ta < tb then b end) as headings from w
"""


@register(CRUMB)
def conversation_breadcrumb(spark, d):
    c = table(spark, d, "conversations").withColumn("level", F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2)).withColumn("h", F.concat_ws(" ", "role", "turn"))
    return sequence.breadcrumb(c, "conv_id", "turn", "level", "h", 2).select("conv_id", "turn", F.array_join("headings", " > ").alias("headings"))


RUNS = """
with e as (select user_id, event_id, event_type, case when lag(event_type) over w = event_type then 0 else 1 end as n from events window w as (partition by user_id order by event_id)),
r as (select user_id, event_id, event_type, sum(n) over (partition by user_id order by event_id) as run from e)
select user_id, run::bigint as run, count(*)::bigint as n, string_agg(event_id::varchar, ',' order by event_id) as ids from r group by user_id, run
"""


@register(RUNS)
def list_run_merge(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    r = sequence.runs(e, "user_id", "event_id", F.col("event_type"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ",")
    return r.groupBy("user_id", "run").agg(F.count(F.lit(1)).alias("n"), ids.alias("ids"))


@register("select l_orderkey, round(avg(l_quantity), 6) as avg_height, round(0.2 * avg(l_quantity), 6) as tolerance from lineitem group by 1")
def band_tolerance_avg_height(spark, d):
    a = F.avg("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(a, 6).alias("avg_height"), F.round(a * 0.2, 6).alias("tolerance"))


@register("select l_orderkey, list_sort(list(l_quantity))[len(list(l_quantity)) // 2 + 1] as median from lineitem group by 1")
def upper_median(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(sequence.upper_median(F.collect_list("l_quantity")).alias("median"))


def boxes(spark, d, step: float = 7.0) -> DataFrame:
    """Lines of an order as boxes on a page, ``step`` apart from line to line."""
    left, top = F.col("l_extendedprice") / 1000.0, F.col("l_linenumber") * step
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("doc"), F.lit(1).alias("page"), left.alias("left"), top.alias("top"),
        (left + 12.0).alias("right"), (top + 10.0).alias("bottom"),
        (F.col("l_discount") * 10.0 + F.col("l_extendedprice") / 1e7).alias("confidence"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("text"), (F.col("l_tax") * 100.0).alias("font_size"),
    )


def boxes_sql(step: float = 7.0) -> str:
    return f"""b as (
    select l_orderkey::varchar as doc, 1 as page, l_extendedprice / 1000.0::double as l, l_linenumber * {step}::double as t,
        l_extendedprice / 1000.0::double + 12.0::double as r, l_linenumber * {step}::double + 10.0::double as m,
        l_discount * 10.0::double + l_extendedprice / 1e7::double as confidence,
        l_orderkey || '-' || l_linenumber || '-' || l_partkey as text, l_tax * 100.0::double as font_size
    from lineitem)"""


#: Greedy: the next most confident box stays if no kept one overlaps it.
SUPPRESSED = f"""
with recursive {boxes_sql()},
o as (select *, row_number() over (partition by doc order by confidence desc, l, t) as i from b),
k as (
    select doc, i, [{{'text': text, 'confidence': confidence, 'l': l, 't': t, 'r': r, 'm': m}}] as kept from o where i = 1
    union all
    select o.doc, o.i, case when len(list_filter(list_transform(k.kept, lambda x:
            greatest(least(x.r, o.r) - greatest(x.l, o.l), 0) * greatest(least(x.m, o.m) - greatest(x.t, o.t), 0)), lambda y:
            y / ((o.r - o.l) * (o.m - o.t) + (o.r - o.l) * (o.m - o.t) - y) > 0.3)) = 0
        then list_append(k.kept, {{'text': o.text, 'confidence': o.confidence, 'l': o.l, 't': o.t, 'r': o.r, 'm': o.m}}) else k.kept end
    from k join o on o.doc = k.doc and o.i = k.i + 1)
select doc, x.text as text, x.confidence as confidence
from (select doc, unnest(kept) as x from k where i = (select max(i) from o where o.doc = k.doc))
"""


@register(SUPPRESSED)
def region_suppression(spark, d):
    return sequence.suppress(boxes(spark, d), 0.3).select("doc", "text", "confidence")


@register(f"with {boxes_sql()} select doc, text, row_number() over (partition by doc order by t, l) - 1 as ord from b")
def region_band_order(spark, d):
    return sequence.band_order(boxes(spark, d)).select("doc", "text", "ord")


#: A word starts a line if it lies beyond the tolerance from the centre of the line's first word.
WORD_LINES = f"""
with recursive {boxes_sql(2.0)},
o as (select *, (t + m) / 2 as y, row_number() over (partition by doc order by (t + m) / 2, l) as i from b),
k as (
    select doc, i, y as anchor, 0 as line from o where i = 1
    union all
    select o.doc, o.i, case when abs(o.y - k.anchor) > 3 then o.y else k.anchor end, k.line + (abs(o.y - k.anchor) > 3)::int
    from k join o on o.doc = k.doc and o.i = k.i + 1)
select doc, 1 as page, k.line::bigint as line, string_agg(text, ' ' order by l) as text, min(l) as "left", min(t) as top, max(r) as "right", max(m) as bottom
from k join o using (doc, i) group by doc, k.line
"""


@register(WORD_LINES)
def word_lines(spark, d):
    return sequence.words_to_lines(boxes(spark, d, 2.0))


PARAGRAPHS = f"""
with {boxes_sql()},
n as (select *, t - lag(m) over (partition by doc order by t) > 1.5 * avg(m - t) over (partition by doc) as new from b),
p as (select *, sum(coalesce(new, false)::int) over (partition by doc order by t rows unbounded preceding) as paragraph from n)
select doc, 1 as page, paragraph::bigint as paragraph, string_agg(text, ' ' order by t, text) as text from p group by doc, paragraph
"""


@register(PARAGRAPHS)
def line_paragraphs(spark, d):
    return sequence.lines_to_paragraphs(boxes(spark, d))


FONT_RUNS = f"""
with {boxes_sql()},
n as (select *, font_size is distinct from lag(font_size) over (partition by doc order by t, l) as new from b),
r as (select *, sum(new::int) over (partition by doc order by t, l rows unbounded preceding) as run from n),
s as (select doc, list_sort(list(font_size))[len(list(font_size)) // 2 + 1] as body from b group by doc),
g as (select doc, run, min(font_size) as font_size, string_agg(text, ' ' order by t, l) as text from r group by doc, run)
select doc, 1 as page, run::bigint as run, font_size, text, case when body <= 0 then 2 when font_size / body >= 2.0 then 1 when font_size / body >= 1.6 then 2
    when font_size / body >= 1.4 then 3 when font_size / body >= 1.3 then 4 when font_size / body >= 1.2 then 5 else 6 end as level
from g join s using (doc) where font_size > body * 1.15
"""


@register(FONT_RUNS)
def font_run_headings(spark, d):
    return sequence.font_runs(boxes(spark, d))


# tables


def region_cells(spark, d) -> DataFrame:
    return tables.unpivot(table(spark, d, "region"), "region", F.col("r_regionkey") + 1)


def nation_cells(spark, d) -> DataFrame:
    return tables.unpivot(table(spark, d, "nation"), "nation", F.col("n_nationkey") + 1)


NATION_CELLS = "select 0 as row, unnest([0, 1, 2]) as col, unnest(['n_nationkey', 'n_name', 'n_regionkey']) as text union all select n_nationkey + 1, unnest([0, 1, 2]), unnest([n_nationkey::varchar, n_name, n_regionkey::varchar]) from nation"
REGION_CELLS = "select 0 as row, unnest([0, 1]) as col, unnest(['r_regionkey', 'r_name']) as text union all select r_regionkey + 1, unnest([0, 1]), unnest([r_regionkey::varchar, r_name]) from region"


@register(f"select 'nation' as tbl, row, col, text, row = 0 as is_header from ({NATION_CELLS})")
def table_cells_unpivot(spark, d):
    return nation_cells(spark, d)


@register(f"select 'nation' as tbl, row, string_agg(text, ' | ' order by col) as text from ({NATION_CELLS}) group by row")
def table_row_text(spark, d):
    return tables.row_texts(nation_cells(spark, d), keys=["tbl"])


@register(f"select 'nation' as tbl, col, greatest(3, max(octet_length(encode(text))))::int as width from ({NATION_CELLS}) group by col")
def table_col_widths(spark, d):
    return tables.column_widths(nation_cells(spark, d), keys=["tbl"])


@register(f"select 'nation' as tbl, max(row) + 1 as rows, max(col) + 1 as cols from ({NATION_CELLS})")
def table_shape(spark, d):
    return tables.shape(nation_cells(spark, d), ["tbl"])


@register(f"select 'nation' as tbl, row, row = 0 as all_header, row = 0 as any_header from ({NATION_CELLS}) group by row")
def table_header_rows(spark, d):
    return tables.header_rows(nation_cells(spark, d), ["tbl"])


@register("with w as (select doc_id, len(string_split(line, ',')) as n from (select doc_id, unnest(string_split(text, chr(10))) as line from documents)) select doc_id, max(n)::int as columns, round(avg(n), 6) as mean, round(var_pop(n), 6) as variance from w group by doc_id")
def csv_delimiter_stats(spark, d):
    n = F.size(F.split("line", ","))
    return lines(spark, d).groupBy("doc_id").agg(F.max(n).alias("columns"), F.round(F.avg(n), 6).alias("mean"), F.round(F.var_pop(n), 6).alias("variance"))


def region_frames(spark, d) -> DocFrames:
    """The region table as a CSV document, read by the CSV reader."""
    # at most the region table's five rows
    body = table(spark, d, "region").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))), lambda x: F.concat_ws(",", x["r_regionkey"], x["r_name"])), "\n").alias("x"))
    return convert(body.select(F.lit("region.csv").alias("name"), F.encode(F.concat(F.lit("r_regionkey,r_name\n"), "x"), "UTF-8").alias("content")))


@register(f"with c as (select row, col, text, greatest(3, max(length(text)) over (partition by col)) as w from ({REGION_CELLS})), r as (select row, '| ' || string_agg(rpad(text, w::int, ' '), ' | ' order by col) || ' |' as line, '| ' || string_agg(repeat('-', w::int), ' | ' order by col) || ' |' as rule from c group by row) select string_agg(case when row = 0 then line || chr(10) || rule else line end, chr(10) order by row) || chr(10) as text from r")
def table_markdown(spark, d):
    return export.markdown(region_frames(spark, d)).select("text")


@register(f"with r as (select row, '<tr>' || string_agg(case when row = 0 then '<th>' || text || '</th>' else '<td>' || text || '</td>' end, '' order by col) || '</tr>' as line from ({REGION_CELLS}) group by row) select '<!DOCTYPE html>' || chr(10) || '<html lang=\"en\">' || chr(10) || '<head><meta charset=\"utf-8\"><title>region.csv</title></head>' || chr(10) || '<body>' || chr(10) || '<table>' || chr(10) || string_agg(case when row = 0 then '<thead>' || line || '</thead>' else line end, chr(10) order by row) || chr(10) || '</table>' || chr(10) || '</body>' || chr(10) || '</html>' || chr(10) as text from r")
def table_html(spark, d):
    return export.html(region_frames(spark, d)).select("text")


# exports of conversations as documents: every turn a paragraph


def conversation_frames(spark, d) -> DocFrames:
    c = table(spark, d, "conversations")
    doc = F.col("conv_id").cast("string")
    none = lambda kind: F.lit(None).cast(kind)
    el = c.select(doc.alias("doc"), F.concat_ws("-", "conv_id", "turn").alias("el"), F.when(F.col("role") == "system", "SectionHeader").otherwise("Paragraph").alias("cls"), F.col("turn").alias("ord"), "text", F.when(F.col("role") == "system", 1).alias("level"), none("int").alias("page"), none("string").alias("parent"), F.lit(0).alias("depth"), *(none("string").alias(n) for n in ("code_lang", "link_target", "link_text", "alt_text", "pic_format")), none("int").alias("img_w"), none("int").alias("img_h"), *(none("string").alias(n) for n in ("start_time", "end_time", "label_id", "citation_key", "caption_of")), none("float").alias("confidence"))
    docs = c.select(doc.alias("doc")).distinct().select("doc", F.lit("text").alias("source_format"), F.sha2("doc", 256).alias("document_hash"), F.concat(F.lit("conv-"), "doc").alias("file_name"), F.lit(0).cast("long").alias("file_size"), none("int").alias("page_count"), none("string").alias("language"), none("string").alias("title"), none("array<string>").alias("creator"), none("string").alias("date"), none("string").alias("description"), none("string").alias("keywords"), F.lit("Success").alias("status"), none("string").alias("error"))
    cells = spark.createDataFrame([], "doc string, tbl string, row int, col int, text string, is_header boolean, row_span int, col_span int")
    return DocFrames(docs, el, cells, spark.createDataFrame([], "doc string, page int, width float, height float"))


@register("select conv_id::varchar as doc, string_agg(text, chr(10) order by turn) as text from conversations group by 1")
def text_export(spark, d):
    return export.text(conversation_frames(spark, d))


@register("with n as (select conv_id::varchar as doc, turn, text, row_number() over (partition by conv_id order by turn) - 1 as i from conversations) select doc, 'WEBVTT' || chr(10) || chr(10) || string_agg(printf('%02d:%02d:%02d.%03d', i * 5 // 3600, i * 5 // 60 % 60, i * 5 % 60, 0) || ' --> ' || printf('%02d:%02d:%02d.%03d', (i + 1) * 5 // 3600, (i + 1) * 5 // 60 % 60, (i + 1) * 5 % 60, 0) || chr(10) || text, chr(10) || chr(10) order by turn) || chr(10) as text from n group by doc")
def webvtt_pseudo(spark, d):
    return export.webvtt(conversation_frames(spark, d))


@register("with t as (select conv_id::varchar as doc, turn, case when role = 'system' then 'section_header_level_1' else 'text' end as tag, replace(replace(text, '<', '&lt;'), '>', '&gt;') as x from conversations) select doc, '<doctag>' || chr(10) || '<page>' || chr(10) || string_agg('<' || tag || '>' || x || '</' || tag || '>', chr(10) order by turn) || chr(10) || '</page>' || chr(10) || '</doctag>' || chr(10) as text from t group by doc")
def doctags_lines(spark, d):
    return export.doctags(conversation_frames(spark, d))


@register("with t as (select conv_id::varchar as doc, turn, case when role = 'system' then '# ' || text else text end as x from conversations) select doc, trim(string_agg(x, chr(10) || chr(10) order by turn)) || chr(10) as text from t group by doc")
def markdown_export(spark, d):
    return export.markdown(conversation_frames(spark, d))


@register("select conv_id::varchar as doc, 'conv-' || conv_id as name, count(*)::int as n_texts, arg_min(text, turn) as first_text from conversations group by conv_id")
def json_export_struct(spark, d):
    j = export.json(conversation_frames(spark, d))
    return j.select("doc", F.get_json_object("text", "$.name").alias("name"), F.json_array_length(F.get_json_object("text", "$.texts")).alias("n_texts"), F.get_json_object("text", "$.texts[0].text").alias("first_text"))


@register("select conv_id::varchar as doc, 'CreativeWork' as type, count(*)::int as n_elements from conversations group by conv_id")
def jsonld_export(spark, d):
    j = export.jsonld(conversation_frames(spark, d))
    return j.select("doc", F.get_json_object("text", "$.@type").alias("type"), F.json_array_length(F.get_json_object("text", "$['doc:hasElement']")).alias("n_elements"))


#: The navigation's items, the heading, and paragraphs, which end at the next mark; their tags go.
PAGE_MARKDOWN = f"""
with p as (select page_id, html, split_part(split_part(html, '<article>', 2), '</article>', 1) as body from pages),
i as (select page_id, '- ' || {said("regexp_replace(unnest(regexp_extract_all(split_part(html, '<article>', 1), '<li>(.*?)</li>', 1)), '<[^>]*>', '', 'g')")} as x,
    generate_subscripts(regexp_extract_all(split_part(html, '<article>', 1), '<li>'), 1) as k from p),
t as (select page_id, {said("regexp_replace(regexp_replace(split_part(unnest(string_split(body, '<p>')[2:]), '</p>', 1), '<br>', ' ', 'g'), '<[^>]*>', '', 'g')")} as x,
    generate_subscripts(string_split(body, '<p>')[2:], 1) as k from p),
blocks as (
    select page_id, string_agg(x, chr(10) order by k) as x, 0 as k from i group by 1
    union all select page_id, '# ' || {said("regexp_extract(html, '<h1>(.*?)</h1>', 1)")}, 1 from p
    union all select page_id, x, k + 1 from t where x <> '')
select page_id, trim(string_agg(x, chr(10) || chr(10) order by k)) || chr(10) as text from blocks group by 1
"""


@register(PAGE_MARKDOWN)
def html_page_markdown(spark, d):
    f = pages(spark, d)
    return f.docs.select("doc", page_id()).join(export.markdown(f), "doc").select("page_id", "text")


# quads and SPARQL over the star schema


def lit(c: str, kind: str) -> F.Column:
    return F.struct(F.col(c).cast("string").alias("o"), F.lit("literal").alias("k"), F.lit(XSD + kind).alias("t"))


def iri(prefix: str, c: str):
    return F.struct(F.concat(F.lit(prefix), F.col(c).cast("string")).alias("o"), F.lit("iri").alias("k"), F.lit(None).cast("string").alias("t"))


def cls(name: str):
    return F.struct(F.lit(NS + name).alias("o"), F.lit("iri").alias("k"), F.lit(None).cast("string").alias("t"))


def facts(df: DataFrame, graph: str, subject, props: dict) -> DataFrame:
    from lectern.schema import RDF_TYPE

    pairs = [F.struct(F.lit(RDF_TYPE if p == "a" else NS + p).alias("p"), v.alias("x")) for p, v in props.items()]
    rows = df.select(subject.alias("subject"), F.explode(F.array(*pairs)).alias("q"))
    return rows.filter("q.x.o is not null").select(F.lit(graph).alias("graph"), "subject", F.col("q.p").alias("predicate"), F.col("q.x.o").alias("object"), F.col("q.x.k").alias("object_kind"), F.col("q.x.t").alias("datatype"), F.lit(None).cast("string").alias("lang"))


def star(spark, d) -> DataFrame:
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    out = facts(table(spark, d, "region"), "g:region", key("r:", "r_regionkey"), {"a": cls("Region"), "name": lit("r_name", "string"), "key": lit("r_regionkey", "integer")})
    out = out.unionByName(facts(table(spark, d, "nation"), "g:nation", key("n:", "n_nationkey"), {"a": cls("Nation"), "name": lit("n_name", "string"), "key": lit("n_nationkey", "integer"), "inRegion": iri("r:", "n_regionkey")}))
    out = out.unionByName(facts(table(spark, d, "customer"), "g:customer", key("c:", "c_custkey"), {"a": cls("Customer"), "name": lit("c_name", "string"), "key": lit("c_custkey", "integer"), "ofNation": iri("n:", "c_nationkey"), "segment": lit("c_mktsegment", "string")}))
    return out.unionByName(facts(table(spark, d, "orders"), "g:orders", key("o:", "o_orderkey"), {"a": cls("Order"), "by": iri("c:", "o_custkey"), "priority": lit("o_orderpriority", "string")}))


def sparql(name: str, text: str, sql: str | None) -> None:
    def run(spark, d):
        return query(star(spark, d), text)

    run.__name__ = f"sparql_{name}"
    register(sql)(run)


sparql("bgp_join", "SELECT ?c ?n ?r { ?x a :Customer ; :name ?c ; :ofNation ?y . ?y :name ?n ; :inRegion ?z . ?z :name ?r }", "select c_name as c, n_name as n, r_name as r from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
sparql("optional", "SELECT ?c ?o { ?c a :Customer . OPTIONAL { ?o :by ?c ; :priority '1-URGENT' } }", "select 'c:' || c_custkey as c, 'o:' || o_orderkey as o from customer left join orders on o_custkey = c_custkey and o_orderpriority = '1-URGENT'")
sparql("not_exists", "SELECT ?n { ?c a :Customer ; :name ?n . FILTER NOT EXISTS { ?o :by ?c } }", "select c_name as n from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
sparql("exists", "SELECT ?n { ?c a :Customer ; :name ?n . FILTER EXISTS { ?o :by ?c } }", "select c_name as n from customer where exists (select 1 from orders where o_custkey = c_custkey)")
sparql("filter_in", "SELECT ?n ?k { ?x a :Nation ; :name ?n ; :key ?k . FILTER(?k IN (1, 3, 5) || ?k > 20) }", "select n_name as n, n_nationkey::varchar as k from nation where n_nationkey in (1, 3, 5) or n_nationkey > 20")
sparql("contains", "SELECT ?n { ?x a :Nation ; :name ?n . FILTER(CONTAINS(LCASE(?n), 'a') && STRSTARTS(?n, 'N') && !REGEX(?n, '9$')) }", "select n_name as n from nation where contains(lower(n_name), 'a') and starts_with(n_name, 'N') and not regexp_matches(n_name, '9$')")
sparql("group_count", "SELECT ?s (COUNT(?c) AS ?n) { ?c a :Customer ; :segment ?s } GROUP BY ?s", "select c_mktsegment as s, count(*)::varchar as n from customer group by 1")
sparql(
    "exists_correlated",
    "SELECT ?a { ?x a :Nation ; :key ?a . FILTER EXISTS { ?y a :Region ; :key ?b . FILTER(?b > ?a) } }",
    "select n_nationkey::varchar as a from nation where exists (select 1 from region where r_regionkey > n_nationkey)",
)
sparql(
    "not_exists_correlated",
    "SELECT ?a { ?x a :Nation ; :key ?a ; :inRegion ?r . FILTER NOT EXISTS { ?y :inRegion ?r ; :key ?b . FILTER(?b > ?a) } }",
    "select n_nationkey::varchar as a from nation n where not exists (select 1 from nation m where m.n_regionkey = n.n_regionkey and m.n_nationkey > n.n_nationkey)",
)
sparql(
    "optional_then_join",
    "SELECT ?c ?o ?p { ?c a :Customer . OPTIONAL { ?o :by ?c ; :priority '1-URGENT' } ?o :priority ?p }",
    """select 'c:' || c_custkey as c, 'o:' || o.o_orderkey as o, o.o_orderpriority as p
    from customer left join orders u on u.o_custkey = c_custkey and u.o_orderpriority = '1-URGENT'
    join orders o on u.o_orderkey is null or o.o_orderkey = u.o_orderkey""",
)
sparql(
    "optional_twice",
    "SELECT ?n ?r ?s { ?x a :Nation ; :name ?n . OPTIONAL { ?x :inRegion ?r . FILTER(STRENDS(STR(?r), '1')) } OPTIONAL { ?r :name ?s } }",
    """select n_name as n, 'r:' || coalesce(r_regionkey, 0) as r, s.r_name as s from nation join region on r_regionkey = n_regionkey and n_regionkey = 1
        join region s using (r_regionkey)
    union all select n_name, q.s, q.name from nation, (select 'r:' || r_regionkey as s, r_name as name from region union all
        select 'n:' || n_nationkey, n_name from nation union all select 'c:' || c_custkey, c_name from customer) q where n_regionkey <> 1""",
)
sparql("from_graph", "SELECT ?n FROM <g:nation> { ?x :name ?n }", "select n_name as n from nation")
sparql(
    "from_named",
    "SELECT ?g (COUNT(?s) AS ?n) FROM <g:nation> FROM NAMED <g:region> FROM NAMED <g:orders> { GRAPH ?g { ?s a ?t } } GROUP BY ?g",
    "select 'g:region' as g, count(*)::varchar as n from region union all select 'g:orders', count(*)::varchar from orders",
)
sparql("bound", "SELECT ?n ?b { ?x a :Nation ; :name ?n . OPTIONAL { ?x :inRegion <r:2> . ?x :key ?k } BIND(BOUND(?k) AS ?b) }", "select n_name as n, (n_regionkey = 2)::varchar as b from nation")
sparql("lang", "SELECT ?n { ?x a :Nation ; :name ?n . FILTER(LANG(?n) = '') }", "select n_name as n from nation")
sparql(
    "numbers",
    "SELECT ?k ?a ?b ?c { ?x a :Nation ; :key ?k . BIND(ABS(?k - 10) AS ?a) BIND(CEIL(?k / 4) AS ?b) BIND(ROUND(?k / 4) AS ?c) }",
    "select n_nationkey::varchar as k, abs(n_nationkey - 10)::varchar as a, ceil(n_nationkey / 4)::int::varchar as b, floor(n_nationkey / 4 + 0.5)::int::varchar as c from nation",
)
sparql(
    "dates",
    "SELECT ?k ?y ?m ?d ?h { ?x a :Region ; :key ?k . BIND('2024-03-09T21:05:00'^^xsd:dateTime AS ?t) BIND(YEAR(?t) AS ?y) BIND(MONTH(?t) AS ?m) BIND(DAY(?t) AS ?d) BIND(HOURS(?t) AS ?h) }",
    "select r_regionkey::varchar as k, '2024' as y, '3' as m, '9' as d, '21' as h from region",
)
sparql(
    "strings",
    "SELECT ?n ?b ?e ?r { ?x a :Nation ; :name ?n . BIND(STRBEFORE(?n, '_') AS ?b) BIND(ENCODE_FOR_URI(CONCAT(?n, ' x')) AS ?e) BIND(REPLACE(?n, 'N', 'n') AS ?r) }",
    "select n_name as n, split_part(n_name, '_', 1) as b, n_name || '%20x' as e, replace(n_name, 'N', 'n') as r from nation",
)
sparql("path_zero_or_one", "SELECT DISTINCT ?r { <n:3> :inRegion? ?r }", "select 'n:3' as r union all select 'r:' || n_regionkey from nation where n_nationkey = 3")
sparql("path_negated", "SELECT ?o { <n:3> !(:name|:key|rdf:type) ?o }", "select 'r:' || n_regionkey as o from nation where n_nationkey = 3")
sparql("having", "SELECT ?c (COUNT(?o) AS ?n) { ?o :by ?c } GROUP BY ?c HAVING (COUNT(?o) > 10)", "select 'c:' || o_custkey as c, count(*)::varchar as n from orders group by 1 having count(*) > 10")
sparql("distinct", "SELECT DISTINCT ?p { ?o a :Order ; :priority ?p }", "select distinct o_orderpriority as p from orders")
sparql("order_limit", "SELECT ?n ?k { ?c a :Customer ; :name ?n ; :key ?k } ORDER BY DESC(?k) LIMIT 10", "select c_name as n, c_custkey::varchar as k from customer order by c_custkey desc limit 10")
sparql("offset", "SELECT ?k { ?c a :Customer ; :key ?k } ORDER BY ?k LIMIT 5 OFFSET 7", "select c_custkey::varchar as k from customer order by c_custkey limit 5 offset 7")
sparql("union", "SELECT ?n { { ?x a :Nation ; :name ?n } UNION { ?x a :Region ; :name ?n } }", "select n_name as n from nation union all select r_name from region")
sparql("minus", "SELECT ?c { ?c a :Customer MINUS { ?o :by ?c } }", "select 'c:' || c_custkey as c from customer where c_custkey not in (select o_custkey from orders)")
sparql("bind", "SELECT ?n ?l ?u { ?x a :Nation ; :name ?n . BIND(STRLEN(?n) AS ?l) BIND(CONCAT(UCASE(SUBSTR(?n, 1, 3)), '-', STRAFTER(?n, 'A')) AS ?u) }", "select n_name as n, length(n_name)::varchar as l, upper(substr(n_name, 1, 3)) || '-' || case when instr(n_name, 'A') > 0 then substr(n_name, instr(n_name, 'A') + 1) else '' end as u from nation")
sparql("values", "SELECT ?n { VALUES ?k { 1 2 4 } ?x a :Nation ; :key ?j ; :name ?n . FILTER(?j = ?k) }", "select n_name as n from nation where n_nationkey in (1, 2, 4)")
sparql("subquery", "SELECT ?n ?m { ?x a :Nation ; :name ?n . { SELECT ?x (COUNT(?c) AS ?m) { ?c :ofNation ?x } GROUP BY ?x } }", "select n_name as n, count(*)::varchar as m from nation join customer on c_nationkey = n_nationkey group by n_name, n_nationkey")
sparql("aggs", "SELECT (SUM(?k) AS ?s) (AVG(?k) AS ?a) (MIN(?k) AS ?lo) (MAX(?k) AS ?hi) (COUNT(DISTINCT ?r) AS ?m) (GROUP_CONCAT(?n; SEPARATOR='|') AS ?all) { ?x a :Nation ; :key ?k ; :name ?n ; :inRegion ?r }", "select sum(n_nationkey)::varchar as s, avg(n_nationkey)::bigint::varchar as a, min(n_nationkey)::varchar as lo, max(n_nationkey)::varchar as hi, count(distinct n_regionkey)::varchar as m, string_agg(n_name, '|' order by n_name) as all from nation".replace(" as all ", " as \"all\" "))
sparql("graph_var", "SELECT ?g (COUNT(?s) AS ?n) { GRAPH ?g { ?s a ?t } } GROUP BY ?g", "select 'g:region' as g, count(*)::varchar as n from region union all select 'g:nation', count(*)::varchar from nation union all select 'g:customer', count(*)::varchar from customer union all select 'g:orders', count(*)::varchar from orders")
sparql("graph_constant", "SELECT ?n { GRAPH <g:nation> { ?x :name ?n } }", "select n_name as n from nation")
sparql("range_optional", "SELECT ?a ?b { ?x a :Nation ; :key ?a . OPTIONAL { ?y a :Region ; :key ?b . FILTER(?b > ?a) } }", "select n_nationkey::varchar as a, r_regionkey::varchar as b from nation left join region on r_regionkey > n_nationkey")
sparql("path_sequence", "SELECT ?c ?r { ?c :ofNation/:inRegion ?r }", "select 'c:' || c_custkey as c, 'r:' || n_regionkey as r from customer join nation on c_nationkey = n_nationkey")
sparql("path_plus", "SELECT DISTINCT ?r { <n:3> (:inRegion|^:inRegion)+ ?r }", "select distinct 'n:' || n_nationkey as r from nation where n_regionkey = (select n_regionkey from nation where n_nationkey = 3) union select 'r:' || n_regionkey from nation where n_nationkey = 3")
sparql("path_star", "SELECT ?n { ?n a :Nation . ?n :inRegion* <r:1> }", "select 'n:' || n_nationkey as n from nation where n_regionkey = 1")
sparql("variable_predicate", "SELECT ?p (COUNT(?o) AS ?n) { <n:3> ?p ?o } GROUP BY ?p", "select unnest(['http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'urn:lectern:ontology#name', 'urn:lectern:ontology#key', 'urn:lectern:ontology#inRegion']) as p, '1' as n")
sparql("typed_constant", "SELECT ?n { ?x a :Nation ; :key 7 ; :name ?n }", "select n_name as n from nation where n_nationkey = 7")
sparql("hashes", "SELECT ?n ?h ?m { ?x a :Region ; :name ?n . BIND(SHA256(?n) AS ?h) BIND(MD5(?n) AS ?m) }", "select r_name as n, sha256(r_name) as h, md5(r_name) as m from region")
sparql("terms", "SELECT ?x ?i ?l ?d { ?x a :Region ; :key ?k . BIND(isIRI(?x) AS ?i) BIND(isNumeric(?k) AS ?l) BIND(STR(DATATYPE(?k)) AS ?d) }", "select 'r:' || r_regionkey as x, 'true' as i, 'true' as l, 'http://www.w3.org/2001/XMLSchema#integer' as d from region")
sparql("coalesce_if", "SELECT ?k ?v { ?x a :Region ; :key ?k . OPTIONAL { ?x :nothing ?z } BIND(IF(?k > 2, 'big', COALESCE(?z, 'small')) AS ?v) }", "select r_regionkey::varchar as k, case when r_regionkey > 2 then 'big' else 'small' end as v from region")
sparql("math", "SELECT ?k ?a ?b { ?x a :Nation ; :key ?k . BIND((?k + 3) * 2 - 1 AS ?a) BIND(FLOOR(?k / 4) AS ?b) }", "select n_nationkey::varchar as k, ((n_nationkey + 3) * 2 - 1)::varchar as a, (n_nationkey // 4)::varchar as b from nation")


@register("select exists(select 1 from customer where c_mktsegment = 'BUILDING') as answer")
def sparql_ask(spark, d):
    found = ask(star(spark, d), "ASK { ?c :segment 'BUILDING' }")
    return spark.createDataFrame([(found,)], "answer boolean")


def star_sql() -> str:
    """The facts of ``star`` in SQL: q (subject, predicate, object, kind, datatype)."""
    out = []
    kinds = {
        "region": ("r", "r_regionkey", {"a": "Region", "name": ("r_name", "string"), "key": ("r_regionkey", "integer")}),
        "nation": ("n", "n_nationkey", {"a": "Nation", "name": ("n_name", "string"), "key": ("n_nationkey", "integer"), "inRegion": "'r:' || n_regionkey"}),
        "customer": ("c", "c_custkey", {"a": "Customer", "name": ("c_name", "string"), "key": ("c_custkey", "integer"), "ofNation": "'n:' || c_nationkey", "segment": ("c_mktsegment", "string")}),
        "orders": ("o", "o_orderkey", {"a": "Order", "by": "'c:' || o_custkey", "priority": ("o_orderpriority", "string")}),
    }
    for name, (prefix, key, props) in kinds.items():
        for p, v in props.items():
            predicate = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type" if p == "a" else NS + p
            value, kind, datatype = (v[0], "literal", f"'{XSD}{v[1]}'") if isinstance(v, tuple) else (f"'{NS}{v}'" if p == "a" else v, "iri", "null")
            out.append(f"select '{prefix}:' || {key} as subject, '{predicate}' as predicate, ({value})::varchar as object, '{kind}' as kind, {datatype}::varchar as datatype from {name}")
    return f"q as ({' union all '.join(out)})"


TERM_SQL = f"case when kind = 'iri' then '<' || object || '>' when datatype = '{XSD}string' then '\"' || object || '\"' else '\"' || object || '\"^^<' || datatype || '>' end"


@register(f"with {star_sql()} select '<' || subject || '> <' || predicate || '> ' || {TERM_SQL} || ' .' as line from q")
def ntriples_lines(spark, d):
    return ntriples(star(spark, d))


@register(
    f"with {star_sql()}, x as (select subject, case when ends_with(predicate, '#type') then 'a' else '<' || predicate || '>' end || ' ' || {TERM_SQL} as pair from q) "
    "select subject, '<' || subject || '> ' || string_agg(pair, ' ;' || chr(10) || '    ' order by pair) || ' .' as block from x group by subject"
)
def turtle_blocks(spark, d):
    return turtle(star(spark, d)).select("subject", "block")


RDFXML = f"""
with {star_sql()},
h as (select *, regexp_extract(predicate, '([^#/]+)$', 1) as local, regexp_extract(predicate, '^(.*[#/])', 1) as space from q),
l as (select subject, '  <p:' || local || ' xmlns:p="' || space || '"' || case when kind = 'iri' then ' rdf:resource="' || object || '"/>'
    else case when datatype <> '{XSD}string' then ' rdf:datatype="' || datatype || '"' else '' end || '>' || object || '</p:' || local || '>' end as line from h)
select subject, '<rdf:Description rdf:about="' || subject || '">' || chr(10) || string_agg(line, chr(10) order by line) || chr(10) || '</rdf:Description>' as block from l group by subject
"""


@register(RDFXML)
def rdfxml_blocks(spark, d):
    return rdfxml(star(spark, d)).select("subject", "block")


@register("select 27::bigint as classes, 63::bigint as properties")
def ontology_counts(spark, d):
    from lectern.schema import RDF_TYPE, RDFS, ontology

    o = ontology(spark).filter(F.col("predicate") == RDF_TYPE)
    return o.agg(F.count_if(F.col("object") == RDFS + "Class").alias("classes"), F.count_if(F.col("object") != RDFS + "Class").alias("properties"))


#: Elements of the driver's pages as the reader numbers them: title, list, items with their links, article, heading, paragraphs, footer.
PAGE_ELEMENTS = f"""
p as (select html, page_id, 'urn:lectern:doc:' || sha256(html) as doc, split_part(html, '<article>', 1) as nav, split_part(split_part(html, '<article>', 2), '</article>', 1) as body,
    {said("regexp_extract(html, '<title>(.*?)</title>', 1)")} as title from pages),
i as (select doc, unnest(regexp_extract_all(nav, '<li>(.*?)</li>', 1)) as x, generate_subscripts(regexp_extract_all(nav, '<li>'), 1) - 1 as k from p),
n as (select doc, len(regexp_extract_all(nav, '<li>')) as n from p),
t0 as (select doc, {said("regexp_replace(regexp_replace(split_part(unnest(string_split(body, '<p>')[2:]), '</p>', 1), '<br>', ' ', 'g'), '<[^>]*>', '', 'g')")} as x,
    generate_subscripts(string_split(body, '<p>')[2:], 1) as k from p),
t as (select doc, x, row_number() over (partition by doc order by k) - 1 as k, count(*) over (partition by doc) as m from t0 where x <> ''),
e as (
    select doc, 'Title' as cls, 'title' as pre, 0 as ord, title as text, null::int as level, null as target, null as parent, 0 as depth from p where title <> ''
    union all select doc, 'UnorderedList', 'ul', 1, null, null, null, null, 0 from p
    union all select doc, 'ListItem', 'listitem', 2 + 2 * k, {said("regexp_replace(x, '<[^>]*>', '', 'g')")}, null, null, doc || '/ul-1', 1 from i
    union all select doc, 'Hyperlink', 'link', 3 + 2 * k, {said("regexp_replace(x, '<[^>]*>', '', 'g')")}, null, regexp_extract(x, 'href="([^"]*)"', 1), doc || '/ul-1', 1 from i
    union all select doc, 'Group', 'article', 2 + 2 * n, null, null, null, null, 0 from n
    union all select doc, 'SectionHeader', 'heading', 3 + 2 * n, {said("regexp_extract(html, '<h1>(.*?)</h1>', 1)")}, 1, null, doc || '/article-' || (2 + 2 * n), 1 from p join n using (doc)
    union all select doc, 'Paragraph', 'paragraph', 4 + 2 * n + k, x, null, null, doc || '/article-' || (2 + 2 * n), 1 from t join n using (doc)
    union all select doc, 'PageFooter', 'footer', 4 + 2 * n + (select count(*) from t where t.doc = n.doc), null, null, null, null, 0 from n),
el as (select *, doc || '/' || pre || '-' || ord as el from e),
x as (select *, lag(el) over w as prev, lead(el) over w as next from el window w as (partition by doc, depth order by ord))"""

_L, _X = "urn:lectern:ontology#", "http://www.w3.org/2001/XMLSchema#"


def quads_sql() -> str:
    def made(subject: str, predicate: str, value: str, source: str, kind: str | None = None) -> str:
        what = f"'literal' as object_kind, '{_X}{kind}' as datatype" if kind else "'iri' as object_kind, null as datatype"
        p = predicate if ":" in predicate else _L + predicate
        return f"select doc as graph, {subject} as subject, '{p}' as predicate, ({value})::varchar as object, {what}, null::varchar as lang from {source} where ({value}) is not null"

    rdf, language = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "nullif(regexp_extract(html, '<html lang=\"([^\"]*)\"', 1), '')"
    rows = [made("doc", rdf, f"'{_L}Document'", "p"), made("el", rdf, f"'{_L}' || cls", "x")]
    of_doc = [("sourceFormat", "'html'", "string"), ("documentHash", "sha256(html)", "string"), ("fileName", "'page-' || page_id || '.html'", "string"), ("fileSize", "octet_length(encode(html))", "integer"), ("language", language, "string"), ("http://purl.org/dc/terms/title", "nullif(title, '')", "string")]
    rows += [made("doc", p, v, "p", t) for p, v, t in of_doc]
    of_element = [("textContent", "text", "string"), ("readingOrder", "ord", "integer"), ("headingLevel", "level", "integer"), ("linkTarget", "target", "string"), ("linkText", "case when cls = 'Hyperlink' then text end", "string")]
    rows += [made("el", p, v, "x", t) for p, v, t in of_element]
    rows += [made("el", p, v, "x") for p, v in (("parentElement", "parent"), ("previousElement", "prev"), ("nextElement", "next"))]
    rows += [made("doc", "hasElement", "el", "x"), made("parent", "childElement", "case when parent is not null then el end", "x")]
    return f"with {PAGE_ELEMENTS} {' union all '.join(rows)}"


@register(quads_sql())
def quads_of_pages(spark, d):
    return to_quads(pages(spark, d))


# enrichment, validation, chunks


@register("select doc_id, source, quality, toxic from documents left join labels using (doc_id)")
def quality_join(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "source", "quality", "toxic")


@register("select doc_id::varchar as el, doc_id || '/provenance-' || (row_number() over (partition by quality order by doc_id) - 1) as provenance from labels")
def provenance_rows(spark, d):
    rows = table(spark, d, "labels").select(F.col("quality").cast("string").alias("doc"), F.col("doc_id").cast("string").alias("el"), F.col("doc_id").alias("ord"), F.col("toxic").cast("float").alias("confidence"))
    return enrich.provenance(rows).select("el", "provenance")


@register("select count(*)::bigint as succeeded, 0::bigint as failed, 0 as exit_code from pages")
def conversion_tallies(spark, d):
    return enrich.tallies(pages(spark, d, store=False).docs)


@register("select 0::bigint as n from region limit 1")
def validate_pages(spark, d):
    return validate.validate(pages(spark, d)).agg(F.count(F.lit(1)).alias("n"))


@register("with t as (select conv_id::varchar as doc, conv_id || '-' || turn as node, turn, lag(turn) over (partition by conv_id order by turn) as p from conversations) select doc, node, 'reading order is contiguous from 0' as rule from t where turn - coalesce(p, -1) <> 1")
def validate_conversations(spark, d):
    return validate.validate(conversation_frames(spark, d))


@register("select group_iri, doc, language, first from (select 'urn:lectern:translation:' || source as group_iri, doc_id::varchar as doc, lang as language, row_number() over (partition by source order by doc_id::varchar) = 1 as first from documents)")
def translation_groups(spark, d):
    docs = table(spark, d, "documents")
    manifest = docs.select(F.col("source").alias("group"), F.col("lang").alias("language"), F.col("doc_id").cast("string").alias("source"))
    return enrich.translation_groups(manifest, docs.select(F.col("doc_id").cast("string").alias("file_name"), F.col("doc_id").cast("string").alias("doc"), F.lit("Success").alias("status")))


@register()
def chunks_conversations(spark, d):
    return chunking.chunks(conversation_frames(spark, d), chunking.Options(max_tokens=128, overlap=16))


#: Neighbours under the same heading are joined while they fit; headings stay alone.
MERGED = """
with recursive c as (
    select conv_id::varchar as doc, turn, role = 'system' as head, text, last_value(case when role = 'system' then text end ignore nulls) over w as crumb from conversations
    window w as (partition by conv_id order by turn rows between unbounded preceding and current row)),
o as (select doc, head, case when head then null else crumb end as crumb, case when head or crumb is null then text else '# ' || crumb || chr(10) || chr(10) || text end as text,
    row_number() over (partition by doc order by turn) as i from c where head or trim(text) <> ''),
k as (
    select doc, i, 0 as chunk, text, head, crumb from o where i = 1
    union all
    select o.doc, o.i, case when fits then k.chunk else k.chunk + 1 end, case when fits then k.text || chr(10) || chr(10) || o.text else o.text end, o.head, o.crumb
    from k join o on o.doc = k.doc and o.i = k.i + 1,
    lateral (select not k.head and not o.head and k.crumb is not distinct from o.crumb and octet_length(encode(k.text || chr(10) || chr(10) || o.text)) <= 4 * 600 as fits))
select doc, chunk as chunk_index, max_by(text, i) as text from k group by doc, chunk
"""


@register(MERGED)
def chunks_merged(spark, d):
    """Neighbours are merged up to the budget; a text beyond it stays whole, cuts are those of ``chunks_cut``."""
    return chunking.chunks(conversation_frames(spark, d), chunking.Options(max_tokens=600, cut=False)).select("doc", "chunk_index", "text")


@register(
    """
    with n as (select conv_id::varchar as doc, turn, regexp_replace(translate(text, ' ' || chr(10) || chr(9), '___'), '[^\\x00-\\x7F]', 'x', 'g') as text from conversations),
    k as (select doc, turn, unnest(range(0, greatest(1, ceil(length(text) / 40.0)::int))) as i, text from n)
    select doc, (row_number() over (partition by doc order by turn, i) - 1)::int as chunk_index, substr(text, i * 40 + 1, 40) as text from k
    """
)
def chunks_cut(spark, d):
    """Texts without white space are cut hard, without overlap; each turn is a document's own run of headings."""
    f = conversation_frames(spark, d)
    solid = F.regexp_replace(F.translate("text", " \n\t", "___"), r"[^\x00-\x7F]", "x")
    el = f.elements.withColumn("text", solid).withColumn("cls", F.lit("SectionHeader")).withColumn("level", F.lit(1))
    return chunking.chunks(f.with_(elements=el), chunking.Options(max_tokens=10, overlap=0)).select("doc", "chunk_index", "text")


@register(
    "select conv_id, turn::int as n, (row_number() over (order by conv_id, turn) - 1)::bigint as chunk_index from conversations"
)
def chunks_renumbered(spark, d):
    """Numbers across documents, from numbers within each."""
    c = table(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    own = c.select("conv_id", F.col("turn").cast("int").alias("n"), (F.row_number().over(w) - 1).alias("chunk_index"))
    return chunking.renumber(own, ["conv_id"]).select("conv_id", "n", "chunk_index")


@register()
def chunks_pages(spark, d):
    return chunking.chunks(pages(spark, d))


# documents of every format, made from the tables
from lectern.plans import catalog_documents, catalog_functions  # noqa: E402, F401
