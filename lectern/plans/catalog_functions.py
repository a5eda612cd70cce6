"""Queries of scalar functions that the other queries do not reach, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.plans.registry import register, table
from lectern.schema import XSD


@register("select page_id, regexp_replace(html, '<[^>]*>?', '', 'g') as text from pages")
def tags_stripped(spark, d):
    return table(spark, d, "pages").select("page_id", T.strip_tags("html").alias("text"))


@register("select n_nationkey, 'key|name;' || n_nationkey || '|' || n_name as rows, replace(n_name, '_', ' ') as plain from nation")
def latex_rows(spark, d):
    body = F.concat(F.lit("\\hline key & name \\\\ "), F.col("n_nationkey"), F.lit("&  "), "n_name", F.lit(" \\\\ \\hline"))
    rows = F.array_join(F.transform(T.tabular_rows(body), lambda r: F.array_join(r, "|")), ";")
    return table(spark, d, "nation").select("n_nationkey", rows.alias("rows"), T.strip_ties(F.replace("n_name", F.lit("_"), F.lit("~"))).alias("plain"))


@register("select n_nationkey, case when n_nationkey % 2 = 0 then n_nationkey || ';' || n_name else n_nationkey || ';;' || n_name || ';' end as cells from nation")
def bar_rows(spark, d):
    line = F.concat(F.lit("|"), F.col("n_nationkey"), F.lit(" | | "), "n_name", F.when(F.col("n_nationkey") % 2 == 1, " |").otherwise(""))
    return table(spark, d, "nation").select("n_nationkey", F.array_join(T.bar_cells(line), ";").alias("cells"))


@register("select n_nationkey, n_nationkey % 3 <> 2 as is_time, n_nationkey * 60.0 + 1.5 as seconds from nation")
def clock_times(spark, d):
    k = F.col("n_nationkey").cast("string")
    told = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lpad(k, 2, "0"), F.lit(":01.5"))).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("0:"), F.lpad(k, 2, "0"), F.lit(":01.500"))).otherwise(F.concat(F.lit("PT"), k, F.lit("M1.5S")))
    return table(spark, d, "nation").select("n_nationkey", T.is_timestamp(told).alias("is_time"), T.duration_seconds(told).alias("seconds"))


@register("select n_nationkey, case when n_regionkey = 0 then n_name else '# ' || r_name || chr(10) || '## ' || n_nationkey || chr(10) || chr(10) || n_name end as text from nation join region on n_regionkey = r_regionkey")
def texts_under_headings(spark, d):
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    none = F.array().cast("array<string>")
    headings = F.when(F.col("n_regionkey") == 0, none).otherwise(F.array("r_name", F.col("n_nationkey").cast("string")))
    return rows.withColumn("headings", headings).select("n_nationkey", T.contextualize("headings", "n_name").alias("text"))


@register("select n_nationkey, ['SectionHeader', 'ListItem', 'PictureElement', 'Paragraph', 'TableElement'][n_nationkey % 5 + 1] as cls from nation")
def label_classes(spark, d):
    labels = F.array(*map(F.lit, ["Section-Header", "list item", "FIGURE", "no such label", "table"]))
    return table(spark, d, "nation").select("n_nationkey", T.region_class(F.element_at(labels, (F.col("n_nationkey") % 5 + 1).cast("int"))).alias("cls"))


@register("select n_nationkey, case when n_nationkey % 2 = 0 then n_nationkey::varchar else n_name end as value, case when n_nationkey % 2 = 0 then 'integer' end as datatype, n_nationkey % 4 = 0 as truth from nation")
def literals_parsed(spark, d):
    typed = F.concat(F.lit('"'), F.col("n_nationkey"), F.lit(f'"^^<{XSD}integer>'))
    term = T.parse_literal(F.when(F.col("n_nationkey") % 2 == 0, typed).otherwise(F.col("n_name")))
    said = F.element_at(F.array(*map(F.lit, ["true", "no", "0", "True"])), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return table(spark, d, "nation").select("n_nationkey", term["value"].alias("value"), term["datatype"].alias("datatype"), T.parse_bool(said).alias("truth"))


@register("select doc_id, nfc_normalize(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as text from documents where text is not null")
def texts_normalized(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", T.normalize_text("text").alias("text"))


@register("select n_nationkey, n_name as asked, 'data:image/png;base64,' || base64(encode(n_name)) as url, 'said ' || n_name as answer, n_nationkey::bigint as tokens from nation")
def vision_messages(spark, d):
    n = table(spark, d, "nation")
    body = T.vision_request("m", F.col("n_name"), F.encode("n_name", "UTF-8"))
    reply = F.concat(F.lit('{"choices":[{"message":{"content":"said '), "n_name", F.lit('"}}],"usage":{"completion_tokens":'), F.col("n_nationkey"), F.lit("}}"))
    got = T.vision_response(reply)
    part = lambda i, p: F.get_json_object(body, f"$.messages[0].content[{i}].{p}")
    return n.select("n_nationkey", part(0, "text").alias("asked"), part(1, "image_url.url").alias("url"), got["text"].alias("answer"), got["tokens"].alias("tokens"))


@register(
    """
    with b as (select doc_id, unnest(string_split(regexp_replace(text, '\\n[ \\t]*\\n', chr(10) || chr(10), 'g'), chr(10) || chr(10))) as b,
        generate_subscripts(string_split(regexp_replace(text, '\\n[ \\t]*\\n', chr(10) || chr(10), 'g'), chr(10) || chr(10)), 1) as k from documents),
    l as (select doc_id, k, array_to_string([trim(x, ' ') for x in string_split(b, chr(10)) if trim(x, ' ') <> ''], ' ') as p from b)
    select doc_id, string_agg(p, '|' order by k) as paragraphs from l where p <> '' group by doc_id
    """
)
def paragraphs_joined(spark, d):
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", T.paragraphs("text").alias("p"))
    return docs.filter(F.size("p") > 0).select("doc_id", F.array_join("p", "|").alias("paragraphs"))
