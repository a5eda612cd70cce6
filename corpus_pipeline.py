"""Corpus pipeline: language, near duplicates, benchmark decontamination, personal data, encoding.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns the columns of
``documents``; the last returns digests of the encoded texts.  Stages are written and read again one by one.

Rows without doc_id cannot be named by the decisions of the second and third stage and pass them; every other
stage treats them like all rows.  Null texts have no letter and go in the first stage.  An empty table passes
all stages as an empty table.  Other columns than those of ``documents`` are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, decontaminate, language, pii, resemblance
from lectern.llm.common import cut, pick, table
from lectern.llm.queries import vocabulary
from lectern.llm.substring import NO_ID

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def columns(docs: DataFrame) -> DataFrame:
    return pick(docs, **{name: (name, kind) for name, kind in COLUMNS.items()})


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows of its input; texts that the model rejects go."""
    docs = columns(docs)
    model = language.train(docs)
    return language.identify(docs, model, keep=True).filter(~F.col("rejected")).select(*COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose five-word shingles have Jaccard similarity 0.8 or more are linked.

    Of each group of linked documents one stays: of the smallest doc_id, null last, the text of the smallest hash.
    """
    docs = columns(docs)
    kept = resemblance.kept(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_key"), F.col("code").alias("_code"))
    keys = docs.withColumn("_key", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("_code", F.xxhash64("text"))
    once = keys.groupBy("_key", "_code").agg(F.min(F.struct(*COLUMNS)).alias("row"))
    return once.join(kept, ["_key", "_code"], "left_semi").select("row.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    docs = columns(docs)
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*COLUMNS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are marked by kind, revealing terms generalised or removed; n_chars counts the new text."""
    return pii.sanitised(columns(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the text decoded from them."""
    return bpe.encode_documents(columns(docs), vocabulary(), ("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("language", known_language),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("encoding", encoded),
]

#: Training, components and merges are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
