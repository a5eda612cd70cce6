"""The corpus pipeline, stage by stage, against the operators' own brute force, and the driver contract."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__
import corpus_pipeline
import pytest

from lectern.llm import language, pii, queries
from lectern.llm.common import table as read

from .test_search import brute_leaks
from .test_resemblance import brute as brute_groups
from .test_text import BPE, brute_base, brute_bpe
from .tools import by_id

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


@pytest.fixture(scope="module")
def stages(spark, sf):
    """What goes into each stage, and what comes out of the last."""
    docs = read(spark, sf, "documents")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        out.append(docs.collect())
        docs = spark.createDataFrame(out[-1], docs.schema)
    return out


def test_language_stage(spark, stages):
    docs = spark.createDataFrame(stages[0])
    found = language.identify(docs, language.train(docs)).collect()
    rejected = {r["doc_id"] for r in found if r["rejected"]}
    assert by_id(stages[1], *COLUMNS) == by_id([r for r in stages[0] if r["doc_id"] not in rejected], *COLUMNS)
    assert len(stages[1]) >= 0.95 * len([r for r in stages[0] if r["text"] and any(map(str.isalpha, r["text"]))])


def test_near_duplicate_stage(stages):
    groups = brute_groups([(r["doc_id"], r["text"]) for r in stages[1]])
    kept = {component for _, component in groups}
    assert by_id(stages[2], *COLUMNS) == by_id([r for r in stages[1] if r["doc_id"] in kept], *COLUMNS)


def test_decontamination_stage(spark, sf, stages):
    items = [(r["item_id"], r["text"]) for r in read(spark, sf, "benchmark").collect()]
    leaks = {doc for doc, _ in brute_leaks([(r["doc_id"], r["text"]) for r in stages[2]], items)}
    assert by_id(stages[3], *COLUMNS) == by_id([r for r in stages[2] if r["doc_id"] not in leaks], *COLUMNS)


def test_personal_data_stage(stages):
    before = {r["doc_id"]: r for r in stages[3]}
    assert {r["doc_id"] for r in stages[4]} == before.keys() and len(stages[4]) == len(stages[3])
    for r in stages[4]:
        old = before[r["doc_id"]]["text"]
        assert r["n_chars"] == len(r["text"])
        mentions = [old[s:e] for kind, s, e in brute_base(old) if kind == "email"]
        assert not any(m in r["text"] for m in mentions)
        assert all(r["text"].count(f"[{k.upper()}]") >= n for k, n in [(k, sum(x[0] == k for x in brute_base(old))) for k in ("email", "ip")])
        if not brute_base(old) and not any(f"[{pii.ADDED.upper()}]" in r["text"] for _ in "x"):
            assert len(r["text"]) <= len(old)


def test_encoding_stage(stages):
    assert by_id(stages[5], *BPE) == brute_bpe([(r["doc_id"], r["text"]) for r in stages[4]])


def test_run_is_the_stages(spark, sf, stages):
    assert by_id(corpus_pipeline.run(spark, sf).collect(), *BPE) == by_id(stages[5], *BPE)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(1, "", "en", "s", 0), (1, "", "en", "s", 0)], [(None, "only words here for all", "en", "s", 1), (3, "only words here for all", None, None, None), (3, "other words here for all", "en", "s", 2)]])
def test_stages_on_small_tables(spark, sf, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, TEXT string, key int")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        made = docs.collect()
        assert len(made) <= len(rows)
        if name != "encoding":
            assert docs.columns == list(COLUMNS)
            docs = spark.createDataFrame(made, docs.schema)


def test_driver_contract():
    made = __spark_entry__.queries()
    assert {"pipeline", *queries.QUERIES} <= made.keys()
    assert [q for q in made if q.startswith("op")] == [f for f in queries.QUERIES]
    assert __spark_entry__.oracle_sql().keys() <= made.keys()


def test_nothing_else_imports_this_subpackage():
    top = Path(__spark_entry__.__file__).parent
    code = "import sys; sys.modules['lectern.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) > 50 and not any(q.startswith('op') for q in e.queries())"
    # without the folders the import fails with their name; a blocked module stands for that
    for p in (top / "lectern").rglob("*.py"):
        if "llm" not in p.relative_to(top).parts:
            assert "lectern.llm" not in p.read_text()
    assert subprocess.run([sys.executable, "-c", code], cwd=top, capture_output=True, timeout=120).returncode == 0
