"""Small tables for the tests of the operators."""

import random

SCHEMA = "text string, TEXT int, doc_id long, Doc_Id string, key string, crc string, start string, lang string, source string, n_chars long"
WORDS = "the a of river stone quiet lantern walks over seven hills and back again under moon".split()


def table(spark, pairs, langs=None):
    """documents with (doc_id, text), whose other columns clash with names of ours."""
    rows = [(t, 7, i, "x", "k", "c", "s", None if langs is None else langs[n], "src", None if t is None else len(t)) for n, (i, t) in enumerate(pairs)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed, words):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", str(rng.randrange(50))]) for _ in range(words))


def random_texts(seed, n, alphabet="ab ", most=60):
    rng = random.Random(seed)
    return [(k, "".join(rng.choice(alphabet) for _ in range(rng.randrange(most)))) for k in range(n)]


LONG = prose(1, 30_000)
#: Nulls, empty and blank texts, ties, repeated rows, multi-byte letters, a very long text, a null id.
EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "Äpfel über 🍎 " * 30), (5, "Äpfel über 🍎 " * 30), (6, LONG), (7, LONG + " end"), (7, LONG + " end"), (None, "no id " + prose(2, 80)), (None, None), (8, "x"), (9, prose(2, 80))]


def by_id(rows, *columns):
    return sorted((tuple(r[c] for c in columns) for r in rows), key=lambda x: tuple((v is None, str(type(v)), v if v is not None else 0) for v in x))


def documents_of(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
