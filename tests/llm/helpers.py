"""Awkward documents that every operator must take: nulls, empty and long texts, repeated rows, clashing further columns."""

import os

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LONG = "Long words and long text, again and again: 1234 5678. " * 8000
TEXTS = [None, "", " ", "!!!", "Hello  World's 2024", "the same text of seven words here", "the same text of seven words here", LONG, "é ΣΑΣ İx ½ ｗｉｄｅ", "a" * 5000]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, ids string, node string, key string, n_tokens string, rank string"


def odd_documents(spark):
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "src1", len(t or ""), 0.5, "x", "y", "z", "n", "r") for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[5], (None, "no id", None, None, 5, None, None, None, None, None, None), (None, "no id", None, None, 5, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(name="documents"):
    import duckdb

    return duckdb.connect().execute(f"SELECT doc_id, text FROM '{DATA}/{name}.parquet'").fetchall()
