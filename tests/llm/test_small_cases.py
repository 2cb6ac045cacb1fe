"""Odd input of every operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing extra columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from modsplit_spark.llm import decontamination, html_template, language_id, packing, sharding, simhash, substring_dedup, toxicity, url_filter, webp

LONG = " ".join(f"w{i % 977}x{i % 131}" for i in range(30_000))
TEXTS = [(1, "a b c d e f"), (2, None), (3, ""), (4, LONG), (5, "a b c d e f"), (5, "a b c d e f"), (None, "left alone"), (6, "  \n\t "), (7, "é" * 3000)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0, "x", 1, 2, 3) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string, slot int, host int, places int")


OPERATORS = {
    "sharding": lambda s, d: sharding.shard_documents(d),
    "media": lambda s, d: webp.media_digest(d),
    "packing": lambda s, d: packing.pack(d),
    "language": lambda s, d: language_id.identify_held_out(d),
    "toxicity": lambda s, d: toxicity.score_held_out(d, s.createDataFrame([(1, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int")),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "substring": lambda s, d: substring_dedup.dedup_substrings(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_once(spark, docs, name):
    got = OPERATORS[name](spark, docs).collect()
    if name == "packing":
        wanted = sum(r["doc_tokens"] for r in got if r["start"] == 0)
        assert sum(r["length"] for r in got) == wanted and sum(r["start"] == 0 for r in got) == len(TEXTS)
    else:
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in TEXTS)
    assert OPERATORS[name](spark, docs.limit(0)).collect() == []


def test_pages_and_urls(spark):
    rows = [(1, "http://A.NET/x", "<article><p>a&amp;b<br> c</p></article><footer>f</footer>", 9), (1, None, None, 9), (2, "no scheme", "", 9), (None, "x://h?q", "<p>only", 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in html_template.extract_main_text(pages).collect()) == [("1", "", 0), ("1", "a&b c", 5), ("2", "", 0), ("None", "only", 4)]
    assert html_template.extract_main_text(pages.limit(0)).collect() == []
    rules = spark.createDataFrame([("net", "/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    got = {(str(r["page_id"]), r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, rules).collect()}
    assert got == {("1", "a.net", "/x", "net/", "block"), ("1", "", "", None, "allow"), ("2", "", "", None, "allow"), ("None", "h", "", None, "allow")}
    assert url_filter.judge_urls(pages, rules.limit(0)).where("verdict = 'allow'").count() == 4
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


def test_leaks_of_odd_tables(spark, docs):
    items = spark.createDataFrame([(1, "a b c d e f", 1), (1, "a b c d e f", 1), (2, None, 1), (3, "", 1), (4, "too short", 1)], "item_id long, text string, doc_id int")
    got = decontamination.find_leaks(docs, items).collect()
    assert sorted((r["doc_id"], r["item_id"], r["edits"]) for r in got) == [(1, 1, 0)] * 2 + [(5, 1, 0)] * 4
    assert decontamination.find_leaks(docs, items.limit(0)).count() == 0 and decontamination.find_leaks(docs.limit(0), items).count() == 0
    assert decontamination.find_leaks(docs, items, items_per_block=1).count() == 6
    short = spark.createDataFrame([(1, "LEFT", 1), (2, "alone left", 1), (3, "b c.", 1), (3, " !? ", 1)], "item_id long, text string, item int")
    assert sorted((str(r["doc_id"]), r["item_id"], r["start_word"]) for r in decontamination.find_leaks(docs, short).collect()) == [("1", 3, 1), ("5", 3, 1), ("5", 3, 1), ("None", 1, 0)]


def test_stages_keep_columns_and_null_ids(spark, docs):
    for stage in (simhash.keep_one, substring_dedup.cut_repeats, lambda d: toxicity.keep_clean(d, toxicity.train([], np.zeros(0, int)))):
        kept = stage(docs)
        assert kept.columns == docs.columns and kept.where(F.col("doc_id").isNull()).count() == 1
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == {1, 2, 4, 7, None}
