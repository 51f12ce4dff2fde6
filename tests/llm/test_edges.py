"""Every query on empty tables, and on rows of nulls, blanks, repeats and clashing columns."""

from __future__ import annotations

import pytest

import corpus_pipeline
from passagekit.llm import queries

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, fp bigint, ids string, items int, kind int"
ROWS = [
    (None, None, None, None, None), (1, None, None, "s", 0), (2, "", None, "s", 0), (3, " \n\t", None, None, 3), (4, "...", None, "s", 3), (5, "x", None, "s", 1),
    (6, "the same words again and again and once more for luck here", None, "s", 1), (6, "the same words again and again and once more for luck here", None, "s", 1),
    (7, "\x00 ퟿ 漢字 \U0001f600 é", None, "s", 1), (8, "word " * 60_000, None, "s", 1), (9, "x" * 70_000, None, "s", 1),
]


TURNS = [(None, None, None, None, 1), (1, None, "user", "", 1), (1, 0, None, None, 1), (2, 5, "user", "word " * 60_000, 1), (2, 5, "user", "word " * 60_000, 1), (2, 9, "", "?", 1)]


def save(spark, path, rows, labels=(), pages=(), items=(), turns=()):
    spark.createDataFrame([(*r, 0.5, 1, "i", 2, 3) for r in rows], DOCUMENTS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(pages), "page_id bigint, url string, html string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame(list(items), "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(list(turns), "conv_id bigint, turn bigint, role string, text string, cost int").write.parquet(f"{path}/conversations.parquet")
    return str(path)


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    empty = save(spark, tmp_path_factory.mktemp("empty"), [])
    odd = save(spark, tmp_path_factory.mktemp("odd"), ROWS, [(None, 1, 1), (5, None, None), (77, 1, 0)], [(None, None, None), (1, "u", ""), (1, "u", "")], [(None, None), (1, ""), (2, "luck here")], TURNS)
    return empty, odd


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_on_odd_and_empty_tables(spark, folders, name):
    empty, odd = folders
    assert queries.QUERIES[name](spark, empty).collect() == []
    rows = queries.QUERIES[name](spark, odd).collect()
    assert len(rows) == {"op8_warc": 3, "op13_conversations": 3}.get(name, len(ROWS))
    for r in rows:
        for c in ("score", "near_edited", "near_next"):
            if c in r.__fields__ and name != "op10_interpolation":
                assert 0 <= r[c] <= 1
    if name == "op1_segmentation":
        assert all(r.lang_pred == "und" for r in rows)  # nothing to learn from
    if name == "op5_winnowing":
        assert [r.n_items for r in rows if r.doc_id == 6] == [1, 1]
    if name == "op4_simhash":
        assert {r.component_id for r in rows if r.fingerprint == "0" * 16} == {1}


def test_pipeline_on_odd_and_empty_tables(spark, folders):
    empty, odd = folders
    assert corpus_pipeline.run(spark, empty).collect() == []
    assert corpus_pipeline.run(spark, odd).count() == 0  # no language is known
