"""The pipeline's stages and the registered queries."""

import corpus_pipeline as cp
import pytest
from harness import compare, connect

from gavelwork.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, sf, name):
    rows, problem = compare(spark, connect(sf), sf, name, queries.QUERIES[name], queries.ORACLES[name])
    assert problem is None and rows


def test_stages_keep_columns_and_their_decisions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        path_ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert path_ids and path_ids <= ids, name
        ids, docs = path_ids, cp.stored(out, "test")
    pieces = cp.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == ids


def test_stages_take_empty_tables_and_nulls(spark, docs):
    rows = docs([(1, None), (2, ""), (3, "12 !!"), (4, "some words here and there"), (4, "some words here and there"), (None, "more words than that in here")])
    assert sorted(str(r["doc_id"]) for r in cp.language(spark, rows, "").collect()) == ["4", "4", "None"]
    for _, stage in cp.STAGES:
        assert stage(spark, rows.limit(0), "").count() == 0
    assert cp.near_duplicates(spark, rows, "").count() == 5


def test_copies_leave_one_document_with_its_text(spark, docs):
    text = "\n".join(f"copied {w} line of one and the same page" for w in ("first", "second", "third"))
    rows = docs([(i, text if i < 20 else f"page {i * 7919} has words{i} of{i} its{i} own{i}\nand line{i} number{i} two{i} here{i}", None, "s") for i in range(60)])
    for name, stage in cp.STAGES[:-1]:
        rows = cp.stored(stage(spark, rows, ""), "test")
        if name == "ngram jaccard join":
            assert [r["text"] for r in rows.collect() if r["doc_id"] < 20] == [text]
            assert rows.count() == 41
    packed = {r["doc_id"] for r in cp.STAGES[-1][1](spark, rows, "").select("doc_id").collect()}
    assert len([d for d in packed if d < 20]) == 1 and len(packed) == 41


def test_small_sources_lose_their_footers(spark, docs):
    rows = [(i, f"own text {i}\nfooter", None, "nine") for i in range(9)] + [(100 + i, f"own text {i}" + "\nshared" * (i < 9), None, "fifty") for i in range(50)]
    rows += [(200 + i, f"own text {i}\nboth", None, "two") for i in range(2)]
    got = {r["doc_id"]: r["text"] for r in cp.lines(spark, docs(rows), "").collect()}
    assert got == {d: t if source == "two" else t.split("\n")[0] for d, t, _, source in rows}
