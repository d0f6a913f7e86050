"""What must not grow faster than the input: words that stay where their document is, state that is read once a batch."""

import re

import pytest
from pyspark.sql import functions as F

from gavelwork.plans import inputs, layout as pages
from gavelwork.sources import views as v
from gavelwork.streaming import memory


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", ["lines", "blocks", "segments", "reading", "packed"])
def test_words_stay_with_their_document(spark, sf, query):
    assert len(re.findall(r"Exchange ", plan(getattr(pages, query)(spark, sf)))) == 1


@pytest.mark.parametrize("query", ["lines_first", "gutters"])
def test_joined_words_stay_with_their_document(spark, sf, query):
    p = plan(getattr(pages, query)(spark, sf))
    assert len(re.findall(r"Exchange ", p)) == len(re.findall(r"Exchange hashpartitioning\((?:page|doc_id)#\d+L, \d+\), REPARTITION_BY_NUM", p)) + p.count("BroadcastExchange ")


def test_an_annotation_takes_no_exchange_of_words(spark, sf):
    p = plan(inputs.ocr_words(spark, sf))
    assert "hashpartitioning" not in p and "Aggregate" not in p
    assert inputs.ocr_words(spark, sf).count() == v.palabras(spark, sf).count()


def test_a_batch_of_the_memory_writes_its_own_entries_only(spark):
    some = lambda a, b: spark.range(a, b).selectExpr("id", "CAST(id % 7 AS STRING) AS expediente", "CAST(id AS STRING) AS finca", "CAST(NULL AS STRING) AS base", "'x' AS bbox")
    seen = memory.DuplicateMemory(spark)
    for a, b in ((0, 500), (500, 520)):
        seen.run(some(a, b)).count()
    written = {r["batch"]: r["count"] for r in seen._entries().groupBy("batch").count().collect()}
    assert written == {0: 500 * 6, 1: 20 * 6}
    assert seen.exported().filter("k = 'bbox'").select("first", "last").collect() == [(0, 519)]


def test_many_publications_of_one_property_in_one_lot(spark):
    lot = spark.range(20_000).select("id", F.lit("a").alias("clave"), F.expr("date_add(DATE'2024-01-01', CAST(id div 4000 AS INT))").alias("fecha"), F.lit("1").alias("base"))
    job = memory.Republications(spark)
    assert {r["resultado"]: r["count"] for r in job.run(lot).groupBy("resultado").count().collect()} == {"reemplazado": 19_999}
    assert [r["id"] for r in job.open().collect()] == [19_999]
    assert not spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider")


def test_few_rules_and_many_give_the_same_and_few_exchange_no_text(spark, monkeypatch):
    from gavelwork.operators import learning as ln

    texts = spark.range(300).selectExpr("id AS document_id", "concat('EXPEDIENTE ', id, IF(id % 3 = 0, ' finca 77', ''), ' x') AS text")
    rules = spark.createDataFrame([(i, f, p, "approved", 0.9, i) for i, (f, p) in enumerate([("e", "expediente ([0-9]+)"), ("f", "FINCA ([0-9]+)"), ("f", "x$"), ("g", "nada")])],
                                  "rule_id int, field_name string, pattern string, status string, confidence double, created_at int")
    few = ln.apply_rules(texts, rules)
    assert "tri#" not in plan(few)
    monkeypatch.setattr(ln, "FEW", 0)
    many = ln.apply_rules(texts, rules)
    assert "tri#" in plan(many) and sorted(few.collect()) == sorted(many.collect()) and few.count() == 600


def test_blocks_of_duplicates_travel_as_digests(spark):
    from gavelwork.operators import dedup

    rows = [(1, "a", "f", None, None, "T"), (2, "a", "f", None, None, "U"), (3, None, "f", None, None, "t"), (4, None, None, None, None, "t"), (5, "b", "c", "d", "e", "")]
    d = dedup.duplicate_levels(spark.createDataFrame(rows, "id long, expediente string, finca string, base string, bbox string, text string"))
    assert "unhex" in plan(d)
    assert {r["id"]: (r["nivel"], r["matched_id"]) for r in d.collect()} == {
        1: ("UNIQUE", None), 2: ("DUPLICATED", 1), 3: ("DUPLICATED", 1), 4: ("UNIQUE", None), 5: ("UNIQUE", None)}


def test_parts_of_notices_follow_their_number(spark, sf, monkeypatch):
    monkeypatch.setattr(v, "ROWS_A_TASK", 100)
    parts = -(-v.table(spark, sf, "orders").count() // 100)
    assert parts > 8 and v.notices(spark, sf).rdd.getNumPartitions() == parts


def test_a_place_name_reads_a_run_of_letters_once(spark):
    import time

    from gavelwork.operators import notice_text as nt

    rows = [(0, "Lote de 100 M2 " + "mas texto " * 20_000), (1, "x 5 M2, LAGO AZUL, CORR: ARENA, DIST: CENTRO, fin"), (2, "7 M2 . Villa 9 Sol CORR: ARENA DISTRITO B,"), (3, "5 M2  CORR: A B, z"), (4, None)]
    began = time.time()
    got = {r["id"]: r["portada"] for r in nt.cover_description(spark.createDataFrame(rows, "id int, text string")).select("id", "portada").collect()}
    assert time.time() - began < 60
    assert got[0] == " ".join(["Lote", "de", "100", "M2"] + ["mas", "texto"] * 13) + "." and got[4] == ""
    assert [got[1], got[2], got[3]] == ["5 M2, LAGO AZUL, CORR: ARENA, DIST: CENTRO.", "7 M2, Sol, CORR: ARENA, DIST: B.", "5 M2, A B, CORR: A B."]


def test_dockets_of_one_ending_meet_whole(spark):
    from gavelwork.operators import matching

    dockets = spark.range(10, 3010).selectExpr("concat(id, '0001-1999') AS expediente")
    texts = spark.range(10, 3010).selectExpr("id AS document_id", "concat('x ', id, '0001-1999 y ', id, '0001-1999') AS text")
    found = matching.docket_anchors(texts, dockets)
    joins = [x for x in plan(found).splitlines() if "Join" in x]
    assert not any("fp#" in x for x in joins) and any("_t#" in x for x in joins)
    assert found.filter("at = 1").count() == 3000


def test_contained_documents_exchange_no_words_and_equal_brute_force(spark):
    import random

    from gavelwork.operators import matching

    r = random.Random(15)
    common, rare = [f"COMUN{i}" for i in range(12)], [f"RARA{i}" for i in range(400)]
    docs = [(r.choice(["x", "y"]), i, r.sample(common, r.randint(0, 5)) + r.sample(rare, r.choice([0, 0, 1, 30])) * 2) for i in range(300)]
    docs += [(p, 300 + i, sorted(set(w), reverse=True)) for i, (p, _, w) in enumerate(docs[:40])] + [(None, 400, ["UNA"]), (None, 401, ["UNA"]), (None, 402, ["UNA", "DOS"])]
    got = matching.contained_documents(spark.createDataFrame(docs, "page string, doc_id long, words array<string>"))
    assert not re.search(r"hashpartitioning\([^)]*\bw#", plan(got)) and "array_except" not in plan(got)
    sets = {}
    for p, i, w in docs:
        if w:
            sets.setdefault((p, frozenset(w)), []).append(i)
    want = [(p, min(x), min(y), len(v), len(x), len(y)) for (p, v), x in sets.items() for (q, w), y in sets.items() if p is not None and p == q and v < w]
    want += [(p, min(x), min(x), len(v), len(x), len(x)) for (p, v), x in sets.items() if len(x) > 1]
    cols = ["page", "a", "b", "n", "copias_a", "copias_b"]
    assert sorted(map(str, want)) == sorted(str(tuple(x)) for x in got.select(cols).collect()) and len(want) > 500


def test_expressions_count_chunks_of_frequent_words_and_equal_brute_force(spark):
    import random
    from collections import Counter

    from gavelwork.operators import quality as q

    r = random.Random(24)
    words = ["AVISO", "REMATE", "FINCA", "JUZGADO", "ÑANDÚ", "BASE"]
    name = lambda i: "".join("ABCDEFGHIJ"[int(c)] for c in f"{i:06d}")
    rows = [(r.choice(["PA", "CO", None]), " 12, ".join(r.choice(words) if r.random() < 0.9 else name(i) for _ in range(r.randint(0, 23)))) for i in range(400)]
    rows += [("PA", None), ("CO", "de la"), ("CO", "UNO"), ("CO", "aviso remate")]
    for sizes in ((2, 3, 4), (1, 3)):
        want = Counter()
        for c, t in rows:
            w = re.findall("[A-ZÁÉÍÓÚÑ]{3,}", (t or "").upper())
            want.update((c, " ".join(w[i:i + n])) for n in sizes for i in range(len(w) - n + 1))
        got = q.expressions(spark.createDataFrame(rows, "country string, text string"), 8, sizes)
        assert "LeftSemi" not in plan(got)
        assert {(x["country"], x["expresion"]): x["n"] for x in got.collect()} == {k: n for k, n in want.items() if n >= 8}
