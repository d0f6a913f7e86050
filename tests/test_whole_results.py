"""Results that must be whole and equal to their SQL where the input is long, repeated or odd."""

import json
import random
import re

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gavelwork.operators import matching
from gavelwork.plans import inputs


def test_a_window_is_chosen_as_its_sql_does(spark, tmp_path):
    """A late short window of a long text, empty texts, one id twice, white space and letters that only one of the engines takes for such."""
    pad = " ".join(["palabra"] * 2500)
    rows = [(1, "casa " + pad + " casa x"), (2, pad + " aviso de remate " + pad + " casa"), (3, None), (4, " \n\t "), (5, "uno dos"), (6, "x casa y"), (6, "casa casa z"),
            (None, "lote"), (7, pad + "\x0bfinca " + "a\x0bcon\x0bcedula b " + pad), (8, pad + " fınca FİNCA " + pad + " con cedula " + pad + " finca"),
            (9, pad + " mediana método " + pad), (10, pad + " de aproximadamente " + pad), (11, pad + " lote " + pad), (12, pad + " ſubasta judicial")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(entry.oracle_sql()["win16_best_window"]).fetchall()
    got = [tuple(r) for r in entry.queries()["win16_best_window"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_a_place_of_a_text_costs_its_own_digits(spark):
    """Digits are cut out of bytes, and what is exchanged went through a table of whole dockets."""
    texts = spark.createDataFrame([(1, "x 100-2001 y 55-2001 " + "3" * 2000)], "document_id long, text string")
    found = matching.docket_anchors(texts, spark.createDataFrame([("100-2001",), ("56-2001",)], "expediente string"))
    p = found._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"regexp_replace\(text#\d+, \\D\+, , 1\) as binary", p) and p.count("bit_or(") == 2
    assert [(r["expediente"], r["document_id"], r["at"]) for r in found.collect()] == [("100-2001", 1, 1)]


def _regions(texts, dockets):
    """Plain Python: a docket's first place in a document's digits, the page of its first digit, the first place in that page's digits, block or line there."""
    out = []
    for doc, text in texts:
        marks = [(m.start(), m.end(), m.group()) for m in re.finditer(r"\n?--- PÁGINA \d+ ---\n?", text)]
        cuts = [0, *[b for _, b, _ in marks]], [*[a for a, _, _ in marks], len(text)], [1, *[int(re.search(r"\d+", m).group()) for _, _, m in marks]]
        places = [i for i, c in enumerate(text) if c in "0123456789"]
        for docket in dockets:
            want = re.sub(r"\D", "", docket)
            k = "".join(text[i] for i in places).find(want)
            for a, b, page in zip(*cuts):
                if k >= 0 and a <= places[k] < b and text[a:b].strip(" "):
                    own = [i for i, c in enumerate(text[a:b]) if c in "0123456789"]
                    j = "".join(text[a:b][i] for i in own).find(want)
                    if j >= 0:
                        pos, end, t = own[j], own[j + len(want) - 1] + 1, text[a:b]
                        starts = [m.start() for m in re.finditer(r"(?m)^\s*(?:EJ|DIV)\s*\.", t)]
                        held = [(x, y) for x, y in zip(starts, [*starts[1:], len(t)]) if x <= pos < y]
                        x, y = held[0] if held else (t.rfind("\n", 0, pos) + 1, len(t) if t.find("\n", end) < 0 else t.find("\n", end))
                        out.append((docket, doc, page, x, y, t[x:y]))
    return sorted(out)


def test_regions_read_their_texts_twice(spark):
    rng = random.Random(9)
    dockets = ["12", "1-23", "2012-0053", "31", "3 1 2", "777777"]
    bits = [*dockets, "\n", "EJ . ", "\nEJ. ", "\n DIV .", "palabra ", "ñ😀 ", "\n--- PÁGINA 12 ---\n", "--- PÁGINA 3 ---", " 7", "1", "x" * 300]
    texts = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 60)))) for i in range(80)] + [(100, "777" + "x" * 2000 + "\n--- PÁGINA 777 ---\n" + "777777")]
    df = spark.createDataFrame(texts, "document_id long, text string").withColumn("text", F.overlay("text", F.lit(""), F.lit(1), F.lit(0)))
    got = matching.anchored_regions(df, spark.createDataFrame([(x,) for x in dockets], "expediente string"))
    assert 1 <= got._jdf.queryExecution().optimizedPlan().toString().count("overlay(") <= 2
    assert sorted(tuple(r) for r in got.collect()) == _regions(texts, dockets)


def test_regions_of_dockets_that_the_sql_looks_up(spark, sf, tmp_path):
    """The SQL takes dockets of nine digits; those of orders from 90,000 on have ten."""
    for t in ("customer", "orders"):
        spark.read.parquet(f"{sf}/{t}.parquet").withColumns({"o_orderkey": F.expr("o_orderkey % 16 + 89992")} if t == "orders" else {}).limit(16 if t == "orders" else 10**6).write.parquet(f"{tmp_path}/{t}.parquet")
    got = entry.queries()["joi10_anchored_regions"](spark, str(tmp_path)).select("expediente").distinct().collect()
    assert got and {len(re.sub(r"\D", "", r["expediente"])) for r in got} == {9}


def test_an_annotation_is_written_without_a_struct_for_each_letter(spark, tmp_path):
    text = 'a"b \\ c\x01d \x7f 😀😀x ñandú $0 {x} \'q\' z'
    spark.createDataFrame([(1, text), (2, " \n "), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = inputs.annotations(spark, str(tmp_path))
    assert "pages, array(" not in made._jdf.queryExecution().optimizedPlan().toString()
    rows = made.collect()
    words = json.loads(rows[0]["annotation"])["pages"][0]["blocks"][0]["paragraphs"][0]["words"]
    assert len(rows) == 1 and [[s["text"] for s in w["symbols"]] for w in words] == [list(w) for w in text.split()]
    assert [w["symbols"][-1]["property"]["detectedBreak"]["type"] for w in words] == ["SPACE"] * 7 + ["LINE_BREAK"] + ["SPACE"] * (len(words) - 8)
    assert all("property" not in s for w in words for s in w["symbols"][:-1])
    got = {r["word_no"]: r["text"] for r in inputs.ocr_words(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(text.split()))
