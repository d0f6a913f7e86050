"""Readers and writers on real folders."""

import json

from pyspark.sql import functions as F

from gavelwork.operators import splitting
from gavelwork.sources import documents, sinks
from gavelwork.sources import views as v


def test_directory_ingest(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("AVISO DE REMATE uno")
    (tmp_path / "sub" / "b.txt").write_text("dos")
    (tmp_path / "c.txt").write_text("   \n")
    (tmp_path / "d.bin").write_text("no")
    ok, bad = documents.read_directory(spark, str(tmp_path), "PA")
    assert sorted(r["text"] for r in ok.collect()) == ["AVISO DE REMATE uno", "dos"]
    assert [r["error"] for r in bad.collect()] == ["texto vacio"]


def test_golden_file(spark, tmp_path):
    data = {"test_suites": [{"id": "s1", "pais": "PA", "expected_count": 1, "expected_avisos": [{"expediente": "1-26", "demandante": "A", "base": "10.5", "raro": "z"}]}]}
    (tmp_path / "g.json").write_text(json.dumps(data))
    r = documents.read_golden(spark, str(tmp_path)).first()
    assert (r["id"], r["demandante"], r["base"], r["extra"]) == ("1-26", "A", "10.5", {"raro": "z"})


def test_feeds_and_reports(spark, sf, tmp_path):
    a = v.avisos(spark, sf).filter("id < 50")
    sinks.write_feeds(a, str(tmp_path / "feed"))
    pa = spark.read.option("header", True).csv(str(tmp_path / "feed" / "pais=1"))
    assert pa.count() == 25 and pa.columns[:4] == ["pais", "codigo", "expediente", "juzg lugar"] and len(pa.columns) == 22
    sinks.write_reports({"uno": a.groupBy("pais").count()}, str(tmp_path / "rep"))
    assert spark.read.json(str(tmp_path / "rep" / "uno")).count() == 2
    sinks.write_log_lines(a.select("id"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 50


def test_purge_can_keep_learning(spark, sf):
    a, c = v.avisos(spark, sf, parties=False), v.correcciones(spark, sf)
    kept = sinks.purge_country(a, 2, {"auditoria": v.auditoria(spark, sf)}, c, keep_learning=True)
    assert kept["correcciones"].count() == c.count()
    assert kept["avisos"].filter("pais = 2").count() == 0


def test_chunks_cover_the_text_and_overlap(spark):
    text = ("palabra " * 40 + "\n") * 60
    df = spark.createDataFrame([(1, text)], "id long, text string")
    got = splitting.chunk_texts(df, ["id"], limit=4000, overlap=800).orderBy("n").collect()
    spans = [(r["inicio"], r["inicio"] + len(r["trozo"])) for r in got]
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b - a <= 4000 for a, b in spans) and all(y[0] == x[1] - 800 for x, y in zip(spans, spans[1:]))
    assert all(text[b] == "\n" and "\n" not in text[b + 1 : a + 4000] for a, b in spans[:-1])


def test_image_pairs(spark):
    m = spark.createDataFrame([(1, 1, "p1_inf.jpg"), (1, 2, "p1_sup.jpg"), (1, 3, "portada.jpg"), (2, 1, "a.jpg"), (2, 2, "b.jpg"), (2, 3, "c.jpg")],
                              "upload long, orden long, file string")
    got = {(r["upload"], r["pagina"]): (r["top"], r["bottom"], r["full"], r["parcial"]) for r in documents.pair_images(m).collect()}
    assert got == {(1, 1): (None, None, "portada.jpg", False), (1, 2): ("p1_sup.jpg", "p1_inf.jpg", None, False), (2, 1): ("a.jpg", "b.jpg", None, False),
                   (2, 2): ("c.jpg", None, None, True)}


def test_checkpoint_dir_is_read_from_the_session(spark):
    from gavelwork.session import checkpoint_dir
    assert checkpoint_dir(spark)
    assert F is not None


def test_client_reports_are_written(spark, sf, tmp_path):
    from gavelwork.operators.reports import client_reports
    r = client_reports(v.avisos(spark, sf), v.correcciones(spark, sf), v.auditoria(spark, sf))
    sinks.write_reports(r, str(tmp_path))
    assert len(r) == 7
    for name in r:
        assert spark.read.json(str(tmp_path / name)).count() > 0
