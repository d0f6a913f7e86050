"""Data beyond limits that operators must not have: long chains, late amounts, many corrections, gaps in bands."""

from pyspark.sql import functions as F

from gavelwork.operators import extract, layout, learning, ordered, quality
from gavelwork.session import shared_base


def test_a_chain_of_two_hundred_links_settles(spark):
    edges = spark.createDataFrame([(i, f"h{i}") for i in range(200)] + [(i + 1, f"h{i}") for i in range(200)] + [(900, "alone")], "node long, hub string")
    got = {r["node"]: r["label"] for r in ordered.components(edges, spark).collect()}
    assert got == {**{i: 0 for i in range(201)}, 900: 900}


def test_the_oldest_of_many_corrections_still_counts(spark):
    rows = [(i, 1, "provincia", f"valor {i}", "palabras comunes " + " ".join(f"clave{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for _ in "x"), i) for i in range(2000)]
    corrections = spark.createDataFrame(rows, "id long, pais int, campo string, valor_nuevo string, contexto string, creado_en long")
    notices = spark.createDataFrame([(1, 1, None, "relleno " * 900 + rows[0][4])], "id long, pais int, provincia string, text string")
    got = learning.apply_learning(notices, corrections, ["provincia"]).collect()
    assert [(r["aviso_id"], r["valor"], r["correccion_id"]) for r in got] == [(1, "valor 0", 0)]


def test_an_amount_far_behind_its_docket(spark):
    text = "EXPEDIENTE 12345-2020 " + "relleno " * 2500 + "la base del remate, es decir la suma de B/. 12,500.00"
    df = spark.createDataFrame([(text, "12345-2020")], "text string, expediente string")
    assert float(df.select(extract.base_after_docket(F.col("text"), F.col("expediente")).alias("b")).first()["b"]) == 12500.0


def test_statistics_are_not_cut(spark):
    df = spark.createDataFrame([(1, f"EXPEDIENTE: {1000 + i}-20") for i in range(70)], "country int, text string")
    assert quality.country_statistics(df).filter("kind = 'expediente'").count() == 70


def test_bands_are_cut_at_gaps_and_headless_spans_rejoin(spark):
    def span(y, words):
        return [("b", y, y + 10, 10 * i, w) for i, w in enumerate(words)]

    filler = [f"palabra{i}" for i in range(12)]
    rows = span(0, ["AVISO", "DE", "REMATE", *filler]) + span(60, filler) + span(5000, ["AVISO", "DE", "REMATE", *filler]) + span(9000, ["corto"])
    df = spark.createDataFrame(rows, "band string, y0 long, y1 long, x0 long, text string")
    got = layout.band_segments(df, ["band"]).orderBy("segmento").collect()
    assert [(r["segmento"], r["palabras"], r["y0"], r["y1"]) for r in got] == [(0, 27, 0, 70), (1, 16, 5000, 9010)]


def test_shared_folder_is_not_machine_local(spark):
    base = shared_base(spark)
    assert base == spark.conf.get("spark.checkpoint.dir", None) or base.startswith(spark.conf.get("spark.sql.warehouse.dir"))


def test_notices_that_follow_do_not_hide_an_amount(spark):
    text = "AVISO DE REMATE EXP 4567-2020 base del remate B/. 12,500.00 " + "x" * 7000 + " AVISO DE REMATE EXP 1-2020 base B/. 900,000.00 " + "y" * 50 + " AVISO DE REMATE EXP 2-2020 suma B/. 800,000.00"
    df = spark.createDataFrame([(text, "4567-2020"), ("AVISO DE REMATE EXP 77-2020 sin monto AVISO DE REMATE EXP 3 base B/. 5,000.00", "77-2020")], "text string, expediente string")
    assert [r["b"] for r in df.select(extract.base_after_docket(F.col("text"), F.col("expediente")).alias("b")).collect()] == [12500.0, None]
