"""Notices with the shapes of real samples: full, incomplete, edict, client layout, Colombian labels and percentages."""

import pytest
from pyspark.sql import functions as F

from gavelwork.functions import dates, money, names, patterns
from gavelwork.operators import extract, normalize, notice_text as nt, rules

PA_FULL = """AVISO DE REMATE
EXPEDIENTE N° 40112-2026
LA SUSCRITA JUEZ 7 MUNICIPAL CIVIL, POR MEDIO DEL PRESENTE AVISO, HACE SABER:
QUE DENTRO DEL PROCESO EJECUTIVO HIPOTECARIO, SE SEÑALA REMATE PARA LA FINCA N° 611203
BASE: B/.92,500.00
FECHA DE REMATE: 9 DE OCTUBRE DE 2026
DEMANDANTE: INMOBILIARIA DEL ISTMO S.A.
DEMANDADO: MARTA ELENA RIOS"""
PA_INCOMPLETE = "AVISO DE REMATE\nEXPEDIENTE N° 777-26\nDEMANDADO: LUIS SOTO\nsin mas datos"
PA_EDICT = "EDICTO EMPLAZATORIO\nEXPEDIENTE N° 5510-26\nSE EMPLAZA A LOS HEREDEROS\nfirma"
PA_CLIENT = "AVISO DE REMATE\n\nJUZGADO: JUZGADO MUNICIPAL DE PANAMA\nEXPEDIENTE N° 88123-24\nDEMANDANTE: BANCO DEL PUEBLO S.A.\nDEMANDADO: ROSA MEJIA\nAVALÚO COMERCIAL: $7.500.00"
CO_FULL = "AVISO DE REMATE\nEXPEDIENTE N° 2025-00981\nMATRÍCULA INMOBILIARIA N° 060-778812\nAVALÚO COMERCIAL: $310,000,000\nFECHA DE REMATE: 4 DE MAYO DE 2026\nDEMANDANTE: BANCO DEL VALLE\nDEMANDADO: PEDRO RUIZ"
CO_PERCENT = "AVISO DE REMATE\n\nEXPEDIENTE N° 2013-00077\nDEMANDANTE: Conjunto Los Pinos\nDEMANDADO: Jairo Gomez y otros\nAVALÚO COMERCIAL: $545.698.500\nFIANZA DEL POSTOR: 40%\nPORCENTAJE MÍNIMO DE LA POSTURA: SETENTA POR CIENTO"


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first()["x"]


def extracted(spark, text, country):
    df = spark.createDataFrame([(text,)], "text string")
    return (extract.panama_v2(df) if country == "PA" else extract.colombia_v2(df)).first().asDict()


def test_panama_full_notice(spark):
    r = extracted(spark, PA_FULL, "PA")
    assert r["expediente"] == "40112-2026" and r["finca"] == "611203" and r["precio_base"] == "92,500.00"
    assert r["fecha_remate"] == "9 DE OCTUBRE DE 2026" and r["demandado"] == "MARTA ELENA RIOS"
    assert r["demandante"] == "INMOBILIARIA DEL ISTMO S.A." and r["proceso"] == "EJECUTIVO HIPOTECARIO"


def test_panama_incomplete_and_edict(spark):
    r = extracted(spark, PA_INCOMPLETE, "PA")
    assert r["expediente"] == "777-26" and r["finca"] is None and r["precio_base"] is None and r["demandado"] == "LUIS SOTO"
    r = extracted(spark, PA_EDICT, "PA")
    assert r["expediente"] == "5510-26" and all(r[f] is None for f in ("finca", "precio_base", "demandante", "demandado"))
    assert one(spark, nt.edict_only(F.col("text")), PA_EDICT) and not one(spark, nt.edict_only(F.col("text")), PA_FULL)


def test_panama_client_layout(spark):
    r = extracted(spark, PA_CLIENT, "PA")
    assert (r["expediente"], r["precio_base"], r["demandante"]) == ("88123-24", "7.500.00", "BANCO DEL PUEBLO S.A.")
    assert one(spark, money.parse_panama(F.lit(r["precio_base"])), "x") == 7500.0


def test_colombia_notices(spark):
    r = extracted(spark, CO_FULL, "CO")
    assert (r["expediente"], r["finca"], r["precio_base"]) == ("2025-00981", "060-778812", "310,000,000")
    assert (r["demandante"], r["demandado"], r["fecha_remate"]) == ("BANCO DEL VALLE", "PEDRO RUIZ", "4 DE MAYO DE 2026")
    r = extracted(spark, CO_PERCENT, "CO")
    assert r["fianza_porcentaje"] == 40.0 and r["minimo_porcentaje"] == 70.0 and r["precio_base"] == "545.698.500"


@pytest.mark.parametrize("raw,value", [("B/.47,927.27", 47927.27), ("47.92727", 47927.27), ("104.355.34", 104355.34), ("1.200.00", 1200.0), ("1.200", 1200.0),
                                       ("1529.03", 1529.03), ("5,800.00.", 5800.0), (".", None), ("abc", None), ("85,000.00", 85000.0)])
def test_panama_money(spark, raw, value):
    assert one(spark, money.parse_panama(F.col("text")), raw) == value


@pytest.mark.parametrize("raw,value", [("CUARENTA POR CIENTO", 40.0), ("0.40", 40.0), ("70 %", 70.0), ("ciento cinco por ciento", 105.0), ("66,67%", 66.67), ("x", None)])
def test_percent(spark, raw, value):
    assert one(spark, money.parse_percent(F.col("text")), raw) == value


@pytest.mark.parametrize("raw,iso", [("2026-02-31", "2026-02-31"), ("3.7.2026", "2026-07-03"), ("25 de mayo de 2026", "2026-05-25"), ("1/13/2026", ""), ("ayer", "")])
def test_dates(spark, raw, iso):
    assert one(spark, dates.to_iso(F.col("text")), raw) == iso


def test_press_code(spark):
    c = dates.press_code(F.lit("La Estrella de Panamá"), F.lit(1), F.lit("2026-07-08"), F.lit("1c"))
    assert one(spark, c, "") == "LE08JUL20261C"


def test_names(spark):
    assert one(spark, names.legal_name(F.col("text")), "PEREZ, juan") == "Juan Perez"
    assert one(spark, names.legal_name(F.col("text")), "banco general s.a.") == "Banco General S.A."


def test_sentences_keep_company_names(spark):
    got = one(spark, nt.sentences(F.col("text")), "Pide Financiera Sol, S.A. el remate. Finca en Colon! Fin")
    assert got == ["Pide Financiera Sol, S.A. el remate.", "Finca en Colon!", "Fin"]


def test_headers(spark):
    h = nt.detect_header(F.col("text"))
    assert one(spark, h["valid"], PA_FULL) and not one(spark, h["valid"], PA_EDICT)
    assert one(spark, h["valid"], "nota\nREMATE JUDICIAL de bienes")


def test_registered_pattern_table(spark):
    patterns.register_extractor("XX", "PRUEBA", {"numero": [r"NUMERO\s+(\d+)", r"(\d+)$"]})
    df = spark.createDataFrame([("NUMERO 12",), ("fin 9",), ("nada",)], "text string")
    assert [r["numero"] for r in patterns.extract_fields(df, "XX", "PRUEBA").collect()] == ["12", "9", None]
    with pytest.raises(Exception):
        patterns.register_extractor("XX", "MALA", {"a": ["("]})


def test_registered_normalizer(spark):
    normalize.register_normalizer("eco", lambda c: F.upper(c))
    normalize.FIELD_TYPES["prueba_eco"] = "eco"
    df = spark.createDataFrame([("prueba_eco", "a"), ("base", "B/.1,200.50"), ("otro", " x ")], "field string, value string")
    assert {r["field"]: r["normalized"] for r in normalize.normalize_long(df).collect()} == {"prueba_eco": "A", "base": "1200.50", "otro": "x"}


def test_validation_ladder(spark):
    df = spark.createDataFrame([(1, PA_FULL, ["expediente", "finca", "precio_base", "fecha_remate", "demandante", "demandado"]), (2, PA_EDICT, ["expediente"]),
                                (3, PA_INCOMPLETE, ["expediente", "demandado"])], "id int, text string, campos array<string>")
    got = {r["id"]: r["decision"] for r in rules.validate(df).collect()}
    assert got == {1: "VALID", 2: "INVALID", 3: "INCOMPLETE"}


def test_boundaries_skip_mentions(spark):
    got = one(spark, extract.mark_boundaries(F.col("text")), "AVISO DE REMATE uno. El presente AVISO DE REMATE sigue. EDICTO EMPLAZATORIO dos")
    assert got.count(extract.BOUNDARY) == 2
