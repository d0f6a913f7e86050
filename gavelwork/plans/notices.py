"""Searches, lists, boards and feeds over the notice table."""

from pyspark.sql import functions as F

from gavelwork.functions import lookups as lk
from gavelwork.operators import boards, search
from gavelwork.registry import query
from gavelwork.sources import sinks
from gavelwork.sources import views as v

DAY = "date_format(creado_en, 'yyyy-MM-dd')"


def _brief(df):
    return df.selectExpr("id", "pais", "estado", "expediente", "demandante", "demandado",
                         "CAST(base AS DOUBLE) AS base", f"{DAY} AS creado_en")


BRIEF = ("id, pais, estado, expediente, demandante, demandado, CAST(base AS DOUBLE) AS base, "
         "strftime(creado_en, '%Y-%m-%d') AS creado_en")
SEARCH_SQL = """estado <> 'eliminado' AND pais = 1 AND creado_en >= TIMESTAMP '1996-01-01'
  AND (descripcion ILIKE '%supplier 1%' OR expediente ILIKE '%supplier 1%' OR demandante ILIKE '%supplier 1%'
       OR demandado ILIKE '%supplier 1%' OR codigo ILIKE '%supplier 1%')"""


@query("src1_table_scan", views=("avisos",), oracle="""
SELECT pais, count(*) AS n, count(DISTINCT documento_id) AS documentos FROM avisos GROUP BY pais""")
def table_scan(spark, sf):
    return v.avisos(spark, sf, parties=False).groupBy("pais").agg(
        F.count("*").alias("n"), F.countDistinct("documento_id").alias("documentos"))


@query("fil1_search_page", views=("avisos",), oracle=f"""
SELECT {BRIEF} FROM avisos WHERE {SEARCH_SQL} ORDER BY avisos.creado_en DESC, id DESC LIMIT 25 OFFSET 25""")
def search_page(spark, sf):
    hits = search.notice_filter(v.avisos(spark, sf), pais=1, desde="1996-01-01", hasta="not a date", q="supplier 1")
    return _brief(search.page(hits, 2, 25))


@query("fil1_search_total", views=("avisos",), oracle=f"""
SELECT count(*) AS total, CAST(ceil(count(*) / 25) AS BIGINT) AS total_pages FROM avisos WHERE {SEARCH_SQL}""")
def search_total(spark, sf):
    hits = search.notice_filter(v.avisos(spark, sf), pais=1, desde="1996-01-01", hasta="not a date", q="supplier 1")
    return search.page_summary(hits, 25)


@query("fil2_pending", views=("avisos",), oracle=f"""
SELECT {BRIEF} FROM avisos WHERE estado = 'esperando_aprobacion' AND pais = 2""")
def pending(spark, sf):
    rows = v.avisos(spark, sf).filter("estado = 'esperando_aprobacion' AND pais = 2")
    return _brief(search.newest_first(rows))


@query("fil3_history", views=("avisos",), oracle=f"""
SELECT {BRIEF} FROM avisos WHERE estado <> 'eliminado' ORDER BY avisos.creado_en DESC, id DESC LIMIT 200""")
def history(spark, sf):
    return _brief(search.newest_first(search.active(v.avisos(spark, sf))).limit(200))


@query("fil3_all_notices", views=("avisos",), oracle=f"""
SELECT {BRIEF} FROM avisos WHERE estado = 'subido'""")
def all_notices(spark, sf):
    return _brief(search.newest_first(search.notice_filter(v.avisos(spark, sf), estado="subido")))


@query("fil4_latest_audit", views=("auditoria",), oracle="""
SELECT id, aviso_id, agente, accion FROM auditoria ORDER BY creado_en DESC, id DESC LIMIT 200""")
def latest_audit(spark, sf):
    return search.newest_first(v.auditoria(spark, sf)).limit(200).select("id", "aviso_id", "agente", "accion")


IDS = "1, 3, 5,7,x9, 11,abc, 13 ,3000"


@query("fil5_export_selection", views=("avisos",), oracle=f"""
SELECT {BRIEF} FROM avisos WHERE estado <> 'eliminado' AND pais = 2 AND id IN (1,3,5,7,11,13,3000)""")
def export_selection(spark, sf):
    return _brief(search.export_selection(v.avisos(spark, sf), "co", None, IDS))


@query("fil6_bulk_selection", views=("avisos",), oracle=f"""
SELECT {BRIEF} FROM avisos WHERE estado <> 'eliminado' AND pais = 1
  AND creado_en >= TIMESTAMP '1997-01-01' AND creado_en <= TIMESTAMP '1997-06-30' AND estado = 'subido'""")
def bulk_selection(spark, sf):
    return _brief(search.bulk_selection(v.avisos(spark, sf), pais=1, estado="subido",
                                        desde="1997-01-01", hasta="1997-06-30"))


@query("fil7_decoded_projection", views=("auditoria",), oracle="""
SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.k') IS NULL AS sin_k
FROM events""")
def decoded_projection(spark, sf):
    ev = v.table(spark, sf, "events")
    return ev.select(F.col("event_id").alias("id"), F.from_json("props", "k BIGINT").alias("p")).selectExpr(
        "id", "p.k AS k", "p.k IS NULL AS sin_k")


@query("fil8_store_fields", views=("resultados_campo",), oracle="""
SELECT document_id, CASE field WHEN 'finca' THEN 'finca_matr' WHEN 'precio_base' THEN 'base'
  WHEN 'fecha_remate' THEN 'fecha' ELSE field END AS campo, count(*) AS n
FROM (SELECT *, CASE part % 7 WHEN 0 THEN '' WHEN 1 THEN 'null' WHEN 2 THEN '.' WHEN 3 THEN 'NOT_FOUND'
        WHEN 4 THEN NULL ELSE part::VARCHAR END AS valor FROM resultados_campo)
WHERE valor NOT IN ('', 'null', '.', '..', 'NOT_FOUND') GROUP BY ALL""")
def store_fields(spark, sf):
    rows = v.resultados_campo(spark, sf).withColumn("valor", F.expr(
        "CASE part % 7 WHEN 0 THEN '' WHEN 1 THEN 'null' WHEN 2 THEN '.' WHEN 3 THEN 'NOT_FOUND' "
        "WHEN 4 THEN NULL ELSE CAST(part AS STRING) END"))
    renamed = F.coalesce(*[F.when(F.col("field") == k, F.lit(n)) for k, n in search.STORE_NAMES.items()],
                         F.col("field"))
    kept = rows.filter(search.drop_placeholder(F.col("valor")).isNotNull())
    return kept.groupBy("document_id", renamed.alias("campo")).agg(F.count("*").alias("n"))


@query("fil9_plausible_base", views=("avisos",), oracle="""
SELECT pais, count(*) FILTER (base >= 100 AND base < 1000000000) AS aceptados,
  count(*) FILTER (base IS NULL OR base < 100 OR base >= 1000000000) AS rechazados FROM avisos GROUP BY pais""")
def plausible_base(spark, sf):
    ok = search.plausible_base(F.col("base"))
    return v.avisos(spark, sf, parties=False).groupBy("pais").agg(
        F.count_if(ok).alias("aceptados"), F.count_if(~ok).alias("rechazados"))


@query("fil16_identity", views=("avisos",), oracle="""
SELECT id FROM avisos WHERE id % 3 <> 0 OR (demandado IS NOT NULL AND id % 2 = 0)""")
def identity(spark, sf):
    a = v.avisos(spark, sf, parties=False).selectExpr(
        "id", "IF(id % 3 = 0, ' ', expediente) AS e", "CAST(NULL AS STRING) AS f", "'' AS d",
        "IF(id % 2 = 0, demandado, NULL) AS o")
    return a.filter(search.has_identity(*[F.col(c) for c in "efdo"])).select("id")


@query("fil17_missing_fields", views=("avisos",), oracle="""
SELECT id, array_to_string(list_filter([
  CASE WHEN hora IS NULL THEN 'hora' END, CASE WHEN lugar IS NULL THEN 'lugar' END,
  CASE WHEN demandado IS NULL THEN 'demandado' END, CASE WHEN base IS NULL THEN 'base' END,
  CASE WHEN fianza_porcentaje IS NULL THEN 'fianza_porcentaje' END,
  CASE WHEN minimo_porcentaje IS NULL THEN 'minimo_porcentaje' END], lambda x: x IS NOT NULL), ',') AS faltantes
FROM avisos""")
def missing(spark, sf):
    return v.avisos(spark, sf).select("id", F.array_join(search.missing_fields(lk.FUNDAMENTAL_FIELDS), ",").alias("faltantes"))


@query("agg1_correction_totals", views=("correcciones",), oracle="""
SELECT count(*) AS total, count(*) FILTER (pais = 1) AS panama, count(*) FILTER (pais = 2) AS colombia FROM correcciones""")
def correction_totals(spark, sf):
    return boards.correction_totals(v.correcciones(spark, sf))


@query("agg1_top_corrected_fields", views=("correcciones",), oracle="""
SELECT campo, count(*) AS veces FROM correcciones GROUP BY campo ORDER BY veces DESC, campo LIMIT 15""")
def top_corrected(spark, sf):
    return boards.top_values(v.correcciones(spark, sf), "campo", "veces", 15)


BOARD_SQL = """count(DISTINCT documento_id) AS documentos_procesados,
  count(*) FILTER (estado <> 'eliminado') AS avisos_totales,
  count(*) FILTER (estado IN ('auto_aprobado', 'subido')) AS auto_aprobados,
  count(*) FILTER (estado = 'esperando_aprobacion') AS esperando_aprobacion,
  count(*) FILTER (estado <> 'eliminado' AND tipo_validacion = 'duplicado_sospechoso') AS duplicados_sospechosos,
  count(*) FILTER (estado <> 'eliminado' AND starts_with(tipo_validacion, 'republicacion_legal')) AS republicaciones_legales,
  count(*) FILTER (estado = 'reemplazado_por_republicacion') AS reemplazados,
  round(CAST(sum(CAST(confianza_promedio AS DECIMAL(5,2))) FILTER (estado <> 'eliminado') AS DOUBLE)
        / count(*) FILTER (estado <> 'eliminado'), 3) AS confianza_promedio_global,
  round(count(*) FILTER (estado IN ('auto_aprobado', 'subido')) * 100.0::DOUBLE
        / count(*) FILTER (estado <> 'eliminado'), 1) AS porcentaje_automatizacion"""


@query("agg2_kpi_board", views=("avisos",), oracle=f"SELECT {BOARD_SQL} FROM avisos")
def kpi_board(spark, sf):
    return boards.kpi_board(v.avisos(spark, sf, parties=False))


@query("agg2_kpi_by_country", views=("avisos",), oracle=f"SELECT pais, {BOARD_SQL} FROM avisos GROUP BY pais")
def kpi_by_country(spark, sf):
    return boards.kpi_board(v.avisos(spark, sf, parties=False), ["pais"])


@query("agg3_export_summary", views=("avisos",), oracle="""
SELECT count(*) AS total, count(*) FILTER (estado = 'subido') AS subidos,
  count(*) FILTER (estado = 'auto_aprobado') AS auto_aprobados,
  count(*) FILTER (estado = 'esperando_aprobacion') AS pendientes,
  count(*) FILTER (estado IN ('subido', 'auto_aprobado')) AS listos_para_exportar
FROM avisos WHERE estado <> 'eliminado' AND pais = 1""")
def export_summary(spark, sf):
    return boards.export_summary(search.export_selection(v.avisos(spark, sf, parties=False), "PA"))


BASELINE_SQL = """SELECT 'total' AS grupo, 'avisos' AS clave, CAST(count(*) AS DOUBLE) AS valor FROM avisos
UNION ALL SELECT 'estado', estado, CAST(count(*) AS DOUBLE) FROM avisos GROUP BY estado
UNION ALL SELECT 'pais', pais::VARCHAR, CAST(count(*) AS DOUBLE) FROM avisos GROUP BY pais
UNION ALL SELECT 'confianza', 'promedio', round(CAST(sum(CAST(confianza_promedio AS DECIMAL(5,2))) AS DOUBLE) / count(*), 4) FROM avisos
UNION ALL SELECT 'confianza', 'min', round(min(confianza_promedio), 4) FROM avisos
UNION ALL SELECT 'confianza', 'max', round(max(confianza_promedio), 4) FROM avisos
UNION ALL SELECT 'automatizacion', 'tasa',
  round(count(*) FILTER (estado IN ('auto_aprobado', 'subido')) * 100.0::DOUBLE / count(*), 1) FROM avisos"""


@query("agg4_baseline_metrics", views=("avisos",), oracle=BASELINE_SQL)
def baseline_metrics(spark, sf):
    return boards.baseline_metrics(v.avisos(spark, sf, parties=False))


@query("agg4_missing_top10", views=("avisos",), oracle="""
SELECT campo, count(*) AS n FROM (SELECT unnest(list_filter([
  CASE WHEN hora IS NULL THEN 'hora' END, CASE WHEN lugar IS NULL THEN 'lugar' END,
  CASE WHEN demandado IS NULL THEN 'demandado' END, CASE WHEN base IS NULL THEN 'base' END,
  CASE WHEN fianza_porcentaje IS NULL THEN 'fianza_porcentaje' END,
  CASE WHEN minimo_porcentaje IS NULL THEN 'minimo_porcentaje' END], lambda x: x IS NOT NULL)) AS campo FROM avisos)
GROUP BY campo ORDER BY n DESC, campo LIMIT 10""")
def missing_top(spark, sf):
    stored = v.avisos(spark, sf).select(F.to_json(search.missing_fields(lk.FUNDAMENTAL_FIELDS)).alias("campos_faltantes_json"))
    return boards.missing_top(stored, 10)


@query("agg5_version_comparison", views=("avisos",), oracle="""
WITH m AS (SELECT CASE WHEN documento_id % 2 = 0 THEN 'v1' ELSE 'v2' END AS ver, count(*)::DOUBLE AS total_avisos,
  round(CAST(sum(CAST(confianza_promedio AS DECIMAL(5,2))) AS DOUBLE) / count(*), 4) AS confianza_promedio,
  round(count(*) FILTER (estado IN ('auto_aprobado', 'subido')) * 100.0::DOUBLE / count(*), 1) AS tasa_automatizacion
  FROM avisos GROUP BY 1),
l AS (UNPIVOT m ON total_avisos, confianza_promedio, tasa_automatizacion INTO NAME metrica VALUE valor)
SELECT metrica, max(valor) FILTER (ver = 'v1') AS v1, max(valor) FILTER (ver = 'v2') AS v2,
  round(max(valor) FILTER (ver = 'v2') - max(valor) FILTER (ver = 'v1'), 4) AS delta FROM l GROUP BY metrica""")
def version_comparison(spark, sf):
    a = v.avisos(spark, sf, parties=False).withColumn("ver", F.expr("IF(documento_id % 2 = 0, 'v1', 'v2')"))
    return boards.version_comparison(a)


@query("srt1_newest_first", views=("correcciones",), oracle="""
SELECT id, campo FROM correcciones ORDER BY creado_en DESC, id DESC LIMIT 500""")
def srt_newest(spark, sf):
    return search.newest_first(v.correcciones(spark, sf)).limit(500).select("id", "campo")


@query("srt5_pagination", views=("avisos",), oracle="""
SELECT id, estado FROM avisos WHERE estado <> 'eliminado' ORDER BY creado_en DESC, id DESC LIMIT 50 OFFSET 100""")
def pagination(spark, sf):
    return search.page(search.active(v.avisos(spark, sf, parties=False)), 3, 50).select("id", "estado")


def _code_case(table):
    return "CASE translate(upper(trim(provincia)), 'ÁÉÍÓÚ', 'AEIOU') " + " ".join(
        f"WHEN '{k}' THEN {c}" for k, c in table.items()) + " END"


CODES = f"""CAST(CASE WHEN pais = 1 THEN {_code_case(lk.PA_PROVINCE_CODES)} ELSE {_code_case(lk.CO_DEPARTMENT_CODES)} END AS INT)"""
CATEGORY = "CAST(CASE categoria " + " ".join(f"WHEN '{k}' THEN {c}" for k, c in lk.CATEGORY_CODES.items()) + " END AS INT)"


@query("joi1_code_lookup", views=("avisos",), oracle=f"""
SELECT id, {CODES} AS codigo_ubicacion, {CATEGORY} AS categoria_codigo FROM avisos""")
def code_lookup(spark, sf):
    return sinks.with_codes(v.avisos(spark, sf)).select("id", "codigo_ubicacion", "categoria_codigo")


@query("snk1_feed_panama", views=("avisos",), oracle=f"""
SELECT pais, coalesce(codigo, 'PA' || lpad(id::VARCHAR, 8, '0')) AS codigo, expediente, lugar AS "juzg lugar",
  NULL::VARCHAR AS observaciones, proceso, demandante, demandado, strftime(fecha, '%Y-%m-%d') AS fecha, hora,
  {CODES} AS "codigo ubicacion", finca_matr AS "finca/matr", plano, lote_casa AS "lote/casa", superficie,
  {CATEGORY} AS categoria, descripcion, provincia, CAST(base AS DOUBLE) AS base, CAST(fianza AS DOUBLE) AS fianza,
  CAST(minimo AS DOUBLE) AS minimo, codigo_fuente AS "cod prensa" FROM avisos WHERE estado <> 'eliminado' AND pais = 1""")
def feed_panama(spark, sf):
    return sinks.feed_panama(search.export_selection(v.avisos(spark, sf), "PA"))


@query("snk1_feed_colombia", views=("avisos",), oracle=f"""
SELECT pais, coalesce(codigo, 'CO' || lpad(id::VARCHAR, 8, '0')) AS codigo, strftime(fecha, '%Y-%m-%d') AS fecha, hora,
  proceso, expediente, lugar AS "juzg lugar", NULL::VARCHAR AS observaciones, {CATEGORY} AS categoria, demandante,
  demandado, lote_casa AS "lote/casa", descripcion, superficie, finca_matr AS "finca/matr",
  {CODES} AS "codigo ubicacion", provincia, plano, CAST(base AS DOUBLE) AS base, 40 AS fianza, 100 AS minimo,
  NULL::VARCHAR AS correo, codigo_fuente AS "cod prensa" FROM avisos WHERE estado <> 'eliminado' AND pais = 2""")
def feed_colombia(spark, sf):
    return sinks.feed_colombia(search.export_selection(v.avisos(spark, sf), "CO"))


@query("snk2_platform_payload", views=("avisos",), oracle=f"""
SELECT CASE WHEN codigo IS NULL THEN '#' || CASE WHEN pais = 1 THEN 'PA' ELSE 'CO' END || '00000000' ELSE '#' || codigo END AS codigo,
  id, strftime(fecha, '%Y-%m-%d') AS fecha_remate, coalesce(hora, '') AS hora_remate,
  provincia AS provincia_o_departamento, coalesce(({CODES})::VARCHAR, '') AS codigo_ubicacion,
  coalesce(lugar, '') AS juzgado, proceso AS tipo_proceso, expediente, demandante,
  coalesce(demandado, '') AS demandado, descripcion, coalesce(base::VARCHAR, '0.00') AS base_remate,
  CASE WHEN pais = 2 THEN coalesce((CAST(fianza_porcentaje AS DECIMAL(5,1)))::VARCHAR, 'None') || '%'
       ELSE coalesce(fianza::VARCHAR, '0.00') END AS minimo_participar,
  coalesce(minimo::VARCHAR, '0.00') AS minimo_ganar, categoria, coalesce(lote_casa, '') AS lote_o_casa,
  finca_matr AS folio_o_matricula, coalesce(plano, '') AS plano, coalesce(superficie, '') AS superficie
FROM avisos WHERE estado = 'auto_aprobado'""")
def platform_payload(spark, sf):
    rows = sinks.with_codes(v.avisos(spark, sf).filter("estado = 'auto_aprobado'"))
    return sinks.platform_payload(rows)


@query("snk5_schema_evolution", views=("avisos",), oracle="""
SELECT CASE WHEN agente IS NULL THEN 'viejo' ELSE 'nuevo' END AS lote, count(*) AS n, count(valor) AS con_valor
FROM (SELECT id, NULL AS agente, NULL AS valor FROM avisos UNION ALL
      SELECT event_id, event_type, value FROM events) GROUP BY 1""")
def schema_evolution(spark, sf):
    old = v.avisos(spark, sf, parties=False).select("id")
    new = v.auditoria(spark, sf).select("id", "agente", "valor")
    return sinks.add_missing_columns(old, new).groupBy(
        F.when(F.col("agente").isNull(), "viejo").otherwise("nuevo").alias("lote")).agg(
        F.count("*").alias("n"), F.count("valor").alias("con_valor"))


@query("snk6_country_purge", views=("avisos", "auditoria", "correcciones"), oracle="""
SELECT 'avisos' AS tabla, count(*) AS n FROM avisos WHERE pais <> 1
UNION ALL SELECT 'auditoria', count(*) FROM auditoria WHERE aviso_id NOT IN (SELECT id FROM avisos WHERE pais = 1)
UNION ALL SELECT 'correcciones', count(*) FROM correcciones
  WHERE pais <> 1 AND aviso_id NOT IN (SELECT id FROM avisos WHERE pais = 1)""")
def country_purge(spark, sf):
    kept = sinks.purge_country(v.avisos(spark, sf, parties=False), 1,
                               {"auditoria": v.auditoria(spark, sf)}, v.correcciones(spark, sf))
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("tabla"), "n") for n, df in kept.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
