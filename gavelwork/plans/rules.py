"""Business rules, validation and text-decision queries."""

from pyspark.sql import functions as F

from gavelwork.functions import lookups as lk, money, names, text
from gavelwork.functions.dates import dates_in_text
from gavelwork.operators import extract, notice_text as nt, rules, search
from gavelwork.registry import query
from gavelwork.sources import views as v

PCT = "CASE WHEN base IS NOT NULL AND pais = 2 AND fianza_porcentaje IS NULL THEN 40::DOUBLE ELSE fianza_porcentaje END"
LEGAL_D = f"CASE WHEN pais = 1 THEN ({PCT}) IN (10, 20, 25) ELSE ({PCT}) = 40 END"
SHARE = "CAST(base * CAST({0} AS DECIMAL(6,2)) * 0.01::DECIMAL(3,2) AS DECIMAL(18,2))"
DEP = f"CASE WHEN base IS NOT NULL AND ({LEGAL_D}) THEN {SHARE.format(PCT)} END"
MINI = f"CASE WHEN base IS NOT NULL AND minimo_porcentaje IS NOT NULL THEN {SHARE.format('minimo_porcentaje')} END"
AMOUNTS = f"""am AS (SELECT *, {PCT} AS fp, {DEP} AS fc, {MINI} AS mc,
  CASE WHEN base IS NULL THEN [] ELSE list_filter([
    CASE WHEN ({PCT}) IS NULL THEN 'fianza_no_leida' WHEN NOT ({LEGAL_D}) THEN 'fianza_no_legal' END,
    CASE WHEN minimo_porcentaje IS NULL THEN 'minimo_no_leido' END,
    CASE WHEN abs(fianza - ({DEP}))::DOUBLE / base::DOUBLE > 0.03 THEN 'fianza_impresa_distinta' END,
    CASE WHEN abs(minimo - ({MINI}))::DOUBLE / base::DOUBLE > 0.03 THEN 'minimo_impreso_distinto' END],
    lambda x: x IS NOT NULL) END AS dis FROM avisos)"""


@query("rul1_amounts", views=("avisos",), oracle=f"""
WITH {AMOUNTS} SELECT id, fp AS fianza_pct, CAST(CASE WHEN base IS NOT NULL THEN coalesce(fc, fianza) END AS DOUBLE) AS fianza,
  CAST(CASE WHEN base IS NOT NULL THEN coalesce(mc, minimo) END AS DOUBLE) AS minimo, array_to_string(dis, ',') AS discrepancias,
  base IS NOT NULL AND pais = 2 AND fianza_porcentaje IS NULL AS asumida FROM am""")
def amounts(spark, sf):
    d = rules.amount_rules(v.notices(spark, sf))
    return d.select("id", "fianza_pct", F.col("fianza_final").cast("double").alias("fianza"), F.col("minimo_final").cast("double").alias("minimo"),
                    F.array_join("discrepancias", ",").alias("discrepancias"), F.col("fianza_asumida_por_regla").alias("asumida"))


@query("rul2_fallbacks", views=("avisos",), oracle=f"""
WITH {AMOUNTS}, f AS (SELECT *, coalesce(fc, fianza) AS f1, coalesce(mc, minimo) AS m1 FROM am WHERE base > 500),
g AS (SELECT *, m1 IS NULL AND minimo_porcentaje IS NULL AS ma, f1 IS NULL AND fp IS NULL AS fa,
  CASE WHEN m1 IS NULL AND minimo_porcentaje IS NULL THEN CASE WHEN pais = 1 THEN 66.67 ELSE 70 END ELSE minimo_porcentaje END::DOUBLE AS mp FROM f)
SELECT id, mp AS minimo_pct, fp AS fianza_pct,
  CAST(CASE WHEN m1 IS NULL THEN {SHARE.format('mp')} ELSE m1 END AS DOUBLE) AS minimo,
  CAST(CASE WHEN f1 IS NULL THEN {SHARE.format('fp')} ELSE f1 END AS DOUBLE) AS fianza,
  array_to_string(CASE WHEN ma THEN list_filter(dis, lambda x: NOT contains(x, '_no_leid')) ELSE dis END, ',') AS discrepancias FROM g""")
def fallbacks(spark, sf):
    d = rules.amount_fallbacks(rules.amount_rules(v.notices(spark, sf).filter("base > 500")))
    return d.select("id", F.col("minimo_pct_final").alias("minimo_pct"), F.col("fianza_pct_final").alias("fianza_pct"),
                    F.col("minimo_final").cast("double").alias("minimo"), F.col("fianza_final").cast("double").alias("fianza"),
                    F.array_join("discrepancias", ",").alias("discrepancias"))


@query("rul3_category_override", views=("avisos",), oracle="""
SELECT id, CASE WHEN id % 9 = 0 OR id % 10 = 7 THEN 'MISCELANEO' ELSE categoria END AS categoria,
  CASE WHEN id % 9 = 0 OR id % 10 = 7 THEN 5 ELSE CASE categoria WHEN 'CASA' THEN 1 WHEN 'APARTAMENTO' THEN 2 WHEN 'TERRENO' THEN 3
    WHEN 'VEHICULO' THEN 4 ELSE 5 END END::INT AS categoria_codigo,
  CASE WHEN codigo_fuente IS NULL AND id % 4 = 2 THEN '810' ELSE codigo_fuente END AS codigo_fuente FROM avisos""")
def category_override(spark, sf):
    a = v.avisos(spark, sf).withColumns({
        "descripcion": F.expr("IF(id % 9 = 0, 'una cuota parte de finca', descripcion)"), "descripcion_completa": F.lit(None).cast("string"),
        "proceso": F.expr("IF(id % 10 = 7, 'VENTA DE CUOTAS PARTES', proceso)"), "codigo": F.expr("IF(id % 4 = 2, '810', codigo)")})
    return rules.category_override(a).select("id", "categoria", "categoria_codigo", "codigo_fuente")


CONF = {"fecha": 3, "hora": 5, "proceso": 7, "lugar": 11, "demandante": 13, "base": 17, "plano": 19, "codigo": 23}


@query("rul4_approval", views=("avisos",), oracle=f"""
WITH c AS (SELECT *, {', '.join(f'(55 + (id * {k}) % 46)::DOUBLE / 100 AS c_{n}' for n, k in CONF.items())} FROM avisos),
m AS (SELECT *, round((c_fecha + c_hora + c_proceso + c_lugar + c_demandante + CASE WHEN base IS NULL THEN 0 ELSE c_base END + c_plano)
    / CASE WHEN base IS NULL THEN 6 ELSE 7 END, 3) AS media,
  (c_fecha + c_hora + c_proceso + c_lugar + c_demandante + CASE WHEN base IS NULL THEN 0 ELSE c_base END)
    / CASE WHEN base IS NULL THEN 5 ELSE 6 END AS crit,
  concat_ws(', ', CASE WHEN hora IS NULL THEN 'hora' END, CASE WHEN lugar IS NULL THEN 'lugar' END,
    CASE WHEN demandado IS NULL THEN 'demandado' END, CASE WHEN base IS NULL THEN 'base' END) AS falta FROM c)
SELECT id, CASE WHEN tipo_validacion = 'duplicado_sospechoso' THEN 'duplicado' WHEN id % 21 = 0 THEN 'discrepancia'
  WHEN falta <> '' THEN 'faltan: ' || falta WHEN crit < 0.70 THEN 'confianza' ELSE 'ok' END AS motivo, media AS confianza_media,
  CASE WHEN tipo_validacion <> 'duplicado_sospechoso' AND id % 21 <> 0 AND falta = '' AND crit >= 0.70 THEN 'auto_aprobado'
    ELSE 'esperando_aprobacion' END AS decision FROM m""")
def approval(spark, sf):
    pairs = [x for n, k in CONF.items() for x in (F.lit(n), F.expr(
        f"IF('{n}' = 'base' AND base IS NULL, NULL, (55 + (id * {k}) % 46) / 100D)"))]
    a = v.avisos(spark, sf).withColumns({"confianza": F.create_map(*pairs), "faltantes": search.missing_fields(lk.FUNDAMENTAL_FIELDS),
                                         "discrepancia": F.expr("id % 21 = 0")})
    return rules.approval(a).select("id", "motivo", "confianza_media", "decision")


def validated(spark, sf):
    """Notices whose text and found fields vary by id."""
    a = v.notices(spark, sf)
    t = F.expr("""CASE id % 8 WHEN 0 THEN concat('AVISO DE REMATE\\nEXPEDIENTE ', expediente) WHEN 1 THEN concat('\\nnota\\n Remate  Judicial ', id)
      WHEN 2 THEN 'EDICTO EMPLAZATORIO\\nAVISO DE REMATE' WHEN 3 THEN 'PUBLICIDAD\\ngran oferta y descuento'
      WHEN 4 THEN 'SUBASTA JUDICIAL\\nfinca' WHEN 5 THEN 'texto\\nEDICTO de prueba' WHEN 6 THEN 'oferta\\ndescuento\\nconvocatoria'
      ELSE 'Tercera fecha de remate' END""")
    fields = F.array_compact(F.array(*[F.expr(f"IF(id % {k} {op} 0, '{n}', NULL)") for n, k, op in FIELDS]))
    return a.select("id", t.alias("text"), fields.alias("campos"))


FIELDS = [("expediente", 3, "<>"), ("finca", 5, "="), ("base", 4, "<>"), ("fecha_remate", 7, "<>"), ("demandante", 2, "="),
          ("demandado", 3, "="), ("lugar", 11, "="), ("hora", 6, "=")]
HAS = {n: f"(id % {k} {op} 0)" for n, k, op in FIELDS}
VALIDATED = f"""v0 AS (SELECT id, id % 8 IN (0, 1, 4, 7) AS r1, id % 8 NOT IN (3, 6) AS r2, id % 8 <> 5 AS r3,
  {HAS['expediente']}::INT + {HAS['finca']}::INT + {HAS['base']}::INT AS s,
  {HAS['fecha_remate']}::INT + {HAS['demandante']}::INT + {HAS['demandado']}::INT AS m, {HAS['lugar']}::INT + {HAS['hora']}::INT AS w,
  list_filter([CASE WHEN {HAS['finca']} AND NOT {HAS['expediente']} THEN 'finca presente pero no expediente' END,
    CASE WHEN {HAS['expediente']} AND NOT {HAS['finca']} THEN 'expediente presente pero no finca' END,
    CASE WHEN {HAS['base']} AND NOT {HAS['fecha_remate']} THEN 'precio_base presente pero no fecha_remate' END,
    CASE WHEN {HAS['fecha_remate']} AND NOT {HAS['base']} THEN 'fecha_remate presente pero no precio_base' END,
    CASE WHEN {HAS['demandante']} AND NOT {HAS['demandado']} THEN 'demandante presente pero no demandado' END,
    CASE WHEN {HAS['demandado']} AND NOT {HAS['demandante']} THEN 'demandado presente pero no demandante' END], lambda x: x IS NOT NULL) AS co,
  list_sort(list_filter([{', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in HAS.items())}], lambda x: x IS NOT NULL)) AS enc,
  list_filter(['base', 'expediente', 'finca', 'finca_matr', 'precio_base'], lambda x: NOT ((x = 'base' AND {HAS['base']})
    OR (x = 'expediente' AND {HAS['expediente']}) OR (x = 'finca' AND {HAS['finca']}))) AS falt FROM avisos),
v1 AS (SELECT *, s >= 1 OR m >= 2 AS r4, s + m + w AS n FROM v0),
v2 AS (SELECT *, r1 AND r4 AS r5, len(co) = 0 AS r6, n >= 2 AS r7 FROM v1),
v3 AS (SELECT *, list_filter([CASE WHEN r1 THEN 'valid_header' END, CASE WHEN r2 THEN 'not_publicidad' END, CASE WHEN r3 THEN 'not_edicto' END,
    CASE WHEN r4 THEN 'min_one_strong_field' END, CASE WHEN r6 THEN 'field_co_occurrence' END, CASE WHEN r7 THEN 'min_field_count' END],
    lambda x: x IS NOT NULL) AS ap,
  list_filter([CASE WHEN NOT r1 THEN 'valid_header' END, CASE WHEN NOT r2 THEN 'not_publicidad' END, CASE WHEN NOT r3 THEN 'not_edicto' END,
    CASE WHEN NOT r4 THEN 'min_one_strong_field' END, CASE WHEN NOT r5 THEN 'structural_coherence' END,
    CASE WHEN NOT r6 THEN 'field_co_occurrence' END, CASE WHEN NOT r7 THEN 'min_field_count' END], lambda x: x IS NOT NULL) AS fa FROM v2),
v4 AS (SELECT *, CASE WHEN NOT r1 OR len(fa) >= 4 OR n = 0 OR NOT r2 OR NOT r3 THEN 'INVALID' WHEN r5 AND n >= 4 THEN 'VALID'
  WHEN r5 THEN 'INCOMPLETE' ELSE 'REQUIRES_REVIEW' END AS decision FROM v3)"""


@query("rul5_validation", views=("avisos",), oracle=f"""
WITH {VALIDATED} SELECT id, decision, array_to_string(ap, ',') AS aplicadas, array_to_string(fa, ',') AS fallidas,
  array_to_string(enc, ',') AS encontrados, array_to_string(falt, ',') AS faltantes, r5 AS estructura FROM v4""")
def validation(spark, sf):
    d = rules.validate(validated(spark, sf))
    return d.select("id", "decision", F.array_join("reglas_aplicadas", ",").alias("aplicadas"), F.array_join("reglas_fallidas", ",").alias("fallidas"),
                    F.array_join("campos_encontrados", ",").alias("encontrados"), F.array_join("campos_faltantes", ",").alias("faltantes"),
                    F.col("estructura_valida").alias("estructura"))


@query("rul6_co_occurrence", views=("avisos",), oracle=f"WITH {VALIDATED} SELECT id, array_to_string(co, '; ') AS avisos FROM v4")
def co_occurrence(spark, sf):
    return validated(spark, sf).select("id", F.array_join(rules.co_occurrence_warnings(F.col("campos")), "; ").alias("avisos"))


@query("rul7_consistency", views=("avisos",), oracle="""
SELECT id, concat_ws(',', CASE WHEN id % 5 = 0 AND base IS NOT NULL THEN 'base' END, CASE WHEN id % 7 = 0 THEN 'finca' END,
  CASE WHEN id % 3 = 0 THEN 'fechas' END, CASE WHEN id % 4 = 0 THEN 'partes' END, CASE WHEN id % 3 = 0 THEN 'fecha_imposible' END) AS tipos,
  (id % 5 = 0 AND base IS NOT NULL) OR id % 7 = 0 OR id % 4 = 0 AS grave FROM avisos""")
def consistency(spark, sf):
    d = consistent(spark, sf)
    return d.select("id", F.array_join(F.transform("issues", lambda x: x["tipo"]), ",").alias("tipos"),
                    F.exists("issues", lambda x: x["gravedad"] == "high").alias("grave"))


def consistent(spark, sf):
    fields = F.expr("""map('base', CAST(base AS STRING), 'precio_base', IF(id % 5 = 0, '1', CAST(base AS STRING)), 'finca', finca_matr,
      'finca_matr', IF(id % 7 = 0, '9', finca_matr), 'demandante', 'Ana Rios', 'demandado', IF(id % 4 = 0, ' ANA RIOS ', 'Luis'))""")
    t = F.expr("concat('el ', CAST(fecha AS STRING), IF(id % 3 = 0, ' y el 40 de mayo de 2020', ''))")
    return v.notices(spark, sf).select("id", rules.consistency_issues(fields, dates_in_text(t)).alias("issues"))


LEVEL = "(['UNIQUE', 'LIKELY_DUPLICATED', 'UNIQUE', 'DUPLICATED', 'UNIQUE'])[id % 5 + 1]"


@query("rul8_final_decision", views=("avisos",), oracle=f"""
WITH {VALIDATED}, d AS (SELECT id, decision, {LEVEL} AS l, id % 3 = 0 AS i FROM v4),
e AS (SELECT id, i, CASE WHEN l = 'DUPLICATED' THEN 'DUPLICATED' WHEN l = 'LIKELY_DUPLICATED' AND decision = 'VALID' THEN 'LIKELY_DUPLICATED'
  ELSE decision END AS d FROM d) SELECT id, CASE WHEN d = 'VALID' AND i THEN 'INCONSISTENT' ELSE d END AS decision FROM e""")
def final_decision(spark, sf):
    d = decided(spark, sf)
    return d.select("id", rules.final_decision(F.col("decision"), F.col("nivel_duplicado"), F.col("inconsistencias")).alias("decision"))


def decided(spark, sf):
    return rules.validate(validated(spark, sf)).withColumns({
        "nivel_duplicado": F.expr("element_at(array('UNIQUE', 'LIKELY_DUPLICATED', 'UNIQUE', 'DUPLICATED', 'UNIQUE'), CAST(id % 5 AS INT) + 1)"),
        "inconsistencias": F.expr("IF(id % 3 = 0, 2, 0)")})


SCORE = """CAST(round(CASE WHEN r1 THEN 0.2 ELSE 0 END + s * 0.04 + m * 0.0375 + n * 0.00625 + CASE WHEN r6 THEN 0.1 ELSE 0 END
  + CASE WHEN id % 3 = 0 THEN 0.05 ELSE 0.1 END + CASE WHEN r2 THEN 0.05 ELSE 0 END + CASE WHEN r3 THEN 0.05 ELSE 0 END
  + CASE WHEN r5 THEN 0.05 ELSE 0 END, 4) AS DOUBLE)"""


@query("rul9_notice_score", views=("avisos",), oracle=f"WITH {VALIDATED} SELECT id, {SCORE} AS score FROM v4")
def notice_score(spark, sf):
    return rules.notice_score(decided(spark, sf)).select("id", "score")


@query("rul10_confidence", views=("avisos",), oracle="""
SELECT id, round(p * 0.4::DOUBLE + o * 0.2::DOUBLE + CASE WHEN nok THEN 1 ELSE 0.5::DOUBLE END * 0.15::DOUBLE + k * 0.15::DOUBLE
    + CASE WHEN val THEN 0.1::DOUBLE ELSE 0 END, 4) AS campo,
  coalesce(nullif(concat_ws(', ', CASE WHEN p >= 0.9 THEN 'parser_high_confidence' END, CASE WHEN o >= 0.8 THEN 'ocr_high_quality' END,
    CASE WHEN nok THEN 'normalization_success' END, CASE WHEN val THEN 'validator_passed' END), ''), 'low_confidence') AS razon,
  round(o * 0.2::DOUBLE + 0.8::DOUBLE * 0.15::DOUBLE + p * 0.25::DOUBLE + CASE WHEN nok THEN 0.1::DOUBLE ELSE 0 END
    + CASE WHEN val THEN 0.15::DOUBLE ELSE 0 END + k * 0.15::DOUBLE, 4) AS documento
FROM (SELECT id, (id % 101)::DOUBLE / 100 AS p, (id * 7 % 101)::DOUBLE / 100 AS o, (id * 3 % 11)::DOUBLE / 10 AS k, id % 2 = 0 AS nok, id % 3 = 0 AS val FROM avisos)""")
def confidence(spark, sf):
    d = v.notices(spark, sf).selectExpr("id", "(id % 101) / 100D AS p", "(id * 7 % 101) / 100D AS o", "(id * 3 % 11) / 10D AS k",
                                                      "id % 2 = 0 AS nok", "id % 3 = 0 AS val")
    c = F.col
    field, reason = rules.field_confidence(c("p"), c("o"), c("nok"), c("k"), c("val"))
    doc = rules.document_confidence({"ocr": c("o"), "segmentation": F.lit(0.8), "parser": c("p"), "normalization": F.when(c("nok"), 1.0).otherwise(0.0),
                                     "validation": F.when(c("val"), 1.0).otherwise(0.0), "knowledge": c("k")})
    return d.select("id", field.alias("campo"), reason.alias("razon"), doc.alias("documento"))


@query("rul12_intelligence", views=("avisos",), oracle="""
WITH x AS (SELECT *, id % 21 = 0 AS dis, list_filter([CASE WHEN id % 21 = 0 THEN 'discrepancia_valores' END,
    CASE WHEN confianza_promedio < 0.7 THEN 'confianza_baja' END, CASE WHEN base IS NULL THEN 'base_faltante' END,
    CASE WHEN fianza IS NULL AND fianza_porcentaje IS NULL THEN 'fianza_indeterminada' END,
    CASE WHEN minimo IS NULL AND minimo_porcentaje IS NULL THEN 'minimo_indeterminado' END], lambda z: z IS NOT NULL) AS low,
  (hora IS NULL)::INT + (lugar IS NULL)::INT + (demandado IS NULL)::INT + (base IS NULL)::INT + (fianza_porcentaje IS NULL)::INT
    + (minimo_porcentaje IS NULL)::INT AS falta FROM avisos)
SELECT id, array_to_string(list_concat(low, list_filter([CASE WHEN estado = 'esperando_aprobacion' AND len(low) = 0 THEN 'pendiente_revision_cliente' END,
    CASE WHEN pais = 1 AND fianza_porcentaje = 33 THEN 'fianza_pct_no_legal' END], lambda z: z IS NOT NULL)), ',') AS motivos,
  CASE id % 4 WHEN 0 THEN 'deterministico' WHEN 1 THEN 'ia' ELSE 'desconocido' END AS motor, falta AS faltantes,
  greatest(0, least(1, round(confianza_promedio * 0.7::DOUBLE + (13 - falta)::DOUBLE / 13 * 0.3::DOUBLE - CASE WHEN dis THEN 0.25::DOUBLE ELSE 0 END
    - CASE WHEN estado = 'esperando_aprobacion' THEN 0.15::DOUBLE ELSE 0 END, 3))) AS confianza_predicha FROM x""")
def intelligence(spark, sf):
    d = rules.notice_intelligence(v.avisos(spark, sf).withColumn("discrepancia", F.expr("id % 21 = 0")))
    return d.select("id", F.array_join("motivos", ",").alias("motivos"), "motor", F.size("faltantes").alias("faltantes"), "confianza_predicha")


METRICS = {"parser_accuracy": "avg(CASE WHEN status = 'FOUND' THEN 100 ELSE 0 END)", "stress_test_reliability": "count(*) * 100.0 / count(*)",
           "parser_throughput": "count(*) / 100.0", "parser_memory": "count(*) / 1000.0", "golden_dataset_integrity": "min(1)",
           "schema_alignment": "count(DISTINCT field) * 100.0 / 7", "alignment_critical_fields_missing_producer": "count(*) - count(field)",
           "alignment_required_fields_no_consumer": "count(*) - count(source)", "alignment_golden_fields_without_parser": "min(0)"}


def metric_table(spark, sf):
    wide = v.resultados_campo(spark, sf).groupBy("country").agg(*[
        F.expr(e.replace("100.0", "100D").replace("1000.0", "1000D")).cast("double").alias(k) for k, e in METRICS.items()])
    return wide.unpivot("country", list(METRICS), "criterion", "actual")


DUCK_METRICS = "m AS (" + " UNION ALL ".join(
    f"SELECT country, '{k}' AS criterion, CAST({e} AS DOUBLE) AS actual FROM resultados_campo GROUP BY country" for k, e in METRICS.items()) + ")"
CRIT = "(VALUES " + ", ".join(f"('{n}', '{o}', {t}::DOUBLE, {w})" for n, o, t, w in rules.CRITERIA) + ") AS c(criterion, op, threshold, weight)"
PASS = "CASE op WHEN '>=' THEN actual >= threshold WHEN '<=' THEN actual <= threshold ELSE actual = threshold END"


@query("rul17_certification", views=("resultados_campo",), oracle=f"""
WITH {DUCK_METRICS}, r AS (SELECT country, criterion, {PASS} AS p, weight FROM m JOIN {CRIT} USING (criterion)),
s AS (SELECT country, round(least(CAST(sum(CASE WHEN p THEN weight ELSE 0 END) AS DOUBLE) * 200, 100), 1) AS score,
  count(*) FILTER (p) AS criteria_passed, count(*) AS criteria_total, bool_or(starts_with(criterion, 'alignment_') AND NOT p) AS blocked FROM r GROUP BY country)
SELECT *, score >= 70 AND NOT blocked AS certified FROM s""")
def certification(spark, sf):
    return rules.certification_score(rules.certify(metric_table(spark, sf), spark, ["country"]), ["country"])


@query("rul17_criteria", views=("resultados_campo",), oracle=f"""
WITH {DUCK_METRICS} SELECT country, criterion, threshold, {PASS} AS passed FROM m JOIN {CRIT} USING (criterion)""")
def criteria(spark, sf):
    return rules.certify(metric_table(spark, sf), spark, ["country"]).select("country", "criterion", "threshold", "passed")


@query("rul18_certification_record", views=("resultados_campo",), oracle="""
SELECT document_id, count(*) AS total_fields, count(*) FILTER (status = 'FOUND') AS fields_present,
  count(*) FILTER (status = 'NOT_FOUND') AS fields_missing,
  CASE WHEN count(*) FILTER (status = 'FOUND') = count(*) THEN 'VALID' WHEN count(*) FILTER (status = 'REQUIRES_REVIEW') > 0 THEN 'REQUIRES_REVIEW'
    ELSE 'INCOMPLETE' END AS decision, '7.0.0' AS version FROM resultados_campo GROUP BY document_id""")
def certification_record(spark, sf):
    s = F.col("status")
    g = v.resultados_campo(spark, sf).groupBy("document_id").agg(
        F.count("*").alias("total_fields"), F.count_if(s == "FOUND").alias("fields_present"), F.count_if(s == "NOT_FOUND").alias("fields_missing"),
        F.count_if(s == "REQUIRES_REVIEW").alias("r"))
    return g.withColumn("decision", F.when(F.col("fields_present") == F.col("total_fields"), "VALID").when(
        F.col("r") > 0, "REQUIRES_REVIEW").otherwise("INCOMPLETE")).withColumn("version", F.lit("7.0.0")).drop("r")


@query("rul19_explanations", views=("avisos",), oracle=f"""
WITH {VALIDATED}, e AS (SELECT *, {SCORE} AS score, {LEVEL} AS l FROM v4)
SELECT id, concat_ws('; ', 'Decision: ' || decision, 'Score: ' || format('{{:.2f}}', score), CASE WHEN r1 THEN 'Valid header detected'
    ELSE 'Invalid or missing header' END, CASE WHEN id % 3 = 0 THEN '2 inconsistency(ies) found' END,
    CASE WHEN len(fa) > 0 THEN len(fa)::VARCHAR || ' rule(s) failed' END) AS razon,
  (1 + len(ap) + CASE WHEN id % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN l <> 'UNIQUE' THEN 1 ELSE 0 END)::INT AS factores,
  concat_ws(',', CASE WHEN NOT r1 THEN 'header' END, CASE WHEN l <> 'UNIQUE' THEN 'duplicate' END) AS recomendaciones FROM e""")
def explanations(spark, sf):
    d = rules.explain(rules.notice_score(decided(spark, sf)))
    return d.select("id", "razon", F.size("factores").alias("factores"), F.array_join("recomendaciones", ",").alias("recomendaciones"))


@query("rul20_provenance", views=("resultados_campo",), oracle="""
SELECT document_id, CASE field WHEN 'finca' THEN 'finca_matr' WHEN 'precio_base' THEN 'base' WHEN 'fecha_remate' THEN 'fecha' ELSE field END AS campo,
  source, confidence, CASE WHEN source = 'knowledge' THEN lpad(part::VARCHAR, 12, '0') END AS rule_id,
  CASE WHEN source = 'knowledge' THEN (part % 9)::INT END AS rule_version, part::VARCHAR AS value
FROM resultados_campo WHERE status = 'FOUND'""")
def provenance(spark, sf):
    r = v.resultados_campo(spark, sf).withColumns({
        "value": F.expr("IF(status = 'FOUND', CAST(part AS STRING), NULL)"),
        "method": F.expr("concat('rule:regex:', lpad(CAST(part AS STRING), 12, '0'), ':v', part % 9)")})
    return rules.provenance(r)


@query("rul23_description_source", views=("avisos",), oracle="""
SELECT id, CASE id % 3 WHEN 0 THEN 'completa' WHEN 1 THEN categoria ELSE '' END AS descripcion,
  coalesce(plano, finca_matr) AS ubicacion FROM avisos""")
def description_source(spark, sf):
    a = v.notices(spark, sf).selectExpr(
        "id", "CASE id % 3 WHEN 0 THEN 'completa' WHEN 1 THEN '' END AS c", "IF(id % 3 = 2, NULL, categoria) AS d", "plano", "finca_matr")
    return a.select("id", F.coalesce(F.nullif("c", F.lit("")), F.nullif("d", F.lit("")), F.lit("")).alias("descripcion"),
                    F.coalesce("plano", "finca_matr").alias("ubicacion"))


@query("rul24_readiness", views=("resultados_campo",), oracle="""
WITH m AS (SELECT document_id % 50 AS lote, round(count(*) FILTER (status = 'FOUND') * 100.0::DOUBLE / count(*), 2) AS mr,
  round(count(*) FILTER (status <> 'NOT_FOUND') * 100.0::DOUBLE / count(*), 1) AS sr, count(*) FILTER (status = 'FOUND') AS ok,
  count(*) FILTER (status = 'NOT_FOUND') AS bad FROM resultados_campo GROUP BY 1)
SELECT lote, least((CASE WHEN mr >= 95 THEN 30 WHEN mr >= 85 THEN 25 WHEN mr >= 70 THEN 20 WHEN mr >= 50 THEN 10 ELSE 0 END
  + CASE WHEN sr >= 95 THEN 20 WHEN sr >= 90 THEN 15 WHEN sr >= 80 THEN 10 ELSE 0 END + 5 + 10
  + CASE WHEN ok * 100.0 / greatest(ok + bad, 1) >= 90 THEN 25 WHEN ok * 100.0 / greatest(ok + bad, 1) >= 75 THEN 20
    WHEN ok * 100.0 / greatest(ok + bad, 1) >= 50 THEN 10 ELSE 0 END + 10)::DOUBLE, 100) AS readiness,
  concat_ws(',', CASE WHEN mr < 90 THEN 'improve_parser' END, CASE WHEN sr < 95 THEN 'concurrency' END, CASE WHEN bad > 0 THEN 'review_invalid' END) AS rec FROM m""")
def readiness(spark, sf):
    s = F.col("status")
    m = v.resultados_campo(spark, sf).groupBy((F.col("document_id") % 50).alias("lote")).agg(
        F.round(F.count_if(s == "FOUND") * F.lit(100.0) / F.count("*"), 2).alias("match_rate"),
        F.round(F.count_if(s != "NOT_FOUND") * F.lit(100.0) / F.count("*"), 1).alias("stress_rate"),
        F.count_if(s == "FOUND").alias("valid_count"), F.count_if(s == "NOT_FOUND").alias("invalid_count")).withColumns({
            "thread_safe": F.lit(True), "bench_success": F.lit(100.0), "memory_mb": F.lit(10.0)})
    return rules.readiness(m).select("lote", "readiness", F.array_join("recomendaciones", ",").alias("rec"))


# ---- predicates and rewriting of text ----

@query("fil11_furniture", views=("avisos",), oracle="""
SELECT id, id % 5 < 3 AS cabecera FROM avisos""")
def furniture(spark, sf):
    t = F.expr("CASE id % 5 WHEN 0 THEN 'AVISO DE REMATE IC PUBLICA tus judiciales' WHEN 1 THEN 'EDICTO 810 ' WHEN 2 THEN 'tel 204-0000' "
               "WHEN 3 THEN concat('EDICTO 810 de ', id) ELSE expediente END")
    return v.notices(spark, sf).select("id", nt.is_furniture(t).alias("cabecera"))


@query("fil12_advert_edict", views=("avisos",), oracle="""
SELECT id, id % 8 IN (3, 6) AS publicidad, id % 8 = 5 AS edicto FROM avisos""")
def advert_edict(spark, sf):
    t = F.col("text")
    return validated(spark, sf).select("id", nt.advert_only(t).alias("publicidad"), nt.edict_only(t).alias("edicto"))


@query("fil13_header", views=("avisos",), oracle="""
SELECT id, id % 8 IN (0, 1, 4, 7) AS valida, CASE id % 8 WHEN 0 THEN 'AVISO DE REMATE' WHEN 1 THEN 'Remate  Judicial ' || id::VARCHAR
  WHEN 2 THEN 'EDICTO EMPLAZATORIO' WHEN 3 THEN 'PUBLICIDAD' WHEN 4 THEN 'SUBASTA JUDICIAL' WHEN 5 THEN 'texto' WHEN 6 THEN 'oferta'
  ELSE 'Tercera fecha de remate' END AS cabecera FROM avisos""")
def header(spark, sf):
    h = nt.detect_header(F.col("text"))
    return validated(spark, sf).select("id", h["valid"].alias("valida"), h["header"].alias("cabecera"))


@query("fil14_auction_body", views=("avisos",), oracle="SELECT id, id % 4 = 0 AS cuerpo FROM avisos")
def auction_body(spark, sf):
    t = F.expr("concat('SERVIRÁ de base para\\n el remate ', expediente, IF(id % 2 = 0, ' postura', ''), IF(id % 4 < 2, ' pública subasta', ''))")
    return v.notices(spark, sf).select("id", nt.is_auction_body(t).alias("cuerpo"))


@query("fil15_cover_and_full", views=("avisos",), oracle="""
SELECT id, id % 4 IN (0, 1, 3) AS portada, id % 4 = 2 AS completo FROM avisos""")
def cover_full(spark, sf):
    t = F.expr("CASE id % 4 WHEN 0 THEN concat('FINCA ', finca_matr, ' en venta') WHEN 1 THEN 'Remate hoy' "
               "WHEN 2 THEN concat('AVISO DE REMATE FINCA No. ', finca_matr, ' BASE $ DEMANDANTE X') ELSE 'Resumen de la semana' END")
    return v.notices(spark, sf).select("id", nt.cover_summary(t).alias("portada"), nt.full_notice(t).alias("completo"))


@query("ext7_section_types", views=("avisos",), oracle="""
SELECT id, (['HEADER','VALORES','PARTIES','UBICACION','DESCRIPCION','VALORES','UNKNOWN'])[id % 7 + 1] AS tipo FROM avisos""")
def section_types(spark, sf):
    t = F.expr("element_at(array('AVISO DE REMATE', 'Base: $ 10 y fianza', 'demandante Ana', 'Provincia de Colón', 'lote 4', 'canon', 'nada'), CAST(id % 7 AS INT) + 1)")
    return v.notices(spark, sf).select("id", extract.section_type(t).alias("tipo"))


@query("ext6_label_values", views=("avisos",), oracle="""
SELECT id, unnest(['expediente', 'proceso', 'demandante', 'fecha', 'provincia']) AS field,
  unnest([expediente, expediente, 'Ana Rios', '5 de mayo', 'COLON']) AS value,
  unnest([1.0::DOUBLE, 1.0::DOUBLE, 0.9::DOUBLE, 0.9::DOUBLE, 0.9::DOUBLE]) AS confidence FROM avisos""")
def label_values(spark, sf):
    s = v.notices(spark, sf).selectExpr("id", "expediente", "posexplode(array(concat('Expediente: ', expediente, ', de oficio'), "
                                                      "'Demandante: Ana Rios\\nFecha: 5 de mayo', 'Provincia: COLON')) AS (section, text)")
    s = s.withColumn("confidence", F.expr("IF(section = 0, 0.85D, 0D)"))
    return extract.label_values(s, ["id"])


@query("ext8_goods_category", views=("avisos",), oracle="""
SELECT id, (['VEHICULO','APARTAMENTO','CASA','MISCELANEO','MISCELANEO','TERRENO'])[id % 6 + 1] AS categoria,
  (['INSOLVENCIA','MONITARIO','EJECUTIVO HIPOTECARIO','EJECUTIVO','SUMARIO','Otro Juicio'])[id % 6 + 1] AS proceso FROM avisos""")
def goods_category(spark, sf):
    g = F.expr("element_at(array('camioneta 2010', 'Aparamento 3', 'cas. 4', 'CUOTA PARTE', 'garaje', 'predio'), CAST(id % 6 AS INT) + 1)")
    p = F.expr("element_at(array('insolvencia judicial', 'Monitorio', 'ejecutivo hipotecario', 'Ejecutivo', 'sumario', 'otro juicio'), CAST(id % 6 AS INT) + 1)")
    return v.notices(spark, sf).select("id", extract.goods_category(g).alias("categoria"), extract.process_of(p).alias("proceso"))


@query("ext10_replies", oracle="""
SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'aprobado' WHEN 1 THEN 'rechazado' END AS respuesta,
  CASE WHEN event_id % 5 < 2 THEN user_id END AS aviso_id FROM events""")
def replies(spark, sf):
    t = F.expr("CASE event_id % 5 WHEN 0 THEN concat(' si ', user_id) WHEN 1 THEN concat('NO  ', user_id) WHEN 2 THEN concat('SI ', user_id, ' ya') "
               "WHEN 3 THEN 'SI x1' ELSE concat('quizas ', user_id) END")
    from gavelwork.operators.lifecycle import parse_reply
    r = parse_reply(t)
    return v.table(spark, sf, "events").select(F.col("event_id").alias("id"), r["respuesta"].alias("respuesta"), r["aviso_id"].alias("aviso_id"))


@query("set5_unique_lines", oracle=r"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS ls FROM documents),
k AS (SELECT doc_id, ls, list_transform(ls, lambda s: upper(regexp_replace(s, '\s+', ' ', 'g'))) AS ks FROM l)
SELECT doc_id, array_to_string(list_filter(ls, lambda s, i: list_position(ks, ks[i]) = i), chr(10)) AS texto FROM k""")
def unique_lines(spark, sf):
    return nt.unique_lines(v.texts(spark, sf), out="texto").select("doc_id", "texto")


@query("str_n5_banners", views=("avisos",), oracle="""
SELECT id, expediente || chr(10) || 'fin' AS limpio FROM avisos""")
def banners(spark, sf):
    t = F.expr("concat('EDICTO 810\\n', IF(id % 2 = 0, 'AVISO DE REMATE IC Publica tus judiciales llamando al 204-0000 204-0045 correo : "
               "judiciales@laestrella.com.pa 10 estrellaonline laestrellaonline\\n', 'judiciales@laestrella.com.pa\\n'), expediente, '  \\n\\n\\n', "
               "IF(id % 3 = 0, 'edicto 44  fin', 'fin'))")
    cleaned = nt.remove_banners(t)
    return v.notices(spark, sf).select("id", F.regexp_replace(F.regexp_replace(cleaned, r" +\n", "\n"), r"\n +", "\n").alias("limpio"))


@query("str_n8_sentences", oracle=r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM documents),
m AS (SELECT doc_id, array_to_string(list_transform(ws, lambda x: x || CASE WHEN regexp_matches(x, '[.!?]$')
  AND NOT length(regexp_replace(x, '[.!?]+$', '')) IN (1, 2)
  AND NOT regexp_full_match(regexp_replace(x, '[.!?]+$', ''), '[A-ZÁÉÍÓÚÑ](\.[A-ZÁÉÍÓÚÑ])*') THEN chr(1) ELSE ' ' END), '') AS t FROM w),
s AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(1)), lambda x: trim(x)), lambda x: x <> '') AS ss FROM m)
SELECT doc_id, len(ss)::INT AS oraciones, ss[1] AS primera, ss[-1] AS ultima FROM s""")
def sentence_split(spark, sf):
    d = v.texts(spark, sf).select("doc_id", nt.sentences(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").alias("oraciones"), F.get("s", F.lit(0)).alias("primera"), F.try_element_at("s", F.lit(-1)).alias("ultima"))


@query("str_n9_cover_description", views=("avisos",), oracle="""
SELECT id, CASE id % 3 WHEN 0 THEN (100 + id % 900)::VARCHAR || '.50 M2, LAGO AZUL, CORR: ARENA, DIST: CENTRO.'
  WHEN 1 THEN 'Aviso corto ' || id::VARCHAR || '.' ELSE 'Bien situado numero ' || id::VARCHAR || ' de la calle.' END AS portada FROM avisos""")
def cover(spark, sf):
    t = F.expr("""CASE id % 3 WHEN 0 THEN concat('Se vende ', 100 + id % 900, '.50 M2, LAGO AZUL, CORR: ARENA, DIST: CENTRO, ', repeat('mas texto ', 30))
      WHEN 1 THEN concat('Aviso corto ', id, '\\nAviso corto ', id) ELSE concat('EXPEDIENTE\\n', repeat('', 1), 'Bien situado numero ', id, ' de la calle. ',
      repeat('palabras sobrantes del texto ', 20), '.') END""")
    d = v.notices(spark, sf).select("id", F.when(F.col("id") % 3 == 2, F.regexp_replace(t, "EXPEDIENTE\n", "")).otherwise(t).alias("text"))
    return nt.cover_description(d).select("id", "portada")


@query("str_n9_cover_on_documents")
def cover_documents(spark, sf):
    d = v.texts(spark, sf)
    return nt.cover_description(d).select("doc_id", "portada")


@query("str_n9_summary", views=("avisos",), oracle="""
SELECT id, CASE id % 3 WHEN 0 THEN 'finca ' || finca_matr WHEN 1 THEN array_to_string(list_transform(range(30), lambda x: 'pal'), ' ')
  ELSE 'corta ' || finca_matr END AS resumen FROM avisos""")
def summary(spark, sf):
    t = F.expr("CASE id % 3 WHEN 0 THEN concat('finca ', finca_matr, ', Linderos: ', repeat('norte ', 40)) WHEN 1 THEN repeat('pal ', 50) ELSE concat(' corta ', finca_matr) END")
    return v.notices(spark, sf).select("id", nt.summarize(t).alias("resumen"))


@query("str_n10_map_location", views=("avisos",), oracle="""
SELECT id, CASE id % 6 WHEN 0 THEN 'Residencial Las Lomas' WHEN 1 THEN 'Villa Sol, ' || provincia WHEN 2 THEN 'Ancon, ' || provincia
  WHEN 3 THEN 'Arraijan, ' || provincia WHEN 4 THEN 'Lote corto, ' || provincia ELSE provincia END AS prevista FROM avisos""")
def map_location(spark, sf):
    a = v.avisos(spark, sf)
    given = F.expr("IF(id % 6 = 0, ' Residencial Las Lomas', 'corta')")
    full = F.expr("CASE id % 6 WHEN 1 THEN 'UBICA\\nCION : Villa  Sol, lote 3' WHEN 2 THEN 'en Corregimiento: Ancon, PA' WHEN 3 THEN 'LOTE 212, Arraiján. x' ELSE 'nada' END")
    full = F.translate(full, "á", "a")
    short = F.expr("CASE WHEN id % 6 = 4 THEN 'Lote corto' WHEN id % 6 = 5 THEN repeat('x', 200) END")
    return a.select("id", nt.map_location(given, full, short, F.col("provincia"), F.col("lugar")).alias("prevista"))


@query("win16_best_window", oracle=r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(range(0, len(ws), 17)) AS i, ws FROM w),
t AS (SELECT doc_id, i, array_to_string(ws[i + 1 : i + 35], ' ') AS x, least(35, len(ws) - i) AS n FROM s),
k AS (SELECT doc_id, i, x, len(regexp_extract_all(x, '(?i)CASA|CON CEATA|CON\s+CEDULA|REMATE|BASE\s+DEL\s+REMATE|VALOR\s+BASE|FINCA|LOTE|TERRENO|MÉTODO|MEDIANA'))::DOUBLE / n
  + CASE WHEN regexp_matches(x, '(?i)AVISO\s+DE\s+REMATE|REMATE\s+JUDICIAL|SUBASTA\s+JUDICIAL') THEN 2 ELSE 0 END AS sc FROM t)
SELECT doc_id, arg_max(x, sc * 1000000 - i) AS ventana FROM (SELECT doc_id, x, i, sc FROM k) GROUP BY doc_id""")
def best_window(spark, sf):
    d = v.texts(spark, sf)
    return nt.best_window_by_key(d, "doc_id", "text").select("doc_id", "ventana")


@query("win18_anchor_slice", views=("avisos",), oracle="""
SELECT id, 'previo ' || expediente || ' cuerpo ' AS ventana FROM avisos""")
def anchor_slice(spark, sf):
    from gavelwork.operators.splitting import slice_at_docket
    t = F.expr("concat('previo ', expediente, ' cuerpo AVISO DE REMATE otro ', id)")
    return v.notices(spark, sf).select("id", slice_at_docket(t, F.col("expediente")).alias("ventana"))


@query("jsn1_tolerant_json", views=("avisos",), oracle="""
SELECT id, CASE id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN NULL ELSE 0 END::INT AS avisos,
  CASE id % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE END AS confianza FROM avisos""")
def tolerant_json(spark, sf):
    from gavelwork.sources.ocr import tolerant_array
    t = F.expr("""CASE id % 4 WHEN 0 THEN '[{"e":"a","c":"1.0"},{"e":"b","c":"x"}]' WHEN 1 THEN '[{"e":"a","c":0.5},{"e":"b","c":0.'
      WHEN 2 THEN 'sin json' ELSE '[]' END""")
    arr = tolerant_array(t, "array<struct<e:string,c:string>>")
    return v.notices(spark, sf).select("id", F.when(arr.isNotNull(), F.size(arr)).alias("avisos"),
                                                     F.get(arr, F.lit(0))["c"].try_cast("double").alias("confianza"))


PLACE = """CASE upper(provincia) WHEN 'PANAMA' THEN 'Panamá' WHEN 'PANAMA OESTE' THEN 'Panamá Oeste' WHEN 'COLON' THEN 'Colón' WHEN 'CHIRIQUI' THEN 'Chiriquí' WHEN 'COCLE' THEN 'Coclé'
  WHEN 'BOCAS DEL TORO' THEN 'Bocas del Toro' WHEN 'BOGOTA' THEN 'Bogotá' WHEN 'CORDOBA' THEN 'Córdoba' WHEN 'LOS SANTOS' THEN 'Los Santos' WHEN 'ZONA LIBRE' THEN 'Zona Libre'
  ELSE upper(left(provincia, 1)) || lower(substr(provincia, 2)) END"""


@query("map1_normalize_by_type", views=("avisos",), oracle=f"""
SELECT id, unnest(['fecha', 'base', 'demandante', 'provincia', 'fianza_porcentaje', 'proceso']) AS field,
  unnest([strftime(fecha, '%Y-%m-%d'), format('{{:.2f}}', CAST(base AS DOUBLE)), 'Customer ' || right(demandante, 9), {PLACE}, format('{{:.2f}}', fianza_porcentaje), proceso]) AS normalized
FROM avisos""")
def normalize_by_type(spark, sf):
    from gavelwork.operators.normalize import normalize_long
    a = v.balanced(v.avisos(spark, sf))
    cols = ["fecha", "base", "demandante", "provincia", "fianza_porcentaje", "proceso"]
    long = a.select("id", *[F.col(c).cast("string").alias(c) for c in cols]).unpivot("id", cols, "field", "value")
    return normalize_long(long).select("id", "field", "normalized")
