"""Quality, operations and text-statistics queries."""

from pyspark.sql import functions as F

from gavelwork.functions import lookups as lk
from gavelwork.operators import quality as q
from gavelwork.registry import query
from gavelwork.sources import views as v

DECISIONS = ["VALID", "INVALID", "DUPLICATED", "LIKELY_DUPLICATED", "INCOMPLETE", "INCONSISTENT", "REQUIRES_REVIEW"]
DEC_SQL = "dec AS (SELECT id, documento_id, ([" + ",".join(f"'{d}'" for d in DECISIONS) + "])[id % 7 + 1] AS decision, " \
    "(id % 101)::DOUBLE / 100 AS score, (id * 3 % 101)::DOUBLE / 100 AS confidence FROM avisos)"


def decisions(spark, sf):
    return v.avisos(spark, sf, parties=False).select(
        "id", "documento_id", F.expr(v.pick(DECISIONS, "id % 7")).alias("decision"), F.expr("(id % 101) / 100D").alias("score"),
        F.expr("(id * 3 % 101) / 100D").alias("confidence"))


POS = "round(CAST(sum(CASE WHEN {0} > 0 THEN CAST({0} AS DECIMAL(18,4)) END) AS DOUBLE) / count(*) FILTER ({0} > 0) + 1e-9, 4)"
MEAN = "round(CAST(sum(CAST({0} AS DECIMAL(18,{1}))) AS DOUBLE) / count({0}) + 1e-9, {2})"


@query("agg6_validation_summary", views=("avisos",), oracle=f"""
WITH {DEC_SQL} SELECT count(*) AS total_avisos, count(*) FILTER (decision = 'VALID') AS valid_count, count(*) FILTER (decision = 'INVALID') AS invalid_count,
  count(*) FILTER (decision IN ('DUPLICATED', 'LIKELY_DUPLICATED')) AS duplicated_count, count(*) FILTER (decision = 'INCOMPLETE') AS incomplete_count,
  count(*) FILTER (decision = 'INCONSISTENT') AS inconsistent_count, count(*) FILTER (decision = 'REQUIRES_REVIEW') AS review_count,
  {POS.format('score')} AS avg_score FROM dec""")
def validation_summary(spark, sf):
    return q.validation_summary(decisions(spark, sf))


@query("agg7_certification_report", views=("avisos",), oracle=f"""
WITH {DEC_SQL} SELECT count(DISTINCT documento_id) AS documents_processed, count(*) AS total_avisos, count(*) FILTER (decision = 'VALID') AS valid,
  count(*) FILTER (decision = 'INVALID') AS invalid, count(*) FILTER (decision IN ('DUPLICATED', 'LIKELY_DUPLICATED')) AS duplicated,
  count(*) FILTER (decision = 'INCOMPLETE') AS incomplete, count(*) FILTER (decision = 'INCONSISTENT') AS inconsistent,
  count(*) FILTER (decision = 'REQUIRES_REVIEW') AS requires_review, {POS.format('score')} AS avg_score, {POS.format('confidence')} AS avg_confidence,
  round(count(*) FILTER (decision = 'VALID') * 100::DOUBLE / count(*), 2) AS valid_pct,
  round(count(*) FILTER (decision IN ('VALID', 'DUPLICATED', 'LIKELY_DUPLICATED')) * 100::DOUBLE / count(*), 2) AS auto_approved_pct,
  round(count(*) FILTER (decision = 'REQUIRES_REVIEW') * 100::DOUBLE / count(*), 2) AS manual_review_pct FROM dec""")
def certification_report(spark, sf):
    return q.certification_report(decisions(spark, sf))


def results(spark, sf):
    return v.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("document_id"), (1 + F.col("o_orderkey") % 4).alias("avisos_detectados"),
        F.expr(v.pick(DECISIONS, "o_orderkey % 7")).alias("decision"),
        F.expr("IF(o_orderkey % 9 = 0, 'DUPLICATED', 'UNIQUE')").alias("nivel_duplicado"), F.expr("(70 + o_orderkey % 31) / 100D").alias("ocr"),
        F.expr("(o_orderkey % 101) / 100D").alias("score"), (F.col("o_orderkey") % 3).alias("errores"), (F.col("o_orderkey") % 5).alias("warnings"),
        F.expr("(o_orderkey % 1000) / 10D").alias("total_ms"))


RES_SQL = "res AS (SELECT o_orderkey AS document_id, 1 + o_orderkey % 4 AS avisos_detectados, ([" + ",".join(f"'{d}'" for d in DECISIONS) + """])[o_orderkey % 7 + 1] AS decision,
  CASE WHEN o_orderkey % 9 = 0 THEN 'DUPLICATED' ELSE 'UNIQUE' END AS nivel_duplicado, (70 + o_orderkey % 31)::DOUBLE / 100 AS ocr,
  (o_orderkey % 101)::DOUBLE / 100 AS score, o_orderkey % 3 AS errores, o_orderkey % 5 AS warnings, (o_orderkey % 1000)::DOUBLE / 10 AS total_ms FROM orders)"""


@query("agg8_operational_metrics", views=("resultados_campo",), oracle=f"""
WITH {RES_SQL}, f AS (SELECT document_id, count(DISTINCT field) FILTER (status = 'FOUND' AND field <> 'lugar') AS found,
  max((source = 'knowledge')::INT) AS knowledge FROM resultados_campo GROUP BY 1)
SELECT count(*) AS documentos_procesados, sum(avisos_detectados)::BIGINT AS avisos_detectados, count(*) FILTER (decision = 'VALID') AS avisos_validos,
  count(*) FILTER (decision IN ('INVALID', 'DUPLICATED', 'LIKELY_DUPLICATED')) AS avisos_descartados, count(*) FILTER (nivel_duplicado <> 'UNIQUE') AS duplicados,
  {MEAN.format('ocr', 4, 3)} AS ocr_promedio, round(sum(coalesce(found, 0))::DOUBLE * 12.5::DOUBLE / count(*), 2) AS parser_accuracy,
  round(sum(coalesce(knowledge, 0))::DOUBLE * 100 / count(*), 2) AS knowledge_usage,
  round(CAST(sum(CAST(score AS DECIMAL(8,4))) AS DOUBLE) * 100 / count(*), 2) AS validator_acceptance,
  round(count(*) FILTER (decision = 'VALID') * 100::DOUBLE / count(*), 2) AS certification_rate, sum(errores)::BIGINT AS errores, sum(warnings)::BIGINT AS warnings,
  round({MEAN.format('total_ms', 2, 4)}, 2) AS tiempo_promedio_ms FROM res LEFT JOIN f USING (document_id)""")
def operational_metrics(spark, sf):
    return q.operational_metrics(results(spark, sf), v.resultados_campo(spark, sf))


STATS = """count(*) AS n, round(CAST(sum(CAST(duration_ms AS DECIMAL(18,2))) AS DOUBLE), 2) AS total_ms,
  round(CAST(sum(CAST(duration_ms AS DECIMAL(18,2))) AS DOUBLE) / count(*), 2) AS avg_ms, max(duration_ms) AS max_ms, min(duration_ms) AS min_ms,
  round(stddev_pop(duration_ms), 2) AS std_ms"""


@query("agg9_stage_stats", views=("etapas",), oracle=f"SELECT stage, {STATS} FROM etapas GROUP BY stage")
def stage_stats(spark, sf):
    return q.stage_stats(v.etapas(spark, sf))


@query("agg9_slowest_stage", views=("etapas",), oracle=f"SELECT stage, {STATS} FROM etapas GROUP BY stage ORDER BY avg_ms DESC, stage LIMIT 1")
def slowest_stage(spark, sf):
    return q.slowest_stage(v.etapas(spark, sf))


@query("agg9_run_totals", views=("etapas",), oracle=f"""
WITH r AS (SELECT document_id, CAST(sum(CAST(duration_ms AS DECIMAL(18,2))) AS DOUBLE) AS duration_ms FROM etapas GROUP BY 1) SELECT {STATS} FROM r""")
def run_totals(spark, sf):
    return q.run_totals(v.etapas(spark, sf))


NAMES = ["accuracy:match_rate", "performance:throughput", "performance:time_ms", "reliability:success_rate", "resource:memory_mb"]
METRIC_SQL = "mp AS (SELECT split_part(x, ':', 1) AS category, split_part(x, ':', 2) AS name, value FROM (SELECT ([" + ",".join(f"'{n}'" for n in NAMES) + \
    "])[event_id % 5 + 1] AS x, value FROM events))"


def metric_points(spark, sf):
    e = v.table(spark, sf, "events").select(F.expr(v.pick(NAMES, "event_id % 5")).alias("x"), "value")
    return e.select(F.split("x", ":")[0].alias("category"), F.split("x", ":")[1].alias("name"), "value")


@query("agg10_metric_categories", oracle=f"""
WITH {METRIC_SQL} SELECT category, count(*) AS n, {MEAN.format('value', 4, 4)} AS avg, round(min(value), 4) AS min, round(max(value), 4) AS max FROM mp GROUP BY 1""")
def metric_categories(spark, sf):
    return q.metric_categories(metric_points(spark, sf))


@query("agg10_metric_summary", oracle=f"""
WITH {METRIC_SQL}, a AS (SELECT name, {MEAN.format('value', 4, 4)} AS m FROM mp GROUP BY 1)
SELECT max(m) FILTER (name = 'match_rate') AS avg_match_rate, max(m) FILTER (name = 'throughput') AS avg_throughput, max(m) FILTER (name = 'time_ms') AS avg_time,
  max(m) FILTER (name = 'success_rate') AS avg_success_rate, max(m) FILTER (name = 'memory_mb') AS avg_memory_mb FROM a""")
def metric_summary(spark, sf):
    return q.metric_summary(metric_points(spark, sf))


PRF_BASE = """o AS (SELECT *, CASE WHEN part % 9 = 0 THEN NULL WHEN status = 'FOUND' AND vote <> 0 THEN 'tp' WHEN status = 'FOUND' THEN 'fp' ELSE 'fn' END AS r FROM resultados_campo)"""
PRF = """count(*) FILTER (r = 'tp') AS tp, count(*) FILTER (r = 'fp') AS fp, count(*) FILTER (r = 'fn') AS fn"""
PRF_OUT = """tp, fp, fn, round(p, 4) AS precision, round(rc, 4) AS recall, round(CASE WHEN p + rc = 0 THEN 0 ELSE 2 * p * rc / (p + rc) END, 4) AS f1,
  round(CASE WHEN tp + fp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp + fn) END, 4) AS accuracy"""
PR = "CASE WHEN tp + fp = 0 THEN {0} ELSE tp::DOUBLE / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END AS rc"


def outcomes(spark, sf):
    r = v.resultados_campo(spark, sf).withColumn("expected", F.expr("IF(part % 9 = 0, '', CAST(part AS STRING))"))
    return r.withColumn("resultado", q.outcome(F.col("expected"), F.col("part").cast("string"), F.col("status"), F.col("vote") != 0))


@query("agg11_precision_recall", views=("resultados_campo",), oracle=f"""
WITH {PRF_BASE}, g AS (SELECT country, field, {PRF} FROM o GROUP BY 1, 2), h AS (SELECT *, {PR.format('0')} FROM g) SELECT country, field, {PRF_OUT} FROM h""")
def precision_recall(spark, sf):
    return q.precision_recall(outcomes(spark, sf), ["country", "field"])


@query("agg11_micro_totals", views=("resultados_campo",), oracle=f"""
WITH {PRF_BASE}, g AS (SELECT {PRF} FROM o), h AS (SELECT *, {PR.format('1')} FROM g) SELECT {PRF_OUT} FROM h""")
def micro_totals(spark, sf):
    return q.precision_recall(outcomes(spark, sf), [], empty_precision=1.0)


@query("agg11_label_precision", oracle=f"""
WITH g AS (SELECT lang, count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality = 1 AND toxic = 1) AS fp, count(*) FILTER (quality = 0) AS fn
  FROM labels JOIN documents USING (doc_id) GROUP BY lang), h AS (SELECT *, {PR.format('0')} FROM g) SELECT lang, {PRF_OUT} FROM h""")
def label_precision(spark, sf):
    j = v.table(spark, sf, "labels").join(v.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    j = j.withColumn("resultado", F.expr("IF(quality = 1, IF(toxic = 0, 'tp', 'fp'), 'fn')"))
    return q.precision_recall(j, ["lang"])


@query("agg12_regression_rollup", views=("resultados_campo",), oracle="""
SELECT country, field, count(*) FILTER (vote <> 0) AS matches, count(*) AS total, round(count(*) FILTER (vote <> 0) * 100::DOUBLE / count(*), 1) AS accuracy
FROM resultados_campo GROUP BY ROLLUP (country, field)""")
def regression_rollup(spark, sf):
    return q.regression_report(v.resultados_campo(spark, sf).withColumn("match", F.col("vote") != 0))


@query("agg12_record_match_rate", views=("resultados_campo",), oracle="""
WITH r AS (SELECT document_id, country, min((vote <> 0)::INT) AS m FROM resultados_campo GROUP BY 1, 2)
SELECT country, count(*) AS total, sum(m)::BIGINT AS matches, round(sum(m)::DOUBLE * 100 / count(*), 1) AS match_rate FROM r GROUP BY 1""")
def record_match_rate(spark, sf):
    return q.record_match_rate(v.resultados_campo(spark, sf).select(
        F.col("document_id").alias("record_id"), "country", (F.col("vote") != 0).alias("match")))


STORED = "CASE field WHEN 'finca' THEN 'finca_matr' WHEN 'precio_base' THEN 'base' WHEN 'fecha_remate' THEN 'fecha' ELSE field END"
PRIO = "CASE field WHEN 'fecha' THEN 'high' WHEN 'lugar' THEN 'medium' ELSE 'critical' END"


def compared(spark, sf):
    return v.resultados_campo(spark, sf).select(F.expr(STORED).alias("field"), (F.col("vote") < 4).alias("exact"), (F.col("vote") < 6).alias("norm"))


ACC = f"""a AS (SELECT field, count(*) AS n, round(count(*) FILTER (vote < 4)::DOUBLE / count(*), 4) AS exact_accuracy,
  round(count(*) FILTER (vote < 6)::DOUBLE / count(*), 4) AS normalized_accuracy FROM (SELECT {STORED} AS field, vote FROM resultados_campo) GROUP BY 1)"""


@query("agg13_field_accuracy", views=("resultados_campo",), oracle=f"WITH {ACC} SELECT *, {PRIO} AS priority FROM a")
def field_accuracy(spark, sf):
    return q.field_accuracy(compared(spark, sf))


@query("agg13_priority_accuracy", views=("resultados_campo",), oracle=f"""
WITH {ACC} SELECT {PRIO} AS priority, count(*) AS fields, round(CAST(sum(CAST(exact_accuracy AS DECIMAL(18,4))) AS DOUBLE) / count(*), 4) AS exact_accuracy FROM a GROUP BY 1""")
def priority_accuracy(spark, sf):
    return q.priority_accuracy(compared(spark, sf))


@query("agg14_field_quality", views=("resultados_campo",), oracle="""
SELECT field, country, document_id, count(*) FILTER (status = 'FOUND') AS found, count(*) FILTER (status = 'NOT_FOUND') AS not_found,
  count(*) FILTER (status = 'REQUIRES_REVIEW') AS review, count(*) FILTER (status = 'FOUND' AND source = 'parser') AS found_parser,
  count(*) FILTER (status = 'FOUND' AND source = 'knowledge') AS found_knowledge, count(*) FILTER (status = 'FOUND' AND source = 'ai') AS found_ia
FROM resultados_campo GROUP BY GROUPING SETS ((field), (country, field), (document_id, field))""")
def field_quality(spark, sf):
    return q.field_quality(v.resultados_campo(spark, sf))


def ai_rows(spark, sf):
    return v.resultados_campo(spark, sf).selectExpr(
        "field AS campo", "concat('modelo-', part % 3) AS modelo", "confidence", "status AS decision",
        "CASE vote WHEN 0 THEN NULL WHEN 1 THEN 'NOT_FOUND' ELSE 'FOUND' END AS final_status")


AI_SQL = """ai AS (SELECT field AS campo, 'modelo-' || (part % 3)::VARCHAR AS modelo, confidence,
  CASE WHEN status = 'FOUND' AND vote <> 1 THEN 'aceptado' WHEN status = 'FOUND' THEN 'corregido' ELSE 'rechazado' END AS w FROM resultados_campo)"""


@query("agg15_ai_feedback", views=("resultados_campo",), oracle=f"""
WITH {AI_SQL} SELECT campo, modelo, count(*) AS total, count(*) FILTER (w = 'aceptado') AS aceptados, count(*) FILTER (w = 'rechazado') AS rechazados,
  count(*) FILTER (w = 'corregido') AS corregidos, round(count(*) FILTER (w = 'aceptado')::DOUBLE / count(*), 4) AS tasa_aceptacion,
  {MEAN.format('confidence', 4, 4)} AS confianza_media FROM ai GROUP BY GROUPING SETS ((campo), (modelo), ())""")
def ai_feedback(spark, sf):
    return q.ai_feedback(ai_rows(spark, sf))


@query("agg16_slow_stages", views=("etapas",), oracle=f"SELECT stage, {STATS} FROM etapas GROUP BY stage ORDER BY avg_ms DESC, stage LIMIT 8")
def slow_stages(spark, sf):
    return q.stage_stats(v.etapas(spark, sf)).orderBy(F.col("avg_ms").desc(), "stage").limit(8)


@query("agg16_top_messages", oracle="""
SELECT repeat('error en ' || event_type || ' ', 20) AS mensaje, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, mensaje LIMIT 10""")
def top_messages(spark, sf):
    return q.message_top(v.table(spark, sf, "events").select(F.expr("repeat(concat('error en ', event_type, ' '), 20)").alias("m")), "m")


@query("agg16_decision_histogram", views=("avisos",), oracle=f"""
WITH {DEC_SQL}, {RES_SQL} SELECT 'decision' AS columna, decision AS valor, count(*) AS n FROM res GROUP BY 2
UNION ALL SELECT 'nivel_duplicado', nivel_duplicado, count(*) FROM res GROUP BY 2""")
def decision_histogram(spark, sf):
    return q.histogram(results(spark, sf), "decision", "nivel_duplicado")


@query("agg17_knowledge_by_field", views=("reglas",), oracle="""
SELECT field_name, count(*) AS reglas, sum(usage_count)::BIGINT AS usos, sum(success_count)::BIGINT AS aciertos,
  round(sum(success_count)::DOUBLE / greatest(sum(usage_count), 1), 4) AS accuracy FROM reglas WHERE status = 'approved' GROUP BY 1""")
def knowledge_by_field(spark, sf):
    return q.usage_accuracy(v.reglas(spark, sf).filter("status = 'approved'"), ["field_name"])


@query("agg17_knowledge_status", views=("reglas",), oracle="SELECT 'status' AS columna, status AS valor, count(*) AS n FROM reglas GROUP BY 2 "
       "UNION ALL SELECT 'field_name', field_name, count(*) FROM reglas GROUP BY 2")
def knowledge_status(spark, sf):
    return q.histogram(v.reglas(spark, sf), "status", "field_name")


@query("agg17_top_rules", views=("reglas",), oracle="""
(SELECT 'usadas' AS lista, rule_id, usage_count AS n FROM reglas WHERE status = 'approved' AND usage_count > 0 ORDER BY n DESC, rule_id LIMIT 10)
UNION ALL (SELECT 'fallidas', rule_id, usage_count - success_count AS n FROM reglas WHERE status = 'approved' AND usage_count > success_count ORDER BY n DESC, rule_id LIMIT 10)""")
def top_rules(spark, sf):
    r = v.reglas(spark, sf).filter("status = 'approved'").withColumn("fail_count", F.expr("usage_count - success_count"))
    return q.top_rules(r, "usage_count").select(F.lit("usadas").alias("lista"), "rule_id", F.col("usage_count").alias("n")).unionByName(
        q.top_rules(r, "fail_count").select(F.lit("fallidas").alias("lista"), "rule_id", F.col("fail_count").alias("n")))


@query("agg19_knowledge_impact", views=("reglas", "correcciones"), oracle="""
WITH o AS (SELECT aviso_id AS source_document_id, arg_min(pais, id) AS p FROM correcciones GROUP BY 1)
SELECT rule_id, field_name, status, usage_count, success_count, usage_count - success_count AS fail_count,
  CASE WHEN usage_count = 0 THEN 0 ELSE round(success_count::DOUBLE / usage_count, 4) END AS accuracy,
  CASE p WHEN 1 THEN 'PA' WHEN 2 THEN 'CO' ELSE 'N/A' END AS pais FROM reglas LEFT JOIN o USING (source_document_id)""")
def knowledge_impact(spark, sf):
    return q.knowledge_impact(v.reglas(spark, sf), v.correcciones(spark, sf).withColumnRenamed("aviso_id", "source_document_id"))


@query("joi13_rule_origin", views=("reglas", "correcciones"), oracle="""
WITH o AS (SELECT aviso_id AS d, arg_min(pais, id) AS p FROM correcciones GROUP BY 1)
SELECT CASE p WHEN 1 THEN 'PA' WHEN 2 THEN 'CO' ELSE 'N/A' END AS pais, count(*) AS n FROM reglas LEFT JOIN o ON d = source_document_id GROUP BY 1""")
def rule_origin(spark, sf):
    return knowledge_impact(spark, sf).groupBy("pais").agg(F.count("*").alias("n"))


@query("agg20_problem_fields", views=("correcciones",), oracle="""
SELECT campo, count(*) AS veces, count(*) FILTER (era_vacio) AS vacios, count(DISTINCT regexp_replace(translate(upper(valor_nuevo), 'ÁÉÍÓÚÑ', 'AEIOUN'), '[^A-Z0-9]', '', 'g')) AS variantes
FROM correcciones GROUP BY 1 ORDER BY veces DESC, campo LIMIT 10""")
def problem_fields(spark, sf):
    return q.problem_fields(v.correcciones(spark, sf))


@query("agg20_duplicate_keys", views=("avisos",), oracle="""
WITH k AS (SELECT id, (id % 500)::VARCHAR || '|' || finca_matr AS clave FROM avisos), g AS (SELECT clave, count(*) AS n FROM k GROUP BY 1 HAVING count(*) > 1)
SELECT clave, n, id FROM g JOIN k USING (clave)""")
def duplicate_keys(spark, sf):
    a = v.avisos(spark, sf, parties=False).withColumn("expediente", F.expr("CAST(id % 500 AS STRING)"))
    return q.duplicate_keys(a)


@query("agg21_correction_evolution", views=("correcciones",), oracle="""
SELECT campo, valor_anterior, valor_nuevo, count(*) AS n, strftime(max(creado_en), '%Y-%m-%d %H:%M:%S') AS ultima FROM correcciones
GROUP BY 1, 2, 3 ORDER BY n DESC, campo, valor_anterior, valor_nuevo LIMIT 20""")
def correction_evolution(spark, sf):
    return q.correction_evolution(v.correcciones(spark, sf)).withColumn("ultima", F.date_format("ultima", "yyyy-MM-dd HH:mm:ss"))


@query("agg22_learning_summary", views=("correcciones",), oracle="""
SELECT campo, count(*) AS total, count(*) FILTER (era_vacio) AS vacios FROM correcciones WHERE pais = 1 GROUP BY 1 ORDER BY total DESC, campo LIMIT 5""")
def learning_summary(spark, sf):
    return q.learning_summary(v.correcciones(spark, sf).filter("pais = 1"))


def country_texts(spark, sf):
    return v.avisos_texto(spark, sf).select(F.expr("IF(pais = 1, 'PA', 'CO')").alias("country"), "text")


TXT = "t AS (SELECT CASE WHEN pais = 1 THEN 'PA' ELSE 'CO' END AS country, text FROM avisos_texto)"


def _duck_patterns(patterns):
    return " UNION ALL ".join(
        "SELECT country, '{0}' AS kind, unnest(regexp_extract_all(text, '{1}', {2})) AS value FROM t".format(k, p.replace("(?iu)", "(?i)").replace("'", "''"), g)
        for k, p, g in patterns)


@query("agg23_country_statistics", views=("avisos_texto",), oracle=f"""
WITH {TXT}, m AS ({_duck_patterns(q.STAT_PATTERNS)}), g AS (SELECT country, kind, upper(value) AS value, count(*) AS n FROM m GROUP BY 1, 2, 3)
SELECT country, kind, value, n FROM g""")
def country_statistics(spark, sf):
    return q.country_statistics(country_texts(spark, sf))


GOLDEN_FIELDS = ["expediente", "demandante", "demandado", "base", "fianza_porcentaje", "minimo_porcentaje", "finca_matr", "fecha", "provincia", "lugar", "proceso", "categoria", "descripcion"]
MUNICIPAL_TEXTS = "t AS (SELECT CASE WHEN pais = 1 THEN 'PA' ELSE 'CO' END AS country, text || CASE WHEN id % 3 = 0 THEN chr(10) || 'en el municipio de ' || provincia || '. ;' ELSE '' END AS text FROM avisos_texto)"


def municipal_texts(spark, sf):
    """Printed notices, every third with the line that names its municipality."""
    t = v.avisos_texto(spark, sf)
    line = F.when(F.col("id") % 3 == 0, F.concat(F.lit("\nen el municipio de "), "provincia", F.lit(". ;"))).otherwise("")
    return t.select(F.when(F.col("pais") == 1, "PA").otherwise("CO").alias("country"), F.concat("text", line).alias("text"))


@query("agg23_municipalities", views=("avisos_texto",), oracle=f"""
WITH {MUNICIPAL_TEXTS}, m AS (SELECT country, unnest(regexp_extract_all(upper(text), '{q.MUNICIPALITY.replace("'", "''")}', 1)) AS m FROM t)
SELECT country, trim(regexp_replace(m, '^\\s+|\\s+$', '', 'g'), ' .') AS municipio, count(*) AS n FROM m GROUP BY 1, 2 HAVING municipio <> ''""")
def municipalities(spark, sf):
    return q.municipalities(municipal_texts(spark, sf))


@query("agg23_expressions", views=("avisos_texto",), oracle=f"""
WITH {TXT}, w AS (SELECT country, regexp_extract_all(upper(text), '[A-ZÁÉÍÓÚÑ]{{3,}}') AS w FROM t),
g AS (SELECT country, unnest(list_concat(list_concat(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' ')), list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))),
  list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))) AS expresion FROM w)
SELECT country, expresion, count(*) AS n FROM g GROUP BY 1, 2 HAVING count(*) >= 25""")
def expressions(spark, sf):
    return q.expressions(country_texts(spark, sf), 25)


FIELD_CATALOG = list(q.FIELD_EVIDENCE)


@query("joi19_unused_fields", views=("avisos", "resultados_campo"), oracle=f"""
WITH c AS (SELECT unnest({FIELD_CATALOG}) AS field), u AS (SELECT DISTINCT field FROM resultados_campo WHERE status = 'FOUND'),
g AS (SELECT unnest([""" + ", ".join(f"CASE WHEN count({c}) > 0 THEN '{c}' END" for c in GOLDEN_FIELDS) + """]) AS field FROM avisos),
k AS (SELECT field FROM g WHERE field IS NOT NULL UNION SELECT CASE field WHEN 'base' THEN 'precio_base' WHEN 'finca_matr' THEN 'finca' WHEN 'fecha' THEN 'fecha_remate' END FROM g)
SELECT 'nunca_usado' AS lista, field FROM c WHERE field NOT IN (SELECT field FROM u) UNION ALL SELECT 'nunca_evaluado', field FROM c WHERE field NOT IN (SELECT field FROM k WHERE field IS NOT NULL)""")
def unused_fields(spark, sf):
    """The catalogue against what the results found and what the golden notices hold."""
    counts = v.avisos(spark, sf).agg(*[F.count(c).alias(c) for c in GOLDEN_FIELDS])
    golden = counts.select(F.explode(F.array(*[F.when(F.col(c) > 0, F.lit(c)) for c in GOLDEN_FIELDS])).alias("field")).filter("field IS NOT NULL")
    catalog = spark.createDataFrame([(c,) for c in FIELD_CATALOG], "field string")
    return q.unused_fields(catalog, v.resultados_campo(spark, sf), golden)


@query("srt2_top_per_group", views=("correcciones",), oracle="""
WITH g AS (SELECT campo, valor_nuevo, count(*) AS n FROM correcciones GROUP BY 1, 2)
SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY campo ORDER BY n DESC, valor_nuevo) <= 3""")
def top_per_group(spark, sf):
    g = v.correcciones(spark, sf).groupBy("campo", "valor_nuevo").agg(F.count("*").alias("n"))
    return q.top_k(g, ["campo"], [F.col("n").desc(), "valor_nuevo"], 3)


def lang_texts(spark, sf):
    return v.balanced(v.table(spark, sf, "documents").select(F.col("lang").alias("country"), "text"))


@query("agg24_word_frequency", oracle="""
WITH w AS (SELECT lang AS country, upper(unnest(regexp_extract_all(text, '[A-Za-zÁÉÍÓÚÑáéíóúñ]{3,}'))) AS palabra FROM documents),
g AS (SELECT country, palabra, count(*) AS n FROM w GROUP BY 1, 2)
SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY country ORDER BY n DESC, palabra) <= 100""")
def word_frequency(spark, sf):
    return q.word_frequency(lang_texts(spark, sf))


GOLDEN = GOLDEN_FIELDS


@query("agg25_golden_coverage", views=("avisos",), oracle="WITH n AS (SELECT count(*) AS total, " + ", ".join(f"count({c}) AS {c}" for c in GOLDEN) +
       " FROM avisos), l AS (UNPIVOT n ON " + ", ".join(GOLDEN) + " INTO NAME field VALUE present) SELECT *, round(present * 100::DOUBLE / total, 1) AS coverage_pct FROM l")
def golden_coverage(spark, sf):
    return q.golden_coverage(v.avisos(spark, sf), GOLDEN)


@query("agg25_golden_issues", views=("avisos",), oracle="""
WITH a AS (SELECT documento_id % 5 AS suite, CASE WHEN id % 40 = 0 THEN '' ELSE expediente END AS e, base, (id % 90 = 0) AS sin FROM avisos)
SELECT suite, 'sin_expediente' AS problema, count(*) AS n FROM a WHERE e = '' GROUP BY 1
UNION ALL SELECT suite, 'sin_demandante', count(*) FROM a WHERE sin GROUP BY 1
UNION ALL SELECT suite, 'base_invalida', count(*) FROM a WHERE base IS NULL OR base <= 0 GROUP BY 1
UNION ALL SELECT suite, 'exceso', count(*) FROM a GROUP BY 1 HAVING count(*) > 100 * (1 + suite)""")
def golden_issues(spark, sf):
    a = v.avisos(spark, sf, parties=False).selectExpr("documento_id % 5 AS suite", "IF(id % 40 = 0, '', expediente) AS expediente",
                                                      "IF(id % 90 = 0, NULL, 'x') AS demandante", "base", "100 * (1 + documento_id % 5) AS expected_count")
    return q.golden_issues(a)


EVID = ", ".join(
    "sum(" + " + ".join("len(regexp_extract_all(text, '(?i){}'))".format(p) for p in ps) + f")::BIGINT AS {f}" for f, ps in q.FIELD_EVIDENCE.items())


@query("agg26_text_evidence", views=("avisos_texto",), oracle=f"""
WITH {TXT}, e AS (SELECT country, {EVID} FROM t GROUP BY 1), l AS (UNPIVOT e ON {', '.join(q.FIELD_EVIDENCE)} INTO NAME field VALUE n)
SELECT field, sum(n) FILTER (country = 'PA')::BIGINT AS "PA", sum(n) FILTER (country = 'CO')::BIGINT AS "CO" FROM l GROUP BY 1""")
def text_evidence(spark, sf):
    return q.text_evidence(country_texts(spark, sf))


CATALOG = ["expediente", "finca", "precio_base", "fecha_remate", "demandante", "demandado", "hora", "lugar", "provincia", "proceso", "plano"]


@query("joi15_catalog_coverage", views=("avisos_texto",), oracle=f"""
WITH {TXT}, e AS (SELECT country, {EVID} FROM t GROUP BY 1), l AS (UNPIVOT e ON {', '.join(q.FIELD_EVIDENCE)} INTO NAME field VALUE n),
s AS (SELECT CASE field WHEN 'matricula' THEN 'finca' WHEN 'avaluo' THEN 'precio_base' ELSE field END AS field,
  sum(n) FILTER (country = 'PA')::BIGINT AS pa, sum(n) FILTER (country = 'CO')::BIGINT AS co FROM l GROUP BY 1),
j AS (SELECT c.field, coalesce(pa, 0) AS pa, coalesce(co, 0) AS co FROM (VALUES {', '.join(f"('{c}')" for c in CATALOG)}) c(field) LEFT JOIN s USING (field))
SELECT *, pa + co = 0 AS nunca, pa + co BETWEEN 1 AND 2 AS casi_nunca, pa + co > 2 AS real, pa > 0 AND co = 0 AS solo_pa, co > 0 AND pa = 0 AS solo_co FROM j""")
def catalog_coverage(spark, sf):
    catalog = spark.createDataFrame([(c,) for c in CATALOG], "field string")
    return q.catalog_coverage(q.text_evidence(country_texts(spark, sf)), catalog)


CAND = " UNION ALL ".join(f"SELECT {i} AS regla, '{c}' AS country, trim(unnest(regexp_extract_all(text, '(?i){p}', 1))) AS value FROM t WHERE country = '{c}'"
                          for i, (c, f, p) in enumerate(q.RULE_CANDIDATES))


@query("agg27_candidate_analytics", views=("avisos_texto",), oracle=f"""
WITH {TXT}, m AS ({CAND}), g AS (SELECT regla, country, value, count(*) AS n FROM m GROUP BY 1, 2, 3),
f AS (SELECT regla, sum(n)::BIGINT AS frecuencia FROM g GROUP BY 1),
b AS (SELECT regla, string_agg(value, '; ' ORDER BY n DESC, value) AS ejemplos FROM (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY regla ORDER BY n DESC, value) <= 3) GROUP BY 1)
SELECT c.regla, c.country, c.campo, coalesce(frecuencia, 0) AS frecuencia, coalesce(ejemplos, '') AS ejemplos,
  CASE WHEN coalesce(frecuencia, 0) >= 3 THEN 'util' WHEN frecuencia >= 1 THEN 'aprendible' ELSE 'ignorable' END AS clase
FROM (VALUES {', '.join(f"({i}, '{c}', '{f}')" for i, (c, f, _) in enumerate(q.RULE_CANDIDATES))}) c(regla, country, campo) LEFT JOIN f USING (regla) LEFT JOIN b USING (regla)""")
def candidate_analytics(spark, sf):
    return q.candidate_analytics(country_texts(spark, sf))


@query("agg28_loss_attribution", views=("resultados_campo",), oracle="""
WITH x AS (SELECT field, status = 'FOUND' AND source = 'parser' AS p, status = 'FOUND' AND source = 'ai' AS a, status = 'FOUND' AS f FROM resultados_campo)
SELECT field, count(*) AS total, count(*) FILTER (NOT f AND NOT p) AS se_pierde_en_parser, count(*) FILTER (NOT f AND p) AS se_pierde_despues,
  count(*) FILTER (NOT p AND a) AS ia_recupera, count(*) FILTER (NOT p AND NOT a) AS parser_pierde FROM x GROUP BY 1""")
def loss_attribution(spark, sf):
    return q.loss_attribution(v.resultados_campo(spark, sf).selectExpr(
        "field", "status = 'FOUND' AND source = 'parser' AS parser_found", "status = 'FOUND' AND source = 'ai' AS ia_found", "status = 'FOUND' AS final_found"))


@query("agg29_discards", views=("avisos_texto",), oracle=r"""
WITH t AS (SELECT lang AS country, text FROM documents UNION ALL SELECT 'PA', CASE id % 3 WHEN 0 THEN 'EDICTO 5' ELSE text END FROM avisos_texto),
x AS (SELECT country, regexp_matches(text, '(?i)\bEDICTO\b') AS e, regexp_matches(text, '(?i)AVISO\s+DE\s+REMATE') AS n FROM t)
SELECT country, count(*) AS documentos, count(*) FILTER (e AND NOT n) AS descartados_correctos, count(*) FILTER (NOT e AND NOT n) AS descartados_incorrectos,
  count(*) FILTER (n) AS con_aviso FROM x GROUP BY 1""")
def discards(spark, sf):
    a = v.avisos_texto(spark, sf).select(F.lit("PA").alias("country"), F.expr("IF(id % 3 = 0, 'EDICTO 5', text)").alias("text"))
    return q.discard_report(lang_texts(spark, sf).unionByName(a))


@query("agg29_repeated_dockets", views=("avisos",), oracle="""
SELECT (id % 4000)::VARCHAR AS expediente, count(DISTINCT documento_id) AS documentos, min(documento_id) AS primero, max(documento_id) AS ultimo FROM avisos
GROUP BY 1 HAVING count(DISTINCT documento_id) > 1""")
def repeated_dockets(spark, sf):
    return q.repeated_dockets(v.avisos(spark, sf, parties=False).withColumn("expediente", F.expr("CAST(id % 4000 AS STRING)")))


@query("joi18_false_duplicates", views=("avisos",), oracle="""
WITH k AS (SELECT DISTINCT expediente AS clave FROM avisos), b AS (SELECT 'prefijo' AS lado, left(clave, 6) AS parte, clave FROM k
  UNION ALL SELECT 'sufijo', right(clave, 6), clave FROM k UNION ALL SELECT 'ambos', left(clave, 6) || '|' || right(clave, 6), clave FROM k)
SELECT lado, parte, count(*) AS n, min(clave) AS primera, max(clave) AS ultima, count(*) * (count(*) - 1) // 2 AS pares FROM b GROUP BY 1, 2 HAVING count(*) > 1""")
def false_duplicates(spark, sf):
    return q.false_duplicate_keys(v.avisos(spark, sf, parties=False).select(F.col("expediente").alias("clave")))


def evidence(spark, sf):
    return v.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS document_id", f"{v.pick(v.RESULT_FIELDS, '(l_linenumber - 1) % 3')} AS field", "CAST(l_partkey AS STRING) AS value",
        "(50 + l_partkey % 51) / 100D AS confidence", "l_linenumber * 1000000L + l_suppkey * 1000 + l_partkey % 1000 AS seq")


@query("agg30_best_evidence", oracle=f"""
WITH e AS (SELECT l_orderkey AS document_id, (['expediente', 'finca', 'precio_base'])[(l_linenumber - 1) % 3 + 1] AS field, l_partkey::VARCHAR AS value,
  (50 + l_partkey % 51)::DOUBLE / 100 AS confidence, l_linenumber * 1000000 + l_suppkey * 1000 + l_partkey % 1000 AS seq FROM lineitem),
w AS (SELECT *, row_number() OVER (PARTITION BY document_id, field ORDER BY confidence DESC, seq) AS rn, count(*) OVER (PARTITION BY document_id, field) AS evidencias FROM e)
SELECT document_id, field, value, confidence, evidencias FROM w WHERE rn = 1""")
def best_evidence(spark, sf):
    return q.best_evidence(evidence(spark, sf))


@query("agg30_evidence_summary", views=("resultados_campo",), oracle="""
SELECT count(*) AS total_evidence, count(*) FILTER (status = 'FOUND') AS found, count(*) FILTER (status = 'NOT_FOUND') AS not_found,
  count(*) FILTER (status = 'REQUIRES_REVIEW') AS requires_review, count(DISTINCT field) AS unique_fields FROM resultados_campo""")
def evidence_summary(spark, sf):
    return q.evidence_summary(v.resultados_campo(spark, sf))


@query("agg31_component_confidence", views=("resultados_campo",), oracle=f"""
SELECT document_id, coalesce(round(CAST(sum(CASE WHEN status = 'FOUND' THEN CAST(confidence AS DECIMAL(18,4)) END) AS DOUBLE) / nullif(count(*) FILTER (status = 'FOUND'), 0) + 1e-9, 4), 0) AS parser,
  {MEAN.format('confidence', 4, 4)} AS media, round(count(*) FILTER (status <> 'NOT_FOUND')::DOUBLE / count(*), 4) AS normalizacion FROM resultados_campo GROUP BY 1""")
def component_confidence(spark, sf):
    return q.component_confidence(v.resultados_campo(spark, sf))


@query("agg31_word_confidence", views=("palabras",), oracle=f"""
SELECT page, {MEAN.format('confidence', 4, 4)} AS ocr, count(*) AS palabras FROM palabras GROUP BY 1""")
def word_confidence(spark, sf):
    return q.word_confidence(v.palabras(spark, sf))


@query("agg32_trail_summary", views=("resultados_campo",), oracle=f"""
SELECT source, status, count(*) AS n, {MEAN.format('confidence', 4, 4)} AS avg_confidence FROM resultados_campo GROUP BY GROUPING SETS ((source), (status), ())""")
def trail_summary(spark, sf):
    return q.trail_summary(v.resultados_campo(spark, sf))


PROFILE = ["expediente", "demandante", "base", "fianza", "minimo", "plano", "codigo", "hora", "email"]
PROFILE_CATALOG = [("expediente", "text", True, True, True), ("demandante", "name", True, True, True), ("base", "currency", True, True, False),
                   ("fianza", "currency", False, True, True), ("email", "text", False, False, True), ("prevista", "text", True, True, True),
                   ("codigo", "text", True, False, True), ("hora", "text", True, True, True)]


@query("agg36_column_profile", views=("avisos",), oracle=f"""
WITH n AS (SELECT {', '.join(f"count(nullif({c}::VARCHAR, '')) AS {c}" for c in PROFILE if c != 'email')}, 0::BIGINT AS email FROM avisos),
l AS (UNPIVOT n ON {', '.join(PROFILE)} INTO NAME field VALUE frecuencia),
c(field, data_type, consumed, in_golden, documented) AS (VALUES {', '.join(f"('{a}', '{b}', {c}, {d}, {e})" for a, b, c, d, e in PROFILE_CATALOG)}),
j AS (SELECT coalesce(c.field, l.field) AS field, coalesce(frecuencia, 0) AS frecuencia, data_type, coalesce(consumed, false) AS co, coalesce(in_golden, false) AS go,
  coalesce(documented, false) AS doc FROM c FULL JOIN l ON c.field = l.field)
SELECT field, frecuencia, CASE WHEN field IN ('expediente', 'demandante', 'base') THEN 'critical' WHEN field = 'codigo' THEN 'high' WHEN frecuencia >= 10 THEN 'high'
  WHEN frecuencia >= 3 THEN 'medium' WHEN frecuencia > 0 THEN 'low' ELSE 'unknown' END AS prioridad, frecuencia > 0 AS producido, co AS consumido,
  frecuencia = 0 AND NOT co AS huerfano, CASE WHEN data_type IS NULL THEN 0 WHEN frecuencia = 0 AND NOT co THEN CASE WHEN go THEN 25 ELSE 0 END
  WHEN frecuencia = 0 THEN 50 WHEN NOT co THEN 75 WHEN NOT doc THEN 90 ELSE 100 END::INT AS puntaje FROM j""")
def column_profile(spark, sf):
    catalog = spark.createDataFrame(PROFILE_CATALOG, "field string, data_type string, consumed boolean, in_golden boolean, documented boolean")
    return q.column_profile(v.avisos(spark, sf).withColumn("email", F.lit("")), catalog, PROFILE)


@query("agg37_alias_hygiene", oracle="""
WITH a AS (SELECT 'campo' || (p_partkey % 40)::VARCHAR AS field, CASE WHEN p_partkey % 3 = 0 THEN 'campo' || (p_partkey % 50)::VARCHAR ELSE 'alias' || p_size::VARCHAR END AS alias FROM part),
o AS (SELECT alias, count(DISTINCT field) AS d, count(*) AS n FROM a GROUP BY 1)
SELECT alias, 'compartido' AS problema FROM o WHERE d > 1 UNION ALL SELECT alias, 'repetido' FROM o WHERE n > d
UNION ALL SELECT DISTINCT x.field, 'mutuo' FROM a x JOIN a y ON x.alias = y.field AND y.alias = x.field AND x.field < y.field""")
def alias_hygiene(spark, sf):
    a = v.table(spark, sf, "part").selectExpr("concat('campo', p_partkey % 40) AS field", "IF(p_partkey % 3 = 0, concat('campo', p_partkey % 50), concat('alias', p_size)) AS alias")
    return q.alias_hygiene(a)


@query("agg38_format_conflicts", views=("avisos",), oracle="""
SELECT field, data_type, count(*) AS valores, count(*) FILTER ((data_type = 'date' AND NOT regexp_full_match(value, '\\d{4}-\\d{2}-\\d{2}'))
  OR (data_type = 'number' AND NOT regexp_full_match(value, '-?\\d+(\\.\\d+)?'))) AS conflictos
FROM (SELECT 'fecha_prensa' AS field, 'date' AS data_type, fecha_prensa AS value FROM avisos UNION ALL SELECT 'pagina_prensa', 'number', pagina_prensa FROM avisos
  UNION ALL SELECT 'superficie', 'number', superficie FROM avisos) WHERE value IS NOT NULL GROUP BY 1, 2""")
def format_conflicts(spark, sf):
    long = v.avisos(spark, sf, parties=False).select("fecha_prensa", "pagina_prensa", "superficie").unpivot(
        [], ["fecha_prensa", "pagina_prensa", "superficie"], "field", "value")
    return q.format_conflicts(long.withColumn("data_type", F.expr("IF(field = 'fecha_prensa', 'date', 'number')")))


@query("agg39_keyword_counts", views=("avisos_texto",), oracle="SELECT id, keyword, n::INT AS n FROM (" + " UNION ALL ".join(
    f"SELECT id, '{k}' AS keyword, len(regexp_extract_all(upper(text), '{k}')) AS n FROM avisos_texto" for k in q.KEYWORDS) + ") WHERE n > 0")
def keyword_counts(spark, sf):
    return q.keyword_counts(v.avisos_texto(spark, sf).select("id", "text"), "id")


VOC = [("expresion", r"\b([A-ZÁÉÍÓÚÑ]{3,}(?:[ \t]+[A-ZÁÉÍÓÚÑ]{3,}){1,3})\b", 1), ("label_nuevo", r"\b([A-ZÁÉÍÓÚÑ]{4,})[ \t]*:", 1)]


@query("agg40_vocabulary", views=("avisos_texto",), oracle=f"""
WITH {TXT}, m AS ({_duck_patterns(VOC)}), g AS (SELECT country, kind, value, count(*) AS n FROM m GROUP BY 1, 2, 3),
x AS (SELECT * FROM g WHERE kind = 'expresion' AND value NOT IN ({', '.join(f"'{k}'" for k in q.KNOWN_EXPRESSIONS)})
      QUALIFY row_number() OVER (PARTITION BY country ORDER BY n DESC, value) <= 15),
y AS (SELECT * FROM g WHERE kind = 'label_nuevo' QUALIFY row_number() OVER (PARTITION BY country ORDER BY n DESC, value) <= 20)
SELECT * FROM x WHERE n >= 2 UNION ALL SELECT * FROM y WHERE n >= 2 AND value NOT IN ({', '.join(f"'{k}'" for k in q.KNOWN_LABELS)})""")
def vocabulary(spark, sf):
    return q.vocabulary_mining(country_texts(spark, sf))


DEF = r"""
WITH tok AS (SELECT lang AS country, unnest(regexp_extract_all(text, '[A-Za-zÁÉÍÓÚÑáéíóúñ0-9'']+')) AS t FROM documents),
w AS (SELECT country, upper(regexp_replace(t, '[^A-Za-zÁÉÍÓÚÑáéíóúñ]', '', 'g')) AS w, count(*) AS n FROM tok GROUP BY 1, 2 HAVING w <> ''),
pr AS (SELECT lang AS country, upper(unnest(regexp_extract_all(text, '([A-Za-zÁÉÍÓÚÑáéíóúñ]{3,})\s*-\s*([A-Za-zÁÉÍÓÚÑáéíóúñ]{3,})', 1))) AS a,
  upper(unnest(regexp_extract_all(text, '([A-Za-zÁÉÍÓÚÑáéíóúñ]{3,})\s*-\s*([A-Za-zÁÉÍÓÚÑáéíóúñ]{3,})', 2))) AS b FROM documents),
s1 AS (SELECT p.country, 'partida' AS kind, a || '-' || b || ' -> ' || a || b AS value, count(*) AS n FROM pr p JOIN w ON w.country = p.country AND w.w = a || b GROUP BY 1, 3),
c AS (SELECT country, w, n, unnest(range(3, length(w) - 2)) AS i FROM w WHERE length(w) >= 6),
s2 AS (SELECT c.country, 'unida' AS kind, left(c.w, min(i)::INT) || '+' || substr(c.w, min(i) + 1) || ' -> ' || left(c.w, min(i)::INT) || ' ' || substr(c.w, min(i) + 1) AS value, any_value(c.n) AS n
  FROM c JOIN w a ON a.country = c.country AND a.w = left(c.w, i::INT) JOIN w b ON b.country = c.country AND b.w = substr(c.w, i + 1) WHERE a.w <> b.w GROUP BY c.country, c.w),
ac AS (SELECT country, translate(w, 'ÁÉÍÓÚÑ', 'AEIOUN') AS plain, min(w) AS acc FROM w WHERE regexp_matches(w, '[ÁÉÍÓÚÑ]') GROUP BY 1, 2),
s3 AS (SELECT w.country, 'acento' AS kind, w || ' (sin acento) -> ' || acc AS value, n FROM w JOIN ac ON ac.country = w.country AND plain = w WHERE NOT regexp_matches(w, '[ÁÉÍÓÚÑ]') AND length(w) >= 3),
dg AS (SELECT country, upper(t) AS t, count(*) AS n FROM tok GROUP BY 1, 2 HAVING regexp_matches(upper(t), '[0-9]') AND length(upper(t)) >= 3),
mx AS (SELECT country, t, n, unnest([replace(t, '0', 'O'), replace(t, '1', 'I'), replace(t, '5', 'S'), replace(t, '8', 'B')]) AS v FROM dg),
s4 AS (SELECT m.country, 'confusion' AS kind, t || ' -> ' || v AS value, m.n FROM mx m JOIN w ON w.country = m.country AND w.w = v WHERE t <> v),
s5 AS (SELECT country, 'simbolo' AS kind, value, count(*) AS n FROM (SELECT lang AS country, unnest(regexp_extract_all(text, '[^A-Za-zÁÉÍÓÚÑáéíóúñ0-9\s.,:;()/"''-]')) AS value FROM documents) GROUP BY 1, 3),
u AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4 UNION ALL SELECT * FROM s5)
SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY country, kind ORDER BY n DESC, value) <= 40"""


@query("agg41_ocr_defects", oracle=DEF)
def ocr_defects(spark, sf):
    return q.ocr_defects(lang_texts(spark, sf))


@query("agg42_run_summary", views=("resultados_campo", "etapas"), oracle=f"""
WITH {RES_SQL} SELECT 'campo' AS grupo, field AS clave, count(*) FILTER (status = 'FOUND')::DOUBLE AS valor FROM resultados_campo GROUP BY 2
UNION ALL SELECT 'fuente', CASE WHEN source = 'ai' THEN 'ia' ELSE 'determinista' END, count(*) FILTER (status = 'FOUND')::DOUBLE FROM resultados_campo GROUP BY 2
UNION ALL SELECT 'etapa_ms', stage, round(CAST(sum(CAST(duration_ms AS DECIMAL(18,2))) AS DOUBLE) / count(*), 2) FROM etapas GROUP BY 2
UNION ALL SELECT 'decision', decision, count(*)::DOUBLE FROM res GROUP BY 2""")
def run_summary(spark, sf):
    return q.run_summary(v.resultados_campo(spark, sf), v.etapas(spark, sf), results(spark, sf))


@query("agg43_audit_statistics", oracle=f"""
WITH a AS (SELECT 'p' || (event_id % 3)::VARCHAR AS provider, event_type AS decision, user_id AS tokens, value AS latency_ms FROM events)
SELECT provider, decision, count(*) AS entries, sum(tokens)::BIGINT AS total_tokens, {MEAN.format('latency_ms', 3, 3)} AS avg_latency_ms FROM a
GROUP BY GROUPING SETS ((provider), (decision), ())""")
def audit_statistics(spark, sf):
    return q.audit_statistics(v.table(spark, sf, "events").selectExpr(
        "concat('p', event_id % 3) AS provider", "event_type AS decision", "user_id AS tokens", "value AS latency_ms"))


@query("agg44_document_rollup", views=("resultados_campo",), oracle=f"""
SELECT document_id, coalesce(string_agg(DISTINCT CASE WHEN status = 'FOUND' THEN field END, ',' ORDER BY CASE WHEN status = 'FOUND' THEN field END), '') AS found,
  coalesce(string_agg(DISTINCT CASE WHEN status = 'NOT_FOUND' THEN field END, ',' ORDER BY CASE WHEN status = 'NOT_FOUND' THEN field END), '') AS missing,
  coalesce(string_agg(DISTINCT CASE WHEN status = 'REQUIRES_REVIEW' THEN field END, ',' ORDER BY CASE WHEN status = 'REQUIRES_REVIEW' THEN field END), '') AS review,
  {POS.format('confidence')} AS confianza FROM resultados_campo GROUP BY 1""")
def document_rollup(spark, sf):
    return q.document_rollup(v.resultados_campo(spark, sf))
