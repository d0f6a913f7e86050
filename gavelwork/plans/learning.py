"""Learning queries: suggestions, rules, aliases, reuse of corrections."""

from pyspark.sql import functions as F

from gavelwork.functions import lookups as lk
from gavelwork.operators import learning as ln
from gavelwork.operators import quality as q
from gavelwork.operators import rule_versions as rv
from gavelwork.registry import query
from gavelwork.sources import views as v

NORM = "regexp_replace(translate(upper(trim({0})), 'ÁÉÍÓÚÜÑ', 'AEIOUUN'), '[^A-Z0-9]', '', 'g')"
PA = ", ".join(f"'{k.replace(' ', '')}'" for k in lk.PA_PROVINCE_CODES)
CO = ", ".join(f"'{k.replace(' ', '').replace('.', '')}'" for k in lk.CO_DEPARTMENT_CODES)


@query("agg33_suggestions", views=("correcciones",), oracle=f"""
WITH c AS (SELECT *, {NORM.format('valor_nuevo')} AS nn, {NORM.format('valor_anterior')} AS onn, (SELECT count(*) FROM correcciones)::DOUBLE AS total FROM correcciones),
r AS (SELECT 'correccion_repetida' AS tipo, campo, pais, min(valor_nuevo) AS valor_sugerido, min(valor_anterior) AS valor_referencia, count(*) AS n,
  least(0.99, 0.5 + count(*) / any_value(total) * 5) AS confianza, NULL::VARCHAR AS alternativas FROM c GROUP BY campo, pais, onn, nn HAVING count(*) >= 2),
s AS (SELECT campo, pais, nn, trim(valor_nuevo) AS forma, count(*) AS k, any_value(total) AS total FROM c WHERE nn <> '' GROUP BY 1, 2, 3, 4),
a AS (SELECT 'alias' AS tipo, campo, pais, arg_min(forma, length(forma)::VARCHAR || forma) AS valor_sugerido, NULL::VARCHAR, sum(k)::BIGINT AS n, least(0.95, 0.6 + sum(k) / any_value(total)) AS confianza,
  string_agg(forma, '|' ORDER BY length(forma), forma) AS alternativas FROM s GROUP BY campo, pais, nn HAVING count(*) >= 2 AND sum(k) >= 2),
e AS (SELECT DISTINCT 'etiqueta_nueva', campo, pais, trim(valor_nuevo), NULL::VARCHAR, 1::BIGINT, 0.5::DOUBLE, NULL::VARCHAR FROM c WHERE trim(valor_nuevo) <> '' AND
  ((campo = 'categoria' AND upper(trim(valor_nuevo)) NOT IN ('CASA', 'APARTAMENTO', 'TERRENO', 'VEHICULO', 'MISCELANEO')) OR (campo = 'provincia' AND
   ((pais = 1 AND nn NOT IN ({PA})) OR (pais = 2 AND nn NOT IN ({CO})))))),
w AS (SELECT 'campo_vacio_frecuente', campo, NULL::INT, NULL::VARCHAR, NULL::VARCHAR, count(*) AS n, least(0.9, 0.4 + count(*) / any_value(total)), NULL::VARCHAR FROM c WHERE era_vacio
  GROUP BY campo HAVING count(*) >= 2 ),
u AS (SELECT * FROM r UNION ALL SELECT * FROM a UNION ALL SELECT * FROM e UNION ALL SELECT * FROM w),
d AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY tipo, campo, pais, valor_sugerido ORDER BY confianza DESC, n, valor_referencia NULLS FIRST) = 1)
SELECT tipo, campo, pais, valor_sugerido, valor_referencia, n, round(confianza::DOUBLE, 6) AS confianza, alternativas FROM d
ORDER BY CASE WHEN pais = 1 THEN 0 ELSE 1 END, d.confianza DESC, tipo, campo, pais NULLS FIRST, valor_sugerido NULLS FIRST""")
def suggestions(spark, sf):
    return ln.suggestions(v.correcciones(spark, sf)).withColumn("confianza", F.round("confianza", 6))


@query("srt4_canonical_spelling", views=("correcciones",), oracle=f"""
SELECT campo, {NORM.format('valor_nuevo')} AS norma, arg_min(trim(valor_nuevo), lpad(length(trim(valor_nuevo))::VARCHAR, 5, '0') || trim(valor_nuevo)) AS canonica FROM correcciones GROUP BY 1, 2""")
def canonical(spark, sf):
    from gavelwork.functions.text import key_alnum
    c = v.correcciones(spark, sf).withColumn("f", F.trim("valor_nuevo"))
    return c.groupBy("campo", key_alnum(F.col("valor_nuevo")).alias("norma")).agg(F.min_by("f", F.struct(F.length("f"), "f")).alias("canonica"))


@query("srt3_country_first", views=("correcciones",), oracle="""
SELECT pais, campo, n FROM (SELECT pais, campo, count(*) AS n FROM correcciones GROUP BY 1, 2) ORDER BY CASE WHEN pais = 1 THEN 0 ELSE 1 END, n DESC, campo LIMIT 7""")
def country_first(spark, sf):
    g = v.correcciones(spark, sf).groupBy("pais", "campo").agg(F.count("*").alias("n"))
    return g.orderBy(F.when(F.col("pais") == 1, 0).otherwise(1), F.col("n").desc(), "campo").limit(7)


CAT = """CASE WHEN regexp_matches(valor_nuevo, '\\d') AND NOT regexp_matches(valor_nuevo, '[A-ZÁÉ]') THEN CASE WHEN contains(valor_nuevo, '-') THEN 'CASE_NUMBER' ELSE 'PROPERTY' END
  WHEN regexp_matches(upper(valor_nuevo), '[\\d,\\.]+') AND regexp_matches(upper(contexto), 'BASE|VALOR') THEN 'MONEY'
  WHEN regexp_matches(upper(contexto), 'DEMANDANTE|DEMANDADO|DEUDOR|ACREEDOR') AND regexp_matches(upper(valor_nuevo), '[A-ZÁÉÍÓÚÑ]{3,}') THEN 'PERSON' ELSE 'LABEL' END"""


def values(spark, sf):
    return v.correcciones(spark, sf).withColumns({
        "valor_nuevo": F.expr("CASE campo WHEN 'expediente' THEN concat(id % 900 + 100, '-24') WHEN 'lugar' THEN concat('JUZGADO ', valor_nuevo) WHEN 'provincia' THEN concat('5.', id % 9, 'K') ELSE valor_nuevo END"),
        "contexto": F.expr("IF(campo = 'demandante', concat('DEMANDANTE ', valor_nuevo), contexto)"), "confidence": F.expr("(50 + id % 51) / 100D")})


VAL = """vals AS (SELECT id, campo, CASE campo WHEN 'expediente' THEN (id % 900 + 100)::VARCHAR || '-24' WHEN 'lugar' THEN 'JUZGADO ' || valor_nuevo WHEN 'provincia' THEN '5.' || (id % 9)::VARCHAR || 'K'
  ELSE valor_nuevo END AS valor_nuevo, CASE WHEN campo = 'demandante' THEN 'DEMANDANTE ' || valor_nuevo ELSE contexto END AS contexto, (50 + id % 51)::DOUBLE / 100 AS confidence FROM correcciones)"""


@query("rul16_correction_category", views=("correcciones",), oracle=f"WITH {VAL} SELECT id, campo, {CAT} AS categoria FROM vals")
def correction_category(spark, sf):
    return values(spark, sf).select("id", "campo", ln.correction_category(F.col("valor_nuevo"), F.col("campo"), F.col("contexto")).alias("categoria"))


@query("agg34_rule_candidates", views=("correcciones",), oracle=f"""
WITH {VAL}, k AS (SELECT campo, {CAT} AS cat, count(*) AS n FROM vals GROUP BY 1, 2), m AS (SELECT campo, arg_max(cat, n) AS category, sum(n)::BIGINT AS n FROM k GROUP BY 1),
c AS (SELECT campo, round(CAST(sum(CAST(confidence AS DECIMAL(6,4))) AS DOUBLE) / count(*) * 0.9::DOUBLE + 1e-9, 4) AS confidence FROM vals GROUP BY 1)
SELECT campo, category, n, CASE category WHEN 'MONEY' THEN '([\\$B/\\.\\s]*[\\d\\.,]+(?:\\s*(?:B/?\\.|USD|dólares|pesos))?)' WHEN 'CASE_NUMBER' THEN '([\\d\\-]+)'
  ELSE 'JUZGADO\\ (.+?)(?:$|\\s)' END AS pattern, confidence FROM m JOIN c USING (campo) WHERE category IN ('MONEY', 'CASE_NUMBER') OR campo = 'lugar'""")
def rule_candidates(spark, sf):
    return ln.rule_candidates(values(spark, sf))


@query("agg34_rule_evidence", views=("correcciones",), oracle="""
SELECT campo, id FROM correcciones QUALIFY row_number() OVER (PARTITION BY campo ORDER BY id) <= 5""")
def rule_evidence(spark, sf):
    return ln.evidence_sample(v.correcciones(spark, sf)).select("campo", "id")


@query("udaf1_common_prefix", views=("avisos",), oracle="""
WITH s AS (SELECT documento_id, min(expediente) AS lo, max(expediente) AS hi FROM avisos GROUP BY 1),
p AS (SELECT *, list_filter(range(1, length(lo) + 1), lambda i: substr(lo, i, 1) <> substr(hi, i, 1))[1] AS d FROM s)
SELECT documento_id, CASE WHEN d IS NULL THEN lo ELSE left(lo, (d - 1)::INT) END AS prefijo FROM p""")
def common_prefix(spark, sf):
    g = v.avisos(spark, sf, parties=False).groupBy("documento_id").agg(F.min("expediente").alias("lo"), F.max("expediente").alias("hi"))
    return g.select("documento_id", ln.common_prefix(F.col("lo"), F.col("hi")).alias("prefijo"))


PATTERNS = {("expediente", 0): "EXPEDIENTE:? ?N? ?([0-9]+-[0-9]+)", ("expediente", 1): "EXPEDIENTE N ([0-9]+)", ("demandante", 0): "PROMOVIDO POR ([A-Z0-9 ]+),",
            ("demandante", 1): "DEMANDANTE: ([A-Z ]+)", ("finca", 0): "FINCA ([0-9]+)", ("finca", 1): "N° ([0-9]+)", ("precio_base", 0): "BASE DEL REMATE: B/.([0-9,.]+)",
            ("precio_base", 1): "AVALUO COMERCIAL: .([0-9,.]+)", ("provincia", 0): "PROVINCIA DE ([A-Za-z ]+),", ("provincia", 1): "PROVINCIA"}
PAT_SQL = "(VALUES " + ", ".join(f"('{f}', {i}, '{p}')" for (f, i), p in PATTERNS.items()) + ") AS p(field_name, variante, pattern)"
RULES = f"""rl AS (SELECT field_name, variante, min(rule_id) AS rule_id, max(created_at) AS created_at, max(confidence) AS confidence FROM (SELECT *, (rule_id % 2)::INT AS variante FROM reglas)
  GROUP BY 1, 2), rp AS (SELECT rl.*, pattern FROM rl JOIN {PAT_SQL} USING (field_name, variante))"""
HIT = f"""{RULES}, h AS (SELECT t.id AS document_id, r.field_name, r.rule_id, r.created_at, round(r.confidence * 0.9::DOUBLE, 4) AS confidence,
  CASE WHEN contains(pattern, '(') THEN regexp_extract(text, '(?i)' || pattern, 1) ELSE regexp_extract(text, '(?i)' || pattern) END AS value
  FROM avisos_texto t JOIN rp r ON regexp_matches(text, '(?i)' || pattern)),
hb AS (SELECT document_id, field_name, trim(value) AS value, rule_id, confidence FROM h QUALIFY row_number() OVER (PARTITION BY document_id, field_name ORDER BY created_at DESC, rule_id) = 1)"""


def rule_table(spark, sf):
    pats = spark.createDataFrame([(f, i, p) for (f, i), p in PATTERNS.items()], "field_name string, variante int, pattern string")
    r = v.reglas(spark, sf).withColumn("variante", F.expr("CAST(rule_id % 2 AS INT)"))
    g = r.groupBy("field_name", "variante").agg(F.min("rule_id").alias("rule_id"), F.max("created_at").alias("created_at"), F.max("confidence").alias("confidence"))
    return g.join(F.broadcast(pats), ["field_name", "variante"]).withColumn("status", F.lit("approved"))


def rule_texts(spark, sf):
    return v.avisos_texto(spark, sf).select(F.col("id").alias("document_id"), "text")


@query("joi23_rule_application", views=("avisos_texto", "reglas"), oracle=f"WITH {HIT} SELECT * FROM hb")
def rule_application(spark, sf):
    return ln.apply_rules(rule_texts(spark, sf), rule_table(spark, sf))


@query("rul13_knowledge_fallback", views=("avisos_texto", "reglas"), oracle=f"""
WITH {HIT}, p AS (SELECT id AS document_id, unnest(['expediente', 'finca']) AS field_name, unnest([CASE WHEN id % 2 = 0 THEN expediente END, CASE WHEN id % 3 = 0 THEN finca_matr END]) AS value FROM avisos_texto)
SELECT document_id, field_name, coalesce(p.value, hb.value) AS value, CASE WHEN p.value IS NOT NULL THEN 'parser' WHEN hb.value IS NOT NULL THEN 'knowledge' END AS source
FROM p LEFT JOIN hb USING (document_id, field_name)""")
def knowledge_fallback(spark, sf):
    p = v.avisos(spark, sf, parties=False).selectExpr("id AS document_id", "inline(array(named_struct('field_name', 'expediente', 'value', IF(id % 2 = 0, expediente, NULL)), "
                                                      "named_struct('field_name', 'finca', 'value', IF(id % 3 = 0, finca_matr, NULL))))")
    return ln.fill_with_rules(p, ln.apply_rules(rule_texts(spark, sf), rule_table(spark, sf)))


@query("agg35_regression_guard", views=("avisos_texto", "reglas"), oracle=f"""
WITH {HIT}, g AS (SELECT id AS document_id, unnest(['expediente', 'finca', 'provincia']) AS field_name, unnest([expediente, finca_matr, provincia]) AS expected,
  unnest([expediente, CASE WHEN id % 3 = 0 THEN finca_matr END, CASE WHEN id % 2 = 0 THEN provincia ELSE 'x' END]) AS pv FROM avisos_texto),
j AS (SELECT g.*, hb.value AS rv, coalesce(hb.value, pv) AS fv FROM g LEFT JOIN hb USING (document_id, field_name)),
s AS (SELECT field_name, count(pv) AS total_before, count(*) FILTER (pv = expected) AS correct_before, count(fv) AS total_after, count(*) FILTER (fv = expected) AS correct_after FROM j GROUP BY 1)
SELECT *, round(correct_before::DOUBLE / greatest(total_before, 1), 4) AS precision_before, round(correct_after::DOUBLE / greatest(total_after, 1), 4) AS precision_after,
  correct_after::DOUBLE / greatest(total_after, 1) < correct_before::DOUBLE / greatest(total_before, 1) AS regression,
  CASE WHEN correct_after::DOUBLE / greatest(total_after, 1) < correct_before::DOUBLE / greatest(total_before, 1) THEN 'REJECTED' ELSE 'APPROVED' END AS decision FROM s""")
def regression_guard(spark, sf):
    a = v.avisos(spark, sf)
    long = a.selectExpr("id AS document_id", """inline(array(named_struct('field_name', 'expediente', 'expected', expediente, 'value', expediente),
      named_struct('field_name', 'finca', 'expected', finca_matr, 'value', IF(id % 3 = 0, finca_matr, NULL)),
      named_struct('field_name', 'provincia', 'expected', provincia, 'value', IF(id % 2 = 0, provincia, 'x'))))""")
    return ln.regression_guard(long.select("document_id", "field_name", "expected"), long.select("document_id", "field_name", "value"),
                               ln.apply_rules(rule_texts(spark, sf), rule_table(spark, sf)))


@query("rul14_rule_lifecycle", views=("reglas",), oracle="""
WITH n AS (SELECT *, CASE WHEN status = 'pending' AND confidence >= 0.7 AND rule_id % 3 >= 1 THEN 'approved'
  WHEN status = 'approved' AND usage_count >= 5 AND success_count::DOUBLE / usage_count < 0.7 THEN 'inactive' ELSE status END AS nuevo_estado FROM reglas)
SELECT rule_id, status AS previous_status, nuevo_estado AS new_status, CASE WHEN usage_count = 0 THEN 0 ELSE round(success_count::DOUBLE / usage_count, 4) END AS accuracy_before FROM n WHERE nuevo_estado <> status""")
def lifecycle(spark, sf):
    r = v.reglas(spark, sf).withColumn("evidence", F.col("rule_id") % 3)
    return ln.rule_lifecycle(r)[1].select("rule_id", "previous_status", "new_status", "accuracy_before")


VERSIONS = """v1 AS (SELECT rule_id, 1::BIGINT AS version, NULL::VARCHAR AS previous_status, status AS new_status, 0::DOUBLE AS accuracy_before,
  CASE WHEN usage_count = 0 THEN 0 ELSE round(success_count::DOUBLE / usage_count, 4) END AS accuracy_after, 'Created' AS reason FROM reglas),
ev AS (SELECT rule_id, (rule_id % 97)::DOUBLE / 97 AS pb, (rule_id * 7 % 89)::DOUBLE / 89 AS pa FROM reglas),
v2 AS (SELECT rule_id, 2::BIGINT AS version, new_status AS previous_status, CASE WHEN pa < pb THEN 'rejected' ELSE 'approved' END AS new_status, accuracy_after AS accuracy_before, pa AS accuracy_after,
  CASE WHEN pa < pb THEN printf('Regression detected: %.2f%% -> %.2f%%', pb * 100, pa * 100) ELSE 'No regression detected. Approved by RegressionGuard.' END AS reason FROM v1 JOIN ev USING (rule_id) WHERE new_status = 'pending'),
l2 AS (SELECT * FROM v1 UNION ALL SELECT * FROM v2), c2 AS (SELECT * FROM l2 QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY version DESC) = 1),
v3 AS (SELECT rule_id, version + 1 AS version, new_status AS previous_status, 'pending' AS new_status, accuracy_after AS accuracy_before, 0::DOUBLE AS accuracy_after, 'Manual rollback to PENDING' AS reason
  FROM c2 WHERE rule_id % 13 = 0 AND new_status <> 'pending'),
lg AS (SELECT * FROM l2 UNION ALL SELECT * FROM v3)"""


def rule_log(spark, sf):
    """Rules as created, pending ones judged by the guard, then every thirteenth rolled back."""
    r = v.reglas(spark, sf)
    judged = rv.guarded(rv.opened(r), r.selectExpr("rule_id", "(rule_id % 97) / 97D AS precision_before", "(rule_id * 7 % 89) / 89D AS precision_after"))
    return rv.rolled_back(judged, r.filter("rule_id % 13 = 0"))


@query("rul14_rollback", views=("reglas",), oracle=f"WITH {VERSIONS} SELECT rule_id, version, previous_status, new_status, round(accuracy_before, 6) AS accuracy_before, accuracy_after, reason FROM v3")
def rollback(spark, sf):
    return rule_log(spark, sf).filter("reason = 'Manual rollback to PENDING'").withColumn("accuracy_before", F.round("accuracy_before", 6)).select(*rv.COLUMNS)


@query("rul14_rejected", views=("reglas",), oracle=f"""
WITH {VERSIONS}, c AS (SELECT * FROM lg QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY version DESC) = 1)
SELECT rule_id, version, previous_status, accuracy_before, round(accuracy_after, 6) AS accuracy_after, reason FROM c WHERE new_status = 'rejected'""")
def rejected_rules(spark, sf):
    return rv.rejected(rule_log(spark, sf)).withColumn("accuracy_after", F.round("accuracy_after", 6)).drop("new_status")


@query("rul14_history", views=("reglas",), oracle=f"""
WITH {VERSIONS} SELECT rule_id, row_number() OVER (PARTITION BY rule_id ORDER BY version DESC)::INT AS orden, version, previous_status, new_status, reason FROM lg""")
def rule_history(spark, sf):
    return rv.history(rule_log(spark, sf)).select("rule_id", "orden", "version", "previous_status", "new_status", "reason")


@query("joi12_rules_by_country", views=("reglas", "correcciones"), oracle="""
SELECT rule_id, field_name FROM reglas WHERE field_name IN (SELECT campo FROM correcciones WHERE pais = 1)""")
def rules_by_country(spark, sf):
    c = v.correcciones(spark, sf).filter("pais = 1").select(F.col("campo").alias("field_name"))
    return v.reglas(spark, sf).join(c, "field_name", "left_semi").select("rule_id", "field_name")


BUILT = "CASE s " + " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in ln.BUILTIN_ALIASES.items()) + " END"


@query("joi14_alias_resolution", views=("correcciones",), oracle=f"""
WITH t AS (SELECT id, campo AS field_name, CASE id % 4 WHEN 0 THEN 'exp' WHEN 1 THEN 'pnama' WHEN 2 THEN 'JDO 1' ELSE valor_nuevo END AS term FROM correcciones),
a AS (SELECT upper(valor_anterior) AS source, upper(valor_nuevo) AS target, campo AS field_name, CASE WHEN id % 5 = 0 THEN 'APPROVED' ELSE 'PENDING' END AS status, (id % 10)::DOUBLE / 10 AS confidence
  FROM correcciones WHERE valor_anterior <> ''),
b AS (SELECT source, field_name, target FROM a QUALIFY row_number() OVER (PARTITION BY source, field_name ORDER BY status = 'APPROVED' DESC, confidence DESC, target DESC) = 1),
u AS (SELECT id, t.field_name, term, upper(trim(term)) AS s FROM t)
SELECT id, u.field_name, term, coalesce({BUILT}, target, term) AS resuelto FROM u LEFT JOIN b ON b.source = s AND b.field_name = u.field_name""")
def alias_resolution(spark, sf):
    c = v.correcciones(spark, sf)
    terms = c.selectExpr("id", "campo AS field_name", "CASE id % 4 WHEN 0 THEN 'exp' WHEN 1 THEN 'pnama' WHEN 2 THEN 'JDO 1' ELSE valor_nuevo END AS term")
    aliases = c.filter("valor_anterior <> ''").selectExpr("upper(valor_anterior) AS source", "upper(valor_nuevo) AS target", "campo AS field_name",
                                                          "IF(id % 5 = 0, 'APPROVED', 'PENDING') AS status", "(id % 10) / 10D AS confidence", "false AS is_builtin")
    return ln.resolve_aliases(terms, aliases)


@query("rul15_alias_learning", views=("correcciones",), oracle="""
SELECT upper(trim(valor_anterior)) AS source, upper(trim(valor_nuevo)) AS target, campo AS field_name, count(*) AS n, max((id % 11)::DOUBLE / 10) AS confidence,
  CASE WHEN max((id % 11)::DOUBLE / 10) >= 0.8 THEN 'APPROVED' ELSE 'PENDING' END AS status FROM correcciones
WHERE upper(trim(valor_anterior)) <> upper(trim(valor_nuevo)) AND length(trim(valor_anterior)) >= 2 GROUP BY 1, 2, 3""")
def alias_learning(spark, sf):
    return ln.learn_aliases(v.correcciones(spark, sf).withColumn("confidence", F.expr("(id % 11) / 10D")))


@query("rul15_alias_normalize", views=("correcciones",), oracle="""
SELECT id, 'EXPEDIENTEDIENTE ' || id::VARCHAR || ' EN PANAMA CALLE 5' AS normalizado FROM correcciones""")
def alias_normalize(spark, sf):
    aliases = v.correcciones(spark, sf).filter("valor_anterior = 'PNAMA'").groupBy(F.col("campo").alias("field_name"), F.col("valor_anterior").alias("source")).agg(
        F.lit("PANAMA").alias("target"), F.lit("APPROVED").alias("status"), F.lit(0.9).alias("confidence"))
    t = v.correcciones(spark, sf).select("id", F.col("campo").alias("field_name"), F.expr("concat('exp ', id, ' EN pnama c/ 5')").alias("text"))
    out = ln.normalize_with_aliases(t, aliases)
    return out.select("id", F.regexp_replace("normalizado", " +", " ").alias("normalizado"))


KW = "list_distinct(regexp_extract_all(upper({0}), '[A-ZÁÉÍÓÚÑa-záéíóúñ]{{4,}}'))"


@query("joi9_apply_learning", views=("avisos_texto", "correcciones"), oracle=f"""
WITH l AS (SELECT * FROM correcciones),
c AS (SELECT pais, campo, id, valor_nuevo, creado_en, {KW.format('contexto')} AS kw FROM l),
n AS (SELECT id AS aviso_id, pais, {KW.format('text')} AS kw, unnest([CASE WHEN id % 2 = 0 THEN 'provincia' END, CASE WHEN id % 3 = 0 THEN 'lugar' END, CASE WHEN id % 5 = 0 THEN 'categoria' END]) AS campo FROM avisos_texto),
p AS (SELECT aviso_id, n.campo, c.id AS correccion_id, valor_nuevo AS valor, creado_en, len(list_intersect(n.kw, c.kw))::DOUBLE AS i, len(n.kw) + len(c.kw) AS s FROM n JOIN c ON n.pais = c.pais AND n.campo = c.campo),
q AS (SELECT *, i / (s - i) AS sim FROM p)
SELECT aviso_id, campo, valor, correccion_id, round(sim, 4) AS similitud FROM q WHERE sim >= 0.15
QUALIFY row_number() OVER (PARTITION BY aviso_id, campo ORDER BY sim DESC, creado_en DESC, correccion_id DESC) = 1""")
def learned(spark, sf):
    n = v.avisos_texto(spark, sf).selectExpr("id", "pais", "text", "IF(id % 2 = 0, '', 'x') AS provincia", "IF(id % 3 = 0, NULL, 'x') AS lugar", "IF(id % 5 = 0, '', 'x') AS categoria")
    return ln.apply_learning(n, v.correcciones(spark, sf), ["provincia", "lugar", "categoria"])
