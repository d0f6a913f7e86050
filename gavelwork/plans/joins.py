"""Matching, duplicate, republication and lifecycle queries."""

from pyspark.sql import functions as F

from gavelwork.operators import dedup, lifecycle, matching
from gavelwork.operators.quality import union
from gavelwork.registry import query
from gavelwork.sources import views as v


def side(spark, sf, name, value, conf):
    return v.resultados_campo(spark, sf).groupBy("document_id", "field").agg(
        F.expr(value).alias("value"), F.expr(conf).alias("confidence"), F.max("status").alias("status"))


@query("joi4_golden_match", views=("avisos",), oracle="""
SELECT g.expediente, g.id AS golden_id, p.id AS pred_id, (g.base = p.base) IS TRUE AS base_igual FROM avisos g JOIN (SELECT id, expediente, CASE WHEN id % 5 = 0 THEN base + 1 ELSE base END AS base
  FROM avisos WHERE estado <> 'eliminado') p USING (expediente) WHERE g.estado = 'subido'""")
def golden_match(spark, sf):
    a = v.avisos(spark, sf, parties=False)
    golden = a.filter("estado = 'subido'").select("expediente", F.col("id").alias("golden_id"), F.col("base").alias("gb"))
    pred = a.filter("estado <> 'eliminado'").selectExpr("expediente", "id AS pred_id", "CAST(IF(id % 5 = 0, base + 1, base) AS DECIMAL(18,2)) AS pb")
    inner, _ = matching.golden_match(golden, pred)
    return inner.select("expediente", "golden_id", "pred_id", F.coalesce(F.col("gb") == F.col("pb"), F.lit(False)).alias("base_igual"))


@query("joi4_not_in_golden", views=("avisos",), oracle="""
SELECT id, expediente FROM avisos WHERE estado <> 'eliminado' AND expediente NOT IN (SELECT expediente FROM avisos WHERE estado = 'subido')""")
def not_in_golden(spark, sf):
    a = v.avisos(spark, sf, parties=False)
    return matching.golden_match(a.filter("estado = 'subido'").select("expediente"), a.filter("estado <> 'eliminado'").select("expediente", "id"))[1].select("id", "expediente")


PFIELDS = ["expediente", "finca_matr", "base", "categoria", "proceso", "hora"]


@query("joi5_best_pairing", views=("avisos",), oracle="""
WITH l AS (SELECT id, documento_id, expediente, finca_matr, coalesce(base::VARCHAR, '') AS base, categoria, proceso, coalesce(hora, '') AS hora FROM avisos),
r AS (SELECT id, documento_id, CASE WHEN id % 3 = 0 THEN replace(expediente, '-', '.-') ELSE expediente END AS expediente, finca_matr,
  CASE WHEN id % 4 = 0 THEN '' ELSE base END AS base, categoria, CASE WHEN id % 2 = 0 THEN lower(proceso) ELSE proceso END AS proceso, hora FROM l),
p AS (SELECT l.id, l.documento_id, r.id AS rid, (l.expediente = r.expediente)::INT + (l.finca_matr = r.finca_matr)::INT + (l.base = r.base)::INT + (l.categoria = r.categoria)::INT
  + (l.proceso = r.proceso)::INT + (l.hora = r.hora)::INT AS exactos,
  (l.expediente <> r.expediente AND replace(l.expediente, '.', '') = replace(r.expediente, '.', ''))::INT + (l.proceso <> r.proceso AND l.proceso = upper(r.proceso))::INT AS normalizados
  FROM l JOIN r USING (documento_id))
SELECT id, documento_id AS document_id, rid, exactos, normalizados, round((exactos + normalizados * 0.5::DOUBLE) / 6, 4) AS score FROM p
QUALIFY row_number() OVER (PARTITION BY id ORDER BY exactos * 2 + normalizados DESC, rid) = 1""")
def best_pairing(spark, sf):
    a = v.balanced(v.avisos(spark, sf, parties=False)).select("id", F.col("documento_id").alias("document_id"), *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in PFIELDS])
    right = a.withColumns({"expediente": F.expr("IF(id % 3 = 0, replace(expediente, '-', '.-'), expediente)"), "base": F.expr("IF(id % 4 = 0, '', base)"),
                           "proceso": F.expr("IF(id % 2 = 0, lower(proceso), proceso)")})
    return matching.best_pairing(a, right, PFIELDS)


DUP_SRC = """dsrc AS (SELECT id, expediente, finca_matr AS finca, base::VARCHAR AS base, ((id % 1000000000) % 6 * 500)::VARCHAR || ':' || ((id % 1000000000) % 4001 * 30)::VARCHAR AS bbox,
  'AVISO ' || expediente || ' FINCA ' || finca_matr AS text FROM republicaciones)"""
COMBOS = [("expediente", "finca"), ("expediente", "base"), ("expediente", "bbox"), ("finca", "base"), ("finca", "bbox"), ("base", "bbox")]
FIRSTS = ", ".join(f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN min(id) OVER (PARTITION BY {a}, {b}) END AS p{i}" for i, (a, b) in enumerate(COMBOS))
TEXTS = ", ".join(f"CASE WHEN {a} IS NOT NULL THEN min(id) OVER (PARTITION BY {a}, text) END AS t{i}" for i, a in enumerate(dedup.DUPLICATE_KEYS))
PREVS = ", ".join(f"CASE WHEN {a} IS NOT NULL THEN lag(id) OVER (PARTITION BY {a} ORDER BY id) END AS l{i}" for i, a in enumerate(dedup.DUPLICATE_KEYS))
LOW = "least(" + ", ".join([f"CASE WHEN p{i} < id THEN p{i} END" for i in range(6)] + [f"CASE WHEN t{i} < id THEN t{i} END" for i in range(4)]) + ")"


def duplicate_input(spark, sf):
    return v.republicaciones(spark, sf).selectExpr(
        "id", "expediente", "finca_matr AS finca", "CAST(base AS STRING) AS base", "concat((id % 1000000000) % 6 * 500, ':', (id % 1000000000) % 4001 * 30) AS bbox",
        "concat('AVISO ', expediente, ' FINCA ', finca_matr) AS text")


@query("joi6_duplicate_levels", views=("republicaciones",), oracle=f"""
WITH {DUP_SRC}, w AS (SELECT *, {FIRSTS}, {TEXTS}, {PREVS} FROM dsrc), m AS (SELECT id, {LOW} AS d, greatest(l0, l1, l2, l3) AS l FROM w)
SELECT id, CASE WHEN d IS NOT NULL THEN 'DUPLICATED' WHEN l IS NOT NULL THEN 'LIKELY_DUPLICATED' ELSE 'UNIQUE' END AS nivel, coalesce(d, l) AS matched_id FROM m""")
def duplicate_levels(spark, sf):
    return dedup.duplicate_levels(duplicate_input(spark, sf)).select("id", "nivel", "matched_id")


@query("joi6_matched_keys", views=("republicaciones",), oracle=f"""
WITH {DUP_SRC}, w AS (SELECT *, {FIRSTS}, {TEXTS}, {PREVS} FROM dsrc), m AS (SELECT *, coalesce({LOW}, greatest(l0, l1, l2, l3)) AS matched_id FROM w)
SELECT m.id, concat_ws(',', CASE WHEN m.expediente = o.expediente THEN 'expediente' END, CASE WHEN m.finca = o.finca THEN 'finca' END,
  CASE WHEN m.base = o.base THEN 'base' END, CASE WHEN m.bbox = o.bbox THEN 'bbox' END) AS matched_on FROM m JOIN dsrc o ON o.id = m.matched_id""")
def matched_keys(spark, sf):
    d = duplicate_input(spark, sf)
    m = dedup.matched_keys(dedup.duplicate_levels(d).filter("matched_id IS NOT NULL"), d)
    return m.select("id", F.array_join("matched_on", ",").alias("matched_on"))


@query("str_n11_text_similarity")
def text_similarity(spark, sf):
    d = duplicate_input(spark, sf)
    m = dedup.matched_keys(dedup.near_levels(d).filter("matched_id IS NOT NULL"), d)
    return dedup.near_text(v.balanced(m)).select("id", "matched_id", "nivel", "similarity")


@query("joi7_delete_duplicates", views=("avisos",), oracle="""
WITH a AS (SELECT id, pais, CASE WHEN id % 30 = 0 THEN NULL ELSE (id % 200)::VARCHAR END AS expediente, (id % 400)::VARCHAR AS finca_matr, CASE WHEN base IS NULL THEN NULL ELSE id % 3 END AS base
  FROM avisos WHERE estado <> 'eliminado'), k AS (SELECT pais, expediente, finca_matr, base, max(id) AS keep_id FROM a GROUP BY ALL)
SELECT a.id, keep_id FROM a JOIN k ON a.pais = k.pais AND a.expediente = k.expediente AND a.finca_matr = k.finca_matr AND a.base = k.base WHERE a.id <> keep_id""")
def delete_duplicates(spark, sf):
    a = v.avisos(spark, sf, parties=False).selectExpr("id", "pais", "estado", "IF(id % 30 = 0, NULL, CAST(id % 200 AS STRING)) AS expediente",
                                                      "CAST(id % 400 AS STRING) AS finca_matr", "IF(base IS NULL, NULL, id % 3) AS base")
    return dedup.delete_candidates(a).select("id", "keep_id")


READ = """lect AS (SELECT id, documento_id // 4 AS d, CASE WHEN id % 5 = 0 THEN NULL ELSE (10000 + id % 7)::VARCHAR END AS f, CASE WHEN id % 4 = 0 THEN NULL ELSE (50000 + id % 6)::VARCHAR END AS e,
  CASE WHEN id % 3 = 0 THEN NULL ELSE id % 5 END AS b, CASE WHEN id % 6 = 0 THEN NULL ELSE 'DEM' || (id % 4)::VARCHAR END AS w, CASE WHEN id % 7 = 0 THEN NULL ELSE 'ACT' || (id % 3)::VARCHAR END AS p FROM avisos)"""
SAME = """(x.f = y.f OR (x.e = y.e AND (x.b IS NULL OR y.b IS NULL OR x.b = y.b)) OR (x.w = y.w AND (x.p IS NULL OR y.p IS NULL OR x.p = y.p) AND (x.b IS NULL OR y.b IS NULL OR x.b = y.b)))"""
COMP = f"""WITH RECURSIVE {READ}, ed AS (SELECT x.id AS a, y.id AS b FROM lect x JOIN lect y ON x.d = y.d AND x.id <> y.id AND {SAME}),
reach(id, c) AS (SELECT id, id FROM lect UNION SELECT ed.b, reach.c FROM reach JOIN ed ON ed.a = reach.id WHERE reach.c < ed.b),
lab AS (SELECT id, min(c) AS componente FROM reach GROUP BY 1)"""


def readings(spark, sf):
    return v.notices(spark, sf).selectExpr(
        "id", "documento_id div 4 AS documento_id", "IF(id % 5 = 0, NULL, CAST(10000 + id % 7 AS STRING)) AS finca_matr",
        "IF(id % 4 = 0, NULL, CAST(50000 + id % 6 AS STRING)) AS expediente", "IF(id % 3 = 0, NULL, id % 5) AS base",
        "IF(id % 6 = 0, NULL, concat('DEM', id % 4)) AS demandado", "IF(id % 7 = 0, NULL, concat('ACT', id % 3)) AS demandante")


@query("joi8_same_notice", views=("avisos",), oracle=f"{COMP} SELECT id, componente FROM lab")
def same_notice(spark, sf):
    return dedup.same_notice(readings(spark, sf), spark).select("id", "componente")


@query("win2_fused_notices", views=("avisos",), oracle=f"""{COMP},
x AS (SELECT componente, l.*, (f IS NOT NULL)::INT + (e IS NOT NULL)::INT + (b IS NOT NULL)::INT + (w IS NOT NULL)::INT + (p IS NOT NULL)::INT AS k FROM lect l JOIN lab USING (id))
SELECT componente, arg_max(id, k * 100000000 - id) AS id, count(*) AS lecturas, arg_max(e, k * 100000000 - id) FILTER (e IS NOT NULL) AS expediente,
  arg_max(f, k * 100000000 - id) FILTER (f IS NOT NULL) AS finca_matr, arg_max(w, k * 100000000 - id) FILTER (w IS NOT NULL) AS demandado FROM x GROUP BY 1""")
def fused(spark, sf):
    r = dedup.same_notice(readings(spark, sf), spark)
    return dedup.fuse(r, ["expediente", "finca_matr", "demandado"])


@query("joi20_republication", views=("republicaciones",), oracle="""
WITH r AS (SELECT *, expediente || '::' || upper(coalesce(lote_casa, finca_matr)) AS clave FROM republicaciones),
w AS (SELECT *, lag(id) OVER p AS pid, lag(fecha) OVER p AS pf, lag(coalesce(base, -1)) OVER p AS pb, lead(fecha) OVER p AS nf, lead(coalesce(base, -1)) OVER p AS nb
  FROM r WINDOW p AS (PARTITION BY clave ORDER BY fecha, id)),
z AS (SELECT *, (fecha - pf) <= 3 AS np, (nf - fecha) <= 3 AS nn, (pb = coalesce(base, -1) OR pb < 0 OR base IS NULL) AS sp, (nb = coalesce(base, -1) OR nb < 0 OR base IS NULL) AS sn FROM w)
SELECT id, CASE WHEN np AND NOT sp THEN 'duplicado_sospechoso' WHEN np THEN 'republicacion_legal_final' ELSE 'nuevo' END AS tipo_validacion,
  CASE WHEN np THEN pid END AS previo_id, coalesce(nn AND sn, false) AS reemplazado FROM z""")
def republication(spark, sf):
    return dedup.republications(v.republicaciones(spark, sf)).select("id", "tipo_validacion", "previo_id", "reemplazado")


@query("joi16_shadow_compare", views=("resultados_campo",), oracle="""
WITH a AS (SELECT document_id, field, max(part)::VARCHAR AS pv, max(confidence) AS pc FROM resultados_campo WHERE source = 'parser' GROUP BY 1, 2),
b AS (SELECT document_id, field, max(part)::VARCHAR AS kv, max(confidence) AS kc FROM resultados_campo GROUP BY 1, 2)
SELECT document_id, field, pv, kv, CASE WHEN pv IS NOT DISTINCT FROM kv THEN 'tie' WHEN pv IS NULL THEN 'knowledge' WHEN kv IS NULL THEN 'parser' WHEN kc > pc THEN 'knowledge' ELSE 'parser' END AS winner
FROM a FULL JOIN b USING (document_id, field)""")
def shadow_compare(spark, sf):
    return shadow(spark, sf).select("document_id", "field", "pv", "kv", "winner")


def shadow(spark, sf):
    r = v.resultados_campo(spark, sf)
    g = lambda d: d.groupBy("document_id", "field").agg(F.max("part").cast("string").alias("value"), F.max("confidence").alias("confidence"))
    return matching.shadow_compare(g(r.filter("source = 'parser'")), g(r))


@query("agg18_shadow_summary", views=("resultados_campo",), oracle="""
WITH a AS (SELECT document_id, field, max(part) AS pv, max(confidence) AS pc FROM resultados_campo WHERE source = 'parser' GROUP BY 1, 2),
b AS (SELECT document_id, field, max(part) AS kv, max(confidence) AS kc FROM resultados_campo GROUP BY 1, 2),
w AS (SELECT CASE WHEN pv IS NOT DISTINCT FROM kv THEN 'tie' WHEN pv IS NULL THEN 'knowledge' WHEN kc > pc THEN 'knowledge' ELSE 'parser' END AS w FROM a FULL JOIN b USING (document_id, field))
SELECT count(*) AS total_comparisons, count(*) FILTER (w = 'parser') AS parser_wins, count(*) FILTER (w = 'knowledge') AS knowledge_wins, count(*) FILTER (w = 'tie') AS ties,
  count(*) FILTER (w <> 'tie') AS differences, round(count(*) FILTER (w = 'knowledge') * 100::DOUBLE / count(*), 2) AS knowledge_improvement FROM w""")
def shadow_summary(spark, sf):
    return matching.shadow_summary(shadow(spark, sf))


@query("joi17_mode_differences", views=("resultados_campo",), oracle="""
WITH g AS (SELECT document_id, field, max(part) AS v FROM resultados_campo GROUP BY 1, 2)
SELECT document_id, field FROM g WHERE v % 4 = 0 OR v % 5 = 0""")
def mode_differences(spark, sf):
    g = v.resultados_campo(spark, sf).groupBy("document_id", "field").agg(F.max("part").alias("p"))
    p = g.select("document_id", "field", F.lit("FOUND").alias("status"), F.col("p").cast("string").alias("value"))
    k = g.filter("p % 4 <> 0").select("document_id", "field", F.lit("FOUND").alias("status"), F.col("p").cast("string").alias("value"))
    a = g.select("document_id", "field", F.expr("IF(p % 5 = 0, 'REQUIRES_REVIEW', 'FOUND')").alias("status"), F.col("p").cast("string").alias("value"))
    return matching.mode_differences(p, k, a).select("document_id", "field")


@query("joi19_field_differences", views=("resultados_campo",), oracle="""
WITH s AS (SELECT DISTINCT field, source FROM resultados_campo WHERE status = 'FOUND' AND (source <> 'ai' OR field IN ('fecha_remate', 'lugar')) AND (source <> 'parser' OR field <> 'lugar'))
SELECT 'parser' AS lado, field FROM (SELECT field FROM s WHERE source = 'parser' EXCEPT SELECT field FROM s WHERE source = 'ai')
UNION ALL SELECT 'ai', field FROM (SELECT field FROM s WHERE source = 'ai' EXCEPT SELECT field FROM s WHERE source = 'parser')
UNION ALL SELECT 'catalogo', field FROM (SELECT unnest(['expediente', 'finca', 'plano', 'hora']) AS field EXCEPT SELECT field FROM s)""")
def field_differences(spark, sf):
    from gavelwork.operators.search import AI_ALLOWED
    found = v.resultados_campo(spark, sf).filter("status = 'FOUND'")
    s = found.filter(((F.col("source") != "ai") | F.col("field").isin(AI_ALLOWED)) & ((F.col("source") != "parser") | (F.col("field") != "lugar"))).select("field", "source").distinct()
    p, a = s.filter("source = 'parser'").select("field"), s.filter("source = 'ai'").select("field")
    catalog = spark.createDataFrame([(c,) for c in ("expediente", "finca", "plano", "hora")], "field string")
    tag = lambda d, n: d.select(F.lit(n).alias("lado"), "field")
    return union([tag(p.join(a, "field", "left_anti"), "parser"), tag(a.join(p, "field", "left_anti"), "ai"), tag(catalog.exceptAll(s.select("field")), "catalogo")])


@query("joi22_replies_applied", oracle="""
WITH ap AS (SELECT user_id AS aviso_id, event_id AS id, ts FROM events WHERE event_type IN ('view', 'click')),
re AS (SELECT user_id AS aviso_id, CASE WHEN event_id % 2 = 0 THEN 'aprobado' ELSE 'rechazado' END AS respuesta, ts FROM events WHERE event_type = 'purchase')
SELECT aviso_id, a.id, r.respuesta FROM (SELECT aviso_id, arg_max(id, ts) AS id FROM ap GROUP BY 1) a LEFT JOIN (SELECT aviso_id, arg_max(respuesta, ts) AS respuesta FROM re GROUP BY 1) r USING (aviso_id)""")
def replies_applied(spark, sf):
    e = v.table(spark, sf, "events")
    approvals = e.filter("event_type IN ('view', 'click')").selectExpr("user_id AS aviso_id", "event_id AS id", "ts AS creado_en")
    replies = e.filter("event_type = 'purchase'").selectExpr("user_id AS aviso_id", "IF(event_id % 2 = 0, 'aprobado', 'rechazado') AS respuesta", "ts")
    return lifecycle.apply_replies(replies, approvals).select("aviso_id", "id", "respuesta")


@query("win15_latest_rows", views=("auditoria",), oracle="""
SELECT aviso_id, arg_max(id, creado_en) AS id, arg_max(accion, creado_en) AS accion FROM auditoria GROUP BY 1""")
def latest_rows(spark, sf):
    return matching.latest_per_key(v.auditoria(spark, sf).select("aviso_id", "id", "accion", "creado_en"), ["aviso_id"], ["creado_en", "id"]).select("aviso_id", "id", "accion")


EVT = """ev AS (SELECT event_id AS id, user_id AS aviso_id, ts, CASE event_type WHEN 'signup' THEN 'approve' WHEN 'click' THEN 'reject' WHEN 'view' THEN 'delete'
  WHEN 'purchase' THEN 'restore' ELSE 'apply' END AS evento FROM events)"""


def events(spark, sf):
    return v.table(spark, sf, "events").selectExpr(
        "event_id AS id", "user_id AS aviso_id", "ts", "CASE event_type WHEN 'signup' THEN 'approve' WHEN 'click' THEN 'reject' WHEN 'view' THEN 'delete' "
        "WHEN 'purchase' THEN 'restore' ELSE 'apply' END AS evento")


@query("rul21_final_states", views=("avisos",), oracle=f"""
WITH {EVT}, s AS (SELECT aviso_id, arg_max(evento, ts) FILTER (evento IN ('approve', 'reject', 'delete')) AS u, max(ts) FILTER (evento IN ('approve', 'reject', 'delete')) AS c,
  max(ts) FILTER (evento = 'restore') AS r FROM ev GROUP BY 1)
SELECT id, estado, CASE WHEN coalesce(u, CASE WHEN estado = 'eliminado' THEN 'delete' END) = 'delete' AND r IS NOT NULL AND (c IS NULL OR r > c) THEN 'pendiente_procesar'
  ELSE coalesce(CASE u WHEN 'approve' THEN 'subido' WHEN 'reject' THEN 'rechazado' WHEN 'delete' THEN 'eliminado' END, estado) END AS estado_final
FROM avisos LEFT JOIN s ON id = aviso_id""")
def final_states(spark, sf):
    return lifecycle.final_states(v.avisos(spark, sf, parties=False), events(spark, sf))


@query("rul21_audit_rows", oracle=f"""
WITH {EVT}, m AS (SELECT *, lag(evento) OVER (PARTITION BY aviso_id ORDER BY ts, id) AS p FROM ev WHERE evento <> 'apply')
SELECT aviso_id, id, CASE evento WHEN 'approve' THEN 'platform_upload' WHEN 'reject' THEN 'whatsapp' ELSE 'admin' END AS agente,
  CASE evento WHEN 'approve' THEN 'subida_tras_aprobacion' WHEN 'reject' THEN 'rechazado' WHEN 'delete' THEN 'eliminar_aviso' ELSE 'restaurar_aviso' END AS accion
FROM m WHERE evento <> 'restore' OR p = 'delete' UNION ALL SELECT aviso_id, id, 'admin', 'aplicar_sugerencia' FROM ev WHERE evento = 'apply'""")
def audit_rows(spark, sf):
    e = events(spark, sf)
    return lifecycle.audit_rows(e, F.to_date("ts"))


@query("rul22_edit_corrections", views=("avisos",), oracle="""
SELECT id, 'lugar' AS campo, coalesce(lugar, '') AS valor_anterior, 'JUZGADO NUEVO' AS valor_nuevo, lugar IS NULL AS era_vacio FROM avisos WHERE id % 2 = 0
UNION ALL SELECT id, 'proceso', proceso, 'PROCESO NUEVO', false FROM avisos WHERE id % 3 = 0""")
def edit_corrections(spark, sf):
    a = v.avisos(spark, sf)
    after = a.withColumns({"lugar": F.expr("IF(id % 2 = 0, 'JUZGADO NUEVO', ' ' || lugar || ' ')"), "proceso": F.expr("IF(id % 3 = 0, 'PROCESO NUEVO', proceso)"),
                           "estado": F.lit("subido")})
    docs = a.groupBy("documento_id").agg(F.min("expediente").alias("texto_ocr"))
    out = lifecycle.edit_corrections(a, after, ["lugar", "proceso", "estado"], docs)
    return out.select("id", "campo", "valor_anterior", "valor_nuevo", "era_vacio")


def document_texts(spark, sf):
    t = v.avisos_texto(spark, sf)
    return t.groupBy("documento_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda s: s["text"]), "\n").alias("text")).select(
        F.col("documento_id").alias("document_id"), "text")


ANCHOR = r"""doc AS (SELECT documento_id AS document_id, string_agg(regexp_replace(text, '\D', '', 'g'), '' ORDER BY id) AS s FROM avisos_texto GROUP BY 1),
ga AS (SELECT DISTINCT expediente, replace(expediente, '-', '') AS t FROM avisos_texto), le AS (SELECT DISTINCT length(t) AS n FROM ga),
gr AS (SELECT document_id, s, n, unnest(range(1, (length(s) - n + 2)::BIGINT)) AS i FROM doc, le WHERE length(s) >= n),
an AS (SELECT expediente, document_id, min(i)::INT AS at FROM ga JOIN gr ON substr(s, i, n) = t AND n = length(t) GROUP BY 1, 2)"""


@query("joi10_docket_anchors", views=("avisos_texto",), oracle=f"WITH {ANCHOR} SELECT * FROM an")
def docket_anchors(spark, sf):
    golden = v.avisos(spark, sf, parties=False).select("expediente").distinct()
    return matching.docket_anchors(document_texts(spark, sf), golden).select("expediente", "document_id", "at")


@query("joi24_first_document", views=("avisos_texto",), oracle=f"""
WITH {ANCHOR}, f AS (SELECT expediente, min(document_id) AS d FROM an GROUP BY 1)
SELECT a.expediente, coalesce(d, (SELECT min(document_id) FROM doc)) AS document_id FROM avisos_texto a LEFT JOIN f USING (expediente)""")
def first_document(spark, sf):
    docs = document_texts(spark, sf)
    golden = v.avisos(spark, sf, parties=False).select("expediente")
    anchors = matching.docket_anchors(docs, golden.distinct())
    order = docs.select("document_id", F.col("document_id").alias("orden"))
    return matching.first_document(anchors, golden, order)


def marked_documents(spark, sf):
    """Documents of printed notices: a page mark before every third notice, a block mark before all but every fourth."""
    t = v.avisos_texto(spark, sf).select("documento_id", "id", F.expr("""concat(IF(id % 3 = 0, concat('\n--- PÁGINA ', id % 50, ' ---\n'), ''), IF(id % 4 = 0, '', '\nEJ . '), text)""").alias("text"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda s: s["text"]), "\n")
    return t.groupBy(F.col("documento_id").alias("document_id")).agg(whole.alias("text"))


@query("joi10_anchored_regions", views=("avisos_texto",), oracle=r"""
WITH doc AS (SELECT documento_id AS document_id, string_agg(CASE WHEN id % 3 = 0 THEN chr(10) || '--- PÁGINA ' || (id % 50)::VARCHAR || ' ---' || chr(10) ELSE '' END ||
  CASE WHEN id % 4 = 0 THEN '' ELSE chr(10) || 'EJ . ' END || text, chr(10) ORDER BY id) AS text FROM avisos_texto GROUP BY 1),
pp AS (SELECT document_id, string_split_regex(text, '
?--- PÁGINA \d+ ---
?') AS parts, regexp_extract_all(text, '
?--- PÁGINA \d+ ---
?') AS marks FROM doc),
pg AS (SELECT document_id, k, parts[k] AS text, CASE WHEN k = 1 THEN 1 ELSE regexp_extract(marks[k - 1], '\d+')::INT END AS pagina,
  coalesce(list_sum(list_transform(parts[1:k - 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(marks[1:k - 1], lambda x: length(x))), 0) AS pat FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS k FROM pp)),
page AS (SELECT * FROM pg WHERE trim(text) <> ''),
target AS (SELECT DISTINCT expediente, replace(expediente, '-', '') AS t FROM avisos_texto),
dd AS (SELECT document_id, list_filter(range(1, length(text) + 1), lambda i: regexp_matches(substr(text, i, 1), '[0-9]')) AS places, regexp_replace(text, '\D', '', 'g') AS s FROM doc),
dn AS (SELECT document_id, s, unnest(range(1, length(s) - 7)) AS i FROM dd),
da AS (SELECT expediente, document_id, min(i) AS i FROM dn JOIN target ON substr(s, i, 9) = t GROUP BY 1, 2),
dp AS (SELECT expediente, document_id, places[i] - 1 AS pos FROM da JOIN dd USING (document_id)),
home AS (SELECT expediente, document_id, pagina, k, text FROM dp JOIN page USING (document_id) WHERE pat <= pos AND pos < pat + length(text)),
hd AS (SELECT *, list_filter(range(1, length(text) + 1), lambda i: regexp_matches(substr(text, i, 1), '[0-9]')) AS places, strpos(regexp_replace(text, '\D', '', 'g'), replace(expediente, '-', '')) AS i FROM home),
hp AS (SELECT *, places[i] - 1 AS pos, places[i + 8] AS hasta, string_split_regex(text, '(?m)^\s*(?:EJ|DIV)\s*\.') AS bp, regexp_extract_all(text, '(?m)^\s*(?:EJ|DIV)\s*\.') AS bm FROM hd WHERE i > 0),
bk AS (SELECT expediente, document_id, k, j, list_sum(list_transform(bp[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(bm[1:j - 1], lambda x: length(x))), 0) AS a, length(bm[j]) + length(bp[j + 1]) AS n, pos
  FROM (SELECT *, unnest(range(1, len(bm) + 1)) AS j FROM hp)),
held AS (SELECT expediente, document_id, k, a AS inicio, a + n AS fin FROM bk WHERE a <= pos AND pos < a + n),
r AS (SELECT expediente, document_id, pagina, text, coalesce(inicio, pos - length(string_split(substr(text, 1, pos), chr(10))[-1])) AS inicio,
  coalesce(fin, hasta + length(string_split(substr(text, hasta + 1), chr(10))[1])) AS fin FROM hp LEFT JOIN held USING (expediente, document_id, k))
SELECT expediente, document_id, pagina, inicio::INT AS inicio, fin::INT AS fin, substr(text, inicio::INT + 1, (fin - inicio)::INT) AS texto FROM r""")
def anchored_regions(spark, sf):
    # the SQL looks up dockets of nine digits only; the operator takes any
    dockets = v.avisos(spark, sf, parties=False).select("expediente").filter("length(replace(expediente, '-', '')) = 9").distinct()
    return matching.anchored_regions(marked_documents(spark, sf), dockets).select(
        "expediente", "document_id", "pagina", F.col("inicio").cast("int").alias("inicio"), F.col("fin").cast("int").alias("fin"), "texto")


@query("joi10_page_ranges", views=("avisos_texto",), oracle=r"""
WITH doc AS (SELECT documento_id AS document_id, string_agg(CASE WHEN id % 3 = 0 THEN chr(10) || '--- PÁGINA ' || (id % 50)::VARCHAR || ' ---' || chr(10) ELSE '' END ||
  CASE WHEN id % 4 = 0 THEN '' ELSE chr(10) || 'EJ . ' END || text, chr(10) ORDER BY id) AS text FROM avisos_texto GROUP BY 1),
pp AS (SELECT document_id, string_split_regex(text, '
?--- PÁGINA \d+ ---
?') AS parts, regexp_extract_all(text, '
?--- PÁGINA \d+ ---
?') AS marks FROM doc),
pg AS (SELECT document_id, parts[k] AS text, CASE WHEN k = 1 THEN 1 ELSE regexp_extract(marks[k - 1], '\d+')::INT END AS pagina,
  coalesce(list_sum(list_transform(parts[1:k - 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(marks[1:k - 1], lambda x: length(x))), 0) AS pat FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS k FROM pp)),
w AS (SELECT document_id, strpos(text, 'EXPEDIENTE') - 1 AS pos FROM doc UNION ALL SELECT document_id, length(text) - 1 FROM doc)
SELECT document_id, pos::INT AS pos, pagina FROM w JOIN pg USING (document_id) WHERE pat <= pos AND pos < pat + length(text) AND trim(text) <> ''""")
def page_ranges(spark, sf):
    """Page of the first docket label and of the last character of every document."""
    from gavelwork.operators.splitting import split_pages

    d = marked_documents(spark, sf)
    points = d.select("document_id", F.explode(F.array(F.instr("text", "EXPEDIENTE") - 1, F.length("text") - 1)).alias("pos"))
    pages = split_pages(d, ["document_id"]).select("document_id", "pagina", "inicio", "fin")
    return matching.range_lookup(points, pages, "document_id", "pos", "inicio", "fin").select("document_id", "pos", "pagina")


@query("joi21_contained_documents", oracle=r"""
WITH d AS (SELECT source AS page, doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z]{4,}'), lambda x: upper(x)))) AS ws FROM documents),
s AS (SELECT page, ws, min(doc_id) AS id, count(*) AS c FROM d WHERE len(ws) > 0 GROUP BY 1, 2), w AS (SELECT page, id, unnest(ws) AS w FROM s),
m AS (SELECT a.page, a.id AS a, b.id AS b, count(*) AS m FROM w a JOIN w b ON a.page = b.page AND a.w = b.w AND a.id <> b.id GROUP BY 1, 2, 3)
SELECT m.page, a, b, m AS n, x.c AS copias_a, y.c AS copias_b FROM m JOIN s x ON x.id = a AND x.page = m.page JOIN s y ON y.id = b AND y.page = m.page WHERE m = len(x.ws)
UNION ALL SELECT page, id, id, len(ws)::BIGINT, c, c FROM s WHERE c > 1""")
def contained(spark, sf):
    d = v.table(spark, sf, "documents").select(F.col("source").alias("page"), "doc_id", F.transform(F.regexp_extract_all("text", F.lit("([A-Za-z]{4,})"), 1), F.upper).alias("words"))
    return matching.contained_documents(v.balanced(d))


@query("set1_union_sources", views=("avisos", "correcciones"), oracle="""
SELECT fuente, count(*) AS n, count(DISTINCT aviso_id) AS avisos FROM (SELECT 'avisos' AS fuente, id AS aviso_id FROM avisos UNION ALL SELECT 'correcciones', aviso_id FROM correcciones
  UNION ALL SELECT 'auditoria', user_id FROM events) GROUP BY 1""")
def union_sources(spark, sf):
    parts = [(v.avisos(spark, sf, parties=False).select(F.col("id").alias("aviso_id")), "avisos"), (v.correcciones(spark, sf).select("aviso_id"), "correcciones"),
             (v.auditoria(spark, sf).select("aviso_id"), "auditoria")]
    return union([d.withColumn("fuente", F.lit(n)) for d, n in parts]).groupBy("fuente").agg(F.count("*").alias("n"), F.count_distinct("aviso_id").alias("avisos"))


@query("set2_best_ranked", views=("resultados_campo",), oracle="""
SELECT document_id, field, arg_max(part, confidence * 1000000 - part / 1000000) AS part FROM resultados_campo GROUP BY 1, 2""")
def best_ranked(spark, sf):
    return v.resultados_campo(spark, sf).groupBy("document_id", "field").agg(F.max_by("part", F.struct("confidence", -F.col("part"))).alias("part"))


@query("set3_field_intersection", views=("resultados_campo",), oracle="""
WITH f AS (SELECT document_id, list_distinct(list(field)) AS fs FROM resultados_campo WHERE status = 'FOUND' GROUP BY 1)
SELECT document_id, len(list_intersect(fs, ['expediente', 'finca', 'precio_base', 'base', 'finca_matr']))::INT AS fuertes,
  len(list_filter(['expediente', 'finca', 'precio_base'], lambda x: NOT list_contains(fs, x)))::INT AS faltan FROM f""")
def field_intersection(spark, sf):
    from gavelwork.functions.lookups import STRONG_FIELDS
    from gavelwork.operators.rules import names_array
    f = v.resultados_campo(spark, sf).filter("status = 'FOUND'").groupBy("document_id").agg(F.collect_set("field").alias("fs"))
    return f.select("document_id", F.size(F.array_intersect("fs", names_array(STRONG_FIELDS))).alias("fuertes"),
                    F.size(F.array_except(names_array(["expediente", "finca", "precio_base"]), F.col("fs"))).alias("faltan"))


@query("set4_missing_documents", views=("resultados_campo",), oracle="""
SELECT o_orderkey AS document_id FROM orders EXCEPT SELECT document_id FROM resultados_campo WHERE status = 'FOUND'""")
def missing_documents(spark, sf):
    docs = v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("document_id"))
    return docs.join(v.resultados_campo(spark, sf).filter("status = 'FOUND'"), "document_id", "left_anti")
