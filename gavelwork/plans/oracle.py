"""The adapter views again, in the SQL dialect of the checking database."""

from gavelwork.sources import views as v


def pick(values, index):
    body = ", ".join("'" + x + "'" if isinstance(x, str) else f"{x}::DOUBLE" for x in values)
    return f"([{body}])[CAST({index} AS INT) + 1]"


VIEWS = {
    "avisos": f"""
SELECT *, concat(categoria, CASE WHEN lote_casa IS NULL THEN '' ELSE ', lote ' || lote_casa END,
   CASE WHEN superficie IS NULL THEN '' ELSE ', ' || superficie || ' m2' END) || ', ' || provincia AS descripcion
FROM (SELECT *, CASE WHEN id % 37 = 0 THEN 'ZONA LIBRE' WHEN id % 6 = 0 THEN lower(p) ELSE p END AS provincia
FROM (SELECT
    o_orderkey AS id, o_orderkey // 8 AS documento_id, CAST(1 + o_orderkey % 2 AS INT) AS pais,
    (10000 + o_orderkey)::VARCHAR || '-' || year(o_orderdate)::VARCHAR AS expediente,
    CAST(100000 + o_orderkey % 5000 AS VARCHAR) AS finca_matr,
    upper(replace(c_name, '#', ' ')) AS demandante,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'SUPPLIER ' || (o_orderkey % 97)::VARCHAR END AS demandado,
    CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS base,
    CASE WHEN o_orderkey % 2 = 0 THEN {pick([10, 20, 25, 33], '(o_orderkey // 2) % 4')}
         WHEN (o_orderkey // 2) % 3 = 0 THEN NULL ELSE 40::DOUBLE END AS fianza_porcentaje,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL
         WHEN o_orderkey % 2 = 0 THEN {pick([66.67, 50, 100], '(o_orderkey // 2) % 3')}
         ELSE {pick([70, 50, 100], '(o_orderkey // 2) % 3')} END AS minimo_porcentaje,
    {pick(v.CATEGORIES, 'o_orderkey % 5')} AS categoria,
    CAST(o_orderdate AS DATE) AS fecha,
    CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE lpad((8 + o_orderkey % 4)::VARCHAR, 2, '0') || ':30 AM' END AS hora,
    {pick(v.PROCESSES, 'o_orderkey % 4')} AS proceso,
    CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE {pick(v.COURTS, 'o_orderkey % 3')} END AS lugar,
    CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'L-' || (o_orderkey % 300)::VARCHAR END AS lote_casa,
    CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE (100 + o_orderkey % 900)::VARCHAR || '.50' END AS superficie,
    CASE WHEN o_orderkey % 10 = 0 THEN NULL
         ELSE '80' || (o_orderkey % 100)::VARCHAR || '-' || (o_orderkey % 7777)::VARCHAR END AS plano,
    CASE WHEN o_orderkey % 50 = 0 THEN 'eliminado' WHEN o_orderstatus = 'F' THEN 'subido'
         WHEN o_orderstatus = 'O' THEN 'esperando_aprobacion' ELSE 'auto_aprobado' END AS estado,
    CASE WHEN o_orderkey % 19 = 0 THEN 'duplicado_sospechoso'
         WHEN o_orderkey % 23 = 0 THEN 'republicacion_legal_final' ELSE 'nuevo' END AS tipo_validacion,
    (60 + o_orderkey % 41)::DOUBLE / 100 AS confianza_promedio,
    CAST(o_orderdate AS TIMESTAMP) AS creado_en,
    CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 17 <> 0
         THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 0.10::DECIMAL(3,2) AS DECIMAL(18,2)) END AS fianza,
    CASE WHEN o_orderkey % 14 = 0 AND o_orderkey % 17 <> 0
         THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 0.50::DECIMAL(3,2) AS DECIMAL(18,2)) END AS minimo,
    CASE WHEN o_orderkey % 2 = 1 THEN 'SEJURE' ELSE {pick(v.PAPERS, '(o_orderkey // 2) % 4')} END AS periodico,
    CASE WHEN o_orderkey % 37 = 0 THEN NULL
         ELSE strftime(CAST(o_orderdate AS DATE) - 10, '%Y-%m-%d') END AS fecha_prensa,
    CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE (1 + o_orderkey % 40)::VARCHAR || 'c' END AS pagina_prensa,
    CASE WHEN o_orderkey % 3 = 0 THEN NULL
         ELSE (CASE WHEN o_orderkey % 2 = 0 THEN 'PA' ELSE 'CO' END) || (64103000 + o_orderkey)::VARCHAR END AS codigo,
    CASE o_orderkey % 4 WHEN 0 THEN 'det-' || o_orderkey::VARCHAR WHEN 1 THEN 'ai-' || o_orderkey::VARCHAR END AS codigo_fuente,
    CASE WHEN o_orderkey % 2 = 0 THEN {pick(v.PA_NAMES, 'c_nationkey % 10')}
         ELSE {pick(v.CO_NAMES, 'c_nationkey % 10')} END AS p
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey))""",
    "republicaciones": """
SELECT id, pais, expediente, finca_matr, lote_casa, base, fecha FROM avisos
UNION ALL
SELECT id + 1000000000, pais, expediente, finca_matr, lote_casa,
  CASE WHEN id % 70 = 0 THEN CAST(base + 1000 AS DECIMAL(18,2)) ELSE base END,
  fecha + CAST(1 + id % 3 AS INT) FROM avisos WHERE id % 7 = 0""",
    "correcciones": f"""
SELECT event_id AS id, user_id AS aviso_id,
  CASE event_type WHEN 'signup' THEN 'provincia' WHEN 'error' THEN 'expediente'
    WHEN 'click' THEN 'demandante' WHEN 'view' THEN 'lugar' ELSE 'categoria' END AS campo,
  CASE WHEN event_id % 3 = 0 THEN '' ELSE {pick(v.OLD_VALUES, '(event_id // 12) % 4')} END AS valor_anterior,
  {pick(v.NEW_VALUES, 'event_id % 12')} AS valor_nuevo,
  CAST(1 + user_id % 2 AS INT) AS pais, event_id % 3 = 0 AS era_vacio,
  'AVISO DE REMATE JUZGADO PRIMERO FINCA ' || (100000 + event_id % 5000)::VARCHAR || ' PROVINCIA ' ||
  {pick(v.NEW_VALUES, 'event_id % 12')} || ' BASE SUPPLIER ' || (event_id % 97)::VARCHAR AS contexto,
  CAST(ts AS TIMESTAMP) AS creado_en FROM events""",
    "auditoria": f"""
SELECT event_id AS id, user_id AS aviso_id, {pick(v.AGENTS, 'event_id % 5')} AS agente,
  event_type AS accion, CAST(ts AS TIMESTAMP) AS creado_en, value AS valor FROM events""",
    "resultados_campo": f"""
SELECT l_orderkey AS document_id, CASE WHEN l_orderkey % 2 = 0 THEN 'PA' ELSE 'CO' END AS country,
  {pick(v.RESULT_FIELDS, '(l_linenumber - 1) % 7')} AS field,
  CASE l_returnflag WHEN 'A' THEN 'FOUND' WHEN 'R' THEN 'REQUIRES_REVIEW'
    ELSE CASE WHEN l_partkey % 2 = 0 THEN 'FOUND' ELSE 'NOT_FOUND' END END AS status,
  CASE WHEN l_linestatus = 'F' THEN 'parser' WHEN l_partkey % 3 = 0 THEN 'ai' ELSE 'knowledge' END AS source,
  (50 + l_partkey % 51)::DOUBLE / 100 AS confidence, l_suppkey % 7 AS vote, l_partkey AS part FROM lineitem""",
    "etapas": f"""
SELECT l_orderkey AS document_id, {pick(v.STAGES, '(l_linenumber - 1) % 7')} AS stage,
  l_quantity AS duration_ms FROM lineitem""",
    "reglas": f"""
SELECT p_partkey AS rule_id, {pick(v.RULE_FIELDS, 'p_size % 5')} AS field_name,
  {pick(v.RULE_STATUS, 'p_partkey % 5')} AS status, (50 + p_partkey % 50)::DOUBLE / 100 AS confidence,
  CAST(p_size AS BIGINT) AS usage_count, (p_size * (p_partkey % 11)) // 10 AS success_count,
  DATE '2024-01-01' + CAST(p_partkey % 365 AS INT) AS created_at, p_partkey AS source_document_id FROM part""",
    "palabras": """
SELECT doc_id - doc_id % 2 AS page, CASE WHEN doc_id % 2 = 1 THEN 'bottom' ELSE 'top' END AS position, doc_id,
  word_no, text, word_no // 8 AS line, (word_no // 8) % 6 AS slot,
  ((word_no // 8) % 6) * 500 + (word_no % 8) * 55 AS x0,
  ((word_no // 8) // 6) * 30 + ((word_no // 8) // 60) * 100 + (word_no * 7) % 5 AS y0,
  ((word_no // 8) % 6) * 500 + (word_no % 8) * 55 + 50 AS x1,
  ((word_no // 8) // 6) * 30 + ((word_no // 8) // 60) * 100 + (word_no * 7) % 5 + 20 AS y1,
  (70 + (doc_id + word_no) % 31)::DOUBLE / 100 AS confidence,
  CASE WHEN word_no % 8 = 7 THEN 'LINE_BREAK' ELSE 'SPACE' END AS break_type
FROM (SELECT doc_id, unnest(ws) AS text, unnest(range(len(ws))) AS word_no
      FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS ws FROM documents))""",
}
MONTH = "(['ENERO','FEBRERO','MARZO','ABRIL','MAYO','JUNIO','JULIO','AGOSTO','SEPTIEMBRE','OCTUBRE','NOVIEMBRE','DICIEMBRE'])[month(fecha)]"
SPANISH_DAY = f"(day(fecha)::VARCHAR || ' DE ' || {MONTH} || ' DE ' || year(fecha)::VARCHAR)"
INT_PCT = "regexp_replace({0}::VARCHAR, '\\.0$', '')"
VIEWS["avisos_texto"] = f"""
SELECT *, CASE WHEN pais = 1 THEN concat_ws(chr(10), 'AVISO DE REMATE', 'EXPEDIENTE N ' || expediente,
   lugar || CASE WHEN id % 4 = 0 THEN ' DE INSOLVENCIA' ELSE '' END,
   'PROCESO ' || proceso || ' PROMOVIDO POR ' || demandante || coalesce(', EN CONTRA DE ' || demandado, '') || ',',
   'FINCA ' || finca_matr, 'LOTE ' || lote_casa, 'PLANO: ' || plano, 'SUPERFICIE: ' || superficie || ' M2',
   'PROVINCIA DE ' || provincia || ',', 'CODIGO DE UBICACION: ' || (4000 + id % 5000)::VARCHAR, 'CATEGORIA: ' || categoria,
   'FECHA DE REMATE: ' || {SPANISH_DAY}, 'REMATE EL DIA ' || {SPANISH_DAY}, 'HORA: ' || hora,
   'BASE DEL REMATE: B/.' || format('{{:,.2f}}', CAST(base AS DOUBLE)), 'FIANZA: ' || {INT_PCT.format('fianza_porcentaje')} || '%',
   'MINIMO: ' || {INT_PCT.format('minimo_porcentaje')} || '%', CASE WHEN id % 5 = 0 THEN 'CORREO: aviso' || id::VARCHAR || '@example.com' END)
 ELSE concat_ws(chr(10), 'AVISO DE REMATE', 'EXPEDIENTE: ' || expediente, 'DEMANDANTE: ' || translate(demandante, '0123456789', 'ABCDEFGHIJ'),
   'DEMANDADO: ' || translate(demandado, '0123456789', 'ABCDEFGHIJ'), 'MATRICULA INMOBILIARIA N° ' || finca_matr,
   'AVALUO COMERCIAL: $' || format('{{:,.2f}}', CAST(base AS DOUBLE)), 'FECHA DE REMATE: ' || {SPANISH_DAY},
   'FIANZA: ' || {INT_PCT.format('fianza_porcentaje')} || '%',
   'POSTURA ADMISIBLE: ' || CASE WHEN id % 4 = 1 THEN CASE minimo_porcentaje WHEN 70 THEN 'SETENTA' WHEN 50 THEN 'CINCUENTA' WHEN 100 THEN 'CIEN' END || ' POR CIENTO'
     ELSE {INT_PCT.format('minimo_porcentaje')} || '%' END) END AS text FROM avisos"""
NEEDS = {"republicaciones": ["avisos"], "avisos_texto": ["avisos"]}


def compose(views, body):
    """Prefix a query body with the views it reads, merging its own WITH clause."""
    order = []

    def add(name):
        for dep in NEEDS.get(name, []):
            add(dep)
        if name not in order:
            order.append(name)

    for name in views:
        add(name)
    body = body.strip()
    if not order:
        return body
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in order)
    recursive = body.upper().startswith("WITH RECURSIVE ")
    if recursive:
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
