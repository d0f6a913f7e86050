"""Notice-shaped views over the given tables; see FIXTURES.md for the rules."""

from pyspark.sql import functions as F


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def balanced(df):
    """Rows for per-row text work, dealt over the cores where the table has fewer files than there are cores.

    Tables of many files keep their splits (``spark.sql.files.maxPartitionBytes`` sizes them) and are not exchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def texts(spark, sf_dir):
    """Documents ready for per-row text work."""
    return balanced(table(spark, sf_dir, "documents").select("doc_id", "text"))


CHARS_A_TASK = 4_000_000


def dealt(spark, sf_dir, key="doc_id"):
    """Documents (doc_id, text and the ``key``) dealt by the key before anything is made of them.

    Words taken from them stay where they are: windows and groups that hold the key need no exchange of words, which are many times their text.
    The number of parts follows the characters, so that the words of a part can be sorted in memory.
    """
    d = table(spark, sf_dir, "documents")
    chars = d.agg(F.sum("n_chars")).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-chars // CHARS_A_TASK))
    d = d.select("doc_id", "text")
    return (d if key == "doc_id" else d.withColumn(key, F.expr(WORD_KEYS[key]))).repartition(parts, key)


WORD_KEYS = {"page": "doc_id - doc_id % 2"}


def pick(values, index):
    """Element of a literal list by a zero-based integer expression."""
    body = ", ".join(repr(v) if isinstance(v, str) else f"{v}D" for v in values)
    return f"element_at(array({body}), CAST({index} AS INT) + 1)"


PA_NAMES = ["BOCAS DEL TORO", "COCLE", "COLON", "CHIRIQUI", "DARIEN", "HERRERA", "LOS SANTOS",
            "PANAMA", "PANAMA OESTE", "VERAGUAS"]
CO_NAMES = ["ANTIOQUIA", "BOGOTA", "BOLIVAR", "CALDAS", "CAUCA", "CORDOBA", "HUILA", "META",
            "NARINO", "TOLIMA"]
CATEGORIES = ["CASA", "APARTAMENTO", "TERRENO", "VEHICULO", "MISCELANEO"]
PROCESSES = ["EJECUTIVO HIPOTECARIO", "EJECUTIVO", "INSOLVENCIA", "SUMARIO"]
COURTS = ["JUZGADO PRIMERO DE CIRCUITO", "JUZGADO SEGUNDO DE CIRCUITO", "JUZGADO TERCER DE CIRCUITO"]
PAPERS = ["LA PRENSA", "METRO LIBRE", "La Estrella de Panamá", "EL SIGLO"]

_BASE = f"""
    o_orderkey AS id,
    o_orderkey div 8 AS documento_id,
    CAST(1 + o_orderkey % 2 AS INT) AS pais,
    concat(10000 + o_orderkey, '-', year(o_orderdate)) AS expediente,
    CAST(100000 + o_orderkey % 5000 AS STRING) AS finca_matr,
    IF(o_orderkey % 13 = 0, NULL, concat('SUPPLIER ', o_orderkey % 97)) AS demandado,
    IF(o_orderkey % 17 = 0, NULL, CAST(o_totalprice AS DECIMAL(18,2))) AS base,
    CASE WHEN o_orderkey % 2 = 0 THEN {pick([10, 20, 25, 33], '(o_orderkey div 2) % 4')}
         WHEN (o_orderkey div 2) % 3 = 0 THEN NULL ELSE 40D END AS fianza_porcentaje,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL
         WHEN o_orderkey % 2 = 0 THEN {pick([66.67, 50, 100], '(o_orderkey div 2) % 3')}
         ELSE {pick([70, 50, 100], '(o_orderkey div 2) % 3')} END AS minimo_porcentaje,
    {pick(CATEGORIES, 'o_orderkey % 5')} AS categoria,
    CAST(o_orderdate AS DATE) AS fecha,
    IF(o_orderkey % 29 = 0, NULL, concat(lpad(CAST(8 + o_orderkey % 4 AS STRING), 2, '0'), ':30 AM')) AS hora,
    {pick(PROCESSES, 'o_orderkey % 4')} AS proceso,
    IF(o_orderkey % 31 = 0, NULL, {pick(COURTS, 'o_orderkey % 3')}) AS lugar,
    IF(o_orderkey % 3 = 0, NULL, concat('L-', o_orderkey % 300)) AS lote_casa,
    IF(o_orderkey % 4 = 0, NULL, concat(100 + o_orderkey % 900, '.50')) AS superficie,
    IF(o_orderkey % 10 = 0, NULL, concat('80', o_orderkey % 100, '-', o_orderkey % 7777)) AS plano,
    CASE WHEN o_orderkey % 50 = 0 THEN 'eliminado' WHEN o_orderstatus = 'F' THEN 'subido'
         WHEN o_orderstatus = 'O' THEN 'esperando_aprobacion' ELSE 'auto_aprobado' END AS estado,
    CASE WHEN o_orderkey % 19 = 0 THEN 'duplicado_sospechoso'
         WHEN o_orderkey % 23 = 0 THEN 'republicacion_legal_final' ELSE 'nuevo' END AS tipo_validacion,
    (60 + o_orderkey % 41) / 100D AS confianza_promedio,
    CAST(o_orderdate AS TIMESTAMP) AS creado_en,
    CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 17 <> 0
         THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST('0.10' AS DECIMAL(3,2)) AS DECIMAL(18,2)) END AS fianza,
    CASE WHEN o_orderkey % 14 = 0 AND o_orderkey % 17 <> 0
         THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST('0.50' AS DECIMAL(3,2)) AS DECIMAL(18,2)) END AS minimo,
    CASE WHEN o_orderkey % 2 = 1 THEN 'SEJURE' ELSE {pick(PAPERS, '(o_orderkey div 2) % 4')} END AS periodico,
    IF(o_orderkey % 37 = 0, NULL, date_format(date_sub(CAST(o_orderdate AS DATE), 10), 'yyyy-MM-dd')) AS fecha_prensa,
    IF(o_orderkey % 41 = 0, NULL, concat(1 + o_orderkey % 40, 'c')) AS pagina_prensa,
    IF(o_orderkey % 3 = 0, NULL, concat(IF(o_orderkey % 2 = 0, 'PA', 'CO'), 64103000 + o_orderkey)) AS codigo,
    CASE o_orderkey % 4 WHEN 0 THEN concat('det-', o_orderkey) WHEN 1 THEN concat('ai-', o_orderkey) END AS codigo_fuente
"""

_PARTIES = f"""
    upper(replace(c_name, '#', ' ')) AS demandante,
    CASE WHEN id % 37 = 0 THEN 'ZONA LIBRE'
         WHEN id % 6 = 0 THEN lower(p) ELSE p END AS provincia
"""


def avisos(spark, sf_dir, parties=True):
    """Notices from orders; ``parties=False`` skips the customer join when no party or place is read."""
    base = table(spark, sf_dir, "orders").selectExpr(*_split(_BASE), "o_custkey")
    if not parties:
        return base.drop("o_custkey")
    cust = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_name", "c_nationkey % 10 AS nk")
    joined = base.join(cust, F.col("o_custkey") == F.col("c_custkey"), "left").withColumn(
        "p", F.expr(f"IF(pais = 1, {pick(PA_NAMES, 'nk')}, {pick(CO_NAMES, 'nk')})"))
    out = joined.selectExpr("*", *_split(_PARTIES))
    out = out.withColumn("descripcion", F.expr(
        "concat(categoria, IF(lote_casa IS NULL, '', concat(', lote ', lote_casa)), "
        "IF(superficie IS NULL, '', concat(', ', superficie, ' m2')), ', ', provincia)"))
    return out.drop("o_custkey", "c_custkey", "c_name", "nk", "p")


ROWS_A_TASK = 50_000


def notice_parts(spark, sf_dir):
    """Parts for per-row text work on notices: as many as there are cores, more where a part would pass ``ROWS_A_TASK``, so that no task grows."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "orders").count() // ROWS_A_TASK))


def notices(spark, sf_dir):
    """Notices without the customer join, spread over the cores for per-row text work."""
    return avisos(spark, sf_dir, parties=False).repartition(notice_parts(spark, sf_dir))


def _split(block):
    """Split a projection list on top-level commas."""
    parts, depth, quote, cur = [], 0, False, ""
    for ch in block:
        if ch == "'":
            quote = not quote
        if not quote:
            depth += ch == "("
            depth -= ch == ")"
        if ch == "," and depth == 0 and not quote:
            parts.append(cur)
            cur = ""
        else:
            cur += ch
    parts.append(cur)
    return [p.strip() for p in parts if p.strip()]


def republicaciones(spark, sf_dir):
    """Notices plus later copies of every 7th one; every 70th copy has another base."""
    cols = ["id", "pais", "expediente", "finca_matr", "lote_casa", "base", "fecha"]
    orig = notices(spark, sf_dir).select(*cols)
    copies = orig.filter("id % 7 = 0").selectExpr(
        "id + 1000000000 AS id", "pais", "expediente", "finca_matr", "lote_casa",
        "IF(id % 70 = 0, CAST(base + 1000 AS DECIMAL(18,2)), base) AS base",
        "date_add(fecha, CAST(1 + id % 3 AS INT)) AS fecha")
    return orig.unionByName(copies)


NEW_VALUES = ["Panamá", "PANAMA", "Colón", "COLON", "CHIRIQUI", "Casa", "CASA", "Juzgado Primero",
              "JUZGADO PRIMERO", "BANCO GENERAL", "Banco General", "ZONA LIBRE"]
OLD_VALUES = ["PNAMA", "C0LON", "JDO 1", "BCO GENERAL"]


def correcciones(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS id", "user_id AS aviso_id",
        "CASE event_type WHEN 'signup' THEN 'provincia' WHEN 'error' THEN 'expediente' "
        "WHEN 'click' THEN 'demandante' WHEN 'view' THEN 'lugar' ELSE 'categoria' END AS campo",
        f"IF(event_id % 3 = 0, '', {pick(OLD_VALUES, '(event_id div 12) % 4')}) AS valor_anterior",
        f"{pick(NEW_VALUES, 'event_id % 12')} AS valor_nuevo",
        "CAST(1 + user_id % 2 AS INT) AS pais",
        "event_id % 3 = 0 AS era_vacio",
        f"concat('AVISO DE REMATE JUZGADO PRIMERO FINCA ', 100000 + event_id % 5000, ' PROVINCIA ', "
        f"{pick(NEW_VALUES, 'event_id % 12')}, ' BASE SUPPLIER ', event_id % 97) AS contexto",
        "CAST(ts AS TIMESTAMP) AS creado_en")


AGENTS = ["extraction", "business_rules", "admin", "platform_upload", "whatsapp"]


def auditoria(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS id", "user_id AS aviso_id", f"{pick(AGENTS, 'event_id % 5')} AS agente",
        "event_type AS accion", "CAST(ts AS TIMESTAMP) AS creado_en", "value AS valor")


RESULT_FIELDS = ["expediente", "finca", "precio_base", "fecha_remate", "demandante", "demandado", "lugar"]
STAGES = ["ocr", "layout", "segmentation", "parser", "knowledge", "validation", "normalization"]


def resultados_campo(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS document_id", "IF(l_orderkey % 2 = 0, 'PA', 'CO') AS country",
        f"{pick(RESULT_FIELDS, '(l_linenumber - 1) % 7')} AS field",
        "CASE l_returnflag WHEN 'A' THEN 'FOUND' WHEN 'R' THEN 'REQUIRES_REVIEW' ELSE "
        "IF(l_partkey % 2 = 0, 'FOUND', 'NOT_FOUND') END AS status",
        "CASE WHEN l_linestatus = 'F' THEN 'parser' WHEN l_partkey % 3 = 0 THEN 'ai' ELSE 'knowledge' END AS source",
        "(50 + l_partkey % 51) / 100D AS confidence",
        "l_suppkey % 7 AS vote", "l_partkey AS part")


def etapas(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS document_id", f"{pick(STAGES, '(l_linenumber - 1) % 7')} AS stage",
        "l_quantity AS duration_ms")


RULE_FIELDS = ["expediente", "demandante", "finca", "precio_base", "provincia"]
RULE_STATUS = ["approved", "pending", "rejected", "expired", "approved"]


def reglas(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS rule_id", f"{pick(RULE_FIELDS, 'p_size % 5')} AS field_name",
        f"{pick(RULE_STATUS, 'p_partkey % 5')} AS status",
        "(50 + p_partkey % 50) / 100D AS confidence", "CAST(p_size AS BIGINT) AS usage_count",
        "(p_size * (p_partkey % 11)) div 10 AS success_count",
        "date_add(DATE'2024-01-01', CAST(p_partkey % 365 AS INT)) AS created_at",
        "p_partkey AS source_document_id")


WORDS = r"filter(split(text, '\\s+'), w -> w <> '')"


PRINTED = {
    "line": "word_no div 8", "slot": "(word_no div 8) % 6",
    "x0": "((word_no div 8) % 6) * 500 + (word_no % 8) * 55",
    "y0": "((word_no div 8) div 6) * 30 + ((word_no div 8) div 60) * 100 + (word_no * 7) % 5",
    "x1": "((word_no div 8) % 6) * 500 + (word_no % 8) * 55 + 50",
    "y1": "((word_no div 8) div 6) * 30 + ((word_no div 8) div 60) * 100 + (word_no * 7) % 5 + 20",
    "confidence": "(70 + (doc_id + word_no) % 31) / 100D",
    "break_type": "IF(word_no % 8 = 7, 'LINE_BREAK', 'SPACE')"}


def palabras(spark, sf_dir, by=None):
    """One row per word of each document, laid out on six columns of a page; odd documents are bottom halves.

    ``by`` (doc_id or page) keeps the words of one such key in one part.
    """
    docs = table(spark, sf_dir, "documents") if by is None else dealt(spark, sf_dir, by)
    page = "page" if by == "page" else f"{WORD_KEYS['page']} AS page"
    words = docs.selectExpr(page, "doc_id", f"posexplode({WORDS}) AS (word_no, text)")
    return words.selectExpr("page", "IF(doc_id % 2 = 1, 'bottom', 'top') AS position", "doc_id", "word_no", "text", *[f"{x} AS {c}" for c, x in PRINTED.items()])


LETTERS = ("0123456789", "ABCDEFGHIJ")


def avisos_texto(spark, sf_dir):
    """Notices with a printed text: judicial prose for Panama, labelled lines for Colombia."""
    from gavelwork.operators.extract import spanish_date, thousands

    def line(*parts):
        return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])

    c = F.col
    a = avisos(spark, sf_dir).repartition(notice_parts(spark, sf_dir))
    day = spanish_date(c("fecha"))
    pct = {n: F.regexp_replace(c(n).cast("string"), r"\.0$", "") for n in ("fianza_porcentaje", "minimo_porcentaje")}
    pa = F.concat_ws(
        "\n", F.lit("AVISO DE REMATE"), line("EXPEDIENTE N ", c("expediente")),
        line(c("lugar"), F.when(c("id") % 4 == 0, " DE INSOLVENCIA").otherwise("")),
        line("PROCESO ", c("proceso"), " PROMOVIDO POR ", c("demandante"),
             F.coalesce(F.concat(F.lit(", EN CONTRA DE "), c("demandado")), F.lit("")), ","),
        line("FINCA ", c("finca_matr")), line("LOTE ", c("lote_casa")), line("PLANO: ", c("plano")),
        line("SUPERFICIE: ", c("superficie"), " M2"), line("PROVINCIA DE ", c("provincia"), ","),
        line("CODIGO DE UBICACION: ", (4000 + c("id") % 5000).cast("string")), line("CATEGORIA: ", c("categoria")),
        line("FECHA DE REMATE: ", day), line("REMATE EL DIA ", day), line("HORA: ", c("hora")),
        line("BASE DEL REMATE: B/.", thousands(c("base"))), line("FIANZA: ", pct["fianza_porcentaje"], "%"),
        line("MINIMO: ", pct["minimo_porcentaje"], "%"),
        F.when(c("id") % 5 == 0, line("CORREO: aviso", c("id").cast("string"), "@example.com")))
    words = F.when(c("minimo_porcentaje") == 70, "SETENTA").when(c("minimo_porcentaje") == 50, "CINCUENTA").when(
        c("minimo_porcentaje") == 100, "CIEN")
    minimum = F.when(c("id") % 4 == 1, line(words, " POR CIENTO")).otherwise(line(pct["minimo_porcentaje"], "%"))
    co = F.concat_ws(
        "\n", F.lit("AVISO DE REMATE"), line("EXPEDIENTE: ", c("expediente")),
        line("DEMANDANTE: ", F.translate(c("demandante"), *LETTERS)), line("DEMANDADO: ", F.translate(c("demandado"), *LETTERS)),
        line("MATRICULA INMOBILIARIA N° ", c("finca_matr")), line("AVALUO COMERCIAL: $", thousands(c("base"))),
        line("FECHA DE REMATE: ", day), line("FIANZA: ", pct["fianza_porcentaje"], "%"), line("POSTURA ADMISIBLE: ", minimum))
    return a.withColumn("text", F.when(c("pais") == 1, pa).otherwise(co))
