"""Extraction and normalisation queries; oracles are the columns the texts were rendered from."""

from pyspark.sql import functions as F

from gavelwork.functions import dates, money, names, text
from gavelwork.operators import extract, search
from gavelwork.registry import query
from gavelwork.sources import views as v

MONTHS = ("(['ENERO','FEBRERO','MARZO','ABRIL','MAYO','JUNIO','JULIO','AGOSTO','SEPTIEMBRE','OCTUBRE','NOVIEMBRE',"
          "'DICIEMBRE'])[month(fecha)]")
DAY = f"day(fecha)::VARCHAR || ' DE ' || {MONTHS} || ' DE ' || year(fecha)::VARCHAR"
LETTERS = "translate({0}, '0123456789', 'ABCDEFGHIJ')"
THOUSANDS = "format('{:,.2f}', CAST(base AS DOUBLE))"


@query("ext2_panama_fields", views=("avisos",), oracle=f"""
SELECT id, expediente, finca_matr AS finca, {THOUSANDS} AS precio_base, {DAY} AS fecha_remate, demandante, demandado, hora,
  CASE WHEN lugar LIKE '%PRIMERO%' THEN CASE WHEN id % 4 = 0 THEN lugar || ' DE INSOLVENCIA' END ELSE lugar END AS lugar,
  superficie, provincia, (4000 + id % 5000)::VARCHAR AS codigo_ubicacion,
  CASE categoria WHEN 'MISCELANEO' THEN CASE WHEN lote_casa IS NOT NULL THEN 'TERRENO' END
    WHEN 'VEHICULO' THEN CASE WHEN lote_casa IS NOT NULL THEN 'TERRENO' ELSE 'VEHICULO' END ELSE categoria END AS categoria,
  proceso, CASE WHEN id % 5 = 0 THEN 'aviso' || id::VARCHAR || '@example.com' END AS email_observaciones
FROM avisos WHERE pais = 1""")
def panama_fields(spark, sf):
    return extract.panama_v2(v.avisos_texto(spark, sf).filter("pais = 1").select("id", "text")).drop("text")


@query("ext3_colombia_fields", views=("avisos",), oracle=f"""
SELECT id, expediente, finca_matr AS finca, {THOUSANDS} AS precio_base, {DAY} AS fecha_remate,
  {LETTERS.format('demandante')} AS demandante, {LETTERS.format('demandado')} AS demandado,
  fianza_porcentaje, minimo_porcentaje FROM avisos WHERE pais = 2""")
def colombia_fields(spark, sf):
    return extract.colombia_v2(v.avisos_texto(spark, sf).filter("pais = 2").select("id", "text")).drop("text")


@query("ext1_panama_first_generation", views=("avisos",), oracle="""
SELECT id, left(expediente, length(expediente) - 2) AS expediente,
  CASE WHEN id % 4 = 0 THEN lugar || ' DE INSOLVENCIA' END AS lugar, demandante, demandado, finca_matr,
  coalesce(lote_casa, CASE WHEN categoria = 'CASA' THEN 'FECHA' END) AS lote_casa, plano,
  superficie, (4000 + id % 5000)::VARCHAR AS codigo_ubicacion_prensa,
  CASE categoria WHEN 'MISCELANEO' THEN 'TERRENO' ELSE categoria END AS categoria,
  CASE WHEN provincia = 'ZONA LIBRE' THEN NULL ELSE upper(provincia) END AS provincia,
  strftime(fecha, '%Y-%m-%d') AS fecha, hora, CASE WHEN fianza_porcentaje <> 33 THEN fianza_porcentaje END AS fianza_porcentaje,
  minimo_porcentaje, 'AVISO DE REMATE' AS proceso, CAST(base AS DOUBLE) AS base,
  concat_ws(', ', CASE categoria WHEN 'MISCELANEO' THEN 'TERRENO' ELSE categoria END,
    'lote ' || coalesce(lote_casa, CASE WHEN categoria = 'CASA' THEN 'FECHA' END), superficie || ' m2',
    CASE WHEN provincia = 'ZONA LIBRE' THEN NULL ELSE upper(provincia) END) AS descripcion
FROM avisos WHERE pais = 1""")
def panama_first(spark, sf):
    return extract.panama_v1(v.avisos_texto(spark, sf).filter("pais = 1").select("id", "text")).drop("text")


@query("ext5_fill_from_description", views=("avisos",), oracle="""
SELECT id, CASE WHEN id % 3 = 0 THEN left(expediente, length(expediente) - 2) ELSE expediente END AS expediente,
  coalesce(CASE WHEN id % 4 = 0 THEN NULL ELSE CAST(base AS DOUBLE) END, CAST(base AS DOUBLE)) AS base,
  concat_ws(',', CASE WHEN id % 4 = 0 THEN CASE WHEN base IS NOT NULL THEN 'base' END END,
    CASE WHEN id % 3 = 0 THEN 'expediente' END) AS completados
FROM avisos WHERE pais = 1""")
def fill_description(spark, sf):
    a = v.avisos_texto(spark, sf).filter("pais = 1").withColumnRenamed("text", "descripcion_completa")
    keep = ["id", "pais", "descripcion_completa", *extract.V1_FIELDS]
    a = a.withColumns({
        "codigo_ubicacion_prensa": F.lit("1"), "plano": F.lit("1"), "lugar": F.lit("J"), "demandado": F.lit("D"),
        "lote_casa": F.lit("L"), "superficie": F.lit("1"), "hora": F.lit("H"), "fianza_porcentaje": F.lit(10.0),
        "minimo_porcentaje": F.lit(50.0),
        "expediente": F.expr("IF(id % 3 = 0, '', expediente)"),
        "base": F.expr("IF(id % 4 = 0, NULL, base)")}).select(*keep)
    got = extract.fill_from_description(a)
    return got.select("id", "expediente", F.col("base").cast("double").alias("base"),
                      F.array_join("completados", ",").alias("completados"))


@query("ext9_render_record", views=("avisos",), oracle=f"""
SELECT id, concat_ws(chr(10), 'AVISO DE REMATE', 'EXPEDIENTE: ' || expediente, 'DEMANDANTE: ' || demandante,
  'DEMANDADO: ' || demandado, 'FINCA: ' || finca_matr, 'MATRICULA INMOBILIARIA: ' || finca_matr, 'BASE: ' || base::VARCHAR,
  'PRECIO BASE: $' || {THOUSANDS}, 'FIANZA: ' || fianza_porcentaje::VARCHAR || '%', 'MINIMO: ' || minimo_porcentaje::VARCHAR || '%',
  'FECHA: ' || strftime(fecha, '%Y-%m-%d'), 'LUGAR: ' || lugar, 'PROCESO: ' || proceso, 'PROVINCIA: ' || provincia,
  'CATEGORIA: ' || categoria, 'DESCRIPCION: ' || descripcion) AS text FROM avisos""")
def render_record(spark, sf):
    a = v.avisos(spark, sf)
    return a.select("id", extract.render_record(a).alias("text"))


@query("joi3_province_in_text", views=("avisos",), oracle="""
SELECT id, CASE WHEN provincia <> 'ZONA LIBRE' THEN upper(provincia) END AS provincia FROM avisos WHERE pais = 1""")
def province_in_text(spark, sf):
    from gavelwork.functions.lookups import PA_PROVINCE_CODES
    t = v.avisos_texto(spark, sf).filter("pais = 1")
    return t.select("id", extract.longest_name_in(F.col("text"), PA_PROVINCE_CODES).alias("provincia"))


@query("joi2_city_department", oracle="""
SELECT c_custkey, CASE c_nationkey % 6 WHEN 0 THEN 'BOGOTA' WHEN 1 THEN 'VALLE DEL CAUCA' WHEN 2 THEN 'TOLIMA'
  WHEN 3 THEN 'CUNDINAMARCA' WHEN 4 THEN 'LETICIA' END AS departamento FROM customer""")
def city_department(spark, sf):
    city = F.expr("element_at(array('Bogota D.C', ' cali ', 'ESPINAL T.', 'Cajica Cundi', 'Leticia', ''), c_nationkey % 6 + 1)")
    return v.table(spark, sf, "customer").select("c_custkey", extract.department_of(city).alias("departamento"))


@query("win4_table_rows", oracle="""
SELECT id, fila, strlen(txt)::BIGINT AS largo FROM (
  SELECT o_orderkey AS id, unnest([1, 2])::INT AS fila, unnest([
    (1 + o_orderkey % 28)::VARCHAR || '-jul 10:00 A.M CALLE ' || (o_orderkey % 90)::VARCHAR || ' CASA',
    '28-AGO 2:30 P.M CARRERA 7 PREDIO BOGOTA continua']) AS txt FROM orders)""")
def table_rows(spark, sf):
    o = v.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS id", "concat('LISTADO\n', 1 + o_orderkey % 28, '-jul 10:00 A.M\n CALLE ', o_orderkey % 90, ' CASA\n\n',"
        " '28-AGO 2:30 P.M CARRERA 7\nPREDIO BOGOTA\n continua ') AS t")
    rows = o.select("id", F.posexplode(extract.table_rows(F.col("t"))).alias("p", "f"))
    return rows.select("id", (F.col("p") + 1).alias("fila"), F.length("f").cast("bigint").alias("largo"))


CO_ROW = ("concat(1 + id % 28, '-jul 8:30 ', IF(id % 4 = 1, 'A.M', 'P.M'), ' CALLE ', 200 + id % 90, ' APARTAMENTO 50N-', 20000 + id,"
          " ' EJ. HP. No.001-2017-', 10000 + id, ' 00 ', demandante_l, ' Vs.', coalesce(demandado_l, 'NADIE'), "
          "' $ 2.000.000 70 $ ', replace(format_number(CAST(floor(coalesce(base, 1000000)) AS BIGINT), '#,##0'), ',', '.'), ' 12 C.M CALI')")


@query("ext4_colombia_table", views=("avisos",), oracle=f"""
SELECT id, '2025-07-' || lpad((1 + id % 28)::VARCHAR, 2, '0') AS fecha, CASE WHEN id % 4 = 1 THEN '08:30' ELSE '20:30' END AS hora,
  'CALLE ' || (200 + id % 90)::VARCHAR AS direccion, 'APARTAMENTO' AS categoria, '001-2017-' || (10000 + id)::VARCHAR AS expediente,
  'EJECUTIVO HIPOTECARIO' AS proceso, 'VALLE DEL CAUCA' AS provincia, floor(CAST(coalesce(base, 1000000) AS DOUBLE)) AS base,
  70::DOUBLE AS minimo_porcentaje, '50N-' || (20000 + id)::VARCHAR AS finca_matr
FROM avisos WHERE pais = 2""")
def colombia_table(spark, sf):
    a = v.avisos(spark, sf).filter("pais = 2")
    a = a.withColumns({"demandante_l": F.translate("demandante", *v.LETTERS), "demandado_l": F.translate("demandado", *v.LETTERS)})
    rows = a.select("id", F.expr(CO_ROW).alias("fila"))
    cols = ["id", "fecha", "hora", "direccion", "categoria", "expediente", "proceso", "provincia", "base", "minimo_porcentaje",
            "finca_matr"]
    return extract.colombia_row(rows).select(*cols)


# ---- numbers, dates, names ----

@query("num1_money_generic", oracle="""
SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 4 THEN NULL WHEN 5 THEN floor(o_totalprice) ELSE o_totalprice END AS monto
FROM orders""")
def money_generic(spark, sf):
    d = "CAST(o_totalprice AS DECIMAL(18,2))"
    raw = F.expr(f"""CASE o_orderkey % 6 WHEN 0 THEN concat('B/.', format_number({d}, '#,##0.00'))
      WHEN 1 THEN concat('$', translate(format_number({d}, '#,##0.00'), ',.', '.,'))
      WHEN 2 THEN replace(CAST({d} AS STRING), '.', ',') WHEN 3 THEN concat(CAST({d} AS STRING), ' USD')
      WHEN 4 THEN '1.2.3' ELSE format_number(floor({d}), '#,##0') END""")
    return v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), money.parse_generic(raw).alias("monto"))


@query("num2_money_panama", oracle="""
SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 5 THEN floor(o_totalprice) ELSE o_totalprice END AS monto FROM orders""")
def money_panama(spark, sf):
    d = "CAST(o_totalprice AS DECIMAL(18,2))"
    f = f"format_number({d}, '#,##0.00')"
    raw = F.expr(f"""CASE WHEN o_orderkey % 6 = 1 THEN replace({f}, ',', '.')
      WHEN o_orderkey % 6 = 2 AND o_totalprice >= 1000 AND o_totalprice < 100000 THEN concat('B / ', split_part({f}, ',', 1), '.', replace(split_part({f}, ',', 2), '.', ''))
      WHEN o_orderkey % 6 = 3 THEN concat(CAST({d} AS STRING), '.') WHEN o_orderkey % 6 = 4 AND o_totalprice >= 1000 THEN translate({f}, ',.', '.,')
      WHEN o_orderkey % 6 = 5 THEN replace(format_number(floor({d}), '#,##0'), ',', '.') ELSE concat('B/.', {f}) END""")
    return v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), money.parse_panama(raw).alias("monto"))


@query("num3_money_colombia", oracle="""
SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN o_totalprice WHEN 1 THEN floor(o_totalprice) END AS monto FROM orders""")
def money_colombia(spark, sf):
    d = "CAST(o_totalprice AS DECIMAL(18,2))"
    raw = F.expr(f"""CASE o_orderkey % 3 WHEN 0 THEN concat('$ ', translate(format_number({d}, '#,##0.00'), ',.', '.,'))
      WHEN 1 THEN concat('$', replace(format_number(floor({d}), '#,##0'), ',', '.')) ELSE 'sin valor' END""")
    return v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), money.parse_colombia(raw).alias("monto"))


@query("num4_currency", oracle="""
SELECT s_suppkey AS id, (['HNL','USD','COP','PAB','LOCAL','UNKNOWN','UNKNOWN'])[s_suppkey % 7 + 1] AS moneda FROM supplier""")
def currency(spark, sf):
    raw = F.expr("element_at(array('B/. 10', '10 usd', 'cop 5', 'PAB 3', '$ 8', '88', ''), CAST(s_suppkey % 7 AS INT) + 1)")
    return v.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), money.currency(raw).alias("moneda"))


@query("num5_percent", oracle="""
SELECT p_partkey AS id, ([40, 70, 40, 40, 45, 100, 102, 33.5, NULL])[p_partkey % 9 + 1]::DOUBLE AS porcentaje FROM part""")
def percent(spark, sf):
    raw = F.expr("element_at(array('40%', '70 %', '0.40', 'cuarenta por ciento', 'CUARENTA Y CINCO POR CIENTO', 'CIEN POR CIENTO',"
                 " 'CIENTO DOS POR CIENTO', '33,5 %', 'nada'), CAST(p_partkey % 9 AS INT) + 1)")
    return v.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), money.parse_percent(raw).alias("porcentaje"))


@query("num6_base_rescue", views=("avisos",), oracle="""
SELECT id, CAST(base AS DOUBLE) AS despues_expediente, CAST(base AS DOUBLE) AS mayor FROM avisos""")
def base_rescue(spark, sf):
    a = v.notices(spark, sf)
    t = F.concat(F.lit("AVISO DE REMATE EXP "), F.col("expediente"), F.lit(" hipoteca de ( B/.50.00 ). Servira de base para el remate la cifra de B/."),
                 extract.thousands(F.col("base")), F.lit(" y la suma ( B/."), extract.thousands(F.col("base")),
                 F.lit(" ) AVISO DE REMATE EXP 1 la cifra de B/.9,999,999.00"))
    return a.select("id", extract.base_after_docket(t, F.col("expediente")).alias("despues_expediente"),
                    extract.base_largest(F.replace(t, F.lit("Servira de base"), F.lit("Precio"))).alias("mayor"))


@query("num7_percents_near_docket", views=("avisos",), oracle="""
SELECT id, CASE WHEN pais = 2 THEN 40::DOUBLE ELSE CASE WHEN fianza_porcentaje <> 33 THEN fianza_porcentaje ELSE 10 END END AS fianza_porcentaje,
  CASE id % 3 WHEN 0 THEN 66.67::DOUBLE WHEN 1 THEN 50::DOUBLE ELSE 100::DOUBLE END AS minimo_porcentaje FROM avisos""")
def percents_near(spark, sf):
    a = v.notices(spark, sf).withColumn("text", F.expr("""concat('AVISO DE REMATE otro 25% de la base del remate ',
      'AVISO DE REMATE EXP ', expediente, ' interes de 20% anual, consignar el ',
      IF(pais = 2, '40', IF(fianza_porcentaje = 33, 'diez ( 10', CAST(CAST(fianza_porcentaje AS INT) AS STRING))),
      IF(pais = 1 AND fianza_porcentaje = 33, ' % )', ' %'), ' de la base del remate, postura ',
      element_at(array('de las dos terceras (2/3)', 'la mitad', 'la totalidad'), CAST(id % 3 AS INT) + 1),
      ' AVISO DE REMATE 25% de la base del remate')"""))
    return extract.percents_near_docket(a).select("id", "fianza_porcentaje", "minimo_porcentaje")


@query("dat1_iso_dates", views=("avisos",), oracle="""
SELECT id, CASE id % 6 WHEN 4 THEN '' WHEN 5 THEN '2026-02-31' ELSE strftime(fecha, '%Y-%m-%d') END AS iso,
  (['ISO','DOT','SLASH','SPANISH','UNKNOWN','ISO'])[id % 6 + 1] AS formato FROM avisos""")
def iso_dates(spark, sf):
    raw = F.expr("CASE id % 6 WHEN 0 THEN CAST(fecha AS STRING) WHEN 1 THEN date_format(fecha, 'd.M.yyyy') "
                 "WHEN 2 THEN date_format(fecha, ' dd/MM/yyyy') WHEN 3 THEN d WHEN 4 THEN 'ayer' ELSE '2026-02-31' END")
    a = v.notices(spark, sf).withColumn("d", F.lower(extract.spanish_date(F.col("fecha"))))
    return a.select("id", dates.to_iso(raw).alias("iso"), dates.date_format_of(raw).alias("formato"))


@query("dat2_auction_date", views=("avisos",), oracle="""
SELECT id, CASE WHEN id % 3 = 2 THEN NULL ELSE strftime(fecha, '%Y-%m-%d') END AS fecha FROM avisos""")
def auction_dates(spark, sf):
    day = extract.spanish_date(F.col("fecha"))
    filler = F.lit("x" * 200)
    t = F.when(F.col("id") % 3 == 0, F.concat(F.lit("inscrito el dia 30 de octubre de 2019 "), filler, F.lit(" remate el día "), day)).when(
        F.col("id") % 3 == 1, F.concat(F.lit("el dia "), day, F.lit(" se ha de celebrar. el dia 31 de febrero de 2020 remate"))).otherwise(
        F.concat(F.lit("remate "), filler, F.lit(" el dia "), day))
    return v.notices(spark, sf).select("id", dates.auction_date(t).alias("fecha"))


@query("dat3_times", oracle="""
SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN lpad((1 + event_id % 12)::VARCHAR, 2, '0') || ':05 A.M.'
  WHEN 1 THEN lpad((1 + event_id % 12)::VARCHAR, 2, '0') || ':00 PM' END AS hora12,
  CASE event_id % 3 WHEN 0 THEN lpad(((1 + event_id % 12) % 12)::VARCHAR, 2, '0') || ':05' END AS hora24 FROM events""")
def times(spark, sf):
    t = F.expr("CASE event_id % 3 WHEN 0 THEN concat('a las ', 1 + event_id % 12, ':05 a. m. en punto') "
               "WHEN 1 THEN concat('LAS ', 1 + event_id % 12, ' HORAS PM') ELSE 'a las 33:99' END")
    return v.table(spark, sf, "events").select(F.col("event_id").alias("id"), dates.time_12h(t).alias("hora12"),
                                               dates.time_24h(F.replace(t, F.lit("a. m."), F.lit("A.M."))).alias("hora24"))


@query("dat4_press_code", views=("avisos",), oracle="""
SELECT id, CASE WHEN pais = 2 THEN 'SEJ' WHEN (id // 2) % 4 = 3 THEN NULL
    ELSE (['LP', 'ML', 'LE'])[(id // 2) % 4 + 1] END || strftime(fecha - 10, '%d') ||
  (['ENE','FEB','MAR','ABR','MAY','JUN','JUL','AGO','SEP','OCT','NOV','DIC'])[month(fecha - 10)] || strftime(fecha - 10, '%Y') ||
  upper(pagina_prensa) AS codigo_prensa FROM avisos WHERE fecha_prensa IS NOT NULL
UNION ALL SELECT id, NULL FROM avisos WHERE fecha_prensa IS NULL""")
def press_code(spark, sf):
    a = v.notices(spark, sf)
    return a.select("id", dates.press_code(F.col("periodico"), F.col("pais"), F.col("fecha_prensa"), F.col("pagina_prensa"),
                                           F.lit(None).cast("string")).alias("codigo_prensa"))


@query("dat5_newspaper_header", views=("avisos",), oracle="""
SELECT id, CASE id % 3 WHEN 0 THEN 'La Estrella' WHEN 1 THEN 'METRO LIBRE' END AS periodico,
  CASE WHEN id % 3 < 2 THEN strftime(fecha, '%Y-%m-%d') END AS fecha_prensa,
  CASE WHEN id % 2 = 0 THEN '6B' ELSE '1C' END AS pagina, CASE WHEN id % 4 = 0 THEN 'LE' END AS sigla_archivo FROM avisos""")
def newspaper_header(spark, sf):
    a = v.notices(spark, sf).withColumn("d", F.lower(extract.spanish_date(F.col("fecha"))))
    t = F.expr("""concat(IF(id % 2 = 0, '6b', 'Ic'), '\\ntexto\\n', CASE id % 3 WHEN 0 THEN concat('La Estrella, Panamá, miércoles ', d)
      WHEN 1 THEN concat('JUEVES ', d, ' METRO LIBRE') ELSE 'El Siglo' END, '\\n')""")
    paper, day = dates.newspaper_header(t)
    name = F.expr("IF(id % 4 = 0, 'le 1c 8 julio.jpg', 'LEON.jpg')")
    return a.select("id", paper.alias("periodico"), day.alias("fecha_prensa"), dates.page_code(t).alias("pagina"),
                    dates.file_acronym(name).alias("sigla_archivo"))


@query("dat6_date_checks", views=("avisos",), oracle="""
SELECT id, 1 + (id % 2)::INT AS fechas, id % 2 = 1 AS varias, id % 4 = 1 AS imposible FROM avisos""")
def date_checks(spark, sf):
    t = F.expr("concat('el ', CAST(fecha AS STRING), IF(id % 2 = 0, '', IF(id % 4 = 1, ' y 45 de mayo de 2020', ' y 5 de mayo de 2035')))")
    found = dates.dates_in_text(t)
    return v.notices(spark, sf).select(
        "id", F.size(found).alias("fechas"), (F.size(F.array_distinct(found)) > 1).alias("varias"),
        F.exists(found, dates.impossible_date).alias("imposible"))


@query("str_n1_key_rules", views=("correcciones",), oracle="""
SELECT DISTINCT valor_nuevo AS valor, translate(upper(trim(valor_nuevo)), 'ÁÉÍÓÚ', 'AEIOU') AS upper_plain, upper(trim(valor_nuevo)) AS upper_only,
  regexp_replace(translate(upper(trim(valor_nuevo)), 'ÁÉÍÓÚÜÑ', 'AEIOUUN'), '[^A-Z0-9]', '', 'g') AS alnum,
  regexp_replace(translate(upper(trim(valor_nuevo)), 'ÁÉÍÓÚÑ', 'AEIOUN'), '[^A-Z0-9]', '', 'g') AS alnum_sin_u,
  regexp_replace(translate(upper(trim(valor_nuevo)), 'ÁÉÍÓÚÑ', 'AEIOUN'), '[.,$ ]', '', 'g') AS dinero,
  regexp_replace(regexp_replace(lower(trim(valor_nuevo)), '\\.0+$', ''), '[$,. ]', '', 'g') AS comparar FROM correcciones""")
def key_rules(spark, sf):
    c = F.col("valor")
    return v.correcciones(spark, sf).select(F.col("valor_nuevo").alias("valor")).distinct().select(
        "valor", text.key_upper_plain(c).alias("upper_plain"), text.key_upper(c).alias("upper_only"),
        text.key_alnum(c).alias("alnum"), text.key_alnum_no_umlaut(c).alias("alnum_sin_u"),
        text.key_money(c).alias("dinero"), text.key_compare(c).alias("comparar"))


@query("str_n2_ocr_clean", oracle=r"""
WITH a AS (SELECT doc_id, regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(translate(regexp_replace(t, '\\([^nrt]|$)', '\1', 'g'), '‘’“”', '\''\''""'), '\b0([0-9]{3})\b', '\1', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM b)
SELECT doc_id, regexp_replace(array_to_string(list_transform(string_split(t, chr(10)), lambda s: regexp_replace(
  regexp_replace(s, '^[\s\-_=*#|"'']+', ''), '[\s\-_=*#|"'']+$', '')), chr(10)), '^\s+|\s+$', '', 'g') AS limpio FROM c""".replace("\\'", "'"))
def ocr_clean_shape(spark, sf):
    return v.texts(spark, sf).select("doc_id", text.ocr_clean(F.col("text")).alias("limpio"))


@query("str_n3_legal_names", oracle="""
SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'Ana Supplier#' || s_suppkey::VARCHAR WHEN 1 THEN 'Banco General S.A.'
  WHEN 2 THEN 'Luis DE Leon' ELSE 'Juan Perez' END AS nombre,
  CASE s_suppkey % 4 WHEN 0 THEN 'Ana' WHEN 1 THEN 'Banco' WHEN 2 THEN 'Luis' ELSE 'Juan' END AS primero,
  CASE s_suppkey % 4 WHEN 1 THEN 'General' WHEN 2 THEN 'DE' END AS medio FROM supplier""")
def legal_names(spark, sf):
    raw = F.expr("CASE s_suppkey % 4 WHEN 0 THEN concat('SUPPLIER#', s_suppkey, ',  ana') WHEN 1 THEN ' banco  GENERAL s.a.' "
                 "WHEN 2 THEN 'LUIS de leon' ELSE 'juan PEREZ' END")
    n = names.legal_name(raw)
    p = names.name_parts(n)
    return v.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), n.alias("nombre"),
                                                 p["first_name"].alias("primero"), p["middle_names"].alias("medio"))


@query("str_n4_place_names", views=("avisos",), oracle="""
SELECT id, CASE upper(provincia) WHEN 'PANAMA' THEN 'Panamá' WHEN 'PANAMA OESTE' THEN 'Panamá Oeste' WHEN 'COLON' THEN 'Colón'
  WHEN 'CHIRIQUI' THEN 'Chiriquí' WHEN 'COCLE' THEN 'Coclé' WHEN 'BOCAS DEL TORO' THEN 'Bocas del Toro' WHEN 'BOGOTA' THEN 'Bogotá'
  WHEN 'CORDOBA' THEN 'Córdoba' WHEN 'LOS SANTOS' THEN 'Los Santos' WHEN 'ZONA LIBRE' THEN 'Zona Libre'
  ELSE upper(left(provincia, 1)) || lower(substr(provincia, 2)) END AS lugar FROM avisos""")
def place_names(spark, sf):
    return v.avisos(spark, sf).select("id", names.place_display(F.col("provincia")).alias("lugar"))


@query("str_n6_hyphen_breaks", oracle=r"""
SELECT doc_id, regexp_replace(text, '-\s*\n\s*', '', 'g') AS unido FROM documents""")
def hyphen_breaks(spark, sf):
    return v.texts(spark, sf).select("doc_id", text.join_hyphen_breaks(F.col("text")).alias("unido"))


@query("str_n7_boundaries", views=("avisos",), oracle="""
SELECT id, CASE WHEN id % 3 = 0 THEN 3 WHEN id % 3 = 1 THEN 2 ELSE 1 END::INT AS marcas FROM avisos""")
def boundaries(spark, sf):
    t = F.expr("concat('AVISO DE REMATE ', expediente, IF(id % 3 = 1, ' se FIJA el EDICTO EMPLAZATORIO y ', ' y luego '), "
               "IF(id % 3 < 2, 'largo texto intermedio hasta el EDICTO No. 12 ', 'presente AVISO DE REMATE '), "
               "IF(id % 3 = 0, 'AVISO DE DISOLUCION', 'fin'))")
    marked = extract.mark_boundaries(t)
    return v.notices(spark, sf).select(
        "id", F.regexp_count(marked, F.lit(extract.BOUNDARY)).alias("marcas"))


# ---- predicates on text ----

@query("fil10_auction_words", views=("avisos",), oracle="""
SELECT doc_id, regexp_matches(upper(text), 'REMATE|SUBASTA|AVALUO|AVALÚO|POSTURA|SE VENDER[AÁ]|MEJOR POSTOR') AS remate FROM documents
UNION ALL SELECT -1 - id, true FROM avisos""")
def auction_words(spark, sf):
    d = v.texts(spark, sf).unionByName(
        v.avisos_texto(spark, sf).select((-1 - F.col("id")).alias("doc_id"), "text"))
    return d.select("doc_id", search.looks_like_auction(F.col("text")).alias("remate"))


@query("fil18_ai_gate", views=("resultados_campo",), oracle="""
SELECT field, CASE WHEN field NOT IN ('fecha_remate', 'hora', 'lugar', 'juzgado', 'provincia', 'municipio') THEN 'NOT_ALLOWED'
  WHEN part % 10 = 0 THEN 'REQUIRES_REVIEW' WHEN confidence >= 0.95 THEN 'FOUND' WHEN confidence >= 0.8 THEN 'REQUIRES_REVIEW'
  ELSE 'NOT_FOUND' END AS estado, count(*) AS n FROM resultados_campo GROUP BY ALL""")
def ai_gate(spark, sf):
    r = v.resultados_campo(spark, sf).withColumn("c", F.expr("IF(part % 10 = 0, 'alta', CAST(confidence AS STRING))"))
    return r.groupBy("field", search.ai_status(F.col("field"), F.col("c")).alias("estado")).agg(F.count("*").alias("n"))
