"""Layout queries over the word view."""

from pyspark.sql import functions as F

from gavelwork.operators import extract, layout, splitting
from gavelwork.operators.dedup import business_codes
from gavelwork.registry import query
from gavelwork.sources import views as v

C4 = "round(CAST(sum(CAST(confidence AS DECIMAL(18,4))) AS DOUBLE) / count(*) + 1e-9, 4)"


def words(spark, sf, by="doc_id"):
    return v.palabras(spark, sf, by)


def slot_lines(spark, sf):
    w = words(spark, sf).withColumnRenamed("slot", "banda")
    return layout.words_to_lines(w, ["doc_id", "banda"])


@query("win1_business_codes", views=("avisos",), oracle="""
SELECT id, CASE WHEN pais = 1 THEN 'PA' ELSE 'CO' END || (CASE WHEN pais = 1 THEN 64103000 ELSE 64104000 END
  + row_number() OVER (PARTITION BY pais ORDER BY id))::VARCHAR AS codigo_interno FROM avisos""")
def codes(spark, sf):
    return business_codes(v.avisos(spark, sf, parties=False)).select("id", "codigo_interno")


@query("win6_lines", views=("palabras",), oracle=f"""
SELECT doc_id, slot AS banda, (row_number() OVER (PARTITION BY doc_id, slot ORDER BY line) - 1)::INT AS line_no, text, confidence, n FROM (
  SELECT doc_id, slot, line, string_agg(text, ' ' ORDER BY word_no) AS text, {C4} AS confidence, count(*) AS n FROM palabras GROUP BY 1, 2, 3)""")
def lines(spark, sf):
    return layout.lines(slot_lines(spark, sf), ["doc_id", "banda"]).select("doc_id", "banda", "line_no", "text", "confidence", "n")


@query("win6_lines_first_word", views=("palabras",), oracle="""
SELECT doc_id, slot AS banda, count(DISTINCT line) AS lineas, count(*) AS palabras FROM palabras GROUP BY 1, 2""")
def lines_first(spark, sf):
    w = words(spark, sf).withColumnRenamed("slot", "banda")
    d = layout.words_to_lines(w, ["doc_id", "banda"], first_word=True, h_med=layout.median_height(w, ["doc_id"]))
    return d.groupBy("doc_id", "banda").agg(F.count_distinct("line_no").alias("lineas"), F.count("*").alias("palabras"))


@query("win7_blocks", views=("palabras",), oracle="""
WITH l AS (SELECT doc_id, slot, line, (line // 6) // 10 AS b, string_agg(text, ' ' ORDER BY word_no) AS t FROM palabras GROUP BY 1, 2, 3, 4)
SELECT doc_id, slot AS banda, b::INT AS block_no, string_agg(t, chr(10) ORDER BY line) AS text, count(*) AS lineas FROM l GROUP BY 1, 2, 3""")
def blocks(spark, sf):
    ln = layout.lines(slot_lines(spark, sf), ["doc_id", "banda"])
    return layout.lines_to_blocks(ln, ["doc_id", "banda"]).select("doc_id", "banda", "block_no", "text", "lineas")


@query("win8_band_segments", views=("palabras",), oracle="""
SELECT doc_id, slot AS banda, 0::BIGINT AS segmento, count(*) AS palabras FROM palabras GROUP BY 1, 2 HAVING count(*) >= 10""")
def segments(spark, sf):
    w = words(spark, sf).withColumnRenamed("slot", "banda").select("doc_id", "banda", "x0", "y0", "x1", "y1", "text")
    return layout.band_segments(w, ["doc_id", "banda"]).select("doc_id", "banda", "segmento", "palabras")


GUT = """b AS (SELECT page, unnest(range(x0 // 8, x1 // 8 + 1)) AS bin FROM palabras), c AS (SELECT page, bin, count(*) AS c FROM b GROUP BY 1, 2),
d AS (SELECT page, max(x1) AS ancho FROM palabras GROUP BY 1),
f AS (SELECT c.page, bin, ancho, greatest(3, floor(ancho * 0.02 / 8)) AS g FROM c JOIN d USING (page)
  QUALIFY c >= greatest(1, max(c) OVER (PARTITION BY c.page) * 0.01)),
i AS (SELECT *, sum(k) OVER (PARTITION BY page ORDER BY bin) AS isla FROM (SELECT *, CASE WHEN bin - lag(bin) OVER (PARTITION BY page ORDER BY bin) - 1 >= g + 1
  OR lag(bin) OVER (PARTITION BY page ORDER BY bin) IS NULL THEN 1 ELSE 0 END AS k FROM f)),
s AS (SELECT page, isla, min(bin) AS a, max(bin) AS b, any_value(ancho) AS ancho, any_value(g) AS g FROM i GROUP BY 1, 2),
e AS (SELECT page, a * 8 AS x_ini, 8 * CASE WHEN lead(a) OVER (PARTITION BY page ORDER BY a) IS NULL AND ancho // 8 + 2 - b - 1 < g + 1 THEN ancho // 8 + 2 ELSE b + 1 END AS x_fin, ancho FROM s)"""


@query("win9_gutter_columns", views=("palabras",), oracle=f"""
WITH {GUT} SELECT page, x_ini, x_fin::BIGINT AS x_fin FROM e WHERE x_fin - x_ini > ancho * 0.04""")
def gutters(spark, sf):
    return layout.gutter_columns(words(spark, sf, "page"))


@query("win10_histogram_columns", views=("palabras",), oracle="""
WITH p AS (SELECT page, CASE WHEN slot < 3 THEN 0 ELSE 2000 END + ((x0 + x1) // 2) % 1000 AS cx FROM palabras), d AS (SELECT page, max(cx) AS hi, min(cx) AS lo FROM p GROUP BY 1 HAVING max(cx) - min(cx) >= 450),
h AS (SELECT page, cx // 1000 AS b, count(*) AS n FROM p JOIN d USING (page) GROUP BY 1, 2),
i AS (SELECT *, sum(k) OVER (PARTITION BY page ORDER BY b) AS isla FROM (SELECT *, CASE WHEN b - lag(b) OVER (PARTITION BY page ORDER BY b) <= 1 THEN 0 ELSE 1 END AS k FROM h)),
c AS (SELECT page, isla, min(b) AS s, max(b) AS e, arg_min(n, b) AS n FROM i GROUP BY 1, 2 HAVING arg_min(n, b) >= 3)
SELECT page, s * 1000 AS x_ini, (e + 1) * 1000 AS x_fin FROM c QUALIFY count(*) OVER (PARTITION BY page) >= 2""")
def histogram_columns(spark, sf):
    w = words(spark, sf, "page").select("page", F.expr("IF(slot < 3, 0, 2000) + ((x0 + x1) div 2) % 1000 AS cx"), F.lit(3000).alias("width"))
    return layout.histogram_columns(w, "page", 3)


@query("win11_six_columns", views=("palabras",), oracle="""
SELECT page, greatest(0, least(5, floor((x0 + x1) / 2.0 / 500)))::INT AS columna, count(*) AS palabras FROM palabras GROUP BY 1, 2""")
def six_columns(spark, sf):
    w = words(spark, sf, "page").withColumn("columna", layout.newspaper_column(F.col("x0"), F.col("x1"), F.lit(3000.0)))
    return w.groupBy("page", "columna").agg(F.count("*").alias("palabras"))


@query("win12_stitched_pages", views=("palabras",), oracle="""
WITH t AS (SELECT page, max(y1) AS o FROM palabras WHERE position = 'top' GROUP BY 1), h AS (SELECT page, count(DISTINCT position) AS k FROM palabras GROUP BY 1)
SELECT page, k < 2 AS partial, min(y0 + CASE WHEN position = 'bottom' THEN coalesce(o, 0) ELSE 0 END) AS y_min,
  max(y1 + CASE WHEN position = 'bottom' THEN coalesce(o, 0) ELSE 0 END) AS y_max, count(*) AS palabras FROM palabras JOIN h USING (page) LEFT JOIN t USING (page) GROUP BY 1, 2""")
def stitched(spark, sf):
    return layout.stitch(words(spark, sf, "page")).groupBy("page", "partial").agg(
        F.min("y0").alias("y_min"), F.max("y1").alias("y_max"), F.count("*").alias("palabras"))


@query("win12_dense_columns", views=("palabras",), oracle="""
WITH x AS (SELECT page, min(x0) AS a, max(x1) AS b, count(*) AS n FROM palabras GROUP BY 1),
d AS (SELECT page, greatest(0, least(5, floor(((x0 + x1) / 2.0 - a) / ((b - a) / 6.0))))::INT AS banda, n FROM palabras JOIN x USING (page)),
k AS (SELECT page FROM d GROUP BY 1 HAVING count(DISTINCT banda) >= 3 AND any_value(n) >= 15)
SELECT page, banda, count(*) AS palabras FROM d WHERE page IN (SELECT page FROM k) GROUP BY 1, 2""")
def dense(spark, sf):
    return layout.dense_columns(layout.stitch(words(spark, sf, "page"))).groupBy("page", "banda").agg(F.count("*").alias("palabras"))


@query("win13_reading_order", views=("palabras",), oracle="""
WITH l AS (SELECT doc_id, slot, line, string_agg(text, ' ' ORDER BY word_no) AS t FROM palabras GROUP BY 1, 2, 3)
SELECT doc_id, string_agg(t, chr(10) ORDER BY slot, line) AS texto FROM l GROUP BY 1""")
def reading(spark, sf):
    return layout.reading_order(slot_lines(spark, sf), "doc_id", "banda")


@query("win14_split_words", oracle="""
SELECT o_orderkey AS id, 'RE' || 'M' || ' ATE de ' || o_orderkey::VARCHAR AS texto FROM orders""")
def split_words(spark, sf):
    o = v.table(spark, sf, "orders").selectExpr("o_orderkey AS id", """array(struct(0L AS x0, 20L AS x1, 'RE' AS text), struct(25L AS x0, 35L AS x1, 'M' AS text),
      struct(60L AS x0, 90L AS x1, 'ATE' AS text), struct(95L AS x0, 115L AS x1, 'de' AS text),
      struct(120L AS x0, 160L AS x1, CAST(o_orderkey AS STRING) AS text)) AS ws""")
    o = o.withColumn("ws", F.expr("transform(ws, (w, i) -> IF(i = 4 AND length(w.text) = 1, struct(300L AS x0, 310L AS x1, w.text AS text), w))"))
    return layout.merge_split_words(o, ["id"]).select("id", F.array_join("palabras", " ").alias("texto"))


@query("win3_header_groups", views=("avisos_texto",), oracle="""
SELECT documento_id, count(*) AS avisos, sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS lineas FROM avisos_texto GROUP BY 1""")
def header_groups(spark, sf):
    t = v.avisos_texto(spark, sf).select("documento_id", "id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    g = layout.header_groups(t, ["documento_id"], ["id", "n"], bucket=F.floor(F.col("id") / 1000)).filter("grupo > 0")
    return g.groupBy("documento_id").agg(F.count_distinct("grupo").alias("avisos"), F.count("*").alias("lineas"))


@query("win3_detected_notices", views=("avisos_texto",), oracle="""
SELECT documento_id, (row_number() OVER (PARTITION BY documento_id ORDER BY id))::BIGINT AS grupo, text AS texto, 'AVISO DE REMATE' AS cabecera FROM avisos_texto""")
def detected(spark, sf):
    t = v.avisos_texto(spark, sf).select("documento_id", "id", F.lit(0.9).alias("confidence"), F.posexplode(F.split("text", "\n")).alias("n", "text"))
    return layout.detected_notices(t, ["documento_id"], ["id", "n"], bucket=F.floor(F.col("id") / 1000)).select("documento_id", "grupo", "texto", "cabecera")


@query("win5_merged_sections", views=("avisos",), oracle="""
SELECT id, unnest([1, 2, 3])::BIGINT AS isla, unnest(['HEADER', 'PARTIES', 'VALORES']) AS tipo, unnest([1, 2, 1])::INT AS partes,
  unnest([0.9::DOUBLE, round((0.8::DOUBLE + (id % 10)::DOUBLE / 10) / 2 + 1e-9, 4), 0.5::DOUBLE]) AS confidence FROM avisos""")
def merged_sections(spark, sf):
    s = v.notices(spark, sf).selectExpr("id", """posexplode(array(named_struct('text', 'AVISO DE REMATE', 'confidence', 0.9D),
      named_struct('text', concat('DEMANDANTE ', id), 'confidence', 0.8D), named_struct('text', 'DEMANDADO X', 'confidence', (id % 10) / 10D),
      named_struct('text', 'BASE $ 5 FIANZA', 'confidence', 0.5D))) AS (n, s)""").select("id", "n", "s.*")
    s = s.withColumn("tipo", extract.section_type(F.col("text")))
    return layout.merge_sections(s, ["id"], ["n"]).select("id", "isla", "tipo", "partes", "confidence")


@query("joi11_continuity", views=("avisos",), oracle="""
SELECT id AS page, 1::BIGINT AS top, CASE WHEN id % 2 = 0 THEN 11 ELSE 12 END::BIGINT AS bottom, CASE WHEN id % 2 = 0 THEN 9 ELSE 5 END::DOUBLE AS score FROM avisos
UNION ALL SELECT id, 2, 11, 3 FROM avisos WHERE id % 2 = 1""")
def continuity(spark, sf):
    a = v.notices(spark, sf)
    tops = a.selectExpr("id AS page", """inline(array(struct(1L AS frag, 0L AS x0, 100L AS x1, 500L AS y1, 'se remata la propie-' AS text, false AS ends_incomplete),
      struct(2L AS frag, 600L AS x0, 700L AS x1, 500L AS y1, 'fin del texto completo' AS text, false AS ends_incomplete)))""")
    bottoms = a.selectExpr("id AS page", """inline(array(
      struct(11L AS frag, IF(id % 2 = 0, 3L, 603L) AS x0, IF(id % 2 = 0, 510L, 900L) AS y0, IF(id % 2 = 0, 'dad numero uno', 'Otra cosa') AS text, false AS has_header),
      struct(12L AS frag, IF(id % 2 = 0, 300L, 300L) AS x0, IF(id % 2 = 0, 2000L, 600L) AS y0, IF(id % 2 = 0, 'AVISO DE REMATE', 'Resto propie-') AS text, id % 2 = 0 AS has_header)))""")
    return layout.continuity(tops, bottoms)


@query("rul11_page_scores", views=("palabras",), oracle="""
SELECT page, round(round(least(count(DISTINCT slot) / 2.0::DOUBLE, 1), 4) * 0.3::DOUBLE + 0.5::DOUBLE * 0.7::DOUBLE, 4) AS score FROM palabras GROUP BY 1""")
def page_scores(spark, sf):
    w = words(spark, sf, "page")
    cols = w.select("page", "slot").distinct()
    notices = w.select("page").distinct().select("page", F.explode(F.array(F.lit(0.2), F.lit(0.9))).alias("confidence"))
    return layout.page_scores(cols, notices)


@query("win17_chunks")
def chunks(spark, sf):
    d = v.texts(spark, sf)
    return splitting.chunk_texts(d, ["doc_id"], limit=4000, overlap=800).select("doc_id", "n", "inicio", F.length("trozo").alias("largo"))


@query("udtf1_split_pages", oracle="""
WITH p AS (SELECT page_id, url || chr(10) || '--- PÁGINA 2 ---' || chr(10) || html AS text, url, html FROM pages)
SELECT page_id, 1 AS pagina, 0 AS inicio, length(url)::INT AS fin FROM p UNION ALL SELECT page_id, 2, (length(text) - length(html))::INT, length(text)::INT FROM p""")
def split_pages(spark, sf):
    p = v.table(spark, sf, "pages").select("page_id", F.concat("url", F.lit("\n--- PÁGINA 2 ---\n"), "html").alias("text"))
    return splitting.split_pages(p, ["page_id"]).select("page_id", "pagina", "inicio", "fin")


@query("win10_profile_columns", views=("palabras",), oracle="""
WITH it AS (SELECT page, x0, x1 FROM palabras), px AS (SELECT page, unnest(range(greatest(0, least(x0, 2999)), greatest(greatest(0, least(x0, 2999)) + 1, least(x1, 2999)))) AS x FROM it),
c AS (SELECT page, x, count(*) AS c FROM px GROUP BY 1, 2), g AS (SELECT page, unnest(range(150, 2850)) AS x FROM (SELECT DISTINCT page FROM it)),
l AS (SELECT g.page, g.x, coalesce(c, 0) < 3 AS low FROM g LEFT JOIN c ON c.page = g.page AND c.x = g.x),
i AS (SELECT *, x - row_number() OVER (PARTITION BY page, low ORDER BY x) AS k FROM l), r AS (SELECT page, min(x) AS a, max(x) + 1 AS b FROM i WHERE low GROUP BY page, k HAVING count(*) >= 30),
t AS (SELECT page, (a + b) // 2 AS cut FROM r UNION SELECT DISTINCT page, 150 FROM it UNION SELECT DISTINCT page, 2850 FROM it),
s AS (SELECT page, cut AS x_ini, lead(cut) OVER (PARTITION BY page ORDER BY cut) AS x_fin FROM t), f AS (SELECT * FROM s WHERE x_fin - x_ini >= 240),
u AS (SELECT f.page, x_ini, x_fin, count(*) AS items FROM f JOIN it ON it.page = f.page AND (x0 + x1) / 2.0 >= x_ini AND (x0 + x1) / 2.0 < x_fin GROUP BY 1, 2, 3),
n AS (SELECT *, (row_number() OVER (PARTITION BY page ORDER BY x_ini) - 1)::INT AS columna FROM u) SELECT page, x_ini, x_fin, items, columna FROM n WHERE columna < 4""")
def profile_columns(spark, sf):
    return layout.profile_columns(words(spark, sf, "page").select("page", "x0", "x1"), "page", 3000)


@query("udtf1_split_notices", views=("avisos_texto",), oracle="""
SELECT documento_id, n::INT AS n, length(text)::INT AS largo FROM (SELECT documento_id, text || CASE WHEN id = max(id) OVER (PARTITION BY documento_id) THEN '' ELSE chr(10) END AS text,
  row_number() OVER (PARTITION BY documento_id ORDER BY id) AS n FROM avisos_texto)""")
def split_notices(spark, sf):
    t = v.avisos_texto(spark, sf).groupBy("documento_id").agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("ts"))
    d = t.select("documento_id", F.array_join(F.transform("ts", lambda x: x["text"]), "\n").alias("text"))
    s = extract.split_notices(d, ["documento_id"])
    first = s.groupBy("documento_id").agg(F.min("n").alias("base"))
    return s.join(first, "documento_id").select("documento_id", (F.col("n") - F.col("base") + 1).alias("n"), F.length("segmento").alias("largo"))


@query("win17_packed_batches", views=("palabras",), oracle="""
WITH RECURSIVE s AS (SELECT doc_id, line, sum(length(text) + 1)::BIGINT AS largo, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS k FROM palabras GROUP BY 1, 2),
f(doc_id, k, b, n) AS (SELECT doc_id, k, 0, largo FROM s WHERE k = 1 UNION ALL
  SELECT s.doc_id, s.k, CASE WHEN f.n > 0 AND f.n + s.largo > 500 THEN f.b + 1 ELSE f.b END, CASE WHEN f.n > 0 AND f.n + s.largo > 500 THEN s.largo ELSE f.n + s.largo END
  FROM f JOIN s ON s.doc_id = f.doc_id AND s.k = f.k + 1)
SELECT doc_id, max(b)::INT + 1 AS lotes FROM f GROUP BY 1""")
def packed(spark, sf):
    w = words(spark, sf).groupBy("doc_id", "line").agg(F.sum(F.length("text") + 1).alias("largo"))
    p = splitting.pack_segments(w, ["doc_id"], "line", "largo", 500)
    return p.groupBy("doc_id").agg((F.max("lote") + 1).alias("lotes"))
