"""Streaming queries, checked against batch SQL over the same events."""

from pyspark.sql import functions as F

from gavelwork.operators import dedup
from gavelwork.plans.joins import DUP_SRC, FIRSTS, PREVS, duplicate_input
from gavelwork.registry import query
from gavelwork.sources import views as v
from gavelwork.streaming import jobs, memory

FMT = "yyyy-MM-dd HH:mm:ss"


@query("str1_ingest", oracle=r"""
SELECT doc_id, length(regexp_replace(text, '^\s+|\s+$', '', 'g'))::INT AS largo, CASE WHEN length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 20 THEN 'cuarentena' ELSE 'aceptado' END AS estado,
  regexp_matches(upper(text), 'REMATE|SUBASTA|AVALUO|AVALÚO|POSTURA|SE VENDER[AÁ]|MEJOR POSTOR') AS indicios FROM documents""")
def ingest(spark, sf):
    return jobs.ingest(spark, sf)


@query("str2_exact_duplicates", oracle="SELECT DISTINCT user_id, event_type FROM events")
def exact_duplicates(spark, sf):
    return jobs.exact_duplicates_dropped(spark, sf)


@query("str2_duplicate_memory", oracle="""
SELECT user_id, event_type, count(*) AS vistos, min(event_id) AS primero, CASE WHEN count(*) = 1 THEN 'UNIQUE' WHEN min(value) = max(value) THEN 'DUPLICATED' ELSE 'LIKELY_DUPLICATED' END AS nivel
FROM events GROUP BY 1, 2""")
def duplicate_memory(spark, sf):
    return jobs.duplicate_memory(spark, sf)


SESSION = """s AS (SELECT *, sum(k) OVER (PARTITION BY {keys} ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY {keys} ORDER BY ts, event_id) <= INTERVAL {gap} THEN 0 ELSE 1 END AS k FROM events))"""


@query("str3_republication", oracle=f"""
WITH {SESSION.format(keys='user_id, event_type', gap='3 DAYS')}
SELECT user_id, event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS inicio, count(*) AS publicaciones, arg_max(event_id, ts) AS vigente FROM s GROUP BY user_id, event_type, g
HAVING max(ts) + INTERVAL 3 DAYS <= (SELECT max(ts) FROM events) - INTERVAL 3 DAYS""")
def republication(spark, sf):
    return jobs.republications(spark, sf).withColumn("inicio", F.date_format("inicio", FMT))


@query("str4_replies", oracle="""
SELECT a.user_id AS aviso_id, a.event_id AS pedido, b.event_id AS respuesta FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase'
  AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 60 MINUTES""")
def replies(spark, sf):
    return jobs.replies_to_requests(spark, sf)


@query("str5_correction_counts", oracle="""
SELECT event_type, event_id % 12 AS valor, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ultima FROM events GROUP BY 1, 2""")
def correction_counts(spark, sf):
    return jobs.correction_counts(spark, sf).withColumn("ultima", F.date_format("ultima", FMT))


@query("str6_rule_counters", oracle="""
SELECT user_id AS rule_id, count(*) AS usos, count(*) FILTER (event_type <> 'error') AS aciertos, count(*) >= 5 AND count(*) FILTER (event_type <> 'error')::DOUBLE / count(*) < 0.7 AS expirada
FROM events GROUP BY 1""")
def rule_counters(spark, sf):
    return jobs.rule_counters(spark, sf)


@query("str7_tumbling", oracle="""
SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS inicio, event_type, count(*) AS n FROM events
GROUP BY time_bucket(INTERVAL 1 HOUR, ts), event_type HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES""")
def tumbling(spark, sf):
    return jobs.windowed_events(spark, sf).withColumn("inicio", F.date_format("inicio", FMT))


@query("str7_sliding", oracle="""
WITH w AS (SELECT event_type, unnest([0, 1, 2, 3, 4, 5]) AS k, ts FROM events), b AS (SELECT event_type, time_bucket(INTERVAL 10 SECONDS, ts) - k * INTERVAL 10 SECONDS AS i FROM w)
SELECT strftime(i, '%Y-%m-%d %H:%M:%S') AS inicio, event_type, count(*) AS n FROM b GROUP BY i, event_type HAVING i + INTERVAL 60 SECONDS <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES""")
def sliding(spark, sf):
    return jobs.windowed_events(spark, sf, "60 seconds", "10 seconds").withColumn("inicio", F.date_format("inicio", FMT))


@query("str7_sessions", oracle=f"""
WITH {SESSION.format(keys='user_id', gap='30 MINUTES')}
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS inicio, count(*) AS n FROM s GROUP BY user_id, g HAVING max(ts) + INTERVAL 30 MINUTES <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES""")
def sessions(spark, sf):
    return jobs.user_sessions(spark, sf).withColumn("inicio", F.date_format("inicio", FMT))


NO_TEXT = "least(" + ", ".join(f"CASE WHEN p{i} < id THEN p{i} END" for i in range(6)) + ")"
COPIES = 1_000_000_000


@query("str2_notice_memory", views=("republicaciones",), oracle=f"""
WITH {DUP_SRC}, w AS (SELECT *, {FIRSTS}, {PREVS} FROM dsrc), m AS (SELECT id, {NO_TEXT} AS d, greatest(l0, l1, l2, l3) AS l FROM w)
SELECT id, CASE WHEN d IS NOT NULL THEN 'DUPLICATED' WHEN l IS NOT NULL THEN 'LIKELY_DUPLICATED' ELSE 'UNIQUE' END AS nivel, coalesce(d, l) AS matched_id FROM m""")
def notice_memory(spark, sf):
    """Two runs over one checkpoint: the notices, then their copies."""
    d, seen = duplicate_input(spark, sf), memory.DuplicateMemory(spark)
    return seen.run(d.filter(F.col("id") < COPIES)).unionByName(seen.run(d.filter(F.col("id") >= COPIES)))


@query("str2_exported_memory", views=("republicaciones",), oracle=f"""
WITH {DUP_SRC}, e AS (SELECT id, unnest(['expediente', 'finca', 'base', 'bbox', 'expediente+finca', 'expediente+base', 'expediente+bbox', 'finca+base', 'finca+bbox', 'base+bbox']) AS k,
  unnest([expediente, finca, base, bbox, expediente || chr(1) || finca, expediente || chr(1) || base, expediente || chr(1) || bbox, finca || chr(1) || base, finca || chr(1) || bbox, base || chr(1) || bbox]) AS v FROM dsrc)
SELECT k, v, min(id) AS first, max(id) AS last FROM e WHERE v IS NOT NULL GROUP BY k, v""")
def exported_memory(spark, sf):
    """The memory of one run is exported and loaded into another, which goes on and exports its own."""
    d, one = duplicate_input(spark, sf), memory.DuplicateMemory(spark)
    one.run(d.filter(F.col("id") < COPIES))
    two = memory.DuplicateMemory(spark, loaded=one.exported())
    two.run(d.filter(F.col("id") >= COPIES))
    return two.exported()


LOTS = """pubs AS (SELECT id, expediente || '::' || upper(coalesce(lote_casa, finca_matr)) AS clave, fecha::TIMESTAMP AS fecha, base::VARCHAR AS base FROM republicaciones
  UNION ALL SELECT id + 2000000000, expediente || '::' || upper(coalesce(lote_casa, finca_matr)), fecha::TIMESTAMP + INTERVAL 4 DAYS, base::VARCHAR FROM republicaciones WHERE id < 1000000000 AND id % 21 = 0),
lots AS (SELECT *, CASE WHEN id % 97 = 0 THEN 2 WHEN year(fecha) < 1997 THEN 0 WHEN year(fecha) < 1999 THEN 1 ELSE 2 END AS lote FROM pubs)"""


@query("str3_notice_republication", views=("republicaciones",), oracle=f"""
WITH RECURSIVE {LOTS},
marks AS (SELECT n AS lote, (SELECT max(fecha) FROM lots WHERE lote < n) - INTERVAL 3 DAYS AS wm FROM range(3) t(n)),
tagged AS (SELECT lots.*, coalesce(fecha <= wm, false) AS tarde FROM lots JOIN marks USING (lote)),
q AS (SELECT *, row_number() OVER (PARTITION BY clave ORDER BY lote, fecha, id) AS n FROM tagged WHERE NOT tarde),
s AS (SELECT clave, n, id, id AS cid, fecha AS cf, base AS cb, NULL::BIGINT AS out_id, NULL::VARCHAR AS res, NULL::BIGINT AS otro FROM q WHERE n = 1
  UNION ALL SELECT q.clave, q.n, q.id,
    CASE WHEN q.fecha - s.cf > INTERVAL 3 DAYS OR (coalesce(q.base = s.cb, true) AND (q.fecha, q.id) > (s.cf, s.cid)) THEN q.id ELSE s.cid END,
    CASE WHEN q.fecha - s.cf > INTERVAL 3 DAYS OR (coalesce(q.base = s.cb, true) AND (q.fecha, q.id) > (s.cf, s.cid)) THEN q.fecha ELSE s.cf END,
    CASE WHEN q.fecha - s.cf > INTERVAL 3 DAYS OR (coalesce(q.base = s.cb, true) AND (q.fecha, q.id) > (s.cf, s.cid)) THEN q.base ELSE s.cb END,
    CASE WHEN q.fecha - s.cf > INTERVAL 3 DAYS THEN NULL WHEN coalesce(q.base = s.cb, true) AND (q.fecha, q.id) > (s.cf, s.cid) THEN s.cid ELSE q.id END,
    CASE WHEN q.fecha - s.cf > INTERVAL 3 DAYS THEN NULL WHEN coalesce(q.base = s.cb, true) THEN 'reemplazado' ELSE 'duplicado_sospechoso' END,
    CASE WHEN q.fecha - s.cf > INTERVAL 3 DAYS THEN NULL WHEN coalesce(q.base = s.cb, true) AND (q.fecha, q.id) > (s.cf, s.cid) THEN q.id ELSE s.cid END
  FROM s JOIN q ON q.clave = s.clave AND q.n = s.n + 1),
gone AS (SELECT out_id AS id, res, otro FROM s WHERE out_id IS NOT NULL),
last AS (SELECT clave, arg_max(cid, n) AS cid FROM s GROUP BY clave)
SELECT t.id, t.clave, CASE WHEN tarde THEN 'tarde' WHEN gone.id IS NOT NULL THEN res
  WHEN last.cid = t.id AND t.fecha + INTERVAL 3 DAYS > (SELECT max(fecha) FROM tagged WHERE NOT tarde) - INTERVAL 3 DAYS THEN 'abierta' ELSE 'vigente' END AS resultado, otro AS otro_id
FROM tagged t LEFT JOIN gone ON gone.id = t.id AND NOT tarde LEFT JOIN last ON last.clave = t.clave AND NOT tarde""")
def notice_republication(spark, sf):
    """Three lots by year; every 97th publication comes with the last one, most of these too late."""
    r = v.republicaciones(spark, sf).withColumn("clave", dedup.property_key(v.republicaciones(spark, sf))).select("id", "clave", "fecha", "base")
    third = r.filter("id < 1000000000 AND id % 21 = 0").selectExpr("id + 2000000000 AS id", "clave", "date_add(fecha, 4) AS fecha", "base")
    lots = r.unionByName(third).withColumn("lote", F.expr("CASE WHEN id % 97 = 0 THEN 2 WHEN year(fecha) < 1997 THEN 0 WHEN year(fecha) < 1999 THEN 1 ELSE 2 END"))
    job, out = memory.Republications(spark), None
    for n in range(3):
        got = job.run(lots.filter(F.col("lote") == n))
        out = got if out is None else out.unionByName(got)
    still = job.open().select("id", "clave", F.lit("abierta").alias("resultado"), F.lit(None).cast("long").alias("otro_id"))
    return out.unionByName(still)
