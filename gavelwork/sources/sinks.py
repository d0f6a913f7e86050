"""Feeds, payloads and maintenance of stored tables."""

from functools import reduce

from pyspark.sql import functions as F

from gavelwork.functions import lookups as lk
from gavelwork.functions.text import blank, key_upper_plain


def code_map(table):
    """Fixed lookup as a map literal; its size is the size of the table in the source."""
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def with_codes(df):
    """Province / department and category codes; a name outside the tables has no code."""
    place = key_upper_plain(F.col("provincia"))
    pa, co, cat = (code_map(t) for t in (lk.PA_PROVINCE_CODES, lk.CO_DEPARTMENT_CODES, lk.CATEGORY_CODES))
    return df.withColumns({
        "codigo_ubicacion": F.when(F.col("pais") == 1, F.try_element_at(pa, place)).when(
            F.col("pais") == 2, F.try_element_at(co, place)),
        "categoria_codigo": F.try_element_at(cat, key_upper_plain(F.col("categoria")))})


def _long_description(df):
    short = F.col("descripcion")
    return F.coalesce(F.nullif(F.col("descripcion_completa"), F.lit("")), short) if "descripcion_completa" in df.columns else short


def _code(prefix):
    return F.coalesce(F.nullif(F.col("codigo"), F.lit("")), F.concat(F.lit(prefix), F.lpad(F.col("id").cast("string"), 8, "0")))


def feed_panama(df):
    """Columns in the order of the Panama sheet."""
    d = with_codes(df)
    money = {c: F.col(c).cast("double") for c in ("base", "fianza", "minimo")}
    return d.select(
        "pais", _code("PA").alias("codigo"), "expediente", F.col("lugar").alias("juzg lugar"),
        F.lit(None).cast("string").alias("observaciones"), "proceso", "demandante", "demandado",
        F.col("fecha").cast("string").alias("fecha"), "hora", F.col("codigo_ubicacion").alias("codigo ubicacion"),
        F.col("finca_matr").alias("finca/matr"), "plano", F.col("lote_casa").alias("lote/casa"), "superficie",
        F.col("categoria_codigo").alias("categoria"), _long_description(df).alias("descripcion"), "provincia",
        *[money[c].alias(c) for c in money], F.col("codigo_fuente").alias("cod prensa"))


def feed_colombia(df):
    """Columns in the order of the Colombia sheet; deposit and minimum are the constants 40 and 100."""
    d = with_codes(df)
    return d.select(
        "pais", _code("CO").alias("codigo"), F.col("fecha").cast("string").alias("fecha"), "hora", "proceso",
        "expediente", F.col("lugar").alias("juzg lugar"), F.lit(None).cast("string").alias("observaciones"),
        F.col("categoria_codigo").alias("categoria"), "demandante", "demandado", F.col("lote_casa").alias("lote/casa"),
        _long_description(df).alias("descripcion"), "superficie", F.col("finca_matr").alias("finca/matr"),
        F.col("codigo_ubicacion").alias("codigo ubicacion"), "provincia", "plano",
        F.col("base").cast("double").alias("base"), F.lit(40).alias("fianza"), F.lit(100).alias("minimo"),
        F.lit(None).cast("string").alias("correo"), F.col("codigo_fuente").alias("cod prensa"))


def write_feeds(df, path):
    """One CSV folder per country."""
    feed_panama(df.filter("pais = 1")).write.mode("overwrite").option("header", True).csv(f"{path}/pais=1")
    feed_colombia(df.filter("pais = 2")).write.mode("overwrite").option("header", True).csv(f"{path}/pais=2")


def _text(name):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _money(name):
    return F.coalesce(F.col(name).cast("decimal(18,2)").cast("string"), F.lit("0.00"))


def platform_payload(df):
    """Fields the publishing platform expects; nothing is NULL."""
    prefix = F.when(F.col("pais") == 1, "PA").otherwise("CO")
    code = F.when(blank(F.col("codigo")), F.concat(F.lit("#"), prefix, F.lit("00000000"))).when(
        F.col("codigo").startswith("#"), F.col("codigo")).otherwise(F.concat(F.lit("#"), F.col("codigo")))
    deposit = F.when(F.col("pais") == 2, F.concat(
        F.coalesce(F.col("fianza_porcentaje").cast("decimal(5,1)").cast("string"), F.lit("None")), F.lit("%"))).otherwise(_money("fianza"))
    return df.select(
        "id", code.alias("codigo"), _text("fecha").alias("fecha_remate"), _text("hora").alias("hora_remate"),
        _text("provincia").alias("provincia_o_departamento"), _text("codigo_ubicacion").alias("codigo_ubicacion"),
        _text("lugar").alias("juzgado"), _text("proceso").alias("tipo_proceso"), _text("expediente").alias("expediente"),
        _text("demandante").alias("demandante"), _text("demandado").alias("demandado"),
        F.coalesce(_long_description(df), F.lit("")).alias("descripcion"), _money("base").alias("base_remate"),
        deposit.alias("minimo_participar"), _money("minimo").alias("minimo_ganar"), _text("categoria").alias("categoria"),
        _text("lote_casa").alias("lote_o_casa"), _text("finca_matr").alias("folio_o_matricula"),
        _text("plano").alias("plano"), _text("superficie").alias("superficie"))


def payload_json(df):
    p = platform_payload(df)
    return p.select("id", F.to_json(F.struct(*[c for c in p.columns if c != "id"])).alias("payload"))


def add_missing_columns(old, new):
    return old.unionByName(new, allowMissingColumns=True)


def purge_country(avisos, pais, dependents, correcciones, keep_learning=False):
    """Tables without one country; rows of dependent tables go with their notice."""
    gone = avisos.filter(F.col("pais") == pais).select(F.col("id").alias("aviso_id"))
    kept = {"avisos": avisos.filter(F.col("pais") != pais)}
    kept.update({name: df.join(gone, "aviso_id", "left_anti") for name, df in dependents.items()})
    kept["correcciones"] = correcciones if keep_learning else correcciones.filter(
        F.col("pais") != pais).join(gone, "aviso_id", "left_anti")
    return kept


def write_log_lines(df, path):
    """One JSON line per document."""
    df.write.mode("append").json(path)


def write_reports(reports, path):
    """Each named report table as JSON."""
    for name, df in reports.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def union_all(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)
