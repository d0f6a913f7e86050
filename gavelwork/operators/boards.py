"""Conditional aggregates behind the dashboards."""

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T


def mean_of(col, cond=None, scale=2, digits=4):
    """Mean through an exact decimal sum, so that the result does not depend on row order; ties round up."""
    value = col.cast(T.DecimalType(18, scale))
    if cond is not None:
        value = F.when(cond, value)
    return F.round(F.try_divide(F.sum(value).cast("double"), F.count(value).cast("double")) + 1e-9, digits)


def percent(part, whole, digits=1):
    """part / whole as a percentage, 0 when there is nothing to divide by."""
    return F.coalesce(F.round(F.try_divide(part * F.lit(100.0), whole.cast("double")), digits), F.lit(0.0))


def top_values(df, col, name, k):
    """The k most frequent values; ties go to the smaller value."""
    return df.groupBy(col).agg(F.count("*").alias(name)).orderBy(F.col(name).desc(), col).limit(k)


def correction_totals(df):
    return df.agg(F.count("*").alias("total"), F.count_if(F.col("pais") == 1).alias("panama"),
                  F.count_if(F.col("pais") == 2).alias("colombia"))


def _active():
    return F.col("estado") != "eliminado"


def _automatic():
    return F.col("estado").isin("auto_aprobado", "subido")


def kpi_board(df, keys=()):
    """All board figures in one pass."""
    kind = F.col("tipo_validacion")
    return df.groupBy(*keys).agg(
        F.countDistinct("documento_id").alias("documentos_procesados"),
        F.count_if(_active()).alias("avisos_totales"),
        F.count_if(_automatic()).alias("auto_aprobados"),
        F.count_if(F.col("estado") == "esperando_aprobacion").alias("esperando_aprobacion"),
        F.count_if(_active() & (kind == "duplicado_sospechoso")).alias("duplicados_sospechosos"),
        F.count_if(_active() & kind.startswith("republicacion_legal")).alias("republicaciones_legales"),
        F.count_if(F.col("estado") == "reemplazado_por_republicacion").alias("reemplazados"),
        F.coalesce(mean_of(F.col("confianza_promedio"), _active(), digits=3), F.lit(0.0)).alias("confianza_promedio_global"),
        percent(F.count_if(_automatic()), F.count_if(_active())).alias("porcentaje_automatizacion"))


def export_summary(df):
    state = F.col("estado")
    return df.agg(
        F.count("*").alias("total"), F.count_if(state == "subido").alias("subidos"),
        F.count_if(state == "auto_aprobado").alias("auto_aprobados"),
        F.count_if(state == "esperando_aprobacion").alias("pendientes"),
        F.count_if(_automatic()).alias("listos_para_exportar"))


def baseline_metrics(df):
    """Long table (group, key, value): totals, states, countries, confidence, automation rate."""
    conf = F.col("confianza_promedio")
    one = df.agg(
        F.count("*").cast("double").alias("total|avisos"), mean_of(conf).alias("confianza|promedio"),
        F.round(F.min(conf), 4).alias("confianza|min"), F.round(F.max(conf), 4).alias("confianza|max"),
        percent(F.count_if(_automatic()), F.count("*")).alias("automatizacion|tasa"))
    flat = one.unpivot([], list(one.columns), "k", "valor").select(
        F.split("k", r"\|")[0].alias("grupo"), F.split("k", r"\|")[1].alias("clave"), "valor")
    groups = df.groupBy("estado").agg(F.count("*").alias("n")).select(
        F.lit("estado").alias("grupo"), F.col("estado").alias("clave"), F.col("n").cast("double").alias("valor"))
    countries = df.groupBy("pais").agg(F.count("*").alias("n")).select(
        F.lit("pais").alias("grupo"), F.col("pais").cast("string").alias("clave"), F.col("n").cast("double").alias("valor"))
    return reduce(lambda a, b: a.unionByName(b), [flat, groups, countries])


def missing_top(df, k):
    """Most frequent names in the stored JSON lists; lists that do not parse are ignored."""
    names = df.select(F.explode(F.from_json("campos_faltantes_json", "array<string>")).alias("campo"))
    return top_values(names, "campo", "n", k)


def version_comparison(df):
    m = df.groupBy("ver").agg(
        F.count("*").cast("double").alias("total_avisos"), mean_of(F.col("confianza_promedio")).alias("confianza_promedio"),
        percent(F.count_if(_automatic()), F.count("*")).alias("tasa_automatizacion"))
    long = m.unpivot("ver", ["total_avisos", "confianza_promedio", "tasa_automatizacion"], "metrica", "valor")
    wide = long.groupBy("metrica").pivot("ver", ["v1", "v2"]).agg(F.max("valor"))
    return wide.withColumn("delta", F.round(F.col("v2") - F.col("v1"), 4))
