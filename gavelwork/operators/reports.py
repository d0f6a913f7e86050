"""The named client reports as tables, ready for ``sinks.write_reports``."""

from pyspark.sql import functions as F

from gavelwork.operators import boards, learning, quality, rules


def continuous_learning(audit, corrections, k=100):
    """Latest audit events and corrections on one time line."""
    a = audit.select("creado_en", "id", "agente", "accion", "aviso_id")
    c = corrections.select("creado_en", "id", F.lit("cliente").alias("agente"), F.lit("correccion").alias("accion"), "aviso_id")
    return a.unionByName(c).orderBy(F.col("creado_en").desc(), "agente", F.col("id").desc()).limit(k)


def latest_intelligence(notices, k=30):
    """Notice intelligence of the newest waiting or published notices."""
    shown = notices.filter(F.col("estado").isin("esperando_aprobacion", "subido", "auto_aprobado"))
    newest = shown.orderBy(F.col("creado_en").desc(), F.col("id").desc()).limit(k)
    return rules.notice_intelligence(newest).select("id", "expediente", "motivos", "faltantes", "motor", "confianza_predicha")


def client_reports(notices, corrections, audit):
    """Report name to table: learning, intelligence, diagnosis, evolution, time line, readiness board, field problems."""
    flagged = notices if "discrepancia" in notices.columns else notices.withColumn("discrepancia", F.lit(False))
    return {
        "hyper_learning": learning.suggestions(corrections),
        "hyper_intelligence": latest_intelligence(flagged),
        "production_diagnosis": boards.baseline_metrics(notices),
        "knowledge_evolution": quality.correction_evolution(corrections),
        "continuous_learning": continuous_learning(audit, corrections),
        "client_ready": boards.kpi_board(notices, ["pais"]),
        "prediction": quality.problem_fields(corrections),
    }
