"""The named client reports, written as JSON and read back, against the SQL of the figures they report."""

from pyspark.sql import functions as F

from gavelwork import registry
from gavelwork.operators import reports
from gavelwork.sources import sinks
from gavelwork.sources import views as v
from gavelwork.session import shared_folder


def _report(name, sql_of):
    """Register ``snk4_<name>``: the report's table after a round through its JSON files."""

    def written(spark, sf):
        table = reports.client_reports(v.avisos(spark, sf), v.correcciones(spark, sf), v.auditoria(spark, sf))[name]
        times = [f.name for f in table.schema.fields if f.dataType.simpleString() == "timestamp"]
        table = table.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in times})
        folder = shared_folder(spark, "reports")
        sinks.write_reports({name: table}, folder)
        out = spark.read.schema(table.schema).json(f"{folder}/{name}")
        return out.withColumn("confianza", F.round("confianza", 6)) if name == "hyper_learning" else out

    registry.QUERIES[f"snk4_{name}"] = written
    registry.ORACLES[f"snk4_{name}"] = registry.ORACLES[sql_of]


REPORTS = {"hyper_learning": "agg33_suggestions", "production_diagnosis": "agg4_baseline_metrics", "knowledge_evolution": "agg21_correction_evolution",
           "client_ready": "agg2_kpi_by_country", "prediction": "agg20_problem_fields"}
for _name, _sql in REPORTS.items():
    _report(_name, _sql)
