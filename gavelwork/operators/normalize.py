"""Normalisation of field values by logical type."""

from pyspark.sql import functions as F

from gavelwork.functions import dates, money, names, text

# fixed values: logical type of each field; any other field is text
FIELD_TYPES = {
    "fecha": "date", "fecha_remate": "date", "fecha_prensa": "date", "finca": "number", "pagina_prensa": "number",
    "superficie": "number", "precio_base": "currency", "base": "currency", "fianza": "currency", "minimo": "currency",
    "fianza_porcentaje": "percent", "minimo_porcentaje": "percent", "demandante": "name", "demandado": "name",
    "lugar": "location", "provincia": "location",
}

# builders by type: each returns the normalised text
NORMALIZERS = {
    "date": lambda c: F.nullif(dates.to_iso(c), F.lit("")),
    "currency": lambda c: money.parse_generic(c).cast("decimal(18,2)").cast("string"),
    "number": lambda c: F.nullif(money.number_text(c), F.lit("")),
    "percent": lambda c: money.parse_percent(c).cast("decimal(8,2)").cast("string"),
    "name": names.legal_name,
    "location": names.place_display,
    "text": lambda c: F.nullif(text.ocr_clean(c), F.lit("")),
}


def register_normalizer(kind, builder):
    NORMALIZERS[kind] = builder


def normalize_long(df, field="field", value="value"):
    """Adds ``normalized`` and ``success`` to a long (field, value) table."""
    types = F.create_map(*[F.lit(x) for kv in FIELD_TYPES.items() for x in kv])
    d = df.withColumn("_t", F.coalesce(F.try_element_at(types, F.lower(F.col(field))), F.lit("text")))
    out = None
    for kind, build in NORMALIZERS.items():
        cond = F.col("_t") == kind
        out = F.when(cond, build(F.col(value))) if out is None else out.when(cond, build(F.col(value)))
    return d.withColumn("normalized", out).withColumn("success", F.col("normalized").isNotNull()).drop("_t")
