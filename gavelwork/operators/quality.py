"""Extraction-quality and operations reports as grouped aggregates over long result tables."""

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gavelwork.operators.boards import mean_of, percent, top_values
from gavelwork.session import checkpoint_dir


def union(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


def top_k(df, keys, order, k):
    """k rows per group by an ordering; the limit is pushed below the shuffle as a window group limit."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def positive_mean(col, digits=4):
    return F.coalesce(mean_of(col, col > 0, 4, digits), F.lit(0.0))


def count_of(name, *values):
    return F.count_if(F.col("decision").isin(*values)).alias(name)


def validation_summary(df):
    return df.agg(
        F.count("*").alias("total_avisos"), count_of("valid_count", "VALID"), count_of("invalid_count", "INVALID"),
        count_of("duplicated_count", "DUPLICATED", "LIKELY_DUPLICATED"), count_of("incomplete_count", "INCOMPLETE"),
        count_of("inconsistent_count", "INCONSISTENT"), count_of("review_count", "REQUIRES_REVIEW"),
        positive_mean(F.col("score")).alias("avg_score"))


def certification_report(df):
    total = F.count("*")
    dup = F.count_if(F.col("decision").isin("DUPLICATED", "LIKELY_DUPLICATED"))
    valid = F.count_if(F.col("decision") == "VALID")
    return df.agg(
        F.countDistinct("documento_id").alias("documents_processed"), total.alias("total_avisos"), valid.alias("valid"),
        count_of("invalid", "INVALID"), dup.alias("duplicated"), count_of("incomplete", "INCOMPLETE"),
        count_of("inconsistent", "INCONSISTENT"), count_of("requires_review", "REQUIRES_REVIEW"),
        positive_mean(F.col("score")).alias("avg_score"), positive_mean(F.col("confidence")).alias("avg_confidence"),
        percent(valid, total, 2).alias("valid_pct"), percent(valid + dup, total, 2).alias("auto_approved_pct"),
        percent(F.count_if(F.col("decision") == "REQUIRES_REVIEW"), total, 2).alias("manual_review_pct"))


# fixed values: fields counted for parser accuracy; decisions that count as valid or discarded
CANONICAL_FIELDS = ["expediente", "finca", "precio_base", "fecha_remate", "demandante", "demandado", "fianza_porcentaje",
                    "minimo_porcentaje"]
VALID_DECISIONS = ["VALID", "CERTIFIED"]
DISCOUNTED = ["INVALID", "REJECTED", "DUPLICATED", "LIKELY_DUPLICATED"]


def operational_metrics(results, fields):
    """Thirteen operational figures from one row per document and the long field table."""
    canonical = F.col("field").isin(CANONICAL_FIELDS) & (F.col("status") == "FOUND")
    by_doc = fields.groupBy("document_id").agg(
        F.count_distinct(F.when(canonical, F.col("field"))).alias("found"),
        F.max(F.when(F.col("source") == "knowledge", 1).otherwise(0)).alias("knowledge"))
    j = results.join(by_doc, "document_id", "left")
    n, d = F.count("*"), F.col("decision")
    valid = F.count_if(d.isin(VALID_DECISIONS))
    return j.agg(
        n.alias("documentos_procesados"), F.sum("avisos_detectados").alias("avisos_detectados"), valid.alias("avisos_validos"),
        F.count_if(d.isin(DISCOUNTED)).alias("avisos_descartados"), F.count_if(F.col("nivel_duplicado") != "UNIQUE").alias("duplicados"),
        mean_of(F.col("ocr"), None, 4, 3).alias("ocr_promedio"),
        F.round(F.sum(F.coalesce("found", F.lit(0))) * F.lit(100.0 / len(CANONICAL_FIELDS)) / n, 2).alias("parser_accuracy"),
        percent(F.sum(F.coalesce("knowledge", F.lit(0))), n, 2).alias("knowledge_usage"),
        F.round(F.sum(F.col("score").cast("decimal(8,4)")).cast("double") * 100 / n, 2).alias("validator_acceptance"),
        percent(valid, n, 2).alias("certification_rate"), F.sum("errores").alias("errores"), F.sum("warnings").alias("warnings"),
        mean_of(F.col("total_ms")).alias("_t")).withColumn("tiempo_promedio_ms", F.round("_t", 2)).drop("_t")


def stage_stats(df, keys=("stage",)):
    x = F.col("duration_ms")
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.sum(x.cast("decimal(18,2)")).cast("double"), 2).alias("total_ms"), mean_of(x, None, 2, 2).alias("avg_ms"),
        F.max(x).alias("max_ms"), F.min(x).alias("min_ms"), F.round(F.stddev_pop(x), 2).alias("std_ms"))


def slowest_stage(df):
    return stage_stats(df).orderBy(F.col("avg_ms").desc(), "stage").limit(1)


def run_totals(df):
    runs = df.groupBy("document_id").agg(F.sum(F.col("duration_ms").cast("decimal(18,2)")).cast("double").alias("duration_ms"))
    return stage_stats(runs, ())


def metric_categories(df):
    return df.groupBy("category").agg(F.count("*").alias("n"), mean_of(F.col("value"), None, 4, 4).alias("avg"),
                                      F.round(F.min("value"), 4).alias("min"), F.round(F.max("value"), 4).alias("max"))


def metric_summary(df):
    def part(category, *words):
        cond = (F.col("category") == category) & F.col("name").rlike("|".join(words))
        return F.coalesce(mean_of(F.col("value"), cond, 4, 4), F.lit(0.0))

    return df.agg(part("accuracy", "match_rate").alias("avg_match_rate"), part("performance", "throughput").alias("avg_throughput"),
                  part("performance", "time").alias("avg_time"), part("reliability", "success", "rate").alias("avg_success_rate"),
                  part("resource", "memory").alias("avg_memory_mb"))


def outcome(expected, actual, status, match):
    """tp / fp / fn of one field; nothing is counted where nothing was expected."""
    asked = expected.isNotNull() & (expected != "")
    found = F.coalesce(status == "FOUND", F.lit(False))
    return F.when(asked, F.when(found & F.coalesce(match, F.lit(False)), "tp").when(found, "fp").otherwise("fn"))


def precision_recall(df, keys=("field",), empty_precision=0.0):
    """Precision, recall, F1 and accuracy from a ``resultado`` column of tp / fp / fn."""
    g = df.groupBy(*keys).agg(*[F.count_if(F.col("resultado") == k).alias(k) for k in ("tp", "fp", "fn")])
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(float(empty_precision)))
    r = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    a = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(F.lit(2.0) * p * r, p + r), F.lit(0.0))
    return g.select(*keys, "tp", "fp", "fn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"),
                    F.round(f1, 4).alias("f1"), F.round(a, 4).alias("accuracy"))


def regression_report(df):
    """Matches per (country, field) with subtotals; a NULL key is a total."""
    g = df.rollup("country", "field").agg(F.count_if("match").alias("matches"), F.count("*").alias("total"))
    return g.withColumn("accuracy", percent(F.col("matches"), F.col("total"), 1))


def record_match_rate(df):
    """Share of records whose compared fields all match."""
    per = df.groupBy("record_id", "country").agg(F.min(F.col("match").cast("int")).alias("all_match"))
    return per.groupBy("country").agg(F.count("*").alias("total"), F.sum("all_match").alias("matches")).withColumn(
        "match_rate", percent(F.col("matches"), F.col("total"), 1))


# fixed values: priority of each stored field
FIELD_PRIORITY = {
    "expediente": "critical", "demandante": "critical", "demandado": "critical", "base": "critical", "finca_matr": "critical",
    "fianza_porcentaje": "high", "minimo_porcentaje": "high", "fecha": "high", "hora": "medium", "lugar": "medium",
    "proceso": "medium", "categoria": "medium", "provincia": "medium", "descripcion": "medium", "plano": "low", "lote_casa": "low",
    "superficie": "low", "periodico": "low", "fecha_prensa": "low", "pagina_prensa": "low", "email_observaciones": "low",
}


def field_accuracy(df):
    """Exact and normalised accuracy per field with its priority."""
    priority = F.create_map(*[F.lit(x) for kv in FIELD_PRIORITY.items() for x in kv])
    g = df.groupBy("field").agg(F.count("*").alias("n"), F.count_if("exact").alias("e"), F.count_if(F.col("exact") | F.col("norm")).alias("m"))
    return g.select("field", "n", F.round(F.col("e") / F.col("n"), 4).alias("exact_accuracy"), F.round(F.col("m") / F.col("n"), 4).alias(
        "normalized_accuracy"), F.coalesce(F.try_element_at(priority, F.col("field")), F.lit("low")).alias("priority"))


def priority_accuracy(df):
    """Mean of the field means per priority."""
    return field_accuracy(df).groupBy("priority").agg(F.count("*").alias("fields"), mean_of(F.col("exact_accuracy"), None, 4, 4).alias("exact_accuracy"))


def field_quality(df):
    """Status and source counts by field over all, by country and by document, in one grouping-sets pass."""
    f, s, src = F.col("field"), F.col("status"), F.col("source")
    return df.groupingSets([["field"], ["country", "field"], ["document_id", "field"]], "field", "country", "document_id").agg(
        F.grouping_id().alias("_g"), F.count_if(s == "FOUND").alias("found"), F.count_if(s == "NOT_FOUND").alias("not_found"),
        F.count_if(s == "REQUIRES_REVIEW").alias("review"), F.count_if((s == "FOUND") & (src == "parser")).alias("found_parser"),
        F.count_if((s == "FOUND") & (src == "knowledge")).alias("found_knowledge"),
        F.count_if((s == "FOUND") & (src == "ai")).alias("found_ia")).drop("_g").select(
        f, "country", "document_id", "found", "not_found", "review", "found_parser", "found_knowledge", "found_ia")


def ai_feedback_rows(df):
    """accepted / corrected / rejected of each proposed answer given the final status."""
    prop, final = F.col("decision"), F.col("final_status")
    return df.withColumn("veredicto", F.when((prop == "FOUND") & (final.isNull() | (final == "FOUND")), "aceptado").when(
        prop == "FOUND", "corregido").otherwise("rechazado"))


def ai_feedback(df):
    rows = ai_feedback_rows(df)
    w = F.col("veredicto")
    return rows.groupingSets([["campo"], ["modelo"], []], "campo", "modelo").agg(
        F.count("*").alias("total"), F.count_if(w == "aceptado").alias("aceptados"), F.count_if(w == "rechazado").alias("rechazados"),
        F.count_if(w == "corregido").alias("corregidos"), F.round(F.count_if(w == "aceptado") / F.count("*"), 4).alias("tasa_aceptacion"),
        mean_of(F.col("confidence"), None, 4, 4).alias("confianza_media"))


def message_top(df, col, k=10):
    return top_values(df.select(F.col(col).alias("mensaje")), "mensaje", "n", k)


def histogram(df, *cols):
    """Frequency of each value of several columns, long form."""
    return union([df.groupBy(F.lit(c).alias("columna"), F.col(c).cast("string").alias("valor")).agg(F.count("*").alias("n")) for c in cols])


# ---- knowledge ----

def usage_accuracy(df, keys=()):
    return df.groupBy(*keys).agg(F.count("*").alias("reglas"), F.sum("usage_count").alias("usos"), F.sum("success_count").alias("aciertos")).withColumn(
        "accuracy", F.round(F.col("aciertos") / F.greatest(F.col("usos"), F.lit(1)), 4))


def top_rules(df, by, k=10):
    return df.filter(F.col(by) > 0).orderBy(F.col(by).desc(), "rule_id").limit(k)


def knowledge_impact(rules, corrections):
    """Per-rule accuracy and origin country; the first correction of a document decides its country."""
    origin = corrections.groupBy("source_document_id").agg(F.min_by("pais", "id").alias("_p"))
    j = rules.join(origin, "source_document_id", "left")
    return j.select(
        "rule_id", "field_name", "status", "usage_count", "success_count", (F.col("usage_count") - F.col("success_count")).alias("fail_count"),
        F.coalesce(F.round(F.try_divide(F.col("success_count"), F.col("usage_count")), 4), F.lit(0.0)).alias("accuracy"),
        F.when(F.col("_p") == 1, "PA").when(F.col("_p") == 2, "CO").otherwise("N/A").alias("pais"))


# ---- corrections ----

def correction_evolution(df, k=20):
    g = df.groupBy("campo", "valor_anterior", "valor_nuevo").agg(F.count("*").alias("n"), F.max("creado_en").alias("ultima"))
    return g.orderBy(F.col("n").desc(), "campo", "valor_anterior", "valor_nuevo").limit(k)


def learning_summary(df, k=5):
    return df.groupBy("campo").agg(F.count("*").alias("total"), F.count_if("era_vacio").alias("vacios")).orderBy(
        F.col("total").desc(), "campo").limit(k)


def problem_fields(df, k=10):
    from gavelwork.functions.lookups import SUGGESTION_FIELDS
    from gavelwork.functions.text import key_alnum
    return df.filter(F.col("campo").isin(SUGGESTION_FIELDS)).groupBy("campo").agg(
        F.count("*").alias("veces"), F.count_if("era_vacio").alias("vacios"),
        F.count_distinct(key_alnum(F.col("valor_nuevo"))).alias("variantes")).orderBy(F.col("veces").desc(), "campo").limit(k)


def duplicate_keys(df):
    """One row per notice of a repeated (docket, property) key, with the key's size."""
    key = F.concat_ws("|", F.coalesce("expediente", F.lit("")), F.coalesce("finca_matr", F.lit("")))
    d = df.select("id", key.alias("clave")).filter(F.length(F.regexp_replace("clave", r"^\|+|\|+$", "")) > 2)
    return d.join(d.groupBy("clave").agg(F.count("*").alias("n")).filter("n > 1"), "clave").select("clave", "n", "id")


# ---- text statistics ----

def pattern_matches(df, patterns, keys=("country",), text="text"):
    """One row per match of a pattern table [(kind, regex, group), ...], read from the text once."""
    found = [F.transform(F.regexp_extract_all(F.col(text), F.lit(p), g), _tagged(kind)) for kind, p, g in patterns]
    return df.select(*keys, F.explode(F.concat(*found)).alias("m")).select(*keys, "m.kind", "m.value")


def _tagged(kind):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value"))


# fixed values: what is counted per country in raw texts
STAT_PATTERNS = [
    ("header", r"(?iu)(AVISO\s+DE\s+REMATE|EDICTO\s+EMPLAZATORIO|AVISO\s+P[ÚU]BLICO|REMATE\s+JUDICIAL)", 1),
    ("etiqueta", r"(?iu)(EXPEDIENTE|DEMANDANTE|DEMANDADO|JUZGADO|FINCA|MATR[ÍI]CULA|AVAL[ÚU]O|FECHA\s+DE\s+REMATE|HORA|PROVINCIA|FIANZA)", 1),
    ("dinero", r"((?:\$\s*|B\s*/\s*\.?\s*)(?:\d{1,3}(?:[.,]\d{3})+(?:[.,]\d{1,2})?|\d+[.,]\d{1,2}))", 1),
    ("fecha", r"(?iu)(\b\d{1,2}\s+DE\s+[A-ZÁÉÍÓÚÑ]{3,}\s+DE\s+\d{4}\b)", 1),
    ("expediente", r"(?iu)EXPEDIENTE\s*:?\s*(?:N[°º.]?\s*)?(\d{3,}[0-9\-]{2,})", 1),
    ("finca", r"(?iu)FINCA\s+(?:N[°º.]?\s*)?(\d{3,})", 1),
    ("matricula", r"(?iu)MATR[ÍI]CULA[^0-9\n]*(\d{3,})", 1),
    ("juzgado", r"(JUZGADO\s+[A-ZÁÉÍÓÚÑ]+\s+DE\s+CIRCUITO)", 1),
    ("porcentaje", r"(?iu)(\b\d{1,3}\s*(?:%|por\s+ciento\b))", 1),
    ("provincia", r"(?iu)(BOCAS\s+DEL\s+TORO|LOS\s+SANTOS|PANAMA|HERRERA|CHIRIQUI|COCLE|COLON|VERAGUAS|DARIEN)", 1),
]


def country_statistics(df, patterns=STAT_PATTERNS, k=None):
    """Frequencies of every kind per country, all of them unless the caller asks for the ``k`` most frequent."""
    m = pattern_matches(df, patterns).groupBy("country", "kind", F.upper("value").alias("value")).agg(F.count("*").alias("n"))
    return top_k(m, ["country", "kind"], [F.col("n").desc(), "value"], k) if k else m


# fixed value: how a text names a municipality
MUNICIPALITY = r"(?:DEL?\s+MUNICIPIO\s+DE|MUNICIPIO\s+DE|EN\s+EL\s+MUNICIPIO\s+DE)\s+([A-ZÁÉÍÓÚÑ'0-9.\s]{3,40})"


def municipalities(df, keys=("country",), text="text"):
    """Municipalities named in the texts with their numbers."""
    found = df.select(*keys, F.explode(F.regexp_extract_all(F.upper(text), F.lit(MUNICIPALITY), 1)).alias("m"))
    name = F.regexp_replace(F.regexp_replace("m", r"^\s+|\s+$", ""), r"^[ .]+|[ .]+$", "")
    return found.select(*keys, name.alias("municipio")).filter("municipio <> ''").groupBy(*keys, "municipio").agg(F.count("*").alias("n"))


OFTEN_BITS = 22
RARE = "-"


def _often(words, least, keys):
    """Bit table, as an array of 2 ** (OFTEN_BITS - 6) numbers, of the words (a column ``w``) that stand ``least`` times or more in their group."""
    often = words.select(F.xxhash64(*keys, "w").alias("h")).groupBy("h").agg(F.count("*").alias("c")).filter(F.col("c") >= least)
    bits = often.select(F.pmod("h", F.lit(1 << OFTEN_BITS)).alias("p")).select(F.shiftright("p", 6).alias("i"), F.expr("shiftleft(1L, CAST(p & 63 AS INT))").alias("bits"))
    every = bits.unionByName(words.sparkSession.range(1 << (OFTEN_BITS - 6)).select(F.col("id").alias("i"), F.lit(0).cast("bigint").alias("bits")))
    rows = every.groupBy("i").agg(F.bit_or("bits").alias("bits"))
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "bits"))), lambda x: x["bits"])).scalar()  # a subquery of the same plan


def expressions(df, least, sizes=(2, 3, 4), keys=("country",), text="text"):
    """Expressions of some words in a row that stand ``least`` times or more in the texts of a group, with their exact numbers.

    An expression that stands so often is made of words that do. Words are counted first; all others become the mark ``RARE``, so that texts
    which differ in a name or a code are alike again. Texts are then cut into chunks, one at each ``max(sizes)`` words with the words that an expression
    which begins in it can reach; equal chunks are counted where they are, and only the distinct ones give expressions.
    """
    most = max(sizes)
    words = F.regexp_extract_all(F.upper(text), F.lit("([A-ZÁÉÍÓÚÑ]{3,})"), 1)
    d = df.select(*keys, words.alias("w"))
    table = _often(d.select(*keys, F.explode("w").alias("w")), least, keys)

    def marked(x):
        p = F.pmod(F.xxhash64(*keys, x), F.lit(1 << OFTEN_BITS))
        often = F.getbit(F.get(table, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1
        return F.when(x.isNull() | often, x).otherwise(RARE)

    slices = F.transform(F.sequence(F.lit(1), F.size("w"), F.lit(most)), lambda i: F.slice("w", i, F.lit(2 * most - 1)))
    chunk = F.concat_ws(" ", *[marked(F.get("s", F.lit(j))) for j in range(2 * most - 1)])
    chunks = d.filter(F.size("w") > 0).select(*keys, F.explode(slices).alias("s")).select(*keys, chunk.alias("chunk")).groupBy(*keys, "chunk").agg(F.count("*").alias("c"))
    w = chunks.select(*keys, F.split("chunk", " ").alias("w"), "c")

    def grams(n):
        starts = F.sequence(F.lit(1), F.least(F.size("w") - (n - 1), F.lit(most)))
        return F.when(F.size("w") >= n, F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))

    every = w.select(*keys, F.explode(F.concat(*[grams(n) for n in sizes])).alias("expresion"), "c").filter(~F.contains("expresion", F.lit(RARE)))
    return every.groupBy(*keys, "expresion").agg(F.sum("c").alias("n")).filter(F.col("n") >= least)


# fixed values: names of one field in the two generations
FIELD_ALIASES = {"base": "precio_base", "finca_matr": "finca", "fecha": "fecha_remate"}


def unused_fields(catalog, results, golden):
    """(lista, field): catalogue fields that no result ever found (``nunca_usado``) and that no golden record can judge (``nunca_evaluado``)."""
    names = F.create_map(*[F.lit(x) for kv in FIELD_ALIASES.items() for x in kv])
    known = golden.select("field").unionByName(golden.select(F.try_element_at(names, F.col("field")).alias("field"))).distinct()
    used = results.filter("status = 'FOUND'").select("field").distinct()
    lists = ("nunca_usado", used), ("nunca_evaluado", known)
    return union([catalog.join(d, "field", "left_anti").select(F.lit(n).alias("lista"), "field") for n, d in lists])


def word_frequency(df, k=100, keys=("country",)):
    words = df.select(*keys, F.explode(F.regexp_extract_all("text", F.lit("([A-Za-zÁÉÍÓÚÑáéíóúñ]{3,})"), 1)).alias("w"))
    g = words.groupBy(*keys, F.upper("w").alias("palabra")).agg(F.count("*").alias("n"))
    return top_k(g, list(keys), [F.col("n").desc(), "palabra"], k)


# fixed values: text evidence of each field
FIELD_EVIDENCE = {
    "expediente": [r"EXPEDIENTE", r"NEGOCIO", r"E\.J\.E\.?"], "finca": [r"FINCA", r"FOLIO\s+REAL"], "matricula": [r"MATR[ÍI]CULA"],
    "precio_base": [r"BASE\s+(?:DEL\s+)?REMATE", r"AVAL[ÚU]O", r"PRECIO\s+BASE", r"VALOR\s+BASE"],
    "fianza_porcentaje": [r"FIANZA\s+DEL\s+POSTOR"], "minimo_porcentaje": [r"PORCENTAJE\s+M[ÍI]NIMO"],
    "fecha_remate": [r"FECHA\s+DE\s+REMATE", r"FECHA\s+(?:DEL\s+)?REMATE"],
    "hora": [r"\bHORA\b", r"\d{1,2}:\d{2}\s*(?:A\.?\s*M\.?|P\.?\s*M\.?|AM|PM)"],
    "demandante": [r"DEMANDANTE", r"ACTOR", r"EJECUTANTE", r"ACREEDOR"], "demandado": [r"DEMANDADO", r"DEUDOR", r"EJECUTADO"],
    "juzgado": [r"JUZGADO"], "lugar": [r"LUGAR", r"EN\s+EL\s+MUNICIPIO\s+DE", r"CIRCUITO\s+JUDICIAL"],
    "municipio": [r"MUNICIPIO", r"DEL\s+MUNICIPIO\s+DE"], "provincia": [r"PROVINCIA"],
    "fecha_publicacion": [r"FECHA\s+DE\s+PUBLICACI[ÓO]N"], "avaluo": [r"AVAL[ÚU]O\s+COMERCIAL"],
    "descripcion": [r"DESCRIPCI[ÓO]N", r"LINDEROS", r"UBICADO"], "proceso": [r"PROCESO", r"EJECUTIVO", r"HIPOTECARIO"],
}
EVIDENCE_CATALOG = {"matricula": "finca", "avaluo": "precio_base"}


def text_evidence(df):
    """Evidence counts per semantic field, one column per country."""
    counts = [sum((F.regexp_count("text", F.lit("(?iu)" + p)) for p in ps), F.lit(0)).alias(f) for f, ps in FIELD_EVIDENCE.items()]
    per = df.select("country", *counts).groupBy("country").agg(*[F.sum(f).alias(f) for f in FIELD_EVIDENCE])
    long = per.unpivot("country", list(FIELD_EVIDENCE), "field", "n")
    return long.groupBy("field").pivot("country", ["PA", "CO"]).agg(F.sum("n")).na.fill(0)


def catalog_coverage(evidence, catalog):
    """Catalog fields with their evidence and never / rarely / really / one-country flags."""
    names = F.create_map(*[F.lit(x) for kv in EVIDENCE_CATALOG.items() for x in kv])
    e = evidence.groupBy(F.coalesce(F.try_element_at(names, F.col("field")), F.col("field")).alias("field")).agg(
        F.sum("PA").alias("pa"), F.sum("CO").alias("co"))
    j = catalog.select("field").join(e, "field", "left").na.fill(0, ["pa", "co"])
    n = F.col("pa") + F.col("co")
    return j.withColumns({"nunca": n == 0, "casi_nunca": (n > 0) & (n <= 2), "real": n > 2,
                          "solo_pa": (F.col("pa") > 0) & (F.col("co") == 0), "solo_co": (F.col("co") > 0) & (F.col("pa") == 0)})


# fixed values: candidate rules whose evidence is counted
RULE_CANDIDATES = [
    ("PA", "expediente", r"EXPEDIENTE\s+N[°º.]?\s*([0-9]+[0-9\-/ ]*)"), ("PA", "precio_base", r"BASE\s+DEL\s+REMATE\s*[:\s]*B?/?\.?\s*([\d.,]+)"),
    ("PA", "finca", r"FINCA\s+N?[°º.]?\s*([0-9]+[0-9 ]*)"), ("PA", "finca", r"FOLIO\s+REAL\s+N[°º.]?\s*([0-9]+)"),
    ("PA", "fecha_remate", r"FECHA\s+DE\s+REMATE\s*[:\s]*(\d{1,2}\s+DE\s+[A-ZÁÉÍÓÚÑ]+\s+DE\s+\d{4})"),
    ("CO", "precio_base", r"AVAL[ÚU]O\s+COMERCIAL\s*:\s*\$?\s*([\d.,]+)"), ("CO", "fianza_porcentaje", r"FIANZA\s+DEL\s+POSTOR\s*:\s*(\d+)%"),
    ("CO", "demandado", r"Vs\.([A-ZÁÉÍÓÚÑ ,.]+)"),
]


def candidate_analytics(df):
    """Evidence of each candidate rule: frequency, three most frequent examples, usefulness bucket."""
    mine = [(f"{i}", "(?iu)" + p, 1) for i, (_, _, p) in enumerate(RULE_CANDIDATES)]
    found = pattern_matches(df, mine)
    spec = df.sparkSession.createDataFrame([(str(i), c, f) for i, (c, f, _) in enumerate(RULE_CANDIDATES)], "kind string, country string, campo string")
    g = found.groupBy("country", "kind", F.trim("value").alias("value")).agg(F.count("*").alias("n"))
    freq = g.groupBy("country", "kind").agg(F.sum("n").alias("frecuencia"))
    best = top_k(g, ["country", "kind"], [F.col("n").desc(), "value"], 3).groupBy("country", "kind").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "value"))), lambda x: x["value"]), "; ").alias("ejemplos"))
    j = F.broadcast(spec).join(freq, ["country", "kind"], "left").join(best, ["country", "kind"], "left")
    n = F.coalesce("frecuencia", F.lit(0))
    return j.select("country", F.col("kind").cast("int").alias("regla"), "campo", n.alias("frecuencia"), F.coalesce("ejemplos", F.lit("")).alias("ejemplos"),
                    F.when(n >= 3, "util").when(n >= 1, "aprendible").otherwise("ignorable").alias("clase"))


def loss_attribution(df):
    """Where golden fields are lost: in the parser or after it, and what the model recovered."""
    p, ai, final = F.col("parser_found"), F.col("ia_found"), F.col("final_found")
    return df.groupBy("field").agg(
        F.count("*").alias("total"), F.count_if(~final & ~p).alias("se_pierde_en_parser"), F.count_if(~final & p).alias("se_pierde_despues"),
        F.count_if(~p & ai).alias("ia_recupera"), F.count_if(~p & ~ai).alias("parser_pierde"))


def discard_report(df):
    """Pages kept or dropped rightly: edicts without an auction header, pages with neither."""
    edict = df["text"].rlike(r"(?iu)\bEDICTO\b")
    notice = df["text"].rlike(r"(?iu)AVISO\s+DE\s+REMATE")
    return df.groupBy("country").agg(F.count("*").alias("documentos"), F.count_if(edict & ~notice).alias("descartados_correctos"),
                                     F.count_if(~edict & ~notice).alias("descartados_incorrectos"), F.count_if(notice).alias("con_aviso"))


def repeated_dockets(df):
    """Dockets found in more than one document."""
    return df.groupBy("expediente").agg(F.count_distinct("documento_id").alias("documentos"), F.min("documento_id").alias("primero"),
                                        F.max("documento_id").alias("ultimo")).filter("documentos > 1")


def false_duplicate_keys(keys):
    """Different keys that share their first or last six characters, as sizes per shared part.

    Pairs are counted, not emitted; pairs sharing either part are prefijo + sufijo - ambos.
    """
    k = keys.select("clave").distinct()
    both = k.select("clave", F.explode(F.array(F.struct(F.lit("prefijo").alias("lado"), F.left("clave", F.lit(6)).alias("parte")),
                                               F.struct(F.lit("sufijo").alias("lado"), F.right("clave", F.lit(6)).alias("parte")),
                                               F.struct(F.lit("ambos").alias("lado"), F.concat(F.left("clave", F.lit(6)), F.lit("|"), F.right("clave", F.lit(6))).alias("parte")))).alias("p"))
    g = both.groupBy("p.lado", "p.parte").agg(F.count("*").alias("n"), F.min("clave").alias("primera"), F.max("clave").alias("ultima"))
    return g.filter("n > 1").withColumn("pares", (F.col("n") * (F.col("n") - 1) / 2).cast("bigint"))


# ---- evidence and confidence ----

def best_evidence(df):
    """Most confident value per field, the number of evidences and their mean; ties go to the earlier evidence."""
    return df.groupBy("document_id", "field").agg(
        F.max_by("value", F.struct("confidence", -F.col("seq"))).alias("value"), F.max("confidence").alias("confidence"),
        F.count("*").alias("evidencias"))


def evidence_summary(df):
    s = F.col("status")
    return df.agg(F.count("*").alias("total_evidence"), F.count_if(s == "FOUND").alias("found"), F.count_if(s == "NOT_FOUND").alias("not_found"),
                  F.count_if(s == "REQUIRES_REVIEW").alias("requires_review"), F.count_distinct("field").alias("unique_fields"))


def component_confidence(df):
    """Parser mean over found fields, mean over all, share normalised, per document."""
    c, s = F.col("confidence"), F.col("status")
    return df.groupBy("document_id").agg(
        F.coalesce(mean_of(c, s == "FOUND", 4, 4), F.lit(0.0)).alias("parser"), mean_of(c, None, 4, 4).alias("media"),
        F.round(F.count_if(s != "NOT_FOUND") / F.count("*"), 4).alias("normalizacion"))


def word_confidence(words):
    return words.groupBy("page").agg(mean_of(F.col("confidence"), None, 4, 4).alias("ocr"), F.count("*").alias("palabras"))


def trail_summary(df):
    return df.groupingSets([["source"], ["status"], []], "source", "status").agg(F.count("*").alias("n"), mean_of(F.col("confidence"), None, 4, 4).alias("avg_confidence"))


# ---- catalogs ----

def column_profile(df, catalog, columns):
    """Non-empty count of each column against a catalog table: priority by frequency, produced / consumed / orphan, score."""
    counts = df.agg(*[F.count(F.nullif(F.col(c).cast("string"), F.lit(""))).alias(c) for c in columns])
    long = counts.unpivot([], list(columns), "field", "frecuencia")
    j = catalog.join(long, "field", "full")
    n = F.coalesce("frecuencia", F.lit(0))
    produced, consumed = n > 0, F.coalesce("consumed", F.lit(False))
    known = F.col("data_type").isNotNull()
    score = (F.when(~known, 0).when(~produced & ~consumed, F.when(F.coalesce("in_golden", F.lit(False)), 25).otherwise(0)).when(~produced, 50)
             .when(~consumed, 75).when(~F.coalesce("documented", F.lit(False)), 90).otherwise(100))
    prio = (F.when(F.col("field").isin("expediente", "demandante", "demandado", "base", "finca_matr", "precio_base", "finca", "fecha_remate", "fecha"), "critical")
            .when(F.col("field").isin("fianza_porcentaje", "minimo_porcentaje", "codigo", "pais"), "high")
            .when(n >= 10, "high").when(n >= 3, "medium").when(n > 0, "low").otherwise("unknown"))
    return j.select("field", n.alias("frecuencia"), prio.alias("prioridad"), produced.alias("producido"), consumed.alias("consumido"),
                    (~produced & ~consumed).alias("huerfano"), score.alias("puntaje"))


def alias_hygiene(df):
    """Aliases owned by several fields, repeated in one field, or mutual."""
    owners = df.groupBy("alias").agg(F.count_distinct("field").alias("duenos"), F.count("*").alias("veces"))
    mutual = df.alias("a").join(df.alias("b"), (F.col("a.alias") == F.col("b.field")) & (F.col("b.alias") == F.col("a.field"))
                                & (F.col("a.field") < F.col("b.field"))).select(F.col("a.field").alias("alias"), F.lit("mutuo").alias("problema")).distinct()
    return (owners.filter("duenos > 1").select("alias", F.lit("compartido").alias("problema"))
            .unionByName(owners.filter("veces > duenos").select("alias", F.lit("repetido").alias("problema"))).unionByName(mutual))


# fixed values: formats of the typed fields
FORMATS = {"date": r"^\d{4}-\d{2}-\d{2}$", "number": r"^-?\d+(?:\.\d+)?$", "currency": r"^-?\d+(?:\.\d+)?$"}


def format_conflicts(df):
    """Values that do not fit the declared type of their field."""
    bad = F.lit(False)
    for kind, p in FORMATS.items():
        bad = bad | ((F.col("data_type") == kind) & ~F.col("value").rlike(p))
    return df.filter(F.col("value").isNotNull()).groupBy("field", "data_type").agg(F.count("*").alias("valores"), F.count_if(bad).alias("conflictos"))


# fixed values: keywords counted in a document
KEYWORDS = ["REMATE", "SUBASTA", "BASE DEL REMATE", "AVALUO", "AVALÚO", "POSTURA", "FIANZA", "CONSIGNAR", "DEMANDANTE", "DEMANDADO",
            "JUZGADO", "EDICTO", "EMPLAZA", "SUCESION", "FINCA", "FOLIO REAL"]


def keyword_counts(df, key):
    up = F.upper("text")
    wide = df.select(key, *[F.regexp_count(up, F.lit(k)).alias(k) for k in KEYWORDS])
    return wide.unpivot(key, KEYWORDS, "keyword", "n").filter("n > 0")


# fixed values: known expressions and labels left out of the vocabulary
KNOWN_EXPRESSIONS = ["AVISO DE REMATE", "EDICTO EMPLAZATORIO", "BASE DEL REMATE", "FECHA DE REMATE", "AVALUO COMERCIAL", "AVALÚO COMERCIAL",
                     "CIRCUITO JUDICIAL DE", "REPUBLICA DE PANAMA", "REPÚBLICA DE PANAMÁ"]
KNOWN_LABELS = ["AVISO", "EDICTO", "JUEZ", "JUEZA", "REPUBLICA", "REPÚBLICA", "ORGANO", "ÓRGANO", "DATOS", "LINDEROS", "OBSERVACIONES",
                "RESTRICCIONES", "NORTE", "SUR", "ESTE", "OESTE", "NOTIFIQ"]


def vocabulary_mining(df):
    """Recurrent capital expressions (top 15) and labels (top 20) that are not known yet, seen at least twice."""
    found = pattern_matches(df, [("expresion", r"\b([A-ZÁÉÍÓÚÑ]{3,}(?:[ \t]+[A-ZÁÉÍÓÚÑ]{3,}){1,3})\b", 1), ("label_nuevo", r"\b([A-ZÁÉÍÓÚÑ]{4,})[ \t]*:", 1)])
    g = found.groupBy("country", "kind", "value").agg(F.count("*").alias("n"))
    known = ((F.col("kind") == "expresion") & F.col("value").isin(KNOWN_EXPRESSIONS)) | ((F.col("kind") == "label_nuevo") & F.col("value").isin(KNOWN_LABELS))
    expr = top_k(g.filter((F.col("kind") == "expresion") & ~known), ["country", "kind"], [F.col("n").desc(), "value"], 15)
    labels = top_k(g.filter(F.col("kind") == "label_nuevo"), ["country", "kind"], [F.col("n").desc(), "value"], 20)
    return expr.unionByName(labels.filter(~F.col("value").isin(KNOWN_LABELS))).filter("n >= 2")


# fixed values: digits that OCR confuses with letters
CONFUSIONS = {"0": "O", "1": "I", "5": "S", "8": "B"}


def ocr_defects(df, k=40):
    """Split words, joined words, lost accents, digit-letter confusions and odd symbols, top k of each per country."""
    cls = "A-Za-zÁÉÍÓÚÑáéíóúñ"
    tokens = df.select("country", F.explode(F.regexp_extract_all("text", F.lit(f"([{cls}0-9']+)"), 1)).alias("t")).groupBy("country", "t").agg(F.count("*").alias("n"))
    checkpoint_dir(df.sparkSession)
    tokens = tokens.checkpoint()  # distinct spellings only; every branch below starts from them
    words = tokens.groupBy("country", F.upper(F.regexp_replace("t", f"[^{cls}]", "")).alias("w")).agg(F.sum("n").alias("n")).filter("w <> ''")
    key = words.select("country", "w")

    def report(kind, d):
        return d.select("country", F.lit(kind).alias("kind"), "value", F.col("n").cast("bigint").alias("n"))

    pairs = df.select("country", F.explode(F.regexp_extract_all("text", F.lit(f"([{cls}]{{3,}}\\s*-\\s*[{cls}]{{3,}})"), 1)).alias("p"))
    sides = F.split(F.regexp_replace(F.upper("p"), r"\s", ""), "-")
    split = pairs.groupBy("country", sides[0].alias("a"), sides[1].alias("b")).agg(F.count("*").alias("n"))
    split = split.withColumn("w", F.concat("a", "b")).join(key, ["country", "w"]).withColumn("value", F.concat("a", F.lit("-"), "b", F.lit(" -> "), "w"))
    cuts = words.filter(F.length("w") >= 6).select("country", "w", "n", F.explode(F.sequence(F.lit(3), F.length("w") - 3)).alias("i"))
    cuts = cuts.select("country", "w", "n", "i", F.left("w", F.col("i")).alias("a"), F.substr("w", F.col("i") + 1).alias("b")).filter("a <> b")
    joined = (cuts.join(key.withColumnRenamed("w", "a"), ["country", "a"], "left_semi").join(key.withColumnRenamed("w", "b"), ["country", "b"], "left_semi")
              .groupBy("country", "w", "n").agg(F.min("i").alias("i")))
    joined = joined.withColumn("value", F.concat(F.left("w", F.col("i")), F.lit("+"), F.substr("w", F.col("i") + 1), F.lit(" -> "),
                                                 F.left("w", F.col("i")), F.lit(" "), F.substr("w", F.col("i") + 1)))
    accented = words.filter(F.col("w").rlike("[ÁÉÍÓÚÑ]")).groupBy("country", F.translate("w", "ÁÉÍÓÚÑ", "AEIOUN").alias("plain")).agg(F.min("w").alias("acc"))
    lost = words.filter(~F.col("w").rlike("[ÁÉÍÓÚÑ]") & (F.length("w") >= 3)).join(accented.withColumnRenamed("plain", "w"), ["country", "w"])
    lost = lost.withColumn("value", F.concat("w", F.lit(" (sin acento) -> "), "acc"))
    digit = tokens.groupBy("country", F.upper("t").alias("t")).agg(F.sum("n").alias("n")).filter(F.col("t").rlike("[0-9]") & (F.length("t") >= 3))
    mixed = digit.select("country", "t", "n", F.explode(F.array(*[F.replace("t", F.lit(d), F.lit(c)) for d, c in CONFUSIONS.items()])).alias("w")).filter("t <> w")
    mixed = mixed.join(key, ["country", "w"]).withColumn("value", F.concat("t", F.lit(" -> "), "w"))
    odd = df.select("country", F.explode(F.regexp_extract_all("text", F.lit(f"([^{cls}0-9\\s.,:;()/\"'-])"), 1)).alias("value")).groupBy("country", "value").agg(
        F.count("*").alias("n"))
    every = union([report("partida", split), report("unida", joined), report("acento", lost), report("confusion", mixed), report("simbolo", odd)])
    return top_k(every, ["country", "kind"], [F.col("n").desc(), "value"], k)


# ---- run summaries ----

def run_summary(fields, stages, results):
    """Long summary: fields found, sources, decisions and mean stage times."""
    f = fields.groupBy(F.lit("campo").alias("grupo"), F.col("field").alias("clave")).agg(F.count_if(F.col("status") == "FOUND").cast("double").alias("valor"))
    s = fields.groupBy(F.lit("fuente").alias("grupo"), F.when(F.col("source") == "ai", "ia").otherwise("determinista").alias("clave")).agg(
        F.count_if(F.col("status") == "FOUND").cast("double").alias("valor"))
    t = stages.groupBy(F.lit("etapa_ms").alias("grupo"), F.col("stage").alias("clave")).agg(mean_of(F.col("duration_ms"), None, 2, 2).alias("valor"))
    d = results.groupBy(F.lit("decision").alias("grupo"), F.col("decision").alias("clave")).agg(F.count("*").cast("double").alias("valor"))
    return union([f, s, t, d])


def audit_statistics(df):
    return df.groupingSets([["provider"], ["decision"], []], "provider", "decision").agg(
        F.count("*").alias("entries"), F.sum("tokens").alias("total_tokens"), mean_of(F.col("latency_ms"), None, 3, 3).alias("avg_latency_ms"))


def document_rollup(df):
    """Found, missing and review field lists of each document and its mean field confidence."""
    def names(state):
        return F.array_join(F.array_sort(F.collect_set(F.when(F.col("status") == state, F.col("field")))), ",")

    return df.groupBy("document_id").agg(names("FOUND").alias("found"), names("NOT_FOUND").alias("missing"), names("REQUIRES_REVIEW").alias("review"),
                                         positive_mean(F.col("confidence")).alias("confianza"))


def golden_coverage(df, fields):
    """Share of records with each field."""
    n = df.agg(F.count("*").alias("total"), *[F.count(c).alias(c) for c in fields])
    return n.unpivot("total", list(fields), "field", "present").withColumn("coverage_pct", percent(F.col("present"), F.col("total"), 1))


def golden_issues(df):
    """Integrity problems: missing docket or plaintiff, base not positive, more records than a suite expects."""
    checks = F.array_compact(F.array(F.when(F.coalesce(F.col("expediente") == "", F.lit(True)), "sin_expediente"),
                                     F.when(F.coalesce(F.col("demandante") == "", F.lit(True)), "sin_demandante"),
                                     F.when(F.coalesce(F.col("base") <= 0, F.lit(True)), "base_invalida")))
    per = df.select("suite", F.explode(checks).alias("problema")).groupBy("suite", "problema").agg(F.count("*").alias("n"))
    over = df.groupBy("suite").agg(F.count("*").alias("n"), F.max("expected_count").alias("e")).filter("n > e").select(
        "suite", F.lit("exceso").alias("problema"), "n")
    return per.unionByName(over)
