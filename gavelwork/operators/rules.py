"""Amount rules, approval, validation, scores and explanations as column projections."""

from pyspark.sql import functions as F

from gavelwork.functions import lookups as lk
from gavelwork.functions.text import blank, key_upper_plain, strip_all
from gavelwork.operators.notice_text import advert_only, detect_header, edict_only


def names_array(values):
    return F.array(*[F.lit(x) for x in values])


def share(base, pct):
    """base x percent, rounded half up to cents in exact arithmetic."""
    return (base * pct.cast("decimal(6,2)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(18,2)")


def _legal(pct, pais, table):
    def near(values):
        hit = F.lit(False)
        for x in values:
            hit = hit | (F.abs(pct - x) <= lk.PERCENT_TOLERANCE)
        return hit

    return F.when(pais == 1, near(table[1])).otherwise(near(table[2]))


def amount_rules(df):
    """Deposit and minimum from base and percentage, with the list of discrepancies."""
    base, pais = F.col("base"), F.col("pais")
    has = base.isNotNull()
    assumed = has & (pais == 2) & F.col("fianza_porcentaje").isNull()
    d = df.withColumns({"fianza_asumida_por_regla": assumed,
                        "fianza_pct": F.when(assumed, 40.0).otherwise(F.col("fianza_porcentaje"))})
    dep, mini = F.col("fianza_pct"), F.col("minimo_porcentaje")
    d = d.withColumns({
        "fianza_legal": _legal(dep, pais, lk.LEGAL_DEPOSIT), "minimo_legal": _legal(mini, pais, lk.LEGAL_MINIMUM)})
    d = d.withColumns({
        "fianza_calculada": F.when(has & F.col("fianza_legal"), share(base, dep)),
        "minimo_calculado": F.when(has & F.col("minimo_legal"), share(base, mini))})

    def off(printed, computed):
        gap = F.abs(F.col(printed) - F.col(computed)).cast("double") / base.cast("double")
        return (F.col(printed) != 0) & (F.col(computed) != 0) & (gap > 0.03)

    found = F.array_compact(F.array(
        F.when(dep.isNull(), "fianza_no_leida").when(~F.col("fianza_legal"), "fianza_no_legal"),
        F.when(mini.isNull(), "minimo_no_leido").when(~F.col("minimo_legal"), "minimo_no_legal"),
        F.when(off("fianza", "fianza_calculada"), "fianza_impresa_distinta"),
        F.when(off("minimo", "minimo_calculado"), "minimo_impreso_distinto")))
    return d.withColumns({
        "discrepancias": F.when(has, found).otherwise(F.array().cast("array<string>")),
        "fianza_final": F.when(has, F.coalesce("fianza_calculada", "fianza")),
        "minimo_final": F.when(has, F.coalesce("minimo_calculado", "minimo"))})


def amount_fallbacks(df):
    """Usual percentages where an amount is still missing and the base is over 500; runs after ``amount_rules``."""
    base, pais = F.col("base"), F.col("pais")
    big = base > 500

    def empty(c):
        return F.col(c).isNull() | (F.col(c) == 0)

    no_min, no_dep = big & empty("minimo_final"), big & empty("fianza_final")
    min_default = no_min & F.coalesce(F.col("minimo_porcentaje") == 0, F.lit(True))
    dep_default = no_dep & F.coalesce(F.col("fianza_pct") == 0, F.lit(True))
    d = df.withColumns({
        "minimo_pct_final": F.when(min_default, F.when(pais == 1, 66.67).otherwise(70.0)).otherwise(F.col("minimo_porcentaje")),
        "fianza_pct_final": F.when(dep_default, F.when(pais == 1, 10.0).otherwise(40.0)).otherwise(F.col("fianza_pct")),
        "_assumed": F.coalesce(min_default, F.lit(False)) | F.coalesce(dep_default & (pais == 1), F.lit(False))})
    return d.withColumns({
        "minimo_final": F.when(no_min, share(base, F.col("minimo_pct_final"))).otherwise(F.col("minimo_final")),
        "fianza_final": F.when(no_dep, share(base, F.col("fianza_pct_final"))).otherwise(F.col("fianza_final")),
        "discrepancias": F.when(F.col("_assumed"), F.filter("discrepancias", lambda x: ~x.rlike("_no_leid"))).otherwise(
            F.col("discrepancias"))}).drop("_assumed")


def category_override(df):
    """Shares of a property are always miscellaneous; a foreign code moves to the source code."""
    share_words = (F.contains(key_upper_plain(F.col("categoria")), F.lit("CUOTA PARTE"))
                   | key_upper_plain(F.col("descripcion")).rlike("CUOTA PARTE|CUOTAS PARTES")
                   | F.contains(key_upper_plain(F.col("descripcion_completa")), F.lit("CUOTAS PARTES"))
                   | F.contains(key_upper_plain(F.col("proceso")), F.lit("CUOTAS PARTES")))
    own = F.col("codigo").rlike("^(PA|CO)")
    from gavelwork.sources.sinks import code_map
    code = F.try_element_at(code_map(lk.CATEGORY_CODES), key_upper_plain(F.col("categoria")))
    return df.withColumns({
        "categoria_codigo": F.when(share_words, 5).otherwise(code),
        "categoria": F.when(share_words, "MISCELANEO").otherwise(F.col("categoria")),
        "codigo_fuente": F.when(blank(F.col("codigo_fuente")) & ~blank(F.col("codigo")) & ~own, F.col("codigo")).otherwise(
            F.col("codigo_fuente"))})


def _mean(values):
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def approval(df, confidence="confianza", missing="faltantes", discrepancy="discrepancia"):
    """Decision, reason and mean confidence from a map of field confidences."""
    keep = F.map_filter(F.col(confidence), lambda k, x: x.isNotNull() & ~k.isin(lk.DERIVED_FIELDS))
    critical = F.map_filter(keep, lambda k, x: ~k.isin(lk.NON_CRITICAL_FIELDS))
    d = df.withColumns({"_all": F.map_values(keep), "_crit": F.map_values(critical)})
    d = d.withColumn("_mean", F.when(F.size("_all") > 0, _mean(F.col("_all"))).otherwise(0.0))
    d = d.withColumn("_cmean", F.when(F.size("_crit") > 0, _mean(F.col("_crit"))).otherwise(F.col("_mean")))
    blocking = F.filter(F.col(missing), lambda f: ~f.isin(lk.NON_CRITICAL_FIELDS))
    reason = (F.when(F.col("tipo_validacion") == "duplicado_sospechoso", "duplicado")
              .when(F.col(discrepancy), "discrepancia").when(F.size(blocking) > 0, F.concat(F.lit("faltan: "), F.array_join(blocking, ", ")))
              .when(F.col("_cmean") < lk.CONFIDENCE_THRESHOLD, "confianza").otherwise("ok"))
    d = d.withColumns({"motivo": reason, "confianza_media": F.round("_mean", 3)})
    return d.withColumn("decision", F.when(F.col("motivo") == "ok", "auto_aprobado").otherwise("esperando_aprobacion")).drop(
        "_all", "_crit", "_mean", "_cmean")


# fixed values: pairs of field groups that should appear together
CO_OCCURRENCE = [
    (["finca", "finca_matr"], ["expediente"]), (["expediente"], ["finca", "finca_matr"]),
    (["precio_base", "base"], ["fecha_remate", "fecha"]), (["fecha_remate", "fecha"], ["precio_base", "base"]),
    (["demandante"], ["demandado"]), (["demandado"], ["demandante"]),
    (["fianza_porcentaje"], ["precio_base", "base"]), (["minimo_porcentaje"], ["precio_base", "base"]),
]


def co_occurrence_warnings(fields):
    return F.array_compact(F.array(*[
        F.when(F.arrays_overlap(fields, names_array(a)) & ~F.arrays_overlap(fields, names_array(b)),
               F.lit(f"{a[0]} presente pero no {b[0]}")) for a, b in CO_OCCURRENCE]))


# fixed values: validation rules in order, with their weights
VALIDATION_RULES = [("valid_header", 0.25), ("not_publicidad", 0.15), ("not_edicto", 0.15), ("min_one_strong_field", 0.15),
                    ("structural_coherence", 0.15), ("field_co_occurrence", 0.10), ("min_field_count", 0.05)]
CRITICAL = ["base", "expediente", "finca", "finca_matr", "precio_base"]


def validate(df, text="text", fields="campos"):
    """Seven weighted rules over a notice text and its found fields, and the decision ladder."""
    f = F.transform(F.col(fields), F.lower)
    d = df.withColumns({"_f": F.array_distinct(f), "_h": detect_header(F.col(text)),
                        "_ad": advert_only(F.col(text)), "_ed": edict_only(F.col(text))})
    known = {n: F.size(F.array_intersect(F.col("_f"), names_array(v))) for n, v in
             (("s", lk.STRONG_FIELDS), ("m", lk.MEDIUM_FIELDS), ("w", lk.WEAK_FIELDS))}
    d = d.withColumns({"_s": known["s"], "_m": known["m"], "_n": known["s"] + known["m"] + known["w"],
                       "avisos_coocurrencia": co_occurrence_warnings(F.col("_f"))})
    d = d.withColumns({"_r1": F.col("_h")["valid"], "_r2": ~F.col("_ad"), "_r3": ~F.col("_ed"),
                       "_r4": (F.col("_s") >= 1) | (F.col("_m") >= 2)})
    d = d.withColumns({"_r5": F.col("_r1") & F.col("_r4"), "_r6": F.size("avisos_coocurrencia") == 0, "_r7": F.col("_n") >= 2})
    passed = {name: F.col(f"_r{i}") for i, (name, _) in enumerate(VALIDATION_RULES, 1)}
    applied = F.array_compact(F.array(*[F.when(p, F.lit(n)) for n, p in passed.items() if n != "structural_coherence"]))
    failed = F.array_compact(F.array(*[F.when(~p, F.lit(n)) for n, p in passed.items()]))
    d = d.withColumns({
        "reglas_aplicadas": applied, "reglas_fallidas": failed, "cabecera": F.col("_h")["header"],
        "cabecera_valida": F.col("_r1"), "estructura_valida": F.col("_r5"),
        "campos_encontrados": F.array_sort(F.array_intersect(F.col("_f"), names_array(
            lk.STRONG_FIELDS + lk.MEDIUM_FIELDS + lk.WEAK_FIELDS))),
        "campos_faltantes": F.array_except(names_array(CRITICAL), F.col("_f"))})
    decision = (F.when(~F.col("_r1"), "INVALID").when(F.size("reglas_fallidas") >= 4, "INVALID").when(F.col("_n") == 0, "INVALID")
                .when(~F.col("_r2") | ~F.col("_r3"), "INVALID").when(F.col("_r5") & (F.col("_n") >= 4), "VALID")
                .when(F.col("_r5"), "INCOMPLETE").otherwise("REQUIRES_REVIEW"))
    return d.withColumn("decision", decision).drop(
        "_f", "_h", "_ad", "_ed", "_s", "_m", "_n", *[f"_r{i}" for i in range(1, 8)])


def notice_score(df):
    """Independent score 0-1; the consistency part is halved as soon as there is any issue."""
    fields = F.col("campos_encontrados")

    def points(n, weight):
        return n.cast("decimal(4,0)") * F.lit(weight).cast("decimal(8,6)")

    def given(cond, weight):
        return points(F.when(cond, 1).otherwise(0), weight)

    def count(values):
        return F.size(F.array_intersect(fields, names_array(values)))

    rule = lambda n: F.array_contains("reglas_aplicadas", n)
    every = len(lk.STRONG_FIELDS) + len(lk.MEDIUM_FIELDS) + len(lk.WEAK_FIELDS)
    total = (given(F.col("cabecera_valida"), 0.20) + points(count(lk.STRONG_FIELDS), 0.20 / len(lk.STRONG_FIELDS))
             + points(count(lk.MEDIUM_FIELDS), 0.15 / len(lk.MEDIUM_FIELDS)) + points(F.size(fields), 0.10 / every)
             + given(rule("field_co_occurrence"), 0.10) + given(F.lit(True), 0.05) + given(F.col("inconsistencias") == 0, 0.05)
             + given(rule("not_publicidad"), 0.05) + given(rule("not_edicto"), 0.05) + given(F.col("estructura_valida"), 0.05))
    return df.withColumn("score", F.least(F.round(total, 4), F.lit(1).cast("decimal(5,4)")).cast("double"))


def consistency_issues(fields, dates):
    """Issues as (kind, severity) structs from a field map and the dates found in the text."""
    from gavelwork.functions.dates import impossible_date

    def values(*names):
        got = [F.nullif(strip_all(F.try_element_at(fields, F.lit(n))), F.lit("")) for n in names]
        return F.array_compact(F.array(*got))

    def issue(cond, kind, severity):
        return F.when(cond, F.struct(F.lit(kind).alias("tipo"), F.lit(severity).alias("gravedad")))

    plaintiff, defendant = values("demandante"), values("demandado")
    bad = F.transform(F.filter(dates, impossible_date), lambda d: F.struct(F.lit("fecha_imposible").alias("tipo"), F.lit("medium").alias("gravedad")))
    main = F.array_compact(F.array(
        issue(F.size(F.array_distinct(values("base", "precio_base"))) > 1, "base", "high"),
        issue(F.size(F.array_distinct(values("finca", "finca_matr"))) > 1, "finca", "high"),
        issue(F.size(F.array_distinct(dates)) > 1, "fechas", "medium"),
        issue((F.size(plaintiff) > 0) & (F.upper(F.get(plaintiff, F.lit(0))) == F.upper(F.get(defendant, F.lit(0)))), "partes", "high")))
    return F.concat(main, bad)


def final_decision(decision, duplicate_level, issues):
    first = F.when(duplicate_level == "DUPLICATED", "DUPLICATED").when(
        (duplicate_level == "LIKELY_DUPLICATED") & (decision == "VALID"), "LIKELY_DUPLICATED").otherwise(decision)
    return F.when((first == "VALID") & (issues > 0), "INCONSISTENT").otherwise(first)


# fixed values: weights of the two confidence formulas
DOCUMENT_WEIGHTS = {"ocr": 0.20, "segmentation": 0.15, "parser": 0.25, "normalization": 0.10, "validation": 0.15, "knowledge": 0.15}
FIELD_WEIGHTS = {"parser": 0.40, "ocr": 0.20, "normalization": 0.15, "knowledge": 0.15, "validation": 0.10}


def weighted(scores, weights):
    total = F.lit(0.0)
    for k, w in weights.items():
        total = total + F.coalesce(scores[k], F.lit(0.0)) * w
    return F.round(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)), 4)


def document_confidence(scores):
    return weighted(scores, DOCUMENT_WEIGHTS)


def field_confidence(parser, ocr, normalized, knowledge, validated):
    """Weighted field confidence and the reasons behind it."""
    norm = F.when(normalized.isNull(), 0.0).when(normalized, 1.0).otherwise(0.5)
    scores = {"parser": F.round(parser, 4), "ocr": F.round(ocr, 4), "normalization": norm, "knowledge": F.round(knowledge, 4),
              "validation": F.when(validated, 1.0).otherwise(0.0)}
    reasons = F.concat_ws(", ", F.when(parser >= 0.9, "parser_high_confidence"), F.when(ocr >= 0.8, "ocr_high_quality"),
                          F.when(normalized, "normalization_success"), F.when(validated, "validator_passed"))
    return weighted(scores, FIELD_WEIGHTS), F.coalesce(F.nullif(reasons, F.lit("")), F.lit("low_confidence"))


def knowledge_boost(base, rule_hits):
    return F.when(rule_hits > 0, F.round(F.least(base + rule_hits * 0.1, F.lit(1.0)), 4)).otherwise(base)


def notice_intelligence(df):
    """Why a notice waits, what it misses, who produced it and the confidence expected."""
    from gavelwork.operators.search import missing_fields
    pct, pais = F.col("fianza_porcentaje"), F.col("pais")
    low = F.array_compact(F.array(
        F.when(F.col("discrepancia"), "discrepancia_valores"),
        F.when(F.col("confianza_promedio") < 0.70, "confianza_baja"),
        F.when(F.col("base").isNull() | (F.col("base") == 0), "base_faltante"),
        F.when(F.col("fianza").isNull() & F.coalesce(pct == 0, F.lit(True)), "fianza_indeterminada"),
        F.when(F.col("minimo").isNull() & F.coalesce(F.col("minimo_porcentaje") == 0, F.lit(True)), "minimo_indeterminado")))
    waiting = F.col("estado") == "esperando_aprobacion"
    reasons = F.concat(
        low, F.array_compact(F.array(F.when(waiting & (F.size(low) == 0), "pendiente_revision_cliente"),
                                     F.when(pct.isNotNull() & ~_legal(pct, pais, lk.LEGAL_DEPOSIT), "fianza_pct_no_legal"))))
    source = F.col("codigo_fuente")  # fixed values: prefixes written by each extraction engine
    engine = F.when(source.startswith("det-"), "deterministico").when(source.rlike("^(ai-|claude|gemini)"), "ia").otherwise("desconocido")
    missing = missing_fields(lk.FUNDAMENTAL_FIELDS)
    n = len(lk.FUNDAMENTAL_FIELDS)
    d = df.withColumns({"motivos": reasons, "faltantes": missing, "motor": engine})
    conf = (F.coalesce(F.col("confianza_promedio"), F.lit(0.0)) * 0.7 + (F.lit(n) - F.size("faltantes")) / F.lit(float(n)) * 0.3
            - F.when(F.col("discrepancia"), 0.25).otherwise(0.0) - F.when(waiting, 0.15).otherwise(0.0))
    return d.withColumn("confianza_predicha", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(conf, 3))))


# ---- certification and readiness ----

# fixed values: criteria (name, operator, threshold, weight)
CRITERIA = [("parser_accuracy", ">=", 85.0, 0.35), ("stress_test_reliability", ">=", 95.0, 0.20),
            ("parser_throughput", ">=", 10.0, 0.15), ("parser_memory", "<=", 50.0, 0.10),
            ("golden_dataset_integrity", "==", 1.0, 0.20), ("schema_alignment", ">=", 100.0, 0.10),
            ("alignment_critical_fields_missing_producer", "==", 0.0, 0.10),
            ("alignment_required_fields_no_consumer", "==", 0.0, 0.10),
            ("alignment_golden_fields_without_parser", "==", 0.0, 0.10)]
PASSING_SCORE = 70.0


def criteria_table(spark):
    return spark.createDataFrame(CRITERIA, "criterion string, op string, threshold double, weight double")


def certify(metrics, spark, keys=()):
    """Criteria against a long (criterion, actual) metrics table."""
    c = F.broadcast(criteria_table(spark))
    j = metrics.join(c, "criterion")
    a, t = F.col("actual"), F.col("threshold")
    ok = F.when(F.col("op") == ">=", a >= t).when(F.col("op") == "<=", a <= t).otherwise(a == t)
    return j.select(*keys, "criterion", "actual", "threshold", "weight", F.coalesce(ok, F.lit(False)).alias("passed"))


def certification_score(results, keys=()):
    """Doubled weighted share of passed criteria, capped at 100."""
    w = F.when(F.col("passed"), F.col("weight").cast("decimal(4,2)")).otherwise(F.lit(0).cast("decimal(4,2)"))
    blocked = F.max(F.when(F.col("criterion").startswith("alignment_") & ~F.col("passed"), 1).otherwise(0)) == 1
    out = results.groupBy(*keys).agg(
        F.round(F.least(F.sum(w).cast("double") * 200, F.lit(100.0)), 1).alias("score"),
        F.count_if("passed").alias("criteria_passed"), F.count("*").alias("criteria_total"), blocked.alias("blocked"))
    return out.withColumn("certified", (F.col("score") >= PASSING_SCORE) & ~F.col("blocked"))


def _bands(c, bands):
    out = None
    for floor, points in bands:
        out = F.when(c >= floor, points) if out is None else out.when(c >= floor, points)
    return out.otherwise(0)


def readiness(df):
    """Banded readiness points over match rate, reliability, benchmark and valid share; ready from 70."""
    score = (_bands(F.col("match_rate"), [(95, 30), (85, 25), (70, 20), (50, 10)])
             + _bands(F.col("stress_rate"), [(95, 20), (90, 15), (80, 10)]) + F.when(F.col("thread_safe"), 5).otherwise(0)
             + F.when(F.col("bench_success") >= 95, 10).otherwise(0)
             + _bands(F.col("valid_count") * 100.0 / F.greatest(F.col("valid_count") + F.col("invalid_count"), F.lit(1)),
                      [(90, 25), (75, 20), (50, 10)]) + 10)
    recs = F.array_compact(F.array(
        F.when(F.col("match_rate") < 90, "improve_parser"), F.when(F.col("stress_rate") < 95, "concurrency"),
        F.when(~F.col("thread_safe"), "thread_safety"), F.when(F.col("memory_mb") > 100, "memory"),
        F.when(F.col("invalid_count") > 0, "review_invalid")))
    d = df.withColumns({"readiness": F.least(score.cast("double"), F.lit(100.0)),
                        "recomendaciones": F.when(F.size(recs) > 0, recs).otherwise(names_array(["ok"]))})
    return d.withColumn("listo", F.col("readiness") >= 70)


# ---- explanations ----

def explain(df):
    """Factors, reason and recommendations of a validated notice."""
    n_issues, failed = F.col("inconsistencias"), F.size("reglas_fallidas")
    reason = F.concat_ws(
        "; ", F.concat(F.lit("Decision: "), F.col("decision")), F.concat(F.lit("Score: "), F.format_number("score", 2)),
        F.when(F.col("cabecera_valida"), "Valid header detected").otherwise("Invalid or missing header"),
        F.when(n_issues > 0, F.concat(n_issues.cast("string"), F.lit(" inconsistency(ies) found"))),
        F.when(failed > 0, F.concat(failed.cast("string"), F.lit(" rule(s) failed"))))
    factors = F.concat(
        F.array(F.concat(F.lit("header_detection:"), F.col("cabecera_valida").cast("string"))),
        F.transform("reglas_aplicadas", lambda r: F.concat(r, F.lit(":true"))),
        F.when(n_issues > 0, F.array_repeat(F.lit("consistency_check:false"), n_issues.cast("int"))).otherwise(
            F.array().cast("array<string>")),
        F.when(F.col("nivel_duplicado") != "UNIQUE", F.array(F.lit("duplicate_detection:false"))).otherwise(F.array().cast("array<string>")))
    recs = F.array_compact(F.array(F.when(~F.col("cabecera_valida"), "header"), F.when(F.col("nivel_duplicado") != "UNIQUE", "duplicate")))
    return df.withColumns({"razon": reason, "factores": factors, "recomendaciones": recs})


# fixed values: stored names of extracted fields
STORED = {"expediente": "expediente", "finca": "finca_matr", "precio_base": "base", "fecha_remate": "fecha",
          "demandante": "demandante", "demandado": "demandado", "fianza_porcentaje": "fianza_porcentaje",
          "minimo_porcentaje": "minimo_porcentaje", "lugar": "lugar", "proceso": "proceso", "provincia": "provincia",
          "categoria": "categoria"}
RULE_ID = r"rule:(?:regex|alias|format|contextual):([a-f0-9]{12}):v(\d+)"


def provenance(fields):
    """One row per found field with its stored name and, for rule hits, the rule id and version."""
    names = F.create_map(*[F.lit(x) for kv in STORED.items() for x in kv])
    by_rule = F.col("source") == "knowledge"
    return fields.filter(F.col("value").isNotNull() & F.col("field").isin(list(STORED))).select(
        "document_id", F.element_at(names, F.col("field")).alias("campo"), "value", "source", "confidence",
        F.when(by_rule, F.nullif(F.regexp_extract("method", RULE_ID, 1), F.lit(""))).alias("rule_id"),
        F.when(by_rule, F.nullif(F.regexp_extract("method", RULE_ID, 2), F.lit("")).cast("int")).alias("rule_version"))
