"""Learning from corrections: suggestions, rule candidates, rule application, aliases, lifecycle of rules."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gavelwork.functions import lookups as lk
from gavelwork.functions.text import key_alnum, strip_all
from gavelwork.operators.quality import top_k, union


def _suggestion(df, tipo, value, ref, count, conf, alternatives=None):
    return df.select(
        F.lit(tipo).alias("tipo"), "campo", "pais", value.alias("valor_sugerido"), ref.alias("valor_referencia"), count.cast("bigint").alias("n"),
        conf.alias("confianza"), (alternatives if alternatives is not None else F.lit(None).cast("string")).alias("alternativas"))


def suggestions(df, k=None):
    """Repeated corrections, spelling aliases, labels outside the vocabulary and fields often empty; Panama first.

    Confidence weighs a group against all corrections; values are grouped before anything is ranked. A group shows its smallest spelling.
    """
    total = df.agg(F.count("*").cast("double")).scalar()
    none = F.lit(None).cast("string")
    d = df.withColumns({"new_n": key_alnum(F.col("valor_nuevo")), "old_n": key_alnum(F.col("valor_anterior"))})
    usable = d.filter(F.col("campo").isin(lk.SUGGESTION_FIELDS))
    n = F.col("n")
    pairs = usable.groupBy("campo", "pais", "old_n", "new_n").agg(F.count("*").alias("n"), F.min("valor_nuevo").alias("v"), F.min("valor_anterior").alias("o")).filter("n >= 2")
    repeated = _suggestion(pairs, "correccion_repetida", F.col("v"), F.col("o"), n, F.least(F.lit(0.99), F.lit(0.5) + n / total * 5))
    spelled = usable.filter("new_n <> ''").groupBy("campo", "pais", "new_n", F.trim("valor_nuevo").alias("forma")).agg(F.count("*").alias("c"))
    forms = spelled.groupBy("campo", "pais", "new_n").agg(F.sum("c").alias("n"), F.count("*").alias("formas"), F.min_by("forma", F.struct(F.length("forma"), "forma")).alias("v"),
                                                         F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.length("forma").alias("l"), "forma"))), lambda x: x["forma"]), "|").alias("alt"))
    alias = _suggestion(forms.filter("formas >= 2 AND n >= 2"), "alias", F.col("v"), none, n, F.least(F.lit(0.95), F.lit(0.6) + n / total), F.col("alt"))
    val = strip_all(F.col("valor_nuevo"))
    cat = (F.col("campo") == "categoria") & ~F.upper(val).isin(list(lk.CATEGORY_CODES))
    pa, co = ([k.replace(" ", "").replace(".", "") for k in t] for t in (lk.PA_PROVINCE_CODES, lk.CO_DEPARTMENT_CODES))
    prov = (F.col("campo") == "provincia") & (((F.col("pais") == 1) & ~F.col("new_n").isin(pa)) | ((F.col("pais") == 2) & ~F.col("new_n").isin(co)))
    new = d.filter((val != "") & (cat | prov)).select("campo", "pais", val.alias("v")).distinct()
    label = _suggestion(new, "etiqueta_nueva", F.col("v"), none, F.lit(1), F.lit(0.5))
    empty = usable.filter("era_vacio").groupBy("campo").agg(F.count("*").alias("n")).filter("n >= 2").withColumn("pais", F.lit(None).cast("int"))
    vacio = _suggestion(empty, "campo_vacio_frecuente", none, none, n, F.least(F.lit(0.9), F.lit(0.4) + n / total))
    every = union([repeated, alias, label, vacio])
    best = top_k(every, ["tipo", "campo", "pais", "valor_sugerido"], [F.col("confianza").desc(), "n", "valor_referencia"], 1)
    order = [F.when(F.col("pais") == 1, 0).otherwise(1), F.col("confianza").desc(), "tipo", "campo", "pais", "valor_sugerido"]
    return best.orderBy(*order).limit(k) if k else best


MONEY_CONTEXT = r"B/?\.|\$|USD|BALBOAS|PESOS|DÓLARES|BASE|VALOR|PRECIO|AVALÚO|AVALUO"


def correction_category(value, field, evidence):
    """MONEY, DATE, CASE_NUMBER, PROPERTY, PERSON or LABEL."""
    v, e = F.upper(strip_all(value)), F.upper(strip_all(evidence))
    numeric = value.rlike(r"\d") & ~value.rlike("[A-ZÁÉ]")
    return (F.when(field.isin("precio_base", "base"), "MONEY").when(field == "fecha_remate", "DATE")
            .when(numeric & F.contains(value, F.lit("-")), "CASE_NUMBER").when(numeric, "PROPERTY")
            .when(v.rlike(r"[\d,\.]+") & e.rlike(MONEY_CONTEXT), "MONEY").when(e.rlike(r"\d{1,2}\s+DE\s+[A-ZÁÉÍÓÚÑ]+\s+DE\s*\d{2,4}"), "DATE")
            .when(e.rlike("DEMANDANTE|DEMANDADO|DEUDOR|ACREEDOR") & v.rlike("[A-ZÁÉÍÓÚÑ]{3,}"), "PERSON").otherwise("LABEL"))


def common_prefix(low, high):
    """Longest common prefix of a group = common prefix of its smallest and largest value."""
    n = F.least(F.length(low), F.length(high))
    same = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(low, i, F.lit(1)) == F.substr(high, i, F.lit(1)))
    first = F.array_position(same, F.lit(False))
    return F.left(low, F.when(n == 0, 0).when(first == 0, n).otherwise(first - 1).cast("int"))


# fixed values: pattern of each category
CATEGORY_PATTERN = {"MONEY": r"([\$B/\.\s]*[\d\.,]+(?:\s*(?:B/?\.|USD|dólares|pesos))?)", "DATE": r"(\d{1,2}\s+DE\s+[A-ZÁÉÍÓÚÑ]+\s+DE\s*\d{2,4})",
                    "CASE_NUMBER": r"([\d\-]+)", "PROPERTY": r"([\d\-]+)"}


def escape_regex(c):
    return F.regexp_replace(c, r"([^A-Za-z0-9_])", r"\\$1")


def rule_candidates(df):
    """One pending rule per field with two corrections or more: majority category, its pattern or the common prefix."""
    d = df.filter("valor_nuevo <> ''").withColumn("cat", correction_category(F.col("valor_nuevo"), F.col("campo"), F.col("contexto")))
    counts = d.groupBy("campo", "cat").agg(F.count("*").alias("n"), F.min(F.upper(strip_all(F.col("valor_nuevo")))).alias("lo"),
                                           F.max(F.upper(strip_all(F.col("valor_nuevo")))).alias("hi"), F.sum(F.col("confidence").cast("decimal(6,4)")).alias("s"))
    g = counts.groupBy("campo").agg(F.max_by("cat", F.struct("n", "cat")).alias("category"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
                                    F.sum("s").alias("s")).filter("n >= 2")
    table = F.create_map(*[F.lit(x) for kv in CATEGORY_PATTERN.items() for x in kv])
    prefix = common_prefix(F.col("lo"), F.col("hi"))
    from_prefix = F.when(F.length(prefix) >= 3, F.when(F.col("lo") == F.col("hi"), escape_regex(prefix)).otherwise(F.concat(escape_regex(prefix), F.lit(r"(.+?)(?:$|\s)"))))
    out = g.select("campo", "category", "n", F.coalesce(F.try_element_at(table, F.col("category")), from_prefix).alias("pattern"),
                   F.round(F.col("s").cast("double") / F.col("n") * 0.9 + 1e-9, 4).alias("confidence"))
    return out.filter("pattern IS NOT NULL")


def evidence_sample(df, k=5):
    """First k corrections of each field as evidence of its rule."""
    return top_k(df.select("campo", "id", "contexto"), ["campo"], ["id"], k)


SALTS = 16
FEW = 200
# what a pattern may do without, or match in several ways, in the order of removal
ESCAPES = r"\\(?:0[0-7]*|x\{[^}]*\}|x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|c.|[pP]\{[^}]*\}|k<[^>]*>|.)"
CLASSES = r"\[\^?\]?[^\]]*\]"
OPTIONAL = r"(?:[?*]|\{[^}]*\})"


def required_literal(pattern):
    """The longest run of three ASCII letters or digits or more that every match of a pattern holds, in lower case; empty if there is none.

    Escapes, classes, optional parts and what is repeated count as unknown; patterns with alternatives or special groups have no literal.
    """
    p = F.regexp_replace(F.regexp_replace(pattern, ESCAPES, " "), CLASSES, " ")
    p = F.regexp_replace(p, r"\(\?:", "(")
    none = p.contains("|") | p.contains("(?")
    for _ in range(4):
        p = F.regexp_replace(F.regexp_replace(p, r"\([^()]*\)" + OPTIONAL, " "), r"\(([^()]*)\)", " $1 ")
    none = none | p.rlike(r"[()\[\]]")
    p = F.regexp_replace(F.regexp_replace(p, "." + OPTIONAL, " "), r"[+]", " ")
    runs = F.regexp_extract_all(p, F.lit("([A-Za-z0-9]{3,})"), 1)
    longest = F.get(F.array_sort(runs, lambda x, y: F.length(y) - F.length(x)), 0)
    return F.when(none, "").otherwise(F.coalesce(F.lower(longest), F.lit("")))


def _over_trigrams(t, ok):
    """Texts with the rules of which they hold the first three letters of the literal."""
    ok = ok.withColumns({"tri": F.substring("literal", 1, 3), "salt": F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))})
    asked = ok.select("tri").distinct()
    at = t.withColumn("i", F.explode(F.sequence(F.lit(0), F.greatest(F.length("low") - 2, F.lit(0)))))
    at = at.withColumn("tri", F.when(F.col("i") == 0, "").otherwise(F.substring("low", F.col("i"), F.lit(3)))).join(F.broadcast(asked), "tri")
    first = at.filter("i = 0 OR instr(low, tri) = i")
    return first.withColumn("salt", F.pmod(F.xxhash64("document_id"), F.lit(SALTS)).cast("int")).join(ok, ["tri", "salt"])


def apply_rules(texts, rules):
    """First approved rule of each field, newest first, whose pattern matches the text; value = group 1 or the match, confidence x 0.9.

    ``texts`` holds document_id and text, and field_name where a text is meant for one field only. A rule is indexed by three letters of a
    literal that its pattern cannot match without; texts give their runs of three letters that any rule asks for (fewer than 50,000 there
    can be, so these are broadcast) and meet rules over them, split by a hash of the document. Only where the whole literal is in the text the
    pattern is tried. Rules without a literal meet every text. Up to ``FEW`` rules for texts of any field are broadcast whole: each text
    meets every literal where it is, and no text is copied or exchanged.
    """
    ok = rules.filter("status = 'approved'").select("field_name", "rule_id", "pattern", "confidence", "created_at").withColumn("literal", required_literal(F.col("pattern")))
    own = "field_name" in texts.columns
    t = texts.select("document_id", "text", F.lower(F.upper("text")).alias("low"), *([F.col("field_name").alias("own")] if own else []))
    if not own and ok.limit(FEW + 1).count() <= FEW:
        j = t.crossJoin(F.broadcast(ok))
    else:
        j = _over_trigrams(t, ok)
    j = j.filter(F.col("low").contains(F.col("literal")) & (F.col("own") == F.col("field_name") if own else F.lit(True)))
    hit = j.withColumn("_p", F.concat(F.lit("(?ium)"), F.col("pattern"))).filter(F.rlike("text", F.col("_p")))
    group = F.regexp_like(F.col("pattern"), F.lit(r"(?<!\\)\((?!\?)"))
    value = F.when(group, F.expr("regexp_extract(text, _p, 1)")).otherwise(F.expr("regexp_extract(text, _p, 0)"))
    best = hit.withColumn("value", strip_all(value)).groupBy("document_id", "field_name").agg(F.max_by(
        F.struct("value", "rule_id", "confidence"), F.struct("created_at", -F.col("rule_id"))).alias("b"))
    return best.select("document_id", "field_name", F.col("b.value").alias("value"), F.col("b.rule_id").alias("rule_id"), F.round(F.col("b.confidence") * 0.9, 4).alias("confidence"))


def fill_with_rules(parser, rule_results):
    """Parser value where there is one, else the rule value."""
    r = rule_results.select("document_id", "field_name", F.col("value").alias("rv"), F.col("confidence").alias("rc"))
    j = parser.join(r, ["document_id", "field_name"], "left")
    return j.select("document_id", "field_name", F.coalesce("value", "rv").alias("value"),
                    F.when(F.col("value").isNotNull(), "parser").when(F.col("rv").isNotNull(), "knowledge").alias("source"))


def regression_guard(golden, parser, rule_results):
    """Precision per rule field with and without rules; a field whose precision drops is rejected."""
    keys = ["document_id", "field_name"]
    j = golden.join(parser.select(*keys, F.col("value").alias("pv")), keys, "left").join(rule_results.select(*keys, F.col("value").alias("rv")), keys, "left")
    final = F.coalesce("rv", "pv")

    def count(cond):
        return F.count_if(F.coalesce(cond, F.lit(False)))

    g = j.groupBy("field_name").agg(count(F.col("pv").isNotNull()).alias("total_before"), count(F.col("pv") == F.col("expected")).alias("correct_before"),
                                    count(final.isNotNull()).alias("total_after"), count(final == F.col("expected")).alias("correct_after"))
    before = F.col("correct_before") / F.greatest(F.col("total_before"), F.lit(1))
    after = F.col("correct_after") / F.greatest(F.col("total_after"), F.lit(1))
    return g.withColumns({"precision_before": F.round(before, 4), "precision_after": F.round(after, 4), "regression": after < before,
                          "decision": F.when(after < before, "REJECTED").otherwise("APPROVED")})


def rule_lifecycle(rules):
    """Automatic transitions: approval of confident pending rules with evidence, expiry of approved rules that fail too often."""
    acc = F.coalesce(F.try_divide("success_count", "usage_count"), F.lit(0.0))
    nxt = (F.when((F.col("status") == "pending") & (F.col("confidence") >= 0.7) & (F.col("evidence") >= 1), "approved")
           .when((F.col("status") == "approved") & (F.col("usage_count") >= 5) & (acc < 0.7), "inactive").otherwise(F.col("status")))
    d = rules.withColumns({"nuevo_estado": nxt, "accuracy": F.round(acc, 4)})
    history = d.filter("nuevo_estado <> status").select(
        "rule_id", F.col("status").alias("previous_status"), F.col("nuevo_estado").alias("new_status"), F.col("accuracy").alias("accuracy_before"),
        F.when(F.col("nuevo_estado") == "approved", F.col("accuracy")).otherwise(0.0).alias("accuracy_after"),
        F.when(F.col("nuevo_estado") == "approved", "Approved by auto").otherwise("Auto-expired").alias("reason"))
    return d, history


def rollback(rules, ids):
    """Named rules back to pending, with their history rows."""
    hit = F.col("rule_id").isin(ids)
    history = rules.filter(hit).select("rule_id", F.col("status").alias("previous_status"), F.lit("pending").alias("new_status"), F.lit("Manual rollback to PENDING").alias("reason"))
    return rules.withColumn("status", F.when(hit, "pending").otherwise(F.col("status"))), history


# fixed values: built-in abbreviations, applied in this order
BUILTIN_ALIASES = {"N°": "NUMERO", "NRO": "NUMERO", "NO.": "NUMERO", "B/.": "BALBOAS", "B/": "BALBOAS", "C/": "CALLE", "AV/": "AVENIDA", "AV": "AVENIDA",
                   "LTDA": "LIMITADA", "SA": "S.A.", "S.A": "S.A.", "D/S": "DEMANDANTE", "DDO": "DEMANDADO", "EXP": "EXPEDIENTE", "EXPE": "EXPEDIENTE"}


def resolve_aliases(terms, aliases):
    """Target of each (term, field): built-in, else approved, else pending; more confident first."""
    built = F.create_map(*[F.lit(x) for kv in BUILTIN_ALIASES.items() for x in kv])
    t = terms.withColumn("source", F.upper(strip_all(F.col("term"))))
    ranked = aliases.filter(F.col("status").isin("APPROVED", "PENDING")).groupBy("source", "field_name").agg(F.max_by("target", F.struct(
        (F.col("status") == "APPROVED").alias("a"), F.col("is_builtin"), "confidence", "target")).alias("target"))
    j = t.join(ranked, ["source", "field_name"], "left")
    return j.withColumn("resuelto", F.coalesce(F.try_element_at(built, F.col("source")), F.col("target"), F.col("term"))).drop("target", "source")


def learn_aliases(df):
    """New aliases from corrections: two characters or more, not built in, different from their target; 0.8 approves."""
    s, t = F.upper(strip_all(F.col("valor_anterior"))), F.upper(strip_all(F.col("valor_nuevo")))
    ok = df.filter((s != t) & (F.length(s) >= 2) & ~s.isin(list(BUILTIN_ALIASES)))
    return ok.groupBy(s.alias("source"), t.alias("target"), F.col("campo").alias("field_name")).agg(F.count("*").alias("n"), F.max("confidence").alias("confidence")).withColumn(
        "status", F.when(F.col("confidence") >= 0.8, "APPROVED").otherwise("PENDING"))


def normalize_with_aliases(df, aliases, text="text"):
    """Built-in then learned aliases of the field replaced in the text, one after the other; approved ones before pending ones."""
    quoted = F.concat(F.lit(r"(?iu)\Q"), F.col("source"), F.lit(r"\E"))
    order = [F.when(F.col("status") == "APPROVED", 0).otherwise(1).alias("o"), (-F.col("confidence")).alias("c"), F.col("source").alias("s")]
    learned = aliases.groupBy("field_name").agg(F.array_sort(F.collect_list(F.struct(*order, quoted.alias("p"), F.regexp_replace("target", r"\$", r"\\\$").alias("t")))).alias("_as"))
    out = F.col(text)
    for src, tgt in BUILTIN_ALIASES.items():
        out = F.regexp_replace(out, rf"(?iu)\Q{src}\E", tgt)
    d = df.withColumn("_t", out).join(learned, "field_name", "left")
    done = F.aggregate(F.coalesce("_as", F.array().cast(learned.schema["_as"].dataType)), F.col("_t"), lambda acc, a: F.regexp_replace(acc, a["p"], a["t"]))
    return d.withColumn("normalizado", done).drop("_t", "_as")


KEYWORD = r"[A-ZÁÉÍÓÚÑa-záéíóúñ]{4,}"


def keywords(text):
    return F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(f"({KEYWORD})"), 1))


def apply_learning(notices, corrections, fields, threshold=0.15, per_notice=5):
    """Empty fields filled from the correction with the most similar context: Jaccard of words >= 0.15, newest on ties, five fields at most.

    All corrections are candidates. Of equal word sets only the newest can win, so the others are dropped first, and equal word sets of
    notices are matched once. Sets meet in a join on (country, field, word); a set of n words needs only its n - ceil(threshold x n) + 1
    rarest ones there, whose overlap no similar pair can do without.
    """
    cand = corrections.filter((F.trim("valor_nuevo") != "") & (F.col("contexto") != "")).select(
        "pais", "campo", "id", "valor_nuevo", "creado_en", F.array_sort(keywords(F.col("contexto"))).alias("ckw"))
    newest = F.max_by(F.struct("creado_en", "id", "valor_nuevo"), F.struct("creado_en", "id"))
    cand = cand.groupBy("pais", "campo", "ckw").agg(newest.alias("r")).select("pais", "campo", "ckw", "r.*")
    n = notices.filter(F.length(F.trim("text")) >= 30).withColumn("kw", F.array_sort(keywords(F.col("text"))))
    empties = F.array_compact(F.array(*[F.when(F.nullif(F.col(f).cast("string"), F.lit("")).isNull(), F.struct(F.lit(i).alias("orden"), F.lit(f).alias("campo")))
                                        for i, f in enumerate(fields)]))
    long = n.select(F.col("id").alias("aviso_id"), "pais", "kw", F.explode(empties).alias("e")).select("aviso_id", "pais", "kw", "e.orden", "e.campo")
    sets = long.select("pais", "campo", "kw").distinct()
    often = cand.select("pais", "campo", F.explode("ckw").alias("w")).groupBy("pais", "campo", "w").agg(F.count("*").alias("df"))

    def rarest(df, kw, keys):
        words = df.select(*keys, kw, F.explode(kw).alias("w")).join(often, ["pais", "campo", "w"])
        ranked = words.groupBy(*keys, kw).agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("ws"))
        most = (F.size(kw) - F.ceil(F.lit(threshold) * F.size(kw)) + 1).cast("int")
        return ranked.select(*keys, kw, F.explode(F.slice("ws", F.lit(1), F.greatest(most, F.lit(1)))).alias("x")).select(*keys, kw, "x.w")

    left = rarest(sets, "kw", ["pais", "campo"])
    right = rarest(cand, "ckw", ["pais", "campo", "id", "valor_nuevo", "creado_en"])
    pairs = left.join(right, ["pais", "campo", "w"]).groupBy("pais", "campo", "kw", "id").agg(F.first(F.struct("ckw", "creado_en", "valor_nuevo")).alias("c"))
    inter = F.size(F.array_intersect("kw", "c.ckw"))
    sim = (inter / (F.size("kw") + F.size("c.ckw") - inter)).alias("sim")
    scored = pairs.select("pais", "campo", "kw", F.struct(sim, F.col("c.creado_en").alias("creado_en"), "id", F.col("c.valor_nuevo").alias("valor")).alias("b"))
    best = scored.groupBy("pais", "campo", "kw").agg(F.max("b").alias("best")).filter(F.col("best.sim") >= threshold)
    ranked = long.join(best, ["pais", "campo", "kw"]).withColumn("rn", F.row_number().over(W.partitionBy("aviso_id").orderBy("orden")))
    return ranked.filter(F.col("rn") <= per_notice).select("aviso_id", "campo", F.col("best.valor").alias("valor"), F.col("best.id").alias("correccion_id"),
                                                          F.round("best.sim", 4).alias("similitud"))
