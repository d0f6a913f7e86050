"""Notice extraction: both generations for Panama, both layouts for Colombia, rendering and splitting."""

from pyspark.sql import functions as F

from gavelwork.functions import dates, lookups as lk, money, patterns
from gavelwork.functions.text import collapse, digits, found, join_hyphen_breaks, let, strip_all

I = "(?iuU)"


# ---- rendering ----

def thousands(c):
    return F.format_number(c, 2)


def spanish_date(c):
    months = ["ENERO", "FEBRERO", "MARZO", "ABRIL", "MAYO", "JUNIO", "JULIO", "AGOSTO", "SEPTIEMBRE", "OCTUBRE",
              "NOVIEMBRE", "DICIEMBRE"]
    return F.concat(F.dayofmonth(c), F.lit(" DE "), F.element_at(F.array(*[F.lit(m) for m in months]), F.month(c)),
                    F.lit(" DE "), F.year(c))


def render_record(df):
    """Label: value lines of the filled fields, the layout used for round-trip checks."""
    labels = [("EXPEDIENTE", "expediente"), ("DEMANDANTE", "demandante"), ("DEMANDADO", "demandado"),
              ("FINCA", "finca_matr"), ("MATRICULA INMOBILIARIA", "finca_matr")]
    tail = [("FECHA", "fecha"), ("LUGAR", "lugar"), ("PROCESO", "proceso"), ("PROVINCIA", "provincia"),
            ("CATEGORIA", "categoria"), ("DESCRIPCION", "descripcion")]

    def line(label, value):
        return F.concat(F.lit(f"{label}: "), value)

    base = F.nullif(F.col("base"), F.lit(0).cast("decimal(18,2)"))
    lines = [line(k, F.col(c).cast("string")) for k, c in labels]
    lines += [line("BASE", base.cast("string")), line("PRECIO BASE", F.concat(F.lit("$"), thousands(base))),
              F.concat(line("FIANZA", F.col("fianza_porcentaje").cast("string")), F.lit("%")),
              F.concat(line("MINIMO", F.col("minimo_porcentaje").cast("string")), F.lit("%"))]
    lines += [line(k, F.col(c).cast("string")) for k, c in tail]
    return F.concat_ws("\n", F.lit("AVISO DE REMATE"), *lines)


# ---- Panama, second generation ----

def category_of(match, text):
    """Category of a matched word in its text, by keyword order."""
    up = F.upper(F.concat(F.lit(" "), match, F.lit(" "), text))
    out = F.when(F.contains(up, F.lit("CUOTA")) & F.contains(up, F.lit("PARTE")), "MISCELANEO")
    for word, cat in (("APARTAMENTO", "APARTAMENTO"), ("APTO", "APARTAMENTO"), ("VEHICULO", "VEHICULO"),
                      ("VEHÍCULO", "VEHICULO"), ("CARRO", "VEHICULO"), ("MOTOCICLETA", "VEHICULO"), ("CASA", "CASA"),
                      ("VIVIENDA", "CASA"), ("RESIDENCIA", "CASA"), ("QUINTA", "CASA"), ("LOCAL", "MISCELANEO"),
                      ("COMERCIO", "MISCELANEO"), ("OFICINA", "MISCELANEO")):
        out = out.when(F.contains(up, F.lit(f" {word} ")), cat)
    return F.when(match.isNotNull(), out.otherwise("TERRENO"))


def process_of(match):
    up = F.upper(match)

    def has(w):
        return F.contains(up, F.lit(w))

    return (F.when(has("INSOLVENCIA"), "INSOLVENCIA").when(has("MONITARIO") | has("MONITORIO"), "MONITARIO")
            .when(has("EJECUTIVO") & has("HIPOTECARIO"), "EJECUTIVO HIPOTECARIO").when(has("EJECUTIVO"), "EJECUTIVO")
            .when(has("SUMARIO"), "SUMARIO").otherwise(F.initcap(up)))


def panama_v2(df, text="text"):
    out = patterns.extract_fields(df, "PA", text=text)
    return out.withColumns({"categoria": category_of(F.col("categoria"), F.col(text)), "proceso": process_of(F.col("proceso"))})


def colombia_v2(df, text="text"):
    """Colombia labels; percentages come out as numbers, number words included."""
    out = patterns.extract_fields(df, "CO", text=text)

    def pct(c):
        return F.coalesce(money.words_to_number(c), money.parse_percent(c))

    return out.withColumns({c: pct(F.col(c)) for c in ("fianza_porcentaje", "minimo_porcentaje")})


# ---- Panama, first generation ----

def deposit_percent(text, legal=(10, 20, 25, 40)):
    """First legal deposit percentage: next to FIANZA, then in words, then any percentage."""
    near = found(I + r"FIANZA[^\d]{0,50}?(\d{1,2})\s*%", text)
    word = r"\b(diez|veinte|veinticinco|cuarenta)\s+por\s+ciento"
    in_words = F.get(F.filter(F.regexp_extract_all(text, F.lit(I + word + r"\s*\(\s*(\d{1,2})\s*%"), 2),
                              lambda x: x.cast("int").isin(*legal)), F.lit(0))
    names = F.create_map(*[F.lit(x) for kv in {"diez": 10.0, "veinte": 20.0, "veinticinco": 25.0, "cuarenta": 40.0}.items() for x in kv])
    any_pct = F.get(F.filter(F.regexp_extract_all(text, F.lit(r"(\d{1,2})\s*%"), 1), lambda x: x.cast("int").isin(*legal)), F.lit(0))
    return F.coalesce(F.when(near.cast("int").isin(*legal), near.cast("double")), in_words.cast("double"),
                      F.try_element_at(names, F.lower(found(I + word, text))), any_pct.cast("double"))


def minimum_percent(text, spaced=False):
    """Two thirds, half or whole; half is tested before whole."""
    up = F.upper(text)
    gap = r"\s*" if spaced else ""
    near = found(I + r"(?:POSTURA\s+MINIMA|MINIMO)[^\d]{0,60}?(\d{1,3}(?:\.\d{1,2})?)\s*%", text)
    return (F.when(F.contains(text, F.lit("2/3")) | F.contains(up, F.lit("DOS TERCERAS")), 66.67)
            .when(F.contains(up, F.lit("LA MITAD")) | text.rlike(f"50{gap}%"), 50.0)
            .when(F.contains(up, F.lit("TOTALIDAD")) | text.rlike(f"100{gap}%"), 100.0)
            .otherwise(near.cast("double")))


def clean_party(c):
    s = strip_all(F.regexp_replace(strip_all(collapse(c)), r"[,.]+$", ""))
    return let(s, lambda x: F.when((F.length(x) >= 3) & (x == F.upper(x)) & ~x.rlike("|".join(patterns.PARTY_NOISE)), x))


def parties(text):
    cls = r"([A-ZÑÁÉÍÓÚ0-9.,& ]{3,80}?)"
    plaintiff = F.coalesce(*[clean_party(found(I + p, text)) for p in (
        r"(?:PROMOVIDO|INSTAURADO|PROPUESTO)\s+POR\s+" + cls + r"(?:,|EN\s+CONTRA|\n|\.\s)",
        r"POR\s+" + cls + r"(?:,|EN\s+CONTRA|\n)")])
    defendant = F.coalesce(*[clean_party(found(I + p, text)) for p in (
        r"EN\s+CONTRA\s+DE\s+" + cls + r"(?:,|\n|\.\s|POR\s+EL|$)",
        r"(?:CONTRA|EN\s+CONTRA\s+DE)\s+" + cls + r"(?:,|\n|\.\s|$)")])
    return plaintiff, defendant


def category_v1(text):
    up = F.upper(text)
    out = F.when(F.contains(up, F.lit("CUOTA PARTE")), "MISCELANEO")
    for w, cat in (("APARTAMENTO", "APARTAMENTO"), ("APTO", "APARTAMENTO"), ("VEHICULO", "VEHICULO"), ("CARRO", "VEHICULO"),
                   ("MOTO", "VEHICULO"), ("CAMION", "VEHICULO"), ("CASA", "CASA"), ("VIVIENDA", "CASA"),
                   ("RESIDENCIA", "CASA"), ("QUINTA", "CASA")):
        out = out.when(F.contains(up, F.lit(w)), cat)
    return out.otherwise("TERRENO")


def longest_name_in(text, names):
    """Longest listed name contained in the text."""
    up = F.upper(text)
    return F.coalesce(*[F.when(F.contains(up, F.lit(n)), F.lit(n)) for n in sorted(names, key=len, reverse=True)])


HEADER = r"AVISO\s+DE\s+[A-Z]{0,2}E[MN]ATE"


def docket_v1(body, before):
    exp = F.coalesce(
        found(I + r"(?:EXP|EXPEDIENTE)\s*\.?\s*ELECTR\.?\s*(\d{4,9})", body),
        found(I + r"(?:E|EXP|EXPEDIENTE)\s*[-.]?\s*[Nn]?[Oo]?\.?\s*(\d{3,7}[-/]\d{2})", body),
        found(I + r"(?:EXP|EXPEDIENTE)\s*[-.]?\s*[Nn]?[Oo]?\.?\s*(\d{4,9})", body),
        found(I + r"NEGOCIO\s+N[°º]?\.?\s*(\d{3,7}[-/]\d{2})", before),
        found(I + r"(?:E|EXP)\s*[-.]?\s*(\d{3,7}[-/]\d{2})", before))
    return F.replace(exp, F.lit("/"), F.lit("-"))


def panama_v1(df, text="text", country="PA"):
    """About twenty fields of one Panama notice; ``confianza`` is 0.9 for each field found."""
    t = F.col("_t")
    d = df.withColumn("_t", join_hyphen_breaks(F.col(text)))
    d = d.withColumn("_p", F.regexp_instr(t, F.lit(HEADER)))
    start = F.greatest(F.col("_p"), F.lit(1))
    lead = F.greatest(start - 150, F.lit(1))
    d = d.withColumns({"_body": F.substr(t, start), "_before": F.substr(t, lead, start - lead)})
    body, before = F.col("_body"), F.col("_before")
    plaintiff, defendant = parties(t)
    lot = F.coalesce(found(I + r"LOTE\s+([A-ZÑÁÉÍÓÚ0-9-]{1,12})", t), found(I + r"CASA\s+(?:LOTE\s+)?([A-ZÑÁÉÍÓÚ0-9-]{1,12})", t))
    place = found(I + r"C[OÓ]DIGO\s+DE\s+UBICACI[OÓ]N\s*:?\s*([A-ZÑÁÉÍÓÚ0-9]{1,6})(?:[,;)\s]|$)", t)
    names = lk.PA_PROVINCE_CODES if country == "PA" else lk.CO_DEPARTMENT_CODES
    d = d.withColumns({
        "expediente": docket_v1(body, before),
        "lugar": collapse(found(I + r"(JUZGADO\s+[A-ZÑÁÉÍÓÚ]+\s+DE\s+CIRCUITO\s+DE\s+INSOLVENCIA"
                                r"(?:\s+DEL\s+[A-ZÑÁÉÍÓÚ]+(?:\s+[A-ZÑÁÉÍÓÚ]+){0,3})?)", t)),
        "demandante": plaintiff, "demandado": defendant,
        "finca_matr": F.coalesce(found(I + r"FINCA\s*:?\s*(\d{5,9})", t), found(I + r"FOLIO\s+REAL\s*:?\s*(\d{5,9})", t),
                                 found(I + r"FOLIO\s+REAL\s*:?\s*([\d-]{5,15})", t)),
        "lote_casa": F.when(~F.upper(lot).isin("NUMERO", "NRO", "NO", "COLOR", "CASA", "N"), lot),
        "plano": found(I + r"PLANO\s*:?\s*([0-9-]{5,15})", t),
        "superficie": found(I + r"([\d.,]{3,10})\s*(?:M2|MTS2|METROS\s+CUADRADOS|MTRS2|MTS\.?\s*2)", t),
        "codigo_ubicacion_prensa": F.when(place.rlike(r"\d"), place),
        "categoria": category_v1(t), "provincia": longest_name_in(t, names),
        "fecha": dates.auction_date(t), "hora": dates.time_12h(t),
        "fianza_porcentaje": deposit_percent(t), "minimo_porcentaje": minimum_percent(t),
        "proceso": F.when(F.contains(F.upper(t), F.lit("CUOTAS PARTES")), "VENTA DE CUOTAS PARTES").otherwise("AVISO DE REMATE"),
    })
    d = d.withColumn("base", base_after_docket(t, F.col("expediente")))
    d = d.withColumn("descripcion", F.concat_ws(", ", "categoria", F.concat(F.lit("lote "), F.col("lote_casa")),
                                                F.concat(F.col("superficie"), F.lit(" m2")), "provincia"))
    return d.drop("_t", "_p", "_body", "_before")


V1_FIELDS = ["expediente", "lugar", "demandante", "demandado", "lote_casa", "superficie", "finca_matr",
             "codigo_ubicacion_prensa", "plano", "fecha", "hora", "base", "fianza_porcentaje", "minimo_porcentaje"]


def fill_from_description(df, text="descripcion_completa"):
    """Panama only: empty fields taken from the long description; ``completados`` lists them."""
    usable = (F.col("pais") == 1) & (F.length(strip_all(F.col(text))) >= 20)
    got = panama_v1(df.select("id", F.when(usable, F.col(text)).alias("text"),
                              *[F.nullif(F.col(c).cast("string"), F.lit("")).alias(f"_o_{c}") for c in V1_FIELDS]))
    take = {c: F.col(f"_o_{c}").isNull() & F.col(c).isNotNull() for c in V1_FIELDS}
    names = F.array_compact(F.array(*[F.when(take[c], F.lit(c)) for c in sorted(V1_FIELDS)]))
    return got.select("id", *[F.coalesce(f"_o_{c}", F.col(c).cast("string")).alias(c) for c in V1_FIELDS],
                      names.alias("completados"))


# ---- amounts from text ----

def amount(c):
    return F.regexp_replace(F.replace(c, F.lit(","), F.lit("")), r"\.+$", "").try_cast("double")


def docket_position(text, docket):
    """1-based position of the docket, or of its digits when there are at least five; 0 when absent."""
    exact = F.position(docket, text)
    only = digits(docket)

    return F.when(exact > 0, exact).when(F.length(only) >= 5, F.position(only, text)).otherwise(0)


def base_after_docket(text, docket):
    """Base amount printed after the docket and before the next notice header."""
    return let(F.struct(text.alias("t"), docket_position(text, docket).alias("p")), lambda x: _base_at(x["t"], x["p"]))


def _base_at(text, pos):
    tail = F.substr(text, pos)
    nxt = F.position(F.lit("AVISO DE REMATE"), F.substr(tail, F.lit(2)))
    window = F.when(nxt > 0, F.substr(tail, F.lit(1), nxt)).otherwise(tail)
    return let(F.when(pos > 0, window), lambda w: _base_in_window(w, pos))


def _base_in_window(window, pos):
    # fixed values: phrases with the base, tried in this order
    special = [
        r"la base del remate\s*,?\s*es decir\s+la\s+suma\s+de\s+[B8]\s*/\s*\.\s*([\d.,]+)",
        r"base para el remate\s+la\s+cifra\s+de\s+[B8]\s*/\s*\.\s*([\d.,]+)",
        r"base para el remate\s*,?\s*la\s+suma\s+de[^)]{0,200}?\(?\s*[B8]?\s*/\s*\.\s*([\d.,]+)",
        r"CUANT[IÍ]A\s+DEL\s+EMBARGO\s*:.*?\(\s*[B8]\s*/\s*\.\s*([\d.,]+)\s*\)"]
    chosen = F.coalesce(*[found(I + p, window) for p in special])
    generic = r"[B8]\s*/\s*\.\s*([\d.,]{5,})"
    at = F.regexp_instr(window, F.lit(generic))
    lead = F.greatest(at - 80, F.lit(1))
    near = F.upper(F.substr(window, lead, at - lead)).rlike("BASE|AVALU|AVALÚ|CIFRA|SUMA|CUANT|EMBARGO|REMATE")
    loose = let(amount(found(generic, window)), lambda x: F.when((x > 500) & (x < 1_000_000_000), x))
    loose = F.when(near, loose)  # the window ends at the next notice, so no other one stands between docket and amount
    return F.when(pos > 0, F.when(chosen.isNotNull(), amount(chosen)).otherwise(loose))


_MENTION = r"(?:SIRVE\s+DE\s+BASE|BASE\s+DEL\s+REMATE|servir[aá]?\s+de\s+base)"


def base_largest(text):
    """Base next to its mention, else the largest bracketed amount of at least 100."""
    a = money.parse_panama(found("(?iuUs)" + _MENTION + r"[^()]{0,500}?\(\s*[B8]?\s*/\s*\.?\s*([\d][\d.,]*)\s*\)", text))
    b = money.parse_panama(found("(?iuUs)" + _MENTION + r"[^()]{0,500}?la\s+suma\s+de\s+[^()]{0,200}?([B8]?\s*/\s*\.?\s*[\d][\d.,]*)", text))
    every = F.regexp_extract_all(text, F.lit(r"(?iuUs)\(\s*[B8]?\s*/\s*[^)\d]{0,60}?([\d][\d.,]*)\s*\)"), 1)
    amounts = F.filter(F.transform(every, money.parse_panama), lambda x: x >= 100)
    return F.coalesce(a, b, F.array_max(amounts))


# fixed values: words in front of a percentage that make it an interest rate
RATE_WORDS = ["INTERÉS", "INTERES", "TASA", "EFECTIVA"]


def percents_near_docket(df, text="text", docket="expediente", pais="pais"):
    """Deposit and minimum percentages in the window around the docket, inside its own notice."""
    t, e = F.col(text), F.col(docket)
    pos = docket_position(t, e)
    d = df.withColumn("_pos", pos)
    head = F.substr(t, F.lit(1), F.col("_pos") - 1)
    own = F.element_at(F.split(head, "AVISO DE REMATE"), -1)
    tail = F.substr(t, F.col("_pos"))
    nxt = F.position(F.lit("AVISO DE REMATE"), F.substr(tail, F.lit(2)))
    rest = F.when(nxt > 0, F.substr(tail, F.lit(1), nxt)).otherwise(tail)
    d = d.withColumn("_w", F.when(F.col("_pos") > 0, F.concat(own, rest)))
    w = F.col("_w")

    def legal(xs):
        return F.get(F.filter(xs, lambda x: F.when(F.col(pais) == 2, x.cast("int") == 40).otherwise(
            x.cast("int").isin(10, 20, 25))), F.lit(0)).cast("double")

    base1 = F.regexp_extract_all(w, F.lit(
        I + r"\b(?:diez|veinte|veinticinco|cuarenta)?\s*(?:\(\s*)?(\d{1,2})\s*%\s*(?:\))?\s*de\s+(?:la\s+)?base\s+del\s+remate"), 1)
    base2 = F.regexp_extract_all(w, F.lit(I + r"el\s+(\d{1,2})\s*%\s*de\s+la\s+base\s+del\s+remate"), 1)
    rate = "".join(rf"(?<!{x}[\s\S]{{0,{30 - len(x)}}})" for x in RATE_WORDS)
    loose = F.regexp_extract_all(w, F.lit(I + rate + r"(?<!\d)(\d{1,2})\s*%"), 1)
    return d.withColumns({"fianza_porcentaje": F.coalesce(legal(base1), legal(base2), legal(loose)),
                          "minimo_porcentaje": minimum_percent(w, spaced=True)}).drop("_pos", "_w")


# ---- splitting ----

def split_notices(df, key, text="text", drop_cited=True):
    """One row per notice header: its text with up to 150 characters of lead, headers inside sentences left out."""
    guard = r"(?<!(?i:PRESENTE)[\s\S]{0,32})(?<!(?i:FIJA)[\s\S]{0,36})"
    if drop_cited:
        guard += r"(?<!(?i:DE UN AVISO)[\s\S]{0,29})"
    parts = F.split(F.col(text), f"(?={HEADER})" + guard)
    d = df.select(*key, F.posexplode(parts).alias("n", "segmento"), parts.alias("_parts"))
    lead = F.when(F.col("n") > 0, F.right(F.get("_parts", F.col("n") - 1), F.lit(150))).otherwise("")
    return d.filter(F.col("segmento").rlike(f"^{HEADER}")).select(
        *key, "n", lead.alias("previo"), "segmento")


# fixed values: marker put between documents and the headers it goes before
BOUNDARY = ">>> LIMITE_DOCUMENTO <<<"
DOCUMENT_HEADERS = (
    r"AVISO\s+DE\s+[A-Z]{0,2}E[MN]ATE|AVISO\s+DE\s+DISOLUCI[OÓ]N|EDICTO\s+EMPLAZATORIO|"
    r"EDICTO\s+(?:No|N[°º])\.?\s*\d|NEGOCIO\s+(?:No|N[°º])\.?\s*\d|EXTRACTO\s+DE\s+LA\s+DISOLUCI[OÓ]N")


def mark_boundaries(text):
    """Boundary marker before each document header that is not a mention inside a sentence."""
    guard = r"(?<!(?i:PRESENTE)[\s\S]{0,22})(?<!(?i:FIJA)[\s\S]{0,26})"
    return F.regexp_replace(text, f"(?={DOCUMENT_HEADERS})" + guard + f"({DOCUMENT_HEADERS})", f"\n{BOUNDARY}\n$1")


# ---- Colombia tables ----

# fixed values: city to department, in search order, and the abbreviations tried after it
CITY_DEPARTMENT = {
    "BOGOTA": "BOGOTA", "CALI": "VALLE DEL CAUCA", "MONTERIA": "CORDOBA", "MEDELLIN": "ANTIOQUIA",
    "BARRANQUILLA": "ATLANTICO", "SOACHA": "CUNDINAMARCA", "VILLAVICENCIO": "META", "PEREIRA": "RISARALDA",
    "ARMENIA": "QUINDIO", "PASTO": "NARINO", "RIOHACHA": "LA GUAJIRA", "TUNJA": "BOYACA", "NEIVA": "HUILA",
    "IBAGUE": "TOLIMA", "CARTAGENA": "BOLIVAR", "BARRANCA": "SANTANDER", "ESPINAL": "TOLIMA", "HONDA": "TOLIMA",
    "FUNZA": "CUNDINAMARCA", "FACATATIVA": "CUNDINAMARCA", "DUITAMA": "BOYACA", "SOGAMOSO": "BOYACA",
    "CARTAGO": "VALLE DEL CAUCA", "GRANADA": "META", "SANTA MARTA": "MAGDALENA",
}
CITY_ABBREVIATION = [("T.", "TOLIMA"), ("TOL", "TOLIMA"), ("CES", "CESAR"), ("CUNDI", "CUNDINAMARCA"), ("BOY", "BOYACA"),
                     ("VALLE", "VALLE DEL CAUCA"), ("RIS", "RISARALDA"), ("CAQ", "CAQUETA")]


def department_of(city):
    """Department of a city by the first listed name it contains, then abbreviations, else the input."""
    cases = [*CITY_DEPARTMENT.items(), *CITY_ABBREVIATION]
    return let(F.upper(strip_all(city)), lambda up: F.coalesce(
        *[F.when(F.contains(up, F.lit(k)), F.lit(d)) for k, d in cases], F.nullif(up, F.lit(""))))


# fixed values: month abbreviations that open a table row, kinds of goods, cities printed in rows
ROW_START = r"(?i)^(\d{1,2})-?(jul|ago|sep|oct|nov|dic|ene|feb|mar|abr|may|jun)\s+(.+)"
ROW_KINDS = ["APARTAMENTO", "VEHICULO", "CASA", "CUOTA PARTE", "LOCAL", "GARAJE", "MOTO"]
ROW_CITIES = ["BOGOTA", "CALI", "MONTERIA", "MEDELLIN", "SOACHA", "VILLAVICENCIO", "PEREIRA", "ARMENIA", "PASTO", "RIOHACHA",
              "TUNJA", "NEIVA", "IBAGUE", "BARRANCA", "ESPINAL", "HONDA", "FUNZA", "FACATATIVA", "DUITAMA", "SOGAMOSO",
              "CARTAGO", "GRANADA", "SANTA MARTA", "MARIQUITA", "PLANETA RICA", "PUERTO ASIS", "CURILLO", "CHOCONTA",
              "SEVILLA", "MOSQUERA", "VILLANUEVA", "GUAYABAL", "PITALITO", "TOCANCIPA", "SAN LUIS", "SAN JUAN", "LA JAGUA",
              "LA MESA", "APIA"]


def table_rows(text):
    """Rows of a printed table as an array: a line that opens with day-month starts one, others continue it."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip_all), lambda s: s != "")
    marked = F.array_join(F.transform(lines, lambda s: F.when(s.rlike(ROW_START), F.concat(F.lit("\u0001"), s)).otherwise(
        F.concat(F.lit(" "), s))), "")
    return F.filter(F.slice(F.split(marked, "\u0001"), 2, 1_000_000_000), lambda s: s != "")


def goods_category(c):
    up = F.upper(c)

    def any_of(*words):
        return up.rlike("|".join(words))

    return (F.when(any_of("VEHICULO", "CAMIONETA", "MOTO", "CHEVROLET", "RENAULT"), "VEHICULO")
            .when(any_of("APARTAMENTO", "APARAMENTO"), "APARTAMENTO").when(any_of("CASA", r"CAS\."), "CASA")
            .when(any_of("CUOTA PARTE", "CUOTAS PARTES"), "MISCELANEO")
            .when(any_of("LOCAL", "GARAJE", "DEPOSITO"), "MISCELANEO").otherwise("TERRENO"))


def colombia_row(df, row="fila", year="2025"):
    """Fields of one reassembled table row."""
    r = F.col(row)
    months = {m.lower(): f"{i:02d}" for i, m in enumerate(lk.MONTH_ABBR, 1)}
    month_map = F.create_map(*[F.lit(x) for kv in months.items() for x in kv])
    head = r"(?i)^(\d{1,2})-(jul|ago|sep|oct|nov|dic|ene|feb|mar|abr|may|jun)"
    sums = F.regexp_extract_all(r, F.lit(r"(\$\s*[\d.,]+)"), 1)
    kind = F.coalesce(*[F.when(F.contains(F.upper(r), F.lit(k)), F.lit(k)) for k in ROW_KINDS], F.lit("PREDIO"))
    city = found("(" + "|".join(ROW_CITIES) + ")", F.upper(r))
    sides = F.split(r, r"(?i)\bVs\.?\s*")
    process = (F.when(r.rlike("HP|HIPOTECARIO"), "EJECUTIVO HIPOTECARIO").when(r.rlike("SING"), "EJECUTIVO SINGULAR")
               .when(F.contains(r, F.lit("MIX")), "EJECUTIVO MIXTO").when(F.contains(r, F.lit("DIV")), "DIVORCIO")
               .when(r.rlike("Administrativo|Coactivo"), "ADMINISTRATIVO COACTIVO").otherwise("EJECUTIVO"))
    two = F.size(sides) >= 2
    left = strip_all(F.regexp_replace(F.get(sides, F.lit(0)), r"^.*?\d{2}\s+", ""))
    right = strip_all(F.regexp_replace(strip_all(F.get(sides, F.lit(1))), r"[ yotrs]+$", ""))
    d = df.withColumns({"tipo_bien": kind, "ciudad": city}).withColumns({
        "fecha": F.concat(F.lit(f"{year}-"), F.try_element_at(month_map, F.lower(found(head, r, 2))), F.lit("-"),
                          F.lpad(found(head, r, 1), 2, "0")),
        "hora": dates.time_24h(r), "avaluo": money.parse_colombia(F.get(sums, F.lit(0))),
        "base": money.parse_colombia(F.get(sums, F.lit(1))),
        "minimo_porcentaje": F.coalesce(found(r"\b(70|100|50)\b", r).cast("double"), F.lit(70.0)),
        "fianza_porcentaje": F.lit(40.0), "finca_matr": found(r"(\d{2,3}[A-Z]?-?\d{3,7})", r),
        "categoria": goods_category(F.col("tipo_bien")), "expediente": found(r"No\.?\s*([0-9\-]+)", r),
        "proceso": process, "demandante": F.when(two, F.nullif(left, F.lit(""))), "demandado": F.when(two, right),
        "provincia": department_of(F.col("ciudad")),
        "lugar": strip_all(found(r"(\d+\s*[A-Z.]+\s*(?:C\.?C|C\.?M|P\.?M|C\.?CE|C\.?ME|EC\.?M|LB|PQNC|D\.?C\.?M))", r)),
    })
    clock = r"(?i)^.*?\d{1,2}[.:]\s*\d{2}\s*(?:A\.?M|P\.?M)"
    rest = strip_all(F.when(F.col("hora").isNotNull(), F.regexp_replace(r, clock, "")).otherwise(F.regexp_replace(r, head, "")))
    address = F.coalesce(strip_all(found(r"(?i)^(.+?)(?:PREDIO|APARTAMENTO|VEHICULO|CASA|CUOTA PARTE|LOCAL|GARAJE|MOTO|PLACAS)", rest)),
                         rest)
    return d.withColumn("direccion", address).withColumn("prevista", F.concat_ws(", ", "direccion", "ciudad"))


# ---- labels and sections ----

# fixed values: section classes, tried in this order
SECTION_TITLE = r"^(?:AVISO|EDICTO|NOTIFICACI[OÓ]N|CITACI[OÓ]N|REQUERIMIENTO)"
SECTION_VALUE = r"\b(?:BASE|AVAL[UÚ]O|AVALUO|VALOR|PRECIO)\s*(?:DEL\s+)?(?:REMATE)?\s*:?\s*\$?"
SECTION_DEPOSIT = r"\b(?:FIANZA|DEP[ÓO]SITO|DEPOSITO|GARANT[IÍ]A)\b"
SECTION_PARTIES = r"\b(?:DEMANDANTE|DEMANDADO|ACTOR|DEMTE|DDO\.?|DEMANDADA)\b"
SECTION_PLACE = r"\b(?:PROVINCIA|DISTRITO|CORREGIMIENTO|MUNICIPIO|DEPARTAMENTO|CIUDAD|LUGAR)\b"
SECTION_DESCRIPTION = (r"\b(?:DESCRIPCI[OÓ]N|DESCRIPCION|LOTE|CASA|APARTAMENTO|TERRENO|VEH[IÍ]CULO|VEHICULO|INMUEBLE|"
                       r"PROPIEDAD|UBICAD[OA]|SITO|SITA)\b")
SECTION_VALUES = r"\b(?:BASE|AVAL[UÚ]O|PRECIO|VALOR|FIANZA|DEP[ÓO]SITO|GARANT[IÍ]A|CANON|ARRENDAMIENTO)\b"


def section_type(text):
    t = strip_all(text)
    return (F.when(t == "", "UNKNOWN").when(t.rlike(I + SECTION_TITLE), "HEADER")
            .when(t.rlike(I + SECTION_VALUE) & t.rlike(I + SECTION_DEPOSIT), "VALORES").when(t.rlike(I + SECTION_PARTIES), "PARTIES")
            .when(t.rlike(I + SECTION_PLACE), "UBICACION").when(t.rlike(I + SECTION_DESCRIPTION), "DESCRIPCION")
            .when(t.rlike(I + SECTION_VALUES), "VALORES").otherwise("UNKNOWN"))


# fixed values: labels of each field, in search order
LABELS = {
    "expediente": ["expediente", "exp", "no.", "numero", "número", "n°", "nº"],
    "demandante": ["demandante", "demante", "actor", "demte"],
    "demandado": ["demandado", "ddo", "demandada", "dda"],
    "finca_matr": ["finca", "folio real", "matrícula", "matricula", "folio", "finca n°", "finca nº", "finca no."],
    "base": ["base", "avalúo", "avaluo", "valor", "base del remate", "base de remate"],
    "provincia": ["provincia", "departamento", "lugar", "distrito", "corregimiento", "ciudad", "municipio"],
    "fianza_porcentaje": ["fianza", "depósito", "deposito", "garantía", "garantia", "fianza de ley"],
    "minimo_porcentaje": ["mínimo", "minimo", "mínimo legal", "minimo legal"],
    "categoria": ["categoría", "categoria", "clase", "tipo de bien"],
    "descripcion": ["descripción", "descripcion", "lote", "inmueble", "propiedad"],
    "lugar": ["juzgado", "tribunal", "despacho"],
    "fecha": ["fecha", "día", "dia", "el día", "fecha de remate"],
    "hora": ["hora", "a las", "hora de remate"],
    "superficie": ["superficie", "área", "area", "metros", "m²", "m2", "hectáreas", "hectareas"],
    "proceso": ["proceso", "causa", "juicio", "expediente"],
    "lote_casa": ["lote", "casa", "apartamento", "local", "oficina", "bodega", "terreno"],
}


def _escape(label):
    return "".join("\\" + ch if ch in ".°º²" else ch for ch in label)


def label_values(df, key, text="text", section="section", confidence="confidence"):
    """Long table of label-value pairs of each section, the most confident section per (key, field)."""
    t = F.col(text)
    pairs = []
    for field, labels in LABELS.items():
        hits = []
        for label in labels:
            p = rf"(?iuU)\b{_escape(label)}\b"
            at = F.regexp_instr(t, F.lit(p))
            tail = F.substr(t, at + F.length(F.regexp_extract(t, p, 0)))
            hits.append(F.when(at > 0, tail))
        some = "|".join(rf"\b{_escape(label)}\b" for label in labels)
        after = F.when(t.rlike("(?iuU)" + some), F.coalesce(*hits))
        rest = strip_all(after)
        value = F.regexp_replace(rest, r"^[:;,\-–— ]+", "")
        value = strip_all(F.split_part(strip_all(F.split_part(value, F.lit("\n"), F.lit(1))), F.lit(","), F.lit(1)))
        value = F.regexp_replace(value, r"^\s*[:\s]+\s*", "")
        own = F.when(F.col(confidence) > 0, F.col(confidence)).otherwise(0.7)
        boost = F.when(rest.rlike(r"^[\s:;\-–—=]+"), 0.1).otherwise(0.0) + F.when(F.length(rest) > 2, 0.1).otherwise(0.0)
        pairs.append(F.when(after.isNotNull(), F.struct(
            F.lit(field).alias("field"), value.alias("value"), F.round(F.least(own + boost, F.lit(1.0)), 4).alias("conf"))))
    long = df.select(*key, F.col(section).alias("_s"), F.explode(F.array_compact(F.array(*pairs))).alias("p"))
    best = long.groupBy(*key, F.col("p.field").alias("field")).agg(
        F.max_by(F.struct("p.value", "p.conf"), F.struct(F.col("p.conf"), -F.col("_s"))).alias("b"))
    return best.select(*key, "field", F.col("b.value").alias("value"), F.col("b.conf").alias("confidence"))
