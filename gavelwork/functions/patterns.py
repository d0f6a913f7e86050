"""Pattern tables (field, ordered regular expressions) and the column generator over them."""

import re

from pyspark.sql import functions as F

from gavelwork.functions.text import collapse, let, strip_all

FLAGS = "(?iuUmd)"

# fixed values: Panama notice patterns, tried in this order
PANAMA = {
    "expediente": [
        r"(?:EXPEDIENTE|EXPE\.?|E\.?J\.?E\.?)\s*[:\s#N°]*\s*([\d]+[\d/\-\.\s]*)",
        r"(?:Exp\.?\s*Electr\.?)\s*[:\s]*(\d+)",
    ],
    "finca": [
        r"FINCA\s+(?:N[°o]\.?\s*)?(\d[\d\s]*)",
        r"FINC\s*[:\s]*(\d[\d\s/]*)",
        r"(?:MATRICULA\s+)?(?:INMUEBLE|PROPIEDAD)\s*[:\s]*(\d[\d\s/-]*)",
        r"LA\s+FINCA\s+N[°o]\.?\s*(\d[\d\s]*)",
    ],
    "precio_base": [
        r"BASE\s+DEL\s+REMATE\s*[:\s]*(?:B/?\.?|\$)?\s*([\d,\.]+)",
        r"AVAL[UÚ]O\s+COMERCIAL\s*[:\s]*(?:B/?\.?|\$)?\s*([\d,\.]+)",
        r"servir[aá]?\s+de\s+base[^)]{0,400}?\(\s*[B8]?\s*/\s*\.?\s*([\d.,\s]+)\s*\)",
        r"(?:SIRVE\s+DE\s+BASE|BASE\s+DEL\s+REMATE)[^)]{0,400}?\(\s*[B8]?\s*/\s*\.?\s*([\d.,\s]+)\s*\)",
        r"BASE\s*[:\s]*(?:B/?\.?|\$)?\s*([\d,\.]+)",
        r"BASE\s*[:\s]*([\d,\.]+)",
        r"VALOR\s+(?:DEL\s+)?(?:REMATE|BASE|AVAL[UÚ]O(?:\s+COMERCIAL)?)\s*[:\s]*(?:B/?\.?|\$)?\s*([\d,\.]+)",
    ],
    "fecha_remate": [
        r"FECHA\s*(?:DE\s+REMATE|DEL\s+REMATE|PROBABLE)?\s*[:\s]*(\d{1,2}\s+DE\s+[A-ZÁÉÍÓÚ]+\s+DE\s+\d{4})",
        r"REMATE\s*(?:PROBABLE|SEÑALADO)?\s*[:\s]*(\d{1,2}/\d{1,2}/\d{2,4})",
        r"(\d{1,2}\s+DE\s+[A-ZÁÉÍÓÚ]+\s+DE\s+\d{4})",
    ],
    "demandante": [
        r"(?:PROMOVIDO|INSTAURADO|PROPUESTO)\s+POR\s+([A-ZÑÁÉÍÓÚ0-9.,& ]{3,80}?)(?:,|\s+EN\s+CONTRA|\n|\.\s)",
        r"A\s+FAVOR\s+DE\s+([A-ZÑÁÉÍÓÚ0-9.,& ]{3,80}?)(?:,|\n|\.\s)",
        r"POR\s+([A-ZÑÁÉÍÓÚ0-9.,& ]{3,80}?)(?:,|\s+EN\s+CONTRA|\n)",
        r"DEMANDANTE\s*[:\s]*([A-ZÁÉÍÓÚ\s,\.]+?)(?:\n|\s{2,}|$)",
        r"(?:PROMOVIDO|PROPUESTO)\s+POR\s+([A-ZÑÁÉÍÓÚ0-9.,& ]{3,80}?)(?:\n|$)",
        r"(?:ALGUACIL|ALGUIL)\s+.*?POR\s+([A-ZÑÁÉÍÓÚ0-9.,& ]{3,60}?)(?:,|\n|\.\s)",
        r"(?:CONTRA|EN\s+CONTRA)\s+(?:DE?\s*)?[A-ZÑÁÉÍÓÚ\s,\.]{5,80}?\s+POR\s+EL\s+BANCO\s+([A-ZÑÁÉÍÓÚ0-9.,& ]{3,60}?)(?:,|\n)",
    ],
    "demandado": [
        r"(?:EN\s+)?CONTRA\s+DE?\s*([A-ZÑÁÉÍÓÚ0-9.,& ]{3,80}?)(?:,|\n|\.\s|POR\s+EL|$)",
        r"(?:PARTE\s+)?DEMANDADA?\s+([A-ZÑÁÉÍÓÚ0-9.,& ]{3,80}?)(?:,|\n|\.\s|CED|$)",
        r"DEMANDADO\s*[:\s]*([A-ZÁÉÍÓÚ\s,\.]+?)(?:\n|\s{2,}|$)",
        r"(?:EN\s+)?CONTRA\s+(?:DE?\s*)?([A-ZÑÁÉÍÓÚ\s,\.]{3,80}?)(?:\n|$)",
    ],
    "hora": [
        r"HORA\s*[:\s]*(\d{1,2}[:\.]\d{2}\s*(?:A\.?M\.?|P\.?M\.?)?)",
        r"(?:a\s+las?\s+|hora\s*)(\d{1,2}[:\.]\d{2}\s*(?:A\.?M\.?|P\.?M\.?)?)",
        r"(\d{1,2}[:\.]\d{2}\s*(?:A\.?M\.?|P\.?M\.?))",
    ],
    "lugar": [
        r"JUZGADO\s+(?:DEL?\s+)?(?:PRIMER?|SEGUNDO|TERCER|CUARTO|QUINTO|DECIMO)\s+DE\s+CIRCUITO",
        r"JUZGADO\s+(?:DEL?\s+)?(?:PRIMER?|SEGUNDO|TERCER|CUARTO|QUINTO|DECIMO)\s+DE\s+INSOLVENCIA",
        r"JUZGADO\s+(?:DEL?\s+)?(?:PRIMER?|SEGUNDO|TERCER|CUARTO|QUINTO|DECIMO)\s+DE\s+LO(?:S)?\s+(?:CIVIL|PENAL|FAMILIA)",
        r"CORTE\s+SUPREMA",
        r"PLAZA\s+DE\s+ARMAS",
        r"TRIBUNAL\s+(?:DE\s+)?(?:CIRCUITO|FAMILIA|CIVIL)",
        r"SECRETAR[IÍ]A\s+DE\s+TRIBUNAL",
        r"JUZGADO\s+\w+\s+DE\s+CIRCUITO\s+DE\s+INSOLVENCIA",
        r"JUZGADO\s+\w+\s+DE\s+CIRCUITO\s+JUDICIAL",
    ],
    "superficie": [
        r"SUPERFICIE\s*[:\s]*([\d,\.]+)\s*(?:M2|M²|METROS?)",
        r"([\d,\.]+)\s*(?:M2|M²|METROS?\s+CUADRADOS?)",
        r"SUPERF(?:ICIE)?\s*[:\s]*([\d,\.]+)",
    ],
    "provincia": [
        r"PROVINCIA\s+DE\s+([A-ZÁÉÍÓÚÑ\s]+?)(?:,|\.|\n)",
        r"(?:CHIRIQUI|PANAMA|COLON|VERAGUAS|HERRERA|LOS\s+SANTOS|COCLE|BOCAS\s+DEL\s+TORO|PANAMA\s+OESTE)",
    ],
    "codigo_ubicacion": [
        r"CODIGO\s+DE\s+UBICACION\s*[:\s]*(\d+)",
        r"UBICACION\s*(?:DEL?\s+)?(?:CODIGO|COD)\s*[:\s]*(\d+)",
        r"COD\.?\s+UBIC\.?\s*[:\s]*(\d+)",
    ],
    "categoria": [
        r"(?:UNA?\s+)?(?:VIVIENDA(?:\s+UNIFAMILIAR)?|CASA(?:\s+RESIDENCIAL)?|RESIDENCIA|QUINTA)\b",
        r"APARTAMENTO|APTO\b",
        r"TERRENO|LOTE\b",
        r"\bVEH[IÍ]CULO\b|\bCARRO\b|\bMOTOCICLETA\b",
        r"\bLOCAL\b|\bCOMERCIO\b|\bOFICINA\b",
        r"CUOTAS?\s+PARTES?",
        r"CATEGORIA\s*[:\s]*(\d)",
    ],
    "proceso": [
        r"(?:DENTRO\s+DEL?\s+)?PROCESO\s+(EJECUTIVO(?:\s+HIPOTECARIO)?|MONITARIO(?:\s+HIPOTECARIO)?|INSOLVENCIA(?:\s+JUDICIAL)?|SUMARIO|EJECUTIVO\s+SIMPLE)",
        r"TIPO\s+DE\s+PROCESO\s+(EJECUTIV[OA](?:\s+HIPOTECARIA?)?|MONITORIO(?:\s+HIPOTECARIO)?|INSOLVENCIA|SUMARIO)",
        r"PROCESO\s+(EJECUTIVO|MONITARIO|MONITORIO|INSOLVENCIA|SUMARIO)",
        r"(EJECUTIVO\s+HIPOTECARIO(?:\s+[A-Z]+)?)",
    ],
    "email_observaciones": [r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"],
}

_PCT = r"FIANZA\s+DEL\s+POSTOR|PORCENTAJE\s+DE\s+FIANZA|FIANZA"
_MIN = r"POSTURA\s+ADMISIBLE|PORCENTAJE\s+MÍNIMO|PORCENTAJE\s+MINIMO|BASE\s+MÍNIMA|BASE\s+MINIMA|MÍNIMO|MINIMO"
_GAP = r"\s*[:\-]?\s*(?:(?:(?:[A-ZÁÉÍÓÚÑ]+[ \t]+){1,3}[A-ZÁÉÍÓÚÑ]+\s*[:\-]?\s*))??(?<![A-ZÁÉÍÓÚÑ])"


def _percent_rules(labels):
    number, word = r"(\d{1,3}(?:[.,]\d+)?)", r"([A-ZÁÉÍÓÚÑ]+(?:\s+[A-ZÁÉÍÓÚÑ]+)*?)"
    return [rf"(?:{labels}){_GAP}{number}\s*%", rf"(?:{labels}){_GAP}{word}\s+POR\s+CIENTO\b", rf"(?:{labels}){_GAP}{number}\s*$"]


# fixed values: Colombia notice patterns, tried in this order
COLOMBIA = {
    "expediente": [
        r"(?:EXPEDIENTE|RADICADO|PROCESO)\s*(?:N[°o]\.?|NÚMERO|NUMERO)?\s*[:\s]*([\d\-/\.]+)",
        r"N[°o]\.?\s*(?:EXP|EXPE)\s*[:\s]*([\d\-/\.]+)",
    ],
    "finca": [
        r"(?:MATRÍCULA|MATRICULA)\s+(?:INMOBILIARIA\s+)?(?:N[°o]\.?\s*)?(\d[\d\s\-/]*)",
        r"(?:CEDULA\s+)?CATASTRAL\s*[:\s]*(\d[\d\s\-/]*)",
        r"FINCA\s+(?:N[°o]\.?\s*)?(\d[\d\s]*)",
    ],
    "precio_base": [
        r"(?:AVALÚO|AVALUO|BASE|PRECIO)\s*[:\s]*(?:COMERCIAL|DEL\s+BIEN|DEL\s+INMUEBLE)?\s*[:\s]*\$?\s*([\d,\.]+)",
        r"VALOR\s+(?:COMERCIAL|DEL\s+INMUEBLE)\s*[:\s]*\$?\s*([\d,\.]+)",
    ],
    "fecha_remate": [
        r"FECHA\s*(?:DE\s+REMATE|PROGRAMADA|SEÑALADA|ESTIMADA)?\s*[:\s]*(\d{1,2}\s+DE\s+[A-ZÁÉÍÓÚ]+\s+DE\s+\d{4})",
        r"REMATE\s*(?:EL\s+DÍA|SEÑALADO\s+PARA\s+EL)?\s*[:\s]*(\d{1,2}/\d{1,2}/\d{2,4})",
    ],
    "demandante": [
        r"DEMANDANTE\s*[:\s]*([A-ZÁÉÍÓÚÑ\s,\.]+?)(?:\n|\s{3,}|$)",
        r"ACTOR\s*[:\s]*([A-ZÁÉÍÓÚÑ\s,\.]+?)(?:\n|\s{3,}|$)",
    ],
    "demandado": [
        r"DEMANDADO\s*[:\s]*([A-ZÁÉÍÓÚÑ\s,\.]+?)(?:\n|\s{3,}|$)",
        r"DEUDOR\s*[:\s]*([A-ZÁÉÍÓÚÑ\s,\.]+?)(?:\n|\s{3,}|$)",
    ],
    "fianza_porcentaje": _percent_rules(_PCT),
    "minimo_porcentaje": _percent_rules(_MIN),
}

# fixed values: phrases that show a party pattern ran over its end; such a match gives way to the next pattern
PARTY_NOISE = ["MEDIO DEL PRESENTE", "PRESENTE AVISO", "PRESENTE EDICTO", "PRESENTE PUBLICACION", "HA PROMOVIDO", "SEGUN", "PARA QUE"]
REJECTED = {"demandante": "|".join(PARTY_NOISE), "demandado": "|".join(PARTY_NOISE)}

REGISTRY = {("PA", "REMATE"): PANAMA, ("CO", "REMATE"): COLOMBIA}


def register_extractor(country, doc_type, table):
    """Add or replace a pattern table: ``{field: [regex, ...]}``."""
    for rules in table.values():
        for rule in rules:
            re.compile(rule)
    REGISTRY[(country, doc_type)] = table


def first_match(text, rules, flags=FLAGS, reject=None):
    """Group 1 (or the whole match) of the first rule that matches, trimmed and collapsed; ``reject`` skips noisy matches."""
    options = []
    for rule in rules:
        p = flags + rule
        found = [F.nullif(F.regexp_extract(text, p, 0), F.lit(""))]
        if re.compile(rule).groups:
            found.insert(0, F.nullif(F.regexp_extract(text, p, 1), F.lit("")))
        value = F.coalesce(*found)
        options.append(let(value, lambda x: F.when(~F.upper(x).rlike(reject), x)) if reject else value)
    return collapse(strip_all(F.coalesce(*options)))


def extract_fields(df, country, doc_type="REMATE", text="text"):
    """All fields of one registered table in a single projection."""
    table = REGISTRY[(country, doc_type)]
    return df.select("*", *[first_match(F.col(text), rules, reject=REJECTED.get(f)).alias(f) for f, rules in table.items()])
