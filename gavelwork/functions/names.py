"""Column builders for party and place names."""

from pyspark.sql import functions as F

from gavelwork.functions.text import collapse, strip_all

# fixed values: words written in capitals inside a name
CAPITAL_WORDS = ["S.A.", "S.A", "DE", "LIMITADA", "Y", "E"]

# fixed values: display names of places, odd spellings included
PA_DISPLAY = {
    "PANAMA": "Panamá", "PANAMÁ": "Panamá", "PANAMA OESTE": "Panamá Oeste", "HEREDIA": "Heredia",
    "COLON": "Colón", "COLÓN": "Colón", "CHIRIQUI": "Chiriquí", "CHIRIBI": "Chiriquí", "COCLE": "Coclé",
    "COCLÉ": "Coclé", "LIMA": "Limón", "LIMÓN": "Limón", "BOCAS": "Bocas del Toro",
    "BOCAS DEL TORO": "Bocas del Toro", "CANAAN": "Canaán", "CANAÁN": "Canaán",
}
CO_DISPLAY = {
    "BOGOTA": "Bogotá", "BOGOTÁ": "Bogotá", "BOGOTA D.C": "Bogotá D.C.", "BOGOTÁ D.C.": "Bogotá D.C.",
    "ANTIOQUIA": "Antioquia", "CALDAS": "Caldas", "RISARALDA": "Risaralda", "QUINDIO": "Quindío",
    "QUINDÍO": "Quindío", "MAGDALENA": "Magdalena", "CESAR": "Cesar", "CORDOBA": "Córdoba",
    "CÓRDOBA": "Córdoba", "SUCRE": "Sucre", "CORAVAL": "Córdoba",
}


def capitalize(c):
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def title(c):
    """Capital after every character that is not a letter."""
    return F.array_join(F.transform(F.split(c, r"(?<=\P{L})|(?=\P{L})"), capitalize), "")


def legal_name(c):
    """``Last, First`` swapped, spaces collapsed, capitals kept for company forms and particles."""
    s = F.regexp_replace(collapse(strip_all(c)), r"^([^,]+),\s*(.+)$", "$2 $1")
    words = F.transform(F.split(strip_all(s), r"\s+"), lambda w: F.when(
        F.contains(w, F.lit(".")) | F.upper(w).isin(CAPITAL_WORDS), F.upper(w)).otherwise(capitalize(w)))
    return F.array_join(words, " ")


def name_parts(c):
    w = F.split(strip_all(c), r"\s+")
    n = F.size(w)
    return F.struct(
        F.get(w, F.lit(0)).alias("first_name"),
        F.when(n > 2, F.array_join(F.slice(w, F.lit(2), F.greatest(n - 2, F.lit(0))), " ")).alias("middle_names"),
        F.when(n > 1, F.element_at(w, -1)).otherwise("").alias("last_name"))


def place_display(c):
    table = {**CO_DISPLAY, **PA_DISPLAY}
    key = collapse(F.upper(strip_all(c)))
    names = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(names, key), title(strip_all(c)))


def city_display(c):
    return title(collapse(strip_all(c)))
