"""Column builders for amounts, currencies and percentages."""

from pyspark.sql import functions as F

from gavelwork.functions.text import collapse, let, strip_all

# fixed values: Spanish number words
UNITS = {
    "CERO": 0, "UN": 1, "UNO": 1, "UNA": 1, "DOS": 2, "TRES": 3, "CUATRO": 4, "CINCO": 5, "SEIS": 6,
    "SIETE": 7, "OCHO": 8, "NUEVE": 9, "DIEZ": 10, "ONCE": 11, "DOCE": 12, "TRECE": 13, "CATORCE": 14,
    "QUINCE": 15, "DIECISEIS": 16, "DIECISIETE": 17, "DIECIOCHO": 18, "DIECINUEVE": 19, "VEINTE": 20,
    "VEINTIUN": 21, "VEINTIUNO": 21, "VEINTIUNA": 21, "VEINTIDOS": 22, "VEINTITRES": 23,
    "VEINTICUATRO": 24, "VEINTICINCO": 25, "VEINTISEIS": 26, "VEINTISIETE": 27, "VEINTIOCHO": 28,
    "VEINTINUEVE": 29,
}
TENS = {"TREINTA": 30, "CUARENTA": 40, "CINCUENTA": 50, "SESENTA": 60, "SETENTA": 70, "OCHENTA": 80, "NOVENTA": 90}


def _lookup(table):
    return F.create_map(*[F.lit(x) for k, n in table.items() for x in (k, float(n))])


def _has(c, ch):
    return F.contains(c, F.lit(ch))


def _count(c, ch):
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


def _without(c, ch):
    return F.replace(c, F.lit(ch), F.lit(""))


def separators_to_point(c):
    """Digits with separators to a plain number: the last kind of separator marks the decimals."""
    comma_last = c.rlike(r",[^.,]*$")
    as_point = F.replace(c, F.lit(","), F.lit("."))
    return (
        F.when(_has(c, ",") & _has(c, "."),
               F.when(comma_last, F.replace(_without(c, "."), F.lit(","), F.lit("."))).otherwise(_without(c, ",")))
        .when(_has(c, ","), F.when((_count(c, ",") == 1) & c.rlike(r",[^,]{0,2}$"), as_point).otherwise(_without(c, ",")))
        .otherwise(c))


def parse_generic(c):
    """Amount in any notation, two decimals; NULL when it is not a number."""
    cleaned = F.regexp_replace(F.regexp_replace(c, r"[^\d.,]", ""), r"^\.+|\.+$", "")
    return F.round(F.nullif(let(cleaned, separators_to_point), F.lit("")).try_cast("double"), 2)


def number_text(c):
    return separators_to_point(F.regexp_replace(c, r"[^\d.,-]", ""))


def parse_panama(c):
    """Panama amounts, repairing thousands and cents glued by OCR (``47.92727`` is 47,927.27)."""
    s = F.regexp_replace(strip_all(c), r"[ $]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"\.+$", ""), r"^(?:B/?\.?|8/\.?|/\.?|\.)", "")
    return let(s, lambda x: _panama_number(F.when(x.rlike(r"^[\d.,]+$"), x)))


def _panama_number(s):
    whole, dec = F.split_part(s, F.lit("."), F.lit(1)), F.split_part(s, F.lit("."), F.lit(2))
    joined = F.concat(whole, dec)
    glued = F.concat(F.left(joined, F.length(joined) - 2), F.lit("."), F.right(joined, F.lit(2))).try_cast("double")
    repair = (F.length(whole) <= 2) & (F.length(dec) > 2) & (F.length(joined) >= 6) & (glued >= 100)
    both = F.when(s.rlike(r",[^.,]*$"), F.replace(_without(s, "."), F.lit(","), F.lit("."))).otherwise(_without(s, ","))
    return (
        F.when(_has(s, ",") & _has(s, "."), both.try_cast("double"))
        .when(_count(s, ".") > 1, F.concat(_without(F.regexp_replace(s, r"\.[^.]*$", ""), "."), F.lit("."),
                                           F.regexp_extract(s, r"([^.]*)$", 1)).try_cast("double"))
        .when(_has(s, ","), _without(s, ",").try_cast("double"))
        .when(_has(s, "."), F.when(F.length(dec) <= 2, s.try_cast("double")).when(repair, glued)
              .otherwise(_without(s, ".").try_cast("double")))
        .otherwise(s.try_cast("double")))


def parse_colombia(c):
    """Colombian amounts: dots are thousands, a comma marks decimals."""
    s = F.regexp_replace(strip_all(c), r"[$ .]", "")
    return F.nullif(F.replace(s, F.lit(","), F.lit(".")), F.lit("")).try_cast("double")


def currency(c):
    """Currency label; ``B/`` is labelled HNL on purpose (kept from the rule book)."""
    up = F.upper(strip_all(c))
    return (F.when(c.isNull() | (c == ""), "UNKNOWN").when(up.rlike(r"\bB\.?\s*/"), "HNL").when(_has(up, "USD"), "USD")
            .when(_has(up, "COP"), "COP").when(_has(up, "PAB"), "PAB").when(_has(c, "$"), "LOCAL").otherwise("UNKNOWN"))


def words_to_number(c):
    """``CUARENTA Y CINCO`` to 45.0, ``CIENTO DOS`` to 102.0; NULL when not number words."""
    return let(F.translate(F.upper(collapse(strip_all(c))), "ÁÉÍÓÚ", "AEIOU"), _words)


def _words(up):
    parts = F.split(up, " ")
    units, tens = _lookup(UNITS), _lookup(TENS)
    first = F.try_element_at(tens, F.get(parts, F.lit(0)))
    return (
        F.when(F.try_element_at(units, up).isNotNull(), F.try_element_at(units, up))
        .when(up == "CIEN", F.lit(100.0))
        .when(first.isNotNull() & (F.size(parts) == 1), first)
        .when(first.isNotNull() & (F.size(parts) == 3) & (F.get(parts, F.lit(1)) == "Y"),
              first + F.try_element_at(units, F.get(parts, F.lit(2))))
        .when((F.size(parts) == 2) & (F.get(parts, F.lit(0)) == "CIENTO"),
              F.lit(100.0) + F.try_element_at(units, F.get(parts, F.lit(1)))))


def parse_percent(c):
    """``40%``, ``70 %``, ``0.40`` and ``CUARENTA POR CIENTO`` to a percentage."""
    return let(strip_all(c), _percent)


def _percent(s):
    words = F.regexp_extract(s, r"(?iuU)^([A-ZÁÉÍÓÚÑ]+(?:\s+[A-ZÁÉÍÓÚÑ]+)*?)\s+POR\s+CIENTO$", 1)
    cleaned = F.regexp_replace(s, r"[^\d.,\-]", "")
    plain = F.when((_count(cleaned, ",") == 1) & cleaned.rlike(r",[^,]{0,2}$"),
                   F.replace(cleaned, F.lit(","), F.lit("."))).otherwise(_without(cleaned, ","))
    value = F.nullif(plain, F.lit("")).try_cast("double")
    scaled = F.when((value > 0) & (value <= 1), value * 100).otherwise(value)
    return F.when(words != "", words_to_number(words)).otherwise(F.round(scaled, 2))
