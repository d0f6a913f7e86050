"""Column builders for text: key normalisation rules, OCR cleaning, display names."""

from pyspark.sql import functions as F

ACCENTED_UPPER = "ÁÉÍÓÚ"
PLAIN_UPPER = "AEIOU"


def strip_all(c):
    """Trim every kind of white space, line breaks included."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapse(c):
    return F.regexp_replace(c, r"\s+", " ")


def key_upper_plain(c):
    """Upper case, trimmed, five accented vowels made plain; NULL becomes empty."""
    return F.coalesce(F.translate(F.upper(strip_all(c)), ACCENTED_UPPER, PLAIN_UPPER), F.lit(""))


def key_upper(c):
    return F.coalesce(F.upper(strip_all(c)), F.lit(""))


def key_alnum(c):
    """Upper case, accents, Ü and Ñ made plain, only A-Z and 0-9 kept."""
    up = F.translate(F.upper(strip_all(c)), "ÁÉÍÓÚÜÑ", "AEIOUUN")
    return F.coalesce(F.regexp_replace(up, "[^A-Z0-9]", ""), F.lit(""))


def key_alnum_no_umlaut(c):
    """As ``key_alnum`` but Ü is dropped instead of made plain."""
    up = F.translate(F.upper(strip_all(c)), "ÁÉÍÓÚÑ", "AEIOUN")
    return F.coalesce(F.regexp_replace(up, "[^A-Z0-9]", ""), F.lit(""))


def key_money(c):
    """Upper case, accents made plain, money punctuation and spaces dropped."""
    up = F.translate(F.upper(strip_all(c)), "ÁÉÍÓÚÑ", "AEIOUN")
    return F.coalesce(F.regexp_replace(up, r"[.,$ ]", ""), F.lit(""))


def key_compare(c):
    """Lower case, a trailing ``.0`` dropped, then money punctuation and spaces dropped."""
    low = F.regexp_replace(F.lower(strip_all(c)), r"\.0+$", "")
    return F.coalesce(F.regexp_replace(low, r"[$,. ]", ""), F.lit(""))


def blank(c):
    return c.isNull() | (strip_all(c.cast("string")) == "")


def found(pattern, c, group=1):
    """First match of a pattern, NULL when there is none or the group is empty."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def let(c, build):
    """``build(x)`` with ``x`` evaluated once, for expressions that use their input many times."""
    return F.get(F.transform(F.array(c), build), F.lit(0))


def digits(c):
    return F.regexp_replace(c, r"\D+", "")


def ocr_clean(c):
    """Control characters, stray backslashes, smart quotes, leading zeros, spaces, borders."""
    c = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    c = F.regexp_replace(c, r"\\(?![nrt])", "")
    c = F.translate(c, "‘’“”", "''\"\"")
    c = F.regexp_replace(c, r"(?U)\b0([0-9]{3})\b", "$1")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = strip_all(F.regexp_replace(c, r"\n{3,}", "\n\n"))
    lines = F.transform(F.split(c, "\n"), lambda s: F.regexp_replace(
        s, r"""^[\s\-_=*#|"']+|[\s\-_=*#|"']+$""", ""))
    return strip_all(F.array_join(lines, "\n"))


def join_hyphen_breaks(c):
    return F.regexp_replace(c, r"-\s*\n\s*", "")
