"""Column builders for dates, times and press codes."""

from pyspark.sql import functions as F

from gavelwork.functions import lookups as lk
from gavelwork.functions.text import found, key_upper_plain, strip_all

ISO = r"^(\d{4})-(\d{2})-(\d{2})"
DOT = r"^(\d{1,2})\.(\d{1,2})\.(\d{4})"
SLASH = r"^(\d{1,2})/(\d{1,2})/(\d{4})"
SPANISH = r"(?i)^(\d{1,2})\s*(?:de\s+)?([A-Za-z]+)\s*(?:de\s+)?(\d{4})"


def month_number(name):
    """Two-digit month of a Spanish month name, NULL when it is not one."""
    table = F.create_map(*[F.lit(x) for kv in lk.MONTHS.items() for x in kv])
    return F.try_element_at(table, F.lower(name))


def _iso(y, m, d):
    """Text date when the parts are in range; the day is only checked against 31."""
    ok = m.cast("int").between(1, 12) & d.cast("int").between(1, 31) & y.cast("int").between(1900, 2100)
    return F.when(ok, F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))


def _parts(pattern, c):
    return [found(pattern, c, i) for i in (1, 2, 3)]


def to_iso(c):
    """ISO text of an ISO, dotted, slashed or Spanish date; empty when none fits."""
    s = strip_all(c)
    y, m, d = _parts(ISO, s)
    out = [_iso(y, m, d)]
    for p in (DOT, SLASH):
        d, m, y = _parts(p, s)
        out.append(_iso(y, m, d))
    d, name, y = _parts(SPANISH, s)
    out.append(_iso(y, month_number(name), d))
    return F.coalesce(*out, F.lit(""))


def date_format_of(c):
    s = strip_all(c)
    return (F.when(s.rlike(ISO), "ISO").when(s.rlike(DOT), "DOT").when(s.rlike(SLASH), "SLASH")
            .when(s.rlike(SPANISH), "SPANISH").otherwise("UNKNOWN"))


# fixed values: words that make a nearby date the auction date
AUCTION_DATE_WORDS = ["REMATE", "SUBASTA", "CELEBRAR", "VERIFICA", "EFECTUAR"]
_DAY = r"(?:EL\s+)?D[IÍ]A\s+\d{1,2}\s+DE\s+[A-ZÁÉÍÓÚÑ]+(?:\s+DE\s+|\s+)\d{4}"


def auction_date(text):
    """First valid date with an auction word in the 150 characters before or the 100 after it."""
    body = r"(?iu)(\d{1,2})\s+DE\s+([A-ZÁÉÍÓÚÑ]+)(?:\s+DE\s+|\s+)(\d{4})$"
    words = "|".join(AUCTION_DATE_WORDS)

    def as_date(s):
        iso = F.concat_ws("-", F.regexp_extract(s, body, 3), F.coalesce(month_number(F.regexp_extract(s, body, 2)), F.lit("00")),
                          F.lpad(F.regexp_extract(s, body, 1), 2, "0"))
        return F.try_to_date(iso, "yyyy-MM-dd")

    def step(acc, d):
        at = F.position(d, text, acc["next"])
        lead = F.greatest(at - 150, F.lit(1))
        near = F.upper(F.substr(text, lead, at - lead + F.length(d) + 100)).rlike(words)
        return F.when(acc["day"].isNotNull(), acc).otherwise(F.struct(
            (at + F.length(d)).alias("next"), F.when(near, as_date(d)).alias("day")))

    start = F.struct(F.lit(1).alias("next"), F.lit(None).cast("date").alias("day"))
    return F.aggregate(F.regexp_extract_all(text, F.lit(f"(?iu)({_DAY})"), 1), start, step)["day"].cast("string")


def time_12h(text):
    """``HH:MM A.M.`` forms, or ``LAS 10 A.M.``"""
    p1 = r"(?iuU)(\d{1,2}):(\d{2})\s*(A\.?\s*M\.?|P\.?\s*M\.?)"
    p2 = r"(?iuU)LAS?\s+(\d{1,2})\s*(?:HORAS?)?\s*(A\.?\s*M\.?|P\.?\s*M\.?)"
    h1, m1, a1 = (found(p1, text, i) for i in (1, 2, 3))
    h2, a2 = found(p2, text, 1), found(p2, text, 2)

    def mark(c):
        return F.upper(F.replace(c, F.lit(" "), F.lit("")))

    return F.when(h1.cast("int").between(1, 12) & m1.cast("int").between(0, 59),
                  F.concat(F.lpad(h1, 2, "0"), F.lit(":"), m1, F.lit(" "), mark(a1))).when(
        h2.cast("int").between(1, 12), F.concat(F.lpad(h2, 2, "0"), F.lit(":00 "), mark(a2)))


def time_24h(text):
    """``8:30 P.M.`` to ``20:30``."""
    p = r"(?i)(\d{1,2})[.:]\s*(\d{2})\s*(A\.?M|P\.?M)"
    h, m = found(p, text, 1).cast("int"), found(p, text, 2)
    half = F.upper(F.replace(found(p, text, 3), F.lit("."), F.lit("")))
    hour = F.when((half == "PM") & (h < 12), h + 12).when((half == "AM") & (h == 12), F.lit(0)).otherwise(h)
    return F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), m)


def newspaper_acronym(paper, pais):
    key = key_upper_plain(paper)
    out = F.when(pais == 2, "SEJ").when(key.isin(list(lk.NEWSPAPER_ACRONYMS.values())), key)
    for name, short in lk.NEWSPAPER_ACRONYMS.items():
        out = out.when(F.contains(key, F.lit(name)), short)
    return out


def press_code(paper, pais, date_text, page, source=None):
    """Acronym + day + month + year + page, e.g. ``LE08JUL20261C``; NULL unless all three are known."""
    p = r"^\s*(\d{4})-(\d{1,2})-(\d{1,2})"
    y, m, d = (found(p, date_text, i) for i in (1, 2, 3))
    month = F.try_element_at(F.array(*[F.lit(x) for x in lk.MONTH_ABBR]), F.nullif(m.cast("int"), F.lit(0)))
    code = F.concat(newspaper_acronym(paper, pais), F.lpad(d, 2, "0"), month, y, F.nullif(F.upper(strip_all(page)), F.lit("")))
    if source is None:
        return code
    return F.coalesce(code, F.when(F.upper(source).rlike("LP|ML|LE|SEJ"), source))


_WEEKDAY = r"(?:lunes|martes|mi[ée]rcoles|jueves|viernes|s[áa]bado|domingo)"
_MONTH = r"(enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre)"
_PAPER = r"(La Prensa|La Estrella|Metro Libre)"
NAME_FIRST = rf"(?iuU){_PAPER}\s*,?\s*Panam[áa]?\s*,?\s*{_WEEKDAY}\s+(\d{{1,2}})\s+de\s+{_MONTH}\s+de\s+(\d{{4}})"
DATE_FIRST = rf"(?iuU){_WEEKDAY}\s+(\d{{1,2}})\s+de\s+{_MONTH}\s+de\s+(\d{{4}})\s*{_PAPER}"


def newspaper_header(text):
    """(paper, date) printed in the page header, with the name first or last; the earlier one wins."""
    def iso(p, d, m, y):
        return F.concat_ws("-", found(p, text, y), month_number(found(p, text, m)), F.lpad(found(p, text, d), 2, "0"))

    a, b = F.regexp_instr(text, F.lit(NAME_FIRST)), F.regexp_instr(text, F.lit(DATE_FIRST))
    first = (a > 0) & ((b == 0) | (a <= b))
    return (F.when(first, found(NAME_FIRST, text, 1)).when(b > 0, found(DATE_FIRST, text, 4)),
            F.when(first, iso(NAME_FIRST, 2, 3, 4)).when(b > 0, iso(DATE_FIRST, 1, 2, 3)))


def page_code(text):
    """Page code alone on a line; a leading I is read as 1."""
    code = F.upper(found(r"(?m)^\s*([0-9I][A-Za-z]{1,2})\s*$", text))
    return F.regexp_replace(code, r"^I(?=[A-Z]+$)", "1")


def file_acronym(name):
    return found(r"^\s*(LP|ML|LE)\b", F.upper(name))


DATE_IN_TEXT = r"\b\d{1,2}\s*(?:de\s+)?[A-Za-z]+\s*(?:de\s+)?\d{4}\b"
ISO_IN_TEXT = r"\b\d{4}-\d{2}-\d{2}\b"


def dates_in_text(text):
    return F.concat(F.regexp_extract_all(text, F.lit(f"({DATE_IN_TEXT})"), 1),
                    F.regexp_extract_all(text, F.lit(f"({ISO_IN_TEXT})"), 1))


def impossible_date(d):
    """Out-of-range parts of a date found in text; month lengths are not checked."""
    iso = r"^(\d{4})-(\d{2})-(\d{2})"
    y, m, day = (F.regexp_extract(d, iso, i).try_cast("int") for i in (1, 2, 3))
    day2 = F.regexp_extract(d, r"^(\d{1,2})", 1).try_cast("int")
    year2 = F.regexp_extract(d, r"(\d{4})$", 1).try_cast("int")
    return F.when(d.rlike(iso), (m > 12) | (day > 31) | (y < 1900) | (y > 2100)).otherwise(
        (day2 > 31) | (year2 < 1900) | (year2 > 2100))
