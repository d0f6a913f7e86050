"""Selections over the notice table: search, lists, exports, predicates on text."""

import re

from pyspark.sql import functions as F

from gavelwork.functions import lookups as lk
from gavelwork.functions.text import blank, strip_all

SEARCH_COLUMNS = ["descripcion", "expediente", "demandante", "demandado", "codigo"]


def _iso_day(text):
    return text if text and re.fullmatch(r"\d{4}-\d{2}-\d{2}", text) else None


def active(df):
    return df.filter(F.col("estado") != "eliminado")


def notice_filter(df, pais=None, estado=None, desde=None, hasta=None, q=None):
    """Active notices with optional filters; dates that do not parse are ignored."""
    out = active(df)
    if pais:
        out = out.filter(F.col("pais") == pais)
    if estado:
        out = out.filter(F.col("estado") == estado)
    if _iso_day(desde):
        out = out.filter(F.col("creado_en") >= F.lit(desde).cast("timestamp"))
    if _iso_day(hasta):
        out = out.filter(F.col("creado_en") <= F.lit(hasta).cast("timestamp"))
    if q:
        hit = F.lit(False)
        for c in SEARCH_COLUMNS:
            hit = hit | F.coalesce(F.ilike(F.col(c), F.lit(f"%{q}%")), F.lit(False))
        out = out.filter(hit)
    return out


def newest_first(df):
    return df.orderBy(F.col("creado_en").desc(), F.col("id").desc())


def page(df, number, size):
    return newest_first(df).offset((number - 1) * size).limit(size)


def page_summary(df, size):
    return df.agg(F.count("*").alias("total")).select(
        "total", F.ceil(F.col("total") / size).alias("total_pages"))


def parse_ids(text, separators=","):
    """Ids of a typed list; anything that is not digits is dropped."""
    return [int(p) for p in re.split(f"[{separators}]+", text or "") if p.strip().isdigit()]


def export_selection(df, pais=None, estado=None, ids=None):
    out = active(df)
    if pais:
        out = out.filter(F.col("pais") == (1 if pais.upper() == "PA" else 2))
    if estado:
        out = out.filter(F.col("estado") == estado)
    wanted = parse_ids(ids)
    return out.filter(F.col("id").isin(wanted)) if wanted else out


def bulk_selection(df, pais=None, estado=None, documento_id=None, desde=None, hasta=None, ids=None):
    out = notice_filter(df, pais, estado, desde, hasta)
    if documento_id:
        out = out.filter(F.col("documento_id") == documento_id)
    wanted = parse_ids(ids, r",\s")
    return out.filter(F.col("id").isin(wanted)) if wanted else out


def missing_fields(fields):
    """Names of the empty fields, as an array."""
    return F.array_compact(F.array(*[F.when(blank(F.col(f)), F.lit(f)) for f in fields]))


# fixed values: words that make a text worth extracting
AUCTION_WORDS = ["REMATE", "SUBASTA", "BASE DEL REMATE", "AVALUO", "AVALÚO", "POSTURA",
                 "SE VENDERA", "SE VENDERÁ", "MEJOR POSTOR"]


def looks_like_auction(text, words=AUCTION_WORDS):
    up = F.upper(text)
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(up, F.lit(w))
    return hit


def plausible_base(amount):
    return amount.isNotNull() & (amount >= 100) & (amount < 1_000_000_000)


def has_identity(expediente, finca, demandante, demandado):
    """A fragment with no docket, property or party is not a notice."""
    keep = F.lit(False)
    for c in (expediente, finca, demandante, demandado):
        keep = keep | ~blank(c)
    return keep


# fixed values: values that stand for nothing, and the renaming to stored fields
PLACEHOLDERS = ["", "null", ".", "..", "NOT_FOUND"]
STORE_NAMES = {"finca": "finca_matr", "precio_base": "base", "fecha_remate": "fecha"}


def drop_placeholder(c):
    return F.when(~c.isin(PLACEHOLDERS), c)


# fixed values: fields a model may fill, may never fill, and the two confidence floors
AI_ALLOWED = ["fecha_remate", "hora", "lugar", "juzgado", "provincia", "municipio"]
AI_FORBIDDEN = ["expediente", "finca", "precio_base", "base", "fianza", "minimo", "matricula"]
AI_FOUND, AI_REVIEW = 0.95, 0.80


def ai_status(field, confidence):
    """Status of a candidate answer: forbidden fields stay out, the rest follow the clamped confidence."""
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence.try_cast("double")))
    level = F.when(confidence.try_cast("double").isNull(), "REQUIRES_REVIEW").when(c >= AI_FOUND, "FOUND").when(
        c >= AI_REVIEW, "REQUIRES_REVIEW").otherwise("NOT_FOUND")
    return F.when(field.isin(AI_ALLOWED), level).otherwise(F.lit("NOT_ALLOWED"))
