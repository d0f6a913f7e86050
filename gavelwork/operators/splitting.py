"""Slices, chunks and pages of long texts."""

from pyspark.sql import functions as F

from gavelwork.operators.extract import docket_position


def slice_at_docket(text, docket, before=2000, after=4000):
    """Text around a docket, cut at the next notice header."""
    pos = docket_position(text, docket)
    tail = F.substr(text, pos, F.lit(after))
    nxt = F.position(F.lit("AVISO DE REMATE"), F.substr(tail, F.lit(2)))
    own = F.when(nxt > 0, F.substr(tail, F.lit(1), nxt)).otherwise(tail)
    start = F.greatest(pos - before, F.lit(1))
    return F.when(pos > 0, F.concat(F.substr(text, start, pos - start), own))


def split_pages(df, keys, text="text"):
    """One row per page of a text with ``--- PÁGINA N ---`` markers: page number, text, and its place (inicio, fin) in the whole text."""
    marker = r"\n?--- PÁGINA \d+ ---\n?"
    numbers = F.concat(F.array(F.lit("1")), F.regexp_extract_all(F.col(text), F.lit(r"--- PÁGINA (\d+) ---"), 1))
    d = df.select(*keys, F.split(F.col(text), marker).alias("_parts"), F.regexp_extract_all(F.col(text), F.lit(f"({marker})"), 1).alias("_marks"), numbers.alias("_numbers"))
    steps = F.transform("_parts", lambda p, i: F.length(p) + F.coalesce(F.length(F.get("_marks", i)), F.lit(0)))
    starts = F.aggregate(steps, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    pages = F.arrays_zip(F.col("_parts").alias("texto"), F.col("_numbers").alias("pagina"), F.slice(starts, F.lit(1), F.size("_parts")).alias("inicio"))
    out = d.select(*keys, F.explode(pages).alias("p"))
    out = out.select(*keys, F.col("p.pagina").cast("int").alias("pagina"), F.col("p.texto").alias("texto"), "p.inicio")
    return out.withColumn("fin", F.col("inicio") + F.length("texto")).filter(F.trim("texto") != "")


def _last_before(part, mark):
    """Characters of ``part`` before its last ``mark``, null if there is none."""
    back = F.instr(F.reverse(part), mark)
    return F.when(back > 0, F.length(part) - back - (len(mark) - 1))


def chunk_spans(text, limit, overlap):
    """Array of (inicio, fin): a chunk ends at the last blank line, else line break, else nowhere special, of its last ``overlap`` characters.

    Every chunk but the last reaches at least ``limit - overlap`` characters and the next begins ``overlap`` before its end, which bounds
    the number of chunks.
    """
    n = F.length(text)
    steps = F.sequence(F.lit(1), F.greatest(F.ceil(n / F.lit(max(1, limit - 2 * overlap))), F.lit(1)).cast("int"))

    def chunk(spans, _):
        last = F.coalesce(F.element_at(spans, -1)["fin"], F.lit(0))
        begin = F.when(F.size(spans) == 0, 0).otherwise(F.greatest(last - overlap, F.element_at(spans, -1)["inicio"] + 1))
        tail = F.substr(text, begin + (limit - overlap) + 1, F.lit(overlap))
        cut = F.coalesce(_last_before(tail, "\n\n"), _last_before(tail, "\n"))
        end = F.when(begin + limit >= n, n).otherwise(begin + F.coalesce(cut + (limit - overlap), F.lit(limit)))
        return F.when((F.size(spans) > 0) & (last >= n), spans).otherwise(F.concat(spans, F.array(F.struct(begin.cast("int").alias("inicio"), end.cast("int").alias("fin")))))

    return F.aggregate(steps, F.array().cast("array<struct<inicio:int,fin:int>>"), chunk)


def chunk_texts(df, keys, text="text", limit=45_000, overlap=8_000):
    """Texts cut into chunks of at most ``limit`` characters, at a blank line or line break near the end of each."""
    d = df.select(*keys, text, F.posexplode(chunk_spans(F.coalesce(F.col(text), F.lit("")), limit, overlap)).alias("n", "s"))
    return d.select(*keys, "n", F.col("s.inicio").alias("inicio"), F.substr(F.col(text), F.col("s.inicio") + 1, F.col("s.fin") - F.col("s.inicio")).alias("trozo"))


def pack_segments(df, keys, order, length, limit=45_000):
    """Batch number of contiguous segments: a batch closes before the segment that would exceed the limit."""
    g = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, length))).alias("ss"))
    start = F.struct(F.lit(0).alias("b"), F.lit(0).cast("bigint").alias("n"), F.array().cast("array<int>").alias("ids"))

    def step(acc, s):
        size = s[length].cast("bigint")
        close = (acc["n"] > 0) & (acc["n"] + size > limit)
        b = F.when(close, acc["b"] + 1).otherwise(acc["b"])
        return F.struct(b.alias("b"), F.when(close, size).otherwise(acc["n"] + size).alias("n"), F.array_append(acc["ids"], b).alias("ids"))

    d = g.withColumn("ids", F.aggregate("ss", start, step)["ids"])
    z = d.select(*keys, F.explode(F.arrays_zip("ss", "ids")).alias("z"))
    return z.select(*keys, F.col(f"z.ss.{order}").alias(order), F.col("z.ids").alias("lote"))
