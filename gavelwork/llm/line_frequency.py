r"""Site-relative line frequency: lines on more than ``ratio`` of a host's pages are boilerplate and go.

A line is what stands between newlines, compared without outer blanks; empty lines are never counted nor dropped. Pages with a line over
pages of the host decide, so a host's own menu goes whatever the host's size; a line must also be on ``least`` pages, since on a host of two
pages every line would exceed any ratio. Equal texts of a host are one page, in a line's pages and in the host's, so that a group of copies
does not make its own lines boilerplate. At most (lines of a page / ratio) lines of a host can exceed it, which bounds the table of
boilerplate lines per host; a host's pages are never gathered.

Null texts stay null and are one page of their host, a null host is a host of its own, rows that repeat are cleaned alike, an empty table
gives an empty result. ``n_lines`` and ``n_removed`` take the place of columns of these names; all other columns pass through.
"""

from pyspark.sql import functions as F

from gavelwork.llm.common import stored

BLANK = " \t\n\x0b\x0c\r"
LEAST = 3


def _trimmed(line):
    return F.trim(line, F.lit(BLANK))


def _key(line):
    """96 bits that stand for a line in counts."""
    return F.struct(F.xxhash64(_trimmed(line)).alias("a"), F.hash(_trimmed(line)).alias("b"))


def boilerplate(docs, host, text="text", ratio=0.1, least=LEAST):
    """h (the host), often (array of the keys of its boilerplate lines)."""
    page = F.struct(F.xxhash64(text).alias("c"), F.hash(text).alias("d")).alias("page")
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: _trimmed(x) != "")
    keys = docs.select(F.col(host).alias("host"), page, F.explode(F.array_distinct(F.transform(lines, _key))).alias("k"))
    on = keys.distinct().groupBy("host", "k").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    pages = stored(docs.select(F.col(host).alias("h"), page).distinct().groupBy("h").agg(F.count("*").alias("pages")), "hosts")
    often = on.join(pages, F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") > ratio * F.col("pages"))
    return stored(often.groupBy(F.col("host").alias("h")).agg(F.collect_set("k").alias("often")), "boilerplate")


def cleaned(docs, host="source", text="text", ratio=0.1, least=LEAST, counts=("n_lines", "n_removed")):
    """``docs`` with ``text`` cleaned and two columns ``counts``: its lines that are not blank, and how many of them went."""
    often = boilerplate(docs, host, text, ratio, least)
    rows = docs.select(F.struct("*").alias("row"), F.col(host).alias("own"), F.col(text).alias("t")).join(often, F.col("own").eqNullSafe(F.col("h")), "left")
    lines, boiler = F.split("t", "\n"), F.col("often")
    kept = F.filter(lines, lambda x: (_trimmed(x) == "") | ~F.array_contains(boiler, _key(x)))
    rows = rows.select("row", "t", lines.alias("lines"), F.when(boiler.isNotNull(), kept).otherwise(lines).alias("kept"))
    some = F.coalesce(F.size(F.filter("lines", lambda x: _trimmed(x) != "")), F.lit(0))
    n = [F.when(F.col("t").isNull(), 0).otherwise(x).cast("long").alias(c) for x, c in zip((some, F.size("lines") - F.size("kept")), counts)]
    clean = F.when(F.col("t").isNotNull(), F.array_join("kept", "\n")).alias(text)
    return rows.select(*(clean if c == text else F.col("row")[c].alias(c) for c in docs.columns if c not in counts), *n)
