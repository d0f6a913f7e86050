"""Fill-in-middle transformation over content-defined chunks.

A text is cut into chunks where a rolling hash of its last 32 bytes is zero in its top bits, so that a passage that many documents share
gives the same chunks wherever it stands. The summary of a chunk (words, whether it begins and ends inside a word, characters) is kept in a
bounded cache under the chunk's own bytes: two chunks share a summary only if they are equal. Summaries of neighbours add up, a word across
a chunk edge counts once; the running counts name the chunk in which a cut falls, and only that chunk is searched for the place.

The draws follow from a seed and the document id alone. Python sees the text and two drawn numbers and gives back the token count and two
places; forms, outputs and the restored text are built-in columns.

Null texts are empty; empty texts are plain with no tokens; a null id draws as an empty string; rows that repeat are transformed alike; an
empty table gives an empty result. The columns ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` take the place of columns
of these names, all others pass through.
"""

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType, StructField, StructType

from gavelwork.llm.common import bounded_batches, released

WINDOW = 32
BITS = 9
LEAST, MOST = 64, 8192
BLOCK = 1 << 20
CACHE_BYTES = 16 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BLANK = frozenset(b"\x20\x09\x0a\x0b\x0c\x0d")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
CONTINUED = bytes(range(0x80, 0xC0))
CUT = ["n", "first", "second"]

_TABLE = np.random.default_rng(7).integers(1, 1 << 32, 256, dtype=np.uint32)
_FACTOR = np.array([0x9E3779B1], dtype=np.uint32)


def edges(raw):
    """Ends of the chunks of ``raw``: rolling-hash places at least LEAST apart, with none further apart than MOST."""
    found = []
    for at in range(0, len(raw), BLOCK):
        before = min(at, WINDOW)
        h = _TABLE[np.frombuffer(raw, np.uint8, min(BLOCK, len(raw) - at) + before, at - before)]
        step, factor = 1, _FACTOR
        while step < WINDOW:  # h covers `step` bytes, then twice as many
            h[step:] += h[:-step] * factor
            step, factor = 2 * step, factor * factor
        found.append(np.flatnonzero(h[before:] < np.uint32(1 << (32 - BITS))) + at + 1)
    places = np.concatenate(found).tolist() if found else []
    out, last, k = [], 0, 0
    while last < len(raw):
        k = bisect_left(places, last + LEAST, k)
        last = min(places[k] if k < len(places) else len(raw), last + MOST, len(raw))
        out.append(last)
    return out


class Chunks:
    """Summaries by content, in two generations of bounded size: the older one goes when the younger is full."""

    def __init__(self):
        self.young, self.old, self.held = {}, {}, 0

    def summary(self, chunk):
        """(words, begins inside a word, ends inside a word, characters)."""
        got = self.young.get(chunk)
        if got is None:
            got = self.old.get(chunk) or (len(chunk.split()), chunk[0] not in BLANK, chunk[-1] not in BLANK, len(chunk.translate(None, CONTINUED)))
            if self.held >= CACHE_BYTES:
                self.old, self.young, self.held = self.young, {}, 0
            self.young[chunk] = got
            self.held += len(chunk) + 200
        return got

    def cuts(self, raw, h1, h2):
        """(tokens, characters before the earlier cut, before the later cut); no places where ``h1`` is None."""
        if not raw:
            return 0, None if h1 is None else 0, None if h1 is None else 0
        ends = edges(raw)
        starts = [0, *ends[:-1]]
        of = [self.summary(raw[a:b]) for a, b in zip(starts, ends)]
        goes_on = [False, *(x[2] and y[1] for x, y in zip(of, of[1:]))]
        words = list(accumulate(x[0] - c for x, c in zip(of, goes_on)))
        n = words[-1] + (not of[-1][2])
        if h1 is None:
            return n, None, None
        chars = [0, *accumulate(x[3] for x in of)]
        return n, *(self._place(raw, k, starts, ends, goes_on, words, chars) for k in sorted((h1 % (n + 1), h2 % (n + 1))))

    def _place(self, raw, unit, starts, ends, goes_on, words, chars):
        """Characters up to the end of token number ``unit``."""
        if unit == 0:
            return 0
        if unit > words[-1]:
            return chars[-1]
        i = bisect_left(words, unit)
        nth = unit - (words[i - 1] if i else 0) + goes_on[i]
        found = WORD.finditer(raw, starts[i], ends[i])
        end = next(m for k, m in enumerate(found, 1) if k == nth).end()
        while end == ends[i] and i + 1 < len(ends) and goes_on[i + 1]:
            i += 1
            end = WORD.match(raw, starts[i], ends[i]).end()
        return chars[i] + len(raw[starts[i] : end].translate(None, CONTINUED))


@arrow_udf(StructType([StructField(k, LongType()) for k in CUT]))
def cut_places(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    chunks = Chunks()
    for texts, one, two in released(batches):
        rows = [chunks.cuts(t.as_py(), a, b) for t, a, b in zip(texts.cast(pa.binary()), one.to_pylist(), two.to_pylist())]
        yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], CUT)


def transformed(docs, seed=42, rate=50, spm=80, doc_id="doc_id", text="text"):
    """``docs`` with n, form (plain, psm or spm), prefix_chars, middle_chars and output.

    Of 100 documents ``rate`` are transformed, of 100 of these ``spm`` with the suffix first.
    """
    bounded_batches(docs.sparkSession)
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    h1, h2, h3, h4 = (F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4))
    plain = (whole == "") | whole.contains(PREFIX) | whole.contains(SUFFIX) | whole.contains(MIDDLE) | (h3 % 100 >= rate)
    form = F.when(plain, "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    own = [c for c in docs.columns if c not in ("n", "form", "prefix_chars", "middle_chars", "output")]
    drawn = docs.select(F.struct(own).alias("_row"), whole.alias("_t"), form.alias("form"), F.when(~plain, h1).alias("_h1"), F.when(~plain, h2).alias("_h2"))
    placed = drawn.withColumn("_cut", cut_places("_t", "_h1", "_h2"))
    a, b = F.col("_cut.first"), F.col("_cut.second")
    t = F.col("_t")
    prefix, middle, suffix = F.substring(t, F.lit(1), a), F.substring(t, a + 1, b - a), F.substring(t, b + 1, F.char_length(t))
    output = F.when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    output = output.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)).otherwise(t)
    return placed.select("_row.*", F.col("_cut.n").alias("n"), "form", a.alias("prefix_chars"), (b - a).alias("middle_chars"), output.alias("output"))


def restored(output, form):
    """Column of the text that ``output`` was made from: the marks stand at its start and between its parts."""
    second = F.when(form == "spm", F.lit(PREFIX)).otherwise(F.lit(SUFFIX))
    i, j, size = F.instr(output, second), F.instr(output, F.lit(MIDDLE)), F.char_length(output)
    one, two, middle = F.substring(output, F.lit(4), i - 4), F.substring(output, i + 3, j - i - 3), F.substring(output, j + 3, size)
    return F.when(form == "plain", output).when(form == "spm", F.concat(two, middle, one)).otherwise(F.concat(one, middle, two))
