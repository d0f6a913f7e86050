r"""Quality rules with a hashed n-gram log-likelihood ratio between trusted text and the raw corpus.

Single words and pairs of words are hashed into ``BUCKETS`` cells. Two multinomials over the cells are compared: the raw corpus, counted
over every document, and the trusted target, counted over documents labelled good (a bounded sample: the ``TRUSTED`` ids of least hash).
The target is smoothed by ``PRIOR`` counts spread like the corpus, so without trusted text every ratio is 0. A document's score is the sum
of its cells' log ratios over the number of its n-grams; it is kept if the score reaches ``THRESHOLD`` and the base rules hold. Counts are
whole numbers and each text is summed in its own order, so a run repeats exactly.

Everything is built-in columns. The table of ratios has ``BUCKETS`` rows whatever the input. Null texts have no words; without words the
score is 0 and the base rules fail; repeated rows count as rows; an empty table gives an empty result.
"""

from pyspark.sql import functions as F

from gavelwork.llm.common import BLANKS, stored

BUCKETS = 65_536
TRUSTED = 20_000
PRIOR = 1_000_000.0
THRESHOLD = -0.085
SYMBOLS = "[#*$%&|<>]"


def with_words(docs, text="text"):
    """``docs`` with ``words``: an array, empty for null texts."""
    return docs.withColumn("words", F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), BLANKS), ""))


def _grams(words):
    """Cells of all words and of all pairs of neighbours."""
    n = F.size(words)
    ones = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))
    pairs = F.when(n < 2, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.pmod(F.xxhash64(F.get(words, i - 1), F.get(words, i)), F.lit(BUCKETS)).cast("int")))
    return F.concat(ones, pairs)


def trusted_ids(labels):
    """At most ``TRUSTED`` ids labelled good and not toxic, by least hash."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    ids = good.select(F.col("doc_id").alias("trusted_id")).distinct()
    return stored(ids.orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(TRUSTED), "trusted")


def log_ratios(docs, trusted, text="text"):
    """List of ``BUCKETS`` smoothed log ratios."""
    rows = docs.join(F.broadcast(trusted), F.col("doc_id") == F.col("trusted_id"), "left")
    cells = with_words(rows, text).select(F.col("trusted_id").isNotNull().alias("t"), F.explode(_grams(F.col("words"))).alias("cell"))
    found = stored(cells.groupBy("cell").agg(F.count("*").alias("raw"), F.count_if("t").alias("good")), "cells")
    n = found.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")).first()
    raw = F.col("raw") / F.lit(float(n["raw"] or 1))
    rows = found.select("cell", F.log((F.col("good") + PRIOR * raw) / (n["good"] + PRIOR) / raw).alias("w")).collect()
    out = [0.0] * BUCKETS
    for r in rows:
        out[r["cell"]] = r["w"]
    return out


def judged(docs, labels, text="text", threshold=THRESHOLD):
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr of every row."""
    ratios = log_ratios(docs, trusted_ids(labels), text)
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    words, n = F.col("words"), F.col("n_words")
    rows = with_words(docs.select("doc_id", F.col(text).alias("text"))).withColumn("n_words", F.size(words).cast("long"))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    windows = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), (n - 3).cast("int")), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))
    rows = rows.select(
        "doc_id", "n_words", F.char_length(F.concat_ws("", words)).cast("long").alias("word_chars"),
        F.coalesce(F.size(F.regexp_extract_all("text", F.lit(SYMBOLS), F.lit(0))), F.lit(0)).cast("long").alias("n_symbols"),
        lines.alias("lines"), windows.alias("windows"), _grams(words).alias("grams"))
    # windows with their place, sorted only where a text has any twice: equal ones are then neighbours
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.when(twice, F.sort_array(F.transform("windows", lambda k, i: F.struct(k.alias("k"), i.alias("i")))))
    rows = rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        placed.alias("placed"), F.aggregate("grams", F.lit(0.0), lambda acc, g: acc + F.get(table, g)).alias("sum"), F.size("grams").alias("n_grams"))
    same = lambda e, i, d: F.coalesce(F.get(F.col("placed"), i + d)["k"] == e["k"], F.lit(False))
    again = F.filter("placed", lambda e, i: same(e, i, -1) | same(e, i, 1))
    rows = rows.withColumn("at", F.sort_array(F.transform(again, lambda e: e["i"])))
    steps = F.transform("at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get(F.col("at"), i + 1) - p, F.lit(3))))
    covered = F.coalesce(F.aggregate(steps, F.lit(0), lambda acc, x: acc + x), F.lit(0)).cast("long")
    rows = rows.withColumns({"n_repeat_words": covered, "llr": F.when(F.col("n_grams") > 0, F.col("sum") / F.col("n_grams")).otherwise(0.0)})
    failed = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("llr") >= threshold)).alias("kept"), "llr")
