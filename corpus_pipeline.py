"""Corpus pipeline: language, boilerplate lines, near duplicates, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's ``docs``. All but
the last return the columns of ``docs``. Extra columns pass through; empty tables pass through as empty ones.
"""

import public_tokenizers
from pyspark.sql import functions as F

from gavelwork.llm import cross_parse, flow_mix, jaccard_join, line_frequency, packing
from gavelwork.llm.common import stored

#: Phrases per symbol above which a text is taken for no language that was learned; natural text needs about 0.2.
STRANGE = 0.6


def language(spark, docs, sf_dir):
    """Rejects texts without a letter and texts whose best language parses them no better than noise; ``lang`` becomes the predicted one.

    Where no document is labelled nothing can be rejected but texts without letters.
    """
    return cross_parse.accepted(docs, STRANGE)


def lines(spark, docs, sf_dir):
    """Drops boilerplate lines of each source; ``n_chars`` follows the text.

    Near duplicates are still in ``docs``: equal texts of a source count as one page, else a large group of copies would lose all of its lines.
    """
    out = line_frequency.cleaned(docs, counts=("_n_lines", "_n_removed"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def near_duplicates(spark, docs, sf_dir):
    """Keeps of each component of five-word similarity 0.8 the document of smallest id, and of rows equal in id and text one."""
    return jaccard_join.one_of_each(docs, width=5, percent=80).select(docs.columns)


def mix(spark, docs, sf_dir):
    """Takes each document as often as the mix does: a document taken twice is two rows."""
    return flow_mix.repeated(docs)


def pack(spark, docs, sf_dir):
    """Token sequences of all that is left."""
    return packing.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("language id", language), ("line dedup", lines), ("ngram jaccard join", near_duplicates), ("source mixing", mix), ("best-fit packing", pack)]

#: No SQL for suffix automata, connected components and tokenizers; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
