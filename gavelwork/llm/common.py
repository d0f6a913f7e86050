"""Helpers shared by the corpus operators: tables between jobs, gapless numbering, packed numpy columns."""

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from gavelwork.session import shared_folder

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def stored(df, name, **options):
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors, has a known size."""
    path = shared_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_BYTES = 8 << 20


def bounded_batches(spark):
    """Texts go to Python in batches of ``BATCH_BYTES`` at most. The setting stays in the session: plans are made after an operator returns.

    It bounds buffers only; results are the same under any setting.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def released(batches):
    """The batches; after the last one the worker gives freed memory back, since it serves other stages next."""
    yield from batches
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def sliced(batches, size=BATCH_BYTES):
    """The batches in slices of about ``size`` bytes of text, so that what a worker makes of a slice is bounded whatever the rows weigh."""
    for b in released(batches):
        weight = np.ones(b.num_rows, np.int64)
        for c in b.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
                weight += pc.binary_length(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto, at = np.cumsum(weight), 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, side="right")))
            yield b.slice(at, end - at)
            at = end


_RESIDENT = {}


def resident(key, make):
    """``make()``, kept in the worker as long as no other operator's object takes its place: workers serve many stages."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def located(df):
    """Adds ``_pid`` and ``_row``: the partition a row was read in and its place there. Store before relying on both."""
    at = F.monotonically_increasing_id()
    return df.withColumns({"_pid": F.shiftright(at, 33).cast("int"), "_row": at.bitwiseAND((1 << 33) - 1)})


def text_hash(text="text"):
    """Tells rows of one id apart by their text."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def repeated_ids(docs, id_col="doc_id"):
    """Stored table ``_id`` of the ids that several rows have: usually empty, so that later joins with it are cheap."""
    twice = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1")
    return stored(twice.select("_id"), "twice")


def one_row_per(docs, keys, twice):
    """``docs`` with one row of every combination of ``keys``; only rows whose first key is in ``twice`` are regrouped."""
    same = F.col(keys[0]) == F.col("_id")
    return docs.join(twice, same, "left_anti").unionByName(docs.join(twice, same, "left_semi").dropDuplicates(keys))


CLEAR_BITS = 24


def without(rows, keys, gone):
    """``rows`` without those whose ``keys`` (a list of columns) stand in ``gone`` (a stored table of the same columns, each once).

    A bit table of at most 2 ** (CLEAR_BITS - 6) words is broadcast and clears most rows; only what it cannot clear is exchanged, so wide rows
    stay where they are however long the list is.
    """
    h = F.pmod(F.xxhash64(*keys), F.lit(1 << CLEAR_BITS))
    words = gone.select(h.alias("_h")).groupBy(F.shiftright("_h", 6).alias("_w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(_h & 63 AS INT))")).alias("_bits"))
    asked = rows.withColumn("_h", h)
    met = asked.join(F.broadcast(words), F.shiftright("_h", 6) == F.col("_w"), "left").withColumn("_clear", F.expr("coalesce(shiftright(_bits, CAST(_h & 63 AS INT)) & 1, 0) = 0"))
    named = gone.select(*[F.col(k).alias(f"_gone_{i}") for i, k in enumerate(keys)])
    same = [F.col(k) == F.col(f"_gone_{i}") for i, k in enumerate(keys)]
    return met.where("_clear").select(rows.columns).unionByName(met.where("NOT _clear").select(rows.columns).join(named, same, "left_anti"))


def _counter(key, out):
    def run(batches):
        seen = {}
        for b in batches:
            codes = b.column(b.schema.get_field_index(key)).dictionary_encode(null_encoding="encode")
            uniques = codes.dictionary.to_pylist()
            idx = np.asarray(codes.indices.to_numpy(zero_copy_only=False), dtype=np.int64)
            order = np.argsort(idx, kind="stable")
            counts = np.bincount(idx, minlength=len(uniques))
            starts = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)
            base = np.array([seen.get(u, 0) for u in uniques], dtype=np.int64)
            local = np.empty(len(idx), dtype=np.int64)
            local[order] = np.arange(len(idx)) - np.repeat(starts, counts)
            for u, c in zip(uniques, counts.tolist()):
                seen[u] = seen.get(u, 0) + c
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(local + base[idx] if len(idx) else local)], names=[*b.schema.names, out])

    return run


def numbered(df, key, out):
    """Gapless numbers from 0 within each value of ``key``, in any order, without gathering a value's rows in one task.

    Every task counts on its own; the counts of a (task, value) are summed up before it and added. ``df`` is stored once.
    """
    pid, local, base = "_pid", "_local", "_base"
    src = df.withColumn(pid, F.spark_partition_id())
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields)
    kept = stored(src.mapInArrow(_counter(key, local), f"{fields}, {local} bigint"), "numbered")
    counts = kept.groupBy(pid, key).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col(pid).alias("_p"), F.col(key).alias("_k"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(base))
    joined = kept.join(bases, (F.col(pid) == F.col("_p")) & F.col(key).eqNullSafe(F.col("_k")), "left")
    return joined.withColumn(out, F.col(local) + F.coalesce(F.col(base), F.lit(0))).drop(pid, local, base, "_p", "_k")
