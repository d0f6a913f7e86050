"""Keyed state over notices: the duplicate memory and the republication window.

Both take lots as a stream whose checkpoint says what has been taken, and keep a few numbers per key, never the notices. The state is a table
that each batch reads and adds to in its own folder, so that a repeated batch replaces its earlier attempt. A batch meets the state in one
exchange by key and one pass over sorted rows of a few numbers, so its cost follows the rows, not calls to a store for every key.
"""

from itertools import combinations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gavelwork.operators.dedup import DUPLICATE_KEYS
from gavelwork.streaming.jobs import work_folder

DAY = 86_400_000
MEMORY = "k string, v string, id long, first long, before long, newest boolean, seen timestamp"


def key_entries(notices):
    """(k, v, id): one row per key that a notice has, and per pair of them."""
    val = {k: F.col(k).cast("string") for k in DUPLICATE_KEYS}
    ones = [F.struct(F.lit(a).alias("k"), val[a].alias("v")) for a in DUPLICATE_KEYS]
    twos = [F.struct(F.lit(f"{a}+{b}").alias("k"), F.when(val[a].isNotNull() & val[b].isNotNull(), F.concat_ws("\u0001", val[a], val[b])).alias("v")) for a, b in combinations(DUPLICATE_KEYS, 2)]
    return notices.select("id", F.explode(F.filter(F.array(*ones, *twos), lambda x: x["v"].isNotNull())).alias("b")).select("b.k", "b.v", "id")


def _levels(entries, notices):
    """Level and partner of each notice from its keys: a pair of keys answers with the first earlier notice, a single key with the one just before."""
    two = F.col("k").contains("+")
    found = entries.filter("before IS NOT NULL").groupBy("id").agg(F.min(F.when(two, F.col("first"))).alias("dup"), F.max(F.when(~two, F.col("before"))).alias("likely"))
    level = F.when(F.col("dup").isNotNull(), "DUPLICATED").when(F.col("likely").isNotNull(), "LIKELY_DUPLICATED").otherwise("UNIQUE")
    return notices.select("id").join(found, "id", "left").select("id", level.alias("nivel"), F.coalesce("dup", "likely").alias("matched_id"))


def _to_end(stream, sink, checkpoint):
    """Give a stream's batches to ``sink`` up to the end of the input there is."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class DuplicateMemory:
    """Levels of notices against all earlier ones, over any number of runs.

    ``run(lot)`` takes the next lot of notices, each newer (by id) than those before, and gives their levels; the checkpoint and the memory
    carry on from run to run. ``exported()`` is the memory as a table (k, v, first, last); another memory starts from it with ``loaded``.
    ``ttl_days`` forgets keys that long without a notice.
    """

    def __init__(self, spark, name="memory", loaded=None, ttl_days=None):
        self.spark, self.loaded, self.ttl, self.folder = spark, loaded, ttl_days, work_folder(spark, name)
        self.started = False

    def _entries(self):
        """Entries of all batches: id, the first notice of the key, the one before, and whether it was the newest of its key in the batch."""
        return self.spark.read.schema(f"{MEMORY}, batch long").parquet(f"{self.folder}/memory")

    def _known(self):
        known = self._entries().filter("newest")
        return known.filter(F.col("seen") > F.current_timestamp() - F.expr(f"INTERVAL {self.ttl} DAYS")) if self.ttl else known

    def _start(self):
        old = self.spark.createDataFrame([], "k string, v string, first long, last long") if self.loaded is None else self.loaded
        old.selectExpr("k", "v", "last AS id", "first", "CAST(NULL AS BIGINT) AS before", "true AS newest", "current_timestamp() AS seen").write.mode("overwrite").parquet(
            f"{self.folder}/memory/batch=-1")
        self.started = True

    def run(self, lot):
        if not self.started:
            self._start()
        lot.write.mode("append").parquet(f"{self.folder}/in")
        taken = []

        def sink(batch, batch_id):
            past = self._known().filter(F.col("batch") < batch_id).select("k", "v", "id", "first", "batch")
            new = key_entries(batch).select("k", "v", "id", F.col("id").alias("first"), F.lit(batch_id).cast("long").alias("batch"))
            w = W.partitionBy("k", "v").orderBy("batch", "id")
            d = past.unionByName(new).select("k", "v", "id", F.first("first").over(w).alias("first"), F.lag("id").over(w).alias("before"), F.lead("id").over(w).isNull().alias("newest"), "batch")
            d.filter(F.col("batch") == batch_id).drop("batch").withColumn("seen", F.current_timestamp()).write.mode("overwrite").parquet(f"{self.folder}/memory/batch={batch_id}")
            taken.append(batch_id)

        _to_end(self.spark.readStream.schema(lot.schema).parquet(f"{self.folder}/in"), sink, f"{self.folder}/cp")
        return _levels(self._entries().filter(F.col("batch").isin(taken)), lot)

    def exported(self):
        """The memory as it stands after the last run."""
        last = self._known().groupBy("k", "v").agg(F.max_by(F.struct("first", "id"), "batch").alias("s"))
        return last.select("k", "v", "s.first", F.col("s.id").alias("last"))


OUTCOME = "id long, clave string, resultado string, otro_id long, fecha long, base string"


def standing(days):
    """Outcomes of rows sorted by clave, past and date: what stands at the end of a clave comes out last, without an outcome."""
    window = days * DAY

    def fold(batches):
        import pyarrow as pa

        names = ["id", "clave", "resultado", "otro_id", "fecha", "base"]
        types = pa.schema([("id", pa.int64()), ("clave", pa.string()), ("resultado", pa.string()), ("otro_id", pa.int64()), ("fecha", pa.int64()), ("base", pa.string())])
        at, now = None, None
        for part in batches:
            out = []
            for clave, fecha, i, base in zip(*(part.column(c).to_pylist() for c in ("clave", "fecha", "id", "base"))):
                new = (i, fecha, base)
                if now is None:
                    at, now = clave, new
                elif clave != at:
                    out.append((now[0], at, None, None, now[1], now[2]))
                    at, now = clave, new
                elif fecha - now[1] > window:
                    out.append((now[0], at, "vigente", None, None, None))
                    now = new
                elif None not in (base, now[2]) and base != now[2]:
                    out.append((i, at, "duplicado_sospechoso", now[0], None, None))
                elif (fecha, i) < (now[1], now[0]):
                    out.append((i, at, "reemplazado", now[0], None, None))
                else:
                    out.append((now[0], at, "reemplazado", i, None, None))
                    now = new
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], types)
        if now is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (now[0], at, None, None, now[1], now[2])))], types)

    return fold


class Republications:
    """Outcomes of publications (id, clave, fecha, base) that arrive in lots, over any number of runs.

    Within ``days`` of the publication in force the newest one takes its place (``reemplazado``); another base makes the newcomer a
    ``duplicado_sospechoso`` and leaves the one in force; an unknown base differs from none. What stays in force until the window is over is
    ``vigente``; ``open()`` lists what still may be replaced. A publication older than the watermark (newest date so far less ``days``) is
    set aside as ``tarde``, since the window it belongs to is closed.
    """

    def __init__(self, spark, days=3, name="republication"):
        self.spark, self.days, self.newest, self.runs, self.folder = spark, days, None, 0, work_folder(spark, name)
        spark.createDataFrame([], OUTCOME).write.parquet(f"{self.folder}/out/batch=-1")

    def _outcomes(self):
        return self.spark.read.schema(f"{OUTCOME}, batch long").parquet(f"{self.folder}/out")

    def _standing(self):
        """What is open after the last batch; the watermark bounds it to the dates of two windows."""
        d = self._outcomes()
        return d.filter(F.col("batch") == d.agg(F.max("batch")).first()[0]).filter("resultado IS NULL")

    def run(self, lot):
        lot = lot.select("id", "clave", F.col("fecha").cast("timestamp").alias("fecha"), F.col("base").cast("string").alias("base"))
        late = F.lit(False) if self.newest is None else F.col("fecha") <= F.lit(self.newest) - F.expr(f"INTERVAL {self.days} DAYS")
        path, taken = f"{self.folder}/in/run={self.runs}", []
        lot.withColumn("late", late).write.partitionBy("late").parquet(path)

        def sink(batch, batch_id):
            self.newest = max((x for x in (self.newest, batch.agg(F.max("fecha")).first()[0]) if x is not None), default=None)
            past = self._outcomes().filter((F.col("batch") == batch_id - 1) & F.col("resultado").isNull()).select("clave", F.lit(0).alias("src"), "fecha", "id", "base")
            d = past.unionByName(batch.select("clave", F.lit(1).alias("src"), F.unix_millis("fecha").alias("fecha"), "id", "base"))
            d = d.repartition("clave").sortWithinPartitions("clave", "src", "fecha", "id").mapInArrow(standing(self.days), OUTCOME)
            over = F.col("resultado").isNull() & (F.col("fecha") <= F.unix_millis(F.lit(self.newest)) - 2 * self.days * DAY)
            d.withColumn("resultado", F.when(over, "vigente").otherwise(F.col("resultado"))).write.mode("overwrite").parquet(f"{self.folder}/out/batch={batch_id}")
            taken.append(batch_id)

        # the folders of the runs so far are one stream; late ones stay outside of it
        _to_end(self.spark.readStream.schema(lot.schema).parquet(f"{self.folder}/in/run=*/late=false"), sink, f"{self.folder}/cp")
        stored = self.spark.read.schema(f"{lot.schema.simpleString()[7:-1].replace(':', ' ')}, late boolean").parquet(path)
        self.runs += 1
        aside = stored.where("late").select("id", "clave", F.lit("tarde").alias("resultado"), F.lit(None).cast("long").alias("otro_id"))
        outcomes = self._outcomes().filter(F.col("batch").isin(taken) & F.col("resultado").isNotNull())
        return outcomes.select("id", "clave", "resultado", "otro_id").unionByName(aside)

    def open(self):
        """id and clave of publications in force whose window is not over."""
        return self._standing().select("id", "clave")
