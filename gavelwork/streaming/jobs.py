"""Structured Streaming jobs over the same schemas as the batch tables."""

import os
import uuid

from pyspark.sql import functions as F

from gavelwork.session import checkpoint_dir

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
DOCUMENTS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def work_folder(spark, name):
    """A new folder for outputs and checkpoints of one run, in the shared checkpoint location."""
    return os.path.join(checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex}")


def event_stream(spark, sf_dir):
    """The events table as a stream; the time column is made a real timestamp so that it can carry a watermark."""
    s = spark.readStream.schema(EVENTS).parquet(f"{sf_dir}/events*.parquet")
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def run_append(spark, df, name):
    """Run to the end of the available input into a Parquet sink and read it back."""
    out = work_folder(spark, name)
    q = df.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/data")


def run_update(spark, df, name, keys):
    """Run an update-mode aggregate; each batch appends its changed rows and the last version of a key counts.

    A batch writes to its own folder, so that a repeated batch replaces its earlier attempt.
    """
    out = work_folder(spark, name)

    def sink(batch, batch_id):
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/data/run={batch_id}")

    q = df.writeStream.foreachBatch(sink).option("checkpointLocation", f"{out}/cp").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(f"{out}/data")
    rest = [c for c in df.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("r"))
    return last.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def ingest(spark, sf_dir, minimum=20):
    """Document stream split into accepted and quarantined outputs; a bad document never stops the stream."""
    from gavelwork.functions.text import strip_all
    from gavelwork.operators.search import looks_like_auction
    s = spark.readStream.schema(DOCUMENTS).parquet(f"{sf_dir}/documents*.parquet")
    out = work_folder(spark, "ingest")
    n = F.length(strip_all(F.col("text")))
    tagged = s.select("doc_id", n.alias("largo"), F.when(n < minimum, "cuarentena").otherwise("aceptado").alias("estado"),
                      looks_like_auction(F.col("text")).alias("indicios"))

    def sink(batch, batch_id):
        batch.write.mode("overwrite").partitionBy("estado").parquet(f"{out}/data/run={batch_id}")

    q = tagged.writeStream.foreachBatch(sink).option("checkpointLocation", f"{out}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/data").select("doc_id", "largo", "estado", "indicios")


def exact_duplicates_dropped(spark, sf_dir, keys=("user_id", "event_type"), delay="60 days"):
    """First event of each key within the watermark: the memory of seen notices kept between runs."""
    s = event_stream(spark, sf_dir).withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))
    return run_append(spark, s.select(*keys), "dedup")


def duplicate_memory(spark, sf_dir):
    """Two-level duplicate state per key (first, repeats, repeats with the same value) that survives restarts."""
    s = event_stream(spark, sf_dir)
    g = s.groupBy("user_id", "event_type").agg(F.count("*").alias("vistos"), F.min("event_id").alias("primero"),
                                               F.min("value").alias("v_min"), F.max("value").alias("v_max"))
    level = F.when(F.col("vistos") == 1, "UNIQUE").when(F.col("v_min") == F.col("v_max"), "DUPLICATED").otherwise("LIKELY_DUPLICATED")
    d = g.select("user_id", "event_type", "vistos", "primero", level.alias("nivel"))
    return run_update(spark, d, "memory", ["user_id", "event_type"])


def republications(spark, sf_dir, days=3, delay="3 days"):
    """Publications of one key chained while the next comes within three days; the last one stands. Closed chains only."""
    s = event_stream(spark, sf_dir).withWatermark("ts", delay)
    g = s.groupBy(F.session_window("ts", f"{days} days"), "user_id", "event_type").agg(
        F.count("*").alias("publicaciones"), F.max_by("event_id", "ts").alias("vigente"))
    d = g.select("user_id", "event_type", F.col("session_window.start").alias("inicio"), "publicaciones", "vigente")
    return run_append(spark, d, "republication")


def replies_to_requests(spark, sf_dir, minutes=60):
    """Replies joined to the requests of the same notice made in the hour before (stream-stream interval join)."""
    req = event_stream(spark, sf_dir).filter("event_type = 'view'").select(F.col("user_id").alias("aviso_id"), F.col("event_id").alias("pedido"), F.col("ts").alias("t0")).withWatermark("t0", "2 hours")
    rep = event_stream(spark, sf_dir).filter("event_type = 'purchase'").select(F.col("user_id").alias("r_id"), F.col("event_id").alias("respuesta"), F.col("ts").alias("t1")).withWatermark("t1", "2 hours")
    j = req.join(rep, F.expr(f"aviso_id = r_id AND t1 >= t0 AND t1 <= t0 + INTERVAL {minutes} MINUTES"))
    return run_append(spark, j.select("aviso_id", "pedido", "respuesta"), "replies")


def correction_counts(spark, sf_dir):
    """Running count and last time of each correction kind."""
    s = event_stream(spark, sf_dir)
    g = s.groupBy("event_type", (F.col("event_id") % 12).alias("valor")).agg(F.count("*").alias("n"), F.max("ts").alias("ultima"))
    return run_update(spark, g, "corrections", ["event_type", "valor"])


def rule_counters(spark, sf_dir):
    """Usage and success of each rule with its expiry flag (five uses or more and accuracy under 0.7), partial-aggregated per batch."""
    s = event_stream(spark, sf_dir)
    g = s.groupBy(F.col("user_id").alias("rule_id")).agg(F.count("*").alias("usos"), F.count_if(F.col("event_type") != "error").alias("aciertos"))
    d = g.withColumn("expirada", (F.col("usos") >= 5) & (F.col("aciertos") / F.col("usos") < 0.7))
    return run_update(spark, d, "rules", ["rule_id"])


def windowed_events(spark, sf_dir, size="1 hour", slide=None, delay="10 minutes"):
    """Events per agent over tumbling (or sliding) windows; closed windows only."""
    s = event_stream(spark, sf_dir).withWatermark("ts", delay)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = s.groupBy(w, "event_type").agg(F.count("*").alias("n"))
    d = g.select(F.col("window.start").alias("inicio"), "event_type", "n")
    return run_append(spark, d, "window")


def user_sessions(spark, sf_dir, gap="30 minutes", delay="10 minutes"):
    """Bursts of calls per user; closed sessions only."""
    s = event_stream(spark, sf_dir).withWatermark("ts", delay)
    g = s.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    d = g.select("user_id", F.col("session_window.start").alias("inicio"), "n")
    return run_append(spark, d, "session")
