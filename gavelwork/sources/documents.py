"""Document inputs: directories, text batches, image manifests, golden suites and corpora."""

from functools import reduce

from pyspark.sql import functions as F


def read_directory(spark, path, country, extensions=("txt",)):
    """One document per file below a folder, allowed extensions only; empty files go to the second, quarantined frame."""
    glob = "*.{" + ",".join(extensions) + "}"
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    d = raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.lit(country).alias("country"))
    return split_batch(d)


def split_batch(df, text="text"):
    """(usable documents, errors): a text that is empty after trimming is an error row, never a failed job."""
    from gavelwork.functions.text import strip_all
    empty = F.coalesce(strip_all(F.col(text)) == "", F.lit(True))
    return df.filter(~empty), df.filter(empty).withColumn("error", F.lit("texto vacio"))


def batch_summary(df, text="text"):
    from gavelwork.functions.text import strip_all
    empty = F.coalesce(strip_all(F.col(text)) == "", F.lit(True))
    return df.groupBy("country").agg(F.count("*").alias("total"), F.count_if(~empty).alias("ok"), F.count_if(empty).alias("errores"))


# fixed values: words of a file name that tell the half of the page
TOP_WORDS = ["superior", "upper", "top", "sup", "arriba"]
BOTTOM_WORDS = ["inferior", "lower", "bottom", "inf", "abajo"]


def name_position(name):
    parts = F.split(F.lower(F.regexp_replace(name, r"\.[^.]*$", "")), "[^a-z0-9]")

    def has(words):
        return F.exists(parts, lambda p: p.isin(words))

    return F.when(has(TOP_WORDS), "top").when(has(BOTTOM_WORDS), "bottom").otherwise("full")


def pair_images(manifest):
    """Pages of one upload from (upload, orden, file): halves named top / bottom pair by rank, else odd = top and even = bottom.

    Unnamed files of an upload that names halves are whole pages and come first; an odd leftover is a partial page.
    """
    from pyspark.sql import Window as W
    d = manifest.withColumn("pos", name_position(F.col("file")))
    named = d.groupBy("upload").agg(F.max((F.col("pos") != "full").cast("int")).alias("named"), F.count_if(F.col("pos") == "full").alias("fulls"))
    d = d.join(named, "upload")
    rank = F.row_number().over(W.partitionBy("upload", "named", F.when(F.col("named") == 1, F.col("pos"))).orderBy("orden"))
    d = d.withColumn("rk", rank)
    page = (F.when(F.col("named") == 0, F.floor((F.col("rk") + 1) / 2)).when(F.col("pos") == "full", F.col("rk")).otherwise(F.col("fulls") + F.col("rk")))
    pos = F.when((F.col("named") == 0) & (F.col("rk") % 2 == 1), "top").when(F.col("named") == 0, "bottom").otherwise(F.col("pos"))
    g = d.select("upload", page.cast("bigint").alias("pagina"), pos.alias("pos"), "file").groupBy("upload", "pagina").agg(
        F.max(F.when(F.col("pos") == "top", F.col("file"))).alias("top"), F.max(F.when(F.col("pos") == "bottom", F.col("file"))).alias("bottom"),
        F.max(F.when(F.col("pos") == "full", F.col("file"))).alias("full"))
    return g.withColumn("parcial", F.col("full").isNull() & (F.col("top").isNull() | F.col("bottom").isNull()))


KNOWN_GOLDEN = ["expediente", "demandante", "demandado", "base", "finca_matr"]


def golden_records(df, column="json"):
    """Records of nested golden suites; unknown keys go to ``extra`` and the id defaults to the docket."""
    suite = "struct<id:string,pais:string,expected_count:int,expected_avisos:array<map<string,string>>>"
    s = df.select(F.explode(F.from_json(column, f"struct<test_suites:array<{suite}>>")["test_suites"]).alias("s"))
    r = s.select(F.col("s.id").alias("suite"), F.col("s.pais").alias("pais"), F.col("s.expected_count").alias("expected_count"), F.explode("s.expected_avisos").alias("m"))
    known = [F.try_element_at("m", F.lit(k)).alias(k) for k in KNOWN_GOLDEN]
    extra = F.map_filter("m", lambda k, x: ~k.isin(*KNOWN_GOLDEN, "id"))
    return r.select("suite", "pais", "expected_count", F.coalesce(F.try_element_at("m", F.lit("id")), F.try_element_at("m", F.lit("expediente"))).alias("id"),
                    *known, extra.alias("extra"))


def read_golden(spark, path):
    return golden_records(spark.read.text(path, wholetext=True).withColumnRenamed("value", "json"))


def corpus(sources):
    """Tagged union of (frame, country, source); Panama documents order first."""
    parts = [d.select(F.col("document_id").cast("string").alias("document_id"), F.lit(c).alias("country"), F.lit(s).alias("source"), "text") for d, c, s in sources]
    return reduce(lambda a, b: a.unionByName(b), parts).withColumn("orden_pais", F.when(F.col("country") == "PA", 0).otherwise(1))
