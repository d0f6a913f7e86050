"""Connected components of a table of links, by alternating large and small stars."""

from pyspark.sql import functions as F

from gavelwork.llm.common import stored


def _mark(edges):
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]


def components(links):
    """(node, root) of every node of ``links`` (a, b): the root is the smallest node that links reach.

    Each round connects a node's larger neighbours, then its smaller ones, to the least of them; stars are reached in a number of rounds
    that grows with the logarithm of the longest path. A round is stored, and nothing but its row count and a hash comes to the driver.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("w")).agg(F.least(F.col("w"), F.min("v")).alias("m"))
        large = stored(both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        inner = large.join(least, F.col("u") == F.col("w")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = stored(inner.select("e.u", "e.v").where("u <> v").distinct(), "small")
        last, mark = mark, _mark(edges)
        if mark == last:
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
