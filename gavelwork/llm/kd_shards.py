"""K-d tree sharding: a table is split at weighted medians along its widest metadata dimension until leaves reach the target bytes.

A point is a row; its weight is its size. The dimensions are numbers of the row's group (rows of equal text): logarithm of the size, place
of the smallest source among all sources and of the smallest language among all languages. A node is cut along the dimension whose values spread most, measured over the whole
table's range, at the weighted median of (value, group hash). The order is total over groups, so copies stay in one shard; only a group
heavier than ``HEAVY`` of a target leaf may be cut, between its rows, or else shards could not be near equal. Medians are found by
histograms of at most 2 ** ``BITS`` cells a node and round, so the driver sees a bounded number of sums, never rows.

Null texts weigh as empty ones, null sources and languages have a code of their own, repeated rows are rows, an empty table gives an
empty result. The number of leaves is a power of two.
"""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from gavelwork.llm.common import numbered, stored

BITS = 12
HEAVY = 0.05
DIMS = ("d_size", "d_source", "d_lang")


def points(docs, id_col="doc_id", text_col="text"):
    """doc_id, size, text_crc32, group hash and dimensions of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    code = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("￿")) if c in docs.columns else F.lit("")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("grp"), code("source").alias("s"), code("lang").alias("l"))
    return stored(rows, "points")


def _ranks(names):
    """name, rank: places of distinct names in their order, counted per task of a range sort and summed up."""
    at = F.monotonically_increasing_id()
    kept = stored(names.distinct().orderBy("name").select("name", F.shiftright(at, 33).alias("p"), at.bitwiseAND((1 << 33) - 1).alias("i")), "names")
    counts = kept.groupBy("p").agg(F.count("*").alias("n"))
    before = counts.select(F.col("p").alias("q"), F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return kept.join(before, F.col("p") == F.col("q")).select("name", (F.col("before") + F.col("i")).cast("double").alias("rank"))


def _dimensions(rows):
    """Groups with their weight and three numbers each; names become codes by their order."""
    groups = rows.groupBy("grp").agg(F.sum("size").alias("weight"), F.max("size").alias("one"), F.min("s").alias("s"), F.min("l").alias("l"))
    groups = stored(groups, "named")
    for c, d in (("s", "d_source"), ("l", "d_lang")):
        ranks = _ranks(groups.select(F.col(c).alias("name"))).withColumnRenamed("rank", d)
        groups = groups.join(ranks, F.col(c) == F.col("name")).drop("name")
    return groups.select("grp", "weight", F.log2("one").alias("d_size"), "d_source", "d_lang")


def _by_node(values):
    """Column with the value of each row's node."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("node")]


def _cuts(nodes, tolerance):
    """For every node of (node, key, weight) the greatest key of its first half, found by narrowing histograms."""
    ends = nodes.groupBy("node").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.sum("weight").alias("w")).collect()
    half = {r["node"]: r["w"] / 2 for r in ends}
    span = {r["node"]: (r["lo"], r["hi"], 0) for r in ends}
    cut = {}
    while span:
        low, high = _by_node({n: v[0] for n, v in span.items()}), _by_node({n: v[1] for n, v in span.items()})
        width = _by_node({n: -(-(hi - lo + 1) // (1 << BITS)) for n, (lo, hi, _) in span.items()})
        off = F.col("key") - low
        cells = nodes.where(F.col("node").isin(list(span)) & F.col("key").between(low, high)).groupBy("node", (off - off % width).alias("cell"))
        rows = cells.agg(F.sum("weight").alias("w"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
        hist = {}
        for r in rows:
            hist.setdefault(r["node"], []).append((r["lo"], r["hi"], r["w"]))
        for n, cells in hist.items():
            before = span[n][2]
            for lo, hi, w in sorted(cells):
                if before + w >= half[n]:
                    break
                before += w
            if w <= tolerance or lo == hi:
                cut[n] = hi if before + w - half[n] <= half[n] - before else lo - 1
                del span[n]
            else:
                span[n] = (lo, hi, before)
    return cut


def _heavy_parts(rows, groups, leaf, loose):
    """``rows`` with a part number: rows of a group above ``HEAVY`` of a leaf are dealt over parts of about ``loose`` of a leaf."""
    heavy = groups.where(F.col("weight") > HEAVY * leaf).select(F.col("grp").alias("g"), F.ceil(F.col("weight") / max(1.0, loose * leaf)).cast("long").alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.col("parts")), F.lit(0)).cast("long")
    return rows.join(stored(heavy, "heavy"), F.col("grp") == F.col("g"), "left").withColumn("part", part).drop("g", "parts")


def shards(rows, count=16, loose=0.002):
    """``rows`` of ``points`` with a shard number from 0; ``count`` is a power of two."""
    depth = int(math.log2(count))
    if 1 << depth != count:
        raise ValueError("the number of leaves must be a power of two")
    leaf = (rows.agg(F.sum("size").alias("w")).first()["w"] or 0) / count
    groups = stored(_dimensions(rows), "groups")
    dealt = stored(_heavy_parts(rows, groups, leaf, loose), "dealt")
    weights = dealt.groupBy("grp", "part").agg(F.sum("size").alias("weight"))
    pts = stored(weights.join(groups.drop("weight"), "grp").withColumn("node", F.lit(0).cast("long")), "kd")
    ends = pts.agg(*[F.struct(F.min(d).alias("lo"), (F.max(d) - F.min(d)).alias("span")).alias(d) for d in DIMS]).first()
    unit = {d: (F.col(d) - (ends[d]["lo"] or 0.0)) / (ends[d]["span"] or 1.0) for d in DIMS}
    # below the value's 20 bits: 32 of the group's hash, 10 of the part's, so that a group's parts stand together
    tie = F.shiftrightunsigned(F.xxhash64("grp"), 32) * 1024 + F.pmod(F.xxhash64("grp", "part"), F.lit(1024))
    for _ in range(depth if leaf else 0):
        spread = pts.groupBy("node").agg(*[(F.max(unit[d]) - F.min(unit[d])).alias(d) for d in DIMS]).collect()
        widest = {r["node"]: max(DIMS, key=lambda d: (r[d] or 0.0, d)) for r in spread}
        value = F.coalesce(*[F.when(_by_node(widest) == d, unit[d]) for d in DIMS])
        keyed = stored(pts.withColumn("key", F.floor(value * 1048575).cast("long") * (1 << 42) + tie), "keyed")
        edge = _by_node(_cuts(keyed.select("node", "key", "weight"), loose * leaf))
        pts = keyed.withColumn("node", F.col("node") * 2 + (F.col("key") > edge).cast("long")).drop("key")
    placed = pts.select(F.col("grp").alias("g"), F.col("part").alias("p"), F.col("node").cast("int").alias("shard"))
    return dealt.join(placed, (F.col("grp") == F.col("g")) & (F.col("part") == F.col("p"))).drop("g", "p", "part")


def sharded(docs, count=16):
    """One row per document: doc_id, size, text_crc32, law, shard, slot (gapless in its shard), grown_shard (null: the law is bytes)."""
    placed = shards(points(docs), count).select("doc_id", "size", "text_crc32", "shard")
    out = numbered(placed, "shard", "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
