"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are summed up by membership pattern: the set of sources that they count for. A pattern offers its words once for nothing, and
a second time at a price (convex repetition costs; ``epochs`` uses at most). A flow from patterns to source quotas of least cost says how
many words each pattern gives; the network has one node per pattern and source, never one per document. Documents of a pattern are then
taken whole, in the order of a seeded hash, until the pattern's words are reached: the sum ends within half a document of the flow.
That order is found by sums over hash ranges, so a pattern's documents never meet in one task.

Null texts have size 0 and are taken 0 words; a null source is a source of its own, sorted last; repeated rows are rows; an empty table
gives an empty result.
"""

import heapq

from pyspark.sql import Window
from pyspark.sql import functions as F

from gavelwork.llm.common import BLANKS, stored

WEIGHTS = (5, 2, 1)
CELL_BITS = 12


def targets(sizes, weights=WEIGHTS, share=1.5, most=2.0):
    """Quotas of [(source, size)] in their order: ``share`` of all words by repeating weights, what exceeds ``most`` x size reshared."""
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(sizes)}
    size = dict(sizes)
    left, open_, out = share * sum(size.values()), [s for s, _ in sizes], {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * size[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        out |= {s: most * size[s] for s in full}
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return out


def min_cost_flow(supply, quota, epochs=2):
    """{(pattern, source): words} of greatest flow at least cost; ``supply``: {pattern (tuple of sources): words}, the n-th use costs n - 1.

    Successive shortest paths with potentials over patterns x sources.
    """
    names = ["out", *[("p", p) for p in supply], *[("s", s) for s in quota], "in"]
    at = {n: i for i, n in enumerate(names)}
    graph = [[] for _ in names]

    def edge(a, b, cap, cost):
        graph[a].append([b, cap, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for p, w in supply.items():
        for use in range(epochs):
            edge(at["out"], at[("p", p)], w, use)
        for s in p:
            edge(at[("p", p)], at[("s", s)], w * epochs, 0)
    for s, q in quota.items():
        edge(at[("s", s)], at["in"], q, 0)
    source, sink, high = at["out"], at["in"], [0] * len(names)
    while True:
        dist, back, heap = {source: 0}, {}, [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > dist[a]:
                continue
            for i, (b, cap, cost, _) in enumerate(graph[a]):
                new = d + cost + high[a] - high[b]
                if cap > 0 and new < dist.get(b, float("inf")):
                    dist[b], back[b] = new, (a, i)
                    heapq.heappush(heap, (new, b))
        if sink not in dist:
            break
        far = max(dist.values())
        high = [h + dist.get(i, far) for i, h in enumerate(high)]
        path, b = [], sink
        while b != source:
            a, i = back[b]
            path.append((a, i))
            b = a
        push = min(graph[a][i][1] for a, i in path)
        for a, i in path:
            graph[a][i][1] -= push
            graph[graph[a][i][0]][graph[a][i][3]][1] += push
    out = {}
    for p in supply:
        for b, _, _, back_at in graph[at[("p", p)]]:
            if names[b][0] == "s":
                out[(p, names[b][1])] = graph[b][back_at][1]  # what the reverse edge could take back
    return out


def _select(docs, quota):
    """``docs`` (pattern, size, seed, n) with words taken: one use of all plus a seeded part, or a seeded part only."""
    cell = F.shiftrightunsigned("seed", 64 - CELL_BITS)
    sums = docs.groupBy("pattern", cell.alias("cell")).agg(F.sum("size").alias("w"))
    over = Window.partitionBy("pattern").orderBy("cell")
    reach = F.sum("w").over(over)
    cells = sums.select("pattern", "cell", reach.alias("upto"), (reach - F.col("w")).alias("before")).join(quota, "pattern")
    edges = cells.where((F.col("before") <= F.col("part")) & (F.col("upto") >= F.col("part")))
    edges = edges.groupBy("pattern").agg(F.min(F.struct("cell", "before", "upto")).alias("e"), F.first("part").alias("part"), F.first("uses").alias("uses"))
    edges = edges.select(F.col("pattern").alias("ep"), "part", "uses", F.col("e.cell").alias("edge"), F.col("e.before").alias("before"))
    rows = docs.withColumn("cell", cell).join(edges, F.col("pattern") == F.col("ep"), "left")
    # only documents of one cell in 2 ** CELL_BITS of a pattern need an order among themselves
    inside = rows.where(F.col("cell") == F.col("edge"))
    order = Window.partitionBy("pattern", "cell").orderBy("seed", "n").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    inside = inside.withColumn("more", (ahead + F.col("size") / 2 <= F.col("part")).cast("int"))
    rest = rows.where(~F.col("cell").eqNullSafe(F.col("edge"))).withColumn("more", F.coalesce((F.col("cell") < F.col("edge")).cast("int"), F.lit(0)))
    return inside.unionByName(rest).withColumn("taken", F.col("size") * (F.col("more") + F.coalesce("uses", F.lit(0)))).drop("ep", "part", "uses", "edge", "before", "cell", "more")


def _seed(seed):
    """Place of a document in the order of its pattern; the same in every run."""
    return F.xxhash64(F.col("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(seed))


def mixed(docs, seed=42, weights=WEIGHTS, share=1.5, members=None):
    """``docs`` with size, source_size, target (of the row's source), taken. ``members``: array column of a row's sources (default: its own).

    ``source_size`` and ``target`` are of ``source``; with several members the quotas are those of all sources named.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.size(F.array_remove(F.split(text, BLANKS), "")).cast("long")
    own = F.col("source").cast("string")
    pattern = F.array_sort(F.array_distinct(members)) if members is not None else F.array(own)
    rows = stored(docs.select("doc_id", own.alias("source"), size.alias("size"), pattern.alias("pattern"), _seed(seed).alias("seed"), F.crc32(text).alias("n")), "sizes")
    found = rows.groupBy("pattern").agg(F.sum("size").alias("w")).collect()
    supply = {tuple(r["pattern"]): r["w"] for r in found}
    size_of = {}
    for p, w in supply.items():
        for s in p:
            size_of[s] = size_of.get(s, 0) + w
    order = sorted(size_of, key=lambda s: (s is None, s or ""))
    want = targets([(s, size_of[s]) for s in order], weights, share)
    flow = min_cost_flow(supply, {s: round(w) for s, w in want.items()})
    words = {p: sum(flow[(p, s)] for s in p) for p in supply}
    uses = lambda p: int(words[p] >= supply[p] > 0)
    quota = spark.createDataFrame([(list(p), words[p] - uses(p) * supply[p], uses(p)) for p in supply], "pattern array<string>, part long, uses int")
    of = spark.createDataFrame([(s, size_of[s], float(want[s])) for s in order], "s string, source_size long, target double")
    taken = _select(rows, quota)
    return taken.join(of, F.col("source").eqNullSafe(F.col("s")), "left").select("doc_id", "source", "size", "source_size", "target", "taken", "seed")


def repeated(docs, seed=42):
    """Rows of ``docs`` as often as the mix takes them; documents without words are not taken."""
    times = mixed(docs, seed).where("taken > 0").groupBy(F.col("seed").alias("_s")).agg(F.max((F.col("taken") / F.col("size")).cast("int")).alias("_times"))
    rows = docs.withColumn("_seed", _seed(seed)).join(times, F.col("_seed") == F.col("_s"))
    return rows.withColumn("_use", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(docs.columns)
