"""Exact top-k inner-product search, block at a time.

Vectors are quantised to integers and treated as documents whose terms are the dimensions. A block is a range of documents in reading
order with a forward index (its matrix) and, per term, the least and greatest weight. For a query the sum of the largest possible
products bounds every score of a block; blocks are scored from the highest bound down and the rest is skipped once the bound falls
below the k-th score. Blocks of all tasks meet all queries in a grid of (block, query group) cells, so a task holds one stored block and
about ``per_group`` queries; a query's own best of each cell are merged by a second top-k.

Null vectors, and vectors with a null or non-finite component, take no part; vectors meet only others of the same length. Repeated
vectors and ids are rows of their own. Ties go to the smaller id (null ids last). An empty table gives an empty result. Products are
exact in int64; inputs whose quantised squares exceed it are outside the operator.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from gavelwork.llm.common import stored

STORED = 4096
RANGE = 256


def _pack(size):
    """Rows (dim, id, is_query, embedding) -> stored blocks of at most ``size`` vectors of one length."""
    schema = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("nulls", pa.binary()), ("vectors", pa.binary())])

    def blocks(pid, no, dim, ids, rows):
        null = np.array([i is None for i in ids])
        known = np.array([0 if i is None else i for i in ids], dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array([(pid << 33) + no], pa.int64()), pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([known.tobytes()], pa.binary()), pa.array([null.tobytes()], pa.binary()), pa.array([np.vstack(rows).tobytes()], pa.binary())], schema=schema)

    def run(batches):
        held, no, pid = {}, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            pid = b.column(2)[0].as_py()
            ids, vecs = b.column(0).to_pylist(), b.column(1)
            lens = np.diff(vecs.offsets.to_numpy())
            flat = vecs.values.to_numpy(zero_copy_only=False).astype(np.float64)
            starts = vecs.offsets.to_numpy()[:-1]
            for dim in np.unique(lens).tolist():
                at = np.flatnonzero(lens == dim)
                m = np.floor(256.0 * flat[(starts[at][:, None] if dim else np.zeros((len(at), 1), int)) + np.arange(dim)[None, :]]).astype(np.int64) if dim else np.zeros((len(at), 0), np.int64)
                own = held.setdefault(dim, ([], []))
                own[0].extend(ids[i] for i in at)
                own[1].append(m)
                while len(own[0]) >= size:
                    allm = np.vstack(own[1])
                    yield blocks(pid, no, dim, own[0][:size], [allm[:size]])
                    no += 1
                    held[dim] = own = (own[0][size:], [allm[size:]])
        for dim, (ids, rows) in held.items():
            if ids:
                yield blocks(pid, no, dim, ids, rows)
                no += 1

    return run


def _queries(modulo):
    """The stated query rows of stored blocks, one row each: block, place, id and vector."""
    schema = pa.schema([("q_block", pa.int64()), ("q_place", pa.int32()), ("dim", pa.int32()), ("query_id", pa.int64()), ("q_vector", pa.binary())])

    def run(batches):
        for b in batches:
            for block, dim, n, ids, nulls, vectors in zip(*(c.to_pylist() for c in b.columns)):
                ids, nulls = np.frombuffer(ids, np.int64), np.frombuffer(nulls, bool)
                m = np.frombuffer(vectors, np.int64).reshape(n, dim)
                at = np.flatnonzero(~nulls & (ids % modulo == 0))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block)), pa.array(at.astype(np.int32)), pa.array(np.full(len(at), dim, np.int32)), pa.array(ids[at]), pa.array([m[i].tobytes() for i in at], pa.binary())], schema=schema)

    return run


def _product(q, m, bound):
    """Exact integer inner products; in float64 where no partial sum can leave its exact range."""
    if bound < 2.0**52:
        return (q.astype(np.float64) @ m.astype(np.float64).T).astype(np.int64)
    return q @ m.T


def score_block(q, q_block, q_place, block, ids, nulls, m, k, width=RANGE):
    """Best ``k`` of one stored block for every query: (query index, id, null id, score), pruning ranges of ``width`` documents."""
    n, dim = m.shape
    if not n or not len(q):
        return [np.empty(0, np.int64)] * 4
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(m).max(initial=0)) * max(dim, 1)
    edges = np.arange(0, n, width)
    high, low = np.maximum.reduceat(m, edges, axis=0), np.minimum.reduceat(m, edges, axis=0)
    limit = _product(np.maximum(q, 0), high, bound) + _product(np.minimum(q, 0), low, bound)
    order = np.argsort(-limit, axis=1, kind="stable")
    floor = np.iinfo(np.int64).min + 1
    best = np.full((len(q), k), floor)
    key = np.full((len(q), k), np.iinfo(np.int64).max)
    place = np.full((len(q), k), -1, np.int64)
    rank = np.empty(n, np.int64)
    rank[np.lexsort((np.arange(n), ids, nulls))] = np.arange(n)
    own = np.where(q_block == block, q_place, -1)
    alive = np.arange(len(q))
    for step in range(len(edges)):
        at = order[alive, step]
        alive, at = (x[limit[alive, at] >= best[alive, k - 1]] for x in (alive, at))
        if not len(alive):
            break
        for r in np.unique(at).tolist():
            who, lo, hi = alive[at == r], int(edges[r]), int(min(n, edges[r] + width))
            s = _product(q[who], m[lo:hi], bound)
            mine = own[who] - lo
            inside = np.flatnonzero((mine >= 0) & (mine < hi - lo) & (own[who] >= 0))
            valid = np.ones(s.shape, bool)
            valid[inside, mine[inside]] = False
            cand_s = np.hstack((best[who], np.where(valid, s, floor)))
            cand_k = np.hstack((key[who], np.where(valid, rank[None, lo:hi], np.iinfo(np.int64).max)))
            cand_p = np.hstack((place[who], np.where(valid, np.arange(lo, hi)[None, :], -1)))
            top = np.lexsort((cand_k, -cand_s), axis=1)[:, :k] if cand_s.shape[1] <= 4 * k else _best(cand_s, cand_k, k)
            for a, c in ((best, cand_s), (key, cand_k), (place, cand_p)):
                a[who] = np.take_along_axis(c, top, axis=1)
    who, col = np.nonzero(place >= 0)
    p = place[who, col]
    return [who, ids[p], nulls[p], best[who, col]]


def _best(s, key, k):
    """Columns of the k highest scores of every row, ties to the smaller key."""
    kth = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
    out = np.empty((len(s), k), np.int64)
    rows, cols = np.nonzero(s >= kth)
    order = np.lexsort((key[rows, cols], -s[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    first = np.searchsorted(rows, np.arange(len(s)))
    for j in range(k):
        out[:, j] = cols[first + j]
    return out


def _cell(k):
    schema = pa.schema([("q_block", pa.int64()), ("q_place", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in schema}, schema=schema)
        names = left.column_names
        q_block, q_place = (right.column(x).to_numpy() for x in ("q_block", "q_place"))
        dims, q_ids, vec = right.column("dim").to_numpy(), right.column("query_id").to_numpy(), right.column("q_vector").to_pylist()
        parts = []
        for row in zip(*(left.column(x).to_pylist() for x in names)):
            b = dict(zip(names, row))
            of = np.flatnonzero(dims == b["dim"])
            if not len(of):
                continue
            q = np.array([np.frombuffer(vec[i], np.int64) for i in of]).reshape(len(of), b["dim"])
            m = np.frombuffer(b["vectors"], np.int64).reshape(b["n"], b["dim"])
            who, ids, nulls, scores = score_block(q, q_block[of], q_place[of], b["block"], np.frombuffer(b["ids"], np.int64), np.frombuffer(b["nulls"], bool), m, k)
            who = of[who]
            parts.append(pa.table([pa.array(q_block[who]), pa.array(q_place[who]), pa.array(q_ids[who]), pa.array(ids, mask=np.asarray(nulls, bool)), pa.array(scores)], schema=schema))
        return pa.concat_tables(parts) if parts else pa.table({f.name: pa.array([], f.type) for f in schema}, schema=schema)

    return run


def top_k(vectors, k=5, modulo=50, id_col="vec_id", vec_col="embedding", per_group=1024, size=STORED):
    """query_id, rank, vec_id, score of the ``k`` best other rows of every row whose id is divisible by ``modulo``."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    rows = rows.select("id", "v", F.spark_partition_id().alias("pid"))
    blocks = stored(rows.mapInArrow(_pack(size), "block bigint, dim int, n int, ids binary, nulls binary, vectors binary"), "blocks")
    queries = stored(blocks.mapInArrow(_queries(modulo), "q_block bigint, q_place int, dim int, query_id bigint, q_vector binary"), "queries")
    groups = max(1, -(-queries.count() // per_group))
    columns = max(1, blocks.count())
    group = lambda *c: F.pmod(F.xxhash64(*c), F.lit(groups)).cast("int")
    left = blocks.withColumns({"b": F.pmod(F.xxhash64("block"), F.lit(columns)).cast("int"), "g": F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))})
    right = queries.withColumns({"g": group("q_block", "q_place"), "b": F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))})
    cells = left.groupBy("b", "g").cogroup(right.groupBy("b", "g")).applyInArrow(_cell(k), "q_block bigint, q_place int, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("q_block", "q_place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
