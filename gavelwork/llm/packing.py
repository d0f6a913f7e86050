"""Best-fit packing of token sequences with matching of large items.

Lengths are whole numbers up to the capacity, so all pieces are described by a histogram of at most ``capacity`` counts, whatever their
number. On it the packing is planned for whole runs of equal bins: pieces above a third of the capacity are matched greedily, the longest
with the longest partner that fits, at most two in a bin; smaller ones, longest first, go where the least room is left. The plan is a
table of a few thousand rows at most (each step empties a length or splits one run of bins); pieces find their place in it by their number
within their length. Numbers are given per task and summed up, so no length meets in one task.

A document longer than the capacity is cut into full pieces after a shorter first one. Null texts are empty, and an empty text still has
its end id. Repeated rows are packed as rows; an empty table gives an empty result.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gavelwork.llm.byte_bpe import ByteBpe
from gavelwork.llm.common import bounded_batches, numbered, resident, sliced

CAPACITY = 1024
END = 2


def pieces_of(ids, capacity=CAPACITY, end=END):
    """[(start, ids)] of one document's ids with the end id: a shorter first piece, then full ones."""
    ids = np.append(ids, np.uint32(end)).astype("<u4")
    cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
    return [(a, ids[a:b]) for a, b in zip(cuts, cuts[1:])]


def _tokenize(paths, capacity):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        vocabulary = resident(("packing", paths), lambda: ByteBpe(*paths))
        for b in sliced(batches):
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                for k, (start, x) in enumerate(pieces_of(vocabulary.ids(text.as_py() or ""), capacity)):
                    rows.append((doc, k, start, len(x), zlib.crc32(x)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, schema)], schema=schema)

    return run


def plan(counts, capacity=CAPACITY):
    """Segments (length, first, last, bin, each, offset): piece number n of a length goes to bin + (n - first) // each.

    ``counts``: {length: number of pieces}. Runs of bins with one content are planned together.
    """
    left, taken, segments, rooms, bins = dict(counts), {}, [], {}, 0

    def put(length, many, first_bin, each, offset):
        start = taken.get(length, 0)
        segments.append((length, start, start + many, first_bin, each, offset))
        taken[length] = start + many
        left[length] -= many

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            mate = next((m for m in large if m <= n and n + m <= capacity and left[m] - (m == n) > 0), None)
            many = left[n] if mate is None else left[n] // 2 if mate == n else min(left[n], left[mate])
            put(n, many, bins, 1, 0)
            if mate is not None:
                put(mate, many, bins, 1, n)
            rooms.setdefault(capacity - n - (mate or 0), []).append((bins, many))
            bins += many
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            room = min((r for r in rooms if r >= n), default=None)
            if room is None:
                room, each = capacity, capacity // n
                rooms.setdefault(room, []).append((bins, -(-left[n] // each)))
                bins += -(-left[n] // each)
            each = room // n
            first, many = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
            full = min(many, left[n] // each)
            if full:
                put(n, full * each, first, each, capacity - room)
                rooms.setdefault(room - each * n, []).append((first, full))
            if full < many:
                rest = left[n]
                if 0 < rest < each:
                    put(n, rest, first + full, rest, capacity - room)
                    rooms.setdefault(room - rest * n, []).append((first + full, 1))
                    full += 1
                if full < many:
                    rooms.setdefault(room, []).append((first + full, many - full))
    return segments


def packed(pieces, capacity=CAPACITY):
    """``pieces`` with ``length`` (1 to ``capacity``) -> sequence_id and offset."""
    ranked = numbered(pieces, "length", "_rank")
    counts = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = pieces.sparkSession.createDataFrame(plan(counts, capacity), "l long, first long, last long, bin long, each long, at long")
    here = (F.col("length") == F.col("l")) & (F.col("_rank") >= F.col("first")) & (F.col("_rank") < F.col("last"))
    k = F.col("_rank") - F.col("first")
    out = ranked.join(F.broadcast(table), here)
    return out.withColumns({"sequence_id": F.col("bin") + (k - k % F.col("each")) / F.col("each").cast("double"), "offset": F.col("at") + k % F.col("each") * F.col("length")}).withColumn("sequence_id", F.col("sequence_id").cast("long")).drop("_rank", "l", "first", "last", "bin", "each", "at")


def packed_documents(docs, tokenizer_path, ranks_path, capacity=CAPACITY):
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of all documents of (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = rows.mapInArrow(_tokenize((tokenizer_path, ranks_path), capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")
    return packed(pieces, capacity)
