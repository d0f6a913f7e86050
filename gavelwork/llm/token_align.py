"""Alignment of two tokenizers over a corpus, each distinct text once.

Documents are shuffled by their full text; copies meet as one row with a count (a text that many documents share is added up before the
shuffle). A distinct text is encoded by both vocabularies, token ends become byte offsets, and offsets at which both end cut the tokens into
groups. Every stretch between two neighbouring ends lies in one A token and one B token, so the stretches are the links. A text keeps its
distinct id pairs with their numbers; counts of pairs over the corpus weigh them by the number of copies.

Each text then needs the corpus counts of its own pairs. The most frequent ``HEAD`` pairs at most are broadcast; rows of all others meet
their counts in a shuffle by pair, where no pair can be frequent. The measures join the documents by a digest of the text; texts that stand
for more than 1/256 of all documents (256 at most) are broadcast for that instead, so no copy group meets in one task.

Texts that are null or empty, or whose tokens do not spell a space and the text in both vocabularies, have no tokens: all measures 0, groups
and digest ''. Ids may be null or repeat: every row gets the measures of its text. An empty table gives an empty result. The columns added
take the place of columns of these names, all others pass through.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gavelwork.llm.byte_bpe import ByteBpe
from gavelwork.llm.common import bounded_batches, released, resident, stored
from gavelwork.llm.token_counts import Lengths

HEAD = 200_000
MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
BATCH = 1 << 20
SPACE = "▁"


def byte_letters():
    """Letter of the byte-level alphabet -> byte: printable bytes stand for themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Both vocabularies with the bytes of their tokens."""

    def __init__(self, tokenizer_path, ranks_path, model_path):
        self.a = ByteBpe(tokenizer_path, ranks_path, special=False)
        self.b = Lengths(model_path)
        m, letters = self.b.model, byte_letters()
        entry = {i: s for s, i in self.a.whole.get_vocab().items()}
        spelled = lambda s: bytes(letters[c] for c in s) if all(c in letters for c in s) else s.encode()
        self.bytes_a = [spelled(entry.get(i, "")) for i in range(max(entry) + 1)]
        self.bytes_b = [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace(SPACE, " ").encode() for i in range(m.vocab_size())]
        self.len_a, self.len_b = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.bytes_a, self.bytes_b))
        number = lambda n, *ends: np.array([f"{i}{e}" for e in ends for i in range(n)], dtype="S")
        self.text_a, self.text_b = number(len(self.bytes_a), ",", "|"), number(len(self.bytes_b), ",", ";")
        self.width = max(self.text_a.itemsize, self.text_b.itemsize)

    def ids(self, text, raw):
        """Ids of both for a non-empty text, or None where one of them does not spell it."""
        whole = b" " + raw
        a = self.a.ids(" " + text, whole)
        if b"".join(map(self.bytes_a.__getitem__, a.tolist())) != whole:
            return None
        b = self.b.ids(text)
        if b"".join(map(self.bytes_b.__getitem__, b)) != whole:
            return None
        return a.astype(np.int64), np.array(b, dtype=np.int64)

    def aligned(self, a, b):
        """(links as A id times the size of B plus B id, in text order; number of groups; the groups as text) of two id arrays."""
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        mark = np.zeros(end_a[-1] + 1, np.uint8)
        mark[end_a] = 1
        mark[end_b] += 2
        mark = mark[np.flatnonzero(mark)]
        has_a, has_b, both = mark & 1 == 1, mark > 1, mark == 3
        upto_a, upto_b, group = np.cumsum(has_a), np.cumsum(has_b), np.cumsum(both) - both
        links = a[upto_a - has_a] * len(self.bytes_b) + b[upto_b - has_b]
        out = np.empty(len(a) + len(b), dtype=f"S{self.width}")
        before_b = np.concatenate(([0], upto_b[both]))
        out[np.arange(len(a)) + before_b[group[has_a]]] = self.text_a[a + both[has_a] * len(self.bytes_a)]
        out[np.arange(len(b)) + upto_a[both][group[has_b]]] = self.text_b[b + both[has_b] * len(self.bytes_b)]
        return links, int(both.sum()), out.tobytes().translate(None, b"\0")[:-1]


SCHEMA = "key binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, pairs array<long>, uses array<int>"
ARROW = pa.schema([("key", pa.binary()), *((k, pa.int64()) for k in ("copies", *MEASURES[:4])), ("groups", pa.string()), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("uses", pa.list_(pa.int32()))])


def _align(paths, keep_groups):
    def table(rows):
        flat = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(ARROW) if k < 8]
        at = pa.array(np.concatenate(([0], np.cumsum([len(r[8]) for r in rows]))), pa.int32())
        lists = (pa.ListArray.from_arrays(at, pa.array(np.concatenate([r[k] for r in rows]), ARROW.field(k).type.value_type)) for k in (8, 9))
        return pa.RecordBatch.from_arrays([*flat, *lists], schema=ARROW)

    def run(batches):
        aligner = resident(("aligner", paths), lambda: Aligner(*paths))
        none = np.empty(0, np.int64)
        for batch in released(batches):
            rows, held = [], 0
            for text, copies in zip(batch.column("text"), batch.column("copies").to_pylist()):
                text = text.as_py()
                raw = text.encode()
                key, ids = hashlib.sha256(raw).digest(), aligner.ids(text, raw)
                if ids is None:
                    rows.append((key, copies, 0, 0, 0, 0, "" if keep_groups else None, "", none, none))
                    continue
                links, n, groups = aligner.aligned(*ids)
                pairs, uses = np.unique(links, return_counts=True)
                digest = hashlib.sha256(groups).hexdigest()
                rows.append((key, copies, len(ids[0]), len(ids[1]), n, len(links), groups.decode() if keep_groups else None, digest, pairs, uses))
                held += len(raw)
                if held >= BATCH:
                    yield table(rows)
                    rows, held = [], 0
            if rows:
                yield table(rows)

    return run


def aligned_texts(docs, paths, keep_groups=False, text="text"):
    """One row of every distinct non-empty text: key (SHA-256 of the text), copies, measures, groups, its distinct pairs and their uses."""
    bounded_batches(docs.sparkSession)
    distinct = docs.select(F.col(text).cast("string").alias("text")).where("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    return distinct.mapInArrow(_align(paths, keep_groups), SCHEMA)


def pair_counts(texts, size_b):
    """pair, links and best of the whole corpus: links that hold the pair, and whether no pair of its B id has more."""
    uses = texts.select("copies", F.explode(F.arrays_zip("pairs", "uses")).alias("p"))
    counts = uses.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum(F.col("p.uses") * F.col("copies")).alias("links")).withColumn("b", F.col("pair") % size_b)
    most = counts.groupBy(F.col("b").alias("mb")).agg(F.max("links").alias("most"))
    return counts.join(F.broadcast(most), F.col("b") == F.col("mb")).select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def head_of(counts, head):
    """Least number of links such that at most ``head`` pairs have that many, by a histogram in steps of a quarter power of two."""
    step = F.floor(F.log2(F.col("links").cast("double")) * 4).cast("int")
    least, total = None, 0
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("links").alias("least")).collect(), key=lambda r: -r["step"]):
        total += r["n"]
        if total > head:
            break
        least = r["least"]
    return least


def scored(texts, counts, head=HEAD):
    """id of a text -> n_best and count_sum."""
    least = head_of(counts, head)
    often = F.lit(False) if least is None else F.col("links") >= least
    uses = texts.select("id", F.explode(F.arrays_zip("pairs", "uses")).alias("p")).select("id", F.col("p.pairs").alias("pair"), F.col("p.uses").alias("uses"))
    near, far = F.broadcast(counts.where(often)), counts.where(~often)
    rare = uses.join(near.select("pair"), "pair", "left_anti")
    measure = F.sum(F.when(F.col("best"), F.col("uses")).otherwise(0)).alias("n_best"), F.sum(F.col("uses") * F.col("links")).alias("count_sum")
    parts = [u.join(c, "pair").groupBy("id").agg(*measure) for u, c in ((uses, near), (rare, far))]
    return parts[0].unionByName(parts[1]).groupBy("id").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def aligned(docs, tokenizer_path, ranks_path, model_path, keep_groups=False, head=HEAD, text="text"):
    """``docs`` with n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, on request, groups (`a1,a2|b1;a3|b2,b3`)."""
    paths = tokenizer_path, ranks_path, model_path
    texts = stored(aligned_texts(docs, paths, keep_groups, text).withColumn("id", F.monotonically_increasing_id()), "aligned", compression="zstd")
    counts = stored(pair_counts(texts, Lengths(model_path).model.vocab_size()), "pairs")
    found = [*MEASURES, "groups_sha256", *(["groups"] if keep_groups else [])]
    scores = scored(texts, counts, head).withColumnRenamed("id", "sid")
    known = stored(texts.join(scores, F.col("id") == F.col("sid"), "left").select("key", "copies", *found), "measures")
    hot = F.broadcast(known.where(F.col("copies") * 256 >= (known.agg(F.sum("copies")).first()[0] or 1)))
    kept = [c for c in docs.columns if c not in found]
    whole = F.col(text).cast("string")
    rows = docs.select(F.struct(*kept).alias("_row"), F.when(whole != "", F.unhex(F.sha2(whole, 256))).alias("_key"))
    keyed = rows.where(F.col("_key").isNotNull())
    same = F.col("_key") == F.col("key")
    cold = keyed.join(hot.select("key"), same, "left_anti").join(known, same)
    none = rows.where(F.col("_key").isNull()).select("_row", *(F.lit(None).cast(known.schema[c].dataType).alias(c) for c in found))
    joined = cold.select("_row", *found).unionByName(keyed.join(hot, same).select("_row", *found)).unionByName(none)
    filled = (F.coalesce(F.col(c), F.lit(0 if c in MEASURES else "")).alias(c) for c in found)
    return joined.select("_row.*", *filled)
