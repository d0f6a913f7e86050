"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text stands for each language. A text is parsed against it into the longest strings that occur in the
labelled text, one after another. A phrase tells a place in the labelled text, so it costs the logarithm of that text's length: the language
of least cost per symbol wins, and one with little labelled text is not put at a disadvantage for its shorter phrases. Labelled text is a
bounded sample: of each language, ``SAMPLE`` documents of least hash (those of 200 to 8,000 characters first), ``CHARS`` symbols in all.

Symbols are the UTF-8 bytes of lower-case letters, runs of anything else are one blank. Each language has its own map of the bytes that its
sample holds, so no script is folded into another's alphabet. Texts are parsed whole, in blocks of ``BLOCK`` symbols that start a phrase
anew, so that all blocks of some texts advance together in numpy. Python sees the text alone, all other columns stay in the JVM.

Null texts, empty texts and texts without a letter are ``und`` with score 0. Ties go to the first language by name. Repeated rows are rows;
an empty table gives an empty result; without labelled text every document is ``und``.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from gavelwork.llm.common import bounded_batches, released, resident, stored

SAMPLE = 64
CHARS = 20_000
BLOCK = 512
BATCH = 1 << 20
UND = "und"


def held_out():
    """crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def labelled_text(docs):
    """{lang: text}, the bounded sample of documents that are not held out."""
    fit = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
    order = F.struct((~F.length("text").between(200, 8000)).alias("odd"), F.xxhash64("doc_id").alias("h"), F.col("doc_id").alias("id"))
    # the least of each of 1,024 hash ranges first: sums up before the shuffle, however large a language is
    least = fit.groupBy("lang", F.pmod(F.xxhash64("doc_id"), F.lit(1024)).alias("cell")).agg(F.min(order).alias("o"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("o"))
    ids = stored(least.withColumn("r", rank).where(F.col("r") <= SAMPLE).select(F.col("lang").alias("l"), F.col("o.id").alias("id"), "r"), "sample")
    rows = fit.join(F.broadcast(ids), (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("l")))
    out = {}
    for r in sorted(rows.groupBy("lang", "r").agg(F.min(F.substring("text", 1, CHARS)).alias("t")).collect()):
        out[r["lang"]] = (out.get(r["lang"], "") + r["t"] + "\n")[:CHARS]
    return out


class Symbols:
    """Texts as bytes of their letters."""

    def __init__(self):
        self.letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)

    def codes(self, text):
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(points):
            return np.empty(0, np.uint8)
        letter = self.letter[points]
        kept = letter | np.concatenate(([True], letter[:-1]))
        raw = np.where(letter, points, np.uint32(32))[kept].tobytes().decode("utf-32-le", "surrogatepass")
        return np.frombuffer(raw.encode("utf-8", "surrogatepass"), np.uint8)


def automaton(codes):
    """Transitions of the suffix automaton of a sequence: a list of {symbol: state}."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return nxt


class Parser:
    """Counts phrases of texts against all languages at once."""

    def __init__(self, texts):
        self.langs, self.symbols = sorted(texts), Symbols()
        self.maps, self.tables, self.starts, cost = [], [], [], []
        for k in self.langs:
            sample = self.symbols.codes(texts[k])[:CHARS]
            own = np.unique(sample)
            n = len(own) + 1  # the last symbol stands for all bytes that the language has not
            lut = np.full(256, n - 1, np.int32)
            lut[own] = np.arange(n - 1)
            nxt = automaton(lut[sample].tolist())
            dead = len(nxt)  # after a symbol that the language has not: any next symbol starts a phrase
            to = np.full((dead + 1, n), -1, np.int64)
            for s, edges in enumerate(nxt):
                for c, t in edges.items():
                    to[s, c] = t
            first = np.where(to[0] < 0, dead, to[0])
            self.maps.append(lut)
            self.tables.append(np.where(to < 0, (first[None, :] * n << 1) | 1, to * n << 1).astype(np.int32).ravel())
            self.starts.append(dead * n)
            cost.append(np.log2(len(sample) + 2))
        self.cost = np.array(cost)

    def phrases(self, codes):
        """(languages x texts) numbers of phrases of a list of symbol arrays."""
        sizes = np.array([len(c) for c in codes], np.int64)
        out = np.zeros((len(self.langs), len(codes)), np.int64)
        if not sizes.sum() or not self.langs:
            return out
        flat, blocks = np.concatenate(codes), -(-sizes // BLOCK)
        doc = np.repeat(np.arange(len(codes)), blocks)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = np.repeat(np.cumsum(sizes) - sizes, blocks) + nth * BLOCK
        lens = np.minimum(BLOCK, sizes[doc] - nth * BLOCK)
        order = np.argsort(-lens, kind="stable")
        doc, start, lens = doc[order], start[order], lens[order]
        active = np.searchsorted(-lens, -np.arange(1, BLOCK + 1), side="right")
        for k, (lut, table) in enumerate(zip(self.maps, self.tables)):
            own, state, count = lut[flat], np.full(len(doc), self.starts[k], np.int32), np.zeros(len(doc), np.int32)
            for t in range(int(lens[0])):
                a = active[t]
                got = table[state[:a] + own[start[:a] + t]]
                count[:a] += got & 1
                state[:a] = got >> 1
            out[k] = np.bincount(doc, weights=count, minlength=len(codes)).astype(np.int64)
        return out

    def best(self, texts):
        """(language, score, phrases, symbols) of each text."""
        codes = [self.symbols.codes(t) for t in texts]
        counts = self.phrases(codes)
        costs = counts * self.cost[:, None]
        for i, c in enumerate(codes):
            if not self.langs or not (c != 32).any():
                yield UND, 0.0, 0, len(c)
                continue
            k = int(np.argmin(costs[:, i]))
            others = np.delete(costs[:, i], k)
            score = 1 - costs[k, i] / others.min() if len(others) else 1 - counts[k, i] / len(c)
            yield self.langs[k], float(score), int(counts[k, i]), len(c)


RESULT = [("lang_pred", StringType(), pa.string()), ("score", DoubleType(), pa.float64()), ("n_phrases", LongType(), pa.int64()), ("n_symbols", LongType(), pa.int64())]


def _weighed(texts):
    """Lists of texts of about BATCH characters."""
    held, total = [], 0
    for t in texts:
        held.append(t.as_py() or "")
        total += len(held[-1])
        if total >= BATCH:
            yield held
            held, total = [], 0
    if held:
        yield held


def predict_udf(texts):
    """Arrow function: texts -> struct of lang_pred, score, n_phrases and n_symbols."""
    key = tuple(sorted(texts.items()))

    @arrow_udf(StructType([StructField(k, t) for k, t, _ in RESULT]))
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        parser = resident(("languages", key), lambda: Parser(texts))
        for b in released(batches):
            rows = [r for held in _weighed(b) for r in parser.best(held)]
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, _, t) in enumerate(RESULT)], [k for k, _, _ in RESULT])

    return predict.asNondeterministic()  # else a filter on the result would run it twice


def predicted(docs):
    """doc_id, held_out, lang_pred, score, n_phrases, n_symbols. Predictions see the text alone."""
    bounded_batches(docs.sparkSession)
    got = predict_udf(labelled_text(docs))(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), got.alias("got")).select("doc_id", "held_out", "got.*")


def accepted(docs, strange):
    """Rows of ``docs`` whose text has letters and needs at most ``strange`` phrases a symbol (and three), with the predicted language as ``lang``."""
    bounded_batches(docs.sparkSession)
    texts, text = labelled_text(docs), F.coalesce(F.col("text").cast("string"), F.lit(""))
    if not texts:
        return docs.where(text.rlike(r"\p{L}"))
    rows = docs.select(F.struct("*").alias("row"), predict_udf(texts)(text).alias("got"))
    fits = (F.col("got.lang_pred") != UND) & (F.col("got.n_phrases") <= F.col("got.n_symbols") * strange + 3)
    return rows.where(fits).select("row.*", F.col("got.lang_pred").alias("_predicted")).select(*(F.col("_predicted").alias(c) if c == "lang" else F.col(c) for c in docs.columns))
