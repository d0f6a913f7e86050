"""Token counts of whole texts: batch encoding in an Arrow function that returns lengths only.

Only the text goes to Python; every other column stays in the JVM. A worker collects texts until a batch holds ``BATCH`` characters, so
that batches weigh the same whatever the number of rows, and encodes a batch in one call. A text above ``PIECE`` characters is cut where no
merge can reach across: between two characters that stand side by side in no piece of the vocabulary. Parts after the first are encoded
behind a line feed, which no piece of the vocabulary holds, so the tokens of that prefix are known and taken off. A run without such a
place is encoded as one part, and so is every text under a model whose vocabulary holds line feeds or whose normaliser changes characters.

Null and empty texts have no tokens; rows that repeat are counted as rows; an empty table gives an empty result. ``n_bytes``, ``n_tokens``
and ``over_limit`` take the place of columns of these names; all other columns pass through.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType

from gavelwork.llm.common import bounded_batches, released, resident

BATCH = 1 << 19
PIECE = 1 << 10
LIMIT = 4096
ANCHOR = "\n"
SPACE = "▁"
SAMPLE = " a  Åﬁ "


class Lengths:
    """Token counts under one sentencepiece BPE model, as the library gives them for whole texts."""

    def __init__(self, model_path, piece=PIECE):
        import sentencepiece

        m = self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        vocabulary = [m.id_to_piece(i) for i in range(m.vocab_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
        same = m.normalize(SAMPLE) == (SPACE + SAMPLE).replace(" ", SPACE) and not any(ANCHOR in p for p in vocabulary)
        self.piece = piece if same else float("inf")
        self.joined = {p[i : i + 2].replace(SPACE, " ") for p in vocabulary for i in range(len(p) - 1)}
        self.anchor = len(m.encode(ANCHOR))

    def parts(self, text):
        """(start, end) of parts that no token spans, of ``piece`` characters where the text allows it."""
        start = 0
        while len(text) - start > self.piece:
            soon = range(start + self.piece, start + self.piece // 2, -1)
            late = range(start + self.piece + 1, len(text))
            at = next((k for places in (soon, late) for k in places if text[k - 1 : k + 1].replace(SPACE, " ") not in self.joined), None)
            if at is None:
                break
            yield start, at
            start = at
        yield start, len(text)

    def of(self, texts):
        """Token counts of an iterable of texts, in order."""
        counts, batch, owners, held = [], [], [], 0
        for text in texts:
            counts.append(0)
            for start, end in self.parts(text) if text else ():
                batch.append(ANCHOR + text[start:end] if start else text[:end])
                owners.append((len(counts) - 1, self.anchor if start else 0))
                held += end - start
                if held >= BATCH:
                    self._add(counts, batch, owners)
                    batch, owners, held = [], [], 0
        self._add(counts, batch, owners)
        return counts

    def ids(self, text):
        """Ids of one text."""
        cuts = [*self.parts(text)]
        found = self.model.encode([ANCHOR + text[a:b] if a else text[:b] for a, b in cuts], num_threads=1)
        return [i for (a, _), ids in zip(cuts, found) for i in (ids[self.anchor :] if a else ids)]

    def _add(self, counts, batch, owners):
        for (k, less), ids in zip(owners, self.model.encode(batch, num_threads=1)):
            counts[k] += len(ids) - less


def lengths_udf(model_path):
    """Arrow function: texts -> numbers of tokens."""

    @arrow_udf(LongType())
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = resident(("lengths", model_path), lambda: Lengths(model_path))
        for texts in released(batches):
            yield pa.array(counter.of(x.as_py() for x in texts), pa.int64())

    return lengths


def counted(docs, model_path, limit=LIMIT, text="text"):
    """``docs`` with n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens)."""
    bounded_batches(docs.sparkSession)
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    tokens = lengths_udf(model_path)(whole)
    return docs.withColumns({"n_bytes": F.octet_length(whole).cast("long"), "n_tokens": tokens}).withColumn("over_limit", F.col("n_tokens") > limit)
