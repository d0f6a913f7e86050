"""Registered queries of the corpus operators, each over its whole table, with the SQL that checks it where SQL can say it."""

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from gavelwork.llm import cross_parse, fill_middle, flow_mix, jaccard_join, kd_shards, line_frequency, packing, quality_llr, repeated_bytes, token_align, token_counts, topk_blocks, warc

QUERIES = {}
ORACLES = {}


def query(name, oracle=None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP1 = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS kept FROM p GROUP BY h),
d AS (SELECT page_id, kept, octet_length(b) AS payload_bytes, sha1(b) AS hex FROM p JOIN g USING (h)),
bits AS (SELECT *, list_transform(range(32), lambda i: CAST(('0x' || substr(hex, 1 + CAST(5 * i // 4 AS INT), 2) || CASE WHEN 1 + 5 * i // 4 = 40 THEN '0' ELSE '' END) AS INT) // CAST(pow(2, 3 - 5 * i % 4) AS INT) % 32) AS q FROM d)
SELECT page_id, payload_bytes, list_aggregate(list_transform(q, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> kept THEN kept END AS refers_to FROM bits"""


@query("op1_arc_to_warc", OP1)
def op1(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_best_fit_packing")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return packing.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query("op3_ngram_likelihood_rules")
def op3(spark, sf_dir):
    return quality_llr.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP4 = r"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
q AS (SELECT source, text, any_value(lines) AS lines FROM d GROUP BY source, text),
p AS (SELECT source, count(*) AS pages FROM q GROUP BY source),
u AS (SELECT source, unnest(list_distinct(list_transform(lines, lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))))) AS line FROM q),
c AS (SELECT source, line, count(*) AS n FROM u WHERE line <> '' GROUP BY ALL),
b AS (SELECT c.source, list(line) AS often FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source WHERE n >= 3 AND n > 0.1 * pages GROUP BY c.source),
k AS (SELECT d.*, list_filter(lines, lambda x: NOT coalesce(list_contains(often, trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), false)) AS kept
  FROM d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(list_filter(lines, lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '')) END AS n_lines,
  CASE WHEN text IS NULL THEN 0 ELSE len(lines) - len(kept) END AS n_removed, CASE WHEN text IS NOT NULL THEN array_to_string(kept, chr(10)) END AS text FROM k"""


@query("op4_site_line_frequency", OP4)
def op4(spark, sf_dir):
    return line_frequency.cleaned(table(spark, sf_dir, "documents")).select("doc_id", "source", "n_lines", "n_removed", "text")


@query("op5_cross_parsing_language")
def op5(spark, sf_dir):
    return cross_parse.predicted(table(spark, sf_dir, "documents"))


@query("op6_ngram_jaccard_join")
def op6(spark, sf_dir):
    return jaccard_join.near_components(table(spark, sf_dir, "documents"))


@query("op7_repeated_bytes")
def op7(spark, sf_dir):
    return repeated_bytes.deduplicated(table(spark, sf_dir, "documents"))


@query("op8_kd_tree_sharding")
def op8(spark, sf_dir):
    return kd_shards.sharded(table(spark, sf_dir, "documents"))


OP9 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q, row_number() OVER () AS rid FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, a.rid, b.vec_id, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.rid <> b.rid AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""


@query("op9_exact_top_k", OP9)
def op9(spark, sf_dir):
    return topk_blocks.top_k(table(spark, sf_dir, "embeddings"))


@query("op10_source_mixing")
def op10(spark, sf_dir):
    return flow_mix.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op11_token_alignment")
def op11(spark, sf_dir):
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
    return token_align.aligned(table(spark, sf_dir, "documents"), *paths).select("doc_id", *token_align.MEASURES, "groups_sha256")


OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
  list_transform(range(4), lambda k: CAST('0x' || substr(hex, CAST(8 * k + 1 AS INT), 8) AS BIGINT)) AS h FROM d),
c AS (SELECT doc_id, t, units, CAST(len(units) AS BIGINT) AS n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS a, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:a], '') AS one, array_to_string(units[a + 1:b], '') AS mid, array_to_string(units[b + 1:], '') AS rest FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(one) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || one || '<S>' || rest || '<M>' || mid ELSE '<S>' || rest || '<P>' || one || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""


@query("op12_fill_in_middle", OP12)
def op12(spark, sf_dir):
    out = fill_middle.transformed(table(spark, sf_dir, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


@query("op13_token_counts")
def op13(spark, sf_dir):
    out = token_counts.counted(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
