"""Small fixtures against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import base64
import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gavelwork.llm import cross_parse, flow_mix, jaccard_join, kd_shards, line_frequency, packing, quality_llr, repeated_bytes, topk_blocks, warc
from gavelwork.llm.common import numbered, stored, without
from gavelwork.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=1, n=60):
    """Texts with copies, near copies, shared passages, very short and odd ones."""
    rng = random.Random(seed)
    base, passage = words(rng, 80), words(rng, 40)
    texts = [None, "", " ", "one", "one two three", "One TWO three", "a  b\n\nc", "<|endoftext|> stays", "ünïcödé текст 漢字 " * 5]
    for i in range(n):
        t = list(base) if i % 3 == 0 else words(rng, rng.randrange(5, 150))
        for _ in range(rng.randrange(0, 9)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
        if i % 5 == 0:
            t[3:3] = passage
        texts.append(" ".join(t))
    texts += [texts[-1]] * 4 + [" ".join(words(rng, 6000))]
    return list(enumerate(texts))


def test_numbers_are_gapless_for_any_key(spark):
    df = spark.range(1000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL ELSE id % 5 END AS k").repartition(7)
    got = collections.defaultdict(list)
    for r in numbered(df, "k", "n").collect():
        got[r["k"]].append(r["n"])
    assert all(sorted(v) == list(range(len(v))) for v in got.values()) and sum(map(len, got.values())) == 1000


def test_rows_without_a_long_list(spark):
    rows = spark.range(5000).selectExpr("CASE WHEN id % 7 = 0 THEN NULL ELSE id % 1500 END AS a", "id % 3 AS b", "id AS wide")
    gone = stored(spark.range(1500).selectExpr("id AS a", "id % 2 AS b").where("a % 5 < 3"), "gone")
    want = {r["wide"] for r in rows.collect() if r["a"] is None or r["a"] % 5 >= 3 or r["b"] != r["a"] % 2}
    got = [r["wide"] for r in without(rows, ["a", "b"], gone).collect()]
    assert len(got) == len(want) and set(got) == want and without(rows, ["a", "b"], gone.limit(0)).count() == 5000


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
    assert components(links.where("a < 0")).count() == 0


def test_arc_versions_convert_and_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x y", "<p>é\r\n\r\nWARC/1.1\n</p>", 1), (2, "http://b.org/", "<p>é\r\n\r\nWARC/1.1\n</p>", 1), (3, None, None, 1), (4, "http://c.org", "", 1), (4, "http://c.org", "", 1), (9, "u", "z" * 300_000, 1)], "page_id long, url string, html string, digest int").repartition(3)
    rows = warc.round_trip(pages).collect()
    b32 = lambda s: base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in rows) == sorted((p["page_id"], len((p["html"] or "").encode()), b32(p["html"])) for p in pages.collect())
    kinds = collections.Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in rows)
    assert kinds == {(1, "revisit", 2): 1, (2, "response", None): 1, (3, "revisit", 4): 1, (4, "response", None): 1, (4, "revisit", 4): 1, (9, "response", None): 1}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_arc_header_lines_by_version():
    import io

    v2 = b"filedesc://f 0.0.0.0 20010203040506 text/plain 200 - - 0 f 14\n2 0 org\nURL x\n\n" + b"dns:a.org 1.2.3.4 200102030405 text/dns 200 - - 0 f 3\nabc\n" + b"http://a b/ 1.2.3.4 20010203 text/html 404 - - 9 f 50\nHTTP/1.0 404 Gone\r\n\r\nshort"
    rows = [warc.converted(r) for r in warc.arc_records(io.BytesIO(v2), "f")]
    assert [(r["kind"], r["url"], r["date"], r["truncated"], r["payload_bytes"]) for r in rows[1:]] == [("resource", "dns:a.org", "2001-02-03T04:05:00Z", False, 3), ("response", "http://a b/", "2001-02-03T00:00:00Z", True, 5)]
    assert rows[0]["kind"] == "warcinfo" and len({r["record_id"] for r in rows}) == 3


def test_top_k_of_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk_blocks.top_k(none).count() == 0


def test_packing_ids_pieces_and_bins(docs):
    rows = corpus()
    got = packing.packed_documents(docs(rows).repartition(3), *PATHS).collect()
    tok, by = Tokenizer.from_file(PATHS[0]), {(r["doc_id"], r["piece"]): r for r in got}
    total = 0
    for d, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        total += len(ids)
        first = len(ids) % 1024 or 1024
        for k, (a, b) in enumerate(itertools.pairwise([0, *range(first, len(ids) + 1, 1024)])):
            r = by.pop((d, k))
            assert (r["start"], r["length"], r["ids_crc32"]) == (a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes()))
    assert not by
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in map(sorted, bins.values()):
        assert v[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(v)) and sum(v[-1]) <= 1024
        assert sum(3 * n > 1024 for _, n in v) <= 2
    assert len(bins) <= -(-total // 1024) * 1.2 + 1
    assert packing.packed_documents(docs(rows).limit(0), *PATHS).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 101): rng.randrange(1, 500) for _ in range(60)}
    used = collections.defaultdict(list)
    placed = collections.Counter()
    for length, first, last, start, each, at in packing.plan(counts, 100):
        for i in range(last - first):
            used[start + i // each].append((at + i % each * length, length))
        placed[length] += last - first
    assert placed == counts
    assert all(sum(n for _, n in v) <= 100 and sorted(v)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(sorted(v))) for v in used.values())


def test_base_rules_and_thresholds(spark, docs):
    rows = corpus(3) + [(900, "a b c " * 300), (901, "line one\nline one\n \n| x |"), (902, "Is onhe. " * 2000)]
    labels = spark.createDataFrame([(d, 1, 0) for d, _ in rows if d % 2] * 2, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_llr.judged(docs(rows), labels).collect()}
    for d, t in rows:
        w = WORD.findall(t or "")
        count, covered, seen, dup = collections.Counter(zip(w, w[1:], w[2:])), set(), set(), 0
        for i in range(len(w) - 2):
            if count[tuple(w[i : i + 3])] > 1:
                covered |= {i, i + 1, i + 2}
        for line in (t or "").split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered), failed)
        assert not (failed and r["kept"])
    none = quality_llr.judged(docs(rows), labels.limit(0)).collect()
    assert all(r["kept"] != r["base_failed"] and abs(r["llr"]) < 1e-12 for r in none)
    assert quality_llr.judged(docs(rows).limit(0), labels).count() == 0


def test_lines_of_a_host(docs):
    rows = [(i, f"menu\nown {i}\n\n menu ", "en", "a") for i in range(30)] + [(100 + i, f"menu\nown {i}", "en", None) for i in range(9)] + [(200, "menu\nrare", "en", "b"), (200, "menu\nrare", "en", "b"), (201, None, "en", "a"), (202, "", "en", "a"), (203, "menu\nother", "en", "b")]
    rows += [(300 + i, "copied\npage", "en", "c") for i in range(50)] + [(400, "copied\nnot", "en", "c"), (401, "x " * 60_000 + "\nfooter", "en", "c"), (402, "y\nfooter", "en", "c"), (403, "footer", "en", "c")]
    clash = docs(rows).withColumns({"h": F.lit("own"), "often": F.lit("own"), "row": F.lit("own"), "t": F.lit("own"), "n_lines": F.lit("old")})
    got = {r["doc_id"]: r for r in line_frequency.cleaned(clash).collect()}
    assert got[3]["text"] == "own 3\n" and (got[3]["n_lines"], got[3]["n_removed"], got[3]["extra"]) == (3, 2, "x")
    assert got[100]["text"] == "own 0" and got[200]["text"] == "menu\nrare" and got[201]["text"] is None and got[202]["text"] == ""
    assert got[203]["n_removed"] == 0 and got[300]["text"] == "copied\npage" and [got[k]["n_removed"] for k in (400, 401, 402, 403)] == [0, 1, 1, 1]
    assert {r["h"] for r in got.values()} == {r["often"] for r in got.values()} == {"own"}
    assert line_frequency.cleaned(docs(rows).limit(0)).count() == 0


def test_languages_by_phrases(docs):
    rng = random.Random(5)
    syllables = {"aa": ["ba", "ko", "lu", "mi", "ta"], "bb": ["schr", "ung", "eit", "pf", "och"], "cc": ["éa", "oué", "çè", "eaux", "oi"]}
    make = lambda k, n: " ".join("".join(rng.choices(syllables[k], k=3)) for _ in range(n))
    rows = [(i, make(k := "aabbcc"[i % 3 * 2 :][:2], rng.randrange(3, 400)), k, "s") for i in range(150)] + [(900, None, "aa"), (901, "123 !!", "aa"), (902, "", None), (903, make("bb", 20000), None)]
    got = {r["doc_id"]: r for r in cross_parse.predicted(docs(rows)).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k, _ in rows[:150])
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "bb"]
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for d, r in got.items())
    assert {r["lang_pred"] for r in cross_parse.predicted(docs([(1, "abc", None)])).collect()} == {"und"}
    assert cross_parse.predicted(docs(rows).limit(0)).count() == 0


def phrases(source, symbols):
    """Greedy longest matches of ``symbols`` in ``source``; a block starts a phrase anew."""
    n = 0
    for at in range(0, len(symbols), cross_parse.BLOCK):
        block, i = symbols[at : at + cross_parse.BLOCK], 0
        while i < len(block):
            k = 1
            while i + k < len(block) and block[i : i + k + 1] in source:
                k += 1
            i, n = i + k, n + 1
    return n


def test_phrases_are_longest_matches():
    rng = random.Random(3)
    texts = {"x": "abracadabra banana", "y": "абракадабра 漢字漢語", "z": "".join(rng.choices("ab c", k=3000))}
    p = cross_parse.Parser(texts)
    probes = ["abracadabra", "bananabra", "zzabz", "a", "cadab ban", "абра 漢字", "Ж漢语", "".join(rng.choices("abcz ", k=2000)), "ab" * 700]
    codes = [p.symbols.codes(t) for t in probes]
    source = [p.symbols.codes(texts[k]).tobytes() for k in sorted(texts)]
    assert p.phrases(codes).tolist() == [[phrases(s, c.tobytes()) for c in codes] for s in source]


def test_languages_of_other_scripts_and_little_text(docs):
    rng = random.Random(9)
    make = lambda letters, n: " ".join("".join(rng.choices(letters, k=rng.randrange(2, 7))) for _ in range(n))
    ru, uk = ["пре", "ово", "ние", "ыть", "шла"], ["пре", "ові", "ння", "їть", "йшл"]
    zh, ja = ["的是", "中国", "人民", "大学", "天气"], ["の", "日本", "です", "人", "大学"]
    sets = {"en": ["th", "ing", "er", "on", "wh"], "ru": ru, "uk": uk, "zh": zh, "ja": ja}
    rows = [(i, make(sets[k], 60 if k != "uk" else 12), k) for i, k in enumerate(list(sets) * 24)]
    rows += [(900 + i, make(sets[k], 9), None) for i, k in enumerate(list(sets) * 6)]
    table = docs(rows).withColumns({"id": F.lit(1), "r": F.lit(2), "l": F.lit(3), "lang_pred": F.lit("old")})
    got = {r["doc_id"]: r["lang_pred"] for r in cross_parse.predicted(table).collect()}
    assert [got[900 + i] for i in range(30)] == list(sets) * 6
    kept = cross_parse.accepted(table, 0.9).collect()
    assert len(kept) == len(rows) and all(r["lang"] == (rows[r["doc_id"]][2] if r["doc_id"] < 900 else list(sets)[(r["doc_id"] - 900) % 5]) and r["lang_pred"] == "old" for r in kept)


def near(rows, width, percent):
    sets = {}
    for d, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = frozenset([tuple(w)] if 0 < len(w) < width else zip(*(w[k:] for k in range(width))))
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {d: (len(s), top(d)) for d, s in sets.items()}


@pytest.mark.parametrize(("width", "percent", "frequent"), [(4, 85, 500_000), (5, 80, 500_000), (4, 85, 0)])
def test_near_components(docs, monkeypatch, width, percent, frequent):
    """Frequent tokens come out of one chunk here, so that most of a near-copy group is indexed by pairs of tokens."""
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent or 1)
    rows = corpus(7, 150) + [(d + 1000, t) for d, t in corpus(8, 90)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_components(docs(rows).repartition(4), width, percent).collect()}
    assert got == near(rows, width, percent)


def test_near_components_of_edge_rows(docs):
    got = jaccard_join.near_components(docs([(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (None, None), (7, "")])).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == [("5", 2, "5"), ("5", 2, "5"), ("7", 0, "7"), ("None", 0, "None"), ("None", 2, "5")]
    assert jaccard_join.near_components(docs([]).limit(0)).count() == 0
    assert jaccard_join.one_of_each(docs([(5, "a b c d e"), (5, "a b c d e"), (6, "a b c d e"), (7, None)])).count() == 2


def test_texts_that_share_an_id_are_texts_of_their_own(docs):
    one, two, three = (" ".join(words(random.Random(k), 60)) for k in (1, 2, 3))
    rows = [(5, one), (5, two), (6, three), (7, one + " more"), (4, two + " more"), (None, one), (8, two), (8, two), (9, three), (9, one)]
    got = jaccard_join.near_components(docs(rows).withColumn("doc", F.lit("own")).repartition(3)).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == [("4", "4"), ("5", "4"), ("5", "5"), ("6", "6"), ("7", "5"), ("8", "4"), ("8", "4"), ("9", "5"), ("9", "6"), ("None", "5")]
    kept = jaccard_join.one_of_each(docs(rows).withColumns({"_id": F.lit("own"), "th": F.lit("own"), "root": F.lit("own")})).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == sorted([("4", two + " more"), ("5", one), ("6", three), ("None", one)])


def test_repeated_bytes(docs):
    rng = random.Random(2)
    rows = corpus(11, 60) + [(500, "ab " * 300), (501, "é" * 400), (502, "q" * 99), (503, "q" * 100), (504, "q" * 250)]
    block = "".join(rng.choices("abcdefgh ", k=260))
    rows += [(600 + i, "".join(rng.choices("xyz ", k=rng.randrange(90))) + block[rng.randrange(60) :] + str(i) * rng.randrange(60)) for i in range(25)]
    rng.shuffle(rows)
    got = {r["doc_id"]: r for r in repeated_bytes.deduplicated(docs(rows).repartition(5)).collect()}
    seen = set()
    for d, t in sorted(rows):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(raw[i : i + 100])
        spans = sum(1 for k, _ in itertools.groupby(gone.tolist()) if k)
        r = got[d]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()), d
    assert repeated_bytes.deduplicated(docs(rows).limit(0)).count() == 0


def test_shards(docs):
    rows = [(d, t, "en", f"s{d % 4}") for d, t in corpus(4, 200)] + [(1000 + i, "copy of a hot page", None, None) for i in range(90)]
    got = kd_shards.sharded(docs(rows)).collect()
    size = {d: len((t or "").encode()) + 1 for d, t, *_ in rows}
    load, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (size[r["doc_id"]], zlib.crc32((dict((x[0], x[1]) for x in rows)[r["doc_id"]] or "").encode()), "bytes", None)
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(got) == len(rows) and set(load) <= set(range(16))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(load.values()) <= sum(load.values()) / 16 + max(size.values())
    assert kd_shards.sharded(docs(rows).limit(0)).count() == 0


def test_names_with_one_beginning_are_told_apart(docs):
    rows = [(i, f"text {i} " + "w " * 20, "language-" + "ab"[i % 2], f"https://site{i % 8}.example") for i in range(800)]
    got = {r["grp"]: r for r in kd_shards._dimensions(kd_shards.points(docs(rows))).collect()}
    assert {r["d_source"] for r in got.values()} == set(range(8)) and {r["d_lang"] for r in got.values()} == {0, 1}
    shard = {r["doc_id"]: r["shard"] for r in kd_shards.sharded(docs(rows)).collect()}
    assert all(len({shard[i] for i, *_, s in rows if s.endswith(f"site{k}.example")}) <= 8 for k in range(8))


def test_copies_stay_together_up_to_a_share_of_a_shard(docs):
    rows = [(i, f"own text {i} " + "w " * 40) for i in range(1500)] + [(5000 + 10 * k + i, f"copied page {k}") for k in range(60) for i in range(5)]
    shard = {r["doc_id"]: r["shard"] for r in kd_shards.sharded(docs(rows).repartition(3)).collect()}
    assert all(len({shard[5000 + 10 * k + i] for i in range(5)}) == 1 for k in range(60))


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.1, 8).tolist()) for i in range(700)] + [(i, [0.5] * 8) for i in range(700, 720)] + [(50, [0.25] * 8), (800, None), (850, [float("nan")] * 8), (900, [None] + [0.0] * 7), (950, [1.0, 2.0]), (None, [0.9] * 8)]
    got = topk_blocks.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), size=128).collect()
    ok = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if v and None not in v and not np.isnan(v).any()]
    want = []
    for n, (i, q) in enumerate(ok):
        if i is not None and i % 50 == 0:
            s = sorted(((-int(q @ v), j is None, j or 0, j) for m, (j, v) in enumerate(ok) if m != n and len(v) == len(q)))[:5]
            want += [(i, k + 1, x[3], -x[0]) for k, x in enumerate(s)]
    assert sorted((r["query_id"], r["rank"], str(r["vec_id"]), r["score"]) for r in got) == sorted((a, b, str(c), d) for a, b, c, d in want)


def test_mix_reaches_targets_and_repeats(docs):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60)), None, ("a", "b", "c", "é", None)[min(4, i % 9)]) for i in range(3000)] + [(5000, None, None, "a"), (5001, "", None, "zero")]
    one, two = ({r["doc_id"]: r for r in flow_mix.mixed(docs(rows).repartition(k)).collect()} for k in (3, 5))
    assert {d: r["taken"] for d, r in one.items()} == {d: r["taken"] for d, r in two.items()}
    taken, of = collections.Counter(), {}
    for d, t, _, s in rows:
        n = len(WORD.findall(t or ""))
        assert one[d]["size"] == n and one[d]["taken"] <= 2 * n
        taken[s] += one[d]["taken"]
        of[s] = one[d]["target"], one[d]["source_size"]
    assert abs(sum(t for t, _ in of.values()) - 1.5 * sum(s for _, s in of.values())) < 1e-6
    assert all(t <= 2 * s and abs(taken[k] - t) <= 60 for k, (t, s) in of.items())
    assert flow_mix.repeated(docs(rows)).count() == sum(r["taken"] // r["size"] for r in one.values() if r["size"])
    assert flow_mix.mixed(docs(rows).limit(0)).count() == 0


def test_ratios_equal_counts_by_hand(docs, spark):
    import xxhash

    signed = lambda v: v - (1 << 64) if v >> 63 else v
    one = lambda w, seed=42: xxhash.xxh64(w.encode(), seed=seed % (1 << 64)).intdigest()
    rows = corpus(5, 40)
    labels = spark.createDataFrame([(d, 1, 0) for d, _ in rows if d % 3 == 0], "doc_id long, quality int, toxic int")

    def cells(t):
        w = WORD.findall(t or "")
        return [signed(one(x)) % quality_llr.BUCKETS for x in w] + [signed(one(b, one(a))) % quality_llr.BUCKETS for a, b in zip(w, w[1:])]

    raw, good = collections.Counter(), collections.Counter()
    for d, t in rows:
        raw.update(cells(t))
        good.update(cells(t) if d % 3 == 0 else [])
    n, g = sum(raw.values()), sum(good.values())
    ratio = {c: np.log((good[c] + quality_llr.PRIOR * k / n) / (g + quality_llr.PRIOR) / (k / n)) for c, k in raw.items()}
    threshold = -0.001
    for r in quality_llr.judged(docs(rows), labels, threshold=threshold).collect():
        own = cells(dict(rows)[r["doc_id"]])
        want = sum(ratio[c] for c in own) / len(own) if own else 0.0
        assert abs(r["llr"] - want) < 1e-9 and r["kept"] == (not r["base_failed"] and r["llr"] >= threshold)


def test_members_route_words_between_sources(docs):
    """Copies that count for two sources give their first use where it is wanted; quotas are met and nothing is taken three times."""
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{i}" for _ in range(rng.randrange(5, 30))), None, "ab"[i % 2]) for i in range(600)]
    both = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array("source"))
    got = {r["doc_id"]: r for r in flow_mix.mixed(docs(rows).repartition(3), members=both).collect()}
    supply = collections.Counter()
    for i, t, _, s in rows:
        supply[("a", "b") if i % 3 == 0 else (s,)] += len(t.split())
    size = {s: sum(w for p, w in supply.items() if s in p) for s in "ab"}
    want = flow_mix.targets([("a", size["a"]), ("b", size["b"])])
    flow = flow_mix.min_cost_flow(dict(supply), {s: round(w) for s, w in want.items()})
    for p, w in supply.items():
        taken = sum(got[i]["taken"] for i, _, _, s in rows if (("a", "b") if i % 3 == 0 else (s,)) == p)
        assert abs(taken - sum(flow[p, s] for s in p)) <= 30
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got.values()) and {r["source_size"] for r in got.values()} == set(size.values())


def test_flow_shares_patterns_at_least_cost():
    flow = flow_mix.min_cost_flow({("a",): 10, ("a", "b"): 10, ("b",): 5}, {"a": 12, "b": 20})
    assert sum(v for (p, s), v in flow.items() if s == "a") == 12 and sum(v for (p, s), v in flow.items() if s == "b") == 20
    assert sum(v for (p, s), v in flow.items() if p == ("a",)) == 10  # no second use while another pattern's first is free
