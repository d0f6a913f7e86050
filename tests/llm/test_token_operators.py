"""Token counts, fill-in-middle and alignment against brute force: nulls, empty and long texts, repeated rows, clashing names, empty tables."""

import collections
import hashlib
import random
import re

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from gavelwork.llm import byte_bpe, fill_middle, token_align, token_counts

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def texts(seed=1, n=40):
    """Shared passages, blanks of every kind, marks, scripts without blanks, long runs, special strings."""
    rng = random.Random(seed)
    words = [f"w{rng.randrange(500)}" for _ in range(400)]
    passage = " ".join(rng.choices(words, k=300))
    out = [None, "", " ", "\n\t ", "a", " a", "a ", "a  b", "<P>", "x <S> y", "m <M>", "<|endoftext|> </s> <s> <unk> <0x41>", "a▁b ▁ c", "\x00\x1f\x85\xa0 x", "é" * 3000, "漢字仮名交じり文" * 400, "q" * 5000, " " * 4000, "\n" * 2500, "🦉 owl " * 300, "🦉" * 900]
    for i in range(n):
        t = rng.choice(["", " ", "\n"]).join(rng.choices([*words, "  ", "\n\n", "ünïcode", "漢"], k=rng.randrange(1, 600)))
        out.append(t + passage + t if i % 3 == 0 else t + rng.choice(["", " ", "\t\n"]))
    return [*enumerate(out), (900, "copy of one"), (900, "copy of one"), (None, "no id here"), (None, None), (901, " ".join(rng.choices(words, k=40_000)))]


def test_token_counts_equal_whole_text_encoding(docs):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = texts()
    got = token_counts.counted(docs(rows).withColumn("n_tokens", F.lit("old")).repartition(3), PIECES, limit=200).collect()
    want = sorted((str(d), len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 200) for d, t in rows)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == want
    assert got[0]["extra"] == "x" and token_counts.counted(docs([]).limit(0), PIECES).count() == 0


@pytest.mark.parametrize("piece", [1, 3, 50, 1024])
def test_no_token_spans_a_part(piece):
    lengths = token_counts.Lengths(PIECES, piece)
    whole = [t for _, t in texts(2, 15) if t]
    assert lengths.of(whole) == [len(ids) for ids in lengths.model.encode(whole)]
    assert all("".join(t[a:b] for a, b in lengths.parts(t)) == t for t in whole)
    assert max(b - a for a, b in lengths.parts("漢字仮名交じり文" * 400)) <= max(piece, 8)


def fim(doc, text):
    """(n, form, prefix, middle, output) by the plain rule."""
    t, hexed = text or "", hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(hexed[8 * k : 8 * k + 8], 16) for k in range(4)]
    u = UNIT.findall(t)
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(u), "plain", None, None, t
    return (len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_equals_the_plain_rule(docs):
    rows = texts(3, 150)
    clash = docs(rows).withColumns({"n": F.lit("old"), "_t": F.lit("kept"), "_cut": F.lit("kept")}).repartition(3)
    out = fill_middle.transformed(clash)
    got = out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in got), key=key) == sorted(((d, *fim(d, t), t or "") for d, t in rows), key=key)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"} and {r["_t"] for r in got} == {r["_cut"] for r in got} == {"kept"}
    assert fill_middle.transformed(docs([]).limit(0)).count() == 0


def test_chunks_follow_content_and_share_summaries():
    rng = random.Random(4)
    shared = " ".join(f"w{rng.randrange(9999)}" for _ in range(4000)).encode()
    one, two = b"first " * 99 + shared, "zweite é ".encode() * 73 + shared
    chunks = lambda raw: (ends := fill_middle.edges(raw)) and {raw[a:b] for a, b in zip([0, *ends], ends)}
    parts = [chunks(one), chunks(two)]
    assert len(parts[0] & parts[1]) > 0.8 * len(parts[0])
    cache = fill_middle.Chunks()
    cache.cuts(one, 1, 2)
    before = len(cache.young)
    cache.cuts(two, 1, 2)
    assert len(cache.young) - before == len(parts[1] - parts[0])
    for raw in (b"a" * 100_000, b"", b" " * 70, bytes(range(256)) * 900):
        ends = fill_middle.edges(raw)
        assert (ends[-1:] or [0]) == [len(raw)] and all(0 < b - a <= fill_middle.MOST for a, b in zip([0, *ends], ends))


def test_cache_forgets_the_older_generation(monkeypatch):
    monkeypatch.setattr(fill_middle, "CACHE_BYTES", 2000)
    cache, rng = fill_middle.Chunks(), random.Random(5)
    for _ in range(200):
        t = "".join(rng.choices("ab \n", k=rng.randrange(1, 900)))
        u = UNIT.findall(t)
        n, a, b = cache.cuts(t.encode(), 10**9 + 7, 5)
        x, y = sorted(((10**9 + 7) % (len(u) + 1), 5 % (len(u) + 1)))
        assert (n, a, b) == (len(u), len("".join(u[:x])), len("".join(u[:y])))
    assert sum(map(len, (*cache.young, *cache.old))) < 4000 + 2 * fill_middle.MOST


def test_both_encoders_split_low_characters_alike():
    both = byte_bpe.ByteBpe(*PATHS, special=False)
    for c in map(chr, range(0x240)):
        for t in (f"a{c}b {c}{c} 1{c}2 {c}", f"{c} x{c}", f"  {c}\n{c}9"):
            assert both.ranked.encode_ordinary(t) == both.whole.encode(t, add_special_tokens=False).ids, hex(ord(c))


def measured(rows):
    """Per row (n_a, n_b, n_groups, n_links, n_best, count_sum, groups) by comparing all tokens of a text."""
    both = token_align.Aligner(*PATHS, PIECES)
    kept = []
    for _, t in rows:
        ids = both.ids(t, t.encode()) if t else None
        if ids is None:
            kept.append(None)
            continue
        spans = []
        for tokens, table in zip(ids, (both.bytes_a, both.bytes_b)):
            at, out = 0, []
            for i in tokens.tolist():
                out.append((at, at := at + len(table[i]), i))
            spans.append(out)
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        cuts = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        inside = lambda side, a, b: ",".join(str(x[2]) for x in side if a < x[1] <= b)
        kept.append((len(ids[0]), len(ids[1]), links, ";".join(f"{inside(spans[0], a, b)}|{inside(spans[1], a, b)}" for a, b in zip([0, *cuts], cuts)), len(cuts)))
    count = collections.Counter(p for k in kept if k for p in k[2])
    most = collections.defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    none = (0, 0, 0, 0, 0, 0, "")
    return [(k[0], k[1], k[4], len(k[2]), sum(count[p] == most[p[1]] for p in k[2]), sum(count[p] for p in k[2]), k[3]) if k else none for k in kept]


@pytest.mark.parametrize("head", [200_000, 40, 0])
def test_alignment_equals_all_overlaps(docs, head):
    """A small head sends most pairs through the shuffle, none sends all of them."""
    rows = [(d, (t or "")[:900] if t is not None else None) for d, t in texts(6, 25)]
    rows += [(1000 + i, "hot copy, viele Male") for i in range(60)]
    table = docs(rows).withColumns({"key": F.lit("own"), "id": F.lit("own"), "n_a": F.lit("old")}).repartition(4)
    got = token_align.aligned(table, *PATHS, PIECES, keep_groups=True, head=head).collect()
    want = [(str(d), *m[:6], hashlib.sha256(m[6].encode()).hexdigest() if m[0] else "", m[6]) for (d, _), m in zip(rows, measured(rows))]
    assert sorted((str(r["doc_id"]), *(r[c] for c in token_align.MEASURES), r["groups_sha256"], r["groups"]) for r in got) == sorted(want)
    assert {r["key"] for r in got} == {r["id"] for r in got} == {"own"}


def test_alignment_of_an_empty_table(docs):
    assert token_align.aligned(docs([]).limit(0), *PATHS, PIECES).count() == 0
    only = token_align.aligned(docs([(1, None), (2, ""), (3, "a▁b")]), *PATHS, PIECES).collect()
    assert sorted((r["doc_id"], r["n_a"], r["count_sum"], r["groups_sha256"]) for r in only) == [(1, 0, 0, ""), (2, 0, 0, ""), (3, 0, 0, "")]


def test_long_texts_align_as_whole_texts():
    both = token_align.Aligner(*PATHS, PIECES)
    for t in (t for _, t in texts(8, 6) if t):
        assert both.b.ids(t) == both.b.model.encode(t)
