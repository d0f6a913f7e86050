"""Hot groups and whole results: order-dependent operators against brute force on data where one key holds a third of the rows."""

import random

from pyspark.sql import functions as F

from gavelwork.operators import dedup, matching, ordered
from gavelwork.sources import views as v


def rows(n=300, seed=7):
    r = random.Random(seed)
    out = []
    for i in range(1, n + 1):
        hot = i % 3 == 0
        out.append((i, "HOT" if hot else f"E{r.randint(1, 60)}", "F1" if hot and r.random() < 0.5 else f"F{r.randint(2, 80)}",
                    None if r.random() < 0.2 else str(r.randint(1, 50)), f"{r.randint(0, 5)}:{r.randint(0, 40)}", f"texto {i % 37}"))
    return out


def brute_levels(data):
    out = {}
    for k, cur in enumerate(data):
        dup = like = None
        for old in data[:k]:
            same = sum(1 for a, b in zip(cur[1:5], old[1:5]) if a is not None and a == b)
            if same >= 2 or (same >= 1 and cur[5] == old[5]):
                dup = dup or old[0]
            elif same == 1:
                like = old[0]
        out[cur[0]] = ("DUPLICATED", dup) if dup else ("LIKELY_DUPLICATED", like) if like else ("UNIQUE", None)
    return out


def test_duplicate_levels_match_a_full_scan(spark):
    data = rows()
    df = spark.createDataFrame(data, "id long, expediente string, finca string, base string, bbox string, text string")
    got = {r["id"]: (r["nivel"], r["matched_id"]) for r in dedup.duplicate_levels(df, width=20).collect()}
    want = brute_levels(data)
    for i, (level, match) in want.items():
        assert got[i][0] == level
        if level != "LIKELY_DUPLICATED":
            assert got[i][1] == match
        else:
            assert got[i][1] >= match


def test_neighbour_and_running_sum_split_hot_groups(spark):
    data = [("HOT" if i % 3 else f"k{i % 5}", i, i % 4) for i in range(500)]
    df = spark.createDataFrame(data, "k string, id long, x long")
    got = {r["id"]: r["p"] for r in ordered.neighbour(df, ["k"], ["id"], F.col("id"), F.floor(F.col("id") / 7), "p").collect()}
    last, want = {}, {}
    for k, i, _ in data:
        want[i] = last.get(k)
        last[k] = i
    assert got == want
    nxt = {r["id"]: r["p"] for r in ordered.neighbour(df, ["k"], ["id"], F.col("id"), F.floor(F.col("id") / 7), "p", previous=False).collect()}
    assert all(nxt[p] == i for i, p in want.items() if p is not None)
    sums = {r["id"]: r["s"] for r in ordered.running_sum(df, ["k"], ["id"], F.col("x"), F.floor(F.col("id") / 11), "s").collect()}
    acc = {}
    for k, i, x in data:
        acc[k] = acc.get(k, 0) + x
        assert sums[i] == acc[k]
    pos = {r["id"]: r["n"] for r in ordered.numbered(df, ["k"], "id", "n", width=13).collect()}
    seen = {}
    for k, i, _ in data:
        seen[k] = seen.get(k, 0) + 1
        assert pos[i] == seen[k]


def test_same_notice_with_one_hot_document(spark):
    r = random.Random(3)
    data = [(i, 1 if i % 3 else i, r.choice([None, f"1000{r.randint(1, 30)}"]), r.choice([None, f"5000{r.randint(10, 40)}"]), r.choice([None, r.randint(1, 5)]),
             r.choice([None, f"DEM{r.randint(1, 30)}"]), r.choice([None, f"ACT{r.randint(1, 3)}"])) for i in range(1, 121)]
    df = spark.createDataFrame(data, "id long, documento_id long, finca_matr string, expediente string, base int, demandado string, demandante string")
    got = {x["id"]: x["componente"] for x in dedup.same_notice(df, spark).collect()}

    def linked(a, b):
        if a[1] != b[1]:
            return False
        base = a[4] is None or b[4] is None or a[4] == b[4]
        party = a[5] and a[5] == b[5] and (a[6] is None or b[6] is None or a[6] == b[6])
        return bool((a[2] and a[2] == b[2]) or (a[3] and a[3] == b[3] and base) or (party and base))

    parent = {d[0]: d[0] for d in data}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(data):
        for b in data[:i]:
            if linked(a, b):
                x, y = sorted((find(a[0]), find(b[0])))
                parent[y] = x
    assert got == {d[0]: find(d[0]) for d in data}


def test_first_document_against_brute_force(spark, sf):
    texts = [(1, "Exp 123-45 y 9 9"), (2, "folio 12345"), (3, "987 65 fin"), (4, "nada")]
    dockets = [("12-345",), ("98765",), ("45-99",), ("55555",)]
    t = spark.createDataFrame(texts, "document_id long, text string")
    g = spark.createDataFrame(dockets, "expediente string")
    order = t.select("document_id", F.col("document_id").alias("orden"))
    got = {r["expediente"]: r["document_id"] for r in matching.first_document(matching.docket_anchors(t, g), g, order).collect()}

    def digits(s):
        return "".join(c for c in s if c.isdigit())

    want = {d: next((i for i, s in texts if digits(d) in digits(s)), 1) for (d,) in dockets}
    assert got == want


def test_best_pairing_against_brute_force(spark):
    r = random.Random(5)
    make = lambda off: [(off + i, i % 4, r.choice("AB"), r.choice("CD"), r.choice(["", "1.0", "10"])) for i in range(40)]
    left, right = make(0), make(100)
    s = "id long, document_id long, a string, b string, c string"
    got = {x["id"]: (x["rid"], x["score"]) for x in matching.best_pairing(spark.createDataFrame(left, s), spark.createDataFrame(right, s), ["a", "b", "c"]).collect()}

    def score(x, y):
        exact = sum(p == q for p, q in zip(x[2:], y[2:]))
        return exact, sum(p != q and p.replace(".", "") == q.replace(".", "") for p, q in zip(x[2:], y[2:]))

    for x in left:
        best = None
        for y in right:
            if y[1] == x[1]:
                e, n = score(x, y)
                if best is None or 2 * e + n > best[1]:
                    best = (y[0], 2 * e + n)
        assert got[x[0]] == (best[0], round(best[1] / 2 / 3, 4))


def test_contained_documents_with_many_copies(spark):
    data = [(1, i, ["ALFA", "BETA"]) for i in range(40)] + [(1, 100, ["ALFA", "BETA", "GAMA"]), (1, 101, ["DELTA"]), (2, 200, ["ALFA"])]
    df = spark.createDataFrame(data, "page long, doc_id long, words array<string>")
    got = {(r["a"], r["b"], r["copias_a"], r["copias_b"]) for r in matching.contained_documents(df).collect()}
    assert got == {(0, 0, 40, 40), (0, 100, 40, 1)}


def test_views_keep_every_notice(spark, sf):
    assert v.avisos(spark, sf).count() == v.table(spark, sf, "orders").count()


def test_similarity_of_matched_pairs(spark):
    import difflib
    pairs = [("AVISO DE REMATE finca 1", "aviso de remate finca 2"), ("uno", "otro texto"), ("", "x")]
    df = spark.createDataFrame([(i, a, b, "LIKELY_DUPLICATED") for i, (a, b) in enumerate(pairs)], "id long, text string, _text string, nivel string")
    got = {r["id"]: (r["similarity"], r["nivel"]) for r in dedup.near_text(df).collect()}
    for i, (a, b) in enumerate(pairs):
        want = round(difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio(), 4) if a and b else 0.0
        assert got[i] == (want, "DUPLICATED" if want > 0.9 else "LIKELY_DUPLICATED")


def test_near_texts_match_any_earlier_notice(spark):
    import difflib
    cols = "id long, expediente string, finca string, base string, bbox string, text string"
    three = [(1, "E", "F1", None, None, "AVISO DE REMATE de la finca inscrita al folio."), (2, "E", "F2", None, None, "otra cosa"), (3, "E", "F3", None, None, "AVISO DE REMATE de la finca inscrita al folio")]
    r = random.Random(3)
    bodies = [" ".join(r.choice(["remate", "finca", "juzgado", "folio", "base", "panama", "venta"]) + str(r.randint(0, 9)) for _ in range(n)) for n in (1, 2, 4, 6, 9, 30)]

    def changed(t):
        for _ in range(r.randint(0, max(1, len(t) // 9))):
            i = r.randrange(len(t))
            t = t[:i] + r.choice(["", "x", t[i] + "y", t[i].upper()]) + t[i + 1:]
        return t
    many = [row[:5] + (changed(r.choice(bodies)) if i % 20 else r.choice(["", None]),) for i, row in enumerate(rows(240, 5))]
    for data in (three, many):
        want = {}
        for k, cur in enumerate(data):
            want[cur[0]] = ("UNIQUE", None)
            for old in data[:k]:
                same = sum(1 for a, b in zip(cur[1:5], old[1:5]) if a is not None and a == b)
                near = same and cur[5] and old[5] and difflib.SequenceMatcher(None, cur[5].lower(), old[5].lower()).ratio() > 0.9
                if same >= 2 or near:
                    want[cur[0]] = ("DUPLICATED", old[0])
                    break
                if same:
                    want[cur[0]] = ("LIKELY_DUPLICATED", old[0])
        for direct in (0, 64):
            got = {x["id"]: (x["nivel"], x["matched_id"]) for x in dedup.near_levels(spark.createDataFrame(data, cols), width=20, direct=direct).collect()}
            assert {i: (g, want[i]) for i, g in got.items() if g != want[i]} == {} and len(got) == len(want)


def test_a_text_with_a_partner_meets_no_more_texts(spark, monkeypatch):
    import difflib
    from pyspark.sql.functions import pandas_udf

    asked = spark.sparkContext.accumulator(0)

    def counted():
        @pandas_udf("double")
        def ratio(a, b):
            asked.add(len(a))
            return a.combine(b, lambda x, y: difflib.SequenceMatcher(None, x, y).ratio())
        return ratio

    monkeypatch.setattr(dedup, "_ratio", counted)
    data = [(i, None, "F", None, None, f"AVISO de remate de la finca del norte {i:03}") for i in range(400)]
    out = dedup.near_levels(spark.createDataFrame(data, "id long, expediente string, finca string, base string, bbox string, text string"))
    assert {r["matched_id"] for r in out.filter("id > 0").collect()} == {0} and asked.value < 400 * 10
