"""Docket search, interval join and regions against plain Python on small texts."""

import random
import re

from gavelwork.operators import matching


def test_anchors_of_any_length(spark):
    rng = random.Random(4)
    dockets = ["7", "12", "0001", "12-345", "2012-00536", "05001-31-03-001-2012-00536-00", "99999999", "31-03-001-2012-00536-00", "sin", "", "123456789012", "923456789012"]
    texts = [(i, "".join(rng.choice(["a ", "1", "2", "0", "9", "\n", *dockets]) for _ in range(rng.randrange(0, 60)))) for i in range(60)] + [(90, None), (91, ""), (92, "9" * 40), (93, "8" * 510 + "05001-31-03-001-2012-00536-00" + "8" * 600 + "12-345")]
    got = matching.docket_anchors(spark.createDataFrame(texts, "document_id long, text string"), spark.createDataFrame([(x,) for x in dockets], "expediente string"))
    want = set()
    for d, t in texts:
        for x in dockets:
            k = re.sub(r"\D", "", t or "").find(re.sub(r"\D", "", x)) if re.sub(r"\D", "", x) else -1
            if k >= 0:
                want.add((x, d, k + 1))
    rows = [(r["expediente"], r["document_id"], r["at"]) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_ranges_of_any_size(spark):
    rng = random.Random(5)
    points = [(rng.randrange(3), rng.randrange(900)) for _ in range(300)]
    ranges = [(rng.randrange(3), i, a, a + rng.choice([0, 1, 7, 64, 500])) for i in range(120) for a in [rng.randrange(900)]]
    got = matching.range_lookup(spark.createDataFrame(points, "d long, pos long"), spark.createDataFrame(ranges, "d long, i long, start long, `end` long"), "d", width=64)
    assert sorted((r["d"], r["pos"], r["i"]) for r in got.collect()) == sorted((d, p, i) for d, p in points for e, i, a, b in ranges if d == e and a <= p < b)


def test_regions_are_blocks_or_lines(spark):
    text = "portada 55555555\nEJ . uno 2012-00536\nfin de 1\n\n  DIV . dos\n77 77-1999 x\n--- PÁGINA 3 ---\nsin bloque 40-2001 aquí\notra línea 40-2001\nEJ. tres 8\n"
    rows = matching.anchored_regions(spark.createDataFrame([(1, text), (2, "nada")], "document_id long, text string"),
                                     spark.createDataFrame([("2012-00536",), ("7777-1999",), ("40-2001",), ("5555-5555",), ("nope",)], "expediente string")).collect()
    got = {r["expediente"]: (r["document_id"], r["pagina"], r["texto"]) for r in rows}
    assert got == {"2012-00536": (1, 1, "EJ . uno 2012-00536\nfin de 1\n"), "7777-1999": (1, 1, "\n  DIV . dos\n77 77-1999 x"),
                   "40-2001": (1, 3, "sin bloque 40-2001 aquí"), "5555-5555": (1, 1, "portada 55555555")}


def test_a_document_of_many_anchors_is_split(spark):
    text = "\n".join(f"EJ. {10_000 + i}-2001 caso" for i in range(3000))
    rows = matching.anchored_regions(spark.createDataFrame([(1, text)], "document_id long, text string"), spark.createDataFrame([(f"{10_000 + i}-2001",) for i in range(0, 3000, 7)], "expediente string")).collect()
    assert len(rows) == 429 and all(r["texto"].strip() == f"EJ. {r['expediente']} caso" for r in rows)
