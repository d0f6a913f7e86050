"""Keyed streaming state over lots: several runs equal one, an exported memory goes on elsewhere, late publications are set aside."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gavelwork.operators import dedup
from gavelwork.streaming import memory

NOTICE = "id long, expediente string, finca string, base string, bbox string, text string"


@pytest.fixture(scope="module")
def notices(spark):
    rng = random.Random(2)
    some = lambda n: rng.choice([None, *map(str, range(n))])
    return spark.createDataFrame([(i, some(30), some(12), some(25), "hot" if i % 3 else some(9), None) for i in range(240)], NOTICE)


def levels(df):
    return {r["id"]: (r["nivel"], r["matched_id"]) for r in df.select("id", "nivel", "matched_id").collect()}


def test_lots_equal_one_batch(spark, notices):
    want, seen, got = levels(dedup.duplicate_levels(notices)), memory.DuplicateMemory(spark), {}
    for a, b in ((0, 100), (100, 100), (100, 170), (170, 999)):
        got |= levels(seen.run(notices.filter(f"id >= {a} AND id < {b}")))
    assert got == want and {x for x, _ in got.values()} == {"UNIQUE", "LIKELY_DUPLICATED", "DUPLICATED"}


def test_an_exported_memory_goes_on(spark, notices):
    one = memory.DuplicateMemory(spark, ttl_days=30)
    got = levels(one.run(notices.filter("id < 120")))
    kept = one.exported()
    two = memory.DuplicateMemory(spark, loaded=kept)
    got |= levels(two.run(notices.filter("id >= 120")))
    assert got == levels(dedup.duplicate_levels(notices))
    want = {(r["k"], r["v"]): (r["f"], r["l"]) for r in memory.key_entries(notices).groupBy("k", "v").agg(F.min("id").alias("f"), F.max("id").alias("l")).collect()}
    assert {(r["k"], r["v"]): (r["first"], r["last"]) for r in two.exported().collect()} == want


def test_republications_by_lots(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    lots = [
        [(1, "a", day(0), "10"), (2, "a", day(3), "10"), (3, "a", day(2), "99"), (4, "b", day(0), None), (5, "c", day(20), "5")],
        [(6, "a", day(19), "7"), (7, "c", day(22), None), (8, "c", day(18), "5"), (9, "d", day(5), "1"), (10, "b", day(17), "1")],
        [(11, "c", day(40), "5"), (12, "c", day(41), "6"), (13, "c", day(19), "5")]]
    job, got = memory.Republications(spark), {}
    for lot in lots:
        for r in job.run(spark.createDataFrame(lot, "id long, clave string, fecha date, base string")).collect():
            assert r["id"] not in got
            got[r["id"]] = r["resultado"], r["otro_id"]
    assert got == {1: ("reemplazado", 2), 3: ("duplicado_sospechoso", 1), 2: ("vigente", None), 4: ("vigente", None), 5: ("reemplazado", 7), 8: ("reemplazado", 5),
                   9: ("tarde", None), 10: ("tarde", None), 6: ("vigente", None), 7: ("vigente", None), 12: ("duplicado_sospechoso", 11), 13: ("tarde", None)}
    assert [r["id"] for r in job.open().collect()] == [11]
