"""Rules met over the literals of their patterns, against trying every rule on every text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gavelwork.operators import learning


@pytest.mark.parametrize(("pattern", "literal"), [
    (r"EXPEDIENTE:? ?N? ?([0-9]+-[0-9]+)", "expediente"), (r"FINCA ([0-9]+)", "finca"), (r"BASE DEL REMATE: B/.([0-9,.]+)", "remate"), (r"([\d\-]+)", ""),
    (r"(?:AVISO|EDICTO) 12", ""), (r"ABC?", ""), (r"ABCD?", "abc"), (r"(ABCDE)?xyz", "xyz"), (r"((ABCDE)x)*xyz{2}", ""), (r"a(?=LOOK)b", ""), (r"\0123", ""), (r"\x41BC", ""),
    (r"\QFINCA (\E", ""), (r"[ABC]+DEFG+H", "defg"), (r"JUZGADO\ (.+?)(?:$|\s)", ""), (r"(uno (dos (tres) cuatro))", "cuatro"), (r"x{100,200}yyy", "yyy"), (r"(PAR{1,3}TE)+cola", "cola"), ("", "")])
def test_literals(spark, pattern, literal):
    got = spark.createDataFrame([(pattern,)], "p string").select(learning.required_literal(F.col("p")).alias("x")).first()["x"]
    assert got == literal or (len(got) == len(literal) and got in pattern.lower())


def test_thousands_of_rules_equal_trying_all(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefghijk", k=rng.randrange(2, 8))).upper() for _ in range(400)]
    make = lambda: rng.choice([
        f"{rng.choice(vocabulary)} ([0-9]+)", f"{rng.choice(vocabulary)}", f"{rng.choice(vocabulary)[:3]}?{rng.choice(vocabulary)}", f"(?:{rng.choice(vocabulary)}|{rng.choice(vocabulary)}) (\\d)",
        f"{rng.choice(vocabulary)}\\s+{rng.choice(vocabulary)}", f"({rng.choice(vocabulary)} )?{rng.choice(vocabulary)} ([A-K]{{3}})", "[0-9]{7}"])
    rules = [(f"f{i % 7}", i, make(), 0.5 + i % 5 / 10, f"2024-{1 + i % 12:02}-01", "approved" if i % 9 else "pending") for i in range(3000)]
    texts = [(i, " ".join(rng.choice([*vocabulary, str(rng.randrange(10**7))]).lower() if rng.random() < 0.5 else rng.choice(vocabulary) for _ in range(rng.randrange(0, 40)))) for i in range(80)] + [(100, ""), (101, None)]
    got = learning.apply_rules(spark.createDataFrame(texts, "document_id long, text string"),
                               spark.createDataFrame(rules, "field_name string, rule_id long, pattern string, confidence double, created_at string, status string")).collect()
    want = {}
    for field, rule, pattern, confidence, created, status in sorted(rules, key=lambda r: (r[4], -r[1])):
        if status == "approved":
            for d, t in texts:
                m = re.search(pattern, t or "", re.I | re.M)
                if m:
                    want[d, field] = ((m[1] if re.search(r"\((?!\?)", pattern) else m[0]) or "").strip(), rule, round(confidence * 0.9, 4)
    assert {(r["document_id"], r["field_name"]): (r["value"], r["rule_id"], r["confidence"]) for r in got} == want
    assert len(want) > 100


def test_rules_are_not_joined_on_the_field_alone(spark):
    t = spark.createDataFrame([(1, "FINCA 5", "finca")], "document_id long, text string, field_name string")
    r = spark.createDataFrame([("finca", 1, "FINCA ([0-9]+)", 0.5, "2024", "approved"), ("lote", 2, "FINCA ([0-9]+)", 0.5, "2024", "approved")], "field_name string, rule_id long, pattern string, confidence double, created_at string, status string")
    out = learning.apply_rules(t, r)
    assert [tuple(x) for x in out.collect()] == [(1, "finca", "5", 1, 0.45)]
    joins = [x for x in out._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in x]
    assert joins and all("tri" in x for x in joins)
