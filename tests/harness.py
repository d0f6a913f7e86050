"""Compare a registered query with its oracle SQL on one scale factor."""

import math
import re

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
SPARK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _key(row):
    return tuple((v is not None, str(type(v)) if isinstance(v, bool) else "", v if v is not None else 0) for v in row)


def _norm(v):
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    return v


def compare(spark, con, sf_dir, name, fn, sql, exact=True):
    """Return (rows, problem); problem is None when both sides agree."""
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = [tuple(_norm(r[c]) for c in cols) for r in df.collect()]
    bad = [c for c in cols if types[c] not in SPARK_TYPES]
    if bad:
        return len(rows), f"output types {[(c, types[c]) for c in bad]}"
    if sql is None:
        return len(rows), None
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return len(rows), f"columns {cols} vs {sorted(names)}"
    want_types = {d[0]: str(d[1]).upper() for d in cur.description}
    order = [names.index(c) for c in cols]
    want = [tuple(_norm(r[i]) for i in order) for r in cur.fetchall()]
    got_types = {c: SPARK_TYPES[types[c]] for c in cols}
    alias = {"STRING": "VARCHAR", "NUMBER": "BIGINT"}
    mism = {c: (got_types[c], want_types[c]) for c in cols
            if alias.get(want_types[c], want_types[c]) != got_types[c]}
    if mism:
        return len(rows), f"types {mism}"
    if len(rows) != len(want):
        return len(rows), f"row count {len(rows)} vs {len(want)}"
    a, b = sorted(rows, key=_key), sorted(want, key=_key)
    for x, y in zip(a, b):
        if x != y:
            for c, p, q in zip(cols, x, y):
                if p != q and not (isinstance(p, float) and isinstance(q, float) and math.isnan(p) and math.isnan(q)):
                    return len(rows), f"first difference in {c}: spark {x} oracle {y}"
    return len(rows), None


def pattern_filter(names, pattern):
    return [n for n in names if not pattern or re.search(pattern, n)]
