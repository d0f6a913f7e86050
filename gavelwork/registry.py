"""Registry of queries: each Spark query next to the SQL that checks it."""

QUERIES = {}
ORACLES = {}


def query(name, oracle=None, views=()):
    """Register ``fn(spark, sf_dir) -> DataFrame``; ``oracle`` is SQL over ``views`` and the tables."""

    def register(fn):
        from gavelwork.plans.oracle import compose

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = compose(views, oracle)
        return fn

    return register
