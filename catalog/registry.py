"""Registry of queries and their SQL twins."""

QUERIES, ORACLES = {}, {}


def query(name, sql=None, **types):
    """Register ``fn(spark, sf_dir) -> DataFrame`` and, where SQL can say it, the twin.

    ``types`` names columns whose type the other engine would choose differently.
    """
    if sql is not None and types:
        casts = ", ".join(f'CAST("{c}" AS {t}) AS "{c}"' for c, t in types.items())
        sql = f"SELECT * REPLACE ({casts}) FROM ({sql}) AS twin"

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
