"""Where queries and their SQL are registered."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _long_counts(sql: str) -> str:
    """count_if gives a wider integer in the checking engine than here."""
    out, at = [], 0
    while (i := sql.find("count_if(", at)) >= 0:
        depth, j = 0, i + len("count_if")
        while True:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
            if not depth:
                break
        out += [sql[at:i], "CAST(", sql[i:j], " AS BIGINT)"]
        at = j
    return "".join(out) + sql[at:]


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame; sql says the same for an independent check."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = _long_counts(sql)
        return f

    return wrap


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
