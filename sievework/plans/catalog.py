"""All queries of the engine by name."""

from __future__ import annotations

from ..session import ship_package
from . import audits, cohorts, corpus, pairs, selections, tables  # noqa: F401
from .registry import ORACLES, QUERIES


def _shipped(f):
    def run(spark, sf_dir):
        ship_package(spark)
        return f(spark, sf_dir)

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


def queries() -> dict:
    return {name: _shipped(f) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
