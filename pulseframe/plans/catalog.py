"""Registry of the queries and the SQL they are checked with."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from pulseframe.plans.frames import Tables, check_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}
_MODULES = ("tables", "rows", "profiles", "relations", "models", "live")


def query(name: str, check: str | None = None, frames: Sequence[str] = ()):
    """Register ``fn(tables)``; ``check`` may use the derived tables named in ``frames``."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Tables(spark, folder))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if check is not None:
            body = check.strip()
            if frames:
                head = check_ctes(frames)
                body = f"WITH {head},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head}\n{body}"
            CHECKS[name] = body
        return fn

    return wrap


def load() -> None:
    for m in _MODULES:
        importlib.import_module(f"pulseframe.plans.queries_{m}")
