"""Register of queries: name -> (job over the given tables, SQL oracle)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tideline.plans.frames import Frames, with_ctes

_JOBS: dict[str, Callable[[Frames], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, *ctes: str, sql: str | None = None):
    """Registers a job; ``sql`` is its oracle, with the named derivations in front."""

    def register(job: Callable[[Frames], DataFrame]):
        if name in _JOBS:
            raise ValueError(f"query {name} is registered twice")
        _JOBS[name] = job
        if sql is not None:
            _SQL[name] = with_ctes(*ctes, body=sql)
        return job

    return register


def _load() -> None:
    from tideline.plans import detecting, evidencing, labelling, loading, marting  # noqa: F401


def jobs() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, folder, job=job: job(Frames(spark, folder))) for name, job in _JOBS.items()}


def oracles() -> dict[str, str]:
    _load()
    return dict(_SQL)
