"""Registry of named queries: a Spark plan and, where SQL can say it, the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fettle.plans.oracle_views import compose
from fettle.plans.workload import DEVELOPMENT_KEY, Workload

Plan = Callable[[Workload], DataFrame]
PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_bodies: dict[str, tuple[str, str]] = {}
_shared: dict[tuple[str, str], Workload] = {}


def workload(spark: SparkSession, folder: str) -> Workload:
    """One workload per application and folder: stages that feed many results are written once."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _shared:
        _shared[key] = Workload(spark, folder, DEVELOPMENT_KEY, settled=True)
    return _shared[key]


def _shape(df: DataFrame, spec: str) -> DataFrame:
    """``name`` as is, ``name*`` rounded to 6 decimals, ``name#`` as a whole number."""
    out = []
    for item in spec.split():
        name = item.rstrip("*#")
        if item.endswith("*"):
            out.append((F.round(F.col(name).cast("double"), 6) + F.lit(0.0)).alias(name))
        elif item.endswith("#"):
            out.append(F.col(name).cast("long").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def _shape_sql(body: str, spec: str) -> str:
    out = []
    for item in spec.split():
        name = item.rstrip("*#")
        if item.endswith("*"):
            out.append(f'round(CAST("{name}" AS DOUBLE), 6) + 0e0 AS "{name}"')
        elif item.endswith("#"):
            out.append(f'CAST("{name}" AS BIGINT) AS "{name}"')
        else:
            out.append(f'"{name}"')
    return compose(f"SELECT {', '.join(out)} FROM ({body})")


def query(name: str, spec: str | None = None, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan; ``spec`` gives the output columns of both sides."""
    def register(plan: Plan) -> Plan:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            df = plan(workload(spark, folder))
            return _shape(df, spec) if spec else df

        PLANS[name] = run
        if sql is not None:
            _bodies[name] = (sql, spec)
        return plan

    return register


def oracles() -> dict[str, str]:
    return {name: _shape_sql(body, spec) for name, (body, spec) in _bodies.items()}
