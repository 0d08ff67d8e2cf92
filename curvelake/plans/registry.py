"""Named queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a builder; without SQL the driver checks row counts only."""

    def add(build: Build) -> Build:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, build, sql)
        return build

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def r(expression: str, digits: int = 6) -> str:
    """SQL rounding without negative zero."""
    return f"(round({expression}, {digits}) + 0)"


def fmod(x: str, p: str) -> str:
    return f"(({x}) - ({p}) * floor(({x}) / ({p})))"


def phase(t: str = "t", t0: str = "t0", p: str = "P") -> str:
    return f"({fmod(f'({t} - {t0}) / {p} + 5e-1', '1e0')} - 5e-1)"


def phase_days(t: str = "t", t0: str = "t0", p: str = "P") -> str:
    return f"({fmod(f'{t} - {t0} + 5e-1 * {p}', p)} - 5e-1 * {p})"


SPARSE = (
    "cad AS (SELECT user_id AS object_id, (epoch_us(ts) - 1704067200000000) / 86400e6 AS t, value AS flux, "
    "event_id, event_type FROM events)"
)
DENSE = (
    "cad AS (SELECT l_suppkey AS object_id, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) "
    "AS DOUBLE) AS t, l_extendedprice AS flux FROM lineitem)"
)
_P = "(5e-1 + (object_id % 25) * 5e-1)"
EPH = (
    f"eph AS (SELECT object_id, {_P} AS P, (object_id % 7) / 1e1 * {_P} AS t0, 5e-2 * {_P} AS duration "
    "FROM (SELECT DISTINCT object_id FROM cad))"
)
_PD = "(3e1 + (object_id % 40) * 5e0)"
EPH_DENSE = (
    f"eph AS (SELECT object_id, {_PD} AS P, (object_id % 7) / 1e1 * {_PD} AS t0, 5e-2 * {_PD} AS duration "
    "FROM (SELECT DISTINCT object_id FROM cad))"
)
CATALOG = (
    "cat AS (SELECT p_partkey AS object_id, p_name AS name, CAST(p_size AS DOUBLE) AS P, "
    "(round((p_retailprice - 85e1) / 1e3, 6) + 0) AS RpRs, 3e0 + p_partkey % 47 AS aRs, "
    "(p_partkey % 110) / 1e2 AS b, p_brand AS facility, p_type AS kind FROM part)"
)
LINE_ORDER_SQL = (
    "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, "
    "l_returnflag, l_linestatus, l_shipdate"
)
