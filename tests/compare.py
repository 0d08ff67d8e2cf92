"""Run registered queries beside their SQL in DuckDB and report differences."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def ordered(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for column in frame.columns:
        if str(frame[column].dtype) in ("boolean", "bool"):
            frame[column] = frame[column].astype(object)
    for column in frame.columns:
        if frame[column].dtype == object:
            frame[column] = frame[column].map(lambda v: None if v is pd.NA else v if v is None or isinstance(v, (str, bool, int, float)) else repr(v))
    key = frame.astype(str).agg("|".join, axis=1) if len(frame.columns) else frame.index
    return frame.iloc[np.argsort(key.to_numpy(), kind="stable")].reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for column in got.columns:
        a, b = got[column].dtype.kind, want[column].dtype.kind
        if a != b and {a, b} - {"O", "b", "f"} and len(got):
            return f"type of {column}: {got[column].dtype} != {want[column].dtype}"
    a, b = ordered(got), ordered(want)
    for column in a.columns:
        left, right = a[column].astype(str), b[column].astype(str)
        same = left == right
        if not same.all():
            at = int(np.argmin(same.to_numpy()))
            return f"{column}: {int((~same).sum())} of {len(a)} differ, first {left[at]} != {right[at]}\n{a.iloc[at].to_dict()}\n{b.iloc[at].to_dict()}"
    return None


def run(spark, sf_dir: str, names=None) -> dict[str, str]:
    from curvelake.operators.grouped import release
    from curvelake.plans import load_registry

    bad, con = {}, duck(sf_dir)
    for name, q in load_registry().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            got = q.build(spark, sf_dir).toPandas()
            spent = time.time() - start
            problem = "no rows" if len(got) == 0 else None
            if q.sql:
                begun = time.time()
                want = con.execute(q.sql).df()
                problem = problem or difference(got, want)
                spent_sql = time.time() - begun
            else:
                spent_sql = float("nan")
        except Exception as error:
            spent, spent_sql, problem = time.time() - start, 0.0, f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok ' if not problem else 'BAD'} {name:34s} {spent:6.2f}s sql {spent_sql:5.2f}s {problem or f'{len(got)} rows'}", flush=True)
        if problem:
            bad[name] = problem
        release()
        spark.catalog.clearCache()
    return bad


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from curvelake.session import get_session

    scale, *wanted = sys.argv[1:]
    conf = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
            "spark.driver.host": "127.0.0.1"}
    session = get_session("compare", master="local[8]", **conf)
    session.sparkContext.setLogLevel("OFF")
    failed = run(session, f"/root/testdata/sf{scale}", wanted)
    print(f"{len(failed)} bad: {sorted(failed)}")
