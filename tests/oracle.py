"""Compare the registered queries with their SQL twins: `python -m tests.oracle <folder> [name part ...]`."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from brackish.session import job

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_float_dtype(df[c]):
            df[c] = df[c].map(lambda x: None if pd.isna(x) else f"{x:.6f}")
        else:
            df[c] = df[c].map(lambda x: None if x is None or x is pd.NA or x != x else str(x))
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def kind(dtype: str) -> str:
    dtype = dtype.lower()
    for family, names in {
        "double": ("double", "float", "decimal"),
        "long": ("bigint", "long", "hugeint"),
        "int": ("int", "integer", "smallint"),
        "string": ("string", "varchar"),
        "bool": ("boolean", "bool"),
    }.items():
        if any(dtype.startswith(n) for n in names):
            return family
    return dtype


def compare(spark, con, folder: str, name: str, build, sql: str | None) -> str:
    """An empty string when both agree, otherwise what differs."""
    with job(spark):
        return _compare(con, build(spark, folder), sql)


def _compare(con, df, sql: str | None) -> str:
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "CartesianProduct" in plan or "NestedLoop" in plan:
        return "the plan forms a product"
    got = df.toPandas()
    if sql is None:
        return "" if len(got) else "no rows"
    rel = con.sql(sql)
    want_types = {c: kind(str(t)) for c, t in zip(rel.columns, rel.types)}
    got_types = {c: kind(t) for c, t in df.dtypes}
    want = rel.df()
    if sorted(got_types) != sorted(want_types):
        return f"columns {sorted(got_types)} vs {sorted(want_types)}"
    notes = [f"type of {c}: {got_types[c]} vs {want_types[c]}" for c in got_types if got_types[c] != want_types[c]]
    for c, t in df.dtypes:
        if t == "date":
            want[c] = want[c].map(lambda x: None if pd.isna(x) else str(x)[:10])
    if len(got) != len(want):
        return "; ".join([*notes, f"rows {len(got)} vs {len(want)}"])
    if not len(got):
        return "; ".join([*notes, "no rows on either side"])
    a, b = _canonical(got), _canonical(want)
    bad = (a.fillna("<null>") != b.fillna("<null>")).any(axis=1)
    if bad.any():
        i = bad.idxmax()
        notes.append(f"{int(bad.sum())} of {len(a)} rows differ, e.g.\n   got  {a.loc[i].to_dict()}\n   want {b.loc[i].to_dict()}")
    return "; ".join(notes)


def main() -> int:
    import logging

    logging.disable(logging.CRITICAL)
    from __spark_entry__ import oracle_sql, queries
    from brackish import build_session

    folder, parts = sys.argv[1], sys.argv[2:]
    spark = build_session("oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="12g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, failed = connect(folder), oracle_sql(), 0
    for name, build in queries().items():
        if parts and not any(name.startswith(p) for p in parts):
            continue
        start = time.time()
        try:
            note = compare(spark, con, folder, name, build, sql.get(name))
        except Exception as e:
            note = f"{type(e).__name__}: {str(e)[:300]}"
        failed += bool(note)
        print(f"{'FAIL' if note else 'ok  '} {time.time() - start:6.2f}s {name}{'' if name in sql else ' (rows only)'} {note}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
