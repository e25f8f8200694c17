"""Compare registered queries with their SQL twins: ``python tests/check.py SF_DIR [name ...]``."""

from __future__ import annotations

import sys
import tempfile
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from ocrspark.session import get_spark  # noqa: E402

SPARK_TO_DUCK = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
}


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def compare(spark, con, name: str, sf_dir: str) -> tuple[float, str | None]:
    """Seconds of the Spark run, and None if both sides agree, else what differs."""
    out = tempfile.mkdtemp(prefix="run-") + "/out"
    start = time.time()
    df = entry.queries()[name](spark, sf_dir)
    df.write.parquet(out)
    took = time.time() - start
    con.execute(f"create or replace temp table want as {entry.oracle_sql()[name]}")
    con.execute(f"create or replace temp view got as select * from '{out}/*.parquet'")
    want_types = {r[0]: r[1] for r in con.sql("describe want").fetchall()}
    types = {c: SPARK_TO_DUCK.get(t, t) for c, t in df.dtypes}
    if types != want_types:
        return took, f"types {types} != {want_types}"
    cols = ", ".join(f'"{c}"' for c in want_types)
    n_got, n_want = (con.sql(f"select count(*) from {t}").fetchall()[0][0] for t in ("got", "want"))
    if n_got != n_want:
        return took, f"{n_got} rows != {n_want}"
    if not n_got:
        return took, "no rows"
    more = con.sql(f"select {cols} from got except all select {cols} from want").fetchall()
    if more:
        less = con.sql(f"select {cols} from want except all select {cols} from got limit 1").fetchall()
        return took, f"{len(more)} of {n_got} rows differ, {cols}: spark {more[0]} sql {less[0]}"
    return took, None


def session(cores: int = 8):
    return get_spark(
        "check", f"local[{cores}]",
        **{
            "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false",
        },
    )


if __name__ == "__main__":
    sf, wanted = sys.argv[1], sys.argv[2:]
    spark, con = session(), oracle(sf)
    spark.sparkContext.setLogLevel("ERROR")
    for q in wanted or entry.queries():
        start, took = time.time(), 0.0
        try:
            took, note = compare(spark, con, q, sf)
        except Exception as err:  # report and go on with the next query
            note = "ERROR " + str(err)[:600]
            if len(wanted) == 1:
                traceback.print_exc()
        print(f"{q:24s} spark {took:6.1f}s  all {time.time() - start:6.1f}s  {note or 'ok'}", flush=True)
