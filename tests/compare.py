"""Run queries in Spark and their oracles in DuckDB and compare whole results."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import tempfile
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from fixture_queries.views import ALL_TABLES  # noqa: E402

#: The tables that the tests read.
SF_DIR = "/root/testdata/sf0.001"


def local_session(cpus: int = 8, memory: str = "12g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("covermart-checks")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="covermart-checks-"))
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in ALL_TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')"
        )
    return connection


def _plain(value):
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, decimal.Decimal):
        return str(float(value))
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_plain(v) for v in value) + "]"
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, connection, sf_dir: str, name: str, query, oracle: str | None) -> str:
    started = time.perf_counter()
    frame = query(spark, sf_dir)
    ours = rows_of(frame.columns, frame.collect())
    took = time.perf_counter() - started
    if oracle is None:
        return f"rows={len(ours)} {took:.1f}s (no oracle)"
    result = connection.execute(oracle)
    columns = [c[0] for c in result.description]
    theirs = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(frame.columns):
        return f"DIFFERENT columns {sorted(frame.columns)} {sorted(columns)}"
    if ours != theirs:
        only_ours = sorted(set(ours) - set(theirs))[:2]
        only_theirs = sorted(set(theirs) - set(ours))[:2]
        return (
            f"DIFFERENT {len(ours)} vs {len(theirs)} rows; "
            f"differing {len(set(ours) ^ set(theirs))}\n   ours {only_ours}\n   oracle {only_theirs}"
        )
    return f"same rows={len(ours)} {took:.1f}s"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.001"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/{sf}"
    spark, connection = local_session(), duck(sf_dir)
    oracles, failed = oracle_sql(), 0
    for name, query in queries().items():
        if wanted and name not in wanted:
            continue
        try:
            outcome = compare(spark, connection, sf_dir, name, query, oracles.get(name))
        except Exception as error:  # report and go on with the other queries
            outcome = f"DIFFERENT error {str(error)[:600]}"
        failed += outcome.startswith("DIFFERENT")
        print(f"{name}: {outcome}", flush=True)
    print(f"failed: {failed}")
    return failed


if __name__ == "__main__":
    sys.exit(main())
