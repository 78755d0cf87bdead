"""Registered queries on values that the given tables hold seldom: zeros, gaps, large sums."""

import datetime as dt
import random

import pytest

from tidemark.operators import metrics, windows
from tidemark.plans import audit_queries, causal_queries, fiscal_queries  # noqa: F401 - these register their queries
from tidemark.plans.catalog import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")


def both(spark, folder, name, tables: dict[str, str]):
    """Rows of a query and of its SQL over tables that DuckDB makes."""
    con = duckdb.connect()
    for table, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    # text, so that NaN and infinity compare
    as_text = lambda rows: sorted(repr(tuple(r)) for r in rows)
    return as_text(QUERIES[name](spark, str(folder)).collect()), as_text(con.execute(ORACLES[name]).fetchall())


def events(*rows) -> str:
    """Events of one user, (type, value) a minute apart."""
    at = dt.datetime(2024, 1, 1)
    return " UNION ALL ".join(f"SELECT {i + 1}::BIGINT AS event_id, TIMESTAMP '{at + dt.timedelta(minutes=i)}' AS ts, 1::BIGINT AS user_id, '{k}' AS event_type, {'NULL' if v is None else v}::DOUBLE AS value" for i, (k, v) in enumerate(rows))


def test_attached_history_divides_by_zero(spark, tmp_path):
    got, want = both(spark, tmp_path, "j20_j21_attached_history", {"events": events(("purchase", 0.0), ("view", 5.0), ("view", 0.0), ("view", None), ("purchase", 2.0), ("view", 3.0))})
    assert got == want and any("inf" in r for r in got) and any("nan" in r for r in got)


def test_frame_hash_passes_63_bits(spark, tmp_path):
    orders = "SELECT range AS o_orderkey, range % 7 AS o_custkey, CASE WHEN range < 100 THEN 'few' ELSE 'many' END AS o_orderstatus FROM range(200000)"
    duckdb.sql(f"COPY ({orders}) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    got = {r.o_orderstatus: (r.n, r.digest) for r in QUERIES["q8_frame_hash"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS {orders}")
    exact = {k: (n, s) for k, n, s in con.execute("SELECT o_orderstatus, count(*), sum(('0x' || substr(md5(o_orderkey || ':' || o_custkey), 1, 12))::BIGINT) FROM orders GROUP BY 1").fetchall()}
    assert got["few"] == exact["few"] and exact["many"][1] >= 1 << 63
    assert got["many"] == (exact["many"][0], (exact["many"][1] + (1 << 63)) % (1 << 64) - (1 << 63))


def test_pareto_of_any_number_of_candidates(spark):
    rng = random.Random(3)
    rows = [(i, i / 300, i / 300 + (0.0 if i % 3 else rng.random()), rng.choice([0.1, 0.2])) for i in range(300)] + [(900, None, 1.0, 1.0), (901, 0.5, 0.5, 0.1), (902, 0.5, 0.5, 0.1)]
    rows += [(1000 + i, rng.uniform(0.2, 1), rng.uniform(0, 1), rng.uniform(0, 1)) for i in range(2000)]
    beats = lambda o, r: None not in o + r and o[1] <= r[1] and o[3] <= r[3] and o[2] >= r[2] and o[1:] != r[1:]
    want = {r[0] for r in rows if not any(beats(o, r) for o in rows)}
    df = spark.createDataFrame(rows, "k long, cost double, gain double, risk double")
    for most in (7, 20_000):
        assert {r.k for r in metrics.pareto(df, "k", ["cost", "risk"], ["gain"], most).collect()} == want


def test_shrinkage_counts_zeros(spark, tmp_path):
    # ids not divisible by seven keep their values
    got, want = both(spark, tmp_path, "w12_weekly_median_shrinkage", {"events": events(*[("view", v) for v in (3.0, 0.0, 5.0, 2.0, 9.0, 4.0, None, 1.0, 0.0, 0.0, 0.0, 7.0, 8.0)])})
    assert got == want


def test_ar1_ends_with_the_last_known_value(spark):
    s = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 0.5), ("a", 2, 0.25), ("a", 3, None)], "k string, t long, x double")
    assert windows.ar1(s, ["k"], "t", "t", "x", least=1).select("pairs", "rho", "last_value").first() == (2, 0.5, 0.25)
