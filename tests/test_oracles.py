"""Every registered query against its SQL in DuckDB."""

import os

import duckdb
import pytest

from tarmac.plans import catalog
from tarmac.streaming import replay

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr(tuple(r[i] for i in order)) for r in found)


def same(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    expected = database(sf_dir).sql(sql)
    assert rows(df.columns, df.collect()) == rows(expected.columns, expected.fetchall())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, name):
    same(spark, sf_dir, catalog.queries()[name], catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(replay.queries()))
def test_stream(spark, sf_dir, name):
    same(spark, sf_dir, replay.queries()[name], replay.oracle_sql()[name])


@pytest.mark.parametrize("name", ["dashboard_overview", "dashboard_cards", "dashboard_overview_rows"])
@pytest.mark.parametrize("rule", ["true", "false"])
def test_no_incidents(spark, tmp_path, sf_dir, name, rule):
    """Events that never slow down, or none: the history is empty."""
    duckdb.sql(f"COPY (SELECT * REPLACE (5::DOUBLE AS value) FROM '{sf_dir}/events.parquet' WHERE {rule}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    same(spark, str(tmp_path), catalog.queries()[name], catalog.oracle_sql()[name])


def test_more_than_a_page(spark, tmp_path, sf_dir):
    """250 segments slow down and stay so: the overview of rows counts them all."""
    values = "SELECT 'p' || s AS event_type, k, CASE WHEN k < 8 THEN 30 ELSE 2 END AS speed FROM range(250) a(s), range(12) b(k)"
    duckdb.sql(f"COPY (SELECT row_number() OVER () AS event_id, TIMESTAMP '2024-01-01' + to_hours((k // 4 * 3)::INT) AS ts, 1::BIGINT AS user_id, event_type, speed::DOUBLE AS value, '' AS props FROM ({values})) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    assert catalog.queries()["dashboard_overview_rows"](spark, str(tmp_path)).first().active_incidents == 250
    same(spark, str(tmp_path), catalog.queries()["dashboard_overview_rows"], catalog.oracle_sql()["dashboard_overview_rows"])
