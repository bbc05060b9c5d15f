"""Every query of the library against its reference SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from lodestream.plans.catalog import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(value):
    if value is None:
        return "null"
    if isinstance(value, float):
        return "null" if value != value else f"{value:.6g}"
    if isinstance(value, bool):
        return str(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir)
    want = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(columns, want.fetchall())


def test_contexts_past_midnight(spark, tmp_path):
    """A day whose last window goes on past midnight, alone or behind others; rows without a user."""
    clocks = [(1, "2024-01-02 09:00:00.5"), (1, "2024-01-02 23:59:10"), (1, "2024-01-02 23:59:40.25"), (2, "2024-01-03 23:59:50"), (3, "2024-01-02 23:59:29.999"), (3, "2024-01-05 23:59:59"), (None, "2024-01-02 10:00:00")]
    rows = ", ".join(f"({i}, {'NULL' if u is None else u}, TIMESTAMP '{t}', 'view', 1.0)" for i, (u, t) in enumerate(clocks))
    duck = duckdb.connect()
    duck.execute(f"CREATE TABLE events AS SELECT v.a::BIGINT AS event_id, v.b::BIGINT AS user_id, v.c AS ts, v.d AS event_type, v.e::DOUBLE AS value FROM (VALUES {rows}) v(a, b, c, d, e)")
    duck.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    want = duck.execute(ORACLE_SQL["context_parse"])
    columns = [d[0] for d in want.description]
    got = QUERIES["context_parse"](spark, str(tmp_path))
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_others_give_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_module(spark, monkeypatch):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["item_id", "doc_id", "score", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    monkeypatch.setattr(entry, "_has_llm", lambda: False)
    assert set(entry.queries()) == set(QUERIES)
