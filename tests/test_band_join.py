"""The pairs of a band join are cut into parts whose ids fit a dictionary page."""

import duckdb
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lodestream.plans import catalog


def test_parts_keep_their_ids_as_a_dictionary(spark, tmp_path):
    at = F.timestamp_millis(F.lit(1_704_067_200_000) + F.col("id") * 8_000)
    events = spark.range(300_000).select(F.col("id").alias("event_id"), at.alias("ts"), (F.col("id") % 7).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"))
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    catalog.QUERIES["band_self_join"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/pairs")
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "pairs").glob("*.parquet")]
    chunks = [m.row_group(i).column(c) for m in files for i in range(m.num_row_groups) for c in (1, 2)]
    assert chunks and not any("PLAIN" in c.encodings for c in chunks if c.num_values)

    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * REPLACE (ts AT TIME ZONE 'UTC' AS ts) FROM '{tmp_path}/events.parquet/*.parquet'")
    got, want = f"(FROM '{tmp_path}/pairs/*.parquet')", f"({catalog.ORACLE_SQL['band_self_join']})"
    total = "SELECT count(*), sum(hash(day, a_id, b_id, gap_ms)::HUGEINT) FROM "
    assert db.sql(total + got).fetchall() == db.sql(total + want).fetchall() != [(0, None)]


def test_pairs_of_many_clips_at_a_time_compress(spark, tmp_path):
    # 100 clips at each of 120 instants, 25 s apart, in no order
    at = F.timestamp_millis(F.lit(1_704_067_200_000) + (F.col("id") % 120) * 25_000 + F.col("id") % 7)
    events = spark.range(12_000).select(F.col("id").alias("event_id"), at.alias("ts"), F.floor(F.col("id") / 120).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"))
    events.orderBy(F.xxhash64("event_id")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    catalog.QUERIES["band_self_join"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/pairs")

    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * REPLACE (ts AT TIME ZONE 'UTC' AS ts) FROM '{tmp_path}/events.parquet/*.parquet'")
    got, want = f"(FROM '{tmp_path}/pairs/*.parquet')", f"({catalog.ORACLE_SQL['band_self_join']})"
    total = "SELECT count(*), sum(hash(day, a_id, b_id, gap_ms)::HUGEINT) FROM "
    found = db.sql(total + got).fetchall()
    assert found == db.sql(total + want).fetchall()
    n_bytes = sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet"))
    assert n_bytes < found[0][0]
