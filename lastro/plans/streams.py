"""Streams over the benchmark tables (STRM-00, CMP-02 online)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import table
from ..streaming import restated, windows
from .registry import SQL, query


def _stream(spark, sf_dir, name):
    """The table as a stream of its files."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


@query(SQL["restatements"])
def online_restatements(spark, sf_dir):
    """STRM-00, CMP-02: the statuses of ``restatements`` as the state of a stream."""
    orders = _stream(spark, sf_dir, "orders").where("o_orderdate < timestamp'1998-01-01' or o_orderdate >= timestamp'2001-01-01'")
    cells = orders.select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("value"), "o_orderkey", "o_orderdate")
    state = restated.restated_state(cells, ["k"], "value", "o_orderkey", F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp"))
    return restated.run_updates(state, ["k"], "online-restatements")


@query("""
WITH e AS (SELECT user_id, ts, ts - lag(ts) OVER w >= INTERVAL 12 HOUR OR lag(ts) OVER w IS NULL AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS n FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM s WHERE user_id IS NOT NULL GROUP BY user_id, s.n""")
def user_sessions(spark, sf_dir):
    """STRM-00: sessions of users, parted by twelve hours without an event."""
    found = windows.session_lengths(table(spark, sf_dir, "events").where("user_id is not null"), "12 hours")
    return found.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")
