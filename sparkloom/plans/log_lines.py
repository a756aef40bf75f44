"""A deterministic log over the ``events`` table, in three layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def log_lines(spark: SparkSession, sf_dir: str, carried: bool = False) -> DataFrame:
    """source, log_idx and raw: one line for each event.  A table of fewer splits than there
    are cores is dealt out, as a folder of log files would be.

    From user 65,536 on the third octet, as in the SQL below, is over 255 and the word no
    address; ``carried``: the second one takes the carry, so that every user has an address."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    cores = spark.sparkContext.defaultParallelism
    if len(e.inputFiles()) < cores:
        e = e.repartition(cores)
    level = F.expr("case event_type when 'error' then 'ERROR' when 'purchase' then 'WARN' when 'signup' then 'NOTICE' when 'click' then 'INFO' else 'DEBUG' end")
    octets = "pmod(user_id div 65536, 256), '.', pmod(user_id div 256, 256), '.', pmod(user_id, 256)" if carried else "'0.', user_id div 256, '.', user_id % 256"
    ip = F.expr(f"concat('10.', {octets})")
    tail = F.expr("concat('user=', user_id, ' ', event_type, ' took ', cast(floor(value) as bigint), ' ms')")
    ts = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    raw = (
        F.when(F.col("event_type") == "click", F.concat_ws("|", ts, level, ip, tail))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("["), ts, F.lit("] ["), level, F.lit("] "), ip, F.lit(' "POST /buy" '), tail))
        .otherwise(F.concat(F.lit("["), ts, F.lit("] ["), level, F.lit("] "), ip, F.lit(" "), tail))
    )
    return e.select(F.lit("events").alias("source"), F.col("event_id").alias("log_idx"), raw.alias("raw"))


#: The same lines in DuckDB, as CTE "l", with the values they are made of.
LOG_LINES_SQL = """
b AS (
  SELECT event_id AS log_idx, event_type, user_id, ts,
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'NOTICE' WHEN 'click' THEN 'INFO' ELSE 'DEBUG' END AS level,
    '10.0.' || CAST(user_id // 256 AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR) AS ip,
    CAST(floor(value) AS BIGINT) AS ms, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t
  FROM events
), l AS (
  SELECT *, 'user=' || CAST(user_id AS VARCHAR) || ' ' || event_type || ' took ' || CAST(ms AS VARCHAR) || ' ms' AS tail,
    CASE event_type WHEN 'click' THEN t || '|' || level || '|' || ip || '|' || tail
      WHEN 'purchase' THEN '[' || t || '] [' || level || '] ' || ip || ' "POST /buy" ' || tail
      ELSE '[' || t || '] [' || level || '] ' || ip || ' ' || tail END AS raw
  FROM b
)
"""
