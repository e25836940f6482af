"""Queries on the event stream, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import series
from paperloom.session import shared_root
from paperloom.sources.tables import table
from paperloom.streaming import bursts as stream

HOUR = 60


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events", "event_id", "ts", "user_id", "event_type").withColumn("ts", F.col("ts").cast("timestamp"))


def _now(spark: SparkSession, folder: str) -> str:
    return str(table(spark, folder, "events", "ts").agg(F.max("ts").cast("string")).first()[0])


def q_bucket_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Events of each type by hour from the first event, hours without any as 0."""
    return series.bucket_counts(_events(spark, folder), "event_type", "ts", HOUR)


def _values(spark: SparkSession, folder: str) -> DataFrame:
    return series.series_of(series.bucket_counts(_events(spark, folder), "event_type", "ts", HOUR))


def q_zscore(spark: SparkSession, folder: str) -> DataFrame:
    """Last hour against those before."""
    return _values(spark, folder).select("term", F.round(series.z_score(F.col("values")), 6).alias("z"))


def q_velocity(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted slope and second difference of the last hours."""
    return _values(spark, folder).select("term", F.round(series.velocity(F.col("values")), 6).alias("velocity"), series.acceleration(F.col("values")).alias("acceleration"))


def q_ewma(spark: SparkSession, folder: str) -> DataFrame:
    """The last smoothed value of each type."""
    return _values(spark, folder).select("term", F.round(F.element_at(series.smoothed(F.col("values")), -1), 6).alias("ewma"))


def q_heat(spark: SparkSession, folder: str) -> DataFrame:
    """Decayed mentions of each type."""
    return series.heat(_events(spark, folder), "event_type", "ts", _now(spark, folder)).select("term", F.round("heat", 6).alias("heat"))


def q_bursts(spark: SparkSession, folder: str) -> DataFrame:
    """Users that burst at the end of the stream."""
    return series.bursts(_events(spark, folder), "user_id", "ts", _now(spark, folder)).withColumn("score", F.round("score", 4))


def q_breaking(spark: SparkSession, folder: str) -> DataFrame:
    """Users with an uncommon share of their events in the last two days."""
    return series.breaking(_events(spark, folder), "user_id", "ts", _now(spark, folder), window=60 * 48, least=3, share=0.08)


def q_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Users with errors: attempts, and whether to leave them alone."""
    return series.failures(_events(spark, folder), "user_id", "ts", F.col("event_type") == "error", _now(spark, folder), 24.0, 3).select("key", "attempts", "skip")


def q_consecutive_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Errors of each user since the last event that was none."""
    return series.consecutive(_events(spark, folder), "user_id", "ts", "event_id", F.col("event_type") == "error")


def q_quota_by_day(spark: SparkSession, folder: str) -> DataFrame:
    """Uses by local day, three days kept."""
    return series.quota_days(_events(spark, folder), "event_type", "ts", "America/Los_Angeles").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def q_queue_tail(spark: SparkSession, folder: str) -> DataFrame:
    """The 500 users queued last, each once."""
    return series.queue_tail(_events(spark, folder), "user_id", "event_id")


def q_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of users with gaps of six hours."""
    return stream.sessions(_events(spark, folder), "user_id", "ts", "6 hours").select("key", F.unix_timestamp("start").alias("start"), "n")


def q_stream_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly counts by a streaming run over the events file, all of them, emitted as complete windows."""
    import uuid

    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder).select("ts", "event_type")
    counts = stream.window_counts(events, "event_type", "ts", "1 hour", "1 hour")
    out = stream.run_available(spark, counts, "hourly", f"{shared_root(spark)}/stream-{uuid.uuid4().hex[:8]}", mode="complete")
    return out.select("term", F.unix_timestamp("start").alias("start"), "n")


_GRID = """s AS (SELECT min(floor(epoch(ts))) AS t0, max(floor(epoch(ts))) AS t1 FROM events),
c AS (SELECT event_type AS term, CAST(floor((floor(epoch(ts)) - t0) / 3600) AS BIGINT) AS bucket, count(*) AS n FROM events, s GROUP BY ALL),
g AS (SELECT term, b AS bucket FROM (SELECT DISTINCT event_type AS term FROM events) t, (SELECT unnest(range(0, CAST(floor((t1 - t0) / 3600) AS BIGINT) + 1)) AS b FROM s) r),
f AS (SELECT g.term, g.bucket, coalesce(c.n, 0) AS n FROM g LEFT JOIN c ON g.term = c.term AND g.bucket = c.bucket),
r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY bucket DESC) AS k FROM f)"""
ORACLES = {
    "q_quota_by_day": "WITH d AS (SELECT event_type AS name, CAST(timezone('America/Los_Angeles', timezone('UTC', ts)) AS DATE) AS day, count(*) AS used FROM events GROUP BY 1, 2) SELECT name, CAST(day AS VARCHAR) AS day, used FROM d QUALIFY row_number() OVER (PARTITION BY name ORDER BY d.day DESC) <= 3",
    "q_bucket_counts": f"WITH {_GRID} SELECT term, bucket, n FROM f",
    "q_zscore": f"WITH {_GRID}, p AS (SELECT term, avg(n) FILTER (WHERE k > 1) AS m, stddev_pop(n) FILTER (WHERE k > 1) AS d, max(n) FILTER (WHERE k = 1) AS last FROM r GROUP BY term) SELECT term, round((last - m) / CASE WHEN d > 1e-12 THEN d ELSE 1.0 END, 6) AS z FROM p",
    "q_velocity": f"WITH {_GRID} SELECT term, round(sum(n * pow(2, 4 - k)) FILTER (WHERE k <= 4) / 15.0 - avg(n) FILTER (WHERE k <= 4), 6) AS velocity, CAST(sum(CASE k WHEN 1 THEN n WHEN 2 THEN -2 * n WHEN 3 THEN n END) AS DOUBLE) AS acceleration FROM r GROUP BY term",
    "q_ewma": f"WITH {_GRID}, l AS (SELECT term, max(bucket) AS m FROM f GROUP BY term) SELECT f.term, round(sum(n * CASE WHEN bucket = 0 THEN pow(0.65, m) ELSE 0.35 * pow(0.65, m - bucket) END), 6) AS ewma FROM f JOIN l ON f.term = l.term GROUP BY f.term",
    "q_heat": "WITH t AS (SELECT max(floor(epoch(ts))) AS now FROM events) SELECT event_type AS term, round(sum(pow(0.5, (now - floor(epoch(ts))) / 60.0 / 240.0)), 6) AS heat FROM events, t GROUP BY event_type",
    "q_breaking": "WITH t AS (SELECT max(floor(epoch(ts))) AS now FROM events), p AS (SELECT user_id AS term, count(*) FILTER (WHERE floor(epoch(ts)) >= now - 172800) AS mentions, count(*) AS total FROM events, t GROUP BY user_id) SELECT * FROM p WHERE mentions >= 3 AND mentions > 0.08 * total",
    "q_failures": "WITH t AS (SELECT max(floor(epoch(ts))) AS now FROM events) SELECT user_id AS key, count(*) AS attempts, count(*) >= 3 OR (max(now) - floor(epoch(max(ts)))) / 3600.0 < 24.0 AS skip FROM events, t WHERE event_type = 'error' GROUP BY user_id",
    "q_consecutive_failures": "WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events), f AS (SELECT user_id, min(k) AS ok FROM o WHERE event_type <> 'error' GROUP BY user_id) SELECT o.user_id AS key, count(*) FILTER (WHERE o.event_type = 'error' AND (ok IS NULL OR k < ok)) AS run FROM o LEFT JOIN f ON o.user_id = f.user_id GROUP BY o.user_id",
    "q_queue_tail": "SELECT user_id AS key, min(event_id) AS seq FROM events GROUP BY user_id ORDER BY seq DESC LIMIT 500",
    "q_sessions": "WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM o) SELECT user_id AS key, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM s GROUP BY user_id, no",
    "q_stream_counts": "SELECT event_type AS term, CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start, count(*) AS n FROM events GROUP BY ALL",
}
_NAMED = (q_bucket_counts, q_zscore, q_velocity, q_ewma, q_heat, q_bursts, q_breaking, q_failures, q_consecutive_failures, q_quota_by_day, q_queue_tail, q_sessions, q_stream_counts)
QUERIES = {f.__name__: f for f in _NAMED}
