"""Time series of terms: buckets, bursts, heat; and state kept by key: back-off, quotas, queues, failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def bucket_counts(events: DataFrame, term: str, ts: str, minutes: int) -> DataFrame:
    """(term, bucket, n), buckets from 0 at the first event, those without events filled with 0."""
    seconds = F.unix_timestamp(ts)
    span = events.agg(F.min(seconds).alias("t0"), F.max(seconds).alias("t1"))
    found = events.crossJoin(F.broadcast(span)).groupBy(F.col(term).alias("term"), F.floor((seconds - F.col("t0")) / (60 * minutes)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    grid = events.select(F.col(term).alias("term")).distinct().crossJoin(F.broadcast(span)).select("term", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("t1") - F.col("t0")) / (60 * minutes)))).alias("bucket"))
    return grid.join(found, ["term", "bucket"], "left").select("term", "bucket", F.coalesce("n", F.lit(0)).alias("n"))


def series_of(counts: DataFrame) -> DataFrame:
    """(term, values): the counts of a term in order of buckets."""
    return counts.groupBy("term").agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "n"))), lambda x: x["n"].cast("double")).alias("values"))


def smoothed(values: Column, alpha: float = 0.35) -> Column:
    """Exponential smoothing, the first value as it is."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, 1, 1), lambda out, x: F.concat(out, F.array(alpha * x + (1 - alpha) * F.element_at(out, -1))))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def z_score(values: Column) -> Column:
    """Distance of the last value from the mean of those before, in their deviations; a deviation of 0 counts as 1."""
    past = F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0)))
    mean = _sum(past) / F.size(past)
    dev = F.sqrt(F.aggregate(past, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(past))
    return F.when(F.size(values) < 2, F.lit(0.0)).otherwise((F.element_at(values, -1) - mean) / F.when(dev > 1e-12, dev).otherwise(1.0))


def velocity(values: Column) -> Column:
    """Mean of the last four weighted 1, 2, 4, 8 minus their plain mean."""
    last = F.slice(values, F.greatest(F.size(values) - 3, F.lit(1)), F.lit(4))
    weights = F.transform(F.sequence(F.lit(0), F.size(last) - 1), lambda i: F.pow(F.lit(2.0), i))
    weighted = _sum(F.zip_with(last, weights, lambda x, w: x * w)) / _sum(weights)
    return F.when(F.size(values) < 2, F.lit(0.0)).otherwise(weighted - _sum(last) / F.size(last))


def acceleration(values: Column) -> Column:
    """Second difference of the last three values."""
    at = lambda i: F.element_at(values, i)
    return F.when(F.size(values) < 3, F.lit(0.0)).otherwise(at(-1) - 2 * at(-2) + at(-3))


def heat(events: DataFrame, term: str, ts: str, now: str, half_life: float = 240.0) -> DataFrame:
    """(term, heat): mentions decayed by age."""
    age = F.greatest(F.lit(0.0), (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(ts)) / 60.0)
    return events.groupBy(F.col(term).alias("term")).agg(F.sum(F.pow(F.lit(0.5), age / half_life)).alias("heat"))


def bursts(events: DataFrame, term: str, ts: str, now: str, window: int = 180, bucket: int = 30, least: int = 2) -> DataFrame:
    """(term, score, recent) of the terms that burst now, on smoothed buckets."""
    recent = events.filter(F.unix_timestamp(ts) >= F.unix_timestamp(F.lit(now).cast("timestamp")) - 60 * window).groupBy(F.col(term).alias("term")).agg(F.count(F.lit(1)).alias("recent")).filter(F.col("recent") >= least)
    rows = series_of(bucket_counts(events, term, ts, bucket)).join(recent, "term").withColumn("m", smoothed_moments(F.col("values")))
    z, v = _z_of(F.col("m")), _velocity_of(F.col("m"))
    base = (_sum(F.col("values")) - F.element_at("values", -1)) / F.greatest(F.size("values") - 1, F.lit(1))
    total = 0.45 * F.least(F.lit(1.0), F.col("recent") / 6) + 0.30 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), z) / 3) + 0.15 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)) + 0.10 * F.when(F.col("recent") > 2 * base, 1.0).otherwise(0.0)
    return rows.select("term", total.alias("score"), "recent")


def smoothed_moments(values: Column, alpha: float = 0.35) -> Column:
    """Of the smoothed series, in one pass: how long it is (n), its last four values (a, b, c, d, the last being d), and the sum and the sum of
    squares of all but the last."""
    zero = F.struct(F.lit(0).alias("n"), *[F.lit(0.0).alias(x) for x in ("a", "b", "c", "d", "sum", "squares")])

    def step(m: Column, x: Column) -> Column:
        new = F.when(m["n"] == 0, x).otherwise(alpha * x + (1 - alpha) * m["d"])
        return F.struct((m["n"] + 1).alias("n"), m["b"].alias("a"), m["c"].alias("b"), m["d"].alias("c"), new.alias("d"), F.when(m["n"] == 0, 0.0).otherwise(m["sum"] + m["d"]).alias("sum"), F.when(m["n"] == 0, 0.0).otherwise(m["squares"] + m["d"] * m["d"]).alias("squares"))

    return F.aggregate(values, zero, step)


def _z_of(m: Column) -> Column:
    n = m["n"] - 1
    mean = m["sum"] / F.greatest(n, F.lit(1))
    dev = F.sqrt(F.greatest(F.lit(0.0), m["squares"] / F.greatest(n, F.lit(1)) - mean * mean))
    return F.when(n < 1, F.lit(0.0)).otherwise((m["d"] - mean) / F.when(dev > 1e-9, dev).otherwise(1.0))


def _velocity_of(m: Column) -> Column:
    """Mean of the last four (or fewer) weighted 1, 2, 4, 8 minus their plain mean."""
    last = F.slice(F.array(m["a"], m["b"], m["c"], m["d"]), F.greatest(F.lit(5) - m["n"], F.lit(1)), F.lit(4))
    return velocity(last)


def breaking(events: DataFrame, term: str, ts: str, now: str, window: int = 120, least: int = 3, share: float = 0.6) -> DataFrame:
    """(term, mentions, total) of terms most of whose mentions are recent."""
    late = F.unix_timestamp(ts) >= F.unix_timestamp(F.lit(now).cast("timestamp")) - 60 * window
    per = events.groupBy(F.col(term).alias("term")).agg(F.count_if(late).alias("mentions"), F.count(F.lit(1)).alias("total"))
    return per.filter((F.col("mentions") >= least) & (F.col("mentions") > share * F.col("total")))


def failures(events: DataFrame, key: str, ts: str, failed: Column, now: str, retry_hours: float, most: int) -> DataFrame:
    """(key, attempts, last_at, skip): keys with failures, and whether to leave them alone for now."""
    per = events.filter(failed).groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("attempts"), F.max(ts).alias("last_at"))
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last_at")) / 3600.0
    return per.withColumn("skip", (F.col("attempts") >= most) | (age < retry_hours))


def consecutive(events: DataFrame, key: str, ts: str, tie: str, failed: Column) -> DataFrame:
    """(key, run): failures since the last success of a key, without sorting its events: all of them after the latest success."""
    at = F.struct(F.col(ts), F.col(tie))
    last = events.filter(~failed).groupBy(key).agg(F.max(at).alias("ok"))
    return events.join(last, key, "left").groupBy(F.col(key).alias("key")).agg(F.count_if(failed & (F.col("ok").isNull() | (at > F.col("ok")))).alias("run"))


def quota_days(events: DataFrame, name: str, ts: str, zone: str, keep: int = 3) -> DataFrame:
    """(name, day, used): uses by local day, the latest days kept."""
    days = events.groupBy(F.col(name).alias("name"), F.to_date(F.from_utc_timestamp(F.col(ts).cast("timestamp"), zone)).alias("day")).agg(F.count(F.lit(1)).alias("used"))
    return days.withColumn("_r", F.row_number().over(Window.partitionBy("name").orderBy(F.col("day").desc()))).filter(F.col("_r") <= keep).drop("_r")


def queue_tail(events: DataFrame, key: str, seq: str, keep: int = 500) -> DataFrame:
    """(key, seq): the latest distinct keys of a queue, each at its first place."""
    first = events.groupBy(F.col(key).alias("key")).agg(F.min(seq).alias("seq"))
    return first.orderBy(F.col("seq").desc()).limit(keep)
