"""Event-time aggregation: the same functions take a table or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.session import table


def _aggregate(grouped, extra: list[str]) -> DataFrame:
    out = grouped.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("value").alias("lowest"), F.max("value").alias("highest"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *extra, "n", "total", "lowest", "highest")


def watermarked(events: DataFrame, late: str | None) -> DataFrame:
    """A stream drops state that events older than `late` could still change; a table needs none."""
    return events.withWatermark("ts", late) if late and events.isStreaming else events


def tumbling(events: DataFrame, width: str, by: list[str], late: str | None = "10 minutes") -> DataFrame:
    """Counts and sums in windows side by side."""
    return _aggregate(watermarked(events, late).groupBy(F.window("ts", width).alias("window"), *by), by)


def sliding(events: DataFrame, width: str, step: str, by: list[str], late: str | None = "10 minutes") -> DataFrame:
    """Counts and sums in windows that begin at every step."""
    return _aggregate(watermarked(events, late).groupBy(F.window("ts", width, step).alias("window"), *by), by)


def sessions(events: DataFrame, gap: str, by: list[str], late: str | None = "10 minutes") -> DataFrame:
    """Counts and sums of runs of events with less than gap between them."""
    return _aggregate(watermarked(events, late).groupBy(F.session_window("ts", gap).alias("window"), *by), by)


def _events(s, d):
    return table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("start", "end")})


QUERIES = {
    "tumbling_windows": lambda s, d: _plain(tumbling(_events(s, d), "1 hour", ["event_type"])),
    "sliding_windows": lambda s, d: _plain(sliding(_events(s, d), "1 hour", "30 minutes", ["event_type"])),
    "session_windows": lambda s, d: _plain(sessions(_events(s, d), "30 minutes", ["user_id"])),
}

_AGG = "count(*) AS n, round(sum(value), 4) AS total, min(value) AS lowest, max(value) AS highest"
_F = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"
ORACLES = {
    "tumbling_windows": f"SELECT {_F.format('b')} AS start, {_F.format('b + INTERVAL 1 HOUR')} AS \"end\", event_type, {_AGG} FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS b FROM events) GROUP BY b, event_type",
    "sliding_windows": f"""SELECT {_F.format('b')} AS start, {_F.format('b + INTERVAL 1 HOUR')} AS "end", event_type, {_AGG}
FROM (SELECT *, time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * k AS b FROM events, (VALUES (0), (1)) v(k)) GROUP BY b, event_type""",
    "session_windows": f"""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT {_F.format('min(ts)')} AS start, {_F.format('max(ts) + INTERVAL 30 MINUTE')} AS "end", user_id, {_AGG} FROM s GROUP BY user_id, k""",
}
