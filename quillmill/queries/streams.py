"""Queries over the event log, by the operators that also run on streams."""

from __future__ import annotations

from quillmill.queries.base import query, table
from quillmill.streaming import discovery as D


@query("stalls", "SELECT user_id, since, epoch_us(ts - since) // 1000000 AS seconds FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS since FROM events) WHERE epoch_us(ts) - epoch_us(since) > 3600000000".replace("epoch_us(ts - since)", "(epoch_us(ts) - epoch_us(since))"))
def stalls(spark, d):
    return D.stalls(table(spark, d, "events"), "user_id", "ts", 3600)


@query("live_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 3600000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 1 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def live_sessions(spark, d):
    return D.live_sessions(table(spark, d, "events"), "user_id", "ts", 3600)
