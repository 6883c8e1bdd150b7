"""Event-time windows (additions), run over the events table as a batch; tests run the same plans as streams."""

from __future__ import annotations

from quillmesh.plans.base import query
from quillmesh.streaming import events as V
from quillmesh.streaming import ingest as I


@query("stream_tumbling", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(c):
    return V.tumbling(c.table("events"))


@query("stream_sliding", "SELECT start, count(*) AS n FROM (SELECT date_trunc('hour', ts) - to_hours(CAST(k AS INT)) AS start FROM events, range(2) r(k)) GROUP BY start")
def _(c):
    return V.sliding(c.table("events"))


@query("stream_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, run""")
def _(c):
    return V.sessions(c.table("events"))


@query("stream_upsert", "SELECT user_id, coalesce(max(event_id) FILTER (event_id % 2 = 1), max(event_id)) AS event_id FROM events GROUP BY user_id")
def _(c):
    """Odd events as changes to a table of even ones."""
    e = c.table("events").select("user_id", "event_id")
    return I.merged(I.latest(e.filter("event_id % 2 = 0"), ["user_id"], "event_id"), e.filter("event_id % 2 = 1"), ["user_id"], "event_id")
