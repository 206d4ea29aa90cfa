"""SQL of the down-sampled charts: the walk over every plain point of a bucket, as recursive common tables."""

from __future__ import annotations


def _walk(name: str, points: str, target: int) -> str:
    """CTEs ending in ``{name}(host_id, pos, v, ord)``: ``points`` (host_id, idx, pos, v, n) thinned to ``target`` where longer."""
    return f"""
{name}_b AS (SELECT host_id, n, i, floor((i + 1) * w)::BIGINT + 1 AS e0, least(floor((i + 2) * w)::BIGINT + 1, n - 1) AS e1,
    least(floor((i + 3) * w)::BIGINT + 1, n) AS e2
  FROM (SELECT DISTINCT host_id, n, (n - 2)::DOUBLE / {target - 2} AS w FROM {points} WHERE n > {target}),
    (SELECT unnest(range({target - 2})) AS i)),
{name}_in AS MATERIALIZED (SELECT b.host_id, b.i, list([q.pos, q.v]) AS pts FROM {name}_b b JOIN {points} q
  ON q.host_id = b.host_id AND (q.idx >= b.e0 AND q.idx < b.e1 OR b.e1 <= b.e0 AND q.idx = b.e0) GROUP BY b.host_id, b.i),
{name}_next AS MATERIALIZED (SELECT b.host_id, b.i, sum(q.v)::BIGINT AS total, count(*) AS size FROM {name}_b b JOIN {points} q
  ON q.host_id = b.host_id AND (q.idx >= b.e1 AND q.idx < b.e2 OR b.e2 <= b.e1 AND q.idx = b.e1) GROUP BY b.host_id, b.i),
{name}_step(host_id, i, pos, v) AS (SELECT host_id, -1::BIGINT, pos, v FROM {points} WHERE idx = 0 AND n > {target}
  UNION ALL SELECT host_id, i, best[2], best[3] FROM (SELECT s.host_id, m.i, list_sort(list_transform(m.pts,
      lambda q: [-abs(2 * q[2] * f.size - (s.v * f.size + f.total)), q[1], q[2]]))[1] AS best
    FROM {name}_step s JOIN {name}_in m ON m.host_id = s.host_id AND m.i = s.i + 1
    JOIN {name}_next f ON f.host_id = m.host_id AND f.i = m.i)),
{name} AS MATERIALIZED (SELECT host_id, pos, v, i + 1 AS ord FROM {name}_step
  UNION ALL SELECT host_id, pos, v, {target - 1} FROM {points} WHERE idx = n - 1 AND n > {target}
  UNION ALL SELECT host_id, pos, v, idx FROM {points} WHERE n <= {target})"""


def chart(head: str, points: str, max_points: int) -> str:
    """The chart of CTE ``points`` (host_id, pos, n, v, date_ist, ul_c, ping_c, connection_type) after the CTEs of ``head``."""
    return f"""{head.replace("WITH ", "WITH RECURSIVE ", 1)},
{points},
chart_points AS MATERIALIZED (SELECT host_id, pos AS idx, pos, v, n FROM points),{_walk("first_pass", "chart_points", 3 * max_points)},
listed AS MATERIALIZED (SELECT f.host_id, f.pos, f.v, row_number() OVER (PARTITION BY f.host_id ORDER BY f.ord) - 1 AS idx,
    count(*) OVER (PARTITION BY f.host_id) AS m, p.n FROM first_pass f JOIN chart_points p ON p.host_id = f.host_id AND p.pos = f.pos),
thin(host_id, idx, pos, v, base_pos, base, kept) AS (SELECT host_id, idx, pos, v, pos, v, TRUE FROM listed WHERE idx = 0 AND n > {max_points}
  UNION ALL SELECT host_id, idx, pos, v, CASE WHEN kept THEN pos ELSE base_pos END, CASE WHEN kept THEN v ELSE base END, kept
  FROM (SELECT l.host_id, l.idx, l.pos, l.v, t.base_pos, t.base, l.idx = l.m - 1 OR l.pos - t.base_pos > 20
      OR CASE WHEN t.base = 0 THEN l.v <> 0 ELSE t.base > 0 AND abs(l.v - t.base) * 100 > 3 * t.base END AS kept
    FROM thin t JOIN listed l ON l.host_id = t.host_id AND l.idx = t.idx + 1)),
left_over AS MATERIALIZED (SELECT host_id, pos, v, row_number() OVER (PARTITION BY host_id ORDER BY idx) - 1 AS idx,
    count(*) OVER (PARTITION BY host_id) AS n FROM
  (SELECT host_id, idx, pos, v FROM thin WHERE kept UNION ALL SELECT host_id, idx, pos, v FROM listed WHERE n <= {max_points})),
{_walk("second_pass", "left_over", max_points).strip()}
SELECT c.host_id, row_number() OVER (PARTITION BY c.host_id ORDER BY c.ord) - 1 AS sample_pos, c.pos, p.date_ist,
  p.v / 100::DOUBLE AS download_avg, p.ul_c / 100::DOUBLE AS upload_avg, p.ping_c / 100::DOUBLE AS ping_avg, p.connection_type,
  p.n AS original_count, count(*) OVER (PARTITION BY c.host_id) AS sampled_count
FROM second_pass c JOIN points p ON p.host_id = c.host_id AND p.pos = c.pos"""


def _points(order: str, source: str) -> str:
    return f"""points AS MATERIALIZED (SELECT host_id, row_number() OVER (PARTITION BY host_id ORDER BY {order}) - 1 AS pos,
    count(*) OVER (PARTITION BY host_id) AS n, coalesce(dl_c, 0)::BIGINT AS v, date_ist, coalesce(ul_c, 0)::BIGINT AS ul_c,
    coalesce(ping_c, 0)::BIGINT AS ping_c, connection_type FROM {source})"""


MINUTE_POINTS = _points("date_ist, seq", "x")
HOUR_POINTS = _points(
    "date_ist",
    """(SELECT host_id, period AS date_ist, download_avg_c AS dl_c, upload_avg_c AS ul_c, ping_avg_c AS ping_c,
      replace(connection_types, '|', ', ') AS connection_type FROM s)""",
)
