"""The series views as SQL, for the oracle texts of the catalogue."""

from __future__ import annotations

_GRID = "(SELECT unnest(range({n})) AS t)"

VIEWS = {
    "ev_hourly": """ev_hourly AS (
  SELECT 'ev_hourly' AS series_id, c.channel_idx::INT AS channel_idx, g.t::BIGINT AS t, v.y
  FROM (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS channel_idx FROM (SELECT DISTINCT event_type FROM events)) c
  CROSS JOIN (SELECT unnest(range(720)) AS t) g
  LEFT JOIN (SELECT event_type, date_diff('hour', TIMESTAMP '2024-01-01', ts) AS t, avg(value) AS y FROM events GROUP BY ALL) v
    ON v.event_type = c.event_type AND v.t = g.t)""",
    "ev_user_daily": """ev_user_daily AS (
  SELECT u.user_id::VARCHAR AS series_id, 0 AS channel_idx, g.t::BIGINT AS t, coalesce(v.y, 0)::DOUBLE AS y
  FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(range(30)) AS t) g
  LEFT JOIN (SELECT user_id, date_diff('day', DATE '2024-01-01', ts::DATE) AS t, count(*) AS y FROM events GROUP BY ALL) v
    ON v.user_id = u.user_id AND v.t = g.t)""",
    "ev_user_hourly": """ev_user_hourly AS (
  SELECT u.user_id::VARCHAR AS series_id, 0 AS channel_idx, g.t::BIGINT AS t, v.y
  FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(range(720)) AS t) g
  LEFT JOIN (SELECT user_id, date_diff('hour', TIMESTAMP '2024-01-01', ts) AS t, avg(value) AS y FROM events GROUP BY ALL) v
    ON v.user_id = u.user_id AND v.t = g.t)""",
    "ev_user_counts": """ev_user_counts AS (
  SELECT u.user_id::VARCHAR AS series_id, 0 AS channel_idx, g.t::BIGINT AS t, coalesce(v.y, 0)::DOUBLE AS y
  FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(range(720)) AS t) g
  LEFT JOIN (SELECT user_id, date_diff('hour', TIMESTAMP '2024-01-01', ts) AS t, count(*) AS y FROM events GROUP BY ALL) v
    ON v.user_id = u.user_id AND v.t = g.t)""",
    "li_daily": """li_daily AS (
  SELECT 'li_daily' AS series_id, c.channel_idx::INT AS channel_idx, g.t::BIGINT AS t, v.y
  FROM (SELECT l_returnflag, row_number() OVER (ORDER BY l_returnflag) - 1 AS channel_idx FROM (SELECT DISTINCT l_returnflag FROM lineitem)) c
  CROSS JOIN (SELECT unnest(range(2499)) AS t) g
  LEFT JOIN (SELECT l_returnflag, date_diff('day', DATE '1995-01-02', l_shipdate::DATE) AS t, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS y FROM lineitem GROUP BY ALL) v
    ON v.l_returnflag = c.l_returnflag AND v.t = g.t)""",
    "ord_daily": """ord_daily AS (
  SELECT 'ord_daily' AS series_id, c.channel_idx::INT AS channel_idx, g.t::BIGINT AS t, v.y
  FROM (SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) - 1 AS channel_idx FROM (SELECT DISTINCT o_orderpriority FROM orders)) c
  CROSS JOIN (SELECT unnest(range(2405)) AS t) g
  LEFT JOIN (SELECT o_orderpriority, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS t, avg(o_totalprice) AS y FROM orders GROUP BY ALL) v
    ON v.o_orderpriority = c.o_orderpriority AND v.t = g.t)""",
    "ord_segment": """ord_segment AS (
  SELECT c.s AS series_id, 0 AS channel_idx, g.t::BIGINT AS t, coalesce(v.y, 0)::DOUBLE AS y
  FROM (SELECT DISTINCT c_mktsegment AS s FROM orders JOIN customer ON o_custkey = c_custkey) c CROSS JOIN (SELECT unnest(range(343)) AS t) g
  LEFT JOIN (SELECT c_mktsegment AS s, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) // 7 AS t, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS y
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) v ON v.s = c.s AND v.t = g.t)""",
    "emb_series": """emb_series AS (
  SELECT vec_id::VARCHAR AS series_id, 0 AS channel_idx, i::BIGINT AS t, embedding[i + 1]::DOUBLE AS y, label::VARCHAR AS config_id
  FROM (SELECT vec_id, label, embedding, unnest(range(len(embedding))) AS i FROM embeddings))""",
}


def impute(view: str, where: str) -> str:
    """filled AS (...): last observation carried on, leading gap from the first one, else 0."""
    return f"""ctx AS (SELECT * FROM {view} WHERE {where}),
filled AS (
  SELECT series_id, channel_idx, t, y, coalesce(
    last_value(y IGNORE NULLS) OVER (PARTITION BY series_id, channel_idx ORDER BY t ROWS UNBOUNDED PRECEDING),
    first_value(y IGNORE NULLS) OVER (PARTITION BY series_id, channel_idx ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS filled
  FROM ctx)"""


def snaive(p: int, m: int) -> str:
    """fc AS (...): seasonal naive over filled, for series longer than the season."""
    return f"""ends AS (SELECT series_id, channel_idx, max(t) + 1 AS n FROM filled GROUP BY ALL),
fc AS (
  SELECT e.series_id, e.channel_idx, h.h::BIGINT AS h, f.filled AS yhat
  FROM ends e CROSS JOIN (SELECT unnest(range({p})) AS h) h
  JOIN filled f ON f.series_id = e.series_id AND f.channel_idx = e.channel_idx AND f.t = e.n - {m} + h.h % {m})"""


def denom(m: int) -> str:
    return f"""den AS (
  SELECT a.series_id, a.channel_idx, greatest(coalesce(avg(abs(a.y - b.y)), 1e-8), 1e-8) AS denom
  FROM ctx a LEFT JOIN ctx b ON b.series_id = a.series_id AND b.channel_idx = a.channel_idx AND b.t = a.t - {m} GROUP BY ALL)"""


def mase(view: str, origin: int, p: int) -> str:
    return f"""sc AS (
  SELECT l.series_id, l.channel_idx, avg(abs(fc.yhat - l.y)) / any_value(den.denom) AS mase
  FROM {view} l JOIN fc ON fc.series_id = l.series_id AND fc.channel_idx = l.channel_idx AND fc.h = l.t - {origin}
  JOIN den ON den.series_id = l.series_id AND den.channel_idx = l.channel_idx
  WHERE l.y IS NOT NULL AND l.t >= {origin} AND l.t < {origin + p} GROUP BY ALL)"""


def with_(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(VIEWS.get(p, p) for p in parts) + "\n" + select
