"""Shared pieces of the check SQL: the inputs and the summary levels, written for DuckDB."""

from __future__ import annotations

# Readings in hundredths, as in netpulse.sources.tables.
M = """
m0 AS (
  SELECT event_id AS seq, ts, ts + INTERVAL 330 MINUTE AS local_ts, user_id,
    CASE WHEN user_id % 5 = 0 THEN '_legacy' ELSE 'host-' || (user_id % 5) END AS host_id,
    CAST(round(value * 100) AS BIGINT) AS base_c,
    CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS latency,
    'srv-' || (user_id % 7) AS server_name,
    'node-' || (user_id % 3) AS server_host,
    CASE WHEN user_id % 4 = 0 THEN '' ELSE 'city-' || (user_id % 4) END AS server_city,
    CASE WHEN user_id % 6 = 0 THEN '' ELSE 'C' || (user_id % 6) END AS server_country,
    CASE WHEN event_id % 11 = 0 THEN '' ELSE 'https://example.net/r/' || event_id END AS result_url,
    CASE WHEN event_id % 50 = 7 THEN 'Unknown'
      ELSE '10.' || (user_id % 3) || '.' || (user_id % 50) || '.' || (event_id % 250) END AS public_ip,
    CASE event_type WHEN 'view' THEN 'Wi-Fi 5GHz' WHEN 'click' THEN 'Wi-Fi 2.4GHz'
      WHEN 'purchase' THEN 'Ethernet' WHEN 'signup' THEN 'Wi-Fi (unknown band)' END AS connection_type,
    CASE WHEN event_type IN ('view', 'click') THEN 'home' END AS wifi_name,
    'Host ' || (user_id % 5) AS host_name, 'site-' || (user_id % 2) AS host_location,
    'isp-' || (user_id % 3) AS host_isp
  FROM events),
m AS (
  SELECT *, time_bucket(INTERVAL 15 MINUTE, local_ts) AS bucket_start,
    CASE WHEN seq % 97 <> 0 THEN base_c * 4 END AS download_c, base_c * 2 AS upload_c,
    CASE WHEN seq % 89 <> 0 THEN latency * 100 END AS ping_c,
    server_name || ' – ' || server_host
      || CASE WHEN server_city = '' THEN '' ELSE ' – ' || server_city END
      || CASE WHEN server_country = '' THEN '' ELSE ' (' || server_country || ')' END AS server_label
  FROM m0),
v AS (SELECT * FROM m WHERE download_c IS NOT NULL AND upload_c IS NOT NULL)"""

O = """
m AS (
  SELECT o_orderkey AS seq, o_orderdate AS local_ts, o_orderdate AS bucket_start,
    'host-' || (o_custkey % 5) AS host_id, CAST(round(o_totalprice / 10) AS BIGINT) AS download_c,
    CAST(round(o_totalprice / 10) AS BIGINT) // 2 AS upload_c, o_orderkey % 60 * 100 AS ping_c,
    'srv-' || (o_custkey % 7) AS server_label,
    '10.9.' || (o_custkey % 50) || '.' || (o_orderkey % 250) AS public_ip,
    o_orderpriority AS connection_type
  FROM orders),
v AS (SELECT * FROM m)"""


def half_up(num: str, den: str) -> str:
    """num / den to a whole number, halves away from zero, NULL unless den > 0."""
    size = f"((2 * abs({num}) + ({den})) // (2 * ({den})))"
    return f"(CASE WHEN ({den}) > 0 THEN CASE WHEN ({num}) < 0 THEN -{size} ELSE {size} END END)"


def mean(c: str) -> str:
    """Mean of hundredths, rounded, in hundredths."""
    return half_up(f"sum({c})", f"count({c})")


def hundredth(c: str) -> str:
    return f"(CAST({c} AS BIGINT) / 100::DOUBLE)"


def tenth(c: str) -> str:
    return f"(CAST({c} AS BIGINT) / 10::DOUBLE)"


def fixed(c: str) -> str:
    """Hundredths as text with two decimals."""
    return f"format('{{:.2f}}', {c} / 100::DOUBLE)"


PERIOD = {
    "hourly": "date_trunc('hour', bucket_start)",
    "daily": "CAST(bucket_start AS DATE)",
    "weekly": "CAST(date_trunc('week', period) AS DATE)",
    "monthly": "CAST(date_trunc('month', period) AS DATE)",
    "yearly": "CAST(date_trunc('year', period) AS DATE)",
}
EXPECTED = {"hourly": 4, "daily": 96}


def _stats(c: str, name: str) -> str:
    values = f"list_sort(list({c}) FILTER (WHERE {c} IS NOT NULL))"

    def at(p: float) -> str:
        return f"{values}[CAST(floor({p}::DOUBLE * (count({c}) - 1)) AS BIGINT) + 1]"

    middle = f"({values}[(count({c}) - 1) // 2 + 1] + {values}[count({c}) // 2 + 1])"
    columns = {
        "avg": mean(c),
        "median": half_up(middle, "2"),
        "max": f"max({c})",
        "min": f"min({c})",
        "p99": at(0.99),
        "p95": at(0.95),
        "p90": at(0.9),
        "p50": at(0.5),
    }
    return ",\n".join(f"{sql} AS {name}_{stat}_c" for stat, sql in columns.items())


def summary(level: str) -> str:
    """CTE ``s``: summaries of each host and ``all`` from ``v`` and ``m``."""
    servers = {"hourly": 3, "daily": 5}[level]
    kept = "TRUE" if level == "hourly" else "r <= 3"
    shown = "string_agg(item, '|' ORDER BY item)" if level == "hourly" else "string_agg(item, '|' ORDER BY r)"
    return f"""
fan AS (SELECT m.* EXCLUDE (host_id), h.host AS host_id, {PERIOD[level]} AS period
  FROM m, LATERAL (SELECT unnest([m.host_id, 'all']) AS host) h),
good AS (SELECT * FROM fan WHERE download_c IS NOT NULL AND upload_c IS NOT NULL),
bad AS (SELECT host_id, period, count(*) AS errors FROM fan
  WHERE download_c IS NULL OR upload_c IS NULL GROUP BY host_id, period),
servers AS (SELECT host_id, period, string_agg(server_label, '|' ORDER BY r) AS servers_top FROM (
    SELECT host_id, period, server_label,
      row_number() OVER (PARTITION BY host_id, period ORDER BY count(*) DESC, min(seq)) AS r
    FROM good GROUP BY host_id, period, server_label) WHERE r <= {servers} GROUP BY host_id, period),
connections AS (SELECT host_id, period, {shown} FILTER (WHERE {kept}) AS connection_types,
    max(item) FILTER (WHERE r = 1) AS top_connection FROM (
    SELECT host_id, period, connection_type AS item,
      row_number() OVER (PARTITION BY host_id, period ORDER BY count(*) DESC, min(seq)) AS r
    FROM good WHERE connection_type <> '' GROUP BY host_id, period, connection_type) GROUP BY host_id, period),
plain AS (SELECT host_id, period, count(*) AS records,
    sum(download_c) AS dl_sum, sum(ping_c) AS ping_sum, count(ping_c) AS ping_n,
    {_stats('download_c', 'download')},
    {_stats('upload_c', 'upload')},
    {_stats('ping_c', 'ping')}
  FROM good GROUP BY host_id, period),
s AS (SELECT plain.*, coalesce(errors, 0) AS errors, servers_top, coalesce(connection_types, '') AS connection_types,
    top_connection, {half_up('records * 1000', str(EXPECTED[level]))} AS completion_d,
    CASE top_connection WHEN 'Wi-Fi 5GHz' THEN 200 WHEN 'Wi-Fi 2.4GHz' THEN 100 WHEN 'Ethernet' THEN 200
      WHEN 'Unknown' THEN 150 ELSE 200 END AS threshold_mbps
  FROM plain LEFT JOIN bad USING (host_id, period) LEFT JOIN servers USING (host_id, period)
  LEFT JOIN connections USING (host_id, period))"""


def messages(level: str) -> str:
    """CTE ``a``: anomaly messages of ``s`` joined with ``; ``."""
    low = f"CASE WHEN records < 76.8 THEN 'Low completion rate: ' || format('{{:.1f}}', completion_d / 10::DOUBLE) || '%' END"
    return f"""
a AS (SELECT host_id, period, concat_ws('; ',
    CASE WHEN dl_sum < threshold_mbps * 90 * records THEN 'Below threshold: avg download ' || {fixed('download_avg_c')}
      || ' Mbps < ' || {fixed('(threshold_mbps * 90)')} || ' Mbps' END,
    CASE WHEN 2 * download_min_c < threshold_mbps * 90 THEN 'Severe degradation: min download ' || {fixed('download_min_c')} || ' Mbps' END,
    CASE WHEN threshold_mbps = 100 AND dl_sum < 8000 * records THEN 'Performance drop: avg download '
        || {fixed('download_avg_c')} || ' Mbps < 80 Mbps (2.4GHz threshold)'
      WHEN threshold_mbps >= 200 AND dl_sum < 15000 * records THEN 'Performance drop: avg download '
        || {fixed('download_avg_c')} || ' Mbps < 150 Mbps' END,
    CASE WHEN ping_sum > 2000 * ping_n THEN 'High latency: avg ping ' || {fixed('ping_avg_c')} || ' ms' END,
    CASE WHEN ping_max_c > 5000 THEN 'Latency spike: max ping ' || {fixed('ping_max_c')} || ' ms' END
    {', ' + low if level == 'daily' else ''}) AS anomalies
  FROM s)"""


DAY_MEANS = """
fan AS (SELECT m.* EXCLUDE (host_id), h.host AS host_id, CAST(bucket_start AS DATE) AS period
  FROM m, LATERAL (SELECT unnest([m.host_id, 'all']) AS host) h
  WHERE download_c IS NOT NULL AND upload_c IS NOT NULL),
types AS (SELECT host_id, period, list(item) AS types FROM (
    SELECT host_id, period, connection_type AS item,
      row_number() OVER (PARTITION BY host_id, period ORDER BY count(*) DESC, min(seq)) AS r
    FROM fan WHERE connection_type <> '' GROUP BY host_id, period, connection_type) WHERE r <= 3 GROUP BY host_id, period),
d AS (SELECT host_id, period, count(*) AS records, {dl} AS dl_c, {ul} AS ul_c, {ping} AS ping_c,
    coalesce(any_value(types), []) AS types
  FROM fan LEFT JOIN types USING (host_id, period) GROUP BY host_id, period)""".format(
    dl=mean("download_c"), ul=mean("upload_c"), ping=mean("ping_c")
)


def coarser(source: str, level: str, name: str) -> str:
    """CTE ``name`` of weeks, months or years over ``source`` (d or a coarser CTE)."""
    return f"""
{name} AS (SELECT host_id, p AS period, count(*) AS n, {mean('dl_c')} AS dl_c, {mean('ul_c')} AS ul_c,
    {mean('ping_c')} AS ping_c, list_sort(list_distinct(flatten(list(types)))) AS types
  FROM (SELECT *, {PERIOD[level]} AS p FROM {source}) GROUP BY host_id, p)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


def dated(query: str, *columns: str) -> str:
    """``query`` with DATE columns shown as text, as the registered queries show them."""
    shown = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in columns)
    return f"SELECT * REPLACE ({shown}) FROM (\n{query}\n)"
