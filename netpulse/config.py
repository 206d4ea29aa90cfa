"""Settings of the engine.

Everything here is a fixed value: thresholds, level settings, alarm definitions
and retention ages that results depend on.
"""

from __future__ import annotations

from dataclasses import dataclass

ZONE = "Asia/Kolkata"
ALL_HOSTS = "all"
LEGACY_HOST = "_legacy"

# Expected download speed (Mbps) by connection type, in lookup order.
THRESHOLDS = {
    "Wi-Fi 5GHz": 200,
    "Wi-Fi 2.4GHz": 100,
    "Ethernet": 200,
    "Unknown": 150,
}
DEFAULT_EXPECTED = 200
DEFAULT_VIEW_EXPECTED = 150
TOLERANCE_PERCENT = 10

# Connection statistics: (threshold, minimum) in Mbps.
CONNECTION_LIMITS = {
    "Ethernet": (200, 180),
    "Wi-Fi 5GHz": (200, 180),
    "Wi-Fi 2.4GHz": (100, 90),
    "Unknown": (150, 135),
}
UNKNOWN_BAND = "Wi-Fi (unknown band)"

# Plausibility bounds, used only when asked for.
MIN_DOWNLOAD = 1
MIN_UPLOAD = 1
MAX_PING = 5000


@dataclass(frozen=True)
class Level:
    """One granularity of the summary tables."""

    name: str
    expected: int | None  # measurements expected per host and period
    top_servers: int
    shown: int  # periods listed by default
    ttl_days: int | None
    chart_points: int


LEVELS = {
    "minute": Level("minute", None, 0, 10, None, 200),
    "hourly": Level("hourly", 4, 3, 24, 90, 300),
    "daily": Level("daily", 96, 5, 7, None, 500),
    "weekly": Level("weekly", None, 0, 4, 730, 500),
    "monthly": Level("monthly", None, 0, 12, 1825, 500),
    "yearly": Level("yearly", None, 0, 5, 3650, 500),
}
TRUNC = {"hourly": "hour", "daily": "day", "weekly": "week", "monthly": "month", "yearly": "year"}
TOP_CONNECTIONS = 3
LOW_COMPLETION = 0.8
MAX_ERRORS = 5


@dataclass(frozen=True)
class Counter:
    """A log pattern counted per window."""

    metric: str
    group: str
    level: str | None
    pattern: str | None


COUNTERS = [
    Counter("AggregatorErrors", "aggregator", "ERROR", None),
    Counter("AggregatorWarnings", "aggregator", "WARNING", None),
    Counter("AggregatorSuccess", "aggregator", "INFO", "Completed"),
    Counter("DashboardErrors", "dashboard", "ERROR", None),
    Counter("DashboardWarnings", "dashboard", "WARNING", None),
    Counter("HourlyCheckerErrors", "checker", "ERROR", None),
    Counter("HourlyCheckerWarnings", "checker", "WARNING", None),
    Counter("DataCollectionRuns", "aggregator", None, "Aggregated.*records"),
    Counter("WeeklyAggregationFailures", "aggregator", "ERROR", "Weekly aggregation failed"),
    Counter("MonthlyAggregationFailures", "aggregator", "ERROR", "Monthly aggregation failed"),
    Counter("AggregatorFunctionErrors", "aggregator", "ERROR", "Failed"),
    Counter("DashboardFunctionErrors", "dashboard", "ERROR", "Failed"),
]


@dataclass(frozen=True)
class Alarm:
    """Sum of a counter per period against a threshold, M of N periods."""

    name: str
    metric: str
    period_s: int
    periods: int
    to_alarm: int
    threshold: int
    below: bool  # True: breach when sum < threshold, else when sum > threshold
    missing_breaches: bool


ALARMS = [
    Alarm("aggregator-errors", "AggregatorErrors", 21600, 1, 1, 0, False, False),
    Alarm("aggregator-warnings", "AggregatorWarnings", 86400, 1, 1, 20, False, False),
    Alarm("dashboard-errors", "DashboardErrors", 3600, 2, 2, 5, False, False),
    Alarm("checker-errors", "HourlyCheckerErrors", 3600, 2, 2, 5, False, False),
    Alarm("weekly-aggregation-failure", "WeeklyAggregationFailures", 86400, 1, 1, 0, False, False),
    Alarm("monthly-aggregation-failure", "MonthlyAggregationFailures", 86400, 1, 1, 0, False, False),
    Alarm("function-aggregator-error", "AggregatorFunctionErrors", 21600, 1, 1, 1, False, False),
    Alarm("function-dashboard-error", "DashboardFunctionErrors", 3600, 1, 1, 10, False, False),
    Alarm("data-collection-failure", "DataCollectionRuns", 86400, 2, 2, 1, True, True),
]
