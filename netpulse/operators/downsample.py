"""Shape-preserving down-sampling of chart series.

Largest-triangle selection picks, bucket after bucket, the point that maximises
``|(v - last) + (v - next_mean)|`` = ``|2v - (last + next_mean)|``. Whatever
``last`` and ``next_mean`` are, that maximum lies at the bucket's smallest or
largest value. So a bucket of any size reduces to two candidate points and a
mean, which is an ordinary grouped aggregate; only the walk over the buckets is
sequential, and it sees at most ``3 * max_points`` rows of a series. The
near-duplicate filter and the second selection then run on those few points.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netpulse.functions import exact
from netpulse.operators import ordinal

GAP = 20  # positions after which a point is kept even without change
TOLERANCE = 3  # percent
FIRST = -2  # bucket of position 0


def _edge(i: Column, width: Column) -> Column:
    """First position of bucket ``i``: ``int((i + 1) * width) + 1`` in double arithmetic."""
    return F.floor((i + 1) * width) + 1


def _bucket(pos: Column, width: Column) -> Column:
    """Bucket that holds a position, exact against ``_edge`` whatever the division rounds to."""
    guess = F.floor((pos - 1) / width) - 1
    return (
        F.when(pos >= _edge(guess + 1, width), guess + 1)
        .when(pos < _edge(guess, width), guess - 1)
        .otherwise(guess)
    )


PAYLOAD = ["date_ist", "upload_avg", "ping_avg", "connection_type"]


def candidates(series: DataFrame, keys: list[str], max_points: int) -> DataFrame:
    """First-pass reduction: at most ``3 * max_points`` rows per series.

    Needs ``pos``, ``n_rows``, ``value`` (hundredths) and the payload columns. Each
    output row is a bucket with its lowest and highest point (the first on ties), its
    sum and its size. The ends, and all points of a short series, are buckets of one.
    """
    target = 3 * max_points
    width = (F.col("n_rows") - 2).cast("double") / F.lit(float(target - 2))
    last = F.col("n_rows") - 1
    # Bucket -1 holds the positions before the first edge: never candidates, but position 0 is kept.
    bucket = (
        F.when(F.col("n_rows") <= target, F.col("pos"))
        .when(F.col("pos") == 0, F.lit(FIRST))
        .when(F.col("pos") == last, F.lit(target))
        .otherwise(_bucket(F.col("pos"), width))
    )
    point = F.struct("pos", "value", *PAYLOAD)
    return (
        series.withColumn("bucket", bucket)
        .groupBy(*keys, "bucket", "n_rows")
        .agg(
            F.min_by(point, F.struct("value", "pos")).alias("low"),
            F.min_by(point, F.struct(-F.col("value"), "pos")).alias("high"),
            F.sum("value").alias("total"),
            F.count(F.lit(1)).alias("size"),
        )
        .select(
            *keys,
            "bucket",
            "n_rows",
            "total",
            "size",
            *[
                F.col(f"{end}.{c}").alias(f"{end}_{c}")
                for end in ("low", "high")
                for c in ("pos", "value", *PAYLOAD)
            ],
        )
    )


def pick_from_buckets(first: tuple, buckets: list[tuple]) -> list[tuple]:
    """Walk the buckets: of each, the low or the high point, whichever lies further off.

    A point is (position, hundredths). ``buckets`` holds (low, high, total, size) with
    the sum and size of the window that follows; whole numbers, so ties are exact and
    go to the earlier position.
    """
    picked = [first]
    for low, high, total, size in buckets:
        centre = picked[-1][1] * size + total
        best = min((low, high), key=lambda p: (-abs(2 * p[1] * size - centre), p[0]))
        picked.append(best)
    return picked


def without_near_duplicates(points: list[tuple]) -> list[tuple]:
    """Keep points that moved more than 3 % from the last kept one, or lie 20 positions on."""
    if len(points) <= 2:
        return points
    kept = [points[0]]
    for pos, value in points[1:-1]:
        base_pos, base = kept[-1]
        if base == 0:
            moved = value != 0
        else:
            moved = base > 0 and abs(value - base) * 100 > TOLERANCE * base
        if moved or pos - base_pos > GAP:
            kept.append((pos, value))
    return [*kept, points[-1]]


def largest_triangles(points: list[tuple], target: int) -> list[tuple]:
    """The same selection over a short list of points."""
    n = len(points)
    if n <= target:
        return points
    width = (n - 2) / (target - 2)
    edge = [int((i + 1) * width) + 1 for i in range(target)]
    buckets = []
    for i in range(target - 2):
        end = min(edge[i + 1], n - 1)
        inside = points[edge[i] : end] or [points[edge[i]]]
        low = min(inside, key=lambda p: (p[1], p[0]))
        high = min(inside, key=lambda p: (-p[1], p[0]))
        following = [p[1] for p in points[end : min(edge[i + 2], n)]] or [points[end][1]]
        buckets.append((low, high, sum(following), len(following)))
    return [*pick_from_buckets(points[0], buckets), points[-1]]


def _first_pass(pdf: pd.DataFrame, n: int, target: int) -> list[tuple]:
    """Walk the reduced buckets of a long series."""
    rows = {int(r.bucket): r for r in pdf.itertuples(index=False)}
    width = (n - 2) / (target - 2)

    def low(r) -> tuple:
        return int(r.low_pos), int(r.low_value)

    end_point = low(rows[target])
    buckets = []
    for i in range(target - 2):
        here, following = rows.get(i), rows.get(i + 1) if i + 1 < target - 2 else None
        total, size = (int(following.total), int(following.size)) if following is not None else (0, 0)
        if min(int((i + 3) * width) + 1, n) == n or not size:  # the window takes the end point in
            total, size = total + end_point[1], size + 1
        if here is None:  # an empty last bucket stands for the end point
            buckets.append((end_point, end_point, total, size))
        else:
            buckets.append((low(here), (int(here.high_pos), int(here.high_value)), total, size))
    return [*pick_from_buckets(low(rows[FIRST]), buckets), end_point]


def select_points(pdf: pd.DataFrame, max_points: int) -> list[tuple]:
    """Chosen points of one series from its reduced buckets."""
    n, target = int(pdf["n_rows"].iloc[0]), 3 * max_points
    if n > target:
        chosen = _first_pass(pdf, n, target)
    else:
        short = pdf.sort_values("bucket")
        chosen = list(zip(short["low_pos"].tolist(), short["low_value"].tolist(), strict=True))
    if n > max_points:
        chosen = without_near_duplicates(chosen)
        if len(chosen) > max_points:
            chosen = largest_triangles(chosen, max_points)
    return chosen


def chart_series(view: DataFrame, keys: list[str], tie_break: list[str], max_points: int) -> DataFrame:
    """Down-sampled chart rows per series, in order of ``sample_pos``.

    ``original_count`` and ``sampled_count`` repeat on each row. Missing readings
    count as 0, a missing connection type as ``Unknown``. The end point may be listed
    twice, as the bucket rule allows.
    """

    def number(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0.0))

    order = ["date_ist", *[c for c in tie_break if c not in keys and c != "date_ist"]]
    rows = view.select(
        *keys,
        *order,
        exact.hundredths(number("download_avg")).alias("value"),
        number("upload_avg").alias("upload_avg"),
        number("ping_avg").alias("ping_avg"),
        F.coalesce("connection_type", F.lit("Unknown")).alias("connection_type"),
    )
    small = candidates(ordinal.with_position(rows, keys, order), keys, max_points)
    fields = {f.name: f.dataType for f in view.schema.fields}
    out = T.StructType(
        [T.StructField(k, fields[k]) for k in keys]
        + [
            T.StructField("sample_pos", T.LongType()),
            T.StructField("pos", T.LongType()),
            T.StructField("date_ist", fields["date_ist"]),
            T.StructField("download_avg", T.DoubleType()),
            T.StructField("upload_avg", T.DoubleType()),
            T.StructField("ping_avg", T.DoubleType()),
            T.StructField("connection_type", T.StringType()),
            T.StructField("original_count", T.LongType()),
            T.StructField("sampled_count", T.LongType()),
        ]
    )

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        ends = [
            pdf[[f"{end}_{c}" for c in ("pos", "value", *PAYLOAD)]].set_axis(
                ["pos", "value", *PAYLOAD], axis=1
            )
            for end in ("low", "high")
        ]
        points = pd.concat(ends).drop_duplicates("pos").set_index("pos", drop=False)
        chosen = select_points(pdf, max_points)
        made = points.loc[[pos for pos, _ in chosen]].reset_index(drop=True)
        made["sample_pos"] = np.arange(len(made))
        made["download_avg"] = made["value"] / 100.0
        made["original_count"] = int(pdf["n_rows"].iloc[0])
        made["sampled_count"] = len(made)
        for k in keys:
            made[k] = pdf[k].iloc[0]
        return made[out.names]

    return small.groupBy(*keys).applyInPandas(finish, out)
