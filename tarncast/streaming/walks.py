"""Persistence from a stream: each series' random walk is kept as a few sums.

A first stream averages readings and appends the days its watermark has closed to a table
(``feeds.daily_stream``, ``feeds.run_append``). A second one reads that table, and each day meets the
state of its series: the last value, its day, and the sum and count of squared changes between
consecutive days. A series with a third of the feed thus brings no more rows than another, and its
state never grows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tarncast.operators.grid import each_horizon
from tarncast.plans.common import HORIZON

#: Day number of the last value, the value, sum and count of squared changes.
STATE = "last_day bigint, last_value double, squared double, changes bigint"
DAY_MS = 86_400_000


def walk_stream(days: DataFrame, value: str, keys=("site_id",), idle_days: int | None = None) -> DataFrame:
    """The walk after each closed day: keys, datetime, mu, step_variance, changes, ended.

    ``mu`` is the value of the day and ``step_variance`` the mean squared change over consecutive days up to it,
    NULL before the first; NULL and NaN values are no values. A series without a value for ``idle_days`` days past
    its last is forgotten: one row with ``ended`` repeats its last state, and a later value starts anew. ``days`` is
    the stream of the closed days' table (keys, datetime, value; other columns are ignored), read without a limit of
    files: a batch of the first stream holds later days than all before it, so a series meets its days in order.
    """
    keys = list(keys)
    days = days.select(*keys, "datetime", value)
    kinds = {field.name: field.dataType.simpleString() for field in days.schema}
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["datetime date, mu double, step_variance double, changes bigint, ended boolean"])

    def frame(key: tuple, rows: list[tuple]) -> pd.DataFrame:
        day, mu, squared, changes, ended = zip(*rows, strict=True)
        variance = [total / count if count else None for total, count in zip(squared, changes, strict=True)]
        own = {k: [part] * len(rows) for k, part in zip(keys, key, strict=True)}
        dates = np.array(day, dtype="datetime64[D]").astype(object)
        return pd.DataFrame(own | {"datetime": dates, "mu": mu, "step_variance": variance, "changes": changes, "ended": ended})

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            rows = [(*state.get, True)]
            state.remove()
            yield frame(key, rows)
            return
        arrived = pd.concat(batches).dropna(subset=[value]).sort_values("datetime")
        last, mu, squared, changes = state.get if state.exists else (None, None, 0.0, 0)
        rows = []
        for day, now in zip(np.array(arrived["datetime"], dtype="datetime64[D]").astype(np.int64).tolist(), arrived[value].tolist(), strict=True):
            if last is not None and idle_days is not None and day - last > idle_days:
                rows.append((last, mu, squared, changes, True))
                last, squared, changes = None, 0.0, 0
            if last is not None and day - last == 1:
                squared, changes = squared + (now - mu) ** 2, changes + 1
            last, mu = day, now
            rows.append((last, mu, squared, changes, False))
        if last is not None:
            state.update((last, mu, squared, changes))
            if idle_days is not None:
                state.setTimeoutTimestamp(max((last + idle_days) * DAY_MS, state.getCurrentWatermarkMs()) + 1)
        if rows:
            yield frame(key, rows)

    timeout = GroupStateTimeout.NoTimeout
    if idle_days is not None:
        timeout = GroupStateTimeout.EventTimeTimeout
        days = days.withColumn("at", F.col("datetime").cast("timestamp")).withWatermark("at", "0 seconds")
    return days.groupBy(*keys).applyInPandasWithState(step, schema, STATE, "append", timeout)


def walk_forecast(walks: DataFrame, horizon: int = HORIZON, keys=("site_id",)) -> DataFrame:
    """Forecasts issued the day after each closed day, as ``persistence`` does: keys, reference_datetime, datetime, mu, sigma."""
    keys = list(keys)
    issued = walks.filter(~F.col("ended")).select(*keys, F.date_add("datetime", 1).alias("reference_datetime"), F.col("datetime").alias("last_date"), "mu", "step_variance")
    steps = F.datediff("datetime", "last_date")
    return each_horizon(issued, 1, horizon - 1).select(*keys, "reference_datetime", "datetime", "mu", F.sqrt(F.col("step_variance") * steps).alias("sigma"))
