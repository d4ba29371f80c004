"""Neural autoregression: small networks on lagged values, trained many at once, with bootstrap paths.

Spark does the set work (daily series, one row for each series and month of issues, spreading them
over tasks). Only training runs in Python, on Arrow batches: all issues and networks of a batch are
one tensor, with stacked normal equations and one batched solve a round.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarncast.operators.grid import spread
from tarncast.operators.series import interpolate, scaffold

OFFSET = 0.001
LEAST_DAMPING = 1e-9
MOST_DAMPING = 1e12
TOLERANCE = 1e-5
ROUNDS = 100
#: Numbers of a tensor that is trained at once: it bounds memory and changes no result.
TENSOR_CELLS = 1 << 20
#: Records are padded to a multiple of so many days.
PADDED = 64


def yule_walker_order(y: np.ndarray, most: int) -> int:
    """The order of a linear autoregression with the least AIC, by the Levinson recursion on Yule-Walker moments; at least 1."""
    n, most = len(y), min(most, len(y) - 2)
    centered = y - y.mean()
    moments = np.array([centered[: n - lag] @ centered[lag:] / n for lag in range(most + 1)])
    if most < 1 or moments[0] <= 0:
        return 1
    variance, phi, scores = moments[0], np.zeros(0), []
    for order in range(1, most + 1):
        partial = (moments[order] - phi @ moments[order - 1 : 0 : -1]) / variance
        phi = np.concatenate([phi - partial * phi[::-1], [partial]])
        variance *= max(1 - partial * partial, 1e-12)
        scores.append(n * np.log(variance) + 2 * (order + 1))
    return int(np.argmin(scores)) + 1


def lag_matrix(y: np.ndarray, lags: list[int]) -> np.ndarray:
    deepest = max(lags)
    return np.column_stack([y[deepest - lag : len(y) - lag] for lag in lags])


def _parts(w: np.ndarray, k: int, hidden: int):
    """Weights [network, ...] of the hidden layer, its offsets, the output's weights and offset."""
    w1 = w[:, : hidden * k].reshape(len(w), hidden, k)
    return w1, w[:, hidden * k : hidden * (k + 1)], w[:, hidden * (k + 1) : hidden * (k + 2)], w[:, -1]


def _forward(x: np.ndarray, w: np.ndarray, hidden: int):
    """Hidden values [network, unit, row] and outputs [network, row] for rows ``x`` [network, lag, row]."""
    w1, b1, w2, b2 = _parts(w, x.shape[1], hidden)
    h = 1 / (1 + np.exp(-np.clip(w1 @ x + b1[:, :, None], -40, 40)))
    return h, (w2[:, None, :] @ h)[:, 0, :] + b2[:, None]


def _solve(square: np.ndarray, gradient: np.ndarray) -> np.ndarray:
    """Steps of many damped systems; NaN where one is singular."""
    try:
        return np.linalg.solve(square, gradient[:, :, None])[:, :, 0]
    except np.linalg.LinAlgError:
        steps = np.full_like(gradient, np.nan)
        for at in range(len(square)):
            try:
                steps[at] = np.linalg.solve(square[at], gradient[at])
            except np.linalg.LinAlgError:
                continue
        return steps


def train(x: np.ndarray, y: np.ndarray, known: np.ndarray, w: np.ndarray, hidden: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Levenberg-Marquardt on the squared errors of many networks at once: weights, and whether each has converged.

    ``x`` [network, lag, row], ``y`` and ``known`` [network, row]: rows that are not known count nothing. Every network has
    its own damping, relative to its system's diagonal; a step that does not lower the loss, or a
    singular one, is rejected and damped more. A network has converged when a step lowers its loss by less than ``TOLERANCE`` of it, or when no
    damping finds a lower one; it then leaves the tensor, so it does the same whatever it is trained beside.
    """
    w = w.copy()
    converged = np.zeros(len(w), dtype=bool)
    damping = np.full(len(w), 1e-2)
    open_ = np.arange(len(w))
    h, out = _forward(x, w, hidden)
    error = np.where(known, out - y, 0.0)
    loss = (error**2).sum(axis=1)
    for _ in range(rounds):
        if not len(open_):
            break
        own_x, own_known = x[open_], known[open_]
        lags, own_rows = own_x.shape[1:]
        seen = own_known[:, None, :]
        slope = h * (1 - h) * _parts(w[open_], lags, hidden)[2][:, :, None] * seen
        jacobian = np.empty((len(open_), w.shape[1], own_rows))
        np.multiply(slope[:, :, None, :], own_x[:, None, :, :], out=jacobian[:, : hidden * lags].reshape(len(open_), hidden, lags, own_rows))
        jacobian[:, hidden * lags : hidden * (lags + 1)] = slope
        jacobian[:, hidden * (lags + 1) : -1] = h * seen
        jacobian[:, -1:] = seen
        square, gradient = jacobian @ jacobian.transpose(0, 2, 1), (jacobian @ error[:, :, None])[:, :, 0]
        diagonal = np.einsum("bii->bi", square)
        weight = np.maximum(diagonal, 1e-8 * np.maximum(diagonal.max(axis=1, keepdims=True), 1e-300))
        damped = square + (damping[open_, None] * weight)[:, :, None] * np.eye(square.shape[1])
        trial = w[open_] - _solve(damped, gradient)
        sound = np.isfinite(trial).all(axis=1)
        trial[~sound] = w[open_][~sound]
        new_h, new_out = _forward(own_x, trial, hidden)
        new_error = np.where(own_known, new_out - y[open_], 0.0)
        new_loss = (new_error**2).sum(axis=1)
        better = sound & (new_loss < loss)
        small = loss - new_loss < TOLERANCE * loss
        w[open_[better]] = trial[better]
        h[better], error[better], loss[better] = new_h[better], new_error[better], new_loss[better]
        damping[open_] = np.where(better, np.maximum(damping[open_] / 3, LEAST_DAMPING), damping[open_] * 4)
        done = (better & small) | (~better & (damping[open_] > MOST_DAMPING))
        converged[open_[done]] = True
        open_, h, error, loss = open_[~done], h[~done], error[~done], loss[~done]
    return w, converged


class Issue:
    """One issue of one series: its scaled record, the rows it is trained on, its draws."""

    def __init__(self, values: np.ndarray, seed: int, lags: tuple[int, ...] | None, most_lags: int):
        logged = np.log(values + OFFSET)
        self.center, self.scale = logged.mean(), logged.std() or 1.0
        self.y = (logged - self.center) / self.scale
        self.lags = list(lags) if lags is not None else list(range(1, yule_walker_order(self.y, most_lags) + 1))
        self.hidden = max(1, round((len(self.lags) + 1) / 2))
        self.rng = np.random.default_rng(seed)

    def starts(self, networks: int) -> np.ndarray:
        return self.rng.uniform(-0.7, 0.7, (networks, self.hidden * (len(self.lags) + 2) + 1))

    def paths(self, weights: np.ndarray, horizon: int, members: int) -> np.ndarray:
        """Bootstrap paths for days 0..horizon after the last value, averaged over the networks."""
        deepest = max(self.lags)
        x, out = lag_matrix(self.y, self.lags), self.y[deepest:]

        def ahead(rows):
            return _forward(np.broadcast_to(rows.T, (len(weights), *rows.T.shape)), weights, self.hidden)[1].mean(axis=0)

        shocks = self.rng.choice(out - ahead(x), size=(members, horizon + 1))
        track = np.empty((members, deepest + horizon + 1))
        track[:, :deepest] = self.y[-deepest:]
        for h in range(horizon + 1):
            at = deepest + h
            track[:, at] = ahead(np.column_stack([track[:, at - lag] for lag in self.lags])) + shocks[:, h]
        return np.exp(np.clip(track[:, deepest:] * self.scale + self.center, -700, 700)) - OFFSET


def train_issues(issues: list[Issue], networks: int, cells: int = TENSOR_CELLS) -> list[tuple[np.ndarray, int]]:
    """Weights of every issue's networks and how many of them converged.

    Issues of one lag order and one padded length go together, as many as ``cells`` allow: the shape that a network is
    trained in comes from its own issue, so the same sums are taken whatever it is trained beside.
    """
    found: list = [None] * len(issues)
    groups: dict[tuple, list[int]] = {}
    for at, one in enumerate(issues):
        groups.setdefault((tuple(one.lags), -(-(len(one.y) - max(one.lags)) // PADDED) * PADDED), []).append(at)
    for (lags, rows), places in groups.items():
        hidden = issues[places[0]].hidden
        step = max(1, cells // (networks * rows * (hidden * (len(lags) + 2) + 1)))
        for first in range(0, len(places), step):
            own = [issues[at] for at in places[first : first + step]]
            x, y, known = np.zeros((len(own), len(lags), rows)), np.zeros((len(own), rows)), np.zeros((len(own), rows), dtype=bool)
            for at, one in enumerate(own):
                n = len(one.y) - max(lags)
                x[at, :, :n], y[at, :n], known[at, :n] = lag_matrix(one.y, one.lags).T, one.y[max(lags) :], True
            each = [np.repeat(part, networks, axis=0) for part in (x, y, known)]
            w, converged = train(*each, np.concatenate([one.starts(networks) for one in own]), hidden)
            for at, weights, done in zip(places[first : first + step], w.reshape(len(own), networks, -1), converged.reshape(len(own), networks), strict=True):
                found[at] = (weights, int(done.sum()))
    return found


def neural_ar(
    targets: DataFrame,
    refs: DataFrame,
    horizon: int = 35,
    members: int = 31,
    lags: tuple[int, ...] | None = None,
    networks: int = 5,
    most_lags: int = 10,
    flags: bool = False,
) -> DataFrame:
    """Networks for each (site, reference date): site_id, reference_datetime, datetime, parameter, prediction.

    The record up to and including the reference date is scaffolded and gap-filled as of that
    date, so nothing later leaks in. Without ``lags`` each issue takes lags 1..p, p the order of least AIC up to ``most_lags`` by
    Yule-Walker moments of its own record. An issue with fewer known days than one fit needs (the deepest
    lag and two) keeps its rows, with NULL predictions. The first simulated day carries the date of issue (horizon 0). With ``flags``
    columns ``order`` and ``converged`` follow: the lag order, and whether all networks met the tolerance (NULL without a fit).

    Each row handed to Python is one daily series and the issues of one month, cut there. Its issues are trained as one
    tensor; draws belong to the issue, so its paths do not depend on what it is trained beside.
    """
    fixed = tuple(lags) if lags is not None else None
    least = (max(fixed) if fixed else 1) + 2
    known = targets.filter(F.col("observation").isNotNull()).select("site_id", "datetime", "observation")
    # A series is one row of (day, value) pairs; its length is bounded by the calendar.
    packed = known.groupBy("site_id").agg(
        F.sort_array(F.collect_list(F.struct("datetime", "observation"))).alias("series")
    )
    month = F.trunc("reference_datetime", "month").alias("month")
    issues = refs.groupBy("site_id", month).agg(F.sort_array(F.collect_set("reference_datetime")).alias("issues"))  # 31 at most
    jobs = spread(issues.join(packed, "site_id", "left"), "site_id", "month").select(
        "site_id",
        "issues",
        F.transform("issues", lambda d: F.datediff(d, F.lit(date(1970, 1, 1)))).alias("ends"),
        F.transform("issues", lambda d: F.xxhash64("site_id", d)).alias("seeds"),
        F.transform("series", lambda s: F.datediff(s["datetime"], F.lit(date(1970, 1, 1)))).alias("days"),
        F.transform("series", lambda s: s["observation"]).alias("values"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                able: dict[int, Issue] = {}
                for at, (end, seed) in enumerate(zip(row.ends, row.seeds, strict=True)):
                    count = 0 if row.days is None else int(np.searchsorted(row.days, end, "right"))
                    if count >= least:
                        filled = np.interp(np.arange(row.days[0], end + 1), row.days[:count], row.values[:count])
                        able[at] = Issue(filled, int(seed) & (2**64 - 1), fixed, most_lags)
                fits = dict(zip(able, train_issues(list(able.values()), networks), strict=True))
                for at, issue in enumerate(row.issues):
                    weights, done = fits.get(at, (None, None))
                    tracks = np.full((members, horizon + 1), np.nan) if weights is None else able[at].paths(weights, horizon, members)
                    yield pd.DataFrame(
                        {
                            "site_id": row.site_id,
                            "reference_datetime": issue,
                            "horizon": np.tile(np.arange(horizon + 1), members),
                            "parameter": np.repeat(np.arange(1, members + 1).astype(str), horizon + 1),
                            "prediction": tracks.ravel(),
                            "order": None if weights is None else max(able[at].lags),
                            "converged": None if weights is None else done == networks,
                        }
                    )

    schema = "site_id string, reference_datetime date, horizon int, parameter string, prediction double, order int, converged boolean"
    out = jobs.mapInPandas(run, schema).withColumn("datetime", F.expr("date_add(reference_datetime, horizon)"))
    return out.select("site_id", "reference_datetime", "datetime", "parameter", "prediction", *(["order", "converged"] if flags else []))


def filled_series(targets: DataFrame, end) -> DataFrame:
    """The gap-free daily series of every site up to ``end``."""
    days = scaffold(targets, ["site_id"], "observation", F.lit(end).cast("date"))
    return interpolate(days, ["site_id"], "observation")
