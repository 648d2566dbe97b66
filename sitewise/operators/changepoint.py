"""Changepoints in mean and variance, per series or shared by several series
of different sampling rate (K1-K8, J12, J13).

Definition (the solver of the field scripts is not available; this is the
penalised-likelihood formulation it names):

* a segment of a series with n points, sum S and sum of squares Q costs
  (-2 log-likelihood at the estimate):
  ``normal_meanvar``  n (ln 2pi + ln max(Q/n - (S/n)^2, 1e-8) + 1);
  ``normal_var``      the same with the variance around the whole series' mean;
  ``poisson_meanvar`` 2 S (ln n - ln S), 0 when S = 0;
* a fit minimises the sum of segment costs plus beta per changepoint;
  ``bic`` gives beta = (p + 1) ln n with p = 2, 1, 1 for the three costs,
  ``log_n`` gives factor * ln n, a number is used as is; several series
  fitted together pay the sum of their betas;
* a segment is allowed only when every series has at least ``min_seg``
  points in it;
* a changepoint is reported at the date of the last point of the left
  segment; the series end is not reported; on a tie the earlier split wins.

Shared changepoints (K3) use the grid of all dates of the group: each series
contributes its own points, so series sampled monthly, fortnightly or yearly
share one set of locations.

Numbers.  A normal cost does not depend on the level of its series, so each
such series is shifted to its mean before anything is summed, and sums are
taken in extended precision; the variance is clamped only after that.  A fit
of y + c is the fit of y.  The Poisson cost rests on the level and is not
shifted.

The program is pruned (PELT) and exact.  A start s is left out once it is
beaten by a later start t for good: F(s) + C(s, t] > F(t) gives F(s) + C(s, T]
> F(t) + C(t, T] for every end T, as splitting a segment never costs more.
Two things stand against that.  A split at t is usable only from the first T
on at which every series has ``min_seg`` points in (t, T], so a start is
dropped no earlier than there.  And a clamped segment costs more than its
likelihood, by up to 1 a point, so what (s, T] may gain by that is allowed
for: what (s, t] has of it, and the points from t on that a clamped segment
can hold at most (``_clamped_points``).

A group runs in one task as long as its series times its dates are within
``DIRECT_CELLS``.  Beyond that its costs are split, as one group may hold any
number of series: tasks keyed by (group, bucket of series, tile of end dates)
sum the segment costs of their series, and one task per group runs the program
over the summed rows of each end date, in date order, holding one value per
date.  Series with few dates beside others with many (``_Sums``) cost their own
dates, not all of the group's.  Costs are added along one fixed binary tree over ``LEAVES`` hash
classes of series in either case, so the number of buckets, the tile size and
the way taken never change a result.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewise.functions._util import as_list
from sitewise.operators._window import by_key

# Cost names, parameters per segment for the bic penalty, the
# variance floor and the minimum segment length.
COSTS = ("normal_meanvar", "normal_var", "poisson_meanvar")
N_PARAMS = {"normal_meanvar": 2, "normal_var": 1, "poisson_meanvar": 1}
VAR_FLOOR = 1e-8
MIN_SEG = 2
LOG_2PI = math.log(2 * math.pi)


# Series times dates of a group that are fitted in one task; 40 bytes each.
DIRECT_CELLS = 8_000_000
# Costs a tile of a larger group holds at a time.
TILE_CELLS = 4_000_000


def segment_variance(cost: str, n, s, q, mu=None):
    if cost == "normal_meanvar":
        return q / n - (s / n) ** 2
    return (q - 2 * mu * s + n * mu * mu) / n


def segment_cost(cost: str, n, s, q, mu=None):
    n = np.asarray(n, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        if cost in ("normal_meanvar", "normal_var"):
            var = np.maximum(np.asarray(segment_variance(cost, n, s, q, mu), dtype=float), VAR_FLOOR)
            return n * (LOG_2PI + np.log(var) + 1)
        if cost == "poisson_meanvar":
            s = np.asarray(s, dtype=float)
            pos = s > 0
            return np.where(pos, 2 * s * (np.log(n) - np.log(np.where(pos, s, 1.0))), 0.0)
    raise ValueError(f"unknown cost {cost!r}; expected one of {COSTS}")


def penalty_value(penalty, cost: str, n: int, factor: float = 1.0) -> float:
    if isinstance(penalty, (int, float)) and not isinstance(penalty, bool):
        return float(penalty)
    if penalty == "bic":
        return (N_PARAMS[cost] + 1) * math.log(n)
    if penalty == "log_n":
        return factor * math.log(n)
    raise ValueError(f"unknown penalty {penalty!r}")


def centred(y: np.ndarray, cost: str) -> np.ndarray:
    """The values a cost is summed over: less their mean for the normal
    costs, twice, as the mean of large values is itself rounded."""
    y = np.asarray(y, dtype=np.longdouble)
    if cost == "poisson_meanvar" or not len(y):
        return y
    z = y - y.mean()
    return z - z.mean()


def _clamped_points(z: np.ndarray, cost: str) -> np.ndarray:
    """For each number of points passed, how many of the next ones a segment
    that starts there and is clamped can hold at most."""
    n = len(z)
    left = np.arange(n, -1, -1, dtype=float)
    if cost == "poisson_meanvar":
        # not clamped; a negative value breaks the rule about splits
        return np.full(n + 1, np.inf) if n and z.min() < 0 else np.zeros(n + 1)
    z = z.astype(float)
    if cost == "normal_meanvar":
        # up to the next other value, if that alone lifts the variance over
        # the floor: two values x apart have a sum of squares of x * x / 2
        other = np.flatnonzero(np.diff(z)) + 1
        lifts = (z[other] - z[other - 1]) ** 2 / 2 >= 2 * n * VAR_FLOOR
    else:
        other = np.flatnonzero(z * z >= 2 * n * VAR_FLOOR)
        lifts = np.ones(len(other), bool)
    at = np.searchsorted(other, np.arange(n + 1), side="right" if cost == "normal_meanvar" else "left")
    known = at < len(other)
    stop = other[np.minimum(at, len(other) - 1)] if len(other) else np.zeros(n + 1, int)
    ok = known & (lifts[np.minimum(at, len(other) - 1)] if len(other) else False)
    return np.where(ok, stop - np.arange(n + 1), left)


class _Series:
    """Running counts, sums and sums of squares of series over a grid, and
    the costs of segments from them."""

    def __init__(self, series, costs: list[str], leaves: list[int], grid: np.ndarray):
        rows, count = len(grid) + 1, len(series)
        self.n, self.s, self.q = (np.zeros((count, rows), t) for t in (float, np.longdouble, np.longdouble))
        self.mu = np.zeros((count, 1))
        self.clamped = np.zeros(rows)
        self.of = {c: np.array([k for k, x in enumerate(costs) if x == c], int) for c in COSTS}
        for k, (d, y) in enumerate(series):
            z = centred(y, costs[k])
            at = np.searchsorted(grid, d) + 1
            for into, w in ((self.n, np.ones(len(z))), (self.s, z), (self.q, z * z)):
                np.add.at(into[k], at, w)
            self.mu[k] = float(z.mean()) if len(z) and costs[k] == "normal_var" else 0.0
            passed = np.cumsum(self.n[k]).astype(int)
            order = np.argsort(at, kind="stable")
            self.clamped += _clamped_points(z[order], costs[k])[passed]
        for x in (self.n, self.s, self.q):
            np.cumsum(x, axis=1, out=x)
        # the first series of each leaf, the second of each, and so on
        turn, turns = {}, {}
        for k, leaf in enumerate(leaves):
            turn[leaf] = turn.get(leaf, -1) + 1
            turns.setdefault(turn[leaf], []).append((k, leaf))
        self.turns = [tuple(np.array(x).T) for _, x in sorted(turns.items())]

    def usable(self, min_seg: int) -> np.ndarray:
        """For each date, the first end at which every series has enough
        points after it; beyond the last date if there is none."""
        out = np.zeros(self.n.shape[1], int)
        for n in self.n:
            out = np.maximum(out, np.searchsorted(n, n + min_seg))
        return out

    def add_costs(self, sums: np.ndarray, starts: np.ndarray, t: int, min_seg: int) -> tuple[np.ndarray, np.ndarray]:
        """Adds the costs of the segments (start, t] to the sums of the leaves
        (a row each), series by series.  Returns where every series has
        enough points, and what clamping has put on top."""
        n = self.n[:, t:t + 1] - self.n[:, starts]
        part, over = np.zeros_like(n), np.zeros(len(starts))
        with np.errstate(divide="ignore", invalid="ignore"):
            for name, k in self.of.items():
                if not len(k):
                    continue
                at = np.ix_(k, starts)
                m, s, q = n[k], self.s[k, t:t + 1] - self.s[at], self.q[k, t:t + 1] - self.q[at]
                part[k] = segment_cost(name, m, s, q, self.mu[k])
                if name != "poisson_meanvar":
                    var = np.asarray(segment_variance(name, m, s, q, self.mu[k]), dtype=float)
                    over += np.where(var < VAR_FLOOR, m, 0.0).sum(axis=0)
        for k, leaf in self.turns:
            sums[leaf] += part[k]
        return (n >= min_seg).all(axis=0), over


class _Sums:
    """Costs of segments of a group over all its dates.  ``leaves`` are the
    hash classes of the series, in order; each class is summed by itself, its
    series by size class (doublings of their points) and then as they come,
    and the classes along a tree.

    The cost of a series changes only with its own points.  The size classes
    from the smallest on that have at most half of the dates between them
    (monthly series beside daily ones) are therefore kept over their own
    dates, where a row of summed costs is worked out once per such end date
    and looked up for all dates up to the next one.  Where that line falls
    changes no sum."""

    def __init__(self, series, costs: list[str], grid: np.ndarray, leaves: list[int] | None = None, slots: int = 1):
        if (unknown := set(costs) - set(COSTS)):
            raise ValueError(f"unknown cost {sorted(unknown)}; expected one of {COSTS}")
        leaves = leaves or [0] * len(series)
        self.slots, self.rows = slots, len(grid) + 1
        sized: dict = {}
        for k, (d, _) in enumerate(series):
            sized.setdefault(len(d).bit_length(), []).append(k)
        few, rest, own = [], [], grid[:0]
        for _, of in sorted(sized.items()):
            dates = np.unique(np.concatenate([own, *[series[k][0] for k in of]]))
            if not rest and 2 * len(dates) <= len(grid):
                few, own = few + of, dates
            else:
                rest += of
        self.few, self.rest = (_Series([series[k] for k in x], [costs[k] for k in x], [leaves[k] for k in x], g)
                               for x, g in ((few, own), (rest, grid)))
        # dates of the sparse grid passed at each date, and the dates' places
        self.passed = np.concatenate([[0], np.searchsorted(own, grid, side="right")])
        self.place = np.concatenate([[0], np.searchsorted(grid, own) + 1, [self.rows]])
        self.clamped = self.rest.clamped + self.few.clamped[self.passed]
        self.known = None

    def usable(self, min_seg: int) -> np.ndarray:
        """As of the series, over all dates."""
        return np.maximum(self.rest.usable(min_seg), self.place[self.few.usable(min_seg)][self.passed])

    def costs(self, starts: np.ndarray, t: int, min_seg: int) -> tuple[np.ndarray, np.ndarray]:
        """Summed cost of the segments (start, t], inf where a series has too
        few points, and what clamping has put on top of it."""
        end = self.passed[t]
        if self.known is None or self.known[0] != (end, min_seg):
            sums = np.zeros((self.slots, end + 1))
            self.known = (end, min_seg), sums, *self.few.add_costs(sums, np.arange(end + 1), end, min_seg)
        _, sums, ok, more = self.known
        total, over = np.full(len(starts), np.inf), np.zeros(len(starts))
        left = np.flatnonzero(ok[self.passed[starts]])
        at = self.passed[starts[left]]
        sums = sums[:, at]
        ok, over[left] = self.rest.add_costs(sums, starts[left], t, min_seg)
        over[left] += more[at]
        while len(sums) > 1:
            sums = sums[::2] + sums[1::2]
        total[left] = np.where(ok, sums[0], np.inf)
        return total, over


class _Program:
    """The dynamic program over all starts, fed with one row of costs per end
    date."""

    def __init__(self, beta: float, room: int = 1024):
        self.beta, self.t = beta, 0
        self.best, self.prev = np.empty(room), np.zeros(room, int)
        self.best[0] = -beta

    def step(self, costs: np.ndarray) -> None:
        self.t += 1
        if self.t == len(self.best):
            self.best, self.prev = (np.concatenate([x, np.zeros_like(x)]) for x in (self.best, self.prev))
        total = self.best[:self.t] + costs
        j = int(np.argmin(total))
        self.best[self.t], self.prev[self.t] = total[j] + self.beta, j

    def changepoints(self) -> tuple[list[int], float]:
        return _walk(self.prev[:self.t + 1], self.best[self.t])


def _walk(prev: np.ndarray, best: float) -> tuple[list[int], float]:
    out = []
    b = int(prev[-1]) if np.isfinite(best) else 0
    while b > 0:
        out.append(b)
        b = int(prev[b])
    return out[::-1], float(best)


def _pruned(sums: _Sums, beta: float, min_seg: int) -> tuple[list[int], float]:
    """The program over the starts that can still matter."""
    end = sums.rows - 1
    best, prev = np.full(end + 1, np.inf), np.zeros(end + 1, int)
    best[0] = -beta
    usable = sums.usable(min_seg)
    starts, gone = np.zeros(1, int), np.full(1, end + 1)  # and the end from which one is dropped
    for t in range(1, end + 1):
        if (out := gone <= t).any():
            starts, gone = starts[~out], gone[~out]
        costs, over = sums.costs(starts, t, min_seg)
        total = best[starts] + costs
        j = int(np.argmin(total))
        best[t], prev[t] = total[j] + beta, starts[j]
        if np.isfinite(best[t]):
            # the rest is for rounding
            beaten = np.isfinite(total) & (total - over > best[t] + sums.clamped[t] + 1e-6 + 1e-9 * abs(best[t]))
            gone = np.where(beaten, np.minimum(gone, usable[t]), gone)
            starts, gone = np.append(starts, t), np.append(gone, end + 1)
    return _walk(prev, best[end])


def solve(series: list[tuple[np.ndarray, np.ndarray]], costs: list[str], betas: list[float],
          min_seg: int = MIN_SEG, leaves: list[int] | None = None):
    """Optimal segmentation of one group.

    ``series``: per series (sorted dates as datetime64[D] or days, values).
    Returns (grid, changepoint indices into the grid (1-based ends of left
    segments), optimal cost).
    """
    grid = np.unique(np.concatenate([d for d, _ in series]))
    sums = _Sums(series, costs, grid, leaves, LEAVES if leaves else 1)
    beta = float(sum(betas)) if leaves is None else float(_tree(_by_leaf(betas, leaves)))
    cps, total = _pruned(sums, beta, min_seg)
    return grid, cps, total


# Series of at most this many points are fitted side by side, this many points
# at a time.
SIDE_BY_SIDE, BLOCK = 256, 32_768


def solve_all(dates: list[np.ndarray], values: list[np.ndarray], costs: list[str], betas: list[float],
              min_seg: int = MIN_SEG) -> list[tuple[np.ndarray, list[int], float]]:
    """``solve`` of each series by itself, dates sorted.  Short series without
    repeated dates are fitted together with those of the same length and cost:
    a step of the program is then one row of costs per series of a block, from
    the same sums and in the same order as alone.  All starts are kept, which
    changes no result."""
    out: list = [None] * len(dates)
    alike: dict = {}
    for i, d in enumerate(dates):
        if len(d) > SIDE_BY_SIDE or costs[i] not in COSTS or (d[1:] == d[:-1]).any():
            out[i] = solve([(d, values[i])], [costs[i]], [betas[i]], min_seg)
        else:
            alike.setdefault((len(d), costs[i]), []).append(i)
    for (n, cost), of in alike.items():
        size = max(1, BLOCK // n)
        for at in range(0, len(of), size):
            part = of[at:at + size]
            prev, best = _side_by_side(np.stack([values[i] for i in part]), cost, np.array([betas[i] for i in part]), min_seg)
            for k, i in enumerate(part):
                out[i] = (dates[i], *_walk(prev[k], best[k]))
    return out


def _side_by_side(y: np.ndarray, cost: str, beta: np.ndarray, min_seg: int) -> tuple[np.ndarray, np.ndarray]:
    """The program of several series of equal length: last start of each end,
    and the cost of the whole."""
    count, n = y.shape
    z = np.stack([centred(row, cost) for row in y])
    mu = np.array([float(row.mean()) for row in z])[:, None] if cost == "normal_var" else np.zeros((count, 1))
    s, q = (np.concatenate([np.zeros((count, 1), np.longdouble), np.cumsum(x, axis=1)], axis=1) for x in (z, z * z))
    best, prev = np.full((count, n + 1), np.inf), np.zeros((count, n + 1), int)
    best[:, 0] = -beta
    rows = np.arange(count)
    for t in range(1, n + 1):
        starts = min(t, max(0, t - min_seg + 1))  # the others leave too few points
        if not starts:
            continue
        points = np.arange(t, t - starts, -1, dtype=float)[None]
        total = best[:, :starts] + segment_cost(cost, points, s[:, t:t + 1] - s[:, :starts], q[:, t:t + 1] - q[:, :starts], mu)
        j = np.argmin(total, axis=1)
        best[:, t], prev[:, t] = total[rows, j] + beta, j
    return prev, best[:, n]


FIT_FIELDS = [T.StructField("cpt_type", T.StringType()), T.StructField("cost", T.DoubleType()),
              T.StructField("n_cpts", T.LongType()), T.StructField("n_grid", T.LongType()),
              T.StructField("locs", T.ArrayType(T.DateType()))]


def _pick(spec, names, default=None):
    """Entry of a map under the first of ``names`` it has, else its ``'*'``."""
    if isinstance(spec, dict):
        for n in names:
            if n is not None and str(n) in spec:
                return spec[str(n)]
        return spec.get("*", default)
    return spec


def _series_of(pdf: pd.DataFrame, keyed: bool, cost, penalty, penalty_factor):
    """The series of some rows (``_s``, ``_d``, ``_y``, ``_kv``), in name
    order with a null name last: names, points, costs and penalties.  A map
    is looked up under the series, all key values joined by ``|``, then each
    key value."""
    d_all, y_all = pdf["_d"].to_numpy(dtype=np.int64), pdf["_y"].to_numpy(dtype=float)
    keys = json.loads(pdf["_kv"].iloc[0])
    under = ["|".join(str(k) for k in keys), *keys]
    code, known = pd.factorize(pdf["_s"], use_na_sentinel=True)
    named = [(None if i < 0 else known[i], i) for i in np.unique(code)]
    order = np.lexsort((d_all, code))
    code, d_all, y_all = code[order], d_all[order], y_all[order]
    out = []
    for name, i in sorted(named, key=lambda x: (x[0] is None, x[0] or "")):
        sel = slice(*np.searchsorted(code, [i, i + 1]))
        d, y = d_all[sel], y_all[sel]
        look = ([name] if keyed else []) + under
        c = _pick(cost, look, "normal_meanvar")
        out.append((name, (d, y), c, penalty_value(_pick(penalty, look, "bic"), c, len(y), penalty_factor)))
    return out


def _source(df: DataFrame, ks, idx, v, series):
    """Keys and the points as ``_d`` (days), ``_y`` with the series ``_s``."""
    src = df.select(*ks, F.unix_date(F.col(idx).cast("date")).alias("_d"), F.col(v).cast("double").alias("_y"),
                    (F.col(series).cast("string") if series else F.lit("")).alias("_s"),
                    F.to_json(F.array(*[F.col(k).cast("string") for k in ks])).alias("_kv"))
    return src.filter(F.col("_y").isNotNull() & ~F.isnan("_y") & F.col("_d").isNotNull())


def changepoint_fit(df: DataFrame, keys, idx: str, v: str, series: str | None = None,
                    cost="normal_meanvar", penalty="bic", penalty_factor: float = 1.0,
                    min_seg: int = MIN_SEG, cpt_type: str | None = None,
                    buckets: int = 8, tile: int = 512) -> DataFrame:
    """One row per group: the optimal cost, number of changepoints, grid
    length and the changepoint dates (``locs``).

    ``keys`` define the groups; ``series`` (optional) names the series
    within a group, fitted jointly (K3), a null name being a series of its
    own.  ``cost`` and ``penalty`` may be maps from a series or group value
    (as text; several keys joined by ``|``) to a name, ``'*'`` being the
    default (K2).  Null values are left out.  ``buckets`` (a power of two up
    to ``LEAVES``) and ``tile`` spread a joint fit and change no result.
    """
    ks = as_list(keys)
    kind = cpt_type or ("joint" if series else "uni")
    src = _source(df, ks, idx, v, series)
    if series:
        fit = _joint_fit(src, ks, cost, penalty, penalty_factor, min_seg, buckets, tile)
        return fit.select(*ks, F.lit(kind).alias("cpt_type"), "cost", "n_cpts", "n_grid", "locs")
    # one row per group with its points in order; Python gets many at a time
    points = src.groupBy(*ks).agg(F.sort_array(F.collect_list(F.struct("_d", "_y"))).alias("_p"), F.first("_kv").alias("_kv"))
    schema = T.StructType(FIT_FIELDS[1:-1] + [T.StructField("locs", T.ArrayType(T.IntegerType()))])

    def fit_all(d: pd.Series, y: pd.Series, kv: pd.Series) -> pd.DataFrame:
        dates, values = [np.asarray(x, dtype=np.int64) for x in d], [np.asarray(x, dtype=float) for x in y]
        costs, betas, known = [], [], {}
        mapped = isinstance(cost, dict) or isinstance(penalty, dict)
        for x, of in zip(dates, kv):
            if (at := (len(x), of if mapped else None)) not in known:
                keys = json.loads(of) if mapped else []
                look = ["|".join(str(k) for k in keys), *keys]
                c = _pick(cost, look, "normal_meanvar")
                known[at] = (c, penalty_value(_pick(penalty, look, "bic"), c, len(x), penalty_factor))
            costs.append(known[at][0])
            betas.append(known[at][1])
        fits = solve_all(dates, values, costs, betas, min_seg)
        return pd.DataFrame({"cost": [float(total) for *_, total in fits], "n_cpts": [len(cps) for _, cps, _ in fits],
                             "n_grid": [len(grid) for grid, *_ in fits],
                             "locs": [[int(grid[i - 1]) for i in cps] for grid, cps, _ in fits]})

    # not to be fitted again for a filter on the result
    run = F.pandas_udf(fit_all, schema).asNondeterministic()
    fit = points.withColumn("_fit", run("_p._d", "_p._y", "_kv"))
    return _dated(fit.select(*ks, F.lit(kind).alias("cpt_type"), "_fit.*"))


def _dated(fit: DataFrame) -> DataFrame:
    return fit.withColumn("locs", F.transform("locs", lambda x: F.date_from_unix_date(x)))


# Hash classes of series; fixed, as the order of additions rests on them.
LEAVES = 64


def _tree(parts: list):
    """Sum along a binary tree; None is an absent leaf."""
    while len(parts) > 1:
        parts = [b if a is None else a if b is None else a + b for a, b in zip(parts[::2], parts[1::2])]
    return parts[0]


def _by_leaf(values: list[float], leaves: list[int], first: int = 0, slots: int = LEAVES) -> list:
    """Sums of the values of each class, None for one without any."""
    out: list = [None] * slots
    for v, leaf in zip(values, leaves):
        out[leaf - first] = v if out[leaf - first] is None else out[leaf - first] + v
    return out


def _leaf_series(pdf: pd.DataFrame, cost, penalty, penalty_factor):
    """The series of a group class by class, each class in name order: class,
    points, cost and penalty."""
    out = []
    for leaf, part in pdf.groupby("_leaf", sort=True):
        out += [(int(leaf), points, c, beta) for _, points, c, beta in _series_of(part, True, cost, penalty, penalty_factor)]
    return out


def _joint_fit(src: DataFrame, ks, cost, penalty, penalty_factor, min_seg, buckets, tile) -> DataFrame:
    if buckets < 1 or LEAVES % buckets or buckets & (buckets - 1):
        raise ValueError(f"buckets must be a power of two up to {LEAVES}")
    # the points are dealt by group once; sizes, joins and the fits in one
    # task keep that partitioning
    src = src.withColumn("_leaf", F.pmod(F.xxhash64("_s"), F.lit(LEAVES)).cast("int"))
    # tied to a column, so that constant keys are not folded into a plan
    # without keys
    src = src.withColumn("_g", F.when(F.col("_leaf") >= 0, F.to_json(F.struct(*ks), {"ignoreNullFields": "false"}))).repartition("_g")
    none = F.when(F.col("_s").isNull(), 1).otherwise(0)
    sizes = src.groupBy("_g").agg((F.size(F.collect_set("_d")) * (F.count_distinct("_s") + F.max(none))).alias("_cells"))
    out = "_g string, cost double, n_cpts long, n_grid long, locs array<int>"

    def direct(pdf: pd.DataFrame) -> pd.DataFrame:
        of = _leaf_series(pdf, cost, penalty, penalty_factor)
        grid, cps, total = solve([p for _, p, _, _ in of], [c for _, _, c, _ in of], [b for *_, b in of], min_seg,
                                 [leaf for leaf, *_ in of])
        return pd.DataFrame({"_g": pdf["_g"].iloc[:1], "cost": [total], "n_cpts": [len(cps)], "n_grid": [len(grid)],
                             "locs": [[int(grid[i - 1]) for i in cps]]})

    small = src.join(sizes.where(F.col("_cells") <= DIRECT_CELLS), "_g", "left_semi").groupBy("_g").applyInPandas(direct, out)
    large = src.join(sizes.where(F.col("_cells") > DIRECT_CELLS), "_g", "left_semi")
    keys = src.groupBy("_g").agg(*[F.first(k).alias(k) for k in ks])
    return _dated(small.unionByName(_tiled_fit(large, cost, penalty, penalty_factor, min_seg, buckets, tile, out))).join(keys, "_g")


def _tiled_fit(src: DataFrame, cost, penalty, penalty_factor, min_seg, buckets, tile, out) -> DataFrame:
    per = LEAVES // buckets
    src = src.withColumn("_b", F.floor(F.col("_leaf") / per).cast("int"))
    # one row per group; every use takes all of it, so the aggregate is one
    # exchange however often it is read
    grid = src.groupBy("_g").agg(F.array_sort(F.collect_set("_d")).alias("grid"))
    # end dates of a tile, so that its rows of costs stay within TILE_CELLS
    ends_ = F.greatest(F.lit(1), F.least(F.lit(tile), F.floor(F.lit(TILE_CELLS) / F.size("grid")))).cast("int")
    grid = grid.withColumn("_step", ends_)
    tiles = F.explode(F.sequence(F.lit(0), F.floor((F.size("grid") - 1) / F.col("_step")).cast("int")))
    todo = grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("_jb"))
    todo = todo.select(F.col("_g").alias("_jg"), "_jb", "grid", "_step", tiles.alias("_jt"))
    points = src.join(grid, "_g").select("_g", "_b", "_leaf", "_s", "_d", "_y", "_kv", tiles.alias("_tile"))

    def block(pdf: pd.DataFrame, job: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=["_g", "t", "_b", "d", "beta", "costs"], dtype=object)
        dates = np.array(job["grid"].iloc[0], dtype=np.int64)
        step, slot = int(job["_step"].iloc[0]), int(job["_jb"].iloc[0])
        first = int(job["_jt"].iloc[0]) * step
        ends = range(first + 1, min(first + step, len(dates)) + 1)
        of = _leaf_series(pdf, cost, penalty, penalty_factor)
        leaves = [leaf - slot * per for leaf, *_ in of]
        sums = _Sums([p for _, p, _, _ in of], [c for _, _, c, _ in of], dates, leaves, per)
        beta = _tree(_by_leaf([b for *_, b in of], leaves, 0, per))
        return pd.DataFrame({"_g": job["_jg"].iloc[0], "t": list(ends), "_b": slot, "d": [int(dates[t - 1]) for t in ends],
                             "beta": beta, "costs": [sums.costs(np.arange(t), t, min_seg)[0] for t in ends]})

    blocks = points.groupBy("_g", "_b", "_tile").cogroup(todo.groupBy("_jg", "_jb", "_jt")).applyInPandas(
        block, "_g string, t int, _b int, d int, beta double, costs array<double>")

    def run(frames):
        state, group, dates, parts, betas, t = None, None, [], [None] * buckets, [None] * buckets, 0

        def step():
            nonlocal state, parts
            if state is None:
                state = _Program(float(_tree(list(betas))))
            state.step(_tree(parts))
            parts = [None] * buckets

        def result():
            cps, total = state.changepoints()
            return pd.DataFrame({"_g": [group], "cost": [total], "n_cpts": [len(cps)], "n_grid": [len(dates)],
                                 "locs": [[dates[i - 1] for i in cps]]})

        for frame in frames:
            for g, end, b, d, beta, costs in frame.itertuples(index=False, name=None):
                if g != group or end != t:
                    if group is not None:
                        step()
                    if g != group:
                        if group is not None:
                            yield result()
                        state, group, dates, betas = None, g, [], [None] * buckets
                    t = end
                    dates.append(d)
                parts[b], betas[b] = np.asarray(costs), beta
        if group is not None:
            step()
            yield result()

    return blocks.repartition("_g").sortWithinPartitions("_g", "t", "_b").mapInPandas(run, out)


def fit_segments(df: DataFrame, keys, idx: str, v: str, series: str | None = None, **fit) -> DataFrame:
    """All rows and columns of ``df`` with the segment number (changepoints
    dated before the row; null without a date) and the fit type, from a fit
    of its non-null values."""
    ks = as_list(keys)
    found = changepoint_fit(df, ks, idx, v, series=series, **fit)
    found = found.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(ks)], "cpt_type", F.col("locs").alias("_locs"))
    same = None
    for i, k in enumerate(ks):
        c = df[k].eqNullSafe(F.col(f"_k{i}"))
        same = c if same is None else same & c
    out = df.join(found, same, "left")
    before = F.size(F.filter(F.coalesce("_locs", F.array().cast("array<date>")), lambda x: x < F.col(idx)))
    return out.withColumn("segment", F.when(F.col(idx).isNotNull(), before.cast("long"))).drop("_locs", *[f"_k{i}" for i in range(len(ks))])


def shared_changepoints_per_series(df: DataFrame, keys, series: str, idx: str, v: str,
                                   **kw) -> DataFrame:
    """Shared changepoints of each group, one row per series of the group and
    changepoint (J12): the result is the size of the answer itself."""
    ks = as_list(keys)
    cpts = changepoints(df, ks, idx, v, series=series, **kw)
    of = df.filter(F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double")) & F.col(idx).isNotNull()).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(ks)], F.col(series).cast("string").alias(series)).distinct()
    same = None
    for i, k in enumerate(ks):
        c = cpts[k].eqNullSafe(F.col(f"_k{i}"))
        same = c if same is None else same & c
    return cpts.join(of, same).select(*ks, series, "cpt_type", "loc")


def changepoints(df: DataFrame, keys, idx: str, v: str, **kw) -> DataFrame:
    """Changepoint table (keys, cpt_type, loc): univariate per key (K1, K2)
    or shared by the series of a group (K3)."""
    fit = changepoint_fit(df, keys, idx, v, **kw)
    return fit.select(*as_list(keys), "cpt_type", F.explode("locs").alias("loc"))


def joint_with_uni(df: DataFrame, keys, series: str, idx: str, v: str, **kw) -> DataFrame:
    """Shared fit of each group beside the univariate fit of each of its
    series, with their costs (K4): (keys, series, cpt_type, cost, n_cpts,
    n_grid, locs); the joint row has a null series."""
    ks = as_list(keys)
    joint = changepoint_fit(df, ks, idx, v, series=series, **kw).withColumn(
        series, F.lit(None).cast(df.schema[series].dataType))
    uni = changepoint_fit(df, ks + [series], idx, v, **kw)
    return joint.unionByName(uni)


def with_segments(df: DataFrame, cpts: DataFrame, keys, idx: str, seg: str = "segment") -> DataFrame:
    """Segment number of each row: changepoints dated before the row's date
    (J13).  Rows and changepoint markers are unioned and counted in one
    running window per key: no range join, no pairs."""
    ks = as_list(keys)
    rows = df.withColumn("_m", F.lit(0))
    marks = cpts.select(*ks, F.col("loc").alias(idx)).withColumn("_m", F.lit(1))
    allr = rows.unionByName(marks, allowMissingColumns=True)
    w = by_key(ks).orderBy(idx, "_m").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (allr.withColumn(seg, F.sum("_m").over(w) - F.col("_m"))
            .filter(F.col("_m") == 0).drop("_m"))


def segment_stats(df: DataFrame, cpts: DataFrame | None, keys, idx: str, v: str,
                  cost: str = "normal_meanvar", **fit) -> DataFrame:
    """Per segment: first and last date, n, mean, sd and cost (K7).  With
    ``cpts=None`` the changepoints are fitted here (``fit_segments``, same
    ``cost``)."""
    ks = as_list(keys)
    if cost not in COSTS:
        raise ValueError(f"unknown cost {cost!r}; expected one of {COSTS}")
    if cpts is None:
        seg = fit_segments(df, ks, idx, v, cost=cost, **fit).filter(F.col(v).isNotNull() & F.col(idx).isNotNull())
    else:
        seg = with_segments(df.filter(F.col(v).isNotNull()), cpts, ks, idx)
    y = F.col(v)
    # shifted to the mean of the key, as the fit does
    seg = seg.withColumn("_z", y - F.avg(y).over(by_key(ks)))
    out = (seg.groupBy(*ks, "segment")
           .agg(F.min(idx).alias("start"), F.max(idx).alias("end"), F.count(y).alias("n"),
                F.avg(y).alias("mean"), F.stddev_samp(y).alias("sd"),
                F.sum(y).alias("_s"), F.var_pop("_z").alias("_v"), F.avg(F.col("_z") * F.col("_z")).alias("_q")))
    n, s = F.col("n"), F.col("_s")
    if cost == "poisson_meanvar":
        c = F.when(s > 0, 2 * s * (F.log(n) - F.log(s))).otherwise(F.lit(0.0))
    else:
        var = F.col("_v") if cost == "normal_meanvar" else F.col("_q")
        c = n * (F.lit(LOG_2PI) + F.log(F.greatest(var, F.lit(VAR_FLOOR))) + 1)
    return out.withColumn("cost", c).drop("_s", "_v", "_q")


def attach_segment_mean(df: DataFrame, cpts: DataFrame | None, keys, idx: str, v: str,
                        out: str = "cpts", series: str | None = None, **fit) -> DataFrame:
    """Each row, with all its columns, and the mean of its segment (K1's
    table with segment means), per series if there are several.  With
    ``cpts=None`` the changepoints are fitted here (``fit_segments``)."""
    ks = as_list(keys)
    seg = fit_segments(df, ks, idx, v, series=series, **fit) if cpts is None else with_segments(df, cpts, ks, idx)
    return seg.withColumn(out, F.avg(v).over(by_key(ks + ([series] if series else []) + ["segment"])))
