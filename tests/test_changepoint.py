import datetime as dt
import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from sitewise.operators.changepoint import (changepoint_fit, changepoints, penalty_value, segment_cost,
                                            segment_stats, solve, with_segments)


def _days(n, step=1, start=0):
    return np.array([np.datetime64("2000-01-01") + np.timedelta64(start + step * i, "D") for i in range(n)])


def brute(y, cost, beta, min_seg=2):
    """Exhaustive search over every set of split points."""
    n = len(y)
    best = (math.inf, None)
    for m in range(n):
        for cps in itertools.combinations(range(1, n), m):
            b = (0,) + cps + (n,)
            if any(b[i + 1] - b[i] < min_seg for i in range(len(b) - 1)):
                continue
            tot = beta * m
            for i in range(len(b) - 1):
                seg = y[b[i]:b[i + 1]]
                tot += float(segment_cost(cost, len(seg), seg.sum(), (seg ** 2).sum(), y.mean()))
            if tot < best[0] - 1e-9:
                best = (tot, list(cps))
    return best


def test_dp_equals_exhaustive_search():
    rng = np.random.default_rng(7)
    for cost in ("normal_meanvar", "normal_var", "poisson_meanvar"):
        for trial in range(4):
            y = np.concatenate([rng.poisson(3, 5), rng.poisson(12, 6)]).astype(float) + rng.random(11) * 0.1
            beta = 2.0 + trial
            grid, cps, total = solve([(_days(len(y)), y)], [cost], [beta])
            b_total, b_cps = brute(y, cost, beta)
            assert abs(total - b_total) < 1e-6 and cps == b_cps


def full_program(series, costs, betas, min_seg=2):
    """The whole cost matrix, then the program over it: plain and slow."""
    grid = np.unique(np.concatenate([d for d, _ in series]))
    n = len(grid)
    total = np.zeros((n + 1, n + 1))
    for (d, y), c in zip(series, costs):
        pos = np.searchsorted(grid, d) + 1
        z = y if c == "poisson_meanvar" else y - y.mean()
        N, S, Q = (np.cumsum(np.bincount(pos, weights=w, minlength=n + 1)) for w in (np.ones(len(z)), z, z * z))
        dn = N[None] - N[:, None]
        part = segment_cost(c, dn, S[None] - S[:, None], Q[None] - Q[:, None], 0.0)
        total += np.where(dn >= min_seg, part, np.inf)
    best, prev = [-sum(betas)], [0]
    for t in range(1, n + 1):
        x = np.array(best) + total[:t, t]
        prev.append(int(np.argmin(x)))
        best.append(x[prev[-1]] + sum(betas))
    cps, b = [], prev[n] if np.isfinite(best[n]) else 0
    while b > 0:
        cps.append(b)
        b = prev[b]
    return sorted(cps), best[n]


def _random_group(rng, rates, n):
    out = []
    for step in rates:
        m = -(-n // step)
        level = np.repeat(rng.uniform(0, 6, 8), -(-m // 8))[:m]
        out.append((_days(m, step=step), rng.poisson(level).astype(float) + rng.random(m) * rng.choice([0.01, 1.0])))
    return out


def test_exact_beyond_400_dates():
    """Random fits of 300 to 1,200 dates, all costs, both penalties, one to
    three rates, against the plain program."""
    rng = np.random.default_rng(3)
    names = ("normal_meanvar", "normal_var", "poisson_meanvar")
    for trial in range(200):
        rates = ([1], [1, 14], [1, 14, 30])[trial % 3]
        n = int(rng.integers(300, 1200 if trial % 20 == 0 else 480))
        group = _random_group(rng, rates, n)
        costs = [names[int(rng.integers(3))] for _ in rates]
        pen = ("bic", "log_n")[trial % 2]
        betas = [penalty_value(pen, c, len(y), 0.5) for c, (_, y) in zip(costs, group)]
        grid, cps, total = solve(group, costs, betas)
        want, cost = full_program(group, costs, betas)
        assert cps == want and abs(total - cost) < 1e-6 * max(1, abs(cost))


def test_level_changes_no_fit():
    """Fits of y and of y + c, both normal costs, up to c = 1e8."""
    rng = np.random.default_rng(12)
    some = 0
    for trial in range(200):
        cost = ("normal_meanvar", "normal_var")[trial % 2]
        n = int(rng.integers(60, 220))
        y = rng.normal(np.repeat(rng.uniform(0, 8, 5), -(-n // 5))[:n], np.repeat(rng.uniform(1, 3, 4), -(-n // 4))[:n])
        beta = penalty_value("bic", cost, n)
        _, cps, total = solve([(_days(n), y)], [cost], [beta])
        some += bool(cps)
        for c in (1e3, 1e5, 1e8):
            _, moved, cost_of = solve([(_days(n), y + c)], [cost], [beta])
            assert moved == cps and abs(cost_of - total) < 1e-3
    assert some > 100


def all_starts(series, costs, betas, min_seg=2):
    """The program without pruning over the same segment costs."""
    from sitewise.operators.changepoint import _Program, _Sums
    grid = np.unique(np.concatenate([d for d, _ in series]))
    sums, program = _Sums(series, costs, grid), _Program(float(sum(betas)), room=4)
    for t in range(1, len(grid) + 1):
        program.step(sums.costs(np.arange(t), t, min_seg)[0])
    return program.changepoints()


def test_pruning_drops_no_start_that_matters():
    """Values around the variance floor, constant stretches, negative values
    under a Poisson cost and sparse series, where splits are usable late."""
    rng = np.random.default_rng(21)
    names = ("normal_meanvar", "normal_var", "poisson_meanvar")
    for trial in range(300):
        group, costs = [], []
        for step in ([1], [1, 9], [3, 20])[trial % 3]:
            n = int(rng.integers(8, 70))
            scale = rng.choice([1e-6, 5e-5, 1e-4, 3e-4, 0.05, 1.0, 300.0])
            y = rng.integers(0, rng.choice([1, 2, 4]) + 1, n) * scale
            if trial % 4 == 0:
                y[: n // 2] = y[0]
            if trial % 7 == 0:
                y = y - scale
            group.append((_days(n, step=step), y))
            costs.append(names[int(rng.integers(3))])
        betas = [float(rng.choice([0.01, 0.5, 3.0, 12.0])) for _ in costs]
        min_seg = int(rng.choice([1, 2, 5]))
        grid, cps, total = solve(group, costs, betas, min_seg)
        want, best = all_starts(group, costs, betas, min_seg)
        assert (cps, total) == (want, best), (trial, costs, betas, min_seg)


def test_many_dates_in_one_task():
    """25,000 daily values with a change each 250 days, and three such series
    together with an annual one."""
    rng = np.random.default_rng(5)
    n, step = 25_000, 250
    y = rng.normal(np.repeat(np.arange(n // step) % 7 * 9.0, step), 1)
    _, cps, _ = solve([(_days(n), y)], ["normal_meanvar"], [penalty_value("bic", "normal_meanvar", n)])
    assert cps == list(range(step, n, step))
    group = [(_days(n), y * f) for f in (1.0, 2.0)] + [(_days(n // 365, step=365), rng.poisson(9, n // 365).astype(float))]
    grid, cps, _ = solve(group, ["normal_meanvar"] * 2 + ["poisson_meanvar"], [20.0] * 3)
    assert len(grid) == n and len(cps) > 20
    for a, b in zip(cps, cps[1:]):  # two annual values in every segment
        assert sum(a <= i * 365 < b for i in range(n // 365)) >= 2


def _joint_frame(spark):
    rng = np.random.default_rng(8)
    rows_ = []
    for g in ("x", "y", None):
        for k in range(20):
            name = None if k == 7 else f"s{k}"
            for d, y in zip(*_random_group(rng, [1 + k % 3], 70)[0]):
                rows_.append((g, 5 if g else None, name, d.astype(object), float(y), "more"))
    rows_ += [("x", 5, "s1", None, 1.0, "more"), ("x", 5, "s2", dt.date(2000, 1, 5), None, "more")]
    return spark.createDataFrame(rows_, "g string, h int, s string, d date, v double, extra string")


def test_buckets_and_tiles_never_change_a_joint_fit(spark, monkeypatch):
    """In one task, and split over buckets and tiles."""
    from sitewise.operators import changepoint as module
    df = _joint_frame(spark)
    kw = {"series": "s", "penalty": "log_n", "penalty_factor": 0.3, "cost": {"s3": "poisson_meanvar", "*": "normal_meanvar"}}
    fits = []
    for cells, buckets, tile in ((None, 8, 512), (0, 1, 512), (0, 8, 512), (0, 64, 16)):
        if cells is not None:
            monkeypatch.setattr(module, "DIRECT_CELLS", cells)
            monkeypatch.setattr(module, "TILE_CELLS", 2000)
        fit = changepoint_fit(df, ["g", "h"], "d", "v", buckets=buckets, tile=tile, **kw).collect()
        fits.append(sorted((str(r.g), r.cost, r.n_grid, r.locs) for r in fit))
    assert all(f == fits[0] for f in fits) and len(fits[0]) == 3 and any(f[3] for f in fits[0])
    part = [r for r in df.collect() if r.g == "y" and r.v is not None and r.d is not None]
    names = sorted({r.s for r in part}, key=lambda x: (x is None, x or ""))
    group = [(np.array(sorted(r.d for r in part if r.s == n), dtype="datetime64[D]"),
              np.array([r.v for r in sorted((r for r in part if r.s == n), key=lambda r: r.d)])) for n in names]
    costs = ["poisson_meanvar" if n == "s3" else "normal_meanvar" for n in names]
    cps, total = full_program(group, costs, [0.3 * math.log(len(y)) for _, y in group])
    got = next(f for f in fits[0] if f[0] == "y")
    grid = np.unique(np.concatenate([d for d, _ in group]))
    assert got[3] == [grid[c - 1].astype(object) for c in cps] and abs(got[1] - total) < 1e-6


def test_segments_keep_all_rows_and_columns(spark):
    from sitewise.operators.changepoint import attach_segment_mean, shared_changepoints_per_series
    df = _joint_frame(spark)
    kw = {"penalty": "log_n", "penalty_factor": 0.3}
    out = attach_segment_mean(df, None, ["g", "h"], "d", "v", series="s", **kw)
    assert out.count() == df.count() and set(df.columns) < set(out.columns)
    assert out.filter("d is null").first().segment is None
    per = shared_changepoints_per_series(df, ["g", "h"], "s", "d", "v", **kw)
    assert per.filter("s is null").count() > 0 and per.filter("g is null").count() > 0


def test_maps_look_at_every_key(spark):
    rows_ = [(a, b, dt.date(2000, 1, 1) + dt.timedelta(days=i), float(1 + (i > 9) * 5 + i % 2)) for a in "ab" for b in "uv" for i in range(20)]
    df = spark.createDataFrame(rows_, "a string, b string, d date, v double")
    def cost(spec):
        return {(r.a, r.b): round(r.cost, 6) for r in changepoint_fit(df, ["a", "b"], "d", "v", cost=spec, penalty=5.0).collect()}
    normal, poisson = cost("normal_meanvar"), cost("poisson_meanvar")
    mixed = cost({"v": "poisson_meanvar", "a|u": "poisson_meanvar", "*": "normal_meanvar"})
    assert mixed == {k: (poisson if k[1] == "v" or k == ("a", "u") else normal)[k] for k in normal}


def test_segment_stats_of_every_cost(spark):
    df = _frame(spark)
    y = np.array([r.v for r in df.filter("k = 'A'").orderBy("d").collect()])
    for cost in ("normal_meanvar", "normal_var", "poisson_meanvar"):
        st = segment_stats(df, None, ["k"], "d", "v", cost=cost, penalty=3.0).filter("k = 'A'").orderBy("segment").collect()
        at = 0
        for r in st:
            seg = y[at:at + r.n]
            assert abs(r.cost - float(segment_cost(cost, len(seg), seg.sum(), (seg ** 2).sum(), y.mean()))) < 1e-6
            at += r.n
        assert at == len(y)


def test_joint_with_one_series_is_univariate(spark):
    rng = np.random.default_rng(5)
    rows_ = []
    for g in ("a", "b", "c"):
        y = np.concatenate([rng.normal(0, 1, 15), rng.normal(4, 1, 15)])
        rows_ += [(g, dt.date(2000, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows_, "g string, d date, v double")
    uni = {r.g: (r.locs, round(r.cost, 9)) for r in changepoint_fit(df, ["g"], "d", "v").collect()}
    joint = {r.g: (r.locs, round(r.cost, 9))
             for r in changepoint_fit(df.withColumn("s", F.lit("only")), ["g"], "d", "v", series="s").collect()}
    assert uni == joint and all(len(x[0]) >= 1 for x in uni.values())


def test_toy_series_through_the_joint_call(spark):
    """The notebook's toy input: series 1..10 and 1..100 on one index."""
    rows_ = [("toy", "s10", dt.date(2000, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(1, 11)]
    rows_ += [("toy", "s100", dt.date(2000, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(1, 101)]
    df = spark.createDataFrame(rows_, "g string, s string, d date, v double")
    fit = changepoint_fit(df, ["g"], "d", "v", series="s").first()
    assert fit.n_grid == 100
    for loc in fit.locs:          # every split leaves >= 2 points of the short series on each side
        left = sum(1 for r in rows_ if r[1] == "s10" and r[2] <= loc)
        assert left >= 2 and 10 - left >= 2


def test_joint_series_of_different_rate_need_two_points_each():
    # monthly-like series and a sparse one on every third date
    y1 = np.array([0, 1, 0, 1, 0, 1, 10, 11, 10, 11, 10, 11], dtype=float)
    d1 = _days(12)
    y2 = np.array([0, 0.5, 20, 21], dtype=float)
    d2 = _days(4, step=3)
    grid, cps, _ = solve([(d1, y1), (d2, y2)], ["normal_meanvar", "normal_meanvar"], [1.0, 1.0])
    assert len(grid) == 12
    for c in cps:                          # each side of a split holds >= 2 points of each series
        assert (d2 <= grid[c - 1]).sum() >= 2 and (d2 > grid[c - 1]).sum() >= 2


def _frame(spark):
    rows = []
    for k, shift in (("A", 0), ("B", 5)):
        for i in range(40):
            v = (0.0 if i < 20 else 10.0) + shift + (i % 3) * 0.3
            rows.append((k, dt.date(2000, 1, 1) + dt.timedelta(days=i), v))
    return spark.createDataFrame(rows, "k string, d date, v double")


def test_spark_changepoints_and_segments(spark):
    df = _frame(spark)
    c = changepoints(df, ["k"], "d", "v")
    locs = {(r.k, r.loc) for r in c.collect()}
    assert locs == {("A", dt.date(2000, 1, 20)), ("B", dt.date(2000, 1, 20))}
    seg = {r.k: r for r in with_segments(df, c, ["k"], "d").filter("d = DATE'2000-01-20'").collect()}
    assert seg["A"].segment == 0
    st = segment_stats(df, c, ["k"], "d", "v").filter("k = 'A'").orderBy("segment").collect()
    assert [r.n for r in st] == [20, 20] and abs(st[1].mean - st[0].mean - 10) < 0.1
    fit = changepoint_fit(df.withColumn("g", F.lit("all")), ["g"], "d", "v", series="k").first()
    assert fit.n_cpts == 1 and fit.locs == [dt.date(2000, 1, 20)] and fit.cpt_type == "joint"


def test_fused_segments_equal_general_path(spark):
    from sitewise.operators.changepoint import attach_segment_mean, fit_segments
    df = _frame(spark)
    c = changepoints(df, ["k"], "d", "v")
    general = {(r.k, r.d): (r.segment, r.cpts) for r in attach_segment_mean(df, c, ["k"], "d", "v").collect()}
    fused = {(r.k, r.d): (r.segment, r.cpts) for r in attach_segment_mean(df, None, ["k"], "d", "v").collect()}
    assert general.keys() == fused.keys()
    assert all(general[x][0] == fused[x][0] and abs(general[x][1] - fused[x][1]) < 1e-12 for x in general)
    st = segment_stats(df, None, ["k"], "d", "v").filter("k = 'B'").orderBy("segment").collect()
    assert [r.n for r in st] == [20, 20]
    assert fit_segments(df, ["k"], "d", "v").count() == 80


def brute_joint(series, costs, betas, min_seg=2):
    """Exhaustive search over split sets of the union grid, for a joint fit."""
    grid = np.unique(np.concatenate([d for d, _ in series]))
    T_ = len(grid)
    best = (math.inf, None)
    for m in range(T_):
        for cps in itertools.combinations(range(1, T_), m):
            b = (0,) + cps + (T_,)
            tot = sum(betas) * m
            ok = True
            for i in range(len(b) - 1):
                lo, hi = grid[b[i] - 1] if b[i] > 0 else None, grid[b[i + 1] - 1]
                for (d, y), c in zip(series, costs):
                    sel = (d <= hi) & ((d > lo) if lo is not None else True)
                    if sel.sum() < min_seg:
                        ok = False
                        break
                    seg = y[sel]
                    tot += float(segment_cost(c, len(seg), seg.sum(), (seg ** 2).sum(), y.mean()))
                if not ok:
                    break
            if ok and tot < best[0] - 1e-9:
                best = (tot, list(cps))
    return best


def test_joint_daily_and_sparse_series_equal_exhaustive_search():
    rng = np.random.default_rng(9)
    d1 = _days(13)                                   # daily
    y1 = np.concatenate([rng.normal(0, 1, 7), rng.normal(5, 1, 6)])
    d2 = _days(5, step=3)                            # every third day
    y2 = np.array([1.0, 1.2, 8.0, 8.5, 8.1])
    for beta in (0.5, 2.0, 6.0):
        grid, cps, total = solve([(d1, y1), (d2, y2)], ["normal_meanvar", "poisson_meanvar"], [beta, beta])
        b_total, b_cps = brute_joint([(d1, y1), (d2, y2)], ["normal_meanvar", "poisson_meanvar"], [beta, beta])
        assert abs(total - b_total) < 1e-6 and cps == b_cps


def test_side_by_side_equals_alone():
    """Series of several lengths, costs and scales, constant ones and ones
    with repeated dates among them: the same fits to the last bit."""
    from sitewise.operators.changepoint import solve_all
    rng = np.random.default_rng(31)
    names = ("normal_meanvar", "normal_var", "poisson_meanvar")
    for min_seg in (1, 2, 5):
        dates, values, costs, betas = [], [], [], []
        for i in range(400):
            n = int(rng.integers(1, 60)) if i % 50 else 300
            d = np.sort(rng.choice(900, n, replace=i % 17 == 0)).astype(np.int64)
            y = rng.integers(0, rng.choice([1, 3, 9]) + 1, n) * rng.choice([1e-5, 1e-4, 0.3, 40.0]) + (rng.random(n) if i % 3 else 0)
            dates.append(d), values.append(y), costs.append(names[i % 3]), betas.append(float(rng.choice([0.1, 2.0, 9.0])))
        for got, d, y, c, b in zip(solve_all(dates, values, costs, betas, min_seg), dates, values, costs, betas):
            grid, cps, total = solve([(d, y)], [c], [b], min_seg)
            assert list(got[0]) == list(grid) and got[1:] == (cps, total), (c, b, min_seg, len(d))


def test_univariate_fits_run_in_batches(spark):
    """Many groups per call of Python, and one evaluation for all its uses."""
    plan = changepoints(_frame(spark), ["k"], "d", "v")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "FlatMapGroupsInPandas" not in plan


def test_sparse_series_cost_their_own_dates(monkeypatch):
    """Monthly series beside a daily one: the cost of their segments is worked
    out between their own dates only, and the fit is that of the plain
    program."""
    from sitewise.operators import changepoint as module
    rng = np.random.default_rng(17)
    group = _random_group(rng, [1] + [30] * 40, 600)
    group[1:] = [(np.sort(d[keep]), y[keep]) for d, y in group[1:] for keep in [rng.permutation(len(d))[:int(rng.integers(9, len(d)))]]]
    costs, betas = ["normal_meanvar"] + ["poisson_meanvar"] * 20 + ["normal_var"] * 20, [0.2] * 41
    cells, plain = [], module.segment_cost
    monkeypatch.setattr(module, "segment_cost", lambda c, n, *a: (cells.append(np.size(n)), plain(c, n, *a))[1])
    leaves = sorted(int(x) for x in rng.integers(0, 64, 41))
    grid, cps, total = solve(group, costs, betas, 2, leaves)
    assert sum(cells) < 600 * 600 / 2 + 41 * 22 * 22  # of 41 times as many
    monkeypatch.undo()
    want, cost = full_program(group, costs, betas)
    assert cps == want and cps and abs(total - cost) < 1e-6
