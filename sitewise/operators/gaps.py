"""Unsampled days and sharing of catches over them.

A trap that is not emptied for some days holds the catch of all of them.
``missing_days`` finds those days, ``missing_runs`` groups them into runs
(gaps and islands), and ``spread_over_gaps`` shares the catch of the next
emptying over the run.  ``share_over_gaps`` does the same from one per-day
aggregate in a single chain of windows (what the site pipeline uses).  All
windows are partitioned by the series keys.

Sorts and windows hold one row per recorded day: a stretch of unsampled days
is its first and last day until the result, where it is turned into days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.functions._util import as_list, col
from sitewise.operators._window import after, ahead, by_key, dealt, running
from sitewise.operators.calendar import gap_fill
from sitewise.operators.filters import between_dates


def missing_days(df: DataFrame, keys, idx: str = "DATE", v: str = "VALUE",
                 lo=None, hi=None, spans: bool = False, deal: bool = False) -> DataFrame:
    """Days between a key's first and last record with no record, or with a
    null value in any record of that day (C6).  One row per key and day.

    Raw rows are first reduced to one row per key and day (partial
    aggregation before the shuffle).  Such a day, if it has a null value, and
    the days up to the next one are a stretch; with ``spans`` the stretches
    themselves are returned, as ``_first`` and ``_last`` day beside the
    recorded day they belong to (for ``missing_runs``).  ``deal``: see
    ``share_over_gaps``.
    """
    ks = as_list(keys)
    day = (between_dates(df, idx, lo, hi).groupBy(*ks, idx)
           .agg(F.bool_or(col(v).isNull()).alias("_anynull")))
    before_next = F.coalesce(F.date_sub(F.lead(idx).over(by_key(ks, idx)), 1), col(idx))
    s = (dealt(day, ks) if deal else day).withColumn("_last", before_next).filter(F.col("_anynull") | (F.col("_last") > col(idx)))
    s = s.select(*ks, idx, F.when(F.col("_anynull"), col(idx)).otherwise(F.date_add(idx, 1)).alias("_first"), "_last")
    return s if spans else s.select(*ks, F.explode(_days("_first", "_last")).alias(idx))


def _days(first: str, last: str):
    """The days of a stretch as an array; one null for a stretch without dates."""
    return F.coalesce(F.sequence(first, last, F.expr("INTERVAL 1 DAY")), F.array(F.col(first)))


def missing_runs(miss: DataFrame, keys, idx: str = "DATE", spans: bool = False, days: bool = True) -> DataFrame:
    """Group consecutive missing days into runs (C7): ``seq_id`` counts runs
    from 1 within a key; each day carries its run's first and last day,
    length, and the days left to the next measurement.

    ``spans``: ``miss`` holds stretches (``missing_days`` with ``spans``), not
    days.  ``days=False`` returns one row per run, without the columns of a
    day."""
    ks = as_list(keys)
    if not spans:
        miss = miss.withColumns({"_first": col(idx), "_last": col(idx)})
    w = by_key(ks, idx)
    step = F.datediff("_first", F.lag("_last").over(w))
    runs = miss.withColumn("_brk", F.when(step == 1, 0).otherwise(1))
    runs = runs.withColumns({
        "seq_id": F.sum("_brk").over(running(ks, idx)).cast("long"),
        "STARTDATE": F.last(F.when(F.col("_brk") == 1, F.col("_first")), ignorenulls=True).over(running(ks, idx)),
        "_end": F.coalesce(F.lead("_brk").over(w), F.lit(1)) == 1,
    })
    # the last stretch of a run ends it
    runs = runs.filter("_end").select(
        *ks, "seq_id", "STARTDATE", F.col("_last").alias("ENDDATE"),
        F.coalesce(F.datediff("_last", "STARTDATE") + 1, F.lit(1)).cast("long").alias("duration"))
    if not days:
        return runs
    return (runs.select(*ks, F.explode(_days("STARTDATE", "ENDDATE")).alias(idx), "seq_id", "STARTDATE", "ENDDATE", "duration")
            .withColumn("next_meas", F.datediff("ENDDATE", col(idx)) + 1))


def top_missing_runs(runs: DataFrame, keys, n: int = 10, days: bool = True) -> DataFrame:
    """The ``n`` longest runs of each key, longest first, earlier first on a
    tie (C8).  ``days``: ``runs`` has a row per day, not one per run."""
    ks = as_list(keys)
    r = runs.select(*ks, "seq_id", "STARTDATE", "ENDDATE", "duration")
    if days:
        r = r.dropDuplicates(ks + ["seq_id"])
    w = by_key(ks).orderBy(F.desc("duration"), F.asc("seq_id"))
    return r.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def spread_over_gaps(counts: DataFrame, runs: DataFrame, keys, idx: str = "DATE",
                     v: str = "counts", lo=None, hi=None, max_gap: int = 3,
                     zero_fill: bool = True, null_after_long_gap: bool = True,
                     runs_idx: str = "DATE") -> DataFrame:
    """Daily grid of a key with the catch shared over short gaps.

    ``counts``: one row per key and sampled day; ``runs``: output of
    ``missing_runs``.  The grid runs from the key's first to last counted
    day inside [lo, hi].  Then, from the columns of one frame:

    1. a day in a run of length d <= ``max_gap``, and the day that ends it,
       get the next count / (d + 1), so the run plus its next day keep the
       total;
    2. days of longer runs stay null; with ``null_after_long_gap`` the day
       after a long run is null too (it is the day after a run end);
    3. with ``zero_fill``, a sampled day (not in a run) without a count is 0
       rather than taking the next day's count.

    The grid, the run facts and the run ends are unioned and merged per key
    and day with window functions, all under one hash partitioning by the
    keys: no join on (key, day), so no reshuffle between the steps.
    """
    ks = as_list(keys)
    grid = gap_fill(between_dates(counts.select(*ks, idx, v), idx, lo, hi), ks, idx, "day")
    grid = grid.withColumn("_g", F.lit(True))
    facts = runs.select(*ks, F.col(runs_idx).alias(idx), "duration")
    ends = (runs.filter(F.col(runs_idx) == F.col("ENDDATE"))
            .select(*ks, F.date_add(runs_idx, 1).alias(idx), F.col("duration").alias("_prev_dur")))
    u = dealt(grid.unionByName(facts, allowMissingColumns=True)
              .unionByName(ends, allowMissingColumns=True), ks)
    wd = by_key(ks + [idx])
    u = (u.withColumns({c: F.first(c, ignorenulls=True).over(wd) for c in ("duration", "_prev_dur")})
         .filter(F.col("_g").isNotNull()))
    x = col(v)
    if zero_fill:
        x = F.when(x.isNull() & F.col("duration").isNull(), F.lit(0)).otherwise(x)
    dur = F.coalesce(F.col("duration"), F.lit(0))
    filled = F.last(x, ignorenulls=True).over(ahead(ks, idx))
    shared = F.when(dur <= max_gap, filled / (dur + 1))
    after = F.col("_prev_dur").isNotNull()
    if not null_after_long_gap:
        after = after & (F.col("_prev_dur") <= max_gap)
    w = by_key(ks, idx)
    return (u.withColumn("_shared", shared)
            .withColumn(v, F.when(after, F.lag("_shared").over(w)).otherwise(F.col("_shared")))
            .withColumn("duration", dur)
            .drop("_shared", "_prev_dur", "_g"))


def share_over_gaps(facts: DataFrame, keys, idx: str = "DATE", v: str = "counts",
                    anynull: str = "_anynull", has: str = "has_taxon", max_gap: int = 3,
                    zero_fill: bool = True, null_after_long_gap: bool = True, carry=(),
                    deal: bool = False) -> DataFrame:
    """``spread_over_gaps`` in one chain of windows over a per-day aggregate
    (``counts.daily_facts``), with the same rules.

    Unsampled days (absent, or with a null value) form runs.  The aggregate
    is not filled up to every day for that: each of its rows stands for its
    own day and the unsampled days up to the next row, which all have one run
    and one share.  Run lengths come from running counts of unsampled days,
    at a run's start and at the next one's; the taxon's first and last day
    (the grid) and the shared catch are columns of the same frame, under one
    sort forwards and one backwards, and the days are written out at the end.
    Nothing is joined or unioned, so the plan keeps one hash partitioning by
    the keys from the aggregate to the result.  ``carry``: columns of the
    aggregate to keep as they are (null on days it does not have).  ``deal``:
    many series of rows that are not stored by their keys are dealt to all
    shuffle partitions, so a task sorts few of them.
    """
    ks = as_list(keys)
    w, back, on, on_next = by_key(ks, idx), running(ks, idx), ahead(ks, idx), after(ks, idx)
    seen, own = F.col("_seen"), F.col("_own")
    g = facts.select(*ks, idx, *carry, F.coalesce(F.col(has), F.lit(False)).alias("_seen"),
                     F.coalesce(F.col(anynull), F.lit(False)).alias("_own"), F.col(v).alias("_x"))
    if deal:
        g = dealt(g, ks)
    x = F.when(seen, F.col("_x"))
    if zero_fill:
        x = F.when(x.isNull() & ~own, F.lit(0.0)).otherwise(x)
    # _gap: days to the next row; _n: unsampled days the row stands for
    g = g.withColumns({"_x": x, "_next": F.lead(idx).over(w)})
    g = g.withColumn("_gap", F.coalesce(F.greatest(F.datediff("_next", F.col(idx)) - 1, F.lit(0)), F.lit(0)))
    g = g.withColumn("_n", F.col("_gap") + own.cast("int"))
    g = g.withColumns({"_before": F.coalesce(F.lag(F.col("_n") > 0).over(w), F.lit(False)),
                       "_cum": F.sum("_n").over(back)})
    # unsampled days before the run that starts in the row
    start = F.when((F.col("_n") > 0) & ~(own & F.col("_before")), F.col("_cum") - F.col("_n"))
    g = g.withColumn("_start", start)
    g = g.withColumn("_base", F.last("_start", ignorenulls=True).over(back))
    wk = by_key(ks)
    upto = F.coalesce(F.last("_start", ignorenulls=True).over(on_next), F.first("_cum").over(on))
    g = g.withColumns({
        "_dur": F.when(F.col("_n") > 0, upto - F.col("_base")),
        "_fill": F.last("_x", ignorenulls=True).over(on),
        "_fill_next": F.last("_x", ignorenulls=True).over(on_next),
        "_lo": F.min(F.when(seen, F.col(idx))).over(wk),
        "_hi": F.max(F.when(seen, F.col(idx))).over(wk),
    })
    # the row before, in the backward order
    prev = by_key(ks).orderBy(F.col(idx).desc())
    g = g.withColumns({f"_prev{c}": F.lead(c).over(prev) for c in ("_dur", "_gap", "_x")})
    own_dur = F.when(own, F.col("_dur")).otherwise(F.lit(0))

    def share(catch, dur):
        return F.when(dur <= max_gap, catch / (dur + 1))

    day_before = F.when(F.col("_prev_gap") > 0, F.col("_fill")).otherwise(F.coalesce("_prev_x", "_fill"))
    ends_run = F.col("_prev_dur").isNotNull() & ~own
    if not null_after_long_gap:
        ends_run = ends_run & (F.col("_prev_dur") <= max_gap)
    here = F.when(ends_run, F.when(F.col(idx) > F.col("_lo"), share(day_before, F.col("_prev_dur")))).otherwise(
        share(F.col("_fill"), own_dur))
    g = g.select(*ks, idx, "_next", "_gap", "_lo", "_hi", "_dur", here.alias("_here"), own_dur.alias("_own_dur"),
                 share(F.col("_fill_next"), F.col("_dur")).alias("_there"), *carry)
    days = F.when(F.col("_gap") > 0, F.sequence(F.col(idx), F.date_sub("_next", 1), F.expr("INTERVAL 1 DAY")))
    first = F.col("_pos") == 0
    return (g.select("*", F.posexplode(F.coalesce(days, F.array(F.col(idx)))).alias("_pos", "_day"))
            .filter(F.col("_day").between(F.col("_lo"), F.col("_hi")))
            .select(*ks, F.col("_day").alias(idx), F.when(first, F.col("_here")).otherwise(F.col("_there")).alias(v),
                    F.when(first, F.col("_own_dur")).otherwise(F.col("_dur")).alias("duration"),
                    *[F.when(first, F.col(c)).alias(c) for c in carry]))
