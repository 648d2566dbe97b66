"""Site pipeline for any number of sites at once.

extraction -> missing days of all species -> taxon filter -> daily total
and species number -> daily grid with catches shared over short gaps ->
monthly totals -> every month present (0 when missing) -> classical
decomposition -> standardised deseasoned series.

One plan keyed by site replaces a loop that re-read the file per site; all
windows are partitioned by the site keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.functions._util import as_list
from sitewise.operators.calendar import complete_days, complete_months
from sitewise.operators.counts import daily_facts, monthly_totals
from sitewise.operators.enrich import enrich
from sitewise.operators.filters import between_dates, taxa_predicate
from sitewise.operators.gaps import share_over_gaps
from sitewise.operators.season import classical_decompose, standardise
from sitewise.session import cut_lineage


def site_daily(clean: DataFrame, keys=("SITECODE",), taxa=None, groups: DataFrame | None = None,
               traits: DataFrame | None = None, lo=None, hi=None, avg_missing_data: bool = True,
               max_gap: int = 3, zero_fill: bool = True, deal: bool = False) -> DataFrame:
    """Daily grid per key: total and species number of the taxon, with the
    catch shared over short unsampled runs (C6-C10 composed): keys, DATE,
    counts, duration (null if nothing is shared) and n_species (null on days
    without the taxon).

    Unsampled days are found from all species; the taxon only selects what
    is counted.  Both come from one aggregate per key and day
    (``daily_facts``), and the sharing is one chain of windows over it
    (``share_over_gaps``): the observations are scanned once and the plan
    has one shuffle for the aggregate and one for the key windows (``deal``:
    over all shuffle partitions).
    """
    ks = as_list(keys)
    df = between_dates(clean, "DATE", lo, hi)
    pred = None
    if taxa is not None:
        df = enrich(df, groups, traits)
        pred = taxa_predicate(taxa)
    facts = daily_facts(df, ks, "DATE", taxon=pred)
    counts = facts.filter(F.col("has_taxon")).select(*ks, "DATE", "counts", "n_species")
    if not avg_missing_data:
        return complete_days(counts, ks, "DATE").withColumn("duration", F.lit(None).cast("long"))
    facts = facts.withColumn("n_species", F.when(F.col("has_taxon"), F.col("n_species")))
    return share_over_gaps(facts, ks, "DATE", "counts", max_gap=max_gap, zero_fill=zero_fill, carry=["n_species"],
                           deal=deal)


def multi_site(clean: DataFrame, keys=("SITECODE",), checkpoint_daily: bool = False, **kw) -> DataFrame:
    """``checkpoint_daily`` writes the daily grid (the costly part) under the
    session's checkpoint folder, so the monthly steps restart from it."""
    ks = as_list(keys)
    daily = site_daily(clean, ks, **kw)
    if checkpoint_daily:
        daily = cut_lineage(daily)
    monthly = monthly_totals(daily, ks, "DATE", "counts", out_idx="DATETIME").drop("NA_per_mo")
    monthly = complete_months(monthly, ks, "DATETIME", fill={"counts": 0})
    dec = classical_decompose(monthly, ks, "DATETIME", "counts")
    return standardise(dec, ks, "DATETIME", "decomp_deseason")
