"""Driver queries, one per inventory item; importing this package fills
``sitewise.plans.registry``."""

from sitewise.plans.catalog import gaps, ingest, reports, season, series, station  # noqa: F401
