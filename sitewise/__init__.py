"""sitewise: keyed environmental time series on Spark.

Irregular field observations (counts by site, trap, date and species), daily
weather and sparse annual or fortnightly series are turned into regular,
comparable series for any number of sites at once.  Every public function
takes and returns a lazy ``DataFrame`` and is partitioned by series key.
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Functions of this package run inside grouped pandas calls on the
    executors.  Pickle them by value, so executors need no installed copy of
    the package (a cluster may still ship it with --py-files)."""
    import sys

    try:
        from pyspark import cloudpickle
    except ImportError:  # pragma: no cover - pyspark is a dependency
        return
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()

