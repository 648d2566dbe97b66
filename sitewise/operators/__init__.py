"""Series operators.  Every window is partitioned by the series keys."""
