"""Operators for training-data pipelines: one module per operator, the
registered queries in ``catalog.py``.  Nothing else in the library imports
this subpackage."""
