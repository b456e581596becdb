"""Operators for training-data pipelines over ``documents``-shaped tables.

Nothing outside this subpackage imports it; ``queries.py`` names the queries
that the driver entry adds when the subpackage is present.
"""
