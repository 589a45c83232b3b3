"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; `queries` registers one query for
each operator and `__spark_entry__` adds them when the subpackage is there.
"""
