"""Comparison of a query's rows with those of its SQL twin."""

from __future__ import annotations


def same(got, want) -> None:
    """Equal rows in any order, floats to nine digits."""
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    text = lambda d: d[columns].map(lambda v: round(v, 9) if isinstance(v, float) else v).astype(str).sort_values(columns).reset_index(drop=True)
    a, b = text(got), text(want)
    assert len(a) == len(b)
    assert (a.values == b.values).all()
