"""Array<double> arithmetic as higher-order column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from winnow.functions.text import as_col


def to_double(v) -> Column:
    return F.transform(as_col(v), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    prods = F.zip_with(as_col(a), as_col(b), lambda x, y: x * y)
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(as_col(v), F.lit(0.0), lambda acc, x: acc + x * x))


def scale(v, s) -> Column:
    s = as_col(s)
    return F.transform(as_col(v), lambda x: x * s)


def with_scalar(value, body) -> Column:
    """``body(value)`` with the value computed once per row.

    A column used inside a ``transform`` lambda is evaluated for every element; as the
    variable of an outer lambda over one element it is not.
    """
    return F.get(F.transform(F.array(value), body), 0)


def l2_normalize(v, eps: float = 1e-12, mode: str = "clamp") -> Column:
    """x / max(||x||, eps) ("clamp") or x / (||x|| + eps) ("add")."""
    n = norm(v)
    denom = F.greatest(n, F.lit(eps)) if mode == "clamp" else n + F.lit(eps)
    return with_scalar(denom, lambda d: F.transform(as_col(v), lambda x: x / d))


def cosine(a, b) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def add(a, b) -> Column:
    return F.zip_with(as_col(a), as_col(b), lambda x, y: x + y)
