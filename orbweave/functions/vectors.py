"""Vector expressions over array<double>; no Python in the path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(c: Column) -> Column:
    """Six decimals by floor, which engines agree on where round() differs."""
    return F.floor(c * 1e6 + 0.5).cast("double") / 1e6


def doubles(c: Column) -> Column:
    return c.cast("array<double>")


def total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    # The norm is bound to a name, or each element would compute it again.
    n = F.array(F.greatest(norm(v), F.lit(1e-12)))
    return F.get(F.transform(n, lambda m: F.transform(v, lambda x: x / m)), F.lit(0))


def add(a: Column, b: Column, scale: float = 1.0) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y * F.lit(scale))


def scaled(v: Column, k: Column) -> Column:
    return F.transform(v, lambda x: x * k)


def mean_of(slots: list[Column], present: list[Column]) -> Column:
    """Mean over the slots that are present; of none, zeros."""
    n = F.greatest(sum((p.cast("double") for p in present), F.lit(0.0)), F.lit(1.0))
    kept = [F.when(p, s).otherwise(F.transform(s, lambda x: x * 0)) for s, p in zip(slots, present)]
    out = kept[0]
    for k in kept[1:]:
        out = add(out, k)
    return F.transform(out, lambda x: x / n)


def softmax_weights(logits: list[float], present: list[Column]) -> list[Column]:
    """Softmax over the present slots; uniform where none is."""
    import math

    e = [F.when(p, math.exp(v)).otherwise(0.0) for p, v in zip(present, logits)]
    s = sum(e[1:], e[0])
    return [F.when(s > 0, x / s).otherwise(1.0 / len(logits)) for x in e]
