"""Scores, ratings and capped severities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions import fixed


def saturating(value: Column, target: float) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value / F.lit(target)))


def graded(count: Column, floor: int, full: int) -> Column:
    """Below the floor partial credit of at most .49, from there on linear from .5 to 1; four decimals."""
    partial = F.round(F.least(F.lit(0.49), count / F.lit(float(floor)) * 0.49), 4)
    return F.when(count < floor, partial).when(count >= full, 1.0).otherwise(F.round(0.5 + 0.5 * (count - floor) / float(full - floor), 4))


def readiness(words: Column, headings: Column, definition: Column, numeric: Column, comparison: Column) -> Column:
    """The weighted score in [0, 1] of a page's length, structure and evidence."""
    w = fixed.SCORE_WEIGHTS
    parts = [w["words"] * saturating(words, fixed.WORD_TARGET), w["headings"] * saturating(headings, fixed.HEADING_TARGET)]
    parts += [w[g] * graded(c, *fixed.GRADES[g]) for g, c in (("definition", definition), ("numeric", numeric), ("comparison", comparison))]
    return F.round(sum(parts[1:], parts[0]), 4)


def rating(score: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, least in fixed.RATINGS:
        out = out.when(score >= least, name)
    return out.otherwise("very_weak")


def rank(value: Column, order: tuple[str, ...]) -> Column:
    """Position in an order; what isn't in it comes last."""
    out = F.when(F.lit(False), F.lit(0))
    for i, name in enumerate(order):
        out = out.when(value == name, F.lit(i))
    return out.otherwise(F.lit(len(order)))


def capped(severity: Column, level: Column) -> Column:
    """The severity, no graver than its claim level allows; info for level 4 and unknown levels."""
    ceiling = F.when(F.lit(False), "")
    for n, name in fixed.CEILINGS.items():
        ceiling = ceiling.when(level == n, name)
    ceiling = ceiling.otherwise("info")
    worse = rank(severity, fixed.SEVERITIES) < rank(ceiling, fixed.SEVERITIES)
    return F.when(worse, ceiling).otherwise(severity)
