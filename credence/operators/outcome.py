"""What every check produces: one struct column with score parts, issues and positives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def outcome(issues: Column, positives: Column, **fields: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()], issues.alias("issues"), positives.alias("positives"))


def deduct(*points: Column) -> Column:
    """Sum of the deductions that apply (NULL: does not apply)."""
    total = F.lit(0)
    for p in points:
        total = total + F.coalesce(p, F.lit(0))
    return total


def fmt(template: str, *columns: Column) -> Column:
    """Template with %s places; NULL when a value is NULL."""
    pieces = template.split("%s")
    out = [F.lit(pieces[0])]
    for piece, column in zip(pieces[1:], columns):
        out += [column.cast("string"), F.lit(piece)]
    return F.concat(*out)
