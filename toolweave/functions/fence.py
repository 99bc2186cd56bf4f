"""Evaluate-once boundary for chains of heavy projections.

Catalyst substitutes an alias by its expression when it pushes a filter below a projection.
With field bags built from a dozen higher-order functions, and each used several times by
the next step, that substitution grows with every step.  The columns of a one-row ``inline``
generator cannot be substituted, so a filter on them stays above while filters on the
carried columns (file, date, tool) are still pushed to the scan.  The generator is narrow: it adds
no shuffle and no row. Where its input holds higher-order functions Spark interprets them, so fence
once per stage, not per column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fence(df: DataFrame, computed: dict[str, Column], drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the computed columns added or replaced, each evaluated exactly once."""
    carried = [F.col(c) for c in df.columns if c not in computed and c not in drop]
    row = F.struct(*[c.alias(n) for n, c in computed.items()])
    return df.select(*carried, F.inline(F.array(row)))
