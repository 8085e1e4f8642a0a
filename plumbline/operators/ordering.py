"""Ranks and running sums along a total order, without a window over all rows.

The rows are dealt by range of the order, and stored with the number of their
range.  Ranks and sums run within each range; what the ranges before it hold, a
row a range, is added.  Rows that are equal in every order column stay together,
so the order should end with a key.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.scratch import materialise


def along(df: DataFrame, order: Sequence[Column], place: str | None = None, start: int = 1, **sums: Column) -> DataFrame:
    """``df`` with ``place``, the rank in ``order`` counted from ``start``, and
    for each ``name=column`` of ``sums`` the running sum of a whole-number column
    up to and with the row, nulls counting as 0.  An empty table stays empty."""
    part, below = "__range", "__below_"
    stored = materialise(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    whole = [F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(name) for name, c in sums.items()]
    held = stored.groupBy(part).agg(F.count("*").alias("rows"), *whole).collect()  # a row a range
    held = sorted(held, key=lambda r: r[part])
    names = ["rows", *sums]
    before = {n: [0, *accumulate(r[n] for r in held)] for n in names}
    offsets = [(r[part], *(before[n][i] for n in names)) for i, r in enumerate(held)]
    schema = f"{part} int, " + ", ".join(f"`{below}{n}` long" for n in names)
    known = F.broadcast(df.sparkSession.createDataFrame(offsets, schema))  # a row a range
    here = Window.partitionBy(part).orderBy(*order)
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    new = {name: F.sum(F.coalesce(c, F.lit(0))).over(upto).cast("long") + F.col(f"{below}{name}") for name, c in sums.items()}
    if place:
        new[place] = F.row_number().over(here) + F.col(f"{below}rows") + (start - 1)
    return stored.join(known, part).withColumns(new).drop(part, *[f"{below}{n}" for n in names])
