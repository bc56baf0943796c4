"""Numbers in an order, for groups of any size and keys of any type.

Rows are dealt by sampled ranges of (group, order), so a group of any size lies
in as many partitions as it fills, and equal keys don't pile up: a tie is
parted by the row it was read as. The dealt rows are written once; a row's
number is its seat in its partition and an offset from a table that has a row
for each group and partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.sources.staging import staged

PART, SEAT = "part_", "seat_"
_BITS = 33


def ranged(rows: DataFrame, keys: list[Column | str], label: str = "ranged", parts: int | None = None, apart: bool = True) -> DataFrame:
    """``rows``, written in the order of ``keys``, with the partition each lies in, ``part_``, and its seat there, ``seat_``, both from 0.

    With ``apart`` rows of equal keys may lie in several partitions; without,
    they stay together.
    """
    tie = [F.monotonically_increasing_id()] if apart else []
    named = rows.withColumns({f"tie_{i}": t for i, t in enumerate(tie)})
    order = [F.col(k) if isinstance(k, str) else k for k in keys] + [F.col(f"tie_{i}") for i in range(len(tie))]
    dealt = named.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order)
    seated = dealt.withColumn("at_", F.monotonically_increasing_id())
    low = F.col("at_").bitwiseAND(F.lit((1 << _BITS) - 1))
    return staged(seated.select(*rows.columns, F.shiftright("at_", _BITS).alias(PART), low.alias(SEAT)), label)


def numbered(rows: DataFrame, by: list[str], order: list[Column | str], name: str = "place", mass: str | None = None, label: str = "numbered", parts: int | None = None) -> DataFrame:
    """``rows`` with ``name``: their number, from 0, in ``order`` within ``by``.

    With ``mass``, a column of whole numbers, ``name`` is the sum of that column
    over the rows before instead. Null groups and null keys are values like
    others; rows that are equal in ``order`` get numbers in any order. An empty
    table stays empty. ``rows`` is read twice, once to sample the ranges.
    """
    held = ranged(rows, [*by, *order], label, parts)
    size = F.count("*") if mass is None else F.sum(mass)
    heads = held.groupBy(*by, PART).agg(F.min(SEAT).alias("first_"), size.alias("size_"))
    earlier = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    # a row for each group and partition: its rows' offset
    offsets = heads.select(*[F.col(c).alias(f"of_{i}") for i, c in enumerate(by)], F.col(PART).alias("of_part"), "first_", F.coalesce(F.sum("size_").over(earlier), F.lit(0)).alias("before_"))
    same = held[PART] == offsets["of_part"]
    for i, c in enumerate(by):
        same = same & held[c].eqNullSafe(offsets[f"of_{i}"])
    joined = held.join(offsets, same)
    if mass is None:
        number = F.col("before_") + F.col(SEAT) - F.col("first_")
    else:
        inside = Window.partitionBy(*by, PART).orderBy(SEAT).rowsBetween(Window.unboundedPreceding, -1)
        number = F.col("before_") + F.coalesce(F.sum(mass).over(inside), F.lit(0))
    return joined.select(*rows.columns, number.cast("long").alias(name))
