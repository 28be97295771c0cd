"""Gapless global row numbers without a window over one partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelake.llm._session import checkpoint

_PART, _TIE = "_rn_part", "_rn_tie"


def with_row_number(df: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """Adds a long column ``name`` (0, 1, ... in the order of ``order``) and returns the row count too.

    Rows are range partitioned by ``order``; a seeded random last key also splits a run of equal rows, so a
    hot key never fills one task. Rows equal in ``order`` get consecutive numbers in no defined order.
    The numbered rows are checkpointed: the bounds of a range partitioning are sampled, and a second
    evaluation could place rows otherwise. Give only the columns that are needed.
    """
    spread = df.withColumn(_TIE, F.rand(7))
    spread = spread.repartitionByRange(*[F.col(c) for c in order], F.col(_TIE)).sortWithinPartitions(*order, _TIE)
    # monotonically_increasing_id is (partition << 33) + row in the partition
    marked = checkpoint(spread.drop(_TIE).withColumn(name, F.monotonically_increasing_id()))
    marked = marked.withColumn(_PART, F.shiftright(name, 33))
    sizes = marked.groupBy(_PART).agg(F.count("*").alias("_rn_n"))
    # one row per partition, whatever the data's size
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = checkpoint(sizes.withColumn("_rn_before", F.coalesce(F.sum("_rn_n").over(before), F.lit(0))))
    total = offsets.agg(F.sum("_rn_n")).first()[0] or 0
    mask = F.lit((1 << 33) - 1)
    out = marked.join(F.broadcast(offsets.drop("_rn_n")), _PART)
    return out.withColumn(name, F.col(name).bitwiseAND(mask) + F.col("_rn_before")).drop(_PART, "_rn_before"), total
