"""Running state along an ordered group that no single task has to hold.

``running_last`` windows over (group, block).  Only groups that span several blocks need anything carried from
one block into the next; for those a one-row-per-block summary is scanned in block order and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGES_PER_BLOCK = 4096


def page_block(page: Column, pages_per_block: int = PAGES_PER_BLOCK) -> Column:
    return F.floor(page / F.lit(pages_per_block)).cast("int")


def last_in_block(rows: DataFrame, group: list[str], block: str, order: list[str], events: dict[str, Column]) -> DataFrame:
    """Add, per event, its last non-null value at or before each row of its block."""
    within = Window.partitionBy(*group, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({name: F.last(event, ignorenulls=True).over(within) for name, event in events.items()})


def running_last(
    rows: DataFrame,
    group: list[str],
    block: str,
    order: list[str],
    events: dict[str, Column],
    long_rows: DataFrame | None = None,
) -> DataFrame:
    """Add, per event, its last non-null value at or before each row in ``order``.

    ``long_rows`` may name a cheaper plan for the rows of the groups that span more than one block.
    """
    windowed = last_in_block(rows, group, block, order, events)

    if long_rows is None:
        spanning = rows.where(F.col(block) > 0).select(*group).distinct()
        long_rows = rows.join(spanning, group, "left_semi")
    position = F.struct(*order)
    summary = long_rows.groupBy(*group, block).agg(
        *[F.max_by(event, F.when(event.isNotNull(), position)).alias(name) for name, event in events.items()])
    before = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    entry = summary.select(
        *group, block,
        *[F.last(name, ignorenulls=True).over(before).alias(f"_in_{name}") for name in events],
    ).where(F.coalesce(*[F.col(f"_in_{name}").isNotNull() | F.lit(None) for name in events], F.lit(False)))
    joined = windowed.join(entry, [*group, block], "left")
    return joined.withColumns(
        {name: F.coalesce(F.col(name), F.col(f"_in_{name}")) for name in events},
    ).drop(*[f"_in_{name}" for name in events])
