"""As-of join: each left row gets the latest right row of its key at or before (or before) its time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    on: str,
    take: list[str],
    *,
    inclusive: bool = True,
    slice_seconds: int = 3_600,
) -> DataFrame:
    """Left join on `by` to the right row with the greatest `on` <= left `on` (< if not `inclusive`).

    `on` is a timestamp in both; the `take` columns of the right row (NULL without a match) are
    added under their names, `on` as right_<on>. Ties on the right are settled by the greatest
    `take` values. A key's rows are sorted per time slice, never as a whole, so a hot key spreads
    over many tasks; what reaches over a slice's edge is the one last right row before it.
    """
    slot = F.floor(F.unix_seconds(F.col(on).cast("timestamp")) / slice_seconds)
    key = [*by, "__slot"]
    lefts = left.select(
        *by,
        slot.alias("__slot"),
        F.col(on).alias("__t"),
        F.lit(0 if not inclusive else 1).alias("__order"),
        F.struct(*left.columns).alias("__left"),
        F.lit(None).cast(_right_type(right, on, take)).alias("__right"),
    )
    rights = right.select(
        *by,
        slot.alias("__slot"),
        F.col(on).alias("__t"),
        F.lit(1 if not inclusive else 0).alias("__order"),
        F.lit(None).cast(lefts.schema["__left"].dataType).alias("__left"),
        F.struct(F.col(on).alias("__t"), *take).alias("__right"),
    )
    for column in ("__t", *by):  # NULL keys and times match nothing
        rights = rights.where(F.col(column).isNotNull())

    merged = lefts.unionByName(rights)
    # Within a slice: running last right row.
    inside = Window.partitionBy(*key).orderBy("__t", "__order", "__right")
    rows = (
        merged.withColumn(
            "__near",
            F.last("__right", ignorenulls=True).over(
                inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ),
        )
        .where("__left IS NOT NULL")
    )
    # Over slices: the last right row of each earlier slice, one row per key and slice.
    closing = merged.groupBy(*key).agg(F.max("__right").alias("__close"))
    across = Window.partitionBy(*by).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    opening = closing.select(*key, F.last("__close", ignorenulls=True).over(across).alias("__before"))

    found = F.coalesce("__near", "__before")
    return rows.join(opening, key, "left").select(
        "__left.*",
        found["__t"].alias(f"right_{on}"),
        *[found[c].alias(c) for c in take],
    )


def _right_type(right: DataFrame, on: str, take: list[str]):
    return right.select(F.struct(F.col(on).alias("__t"), *take).alias("r")).schema["r"].dataType
