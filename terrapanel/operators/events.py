"""Event-study timing from yearly changes of a measure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Size of a change that counts, and the window around it.
EVENT_THRESHOLD = 5.0
WINDOW = (-3, 5)
REFERENCE = -1


def event_years(df: DataFrame, entity: str, measure: str, threshold: float = EVENT_THRESHOLD) -> DataFrame:
    """First year in which an entity's yearly mean rises by at least ``threshold``.

    Rows are first reduced to one per entity and year, so the window sees a handful.
    """
    yearly = df.groupBy(entity, "year").agg(F.avg(measure).alias("_level"))
    order = W.partitionBy(entity).orderBy("year")
    # rounded, so that a rise of exactly the threshold counts whatever the order of addition
    change = F.round(F.col("_level") - F.lag("_level").over(order), 9)
    consecutive = F.col("year") - F.lag("year").over(order) == 1
    marked = yearly.withColumn("_event", consecutive & (change >= threshold))
    return marked.filter("_event").groupBy(entity).agg(F.min("year").alias("event_year"))


def event_dummies(
    df: DataFrame, entity: str, events: DataFrame, window: tuple[int, int] = WINDOW, reference: int = REFERENCE
) -> DataFrame:
    """Relative year, end points collecting everything beyond, and 0/1 columns but one."""
    low, high = window
    rel = F.least(F.greatest(F.col("year") - F.col("event_year"), F.lit(low)), F.lit(high))
    # least and greatest skip NULL, so entities without an event are set apart first
    rel = F.when(F.col("event_year").isNotNull(), rel)
    out = df.join(events, entity, "left").withColumn("relative_year", rel)
    steps = [k for k in range(low, high + 1) if k != reference]
    return out.withColumns(
        {
            f"event_{'m' if k < 0 else 'p'}{abs(k)}": F.coalesce((F.col("relative_year") == k).cast("int"), F.lit(0))
            for k in steps
        }
    )
