"""Small helpers on whole DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

#: monotonically_increasing_id keeps the partition above these bits.
_PART = 33


def attach(df: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    """``df`` with the columns of the one row that ``rows`` has for its group.

    Without groups the single row is a scalar subquery.  With groups it is an
    equality join whose right side has one row per group: adaptive execution
    broadcasts it if its measured size allows and else splits hot groups.
    """
    if by:
        return df.join(rows, by)
    added = rows.columns
    return df.withColumn("_row", rows.select(F.struct(*added)).scalar()).select(
        *[F.col(f"`{c}`") for c in df.columns], *[F.col("_row")[c].alias(c) for c in added]
    )


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by its keys over a few tasks for each core, for work that costs far more than a shuffle.

    A table in one file of few row groups is read by as many tasks, however
    many cores there are; the count is fixed, as the rows are small where the
    work on them is not.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)


def ranked(rows: DataFrame, by: list[str], order: list[Column | str], label: str = "ranked") -> DataFrame:
    """``rows`` with ``at`` (a unique id in the order of ``by``, then ``order``) and ``rank`` (from 0 within ``by``).

    The table is sorted over the cluster and written once.  Each partition's
    rows of a group keep their order, so a rank is the place in the partition
    plus what earlier partitions hold of the group: one number for each group
    and partition, no group is gathered.  Nulls of ``by`` are a group.
    """
    sorted_rows = materialize(rows.orderBy(*by, *order).withColumn("at", F.monotonically_increasing_id()), label)
    part = F.shiftright("at", _PART)
    runs = sorted_rows.groupBy(*by, part.alias("_part")).agg(F.min("at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift")
    runs = runs.select(*[F.col(c).alias(f"_by_{c}") for c in by], "_part", shift)
    same = part == F.col("_part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return sorted_rows.join(runs, same).select(*sorted_rows.columns, (F.col("at") + F.col("_shift")).alias("rank"))
