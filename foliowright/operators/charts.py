"""Frames behind charts: complete grids in a fixed order, intervals around zero, stacked parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

MOST = 200  # rows or columns of a chart


def axis(df: DataFrame, column: str, given: list | None = None) -> list:
    """The values along an axis: those given, in their order, else what the column holds, sorted, null last; at most MOST."""
    if given is None:
        found = df.select(column).distinct().orderBy(F.col(column).asc_nulls_last()).limit(MOST + 1).collect()
        given = [r[0] for r in found]
    if len(given) > MOST:
        raise ValueError(f"more than {MOST} values of {column} make no chart")
    return given


def grid(df: DataFrame, row: str, column: str, value: Column, rows: list | None = None, columns: list | None = None) -> DataFrame:
    """row_at, column_at, row, column, value of every cell, 0 where nothing stands: grouped bars, a heat map's cells.

    ``value`` is an aggregate. Values outside the axes are left out.
    """
    rows, columns = axis(df, row, rows), axis(df, column, columns)
    listed = lambda values, c: F.array(*[F.struct(F.lit(i).alias("at"), F.lit(x).cast(df.schema[c].dataType).alias("x")) for i, x in enumerate(values)])
    cells = df.sparkSession.range(1).select(F.explode(listed(rows, row)).alias("r")).select("r", F.explode(listed(columns, column)).alias("c")) if rows and columns else None
    if cells is None:
        return df.limit(0).groupBy(F.lit(0).alias("row_at"), F.lit(0).alias("column_at"), F.col(row).alias("row"), F.col(column).alias("column")).agg(value.cast("double").alias("value"))
    made = df.groupBy(F.col(row).alias("__r"), F.col(column).alias("__c")).agg(value.cast("double").alias("__v"))
    joined = cells.join(made, F.col("r.x").eqNullSafe(F.col("__r")) & F.col("c.x").eqNullSafe(F.col("__c")), "left")
    return joined.select(F.col("r.at").alias("row_at"), F.col("c.at").alias("column_at"), F.col("r.x").alias("row"), F.col("c.x").alias("column"), F.coalesce("__v", F.lit(0.0)).alias("value"))


def heat_map(df: DataFrame, row: str, column: str, value: Column, rows: list | None = None, columns: list | None = None) -> DataFrame:
    """row_at, row and a column for each value of the second axis, in its order; cells without rows are 0. A null value's column is named null."""
    names = ["null" if x is None else str(x) for x in axis(df, column, columns)]
    g = grid(df, row, column, value, rows, columns)
    cells = [F.max(F.when(F.col("column_at") == i, F.col("value"))).alias(n) for i, n in enumerate(names)]
    return g.groupBy("row_at", "row").agg(*cells) if cells else g.select("row_at", "row").distinct()


def stacked(df: DataFrame, category: str, series: str, value: Column, categories: list | None = None, all_series: list | None = None) -> DataFrame:
    """The cells of a grid with low and high: where each series' part of a category's bar begins and ends, and its share."""
    g = grid(df, category, series, value, categories, all_series)
    bar = W.Window.partitionBy("row_at")  # at most MOST rows
    high = F.sum("value").over(bar.orderBy("column_at"))
    total = F.sum("value").over(bar)
    return g.select("*", (high - F.col("value")).alias("low"), high.alias("high"), F.when(total != 0, F.col("value") / total).otherwise(0.0).alias("share"))


def forest(df: DataFrame, label: str, value: str, low: str, high: str) -> DataFrame:
    """at, label, value, low, high, side: estimates with intervals, the largest first, equal ones by label.

    side tells on which side of zero the whole interval lies (1, -1), or 0. Rows without an estimate come last.
    """
    side = F.when(F.col(low) > 0, 1).when(F.col(high) < 0, -1).otherwise(0)
    few = df.select(F.col(label).alias("label"), F.col(value).alias("value"), F.col(low).alias("low"), F.col(high).alias("high"), side.alias("side")).orderBy(F.desc_nulls_last("value"), "label").limit(MOST)
    return few.withColumn("at", F.row_number().over(W.Window.orderBy(F.desc_nulls_last("value"), "label")) - 1)  # at most MOST rows
