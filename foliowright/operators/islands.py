"""Runs of consecutive rows: gaps and islands, sessions, groups of comments.

Rows are dealt by range, so one key, however large, is spread over tasks. Inside a range a window of lagged values
finds where a run begins; the last row of every range, one row a range, is handed to the next one, and counts of runs
before it make the numbers global. No task and no driver holds a key.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share; only a local master gets one of its own."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="foliowright-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def fixed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder; its lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def islands(df: DataFrame, by: list[str], order: list[str], breaks, parts: int | None = None) -> DataFrame:
    """Adds island: rows of one key, next to each other in the order, belong together until ``breaks`` holds.

    ``breaks(this, last)`` gets two functions from a column's name to that row's and the previous row's value, and gives
    a condition; it is not asked for the first row of a key, null counts as true. Numbers rise with key and order and
    are gapless from 0 over the whole table. Null keys are one key each and come first; rows with equal order
    stand in no stated order, repeated rows each count. An empty table gives no rows.
    """
    cols = df.columns
    sort = [*by, *order]
    dealt = (df.repartitionByRange(parts, *sort) if parts else df.repartitionByRange(*sort)).sortWithinPartitions(*sort)
    dealt = fixed(dealt.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    row = F.struct(*cols)
    w = W.Window.partitionBy("__part").orderBy("__at")
    border = dealt.groupBy("__part").agg(F.max_by(row, F.col("__at")).alias("__r"))
    ranges = W.Window.orderBy("__part")  # one row a range
    handed = F.broadcast(border.select("__part", F.lag("__r").over(ranges).alias("__handed"), F.lit(True).alias("__any")))
    rows = dealt.join(handed, "__part").withColumn("__last", F.coalesce(F.lag(row).over(w), F.col("__handed")))
    this, last = (lambda c: F.col(c)), (lambda c: F.col(f"__last.{c}"))
    same_key = F.col("__last").isNotNull()
    for c in by:
        same_key &= this(c).eqNullSafe(last(c))
    rows = rows.withColumn("__new", F.when(same_key, F.coalesce(breaks(this, last), F.lit(True)).cast("long")).otherwise(F.lit(1)))
    rows = rows.withColumn("__run", F.sum("__new").over(w.rowsBetween(W.Window.unboundedPreceding, 0)))
    counts = rows.groupBy("__part").agg(F.max("__run").alias("__runs"))
    before = F.coalesce(F.sum("__runs").over(ranges.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    bases = F.broadcast(counts.select("__part", before.alias("__base")))
    return rows.join(bases, "__part").select(*cols, (F.col("__base") + F.col("__run") - 1).alias("island"))


def comment_groups(comments: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """Adds island: line comments on consecutive lines with one marker at one column form one logical comment.

    comments: keys, line, column, marker, own_line (nothing else stands before it on its line), standalone (a directive or
    first line that stays by itself), and any more columns. A block comment has a null marker and stays alone. A group
    goes on only from a comment on a line of its own.
    """

    def breaks(this, last):
        goes_on = (this("line") == last("line") + 1) & (this("column") == last("column")) & (this("marker") == last("marker"))
        return ~(goes_on & last("own_line") & ~this("standalone") & ~last("standalone"))

    return islands(comments, keys, ["line"], breaks, parts)


def sessions(events: DataFrame, by: list[str], time: str, gap: Column | int, parts: int | None = None) -> DataFrame:
    """Adds island: events of a key that follow each other within ``gap`` (seconds, or an interval column)."""
    limit = F.make_interval(secs=F.lit(gap)) if isinstance(gap, int) else gap
    return islands(events, by, [time], lambda this, last: this(time) > last(time) + limit, parts)


def places(df: DataFrame, by: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """Adds place: the number of each row in its key's order, from 0. Dealt by range like ``islands``, so a key of any size is spread."""
    cols = df.columns
    sort = [*by, *order]
    dealt = (df.repartitionByRange(parts, *sort) if parts else df.repartitionByRange(*sort)).sortWithinPartitions(*sort)
    dealt = fixed(dealt.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    own = F.row_number().over(W.Window.partitionBy("__part", *by).orderBy("__at"))
    upto = W.Window.partitionBy(*by).orderBy("__part").rowsBetween(W.Window.unboundedPreceding, -1)
    bases = dealt.groupBy("__part", *by).count().withColumn("__base", F.coalesce(F.sum("count").over(upto), F.lit(0)))
    bases = bases.select(F.col("__part").alias("__p"), F.struct(*by).alias("__k"), "__base")
    same = (F.col("__part") == F.col("__p")) & F.struct(*by).eqNullSafe(F.col("__k"))
    return dealt.join(bases, same).select(*cols, (F.col("__base") + own - 1).alias("place"))
