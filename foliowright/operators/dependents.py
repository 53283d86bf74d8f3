"""Segments that hold other segments: render levels from the innermost outwards, cycles, rendering level by level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .islands import fixed

MOST_LEVELS = 32
MARK = r"\{\{\w+\}\}"  # where a segment's text holds another one: its id between braces


def levels(df: DataFrame, keys: list[str], id_: str = "id", parent: str = "parent", most: int = MOST_LEVELS) -> DataFrame:
    """keys, id, parent, level, cyclic: a segment that holds none has level 0, any other one more than the highest it holds.

    Peeled round by round: segments that hold no open one are ready, and leave. Each round joins only what is open, and
    its tables are written, so lineage stays short; rounds are as many as levels. What never gets ready lies on a cycle
    or holds one: level null, cyclic. A parent that is no segment holds nothing. Repeated rows are one. More than
    ``most`` levels are an error; an empty table gives no rows.
    """
    open_ = fixed(df.select(*keys, F.col(id_).alias("id"), F.col(parent).alias("parent")).distinct())
    on, done = [*keys, "id"], []
    for level in range(most + 1):
        holders = open_.where("parent IS NOT NULL").select(*keys, F.col("parent").alias("id")).distinct()
        ready = fixed(open_.join(holders, on, "left_anti").withColumn("level", F.lit(level)))
        if ready.isEmpty():
            break
        done.append(ready)
        open_ = fixed(open_.join(ready.select(*on), on, "left_anti"))
        if open_.isEmpty():
            break
    else:
        raise RuntimeError(f"segments lie more than {most} levels deep")
    done.append(open_.withColumn("level", F.lit(None).cast("int")))
    return reduce(DataFrame.union, done).select(*keys, "id", "parent", "level", F.col("level").isNull().alias("cyclic"))


def render(df: DataFrame, keys: list[str], id_: str = "id", parent: str = "parent", text: str = "text", most: int = MOST_LEVELS) -> DataFrame:
    """keys, id, text, error: every segment with the marks of those it holds replaced by their rendered text.

    One splice a level. A mark of a segment that is not held by this one stays as it is. Segments on or above a cycle keep
    their text and get an error. Ids are text; keys and id must tell segments apart.
    """
    rows = df.select(*keys, F.col(id_).cast("string").alias("id"), F.col(parent).cast("string").alias("parent"), F.col(text).alias("text"))
    known = fixed(rows.join(levels(rows, keys, most=most).select(*keys, "id", "level"), [*keys, "id"], "left"))
    top = known.agg(F.max("level")).first()[0] or 0
    made = known.where("level = 0").select(*keys, "id", "parent", "text")
    for level in range(1, top + 1):
        held = known.where(F.col("level") == level)
        marks = spans.match_positions(held, [*keys, "id"], F.col("text"), MARK).withColumn("child", F.expr("substring(span, 3, length(span) - 4)"))
        child = made.select(*keys, F.col("parent").alias("id"), F.col("id").alias("child"), F.col("text").alias("new"))
        edits = marks.join(child, [*keys, "id", "child"]).select(*keys, "id", "start", "end", F.col("new").alias("text"))
        done = spans.splice(held, edits, [*keys, "id"]).join(held.select(*keys, "id", "parent"), [*keys, "id"]).select(*keys, "id", "parent", "text")
        made = fixed(made.union(done))
    bad = known.where("level IS NULL").select(*keys, "id", "text", F.lit("segments hold each other").alias("error"))
    return made.select(*keys, "id", "text", F.lit(None).cast("string").alias("error")).union(bad)
