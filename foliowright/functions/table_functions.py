"""Table functions for SQL: polymorphic, over a table argument that the caller partitions and orders.

``SELECT * FROM pack_batches(TABLE(t) PARTITION BY doc, lang ORDER BY (seq), 'n', 40, 12000)``. Rows of a partition come
one after the other and meet a constant state; Spark spills and sorts them.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def _widened(table: AnalyzeArgument, name: str, more: StructField) -> AnalyzeResult:
    if not table.isTable:
        raise ValueError("the first argument has to be a table")
    if name not in table.dataType.names:
        raise ValueError(f"the table has no column {name}")
    return AnalyzeResult(schema=StructType([*table.dataType.fields, more]))


def _text(arg: AnalyzeArgument) -> str:
    if not arg.isConstantExpression or not isinstance(arg.value, str):
        raise ValueError("the name of a column has to be a constant")
    return arg.value


@udtf
class PackBatches:
    """The table's columns and batch: greedy packing in the table's order; null sizes count as 0."""

    @staticmethod
    def analyze(table: AnalyzeArgument, size: AnalyzeArgument, max_items: AnalyzeArgument, max_size: AnalyzeArgument) -> AnalyzeResult:
        return _widened(table, _text(size), StructField("batch", IntegerType()))

    def __init__(self):
        self.packer = None

    def eval(self, row, size: str, max_items: int, max_size: int):
        from ..operators.translation import Packer

        if self.packer is None:
            self.packer = Packer(max_items, max_size)
        yield *row, self.packer.put(row[size] or 0)


@udtf
class NumberRuns:
    """The table's columns and run, from 0: it goes up where the named column differs from the row before. Nulls are alike."""

    @staticmethod
    def analyze(table: AnalyzeArgument, column: AnalyzeArgument) -> AnalyzeResult:
        return _widened(table, _text(column), StructField("run", LongType()))

    def __init__(self):
        self.run, self.last = -1, None

    def eval(self, row, column: str):
        if self.run < 0 or row[column] != self.last:
            self.run, self.last = self.run + 1, row[column]
        yield *row, self.run


@udtf
class DifferingBlocks:
    """key, kind, place, block: how the blocks of side b differ from those of side a, given in one table in order of place.

    The table holds the columns side ('a' or 'b'), that of the blocks and the key by which the caller partitions. A block of either side that the other one lacks, as
    often, is lost or added; only blocks that wait for their other half are held.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, column: AnalyzeArgument, key: AnalyzeArgument) -> AnalyzeResult:
        for name in ("side", _text(column), _text(key)):
            _widened(table, name, StructField("x", LongType()))
        own = StructField(key.value, table.dataType[key.value].dataType)
        return AnalyzeResult(schema=StructType([own, StructField("kind", StringType()), StructField("place", LongType()), StructField("block", StringType())]))

    def __init__(self):
        self.waiting, self.at, self.key = {}, 0, None

    def eval(self, row, column: str, key: str):
        self.key = row[key]
        block, side = row[column], row["side"]
        queue = self.waiting.setdefault(block, [])
        if queue and queue[0][0] != side:
            queue.pop(0)
            if not queue:
                del self.waiting[block]
        else:
            queue.append((side, self.at))
        self.at += 1

    def terminate(self):
        left = [(self.key, "lost" if side == "a" else "added", at, block) for block, queue in self.waiting.items() for side, at in queue]
        yield from sorted(left, key=lambda x: x[2])


TABLE_FUNCTIONS = {"pack_batches": PackBatches, "number_runs": NumberRuns, "differing_blocks_of": DifferingBlocks}


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    for name, fn in TABLE_FUNCTIONS.items():
        spark.udtf.register(prefix + name, fn)
    return [prefix + name for name in TABLE_FUNCTIONS]
