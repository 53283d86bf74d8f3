"""Shared helpers: tables in the shared folder, whole-text Arrow stages, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that lower-case A-Z and leave all else.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes of texts that an Arrow stage holds as Python objects at once, whatever its batch holds; a longer text stands alone.
STRETCH = 1 << 21
#: Bytes of a batch that goes to Python or comes back; Spark's own setting has 64 MB, which the JVM of every task holds twice.
BATCH_BYTES = 1 << 22
#: Bytes 0x80-0xBF continue a UTF-8 code point.
CONTINUATION = bytes(range(0x80, 0xC0))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Only a local master, where there is one machine,
    gets a temporary folder when the setting is missing; on a cluster that is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="foliowright-")
        sc.setCheckpointDir(found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: lineage ends there.

    Lazy results read the tables, so nothing here deletes them. The setting ``foliowright.run`` names a folder
    for a run's tables, which its caller can drop as a whole when the results are written.
    """
    spark = df.sparkSession
    run = spark.conf.get("foliowright.run", None) or "tables"
    path = f"{shared_dir(spark).rstrip('/')}/foliowright/{run}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most about BATCH_BYTES from now on, unless the session has a limit of its own; no result depends on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def bucket_of(id_col: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(col.cast("string").cast("binary")) % n


def map_texts(
    df: DataFrame,
    carry: dict[str, Column],
    fields: str,
    fn: Callable[[list[bytes | None]], list],
    text: str = "text",
    raw: bool = False,
) -> DataFrame:
    """One Arrow stage over whole texts (as UTF-8 bytes, null stays None).

    ``fn`` gets the texts of a stretch of a batch (STRETCH bytes) and returns one list per column of ``fields``; the carried
    columns pass through. Only the named columns leave the scan, so extra columns of any name are
    never read. With ``raw`` the text itself is also passed through, as ``text``.
    """
    small_batches(df.sparkSession)
    last = F.col(text) if raw else F.col(text).cast("binary")
    picked = df.select(*[c.alias(k) for k, c in carry.items()], last.alias("text" if raw else "__b"))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields if f.name != "__b"]
    schema = ", ".join([*kept, fields])
    out = T_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in stretches(batch)):
            n = b.num_columns - (not raw)
            texts = b.column(b.num_columns - 1)
            # the bytes of a text that is passed through are those of the same buffer
            made = fn((texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()) if raw else texts).to_pylist())
            arrays = [*b.columns[:n], *(pa.array(v, type=t) for v, t in zip(made, out[1], strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*b.schema.names[:n], *out[0]])

    return picked.mapInArrow(run, schema)


def stretches(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices whose texts, its last column, have at most STRETCH bytes beside the first one's."""
    size = pc.fill_null(pc.binary_length(b.column(b.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // STRETCH)) + 1).tolist(), b.num_rows]
    for a, z in zip(cuts, cuts[1:], strict=False):
        if z > a:
            yield b.slice(a, z - a)


def T_schema(ddl: str) -> tuple[list[str], list[pa.DataType]]:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    st = StructType.fromDDL(ddl)
    return [f.name for f in st], [to_arrow_type(f.dataType) for f in st]


def connected_components(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); component is the smallest node reached.

    Alternating large-star and small-star rounds on tables in the shared folder. A hub's neighbours
    meet their minimum through a pre-aggregated group-by and a join that adaptive execution may split,
    so no task holds a hub's whole neighbourhood. Only two numbers a round reach the driver.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = materialize(e, f"{name}-edges")
    mark = _mark(e)
    for r in range(max_rounds):
        if mark[0] == 0:
            break
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(moved.union(low.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{r}")
        now = _mark(e)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    stars = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.union(roots.join(stars, "node", "left_anti"))


def _mark(e: DataFrame) -> tuple:
    row = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
