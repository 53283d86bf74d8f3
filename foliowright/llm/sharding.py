"""Sharding by vector bin packing over bytes, tokens and rows; equal texts form one group.

Groups are placed largest first, each into the shard where the dot product of its size vector with the
shard's residual capacity is highest among those with room. A group larger than a shard is dealt in
pieces. Groups below 1/LIGHT of the corpus in every dimension are placed by the hash bucket of their
text, so the packer's items are bounded by 3 * LIGHT + BUCKETS plus the pieces at any input size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .common import load, materialize

SHARDS = 8
LIGHT = 4096
BUCKETS = 8192
PIECES = 8  # pieces of a shard's worth of an oversized group
SALTS = 512  # numbering cells of a shard
LAW = "bytes"


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every item (rows of shares of the total). Largest first, by dot product with what is left."""
    order = np.lexsort((np.arange(len(items)), -items.sum(axis=1), -items.max(axis=1)))
    left = np.full((shards, items.shape[1]), 1.0 / shards)
    out = np.zeros(len(items), int)
    for i in order:
        room = (left >= items[i] - 1e-12).all(axis=1)
        # without room in all dimensions, bytes (the law) decide first
        score = left @ items[i] if room.any() else left[:, 0]
        out[i] = best = int(np.argmax(np.where(room, score, -np.inf) if room.any() else score))
        left[best] -= items[i]
    return out


def shards(docs: DataFrame, n_shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    size is the UTF-8 bytes plus 1 (null text: 1); text_crc32 of a null text is that of an empty one.
    Nulls form one group, empty texts another. A group larger than a shard is dealt row by row, so rows that
    repeat both id and text part as well. Slots are numbered by doc_id inside hash cells of rows, a null id first;
    repeated rows get a slot each, in no stated order. Of shards with an equal score
    the lowest is taken. An empty table gives no rows; no other column is read.
    """
    spark, col = docs.sparkSession, F.col(text)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),  # fixed once the table is written
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(col), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(col, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.regexp_count(col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("tokens"),
        F.coalesce(F.unhex(F.md5(col)), F.lit(b"").cast("binary")).alias("key"),
    )
    rows = materialize(rows, "sizes")
    groups = rows.groupBy("key").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r"))
    groups = materialize(groups, "text-groups")
    total = groups.agg(F.sum("b"), F.sum("t"), F.sum("r")).first()
    total = [float(x or 0) or 1.0 for x in total]
    share = F.greatest(F.col("b") / total[0], F.col("t") / total[1], F.col("r") / total[2])
    heavy = groups.where(share > 1.0 / LIGHT).select("key", share.alias("share")).collect()  # at most 3 * LIGHT
    piece_of = [(bytes(x["key"]), int(np.ceil(x["share"] * n_shards * PIECES)) if x["share"] > 1.0 / n_shards else 1) for x in heavy]
    schema = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("pieces", T.IntegerType())])
    marked = rows.join(F.broadcast(spark.createDataFrame(piece_of, schema)), "key", "left")
    light = F.col("pieces").isNull()
    marked = marked.select(
        "row", "doc_id", "size", "text_crc32", "tokens",
        F.when(light, F.lit(b"").cast("binary")).otherwise(F.col("key")).alias("item"),
        F.when(light, F.pmod(F.xxhash64("key"), F.lit(BUCKETS))).otherwise(F.pmod(F.xxhash64("row"), F.col("pieces"))).cast("int").alias("part"),
    )
    items = marked.groupBy("item", "part").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r")).orderBy("item", "part").collect()
    placed = pack(np.array([[x["b"], x["t"], x["r"]] for x in items], float).reshape(-1, 3) / np.array(total), n_shards)
    schema = T.StructType([T.StructField("item", T.BinaryType()), T.StructField("part", T.IntegerType()), T.StructField("shard", T.IntegerType())])
    where = spark.createDataFrame([(bytes(x["item"]), x["part"], int(s)) for x, s in zip(items, placed, strict=True)], schema)
    return numbered(marked.join(F.broadcast(where), ["item", "part"]), "doc_id").select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def numbered(rows: DataFrame, doc_id: str) -> DataFrame:
    """Adds slot: gapless from 0 inside each shard, counted in SALTS cells of rows (by their number) side by side."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("row", F.lit(9)), F.lit(SALTS)).cast("int"))
    sizes = rows.groupBy("shard", "salt").count()
    before = W.Window.partitionBy("shard").orderBy("salt").rowsBetween(W.Window.unboundedPreceding, -1)
    sizes = sizes.select("shard", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))  # at most shards * SALTS rows
    order = W.Window.partitionBy("shard", "salt").orderBy(doc_id, "row")
    return rows.withColumn("at", F.row_number().over(order)).join(F.broadcast(sizes), ["shard", "salt"]).withColumn("slot", (F.col("base") + F.col("at") - 1).cast("long"))


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    return shards(load(spark, sf_dir, "documents"))
