"""The bitmap that spares texts a shuffle never loses a key."""

from pyspark.sql import functions as F

from foliowright.llm import minhash_dedup as M


def test_bitmap_keeps_every_key_and_little_else(spark):
    rows = spark.range(20000).select(F.when(F.col("id") % 50 != 3, F.col("id")).alias("least"), F.xxhash64("id").alias("h"), F.lit("text").alias("page"), F.lit(1).alias("bits"))
    keys = rows.where("least % 7 = 0").select("least", "h")
    got = M._perhaps_among(rows.withColumnsRenamed({"page": "b", "bits": "c"}), keys, ["least", "h"])
    assert keys.join(got, ["least", "h"], "left_anti").count() == 0
    assert got.columns == ["least", "h", "b", "c"] and keys.count() <= got.count() < keys.count() + 20
    assert M._perhaps_among(rows.select("least", "h"), keys.limit(0), ["least", "h"]).count() == 0
