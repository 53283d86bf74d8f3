"""The per-document pipeline as a stream: documents in, segments or assembled documents out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import documents as D
from ..operators import translation as T

FILES = "path string, modificationTime timestamp, length long, content binary"


def read_files(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    raw = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).load(path)
    return raw.selectExpr("path AS doc", "decode(content, 'UTF-8') AS content")


def translate_stream(docs: DataFrame, langs: list[str], engine: T.Translator, out: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch runs the batch operators; a batch id's folder is overwritten, so a replay is harmless."""

    def one(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        segments = D.extract_segments(batch)
        outcomes = T.translate(segments, langs, engine)
        D.assemble(batch, segments, outcomes.where("text IS NOT NULL").select("doc", "lang", "seg_id", "text")).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        batch.unpersist()

    return docs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
