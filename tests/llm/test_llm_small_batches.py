"""Batches between the JVM and a worker are bounded in bytes, not only in rows."""

import pyarrow as pa
from pyspark.sql import functions as F

from foliowright.llm import common

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_a_batch_of_long_texts_is_bounded(spark):
    docs = spark.createDataFrame([(i, "x" * 30_000) for i in range(400)], "doc_id long, text string").coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]})

    rows = common.map_texts(docs, {"doc_id": F.col("doc_id")}, "n long", lambda texts: [[len(t) for t in texts]]).collect()
    assert [tuple(r) for r in rows] == [(i, 30_000) for i in range(400)]
    got = docs.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r["n"] for r in got) == 400
    assert max(r["size"] for r in got) <= common.BATCH_BYTES + 60_000


def test_a_limit_of_the_session_stays(spark):
    before = spark.conf.get(KEY, None)
    try:
        spark.conf.set(KEY, "1000000")
        common.small_batches(spark)
        assert spark.conf.get(KEY) == "1000000"
    finally:
        spark.conf.set(KEY, before) if before else spark.conf.unset(KEY)
