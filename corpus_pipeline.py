"""A training-data pipeline of five stages; each is written as Parquet and read again by the next.

Language ID drops what has no letter or fits no language, the quality classifier what it predicts to be bad, MinHash
near-dedup all but one document of each group; mixing repeats or drops documents towards the source
weights, and packing lays the result into sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliowright.llm import language_id, minhash_dedup, mixing, packing, quality_pu
from foliowright.llm.common import bucket_of, load, materialize, shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.col(c) for c in COLUMNS])


def _carry(docs: DataFrame) -> dict:
    return {c: F.col(c) for c in COLUMNS if c != "text"}


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops ``und`` (null texts and texts without a letter, or all where no label could be learned) and texts whose
    score lies below the least score of a text of a learned language, fitted on held-out rows.

    Repeated rows are judged alike and each kept; rows with null ids or sources stay. An empty table, or
    one without a non-null lang, leaves nothing.
    """
    model = language_id.train(docs, bucket_of("doc_id", 4) != 2)
    judged = materialize(language_id.language_id(docs, model, _carry(docs), raw=True), "languages")  # predicted once
    least = language_id.least_score(judged, language_id.held_out())
    return _documents(judged.where((F.col("lang_pred") != "und") & (F.col("score") >= least)))


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier predicts to be good.

    Repeated rows are judged alike and each kept. Without labels of 1 every document scores one half and
    stays; an empty table stays empty.
    """
    model = quality_pu.train(docs, load(spark, sf_dir, "labels"), bucket_of("doc_id", 5) != 0)
    return _documents(quality_pu.quality_scores(docs, model, _carry(docs), raw=True).where("predicted = 1"))


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group; of rows that share id and group or text, one.

    Texts without words link with nothing and stay, as do rows without an id (repeated ones too).
    """
    left = docs.withColumn("h", minhash_dedup.text_hash()).join(minhash_dedup.survivors(docs), ["doc_id", "h"], "left_semi")
    once = left.groupBy("doc_id", "h").agg(F.first(F.struct(*[c for c in COLUMNS if c != "doc_id"])).alias("d"))
    return _documents(once.select("doc_id", "d.*")).union(_documents(docs.where("doc_id IS NULL")))


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each copy that the mix takes of a document.

    A null source is a source of its own. Documents without words take part in the ranking like those of
    one word. Repeated rows are taken together.
    """
    rows = mixing.with_copies(_documents(docs), "__n").where("__n > 0")
    return _documents(rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int")))))


def stage_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens; copies of a document are packed each by itself.

    A null text is an empty one, which is a single end token; an empty table gives no pieces.
    """
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path(packing.VOCABULARY))


STAGES = [
    ("language_id", stage_language),
    ("quality_classifier", stage_quality),
    ("minhash_near_dedup", stage_near_dedup),
    ("mixing", stage_mix),
    ("packing", stage_pack),
]
#: Trained models and random trees have no SQL form. A test recomputes run() stage by stage in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents`` and returns the last one's rows.

    Only COLUMNS of the table are read; further columns, of any name, take no part.
    """
    docs = load(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
