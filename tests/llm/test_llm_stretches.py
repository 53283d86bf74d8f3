"""Stages over whole texts hold a bounded stretch of a batch, and a worker reads the library's tokenizer only for texts that need it."""

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliowright.llm import common, packing


def test_a_stage_holds_a_stretch_of_a_batch(spark):
    docs = spark.createDataFrame([(i, None if i % 50 == 7 else "x" * (900_000 if i == 33 else 30_000)) for i in range(200)], "doc_id long, text string").coalesce(1)

    def run(texts):
        return [[sum(len(t or b"") for t in texts)] * len(texts), [len(t) if t is not None else None for t in texts]]

    for raw in (False, True):
        rows = common.map_texts(docs, {"doc_id": F.col("doc_id")}, "held long, n long", run, raw=raw).collect()
        assert [r["doc_id"] for r in rows] == list(range(200))
        assert [r["n"] for r in rows] == [None if i % 50 == 7 else 900_000 if i == 33 else 30_000 for i in range(200)]
        assert max(r["held"] for r in rows) <= common.STRETCH + 900_000


def test_the_library_is_read_when_a_text_needs_it():
    path = public_tokenizers.path(packing.VOCABULARY)
    enc, lib = packing.Encoder(path), Tokenizer.from_file(path)
    assert enc.size == lib.get_vocab_size() and sorted(enc.special) == sorted(t.content for t in lib.get_added_tokens_decoder().values())
    assert enc.ids("Plain words, 12 of them.".encode()).tolist() == lib.encode("Plain words, 12 of them.", add_special_tokens=False).ids
    assert "lib" not in vars(enc)
    assert enc.ids("\U0001f600 rare".encode()).tolist() == lib.encode("\U0001f600 rare", add_special_tokens=False).ids
    assert "lib" in vars(enc)
