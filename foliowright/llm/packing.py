"""Packing along a space-filling curve.

A document's token ids are hashed into a count vector, projected to AXES dimensions by fixed random signs
and quantised; its place is the Hilbert key of that cell. Documents are range-sorted by key, their tokens
laid end to end along the curve and cut every LENGTH, so neighbours share sequences and only the last
sequence of all has room left.
"""

from __future__ import annotations

import json
import zlib
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, map_texts, materialize

VOCABULARY = "byte_bpe_50k.json"
LENGTH = 1024
END = 0  # id behind each document
AXES, BITS = 3, 16
HASHED = 1024  # dimensions of the hashed count vector

#: Public split of byte-level vocabularies.
SPLIT = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Texts with other characters go to the library whole: character tables of other versions may differ.
_ODD = regex.compile(r"[^\x00-\x1b\x20-\x84\x86-ɏ‐-‧₠-₿]")


class Encoder:
    """Ids of whole texts as the library gives them.

    Where the vocabulary's ids follow its merges, a rank-based encoder built from the same file yields
    the same ids several times faster; special strings and rare characters go through the library.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path, self.fast = path, None
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, added = file["model"], file.get("added_tokens") or []
        self.special = [t["content"] for t in added]
        self.size = len(set(model["vocab"]) | set(self.special))
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        vocab, first = model["vocab"], len(model["vocab"]) - len(pairs)
        if all(vocab.get(a + b) == first + i for i, (a, b) in enumerate(pairs)):
            back = {c: b for b, c in byte_alphabet().items()}
            ranks = {bytes(back[c] for c in token): i for token, i in vocab.items() if i < first + len(pairs) and token not in self.special}
            self.fast = tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def lib(self):
        """The library's own tokenizer, read where a text first needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, raw: bytes | None) -> np.ndarray:
        text = raw.decode("utf-8", "replace") if raw else ""
        if self.fast is None or any(s in text for s in self.special) or _ODD.search(text):
            return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast.encode_ordinary(text), "<u4")


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies: itself if printable, else 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


_signs = np.random.default_rng(41).choice([-1.0, 1.0], (HASHED, AXES))


def cells(id_lists: list[np.ndarray]) -> np.ndarray:
    """Quantised projections, one row a document."""
    out = np.empty((len(id_lists), AXES))
    for i, ids in enumerate(id_lists):
        counts = np.sqrt(np.bincount(ids * np.uint32(2654435761) % np.uint32(HASHED) if len(ids) else np.zeros(0, int), minlength=HASHED))
        out[i] = counts @ _signs / max(1e-9, np.sqrt((counts * counts).sum()))
    # projections of unit vectors have a spread of 1: six spreads cover the range
    return np.clip((out / 6 + 0.5) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.uint64)


def hilbert(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Keys of cells along the Hilbert curve; x: (n, axes) of unsigned cells below 2 ** bits.

    From the highest bit down, the lower bits of an axis are swapped with the first axis or inverted
    as the curve turns; a Gray code over the interleaved bits then gives the key.
    """
    x = x.astype(np.uint64).T.copy()
    axes, one = len(x), np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        low = q - one
        for a in range(axes):
            on = (x[a] & q) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[a]) & low)
            x[0] ^= np.where(on, low, swap)
            x[a] ^= swap
    for a in range(1, axes):
        x[a] ^= x[a - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        turn ^= np.where((x[-1] & q) != 0, q - one, np.uint64(0))
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for a in range(axes):
            key = (key << one) | ((x[a] >> np.uint64(b)) & one)
    return key.astype(np.int64)


def packed(docs: DataFrame, vocabulary: str, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, hilbert_key.

    Null text is empty and yields the end id alone. Repeated rows and null ids are documents of their
    own. Documents of one key stand in the order of the table's parts; an empty table gives no pieces. The ids are written once and shuffled once; what is range-sorted is three numbers a document.
    Only one row total per sorted partition reaches the driver.
    """

    def run(texts):
        enc = encoder(vocabulary)
        ids = [enc.ids(t) for t in texts]
        keys = hilbert(cells(ids)) if ids else []
        wide = "<u2" if enc.size <= 1 << 16 else "<u4"
        return [[len(x) + 1 for x in ids], list(keys), [np.append(x, END).astype(wide).tobytes() for x in ids]]

    made = map_texts(docs, {"doc_id": F.col(doc_id)}, "doc_tokens bigint, hilbert_key bigint, ids binary", run, text)
    made = materialize(made.withColumn("uid", F.monotonically_increasing_id()), "token-ids")

    def running(batches):
        at = 0
        for b in batches:
            n = b.column(1).to_numpy()
            ends = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ends - n, pa.int64()), b.column(1), b.column(2)], names=["uid", "local", "n", "part"])
            at = int(ends[-1]) if len(ends) else at

    parts = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    curve = made.select("uid", "doc_tokens", "hilbert_key").repartitionByRange(int(parts), "hilbert_key", "uid").sortWithinPartitions("hilbert_key", "uid")
    curve = materialize(curve.select("uid", "doc_tokens", F.spark_partition_id().alias("part")).mapInArrow(running, "uid bigint, local bigint, n bigint, part int"), "curve")
    starts, total = [], 0
    for r in curve.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        starts.append((r["part"], total))
        total += r["n"]
    starts = F.broadcast(docs.sparkSession.createDataFrame(starts, "part int, base bigint"))  # a row a sorted partition
    placed = made.join(curve.join(starts, "part").select("uid", (F.col("base") + F.col("local")).alias("first")), "uid")

    def pieces(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            rows = []
            for i, (first, n, ids) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                x = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4")
                start = 0
                while start < n:
                    sequence, offset = divmod(first + start, length)
                    took = min(n - start, length - offset)
                    rows.append(i)
                    for c, v in zip(cols, (start, took, zlib.crc32(x[start : start + took].tobytes()), n, sequence, offset), strict=True):
                        c.append(v)
                    start += took
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(3).take(take), *(pa.array(c, pa.int64()) for c in cols), b.column(4).take(take)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "hilbert_key"])

    id_type = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, hilbert_key bigint"
    return placed.select("first", "doc_tokens", "ids", "doc_id", "hilbert_key").mapInArrow(pieces, schema)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(load(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
