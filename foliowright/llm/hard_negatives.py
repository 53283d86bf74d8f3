"""Hard-negative mining by two-dimensional block matrix multiplication (SUMMA-style).

Rows and anchors are cut into blocks of TILE vectors and into chunks of CHUNK dimensions. An anchor block's chunk is
sent to the row blocks it must meet; each chunk gives a partial int64 score tile, and the partial tiles of a block
pair are shuffled together and added one after the other. From a finished tile only the best of every anchor (or of
every window of an anchor and a positive) go on, so no list of all scores exists.

Blocks hold one label each where a label has vectors enough. Tiles of blocks that share a label give the positives,
tiles of blocks that may differ in label the negatives; a tile of pure blocks is computed in one of the passes only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import load, materialize
from .mixing import running

# Which rows are anchors, which labels are moved by one and over how many, the scale of a component.
ANCHOR_EVERY, MOVED_EVERY, LABELS, SCALE = 100, 7, 10, 256
POSITIVES, NEGATIVES = 5, 5
LOW = 80  # hundredths of the positive's score that a negative needs
TILE = 512  # vectors a block
CHUNK = 32  # dimensions a chunk
OWN_BLOCK = 32  # vectors of a label from which on it has blocks of its own
MOST = 1 << 26  # a larger component saturates, so that sums over 2048 dimensions stay exact
SALTS = 64
_META = "uid binary, vec binary, has_vec binary, label binary"


def _ints(cell) -> np.ndarray:
    return np.frombuffer(cell, np.int64)


def pack_block(table: pa.Table, chunk: int) -> Iterator[tuple[int, bytes, int]]:
    """(chunk number, its matrix in the narrowest whole numbers, columns) of a block, in the order of the rows."""
    column = table["e"].combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    width = max(1, int(sizes.max(initial=0)))
    flat = np.clip(np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE), -MOST, MOST)
    full = np.zeros((len(sizes), width))
    full[np.arange(width) < sizes[:, None]] = flat  # shorter vectors are filled with zeros
    for k, a in enumerate(range(0, width, chunk)):
        part = full[:, a : a + chunk]
        top = np.abs(part).max(initial=0)
        kind = np.int16 if top < 1 << 15 else np.int32
        yield k, np.ascontiguousarray(part.astype(kind)).tobytes(), part.shape[1]


def unpack(cell: bytes, rows: int, width: int) -> np.ndarray:
    return np.frombuffer(cell, np.int16 if len(cell) == 2 * rows * width else np.int32).reshape(rows, width)


def partial_tile(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """int64 scores of one chunk; in floating point only where every sum is below 2^53 and so exact."""
    width = min(a.shape[1], r.shape[1])  # the rest of the wider block meets zeros
    a, r = a[:, :width].astype(np.int64), r[:, :width].astype(np.int64)
    if width * int(np.abs(a).max(initial=0)) * int(np.abs(r).max(initial=0)) < 1 << 53:
        return (a.astype(np.float64) @ r.astype(np.float64).T).astype(np.int64)
    return a @ r.T


def planes(tile: np.ndarray) -> bytes:
    """The tile by byte planes: high bytes stand together, so the shuffle's compression drops them."""
    return np.ascontiguousarray(tile.reshape(-1, 1).view(np.uint8).T).tobytes()


def from_planes(cell: bytes, rows: int) -> np.ndarray:
    flat = np.ascontiguousarray(np.frombuffer(cell, np.uint8).reshape(8, -1).T).view(np.int64)
    return flat.reshape(rows, -1)


def best_positives(tile: np.ndarray, anchors: dict, rows: dict, n: int) -> dict[str, list]:
    """Per anchor the n best other rows of its label."""
    out: dict[str, list] = {k: [] for k in ("uid", "pos_uid", "pos_vec", "pos_score")}
    for x in range(len(tile)):
        at = np.flatnonzero((rows["label"] == anchors["label"][x]) & (rows["uid"] != anchors["uid"][x]))
        best = at[_order(tile[x, at], rows, at)[:n]]
        out["uid"] += [anchors["uid"][x]] * len(best)
        out["pos_uid"] += rows["uid"][best].tolist()
        out["pos_vec"] += _vec(rows, best)
        out["pos_score"] += tile[x, best].tolist()
    return out


def best_negatives(tile: np.ndarray, anchors: dict, rows: dict, windows: dict | None, n: int) -> dict[str, list]:
    """Per window (anchor, positive) the n best rows of another label whose score lies in it."""
    out: dict[str, list] = {k: [] for k in ("uid", "pos_uid", "anchor_id", "positive_id", "positive_score", "neg_uid", "negative_id", "negative_score")}
    of = {int(u): x for x, u in enumerate(anchors["uid"])}
    groups: dict[int, list[int]] = {}
    for w, u in enumerate(windows["uid"] if windows else ()):
        groups.setdefault(of[int(u)], []).append(w)
    for x, ws in groups.items():
        tops = [int(windows["score"][w]) for w in ws]
        lows = [-((-LOW * t) // 100) for t in tops]  # least whole score in the window
        s = tile[x]
        at = np.flatnonzero((rows["label"] != anchors["label"][x]) & (s >= min(lows)) & (s <= max(tops)))
        at = at[_order(s[at], rows, at)]
        falling = -s[at]
        for w, top, low in zip(ws, tops, lows, strict=True):
            a, b = np.searchsorted(falling, -top, "left"), np.searchsorted(falling, -low, "right")
            best = at[a : min(b, a + n)]
            m = len(best)
            out["uid"] += [int(windows["uid"][w])] * m
            out["pos_uid"] += [int(windows["pos_uid"][w])] * m
            out["anchor_id"] += [int(anchors["vec"][x])] * m
            out["positive_id"] += _vec({"vec": windows["pos_vec"], "has_vec": windows["has_pos"]}, np.array([w])) * m
            out["positive_score"] += [top] * m
            out["neg_uid"] += rows["uid"][best].tolist()
            out["negative_id"] += _vec(rows, best)
            out["negative_score"] += s[best].tolist()
    return out


def _order(score: np.ndarray, rows: dict, at: np.ndarray) -> np.ndarray:
    return np.lexsort((rows["uid"][at], rows["vec"][at], rows["has_vec"][at] == 0, -score))


def _vec(rows: dict, at: np.ndarray) -> list:
    return [int(v) if has else None for v, has in zip(rows["vec"][at], rows["has_vec"][at], strict=True)]


def scored_rows(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """uid, vec, label, anchor, e of the rows that take part."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec"), F.col(label).cast("long").alias("label"), F.col(embedding).alias("e"))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    rows = rows.where(F.col("label").isNotNull() & F.coalesce(F.forall("e", number), F.lit(False)))
    moved = F.when(F.col("vec") % MOVED_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    anchor = F.coalesce(F.col("vec") % ANCHOR_EVERY == 0, F.lit(False))
    rows = rows.select(F.monotonically_increasing_id().alias("uid"), "vec", moved.alias("label"), anchor.alias("anchor"), "e")
    return materialize(rows, "negatives-rows")  # the row numbers are fixed from here on


def blocks(rows: DataFrame, tile: int, chunk: int, name: str) -> tuple[DataFrame, DataFrame, int]:
    """(block, pure, labels and the rows' columns), (block, k, width, n, m) and the number of blocks."""
    by = rows.groupBy("label").count().withColumn("own", F.col("count") >= OWN_BLOCK)
    few = by.where("NOT own").agg(F.sum("count")).first()[0] or 0
    parts = F.ceil(F.col("count") / tile).cast("long")
    key = F.when(F.col("own"), F.xxhash64("label", F.pmod(F.xxhash64("uid"), parts))).otherwise(F.pmod(F.xxhash64("label"), F.lit(-(-few // tile) or 1)))
    keyed = rows.join(by, "label").select(key.alias("key"), "uid", "vec", "label", "e")

    def pack(table: pa.Table) -> pa.Table:
        uid, label = table["uid"].to_numpy(), table["label"].to_numpy()
        has = table["vec"].is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
        vec = table["vec"].fill_null(0).to_numpy()
        seen = np.unique(label)
        lines = [(table["key"][0].as_py(), -1, 0, len(uid), None, uid.tobytes(), vec.tobytes(), has.tobytes(), label.tobytes(), int(seen[0]) if len(seen) == 1 else None, seen.tolist())]
        for k, m, width in pack_block(table, chunk):
            lines.append((lines[0][0], k, width, len(uid), m, None, None, None, None, None, None))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines, strict=True), types, strict=True)], names=names)

    names = ["key", "k", "width", "n", "m", "uid", "vec", "has_vec", "label", "pure", "labels"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 5, pa.int64(), pa.list_(pa.int64())]
    packs = keyed.groupBy("key").applyInArrow(pack, f"key bigint, k int, width int, n int, m binary, {_META}, pure bigint, labels array<bigint>")
    packs = materialize(packs, name)
    metas = packs.where("k = -1")
    numbers = materialize(running(metas.select("key"), [F.col("key")], [], f"{name}-order").select("key", F.col("place").cast("long").alias("block")), f"{name}-numbers")
    metas = metas.join(numbers, "key").select("block", "n", "uid", "vec", "has_vec", "label", "pure", "labels")
    chunks = packs.where("k >= 0").join(numbers, "key").select("block", "k", "width", "n", "m")
    return metas, chunks, numbers.count()


def tiles(pairs: DataFrame, a: tuple[DataFrame, DataFrame], r: tuple[DataFrame, DataFrame], windows: DataFrame | None, pick, schema: str) -> DataFrame:
    """``pick`` over the finished tile of every block pair (i, j); ``schema`` has the columns that it makes, and i."""
    a_chunks = a[1].select(F.col("block").alias("i"), "k", F.col("width").alias("aw"), F.col("n").alias("an"), F.col("m").alias("am"))
    r_chunks = r[1].select(F.col("block").alias("j"), "k", F.col("width").alias("rw"), F.col("n").alias("rn"), F.col("m").alias("rm"))
    met = pairs.join(a_chunks, "i").join(r_chunks, ["j", "k"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in range(b.num_rows):
                i, j, k, aw, an, am, rw, rn, rm = (b.column(c)[x].as_py() for c in ("i", "j", "k", "aw", "an", "am", "rw", "rn", "rm"))
                tile = partial_tile(unpack(am, an, aw), unpack(rm, rn, rw))
                yield pa.RecordBatch.from_pylist([{"i": i, "j": j, "kind": 3, "n": an, "b0": planes(tile)}], schema=sent)

    cells = ["b0", "b1", "b2", "b3", "b4"]
    sent = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("kind", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in cells)])
    line = "i bigint, j bigint, kind int, n int, b0 binary, b1 binary, b2 binary, b3 binary, b4 binary"
    partial = met.mapInArrow(multiply, line)
    no = F.lit(None).cast("binary")
    meta = lambda m, on, kind: pairs.join(m.withColumnRenamed("block", on), on).select("i", "j", F.lit(kind).alias("kind"), "n", "uid", "vec", "has_vec", "label", no)
    stream = partial.union(meta(a[0], "i", 0)).union(meta(r[0], "j", 1))
    if windows is not None:
        stream = stream.union(pairs.join(windows, "i").select("i", "j", F.lit(2).alias("kind"), F.lit(0), "uid", "pos_uid", "pos_vec", "has_pos", "score"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tile, anchors, rows, wins = None, None, None, None, None

        def done():
            made = pick(tile, anchors, rows, wins)
            made["i"] = [at[0]] * len(made["uid"])
            return pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in out], schema=out)

        for b in batches:
            for x in range(b.num_rows):
                i, j, kind, n, *cell = (b.column(c)[x].as_py() for c in range(9))
                if (i, j) != at:
                    if tile is not None:
                        yield done()
                    at, tile, wins = (i, j), None, None
                if kind == 0:
                    anchors = dict(zip(("uid", "vec", "has_vec", "label"), map(_ints, cell[:4]), strict=True))
                elif kind == 1:
                    rows = dict(zip(("uid", "vec", "has_vec", "label"), map(_ints, cell[:4]), strict=True))
                elif kind == 2:
                    wins = dict(zip(("uid", "pos_uid", "pos_vec", "has_pos", "score"), map(_ints, cell), strict=True))
                else:
                    part = from_planes(cell[0], n)
                    tile = part if tile is None else tile + part
        if tile is not None:
            yield done()

    out = pa.schema([(f.split()[0], pa.int64()) for f in schema.split(", ")])
    return stream.repartition("i", "j").sortWithinPartitions("i", "j", "kind").mapInArrow(add, schema)


def hard_negatives(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", tile: int = TILE, chunk: int = CHUNK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null label, a null vector or a null or non-finite component take no part. A row with a null id is no
    anchor; as a positive or negative it comes last among equal scores. Repeated rows take part each by itself, also as
    an anchor's positive. Vectors of unequal length meet as if the shorter one ended in zeros (an empty one scores 0).
    A component beyond 2^26 after scaling saturates. Anchors without positives, and windows without negatives, give no
    rows, as does an empty table; no other column is read. Ties by smaller vec_id.

    A task holds one tile of at most about TILE x TILE scores and one partial tile, whatever the label's share of rows.
    """
    rows = scored_rows(vectors, vec_id, embedding, label)
    a_meta, a_chunks, n_a = blocks(rows.where("anchor"), tile, chunk, "negatives-anchors")
    r_meta, r_chunks, _ = blocks(rows, tile, chunk, "negatives-blocks")

    # a label's blocks of both sides meet in SALTS cells, numbers only
    mine = a_meta.select(F.col("block").alias("i"), F.explode("labels").alias("l")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    theirs = r_meta.select(F.col("block").alias("j"), F.explode("labels").alias("l"), F.pmod("block", F.lit(SALTS)).cast("int").alias("salt"))
    same = materialize(mine.join(theirs, ["l", "salt"]).select("i", "j").distinct(), "negatives-same")
    found = tiles(same, (a_meta, a_chunks), (r_meta, r_chunks), None, lambda t, a, r, w: best_positives(t, a, r, POSITIVES), "i bigint, uid bigint, pos_uid bigint, pos_vec bigint, pos_score bigint")
    best = W.Window.partitionBy("uid").orderBy(F.desc("pos_score"), F.asc_nulls_last("pos_vec"), "pos_uid")
    positives = found.withColumn("at", F.row_number().over(best)).where(F.col("at") <= POSITIVES).drop("at")
    positives = materialize(positives, "negatives-positives")

    # the windows of an anchor block go along with its tiles

    def gather(table: pa.Table) -> pa.Table:
        has = table["pos_vec"].is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
        made = [table["uid"].to_numpy(), table["pos_uid"].to_numpy(), table["pos_vec"].fill_null(0).to_numpy(), has, table["pos_score"].to_numpy()]
        return pa.table([pa.array([table["i"][0].as_py()], pa.int64()), *(pa.array([m.astype(np.int64).tobytes()], pa.binary()) for m in made)], names=["i", "uid", "pos_uid", "pos_vec", "has_pos", "score"])

    windows = positives.groupBy("i").applyInArrow(gather, "i bigint, uid binary, pos_uid binary, pos_vec binary, has_pos binary, score binary")
    windows = materialize(windows, "negatives-windows")
    every = r_meta.select(F.col("block").alias("j"), F.col("pure").alias("rp"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(n_a, 1) - 1).cast("long"))).alias("i"))
    other = every.join(a_meta.select(F.col("block").alias("i"), F.col("pure").alias("ap")), "i").where("NOT coalesce(ap = rp, false)").select("i", "j")
    other = materialize(other, "negatives-other")
    fields = "i bigint, uid bigint, pos_uid bigint, anchor_id bigint, positive_id bigint, positive_score bigint, neg_uid bigint, negative_id bigint, negative_score bigint"
    mined = tiles(other, (a_meta, a_chunks), (r_meta, r_chunks), windows, lambda t, a, r, w: best_negatives(t, a, r, w, NEGATIVES), fields)
    best = W.Window.partitionBy("uid", "pos_uid").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"), "neg_uid")
    return mined.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= NEGATIVES).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    return hard_negatives(load(spark, sf_dir, "embeddings"))


SQL = """
WITH rows_in AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), v AS (
  SELECT r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(e, lambda x: floor(256 * x)::BIGINT) AS e
  FROM rows_in WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scores AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id AS other_id, a.label = b.label AS same,
         list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.r <> b.r
), positives AS (
  SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.other_id AS positive_id, row_number() OVER (PARTITION BY p.ar, p.br ORDER BY n.score DESC, n.other_id)::INTEGER AS rank,
       n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON n.ar = p.ar AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5
"""
