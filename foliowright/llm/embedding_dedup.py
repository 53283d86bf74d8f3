"""Embedding near-dedup: an exact metric range join with pivots.

On unit vectors cosine >= t is Euclidean distance <= eps = sqrt(2 - 2t). Identical vectors are one class
first. Every class belongs to the cell of its nearest pivot; it is also replicated to each lower-numbered
cell whose vectors it may reach: by the triangle inequality only if d(v, p) <= eps + radius(p) and
d(v, p) - d(v, home) <= 2 eps (sharpened by the distance to the bisecting hyperplane). Each pair so meets
in exactly one cell, and cells join independently, large cells in tiles. A tile compares by blocked
matrix products, counts links and emits one edge a vector, so no list of all pairs exists.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, load, materialize

THRESHOLD = 0.95
CELL = 4096  # classes a pivot stands for
MAX_PIVOTS = 512  # bound on what the driver holds
TILE = 8192  # home or member rows of one tile
_SLACK = 1e-6


def unit(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.reshape(-1, dim).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _vectors(column: pa.Array) -> np.ndarray:
    return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)


class Cells:
    """Assigns unit vectors to the cells of the pivots."""

    def __init__(self, pivots: np.ndarray, eps: float):
        self.pivots, self.eps = pivots, eps
        self.between = np.sqrt(np.maximum(1e-12, 2 - 2 * pivots @ pivots.T))
        self.radius = np.full(len(pivots), np.inf)

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d2 = np.maximum(0, 2 - 2 * x @ self.pivots.T)
        h = d2.argmin(axis=1)
        return d2, h, np.sqrt(d2[np.arange(len(x)), h])

    def reach(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of every membership; a vector's own cell and the lower cells it may reach."""
        d2, h, dh = self.home(x)
        d = np.sqrt(d2)
        lower = np.arange(len(self.pivots))[None, :] < h[:, None]
        near = (d <= self.radius + self.eps + _SLACK) & (d - dh[:, None] <= 2 * self.eps + _SLACK)
        near &= (d2 - (dh**2)[:, None]) <= 2 * self.between[h] * (self.eps + _SLACK)
        return np.nonzero((lower & near) | (np.arange(len(self.pivots))[None, :] == h[:, None]))


def tile_join(home: np.ndarray, member: np.ndarray, home_n, member_n, home_rep, member_rep, same_cell, t: float):
    """Link counts of both sides (member side: only those of other cells) and component labels of a tile."""
    h32, m32 = home.astype(np.float32), member.astype(np.float32)
    out_h, out_m = np.zeros(len(home), np.int64), np.zeros(len(member), np.int64)
    lab_h, lab_m = home_rep.copy(), member_rep.copy()
    for a in range(0, len(home), 256):
        s = h32[a : a + 256] @ m32.T
        link = s >= t + 1e-4
        i, j = np.nonzero((s >= t - 1e-4) & ~link)
        if len(i):
            sure = np.einsum("ij,ij->i", home[a + i], member[j]) >= t
            link[i[sure], j[sure]] = True
        out_h[a : a + 256] += link @ member_n
        out_m += home_n[a : a + 256] @ link
        for r in np.flatnonzero(link.sum(axis=1) > 0):
            got = lab_m[link[r]]
            low = min(got.min(), lab_h[a + r])
            if lab_h[a + r] != low or (got != low).any():
                old = np.unique(np.append(got, lab_h[a + r]))
                lab_m[np.isin(lab_m, old)] = low
                lab_h[np.isin(lab_h, old)] = low
    return out_h, np.where(same_cell, 0, out_m), lab_h, lab_m


def embedding_links(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept for every row.

    A vector that is null, empty, zero or holds a null or non-finite component links with nothing, nor
    does one with a null id (component null, kept). Vectors are joined once per length; those of unequal
    lengths stay unlinked. Repeated rows are linked with each other. All pairs at or above the threshold
    count, whatever the size of their group.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("e"))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    fine = F.col("vec_id").isNotNull() & F.coalesce(F.forall("e", number) & F.exists("e", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("ok", fine)
    sizes = rows.where("ok").groupBy(F.size("e").alias("d")).count().where("count > 1").orderBy("d").collect()  # a row a length
    alone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not sizes:
        return alone
    linked = [r["d"] for r in sizes]
    rows = rows.withColumn("ok", F.col("ok") & F.size("e").isin(linked))
    known = reduce(DataFrame.union, [_known(rows.where(F.col("ok") & (F.size("e") == d)), d, threshold) for d in linked])
    rest = rows.where("NOT ok").select("vec_id", F.lit(0).cast("long"), F.col("vec_id"), F.lit(True))
    out = rows.where("ok").join(known, "e").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return out.union(rest)


def _known(rows: DataFrame, dim: int, threshold: float) -> DataFrame:
    """e, n_links and component_id of every distinct vector of one length."""
    spark = rows.sparkSession
    classes = rows.groupBy("e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    total = classes.count()
    k = min(MAX_PIVOTS, max(1, math.ceil(total / CELL)))
    eps = math.sqrt(max(0.0, 2 - 2 * threshold))
    chosen = classes.orderBy(F.xxhash64("rep"), "cid").limit(k).collect()  # bounded by MAX_PIVOTS
    cells = Cells(unit(np.array([r["e"] for r in chosen], float).ravel(), dim), eps)

    def radii(batches):
        far = np.zeros(len(cells.pivots))
        for b in batches:
            if b.num_rows:
                _, h, d = cells.home(unit(_vectors(b.column(0)), dim))
                np.maximum.at(far, h, d)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(range(len(far)), pa.int32()), "r": pa.array(far)})

    for r in classes.select("e").mapInArrow(radii, "cell int, r double").groupBy("cell").agg(F.max("r").alias("r")).collect():
        cells.radius[r["cell"]] = r["r"]

    def memberships(batches):
        for b in batches:
            if b.num_rows:
                x = unit(_vectors(b.column(0)), dim)
                i, c = cells.reach(x)
                own = cells.home(x)[1][i] == c
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(own), *(b.column(q).take(pa.array(i)) for q in range(b.num_columns))], names=["cell", "own", *b.schema.names])

    e_type = classes.schema["e"].dataType.simpleString()
    counted = classes.select("e").mapInArrow(lambda bs: (x.select(["cell", "own"]) for x in memberships(bs)), "cell int, own boolean").groupBy("cell").agg(F.count_if("own").alias("h"), F.count("*").alias("m")).collect()
    split = {r["cell"]: (math.ceil(r["h"] / TILE), math.ceil(r["m"] / TILE)) for r in counted}  # at most MAX_PIVOTS
    parts = spark.createDataFrame([(c, max(1, h), max(1, m)) for c, (h, m) in split.items()] or [(0, 1, 1)], "cell int, sh int, sm int")
    placed = classes.select("e", "cid", "rep", "n").mapInArrow(memberships, f"cell int, own boolean, e {e_type}, cid bigint, rep bigint, n bigint").join(F.broadcast(parts), "cell")
    # a home row goes to its row of tiles, a member row (own or replicated) to its column
    hi, mj = F.pmod(F.xxhash64("cid"), F.col("sh")).cast("int"), F.pmod(F.xxhash64("cid", F.lit(1)), F.col("sm")).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    homes = placed.where("own").select("cell", hi.alias("i"), each(F.col("sm")).alias("j"), F.lit(True).alias("home"), "own", "e", "cid", "rep", "n")
    members = placed.select("cell", each(F.col("sh")).alias("i"), mj.alias("j"), F.lit(False).alias("home"), "own", "e", "cid", "rep", "n")

    def join(table: pa.Table) -> pa.Table:
        is_home = table["home"].to_numpy()
        x = unit(_vectors(table["e"]), dim)
        own, cid, rep, n = (table[c].to_numpy() for c in ("own", "cid", "rep", "n"))
        h, m = np.flatnonzero(is_home), np.flatnonzero(~is_home)
        out_h, out_m, lab_h, lab_m = tile_join(x[h], x[m], n[h], n[m], rep[h], rep[m], own[m], threshold)
        at = np.concatenate([h, m])
        links, label = np.concatenate([out_h, out_m]), np.concatenate([lab_h, lab_m])
        keep = (links > 0) | (label != rep[at])
        return pa.table({"cid": cid[at][keep], "rep": rep[at][keep], "links": links[keep], "label": label[keep]})

    tiles = materialize(homes.union(members).groupBy("cell", "i", "j").applyInArrow(join, "cid bigint, rep bigint, links bigint, label bigint"), "vector-tiles")
    links = tiles.groupBy("cid").agg(F.sum("links").alias("links"))
    found = connected_components(tiles.where("rep <> label").select(F.col("rep").alias("a"), F.col("label").alias("b")), "vectors")
    known = classes.join(links, "cid", "left").join(found, classes["rep"] == found["node"], "left")
    return known.select("e", (F.coalesce("links", "n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))


def op2_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return embedding_links(load(spark, sf_dir, "embeddings"))
