"""MinHash near-dedup by a chosen-path set similarity join.

Documents with equal shingle sets are one class first. In each of TREES independent trees a node picks
random minwise positions, each with probability 1 / (LAMBDA * POSITIONS), and its documents branch by the
minwise token at every picked position; two documents of similarity LAMBDA or more so keep meeting with
probability bounded below at every level. Nodes of at most LEAF documents are compared exhaustively on
sketches. A larger node in which all but LEAF documents are candidates of its least one (a group of near
copies, say) is settled too: those few are compared with all. All others branch on, and what still stays
together at DEPTH shared tokens is taken as similar. The candidate groups are then confirmed exactly on full shingle sets, where pairs already
connected need no comparison. Groups too large for a task are confirmed in blocks that share pivots,
and whatever that leaves outside a group's largest part is dealt into tiles, each of which meets each block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, connected_components, load, map_texts, materialize

WIDTH = 4  # words of a shingle
NUMERATOR, DENOMINATOR = 80, 100  # similarity at least
LAMBDA = NUMERATOR / DENOMINATOR
POSITIONS = 64
SKETCH = 32  # positions that the leaves compare, 16 bits each
SKETCH_AT = 15  # equal lanes of a candidate; below it a pair of similarity 0.8 falls once in 10^5
TREES = 20
LEAF = 200
DEPTH = 4
BLOCK = 400  # documents a task confirms at once
BLOCK_SHINGLES = 1_500_000
PIVOTS = 4
BITMAP, PAGE = 1 << 26, 1 << 15  # bits of the filter of texts, and of a page of it
SIGNATURE_AT = 36  # equal positions of a pair worth confirming; one of similarity 0.8 has fewer once in 10^6

_rng = np.random.default_rng(20240607)
_A = (_rng.integers(0, 1 << 32, POSITIONS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, POSITIONS, dtype=np.uint64).astype(np.uint32)
_K = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(raw: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text; A-Z count as a-z."""
    ws = (raw or b"").translate(LOWER).split()
    if not ws:
        return np.zeros(0, np.uint64)
    if len(ws) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(ws), len(ws))], np.uint64)
    h = np.array([xxhash.xxh64_intdigest(w) for w in ws], np.uint64)
    n = len(h) - width + 1
    s = h[:n].copy()
    for i in range(1, width):
        s *= _K
        s += h[i : n + i]
    s ^= s >> np.uint64(29)
    s *= _M
    s ^= s >> np.uint64(32)
    return np.unique(s)


def signature(s: np.ndarray) -> np.ndarray:
    """POSITIONS minwise tokens of a non-empty set."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(POSITIONS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(out, (x[at : at + 2048, None] * _A + _B).min(axis=0), out=out)
    return out


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 80 * union, on full sets."""
    n, m = len(a), len(b)
    if DENOMINATOR * min(n, m) < NUMERATOR * max(n, m):
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return DENOMINATOR * shared >= NUMERATOR * (n + m - shared)


def text_hash(text: str = "text") -> Column:
    """Tells apart the texts of rows that share an id."""
    return F.xxhash64(F.col(text).cast("binary"))


def _sets(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, h (hash of the text), n_shingles, key (of the set), sig for every row, written once."""

    def run(texts):
        n, keys, sigs = [], [], []
        for t in texts:
            s = shingles(t)
            n.append(len(s))
            keys.append(xxhash.xxh128_digest(s.tobytes()) if len(s) else None)
            sigs.append(signature(s).view(np.int32) if len(s) else None)
        return [n, keys, sigs]

    return materialize(map_texts(docs, {"doc_id": F.col(doc_id).cast("long"), "h": text_hash(text)}, "n_shingles bigint, key binary, sig array<int>", run, text), "sets")


def _branch(members: DataFrame, reps: DataFrame) -> DataFrame:
    """Children (node, rep) of the nodes' documents, by the positions that each node picks."""
    at_most = int((1 << 20) / (LAMBDA * POSITIONS))
    picks = F.filter(F.sequence(F.lit(0), F.lit(POSITIONS - 1)), lambda p: F.pmod(F.xxhash64("node", p), F.lit(1 << 20)) < at_most)
    # a node that would pick nothing picks one position, so that no pair is lost to an empty draw
    picks = F.when(F.size(picks) > 0, picks).otherwise(F.array(F.pmod(F.xxhash64("node", F.lit("one")), F.lit(POSITIONS)).cast("int")))
    rows = members.join(reps.select("rep", "sig"), "rep").select("node", "rep", "sig", F.explode(picks).alias("p"))
    return rows.select(F.xxhash64("node", "p", F.get("sig", F.col("p"))).alias("node"), "rep")


def _leaf_edges(leaves: DataFrame, reps: DataFrame) -> DataFrame:
    """Exhaustive comparison inside every small node; one edge a document to the least of its candidates."""
    rows = leaves.join(reps.select("rep", "n", "sk"), "rep").select("node", "rep", "n", "sk")
    rows = rows.repartition("node").sortWithinPartitions("node", "rep")

    def edges(batches):
        carry = None
        for b in batches:
            got = [b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).flatten().to_numpy().reshape(-1, SKETCH)]
            if not len(got[0]):
                continue
            if carry is not None:
                got = [np.concatenate(x) for x in zip(carry, got, strict=True)]
            cut = int(np.searchsorted(got[0], got[0][-1]))  # the last node may go on
            carry = [x[cut:] for x in got]
            if cut:
                yield compare(*(x[:cut] for x in got))
        if carry is not None:
            yield compare(*carry)

    def compare(node, rep, n, sk):
        left, right = [], []
        for k in range(1, len(node)):
            i = np.flatnonzero(node[:-k] == node[k:])
            if not len(i):
                break
            j = i + k
            fit = (DENOMINATOR * np.minimum(n[i], n[j]) >= NUMERATOR * np.maximum(n[i], n[j])) & ((sk[i] == sk[j]).sum(axis=1) >= SKETCH_AT)
            left.append(i[fit])
            right.append(j[fit])
        i, j = (np.concatenate(x) if x else np.zeros(0, int) for x in (left, right))
        label = np.arange(len(node))
        while len(i):
            low = np.minimum(label[i], label[j])
            if (label[i] == low).all() and (label[j] == low).all():
                break
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
        at = np.flatnonzero(label != np.arange(len(node)))
        return pa.RecordBatch.from_pydict({"a": pa.array(rep[at], pa.int64()), "b": pa.array(rep[label[at]], pa.int64())})

    return rows.mapInArrow(edges, "a bigint, b bigint")


def _beside_least(large: DataFrame, reps: DataFrame, depth: int) -> DataFrame:
    """node, rep, low, c of the large nodes with near (the document is a candidate of the node's least one) and
    far (how many of the node are not)."""
    least = large.groupBy("node").agg(F.first("low").alias("low"))
    least = least.join(reps.select(F.col("rep").alias("low"), F.col("sk").alias("l_sk"), F.col("n").alias("l_n")), "low").drop("low")
    rows = large.join(reps.select("rep", "n", "sk"), "rep").join(least, "node")
    equal = F.size(F.filter(F.zip_with("sk", "l_sk", lambda a, b: a == b), lambda same: same))
    near = (equal >= SKETCH_AT) & (DENOMINATOR * F.least("n", "l_n") >= NUMERATOR * F.greatest("n", "l_n"))
    rows = materialize(rows.select("node", "rep", "low", "c", near.alias("near")), f"beside-{depth}")
    far = rows.groupBy("node").agg(F.count_if(~F.col("near")).alias("far"))
    return rows.join(far, "node").withColumn("leaf", F.lit(LEAF))


def _outsiders(held: DataFrame) -> DataFrame:
    """Leaves (node, rep) in which the few documents of a large node that are no candidates of its least one meet
    all others, a part of them in each leaf."""
    parts = F.ceil(F.col("c") / LEAF).cast("int")
    part = F.explode(F.when(F.col("near"), F.array(F.pmod(F.xxhash64("rep", F.lit(3)), parts).cast("int"))).otherwise(F.sequence(F.lit(0), parts - 1)))
    return held.select("node", "rep", part.alias("part")).select(F.xxhash64("node", F.lit("part"), "part").alias("node"), "rep")


def candidate_edges(reps: DataFrame, trees: int = TREES) -> DataFrame:
    """Edges (a, b) that connect every group of candidates; reps: rep, n, sig, sk (the sketch)."""
    rng = np.random.default_rng(99)
    first = []
    for t in range(trees):
        picked = np.flatnonzero(rng.random(POSITIONS) < 1 / (LAMBDA * POSITIONS))
        first += [(t, int(p)) for p in (picked if len(picked) else [rng.integers(POSITIONS)])]
    roots = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in first]))
    members = reps.select("rep", "sig", roots.alias("r")).select(F.xxhash64("r.t", "r.p", F.get("sig", F.col("r.p"))).alias("node"), "rep")
    small, edges = [], []
    for depth in range(1, DEPTH + 1):
        sizes = members.groupBy("node").agg(F.count("*").alias("c"), F.min("rep").alias("low")).where("c > 1")
        members = materialize(members.join(sizes, "node"), f"paths-{depth}")
        small.append(members.where(F.col("c") <= LEAF).select("node", "rep"))
        large = members.where(F.col("c") > LEAF)
        if large.isEmpty():
            break
        if depth == DEPTH:
            edges.append(large.where("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b")))
        else:
            held = _beside_least(large, reps, depth)
            edges.append(held.where("far <= leaf AND near AND rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b")))
            small.append(_outsiders(held.where("far BETWEEN 1 AND leaf")))
            members = materialize(_branch(held.where("far > leaf").select("node", "rep"), reps), f"branches-{depth}")
    leaves = small[0]
    for s in small[1:]:
        leaves = leaves.union(s)
    out = _leaf_edges(leaves, reps)
    for e in edges:
        out = out.union(e)
    return out


def _confirm(rep: np.ndarray, sets: list[np.ndarray], sig: np.ndarray, label: np.ndarray, wander: np.ndarray) -> np.ndarray:
    """The least connected rep or label of every row of one group; reps in ascending order.

    Equal labels are connected already. If any row is a wanderer, only pairs with one are compared. Pairs
    that differ too much in size or in the signature need no comparison of full sets.
    """
    n = np.array([len(x) for x in sets])
    group = np.unique(label, return_inverse=True)[1]
    some = wander.any()
    for i in range(1, len(rep)):
        fit = (group[:i] != group[i]) & (DENOMINATOR * np.minimum(n[:i], n[i]) >= NUMERATOR * np.maximum(n[:i], n[i]))
        if some and not wander[i]:
            fit &= wander[:i]
        at = np.flatnonzero(fit)
        agree = (sig[at] == sig[i]).sum(axis=1)
        near = agree >= SIGNATURE_AT
        for j in at[near][np.argsort(-agree[near], kind="stable")]:
            if group[j] != group[i] and similar(sets[i], sets[j]):
                group[group == group[i]] = group[j]
    low = np.full(len(rep), np.iinfo(np.int64).max)
    np.minimum.at(low, group, np.minimum(rep, label))
    return low[group]


def _confirmed(assigned: DataFrame) -> DataFrame:
    """Edges (comp, rep, label) found inside groups of full sets.

    assigned: bundle, block, tile (a task each), comp, rep, label, wander, sig, s.
    """

    def run(table: pa.Table) -> pa.Table:
        comp, rep, label, wander = (table[c].to_numpy() for c in ("comp", "rep", "label", "wander"))
        sig = table["sig"].combine_chunks().flatten().to_numpy().reshape(-1, POSITIONS)
        raw = table["s"].to_pylist()
        order = np.lexsort((~wander, rep, comp))
        first = np.append(True, (comp[order][1:] != comp[order][:-1]) | (rep[order][1:] != rep[order][:-1]))
        order = order[first]  # a wanderer that is at home in this block stands here once
        out = []
        for part in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1):
            if len(part) > 1:
                low = _confirm(rep[part], [np.frombuffer(raw[i], np.uint64) for i in part], sig[part], label[part], wander[part])
                moved = low < label[part]
                out.append((comp[part][moved], rep[part][moved], low[moved]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table({k: pa.array(c, pa.int64()) for k, c in zip(("comp", "rep", "label"), columns, strict=True)})

    return assigned.groupBy("bundle", "block", "tile").applyInArrow(run, "comp bigint, rep bigint, label bigint")


def _perhaps_among(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key may be one of ``keys``, told by a bitmap of hashes, so that texts nobody asks for are not shuffled.

    The bitmap is BITMAP bits in pages of PAGE bits, 8 MB in all at any number of keys, and is broadcast; where keys are so
    many that it fills, more rows pass, and the join behind it decides as before.
    """
    bit = F.pmod(F.xxhash64(*on, F.lit(5)), F.lit(BITMAP)).cast("int")
    page, at = (bit / PAGE).cast("int"), bit % PAGE

    def pack(table: pa.Table) -> pa.Table:
        w = table["at"].to_numpy()
        bits = np.zeros(PAGE // 8, np.uint8)
        np.bitwise_or.at(bits, w >> 3, (1 << (w & 7)).astype(np.uint8))
        return pa.table({"page": pa.array([table["page"][0].as_py()], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary())})

    pages = keys.select(page.alias("page"), at.alias("at")).distinct().groupBy("page").applyInArrow(pack, "page int, bits binary")
    met = rows.withColumn("__page", page).withColumn("__at", at).join(F.broadcast(pages), F.col("__page") == F.col("page"))  # at most BITMAP / PAGE rows
    byte = F.conv(F.hex(F.substring("bits", (F.col("__at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.where(F.bit_get(byte, F.col("__at") % 8) == 1).select(*rows.columns)


def components(sets: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, component, group) of every set that more than one row shares or that has a link.

    component is the least id of the linked sets, group tells apart components that share a least id.
    """
    usable = sets.where("key IS NOT NULL AND doc_id IS NOT NULL")
    reps = usable.groupBy("key").agg(F.min(F.struct("doc_id", "h")).alias("least"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    # a set is a node of its own, also where one id has several texts
    reps = reps.select("key", "copies", "n", "sig", F.col("least.doc_id").alias("least"), F.col("least.h").alias("h"), F.monotonically_increasing_id().alias("rep"))
    sketch = F.transform(F.slice("sig", 1, SKETCH), lambda x: (x.bitwiseAND(0xFFFF) - 32768).cast("short"))
    reps = materialize(reps.withColumn("sk", sketch), "classes")
    found = connected_components(candidate_edges(reps), "candidates")
    sized = reps.select("rep", "n").join(found, F.col("rep") == F.col("node")).select("rep", "n", F.col("component").alias("comp"))
    members = materialize(sized, "members")
    loads = members.groupBy("comp").agg(F.count("*").alias("m"), F.sum("n").alias("s"), *[F.min(F.struct(F.xxhash64("rep", F.lit(i)), "rep")).alias(f"p{i}") for i in range(PIVOTS)])
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int")
    dealt = members.join(loads, "comp").withColumn("blocks", blocks)
    pivot = F.greatest(*[(F.col(f"p{i}.rep") == F.col("rep")).cast("int") for i in range(PIVOTS)]) == 1
    own = F.pmod(F.xxhash64("rep", F.lit(77)), F.col("blocks")).cast("int")
    dealt = materialize(dealt.select("comp", "rep", "n", "blocks", pivot.alias("pivot"), own.alias("own")), "dealt")
    docs_in = max(1, dealt.count())
    # the text of each set: its least document's, and of that one's texts the one that has this set
    places = ["rep", "n", "comp", "blocks", "pivot", "own"]
    keys = reps.select("rep", "least", "h", "sig").join(dealt, "rep")
    texts = docs.select(F.col(doc_id).cast("long").alias("least"), text_hash(text).alias("h"), F.col(text).cast("binary").alias("b"))
    # no semi-join behind the filter: it would be moved in front of it, and all texts would be shuffled
    texts = _perhaps_among(texts, keys, ["least", "h"]).groupBy("least", "h").agg(F.first("b").alias("b")).join(keys, ["least", "h"]).select(*places, "sig", "b")
    full = map_texts(texts, {c: F.col(c) for c in [*places, "sig"]}, "s binary", lambda ts: [[shingles(t).tobytes() for t in ts]], "b")
    full = materialize(full, "full-sets")  # with its places, so that it is shuffled once
    # small groups go in bundles of about BLOCK documents; large ones by block, pivots to each block
    bundle = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("comp"), F.lit(math.ceil(docs_in / BLOCK)))).otherwise(F.col("comp"))
    block = F.explode(F.when(F.col("pivot"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own")))
    assigned = full.select(bundle.alias("bundle"), "comp", block.alias("block"), F.lit(0).alias("tile"), "rep", F.col("rep").alias("label"), F.lit(False).alias("wander"), "blocks", "sig", "s")
    assigned = assigned.withColumn("block", F.when(F.col("blocks") == 1, -1).otherwise(F.col("block"))).drop("blocks")
    linked = materialize(_confirmed(assigned), "linked")
    big = dealt.where("blocks > 1").select("comp", "rep", "n", "blocks", "own")
    if not big.isEmpty():
        linked = materialize(_across(linked, big, full.where("blocks > 1").select("rep", "sig", "s")), "linked-across")
    final = linked.groupBy("rep").agg(F.min("label").alias("group"))
    grouped = reps.join(final, "rep", "left").select("key", "least", "copies", F.coalesce("group", "rep").alias("group"))
    least = grouped.groupBy("group").agg(F.min("least").alias("component"), F.sum("copies").alias("rows")).where("rows > 1")
    return grouped.join(least, "group").select("key", "component", "group")


def _across(linked: DataFrame, big: DataFrame, full: DataFrame) -> DataFrame:
    """Joins the blocks of large groups: labels meet over the pivots, then the documents outside their
    group's largest label are dealt into tiles and every tile meets every block, a task each."""
    of_big = linked.join(big.select("comp").distinct(), "comp", "left_semi")
    rest = linked.join(big.select("comp").distinct(), "comp", "left_anti")

    def settled(edges: DataFrame, name: str) -> DataFrame:
        got = connected_components(edges.where("rep <> label").select(F.col("rep").alias("a"), F.col("label").alias("b")), name)
        return materialize(big.join(got, F.col("rep") == F.col("node"), "left").select("comp", "rep", "n", "blocks", "own", F.coalesce("component", "rep").alias("label")), name)

    now = settled(of_big, "across")
    sizes = now.groupBy("comp", "label").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    most = sizes.groupBy("comp").agg(F.max(F.struct("m", "s", "label")).alias("top"), F.count("*").alias("labels"), F.sum("m").alias("m"), F.sum("s").alias("s")).where("labels > 1")
    tiles = F.greatest(F.ceil((F.col("m") - F.col("top.m")) / BLOCK), F.ceil((F.col("s") - F.col("top.s")) / BLOCK_SHINGLES)).cast("int")
    most = materialize(most.select("comp", F.col("top.label").alias("top"), tiles.alias("tiles")), "across-top")
    if not most.isEmpty():
        open_ = now.join(most, "comp")
        each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        home = open_.select("comp", F.col("own").alias("block"), each(F.col("tiles")).alias("tile"), "rep", "label", F.lit(False).alias("wander"))
        tile = F.pmod(F.xxhash64("rep", F.lit(78)), F.col("tiles")).cast("int")
        wanderers = open_.where("label <> top").select("comp", each(F.col("blocks")).alias("block"), tile.alias("tile"), "rep", "label", F.lit(True).alias("wander"))
        met = home.union(wanderers).withColumn("bundle", F.col("comp"))
        again = _confirmed(met.join(_perhaps_among(full, open_.select("rep"), ["rep"]), "rep"))
        edges = again.select("comp", "rep", "label").union(now.select("comp", "rep", "label"))
        now = settled(edges, "across-2")
    return rest.select("comp", "rep", "label").union(now.select("comp", "rep", "label"))


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, h, n_shingles, component_id, group (null where nothing is linked or equal) and kept for every row."""
    sets = _sets(docs, doc_id, text)
    groups = components(sets, docs, doc_id, text)
    out = sets.select("doc_id", "h", "n_shingles", "key").join(groups, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "h", "n_shingles", component.alias("component_id"), "group").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def minhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row.

    Null, empty and wordless texts and rows without an id link with nothing (component: the own id;
    kept, also where the id is null). Rows that share an id but not a set are linked each by its own
    text. Equal sets share a component at any number of copies.
    """
    return _rows(docs, doc_id, text).select("doc_id", "n_shingles", "component_id", "kept")


def survivors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, h) of one text of each group, and of every text that nothing is linked with or equal to; no null ids."""
    kept = _rows(docs, doc_id, text).where("kept AND doc_id IS NOT NULL")
    alone = kept.where("group IS NULL").select("doc_id", "h").distinct()
    return kept.where("group IS NOT NULL").groupBy("doc_id", "group").agg(F.min("h").alias("h")).select("doc_id", "h").union(alone)


def op7_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return minhash_groups(load(spark, sf_dir, "documents"))
