"""Mixing sources to target weights by Pareto order sampling.

A source's target is a number of words. Inside a source the copies that a document should get fall with its
size, by TILT for each doubling, so that a source is spread over many documents: with e copies for a size
class, the sum of e times the class's words is the target. The whole part of e is certain, the rest is the
inclusion probability pi of one more copy. Documents are ranked by (u / (1 - u)) / (pi / (1 - pi)) with u a
hash of the document; the first of the ranking are taken until the source's missing words are filled (the
fixed size of the sample, in words). Where the next document is larger than what is open, that goes to
documents behind it that fit, the next ones of each size class, at most LANES.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import load, materialize

# Weights of the sources in order of their names, repeating; most copies of a document.
WEIGHTS = (5, 2, 1)
MOST = 3
TILT = 0.25  # a document of twice the size gets 2 ** -TILT times the copies
BITS = 14  # of the ranking; only the bucket where a source's words run out is ranked row by row
LANES = 8  # documents of a size class that may complete a sample
_STEPS = 1 << 52
_NONE = 1e-9  # inclusion probabilities from here on count


def words_in(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """1 + the whole part of the binary logarithm; a document without words is of the first class."""
    return F.length(F.bin(F.greatest(size, F.lit(1)))).cast("int")


def draw(doc_id: str = "doc_id", text: str = "text") -> Column:
    """u as an integer below 2^52, the same in every run; rows that share an id but not a text draw apart."""
    key = F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.coalesce(F.xxhash64(text), F.lit(0)).cast("string"), F.lit("mix"))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long")


def ranking(u: Column, pi: Column) -> Column:
    """The place of a document in the ranking as an integer below 2^52: the odds of u divided by the inclusion
    odds, o, as o / (1 + o). Null where nothing is left to chance."""
    x = (u + 0.5) / _STEPS
    odds = (x / (1 - x)) / (pi / (1 - pi))
    return F.when(pi >= _NONE, F.least(F.floor(odds / (1 + odds) * _STEPS), F.lit(_STEPS - 1)).cast("long"))


def running(rows: DataFrame, order: list[Column], sums: list[str], name: str) -> DataFrame:
    """Adds place (from 0) and, for every column of ``sums``, before_<column>: its sum over the rows before.

    The order is total. Rows are dealt by range; only one row of totals a partition reaches the driver, and
    a window never holds more than one range.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = materialize(dealt.withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()), name)
    totals = dealt.groupBy("__part").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sums]).orderBy("__part").collect()
    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema.fields}
    first, seen = [], [0, *(0.0 if kinds[c] == "double" else 0 for c in sums)]
    for r in totals:
        first.append((r["__part"], *seen))
        seen = [a + b for a, b in zip(seen, r[1:], strict=True)]
    ddl = ", ".join(["__part int", "__n bigint", *(f"__first_{c} {kinds[c]}" for c in sums)])
    starts = F.broadcast(rows.sparkSession.createDataFrame(first or [(-1, *seen)], ddl))  # a row a partition
    own = W.Window.partitionBy("__part").orderBy("__row")
    out = dealt.join(starts, "__part").withColumn("place", F.col("__n") + F.row_number().over(own) - 1)
    for c in sums:
        out = out.withColumn(f"before_{c}", F.col(f"__first_{c}") + F.coalesce(F.sum(c).over(own.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)))
    return out.drop("__part", "__row", "__n", *(f"__first_{c}" for c in sums))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target of every source; one row a source, any number of sources.

    Words go by weight; a source whose share would pass MOST times its size stops there and the excess
    is dealt again by weight. That fills sources in order of MOST * size / weight, which running sums
    find at once. Sources are ordered by code point (binary), null last.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = running(by, [F.col("source").isNull(), F.col("source").cast("binary")], [], "mix-sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), F.pmod("place", F.lit(len(WEIGHTS))).cast("int") + 1)
    by = by.select("source", "source_size", weight.alias("weight"))
    by = running(by, [F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary")], ["source_size", "weight"], "mix-levels")
    every = by.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    # the level that the sources from here on would share; the first that does not stop sets it for the rest
    level = (F.lit(every["s"] or 0) - MOST * F.col("before_source_size")) / (F.lit(every["w"] or 0.0) - F.col("before_weight"))
    by = by.withColumn("level", level).withColumn("stops", MOST * F.col("source_size") <= F.col("level") * F.col("weight"))
    final = by.where("NOT stops").agg(F.min(F.struct("place", "level")).alias("x")).first()["x"]
    cap = (MOST * F.col("source_size")).cast("double")
    shared = F.least(cap, F.lit(final["level"]) * F.col("weight")) if final else cap
    return by.select("source", "source_size", F.when(F.col("stops"), cap).otherwise(shared).alias("target"))


def rates(sizes: DataFrame) -> DataFrame:
    """r_source, class, source_size, target, copies, pi of every source and size class; sizes: source, size, class."""
    t = targets(sizes).withColumnRenamed("source", "r_source")
    words = sizes.groupBy("source", "class").agg(F.sum("size").alias("words"))
    rows = words.join(t, F.col("source").eqNullSafe(F.col("r_source"))).withColumn("g", F.pow(F.lit(2.0), -TILT * F.col("class")))
    own = W.Window.partitionBy("r_source")  # at most 64 classes a source
    before = own.orderBy("class").rowsBetween(W.Window.unboundedPreceding, -1)
    tilted = F.col("words") * F.col("g")
    # classes below are at MOST copies; the rest would share the open words in proportion to g
    open_ = F.col("target") - MOST * F.coalesce(F.sum("words").over(before), F.lit(0))
    share = open_ / F.nullif(F.sum(tilted).over(own) - F.coalesce(F.sum(tilted).over(before), F.lit(0.0)), F.lit(0.0))
    rows = rows.withColumn("share", F.coalesce(share, F.lit(0.0))).withColumn("full", F.col("share") * F.col("g") >= MOST - _NONE)
    a = F.min(F.when(~F.col("full"), F.struct("class", "share"))).over(own)["share"]
    copies = F.when(F.col("full") | a.isNull(), F.lit(float(MOST))).otherwise(F.least(F.lit(float(MOST)), F.greatest(F.lit(0.0), a * F.col("g"))))
    rows = rows.withColumn("e", F.when(F.col("target") > 0, copies).otherwise(0.0))
    whole = F.floor(F.col("e") + _NONE).cast("long")
    return rows.select("r_source", F.col("class").alias("r_class"), "source_size", "target", "words", whole.alias("copies"), F.greatest(F.lit(0.0), F.col("e") - whole).alias("pi"))


def plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, source, size, source_size, target, copies, v of every row; rates by source and class; plan by source).

    A plan says where the ranking of a source ends: bucket, the last place inside it (v, doc_id) and the
    documents behind it that complete the sample.
    """
    small = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words_in(text).alias("size"), draw(doc_id, text).alias("u"))
    small = materialize(small.withColumn("class", size_class(F.col("size"))), "mix-sizes")
    r = materialize(rates(small), "mix-rates")
    same = F.col("source").eqNullSafe(F.col("r_source")) & (F.col("class") == F.col("r_class"))
    rows = small.join(r, same).select("doc_id", "source", "size", "class", "source_size", "target", "copies", ranking(F.col("u"), F.col("pi")).alias("v"))
    rows = materialize(rows, "mix-rows")
    left = r.groupBy(F.col("r_source").alias("p_source")).agg((F.first("target") - F.sum(F.col("copies") * F.col("words"))).alias("missing"))
    # words by source and bucket: sums, so a hot source is added up where its rows lie
    bucket = F.shiftright("v", 52 - BITS)
    ranked = rows.where("v IS NOT NULL")
    sums = ranked.groupBy(F.col("source").alias("s_source"), bucket.alias("bucket")).agg(F.sum("size").alias("s"))
    sums = sums.withColumn("upto", F.sum("s").over(W.Window.partitionBy("s_source").orderBy("bucket")))  # at most 2 ** BITS rows a source
    same = F.col("p_source").eqNullSafe(F.col("s_source"))
    last = sums.join(left, same).where("upto > missing").groupBy("p_source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("s")).alias("before"))).alias("x"))
    bounds = left.join(last.withColumnRenamed("p_source", "s_source"), same, "left").select("p_source", "missing", "x.bucket", "x.before")
    bounds = materialize(bounds, "mix-bounds")
    # only the rows of that bucket are ranked one by one
    edge = ranked.join(bounds.where("bucket IS NOT NULL"), F.col("p_source").eqNullSafe(F.col("source")) & (bucket == F.col("bucket")))
    edge = edge.groupBy("p_source", "v", "doc_id", "before", "missing").agg(F.sum("size").alias("size"))
    edge = edge.withColumn("upto", F.col("before") + F.sum("size").over(W.Window.partitionBy("p_source").orderBy("v", "doc_id")))
    within = F.col("upto") <= F.col("missing")
    ends = edge.groupBy(F.col("p_source").alias("s_source")).agg(F.max(F.when(within, F.struct("v", F.col("doc_id").isNotNull().alias("some"), "doc_id"))).alias("last"), F.max(F.when(within, F.col("upto"))).alias("upto"))
    out = bounds.join(ends, same, "left").withColumn("open", F.when(F.col("bucket").isNull(), F.lit(0.0)).otherwise(F.col("missing") - F.coalesce("upto", "before")))
    out = materialize(out.select("p_source", "missing", "bucket", "last", "open"), "mix-ends")
    rest = ranked.join(out.where("open > 0"), F.col("source").eqNullSafe(F.col("p_source"))).where(~_inside(F.col("v"), F.col("doc_id")))
    rest = rest.groupBy("p_source", "open", "class", "v", "doc_id").agg(F.sum("size").alias("size")).where("size > 0 AND size < 2 * open")
    lane = F.pmod(F.xxhash64("v", "doc_id"), F.lit(LANES))
    rest = rest.groupBy("p_source", "open", "class", lane.alias("lane")).agg(F.min(F.struct("v", "doc_id", "size")).alias("c"))
    rest = rest.groupBy(F.col("p_source").alias("s_source")).agg(F.first("open").alias("gap"), F.sort_array(F.collect_list(F.struct("c.size", "c.v", "c.doc_id")), False).alias("fits"))  # at most LANES a class
    extra = rest.select("s_source", _completing(F.col("fits"), F.col("gap")).alias("extra"))
    return rows, r, materialize(out.join(extra, same, "left").select("p_source", "missing", "bucket", "last", "extra"), "mix-plan")


def _completing(fits: Column, gap: Column) -> Column:
    """Of the documents, largest first, those that fit into what is open, and one more if it brings the words nearer."""
    none = F.filter(fits, lambda x: F.lit(False))

    def step(acc, x):
        fit = x["size"] <= acc["open"]
        return F.struct(F.when(fit, acc["open"] - x["size"]).otherwise(acc["open"]).alias("open"), F.when(fit, F.concat(acc["got"], F.array(x))).otherwise(acc["got"]).alias("got"))

    done = F.aggregate(fits, F.struct(gap.cast("double").alias("open"), none.alias("got")), step)
    near = F.filter(F.array_except(fits, done["got"]), lambda x: x["size"] < 2 * done["open"])
    best = F.array_min(F.transform(near, lambda x: F.struct(F.abs(x["size"] - done["open"]).alias("off"), x.alias("x"))))
    return F.when(best.isNull(), done["got"]).otherwise(F.concat(done["got"], F.array(best["x"])))


def _inside(v: Column, doc_id: Column) -> Column:
    """True where the ranking of the source's plan takes the document."""
    at = F.shiftright(v, 52 - BITS)
    # no bucket: the missing words are all there are
    sure = F.when(v.isNull(), False).when(F.col("bucket").isNull(), F.col("missing") > 0).when(at < F.col("bucket"), True).when(at > F.col("bucket"), False)
    not_after = doc_id.isNull() | F.coalesce(doc_id <= F.col("last.doc_id"), F.lit(False))
    return sure.otherwise(F.coalesce((v < F.col("last.v")) | ((v == F.col("last.v")) & not_after), F.lit(False)))


def total_copies(v: Column, doc_id: Column) -> Column:
    """Copies of a row joined with its source's rates and plan: the certain ones and one more if it is sampled."""
    completes = F.coalesce(F.exists("extra", lambda x: (x["v"] == v) & x["doc_id"].eqNullSafe(doc_id)), F.lit(False))
    return F.col("copies") + (_inside(v, doc_id) | completes).cast("long")


def with_copies(docs: DataFrame, out: str = "copies_taken", doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows, all columns, with one more that says how often the mix takes them.

    Rates and plan hold a few rows a source. Where Spark's own size check lets them be broadcast, texts stay
    where they are; with more sources they are joined by source and size class.
    """
    _, r, p = plan(docs, doc_id, text, source)
    own = [f"__own_{c}" for c in docs.columns]
    rows = docs.select(*[F.col(c).alias(o) for c, o in zip(docs.columns, own, strict=True)], size_class(words_in(text)).alias("__class"), draw(doc_id, text).alias("__u"))
    rows = rows.join(r, F.col(f"__own_{source}").eqNullSafe(F.col("r_source")) & (F.col("__class") == F.col("r_class")))
    rows = rows.join(p, F.col(f"__own_{source}").eqNullSafe(F.col("p_source")))
    n = total_copies(ranking(F.col("__u"), F.col("pi")), F.col(f"__own_{doc_id}"))
    return rows.select(*[F.col(o).alias(c) for c, o in zip(docs.columns, own, strict=True)], n.alias(out))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every row.

    A null, empty or wordless text has size 0 and takes 0 words. A null source is a source of its own.
    Repeated rows (id and text) are taken together, rows that share only the id each by itself; equal
    places in the ranking go by id. An empty table gives no rows, other columns are not read. Reruns
    agree: the draw is a hash of id and text.
    """
    rows, _, p = plan(docs, doc_id, text, source)
    rows = rows.join(p, F.col("source").eqNullSafe(F.col("p_source"))).withColumn("n", total_copies(F.col("v"), F.col("doc_id")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("n") * F.col("size")).alias("taken"), F.col("n").alias("copies"))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents"))
