"""Evaluation analytics over judgements, records, defects and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import statistics as X
from .islands import fixed


def tally(judgements: DataFrame, groupings: list[list[str]], columns: list[str]) -> DataFrame:
    """wins, losses, ties, win rate and MQM per 100 words over several groupings at once (GROUPING SETS)."""
    cols = [F.col(c) for c in columns]
    sets = [[F.col(c) for c in g] for g in groupings]
    out = judgements.groupingSets(sets, *cols).agg(
        F.count_if(F.col("verdict") == "on").alias("wins"),
        F.count_if(F.col("verdict") == "off").alias("losses"),
        F.count_if(~F.col("verdict").isin("on", "off")).alias("ties"),
        F.sum("words").alias("words"),
        F.sum("mqm_on").alias("mqm_on"),
        F.sum("mqm_off").alias("mqm_off"),
        *[F.grouping(c).cast("int").alias(f"all_{c}") for c in columns],
    )
    per = F.greatest(F.lit(1.0), F.col("words") / 100)
    return out.withColumn("win_rate", F.col("wins") / F.greatest(F.lit(1), F.col("wins") + F.col("losses"))).withColumn("on_per_100", F.col("mqm_on") / per).withColumn("off_per_100", F.col("mqm_off") / per).withColumn("p", X.sign_test(F.col("wins"), F.col("wins") + F.col("losses")))


def panel(judgements: DataFrame, item: list[str]) -> DataFrame:
    """Majority of the judges by item; inconsistent counts as a tie."""
    return judgements.groupBy(*item).agg(F.count_if(F.col("verdict") == "on").alias("on"), F.count_if(F.col("verdict") == "off").alias("off")).withColumn("majority", F.when(F.col("on") > F.col("off"), "on").when(F.col("off") > F.col("on"), "off").otherwise("tie"))


def judge_reliability(judgements: DataFrame, item: list[str]) -> DataFrame:
    """By judge: share of decisive and of consistent verdicts, agreement with the majority of the others.

    The others' majority is the item's totals less the judge's own vote, so no judge-by-judge join is made.
    """
    w = W.Window.partitionBy(*item)
    own = lambda v: (F.col("verdict") == v).cast("int")
    on, off = F.sum(own("on")).over(w) - own("on"), F.sum(own("off")).over(w) - own("off")
    rows = judgements.withColumn("others", F.when(on > off, "on").when(off > on, "off").otherwise("tie")).withColumn("mine", F.when(F.col("verdict").isin("on", "off"), F.col("verdict")).otherwise("tie"))
    return rows.groupBy("judge").agg(
        F.count("*").alias("n"),
        F.avg((F.col("mine") != "tie").cast("int")).alias("decisive"),
        F.avg((F.col("verdict") != "inconsistent").cast("int")).alias("consistent"),
        F.avg((F.col("mine") == F.col("others")).cast("int")).alias("agreement"),
    )


def pairwise_kappa(judgements: DataFrame, item: list[str]) -> DataFrame:
    """Cohen's kappa of every two judges, by counts of verdict pairs on shared items."""
    a = judgements.select(*item, F.col("judge").alias("judge_a"), F.col("verdict").alias("va"))
    b = judgements.select(*item, F.col("judge").alias("judge_b"), F.col("verdict").alias("vb"))
    return X.cohen_kappa(a.join(b, item).where("judge_a < judge_b"), ["judge_a", "judge_b"], "va", "vb")


def category_points(judgements: DataFrame, errors: str, by: list[str]) -> DataFrame:
    """Weighted error points by category."""
    e = judgements.select(*by, F.explode(errors).alias("e"))
    return e.groupBy(*by, F.col("e.category").alias("category")).agg(F.sum(F.when(F.col("e.severity") == "critical", 10.0).when(F.col("e.severity") == "major", 5.0).otherwise(1.0)).alias("points"))


def decision(df: DataFrame) -> DataFrame:
    """Adds quality and recommendation from wins, losses, p_adj, items, affected and correctness."""
    quality = F.when(F.col("wins") + F.col("losses") > 0, F.when(F.col("p_adj") < 0.05, F.when(F.col("wins") > F.col("losses"), "better").otherwise("worse")).otherwise("no significant difference")).when(F.col("items") > 0, "no significant difference").otherwise("not judged")
    q, c = F.col("quality"), F.col("correctness")
    advice = (
        F.when(F.col("affected") == 0, "not exercised")
        .when(((q == "better") & (c == "worse")) | ((q == "worse") & (c == "better")), "review manually")
        .when((q == "better") | ((c == "better") & (q != "worse")), "on")
        .otherwise("off")
    )
    return df.withColumn("quality", quality).withColumn("recommendation", advice)


def defect_changes(before: DataFrame, after: DataFrame, expected: DataFrame | None = None, key: str = "defect") -> DataFrame:
    """new, fixed and (if no longer expected) retired defects of two runs."""
    b, a = before.select(key).distinct(), after.select(key).distinct()
    gone = b.join(a, key, "left_anti")
    new = a.join(b, key, "left_anti").withColumn("change", F.lit("new"))
    if expected is None:
        return new.union(gone.withColumn("change", F.lit("fixed")))
    e = expected.select(key).distinct()
    return new.union(gone.join(e, key, "left_semi").withColumn("change", F.lit("fixed"))).union(gone.join(e, key, "left_anti").withColumn("change", F.lit("retired")))


def latest_before(runs: DataFrame, history: DataFrame, by: list[str], at: str = "created_at") -> DataFrame:
    """For each run the latest snapshot strictly before it: one sort by key and time, no range join."""
    h = history.select(*by, F.col(at).alias("__t"), F.struct("*").alias("__s"), F.lit(0).alias("__run"))
    r = runs.select(*by, F.col(at).alias("__t"), F.lit(None).cast(h.schema["__s"].dataType).alias("__s"), F.lit(1).alias("__run"))
    strict = W.Window.partitionBy(*by).orderBy("__t", F.desc("__run")).rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    return h.union(r).withColumn("previous", F.last("__s", ignorenulls=True).over(strict)).where("__run = 1").select(*by, F.col("__t").alias(at), "previous")


def regression(now: DataFrame, before: DataFrame, by: list[str], rates: list[str], counts: list[str], tolerance: float = 0.005) -> DataFrame:
    """Metric, before, now and status (better, worse, same); rates move by more than the tolerance, counts by any."""
    metrics = [*rates, *counts]
    long = lambda df, name: df.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x")).select(*by, "x.metric", F.col("x.v").alias(name))
    j = long(before, "before").join(long(now, "now"), [*by, "metric"])
    d = F.when(F.col("metric").isin(rates), F.when(F.abs(F.col("now") - F.col("before")) <= tolerance, 0.0).otherwise(F.col("now") - F.col("before"))).otherwise(F.col("before") - F.col("now"))
    return j.withColumn("status", F.when(d > 0, "better").when(d < 0, "worse").otherwise("same"))


def dangling(targets: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """Targets that are nowhere known, as often as they are named (a bag less a set)."""
    return targets.join(known.select(*on).distinct(), on, "left_anti")


def quantiles(df: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """Quantiles by linear interpolation between ranks, and the mean."""
    return df.groupBy(*by).agg(*[F.percentile(value, q).alias(name) for name, q in at.items()], F.avg(value).alias("mean"))


SPLITS = 128  # parts that one round cuts an interval into
FEW = 1_000_000  # values of an interval from which on it is no longer cut but sorted


def exact_quantiles(df: DataFrame, by: list[str], value: str, at: dict[str, float], few: int = FEW) -> DataFrame:
    """by and a column for each of ``at``: quantiles by linear interpolation between ranks, exact, in bounded memory.

    Every wanted rank has an interval that holds its value, first the whole range. A round cuts each interval at quantiles
    of a mergeable sketch of what lies in it, counts the parts and keeps the one with the rank: about a hundredth.
    When no interval holds more than ``few`` values, or only equal ones, these are counted and the rank is read off. Rounds
    grow with the logarithm of the rows; nothing collects a group. Null and NaN values take no part; a group without
    any is left out.
    """
    v = F.col(value).cast("double")
    rows = fixed(df.select(*by, v.alias("__v")).where("__v IS NOT NULL AND NOT isnan(__v)"))
    key = F.struct(*by) if by else F.lit(0)
    rows = rows.withColumn("__k", F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit(""))
    groups = rows.groupBy("__k").agg(F.first(key).alias("__by"), F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(float(q)) * (F.col("n") - 1)).alias("place")) for name, q in at.items()])
    asked = fixed(groups.select("__k", "__by", "lo", "hi", "n", F.explode(wanted).alias("w")).select("__k", "__by", "lo", "hi", "n", "w.*"))
    ranks = asked.select("__k", F.explode(F.array(F.floor("place"), F.ceil("place"))).alias("rank"), "lo", "hi", F.col("n").alias("c")).distinct()
    open_ = fixed(ranks.withColumn("below", F.lit(0).cast("long")))
    while open_.where(F.col("c") > few).where("lo < hi").limit(1).count():
        inside = rows.join(open_, "__k").where("__v BETWEEN lo AND hi")
        sketch = F.percentile_approx("__v", [i / SPLITS for i in range(1, SPLITS)], 10 * SPLITS)
        cuts = inside.groupBy("__k", "rank").agg(sketch.alias("cuts"), F.max(F.when(F.col("__v") < F.col("hi"), F.col("__v"))).alias("next"))
        # the lowest value and the highest below the end are cuts as well, so values that most rows share get a part of their own
        ends = F.concat("cuts", F.array("lo", "next", F.col("lo") / 2 + F.col("hi") / 2))
        cuts = fixed(open_.join(cuts, ["__k", "rank"]).withColumn("cuts", F.array_distinct(F.filter(ends, lambda x: (x >= F.col("lo")) & (x < F.col("hi"))))))
        # part p holds the values above cut p - 1 up to cut p
        part = F.size(F.filter("cuts", lambda x: x < F.col("__v")))
        counts = rows.join(cuts, "__k").where("__v BETWEEN lo AND hi").groupBy("__k", "rank", part.alias("part")).agg(F.count("*").alias("here"), F.min("__v").alias("low"), F.max("__v").alias("high"))
        upto = W.Window.partitionBy("__k", "rank").orderBy("part")  # at most SPLITS rows
        counts = counts.join(open_.select("__k", "rank", "below"), ["__k", "rank"]).withColumn("before", F.col("below") + F.sum("here").over(upto) - F.col("here"))
        open_ = fixed(counts.where("rank >= before AND rank < before + here").select("__k", "rank", F.col("low").alias("lo"), F.col("high").alias("hi"), F.col("here").alias("c"), F.col("before").alias("below")))
    equal = open_.where("lo = hi").select("__k", "rank", F.col("lo").alias("x"))
    sorted_ = rows.join(open_.where("lo < hi"), "__k").where("__v BETWEEN lo AND hi").groupBy("__k", "rank", "below", "__v").count()
    before = F.col("below") + F.sum("count").over(W.Window.partitionBy("__k", "rank").orderBy("__v")) - F.col("count")  # at most ``few`` values
    read = sorted_.withColumn("before", before).where("rank >= before AND rank < before + count").select("__k", "rank", F.col("__v").alias("x"))
    found = equal.union(read)
    low = found.select("__k", F.col("rank").alias("f"), F.col("x").alias("x0"))
    high = found.select("__k", F.col("rank").alias("c"), F.col("x").alias("x1"))
    made = asked.withColumn("f", F.floor("place")).withColumn("c", F.ceil("place")).join(low, ["__k", "f"]).join(high, ["__k", "c"])
    made = made.withColumn("q", F.col("x0") + (F.col("x1") - F.col("x0")) * (F.col("place") - F.col("f")))
    out = made.groupBy("__k").agg(F.first("__by").alias("__by"), *[F.max(F.when(F.col("name") == name, F.col("q"))).alias(name) for name in at])
    return out.select(*[F.col(f"__by.{c}").alias(c) for c in by], *at)


def quantile_sketches(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, sketch, n: a mergeable sketch of the values of each group, to be stored with a snapshot."""
    sketch = F.kll_sketch_agg_double(F.col(value).cast("double"))
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(sketch.alias("sketch"), F.count("*").alias("n"))


def merged_quantiles(sketches: DataFrame, by: list[str], at: dict[str, float]) -> DataFrame:
    """by, n and approximate quantiles of stored sketches put together; the rows that they were made of are not read."""
    one = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("__s"), F.sum("n").alias("n"))
    return one.select(*by, "n", *[F.kll_sketch_get_quantile_double("__s", F.lit(float(q))).alias(name) for name, q in at.items()])


def multiset_common(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """Rows of both sides, as often as the rarer side has them."""
    return a.select(*cols).intersectAll(b.select(*cols))
