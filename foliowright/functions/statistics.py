"""Statistics as Catalyst expressions and DataFrame transforms; only the bootstrap needs Python."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def sign_test(k: Column, n: Column) -> Column:
    """Exact two-sided sign test in log space; 1 for n = 0."""
    k, n = k.cast("double"), n.cast("double")
    low = F.least(k, n - k).cast("int")
    state = F.struct(F.lit(0.0).alias("log"), F.exp(-n * F.lit(float(np.log(2)))).alias("p"))

    def step(acc, i):
        log = acc["log"] + F.log(n - i + 1) - F.log(i.cast("double"))
        return F.struct(log.alias("log"), (acc["p"] + F.exp(log - n * F.lit(float(np.log(2))))).alias("p"))

    terms = F.when(low >= 1, F.sequence(F.lit(1), F.greatest(low, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(terms, state, step, lambda acc: acc["p"])))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    k, n = k.cast("double"), n.cast("double")
    p, d = k / F.nullif(n, F.lit(0.0)), 1 + z * z / F.nullif(n, F.lit(0.0))
    middle, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), middle - half)), F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), middle + half))


def holm(df: DataFrame, p: str = "p", family: list[str] | None = None, out: str = "p_adj") -> DataFrame:
    """Adds Holm-adjusted p-values inside each family (comparisons of one report: a small table)."""
    keys = [F.col(c) for c in family or []]
    order = W.Window.partitionBy(*keys).orderBy(p)
    rank, n = F.row_number().over(order), F.count(p).over(W.Window.partitionBy(*keys))
    raw = F.least(F.lit(1.0), F.col(p) * (n - rank + 1))
    return df.withColumn("__raw", raw).withColumn(out, F.max("__raw").over(order.rowsBetween(W.Window.unboundedPreceding, 0))).drop("__raw")


def cohen_kappa(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by..., n, kappa) of two raters' columns; counts are pre-aggregated per pair of categories."""
    cells = df.groupBy(*by, a, b).count()
    n = cells.groupBy(*by).agg(F.sum("count").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("count")).otherwise(0)).alias("same"))
    left = cells.groupBy(*by, F.col(a).alias("c")).agg(F.sum("count").alias("ca"))
    right = cells.groupBy(*by, F.col(b).alias("c")).agg(F.sum("count").alias("cb"))
    chance = left.join(right, [*by, "c"]).groupBy(*by).agg(F.sum((F.col("ca") * F.col("cb")).cast("double")).alias("x"))
    out = n.join(chance, by, "left")
    po, pe = F.col("same") / F.col("n"), F.coalesce(F.col("x"), F.lit(0.0)) / (F.col("n") * F.col("n"))
    return out.select(*by, "n", F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def fleiss_kappa(df: DataFrame, by: list[str], item: str, rating: str) -> DataFrame:
    """(by..., items, kappa); only items with as many ratings as the first (least) item count."""
    cells = df.groupBy(*by, item, rating).count()
    items = cells.groupBy(*by, item).agg(F.sum("count").alias("m"), F.sum(F.col("count") * F.col("count")).alias("sq")).where("m >= 2")
    first = items.groupBy(*by).agg(F.min_by("m", item).alias("m"))
    usable = items.join(first, [*by, "m"])
    agree = usable.groupBy(*by).agg(F.count("*").alias("items"), F.first("m").alias("m"), F.avg((F.col("sq") - F.col("m")) / (F.col("m") * (F.col("m") - 1))).alias("p"))
    share = cells.join(usable.select(*by, item), [*by, item]).groupBy(*by, rating).agg(F.sum("count").alias("c"))
    chance = share.join(agree.select(*by, "items", "m"), by).groupBy(*by).agg(F.sum(F.pow(F.col("c") / (F.col("items") * F.col("m")), F.lit(2.0))).alias("pe"))
    out = agree.join(chance, by)
    return out.select(*by, "items", F.when(F.col("pe") == 1, 1.0).otherwise((F.col("p") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def mulberry32(seed: int, n: int, start: int = 0) -> np.ndarray:
    """Numbers start to start + n in [0, 1) of the 32-bit generator, all at once: its state is a counter."""
    with np.errstate(over="ignore"):
        a = np.uint32(seed) + np.arange(start + 1, start + n + 1, dtype=np.uint64).astype(np.uint32) * np.uint32(0x6D2B79F5)
        t = (a ^ (a >> np.uint32(15))) * (a | np.uint32(1))
        t = t ^ (t + (t ^ (t >> np.uint32(7))) * (t | np.uint32(61)))
        return (t ^ (t >> np.uint32(14))).astype(np.float64) / 4294967296.0


DRAWS = 1 << 20  # numbers that are drawn at once


SHARD = 1 << 22  # items of a group that one task holds


def resampled_sums(words: np.ndarray, gain: np.ndarray, first: int, count: int, seed: int = 7, low: int = 0, n: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sums of words and gain of resamples first to first + count, each of n draws from n items; only of the drawn items
    low to low + len(words), which are given. The sums of all ranges add up to those of the whole."""
    n = len(words) if n is None else n
    w, g = np.zeros(count), np.zeros(count)
    whole = low == 0 and len(words) == n
    step = max(1, DRAWS // max(1, n))
    for at in range(0, count if n else 0, step):
        k = min(step, count - at)
        for slot in range(0, n, DRAWS):  # more than one stretch only where a single resample exceeds DRAWS
            m = min(DRAWS, n - slot) if k == 1 else n
            pick = np.floor(mulberry32(seed, k * m, (first + at) * n + slot) * n).astype(np.int64).reshape(k, m) - low
            if not whole:
                inside = (pick >= 0) & (pick < len(words))
                pick = np.where(inside, pick, len(words))
            w[at : at + k] += (words if whole else np.append(words, 0.0))[pick].sum(1)
            g[at : at + k] += (gain if whole else np.append(gain, 0.0))[pick].sum(1)
            if k > 1:
                break
    return w, g


def reductions(w: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Reduction per 100 words."""
    return np.where(w != 0, g / np.where(w != 0, w, 1) * 100, 0.0)


def bootstrap_reduction(words, on, off, iterations: int = 2000, seed: int = 7) -> tuple[float, float, float]:
    """(estimate, low, high) of the reduction per 100 words; items are resampled with replacement."""
    w, d = np.asarray(words, float), np.asarray(off, float) - np.asarray(on, float)
    if not len(w):
        return (np.nan, np.nan, np.nan)
    low, high = np.quantile(reductions(*resampled_sums(w, d, 0, iterations, seed)), [0.025, 0.975])
    return float(d.sum() / w.sum() * 100 if w.sum() else 0.0), float(low), float(high)


def bootstrap(
    items: DataFrame, by: list[str], order: str, words: str = "words", on: str = "mqm_on", off: str = "mqm_off", iterations: int = 2000, seed: int = 7, chunk: int = 100, shard: int = SHARD,
) -> DataFrame:
    """by, estimate, low, high as ``bootstrap_reduction`` gives them, items in the order of ``order`` (which should be total).

    The generator is a counter, so any stretch of draws is computable anywhere: resamples are dealt in chunks and the
    items of a group in ranges of ``shard``; a task holds two numbers an item of one range, draws at most DRAWS at once
    and keeps the draws that fall into its range. Sums of a resample over the ranges are added by Spark, which takes the
    quantiles as well. A group's items are numbered by ranges of the order; no task holds a group. Null numbers count
    as 0; null keys are a key; an empty table gives no rows.
    """
    from ..operators.islands import places

    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    rows = items.select(*by, F.col(order).alias("__o"), zero(F.col(words)).alias("__w"), zero(F.col(off) - F.col(on)).alias("__d"))
    placed = places(rows, by, ["__o"])
    key = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")
    sums = rows.groupBy(*by).agg(F.count("*").alias("__n"), F.sum("__w").alias("w"), F.sum("__d").alias("d")).withColumn("__key", key)
    lists = placed.withColumn("__s", (F.col("place") / shard).cast("long")).groupBy(key.alias("__key"), "__s").agg(F.array_sort(F.collect_list(F.struct("place", "__w", "__d"))).alias("x"))
    chunks = F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-iterations // chunk) - 1))))
    work = lists.join(sums.select("__key", "__n"), "__key").select("__key", "__s", "__n", F.transform("x", lambda i: i["__w"]).alias("w"), F.transform("x", lambda i: i["__d"]).alias("d"), chunks.alias("c")).repartition("__key", "__s", "c")

    @F.pandas_udf("array<struct<i:int,w:double,d:double>>")
    def draw(w: pd.Series, d: pd.Series, c: pd.Series, s: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for a, b, k, at, size in zip(w, d, c, s, n, strict=True):
            count = min(chunk, iterations - k * chunk)
            x, y = resampled_sums(np.asarray(a), np.asarray(b), int(k) * chunk, count, seed, int(at) * shard, int(size))
            out.append([{"i": int(k) * chunk + i, "w": p, "d": q} for i, (p, q) in enumerate(zip(x, y, strict=True))])
        return pd.Series(out)

    drawn = work.select("__key", F.explode(draw("w", "d", "c", "__s", "__n")).alias("r")).groupBy("__key", "r.i").agg(F.sum("r.w").alias("w"), F.sum("r.d").alias("d"))
    per_cent = F.when(F.col("w") != 0, F.col("d") / F.col("w") * 100).otherwise(0.0)
    spread = drawn.select("__key", per_cent.alias("s")).groupBy("__key").agg(F.percentile("s", 0.025).alias("low"), F.percentile("s", 0.975).alias("high"))
    return sums.select(*by, "__key", per_cent.alias("estimate")).join(spread, "__key").select(*by, "estimate", "low", "high")
