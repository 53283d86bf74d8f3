"""Quantiles by selection and by stored sketches, chart frames."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliowright.operators import charts as C
from foliowright.operators import evaluation as E


def test_exact_quantiles_of_awkward_values(spark):
    """Spikes at either end and in the middle, ties, two values, one, none: as numpy has them, however few values are sorted."""
    rng = random.Random(1)
    groups = {
        "normal": [rng.gauss(0, 1) for _ in range(3000)], "low": [0.0] * 2900 + [rng.random() for _ in range(60)], "high": [1.0] * 2900 + [rng.random() for _ in range(60)],
        "middle": [rng.random() for _ in range(300)] + [0.5] * 2500 + [rng.random() for _ in range(300)], "ties": [float(rng.randrange(3)) for _ in range(2000)],
        "two": [1.0, 4.0], "one": [7.0], None: [rng.expovariate(1e-9) for _ in range(700)], "same": [3.0] * 900,
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("normal", None), ("normal", float("nan")), ("none", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    at = {"q0": 0.0, "q3": 0.3, "mid": 0.5, "q975": 0.975, "q1": 1.0}
    for few in (100, 10**6):
        got = {r["g"]: r for r in E.exact_quantiles(df, ["g"], "v", at, few).collect()}
        assert got.keys() == groups.keys()
        for g, vs in groups.items():
            for name, q in at.items():
                assert got[g][name] == pytest.approx(float(np.quantile(vs, q)), rel=1e-12), (g, name)
    assert E.exact_quantiles(df, [], "v", {"m": 0.5}, 100).first()["m"] == pytest.approx(float(np.quantile([v for vs in groups.values() for v in vs], 0.5)))
    assert E.exact_quantiles(df.limit(0), ["g"], "v", at).count() == 0


def test_sketches_of_snapshots_merge(spark):
    rng = random.Random(2)
    rows = [(day, g, rng.gauss(day, 2)) for day in range(5) for g in ("a", "b") for _ in range(2000)] + [(0, "a", None)]
    df = spark.createDataFrame(rows, "day int, g string, v double").repartition(4)
    stored = E.quantile_sketches(df, ["day", "g"], "v")
    assert stored.count() == 10
    got = {r["g"]: r for r in E.merged_quantiles(stored, ["g"], {"m": 0.5, "p9": 0.9}).collect()}
    for g in ("a", "b"):
        vs = np.sort([v for _, k, v in rows if k == g and v is not None])
        assert got[g]["n"] == len(vs)
        for name, q in (("m", 0.5), ("p9", 0.9)):
            assert abs(np.searchsorted(vs, got[g][name]) / len(vs) - q) < 0.03


def test_grids_and_stacks(spark):
    df = spark.createDataFrame([("b", "x", 2.0), ("a", "y", 3.0), ("b", "x", 1.0), (None, "x", 5.0), ("a", None, 4.0)], "r string, c string, v double")
    g = {(r["row_at"], r["column_at"]): r["value"] for r in C.grid(df, "r", "c", F.sum("v")).collect()}
    assert g == {(0, 0): 0.0, (0, 1): 3.0, (0, 2): 4.0, (1, 0): 3.0, (1, 1): 0.0, (1, 2): 0.0, (2, 0): 5.0, (2, 1): 0.0, (2, 2): 0.0}
    wide = {r["row"]: (r["y"], r["zz"], r["null"]) for r in C.heat_map(df, "r", "c", F.sum("v"), rows=["a", "gone"], columns=["y", "zz", None]).collect()}
    assert wide == {"a": (3.0, 0.0, 4.0), "gone": (0.0, 0.0, 0.0)}
    s = [(r["column"], r["low"], r["high"], round(r["share"], 6)) for r in C.stacked(df, "r", "c", F.sum("v")).where("row = 'a'").orderBy("column_at").collect()]
    assert s == [("x", 0.0, 0.0, 0.0), ("y", 0.0, 3.0, 0.428571), (None, 3.0, 7.0, 0.571429)]
    assert C.grid(df.limit(0), "r", "c", F.sum("v")).count() == 0 and C.heat_map(df.limit(0), "r", "c", F.sum("v")).count() == 0
    many = spark.range(300).select(F.col("id").cast("string").alias("r"), F.lit("x").alias("c"))
    with pytest.raises(ValueError, match="more than 200"):
        C.grid(many, "r", "c", F.count("*"))


def test_forest(spark):
    df = spark.createDataFrame([("a", 0.5, 0.1, 0.9), ("b", None, None, None), ("c", 0.5, -0.1, 0.9), ("d", -2.0, -3.0, -1.0)], "l string, v double, a double, b double")
    got = [(r["at"], r["label"], r["side"]) for r in C.forest(df, "l", "v", "a", "b").orderBy("at").collect()]
    assert got == [(0, "a", 1), (1, "c", 0), (2, "d", -1), (3, "b", 0)]
