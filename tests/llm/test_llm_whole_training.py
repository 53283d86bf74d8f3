"""The language stage learns from every labelled row and sets its least score over every held-out row."""

import numpy as np
from pyspark.sql import functions as F

from foliowright.llm import language_id as L


def test_least_score_reads_all_held_out_rows(spark):
    judged = spark.range(9000, numPartitions=3).select(
        F.lit("words").alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 10 == 0, "fr").otherwise("en").alias("lang_pred"),
        F.when(F.col("id") % 1000 == 7, F.col("id") / 90000).otherwise(0.9).alias("score"))
    right = [i / 90000 if i % 1000 == 7 else 0.9 for i in range(9000) if i % 10]
    assert abs(L.least_score(judged, F.lit(True)) - L.FLOOR * np.percentile(right, 0.1)) < 1e-12
    assert L.least_score(judged, F.lit(False)) == 0.0


def test_rows_outside_the_sample_are_learned_from(spark):
    rows = [(i, ("abab " if i % 2 else "xyxy ") * 60, "a" if i % 2 else "x") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    model = L.train(docs, F.lit(True), per_lang=0)  # nothing to start from
    start = L.ByteGRU(["a", "x"])
    assert not np.array_equal(model.flat(), start.flat())
    x = np.stack(list(L.windows_of(b"abab " * 60)) + list(L.windows_of(b"xyxy " * 60)), axis=1)
    y = np.array([0] * 3 + [1] * 3)
    assert model.loss_gradient(x, y)[0] < start.loss_gradient(x, y)[0]
    none = L.train(docs.where("doc_id < 0"), F.lit(True))
    assert none.labels == []


def test_gradient_is_the_slope_of_the_loss_and_costs_few_predictions():
    from time import process_time

    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 256, (L.WINDOW, 512)).astype(np.intp), rng.integers(0, 4, 512)
    x[100:, ::3] = L.PAD
    model = L.ByteGRU(list("abcd"))
    g = model.loss_gradient(x, y)[1]
    for k, value in model.p.items():
        way = rng.standard_normal(value.shape).astype(np.float32)
        at, losses = value.copy(), []
        for step in (1e-3, -1e-3):
            model.p[k] = at + np.float32(step) * way
            losses.append(model.loss_gradient(x, y)[0])
        model.p[k] = at
        slope = float((g[k] * way).sum())
        assert abs((losses[0] - losses[1]) / 2e-3 - slope) < 0.02 * abs(slope) + 2e-4, k

    def cost(f):
        times = []
        for _ in range(5):
            t = process_time()
            f()
            times.append(process_time() - t)
        return min(times)

    x, y = np.concatenate([x, x], axis=1), np.concatenate([y, y])
    assert cost(lambda: model.loss_gradient(x, y)) < 5 * cost(lambda: model.positions(x))
