"""Stores of results, calls of services, nested segments, resampling over shards."""

import random
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliowright.functions import statistics as X
from foliowright.operators import calls, dependents
from foliowright.operators.islands import places
from foliowright.sources.store import Conflict, RunStore

# ---- the store


def test_a_run_that_dies_goes_on_and_a_second_one_computes_nothing(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "s"), ["k"], 8)
    wanted = spark.range(200).select(F.col("id").alias("k"), F.concat(F.lit("t"), "id").alias("t"))
    done = []

    def compute(todo):
        if len(done) == 3:
            raise RuntimeError("killed")
        done.append(todo.count())
        return todo.select("k", F.upper("t").alias("t"))

    with pytest.raises(RuntimeError, match="killed"):
        store.run(wanted, compute, steps=6)
    held = store.read().count()
    assert 0 < held == sum(done) < 200 and store.versions() == [1, 2, 3]
    before, done[:] = sum(done), [0] * 4  # the next three slices may run
    assert store.run(wanted, compute, steps=6) == 3
    assert sum(done) == 200 - before and store.read().where("t = concat('T', k)").count() == 200
    assert store.run(wanted, compute, steps=6) == 0 and store.missing(wanted).count() == 0
    assert store.read(2).count() < store.read(3).count()


def test_upserts_replace_by_key_and_touch_their_buckets_only(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "s"), ["a", "b"], 8)
    assert store.read() is None and store.compact() == 0
    rows = [(i, None if i % 3 else "x", i) for i in range(50)]
    schema = "a long, b string, v int"
    store.upsert(spark.createDataFrame(rows, schema))
    folders = dict(store._manifest()["buckets"])
    store.upsert(spark.createDataFrame([(1, None, 100), (1, None, 99), (1, "x", 7), (None, None, 5)], schema))
    now = store._manifest()["buckets"]
    assert sum(now[b] != folders.get(b) for b in now) <= 3
    got = {(r["a"], r["b"]): r["v"] for r in store.read().collect()}
    assert got == {**{(i, b): v for i, b, v in rows}, (1, None): 100, (1, "x"): 7, (None, None): 5}
    assert {(r["a"], r["b"]) for r in store.read(1).collect()} == {(i, b) for i, b, _ in rows}
    store.upsert(spark.createDataFrame([], schema))
    with pytest.raises(ValueError, match="columns"):
        store.upsert(spark.createDataFrame([(1, "x", 2)], "a long, b string, other int"))
    with pytest.raises(ValueError, match="no version 99"):
        store.read(99)
    v = store.compact(keep=1)
    assert store.versions() == [v] and {(r["a"], r["b"]): r["v"] for r in store.read().collect()} == got
    assert len([p for p in (tmp_path / "s/data").iterdir() if p.is_dir()]) == 1


def test_of_two_writers_none_is_lost(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    store, other = RunStore(spark, path, ["k"], 4), RunStore(spark, path, ["k"], 4)
    row = lambda k: spark.createDataFrame([(k, k)], "k long, v long")
    store.upsert(row(1))
    commit, raced = RunStore._commit, []

    def overtaken(self, manifest):
        if self is store and not raced:
            raced.append(1)
            other.upsert(row(2))
        return commit(self, manifest)

    monkeypatch.setattr(RunStore, "_commit", overtaken)
    store.upsert(row(3))
    assert {r["k"] for r in store.read().collect()} == {1, 2, 3} and raced
    monkeypatch.setattr(RunStore, "_commit", lambda self, m: False)
    with pytest.raises(Conflict):
        store.upsert(row(4))


# ---- calls


def test_waits_and_attempts():
    p = calls.Policy(attempts=6)
    for n in range(1, 6):
        assert 0.75 * min(30, 2 ** (n - 1)) <= p.wait(3, n) <= 1.25 * min(30, 2 ** (n - 1))
    assert p.wait(3, 2) == p.wait(3, 2) != p.wait(4, 2)
    assert (p.wait(0, 1, 5.0), p.wait(0, 1, 900.0), p.wait(0, 1, -1.0)) == (5.0, 60.0, 0.0)
    plan = {"a": [429, 503], "b": [400], "c": [500] * 9, "d": []}
    slept = []

    def send(r):
        if r == "e":
            raise KeyError("odd")
        if plan[r]:
            raise calls.Refused(plan[r].pop(0), 0.5 if r == "a" else None)
        return r.upper()

    out = [calls.ask(i, r, send, p, sleep=slept.append) for i, r in enumerate("abcde")]
    assert [(o.answer, o.attempts) for o in out] == [("A", 3), (None, 1), (None, 6), ("D", 1), (None, 1)]
    assert (out[0].waited, out[1].error, out[2].error) == (1.0, "status 400", "status 500") and out[4].error.startswith("KeyError")
    assert out[2].waited == pytest.approx(sum(p.wait(2, n) for n in range(1, 6))) and sum(slept) == pytest.approx(1.0 + out[2].waited)


def test_window_in_flight_keeps_order():
    lock, now, most, read = threading.Lock(), [0], [0], [0]

    def send(r):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.02 if int(r) % 5 == 0 else 0.001)
        with lock:
            now[0] -= 1
        return r

    def requests():
        for i in range(60):
            read[0] = i
            yield i, str(i)

    out = calls.in_order(requests(), send, calls.Policy(in_flight=4))
    assert next(out).answer == "0" and read[0] <= 5
    assert [o.answer for o in out] == [str(i) for i in range(1, 60)] and 2 <= most[0] <= 4


def test_token_bucket():
    at = [0.0]
    b = calls.TokenBucket(2.0, 2, clock=lambda: at[0])
    assert [b.take() for _ in range(4)] == [0.0, 0.0, 0.5, 1.0]
    at[0] = 10.0
    assert [b.take() for _ in range(3)] == [0.0, 0.0, 0.5]
    assert calls.TokenBucket.named("x", 1, 1) is calls.TokenBucket.named("x", 9, 9)


def test_calls_of_awkward_rows(spark):
    df = spark.createDataFrame([(1, "a", 3), (None, "b", 4), (2, None, 5)], "n int, r string, extra int")
    got = {r["extra"]: (r["answer"], r["attempts"], r["error"]) for r in calls.called(df, "n", "r", lambda: str.upper, calls.Policy(per_second=500.0, burst=5)).collect()}
    assert got == {3: ("A", 1, None), 4: ("B", 1, None), 5: (None, 0, None)}
    assert calls.called(df.limit(0), "n", "r", lambda: str.upper).count() == 0


# ---- nested segments


def test_levels_and_rendering(spark):
    rows = [
        ("a", "s1", None, "one {{s2}} and {{s3}} {{s9}}"), ("a", "s2", "s1", "two({{s4}}{{s4}})"), ("a", "s3", "s1", "three"), ("a", "s4", "s2", "four {{s5}}"), ("a", "s5", "s4", "five é"),
        ("b", "s1", "s2", "x {{s2}}"), ("b", "s2", "s1", "y {{s1}}"), ("b", "s3", None, "holds {{s4}} "), ("b", "s4", "s3", None), ("b", "s6", "none", "alone"), ("b", "s7", "s2", "leaf"),
    ]
    df = spark.createDataFrame(rows, "doc string, id string, parent string, text string")
    lev = {(r["doc"], r["id"]): (r["level"], r["cyclic"]) for r in dependents.levels(df.union(df), ["doc"]).collect()}
    assert {k: v[0] for k, v in lev.items() if k[0] == "a"} == {("a", "s5"): 0, ("a", "s3"): 0, ("a", "s4"): 1, ("a", "s2"): 2, ("a", "s1"): 3}
    assert lev["b", "s1"] == lev["b", "s2"] == (None, True) and lev["b", "s3"] == (1, False) and lev["b", "s6"] == lev["b", "s7"] == (0, False)
    got = {(r["doc"], r["id"]): (r["text"], r["error"]) for r in dependents.render(df, ["doc"]).collect()}
    assert len(got) == len(rows)
    assert got["a", "s1"] == ("one two(four five éfour five é) and three {{s9}}", None)
    assert got["b", "s1"] == ("x {{s2}}", "segments hold each other")
    deep = spark.createDataFrame([("a", str(i), str(i + 1)) for i in range(6)], "doc string, id string, parent string")
    with pytest.raises(RuntimeError, match="more than 3 levels"):
        dependents.levels(deep, ["doc"], most=3)
    assert dependents.levels(deep.limit(0), ["doc"]).count() == 0


# ---- resampling


@pytest.mark.parametrize("shard", [7, 50, 1 << 22])
def test_bootstrap_over_shards_equals_the_sequential_one(spark, shard):
    rng = random.Random(3)
    rows = [(g, i, rng.randrange(1, 90), rng.random() * 9, rng.random() * 11) for g, n in (("a", 120), ("b", 1), (None, 33)) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i int, words int, mqm_on double, mqm_off double").repartition(3)
    got = {r["g"]: (r["estimate"], r["low"], r["high"]) for r in X.bootstrap(df, ["g"], "i", iterations=300, chunk=64, shard=shard).collect()}
    for g in ("a", "b", None):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
        assert got[g] == pytest.approx(X.bootstrap_reduction([r[2] for r in mine], [r[3] for r in mine], [r[4] for r in mine], 300), rel=1e-9)
    assert X.bootstrap(df.limit(0), ["g"], "i").count() == 0


def test_resamples_longer_than_one_stretch_of_draws(monkeypatch):
    """A resample drawn in stretches, by ranges of items, adds up to the whole."""
    rng = np.random.default_rng(1)
    w, g = rng.random(5000), rng.random(5000)
    whole = X.resampled_sums(w, g, 3, 4)
    monkeypatch.setattr(X, "DRAWS", 700)
    parts = [X.resampled_sums(w[a : a + 1300], g[a : a + 1300], 3, 4, low=a, n=5000) for a in range(0, 5000, 1300)]
    for k in (0, 1):
        assert sum(p[k] for p in parts) == pytest.approx(whole[k]) and X.resampled_sums(w, g, 3, 4)[k] == pytest.approx(whole[k])


def test_places(spark):
    rows = [(k, i) for k, n in ((1, 500), (2, 1), (None, 9), (3, 40)) for i in range(n)]
    random.Random(4).shuffle(rows)
    for parts in (1, 9):
        got = places(spark.createDataFrame(rows, "k int, i int"), ["k"], ["i"], parts).collect()
        assert len(got) == len(rows) and all(r["place"] == r["i"] for r in got)
