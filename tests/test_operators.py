import pytest
from pyspark.sql import functions as F

from foliowright.functions import scalars as S
from foliowright.functions import statistics as X
from foliowright.operators import documents as D
from foliowright.operators import evaluation as E
from foliowright.operators import translation as T
from foliowright.sources import files
from foliowright.streaming import documents as streams

DOCS = [("a.md", "# Title here\n\nSome **bold** text with `code` inside it.\n"), ("b.md", "Only one line of prose that is long enough.\n"), ("c.md", None), ("d.md", " \n")]


def _docs(spark):
    return spark.createDataFrame(DOCS, "doc string, content string")


def test_translate_and_assemble(spark):
    docs = _docs(spark)
    seg = D.extract_segments(docs)
    out = T.translate(seg, ["fr"], T.Pseudo())
    made = {r["doc"]: r for r in D.assemble(docs, seg, out.select("doc", "lang", "seg_id", "text")).collect()}
    assert made["a.md"]["text"] == "# ÜTITLE ÜHERE\n\nÜSOME **ÜBOLD** ÜTEXT ÜWITH `code` ÜINSIDE ÜIT.\n"
    assert set(made) == {"a.md", "b.md"} and all(r["error"] is None for r in made.values())


def test_fallback_and_kept_source(spark):
    seg = D.extract_segments(_docs(spark))
    known = T.Memory({"Title here": "Titre ici"})
    out = {(r["doc"], r["seg_id"]): r for r in T.translate(seg, ["fr"], known).collect()}
    assert out["a.md", "s1"]["via"] == "tm" and out["b.md", "s1"]["via"] == "source" and out["b.md", "s1"]["errors"]
    both = T.translate(seg, ["fr"], known, T.Pseudo())
    assert {r["via"] for r in both.collect()} == {"tm", "pseudo"}
    rep = {r["doc"]: r for r in T.report(T.translate(seg, ["fr"], known), ["doc", "lang"]).collect()}
    assert rep["a.md"]["status"] == "partial" and rep["b.md"]["status"] == "failed"


def test_batches_close_before_a_limit(spark):
    rows = spark.createDataFrame([("d", i, "x" * n) for i, n in enumerate([5, 5, 5, 20, 1])], "doc string, seq bigint, t string")
    got = [r["batch"] for r in T.batches(rows, ["doc"], "seq", "t", 2, 12).orderBy("seq").collect()]
    assert got == [0, 0, 1, 2, 3]


def test_review_keeps_cached_text(spark):
    o = spark.createDataFrame([("d", "fr", "s1", "a", "gpt"), ("d", "fr", "s2", "b", "cache")], "doc string, lang string, seg_id string, text string, via string")
    e = spark.createDataFrame([("d", "fr", s, "z", "style", "minor", "") for s in ("s1", "s2", "s9")], "doc string, lang string, seg_id string, text string, category string, severity string, explanation string")
    got = {r["seg_id"]: r for r in T.apply_review(o, e).collect()}
    assert got["s1"]["text"] == "z" and got["s1"]["review"]["before"] == "a" and got["s2"]["text"] == "b" and len(got) == 2


def test_statistics(spark):
    r = spark.range(1).select(X.sign_test(F.lit(6), F.lit(6)).alias("a"), X.sign_test(F.lit(185), F.lit(313)).alias("b"), X.sign_test(F.lit(900), F.lit(1000)).alias("c"), X.sign_test(F.lit(0), F.lit(0)).alias("d")).first()
    assert r["a"] == pytest.approx(0.03125) and r["b"] == pytest.approx(0.00151, abs=1e-5) and r["c"] < 1e-150 and r["d"] == 1
    p = spark.createDataFrame([(i, v) for i, v in enumerate([0.01, 0.04, 0.03, 0.5])], "i int, p double")
    assert [round(r["p_adj"], 6) for r in X.holm(p).orderBy("i").collect()] == [0.04, 0.09, 0.09, 0.5]


#: Published wins, losses and adjusted p-values of one family of seven comparisons.
FAMILY = [(190, 1, 8.56446e-55), (126, 97, 0.121094), (57, 5, 1.53276e-11), (12, 1, 0.0102539), (17, 0, 6.10352e-05), (2, 144, 1.44372e-39), (6, 3, 0.507812)]


def test_published_family(spark):
    rows = spark.createDataFrame([(i, w, l) for i, (w, l, _) in enumerate(FAMILY)], "i int, w int, l int")
    got = X.holm(rows.withColumn("p", X.sign_test(F.col("w"), F.col("w") + F.col("l")))).orderBy("i").collect()
    for r, (_, _, want) in zip(got, FAMILY, strict=True):
        assert r["p_adj"] == pytest.approx(want, rel=1e-4)


def test_scalars(spark):
    df = spark.createDataFrame([("on", "on"), ("on", "off"), ("on", "tie"), (None, "on")], "a string, b string")
    assert [r[0] for r in df.select(S.verdict(F.col("a"), F.col("b"))).collect()] == ["on", "inconsistent", "tie", "error"]
    one = spark.range(1).select(S.switch(F.lit("Yes")).alias("y"), S.switch(F.lit("maybe")).alias("m"), S.utf16_length(F.lit("😀a")).alias("u"), S.sanitize(F.lit(" x\ny "), F.lit("a ")).alias("s")).first()
    assert one["y"] is True and one["m"] is None and one["u"] == 3 and one["s"] == "x y "


def test_defects_and_regression(spark):
    d = lambda *x: spark.createDataFrame([(v,) for v in x], "defect string")
    got = {(r[0], r[1]) for r in E.defect_changes(d("a", "b", "c"), d("c", "n"), d("a")).collect()}
    assert got == {("n", "new"), ("a", "fixed"), ("b", "retired")}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.md").write_bytes("\ufeffHi\r\nthere".encode())
    got = files.documents(spark, str(tmp_path / "in")).first()
    assert got["content"] == "\ufeffHi\r\nthere" and got["mdx"] is False
    with pytest.raises(ValueError):
        files.request(spark, {})
    files.append_cache(spark.createDataFrame([("k", "t", "gpt"), ("k", "t", "gpt"), ("s", "u", "source")], "key string, text string, via string"), str(tmp_path / "cache"))
    assert files.read_cache(spark, str(tmp_path / "cache")).count() == 1


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.md").write_text("# Hello there\n")
    q = streams.translate_stream(streams.read_files(spark, str(tmp_path / "in")), ["fr"], T.Pseudo(), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).first()["text"] == "# ÜHELLO ÜTHERE\n"
