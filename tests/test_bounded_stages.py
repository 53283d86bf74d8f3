"""Stages that work on bounded stretches, cheap gates of rules, and queries over whole tables."""

import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__
from foliowright.functions import anchors, protect
from foliowright.operators import documents as D
from foliowright.operators import run as R
from foliowright.operators import scoring as Q
from foliowright.operators import stages
from foliowright.operators import translation as T
from foliowright.options import Options


def test_english_left_counts_lines_of_any_length(spark, tmp_path):
    rows = [(1, "two words\n\nuna\nmore than three words here", "src1"), (2, "two words\nuna\nuna\n", "src2"), (3, "two words", "src1")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["line"]: r["n"] for r in __spark_entry__.queries()["english_left"](spark, str(tmp_path)).collect()}
    assert got == {"two words": 1, "una": 1, "": 1}


def test_gates_leave_plain_prose_to_no_rule():
    assert protect.possible_rules("Plain words of a line, some of which cost $ 3 or so. And no more, see above") == []
    for text, rule in (("see README", "specialfile"), ("go.mod", "specialfile"), ("a $x", "envvar"), ("%A%/b", "envpath"), ("run a.md", "filename")):
        assert rule in protect.possible_rules(text), text
    assert [s[2] for s in protect.find_protected("a Makefile, NOTICE and %PATH%")] == ["specialfile", "specialfile", "envvar"]


def test_short_headings_are_remembered():
    anchors._short.cache_clear()
    text = "\n\n".join(["## Word", "## Other one", "## Word", "## " + "long " * 30] * 2)
    assert [h[2] for h in anchors.headings(text)][:3] == ["word", "other-one", "word-1"]
    assert anchors._short.cache_info().currsize == 2


def test_a_batch_is_cut_into_stretches():
    n = stages.STRETCH
    b = pa.record_batch({"k": [1, 2, 3, 4, 5], "t": ["a" * (n - 200), "b" * n, None, "c" * (3 * n), "d"]})
    parts = list(stages.stretches(b, ["t"]))
    assert len(parts) > 2 and pa.Table.from_batches(parts).to_pylist() == b.to_pylist()
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p["t"].to_pylist()[1:]) <= n for p in parts)
    assert list(stages.stretches(b.slice(0, 0), ["t"])) == []


def test_stages_over_several_stretches(spark):
    """Results don't depend on how a batch is cut."""
    line = "Some words of a text that goes on for a while "
    docs = spark.range(12, numPartitions=1).select("id", F.concat(F.lit("# Head\n\n"), F.repeat(F.lit(line), 2000), F.col("id").cast("string"), F.lit("\n\n")).alias("text"))
    seg = D.extract_segments(docs, "id", "text").orderBy(F.col("doc").cast("int"), "seq").collect()
    assert [(s["doc"], s["seg_id"]) for s in seg] == [(str(i), f"s{k}") for i in range(12) for k in (1, 2)]
    sides = docs.select("id", F.col("text").alias("source"), F.col("text").alias("on"), F.replace("text", F.lit("while"), F.lit("bit")).alias("off"))
    assert Q.differing_blocks(sides, ["id"]).groupBy("item").count().collect() == [("b1", 12)]
    code = docs.select("id", F.lit("// a word\n// two words").alias("code"))
    assert D.comment_prose(code, ["id"], F.lit("js")).count() == 24
    names = D.map_column(docs, "text", "n", len, "int").agg(F.count("n"), F.min("n")).first()
    assert tuple(names) == (12, 8 + 2000 * len(line) + 3)
    assert D.map_column(docs.where("id < 0"), "text", "n", len, "int").count() == 0


def test_a_run_takes_segments_of_another(spark):
    docs = spark.createDataFrame([("a", "# One head\n\nSome words here\n"), ("b", None)], "doc string, content string")
    first = R.run(docs, ["fr"], T.Pseudo())
    again = R.run(docs, ["fr"], T.Pseudo(), Options(max_attempts=1), segments=first.segments)
    assert sorted(map(str, again.outcomes.collect())) == sorted(map(str, first.outcomes.collect()))
    assert again.documents.collect() == first.documents.collect()
