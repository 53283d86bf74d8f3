"""Relational operators against plain Python: spans, splicing, tags, runs of rows, batches."""

import random

import pytest
from pyspark.sql import functions as F

from foliowright.functions import masking, table_functions, tags
from foliowright.functions.protect import find_protected
from foliowright.operators import documents as D
from foliowright.operators import islands as I
from foliowright.operators import spans as P
from foliowright.operators import translation as T

BITS = """a_b@c-d.example.org v1.2.3.4 FooBar.bazQux http://x.org/a_b?c=1, $HOME/x.txt C:\\dir\\x \\\\srv\\share ~/a/b.md ./x/ README --long-flag=3 -x,
{{tmpl}} %d #123 @user/x Get-Item call() A::b snake_case camelCase PascalCase 10.0.0.1:80 localhost:80 #ffaa00 0xFF :smile: [!NOTE] www.a.org [!INCLUDE
\xa0é \U0001f600 $x$ $a+b$ $5 and $6 $\\alpha$ $y $$z$$ \\$w$ $ab cd ef = 3$ $f'$ 550e8400-e29b-41d4-a716-446655440000 .env $1.5 * x$ a.b.c( foo.bar = <%= Spark Lake \x85""".split(" ")


def _texts(n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choice(BITS) for _ in range(rng.randrange(1, 40))) + rng.choice(("", "\n", "\n\n")) for _ in range(n)]


def test_protected_spans_without_python(spark):
    """The union of all rules equals that of the scanner, span by span; keys may repeat or be null."""
    rows = [(i if i % 9 else None, t) for i, t in enumerate(_texts(800, 1))] + [(5000, None), (5001, ""), (5002, "x_y"), (5002, "x_y")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, rule string, start int").repartition(3)
    terms = ("Spark", "a.b", "")
    got = sorted((tuple(r) for r in P.protected_spans(df, ["doc_id"], dnt=terms).collect()), key=str)
    want = sorted(((i, *s, t[s[0] : s[1]]) for i, t in rows if t for s in find_protected(t, terms)), key=str)
    assert got == want and len({r[3] for r in got}) > 25
    plan = P.protected_spans(df, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert P.protected_spans(df.limit(0), ["doc_id"]).count() == 0


def test_splice(spark):
    rng = random.Random(2)
    docs, edits, want = [], [], {}
    for i, t in enumerate(_texts(300, 3) + [None, "", "plain ascii text " * 30_000]):
        docs.append((i, t))
        if t is None or i % 10 == 9:
            want[i] = (t, 0, None)
            continue
        cuts = sorted(rng.sample(range(len(t) + 1), min(len(t) + 1, 2 * rng.randrange(0, 7) if i < 302 else 4000)))
        mine = [(a, b, rng.choice(("", "é", "new \U0001f600 words"))) for a, b in zip(cuts[::2], cuts[1::2], strict=False)]
        made, at = "", 0
        for a, b, new in mine:
            made, at = made + t[at:a] + new, b
        edits += [(i, *e) for e in mine]
        want[i] = (made + t[at:], len(mine), None)
    for i, bad, why in ((1000, [(0, 3, "x"), (2, 4, "y")], "edits overlap"), (1001, [(0, 99, "x")], "an edit lies outside the text"), (1002, [(0, 1, None)], "an edit has no place or no text"), (1003, [(3, 1, "x")], "an edit has no place or no text")):
        docs.append((i, "twelve signs"))
        edits += [(i, *e) for e in bad]
        want[i] = (None, len(bad), why)
    docs.append((1004, "ab"))
    edits += [(1004, 1, 1, "2"), (1004, 1, 1, "1"), (1004, 0, 0, "<"), (1004, 2, 2, ">"), (4444, 0, 1, "no document")]
    want[1004] = ("<a12b>", 4, None)
    d = spark.createDataFrame(docs, "doc long, text string").repartition(3)
    e = spark.createDataFrame(edits, "doc long, start int, end int, text string").repartition(4)
    got = {r["doc"]: (r["text"], r["edits"], r["error"]) for r in P.splice(d, e, ["doc"]).collect()}
    assert got == want
    placed = P.new_places(e.where("doc < 303"), ["doc"]).collect()
    assert len(placed) > 800 and all(want[r["doc"]][0][r["new_start"] : r["new_end"]] == r["text"] for r in placed)
    assert P.splice(d.limit(0), e, ["doc"]).count() == 0


def test_tag_checks_without_python(spark):
    """Folds with a stack give the scanner's verdicts on random tags."""
    rng = random.Random(4)
    parts = ["<g1>", "</g1>", "<x2/>", "<g3>", "</g3>", "<g4/>", "</x5>", "<x0/ >", "word &lt;q&quot;", "'", " ", "<g12 >", "</g12>", "<b>"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 9)))) for i in range(1500)] + [(9000, "<g1><x2/><g3></g3></g1>"), (9001, "<g1>" * 300 + "</g1>" * 300)]
    groups, quotes = [(["g1", "g3"], True), (["x2", "g1"], False), (["g4"], True)], {1: '"', 3: "'"}
    shape = "array<struct<tags:array<string>,closed_up:boolean>>"
    df = spark.createDataFrame([(i, t, groups, quotes) for i, t in rows], f"i long, t string, g {shape}, q map<int,string>").repartition(3)
    got = df.select("i", tags.tag_faults(F.array(F.lit(2)), F.array(F.lit(1), F.lit(3)), F.col("t")).alias("f"), tags.group_faults(F.col("g"), F.col("q"), F.col("t")).alias("h"), tags.well_nested(F.col("t")).alias("w")).collect()
    by = dict(rows)
    kinds = set()
    for r in got:
        want = masking.check_tags({2}, {1, 3}, by[r["i"]])
        assert r["f"] == want, by[r["i"]]
        assert r["w"] == (not any("ends what" in x for x in want))
        assert sorted(r["h"]) == sorted(masking.check_groups(groups, quotes, by[r["i"]])), by[r["i"]]
        kinds |= {x.split(" ", 1)[1][:12] for x in [*r["f"], *r["h"]]}
    assert len(kinds) >= 6


def _runs(rows, breaks):
    out, last = [], None
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1])):
        if last is None or last[0] != r[0] or breaks(r, last):
            out.append([])
        out[-1].append(r)
        last = r
    return out


@pytest.fixture
def many_tasks(spark):
    """Small partitions stay apart, so that tasks can be told from their rows."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_islands_across_ranges(spark, many_tasks, parts):
    """A key of most rows is spread over ranges and its runs are the same, whatever the number of ranges."""
    rng = random.Random(5)
    rows = [(1, i, rng.random() < 0.02) for i in range(6000)] + [(k, i, rng.random() < 0.3) for k in range(2, 40) for i in range(k % 5)] + [(None, i, False) for i in range(6)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], "k long, at long, cut boolean, island string").drop("island").repartition(5)
    made = I.islands(df, ["k"], ["at"], lambda this, last: this("cut"), parts)
    found = made.withColumn("p", F.spark_partition_id()).collect()
    got = {}
    for r in found:
        got.setdefault(r["island"], []).append((r["k"], r["at"], r["cut"]))
    want = _runs(rows, lambda r, last: r[2])
    assert sorted(got) == list(range(len(want)))
    assert [sorted(got[i], key=lambda r: r[1]) for i in sorted(got)] == want
    if parts > 1:
        assert max(sum(r["p"] == p for r in found) for p in {r["p"] for r in found}) < len(rows)
    assert I.islands(df.limit(0), ["k"], ["at"], lambda this, last: this("cut"), parts).count() == 0


def test_one_key_of_a_million_rows(spark, many_tasks):
    """Runs of one key are found in several tasks; batches of one key stream through constant state."""
    df = spark.range(1_000_000).select(F.lit(1).alias("k"), "id", (F.col("id") % 1000 == 0).alias("cut"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("t"))
    tasks = I.islands(df.drop("t"), ["k"], ["id"], lambda this, last: this("cut"), 8).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.max("island").alias("top")).collect()
    assert len(tasks) > 4 and max(r["n"] for r in tasks) < 500_000 and max(r["top"] for r in tasks) == 999
    got = T.batches(df, ["k"], "id", "t").groupBy("batch").agg(F.count("*").alias("n"), F.sum(F.length("t")).alias("c")).collect()
    want = {}
    for i, b in enumerate(T.packed((i % 50 for i in range(1_000_000)), 40, 12000)):
        n, c = want.get(b, (0, 0))
        want[b] = n + 1, c + i % 50
    assert {r["batch"]: (r["n"], r["c"]) for r in got} == want


def test_comment_groups(spark):
    """Marker, column, neighbouring line, own line and directives decide."""
    rows = [
        ("a", 1, 0, "#", True, True), ("a", 2, 0, "#", True, False), ("a", 3, 0, "#", True, False), ("a", 5, 0, "#", True, False), ("a", 6, 2, "#", True, False), ("a", 7, 2, "//", True, False),
        ("a", 8, 9, "//", False, False), ("a", 9, 9, "//", True, False), ("a", 10, 9, "//", True, False), ("b", 11, 9, "//", True, False), ("b", 12, 9, None, True, False), ("b", 13, 9, None, True, False),
    ]
    df = spark.createDataFrame(rows, "doc string, line int, column int, marker string, own_line boolean, standalone boolean")
    got = {}
    for r in I.comment_groups(df, ["doc"], 3).collect():
        got.setdefault(r["island"], []).append(r["line"])
    assert sorted(map(sorted, got.values())) == [[1], [2, 3], [5], [6], [7], [8], [9, 10], [11], [12], [13]]


def test_batches_and_their_table_function(spark):
    """Both ways give the same rows; repeated places are packed by themselves; null keys are a key."""
    rng = random.Random(6)
    rows = [(k, lang, i, "w" * rng.randrange(0, 60)) for k in (1, 2, None) for lang in ("fr", "sv") for i in range(rng.randrange(5, 60))] + [(3, "fr", 1, "a"), (3, "fr", 1, "a"), (3, "fr", 2, None)]
    df = spark.createDataFrame(rows, "doc long, lang string, seq int, t string").repartition(3)
    got = sorted((tuple(r) for r in T.batches(df, ["doc", "lang"], "seq", "t", 4, 90).collect()), key=str)
    assert len(got) == len(rows)
    table_functions.register(spark)
    df.withColumn("n", F.length("t").cast("long")).createOrReplaceTempView("t_batches")
    sql = "SELECT doc, lang, seq, t, batch FROM pack_batches(TABLE(t_batches) PARTITION BY (doc, lang) ORDER BY (seq, n), 'n', 4, 90)"
    assert sorted((tuple(r) for r in spark.sql(sql).collect()), key=str) == got
    for bad in ("'none', 4, 90", "t, 4, 90"):
        with pytest.raises(Exception, match="no column|constant|UNRESOLVED|TABLE_VALUED"):
            spark.sql(f"SELECT * FROM pack_batches(TABLE(t_batches) PARTITION BY doc ORDER BY (seq), {bad})").collect()


def test_splice_equals_assembly_of_spans(spark):
    """Protected spans replaced by marks and put back give the text again."""
    rows = list(enumerate(_texts(200, 8)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = D.protected_spans(df, ["doc_id"])
    marked = P.splice(df, spans.select("doc_id", "start", "end", F.lit("\x01").alias("text")), ["doc_id"])
    back = P.new_places(spans.select("doc_id", "start", "end", F.lit("\x01").alias("text"), "span"), ["doc_id"])
    again = P.splice(marked.select("doc_id", "text"), back.select("doc_id", F.col("new_start").alias("start"), F.col("new_end").alias("end"), F.col("span").alias("text")), ["doc_id"])
    assert {r["doc_id"]: r["text"] for r in again.collect()} == dict(rows)
