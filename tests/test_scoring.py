import json

import pytest
from pyspark.sql import functions as F

from foliowright import sql
from foliowright.functions import markdown, masking
from foliowright.functions import scalars as S
from foliowright.functions import statistics as X
from foliowright.operators import documents as D
from foliowright.operators import evaluation as E
from foliowright.operators import scoring as Q
from foliowright.operators import translation as T
from foliowright.options import Options, as_switch
from foliowright.sources import files


def test_options_are_read_from_a_mapping():
    o = Options.read({"FW_REVIEW": "off", "FW_structuralContext": "Yes", "FW_BATCH_CHARS": "-3", "FW_MAX_ATTEMPTS": "4", "FW_ENGINE": " tm ", "other": "x"}, "FW_")
    assert (o.review, o.structural_context, o.batch_chars, o.max_attempts, o.engine) == (False, True, 12000, 4, "tm")
    assert len(Options.switches()) == 9 and o.flipped("mdx").mdx and not o.mdx
    with pytest.raises(ValueError):
        as_switch("maybe")
    assert as_switch("maybe", strict=False) is False and Options.read({"mdx": "odd"}, strict=False).mdx is False


def test_functions_in_sql(spark):
    assert len(sql.register(spark, "t_")) == len(sql.FUNCTIONS)
    r = spark.sql(
        "SELECT t_protected_spans('see a.txt') AS p, t_dollar_math('so $a+b$') AS m, t_mask_text('**b** x.txt') AS k, t_masked_plain_text('a &lt; <x1/>b') AS n, t_md_blocks('a\n\nb') AS b,"
        " t_tag_faults('a <x1/>', 'b') AS f, t_looks_untranslated('one two three four', 'one two three four') AS u, t_md_segments(CAST(NULL AS STRING)) AS z, t_heading_anchors('# A b') AS h"
    ).first()
    assert [tuple(x) for x in r["p"]] == [(4, 9, "filename")] and [tuple(x) for x in r["m"]] == [(3, 8)] and r["k"] == "<g1>b</g1> <x2/>" and r["n"] == "a < b"
    assert r["b"] == ["a", "b"] and len(r["f"]) == 1 and r["u"] is True and r["z"] is None and r["h"] == ["a-b"]


def test_requests_are_halved_and_retried_with_problems(spark):
    class Stubborn:
        """Fails on long requests, gives a bad answer first and a good one when told what was wrong."""

        name = "stub"

        def translate(self, texts, lang):
            if len(texts) > 1:
                raise T.TooLong
            return ["kein Zeichen"]

        def retry(self, texts, lang, previous, problems):
            return [masking.pseudo(t) if p and faults else None for t, p, faults in zip(texts, previous, problems, strict=True)]

    docs = spark.createDataFrame([("a", "Some **bold** words.\n\nMore `code` here now.\n")], "doc string, content string")
    out = T.translate(D.extract_segments(docs), ["fr"], Stubborn()).collect()
    assert len(out) == 2 and all(r["via"] == "stub" and r["retries"] == 1 and r["errors"] == [] for r in out)
    assert T.ask(lambda at: [str(i) for i in at] if len(at) < 3 else (_ for _ in ()).throw(T.TooLong()), list(range(7))) == [str(i) for i in range(7)]
    assert T.ask(lambda at: ["x"], [1, 2]) == ["x", None]


def test_answers_are_put_on_one_line():
    assert masking.sanitize(" ein\n  zwei ", "a b") == "ein zwei" and masking.sanitize("x\ny", " a\nb ") == " x\ny " and masking.sanitize(None, "a") is None


def test_batches_are_greedy():
    assert T.packed([5, 5, 5, 20, 1], 2, 12) == [0, 0, 1, 2, 3] and T.packed([], 2, 3) == [] and T.packed([99], 2, 3) == [0]


def test_cache_hits_need_the_same_tags(spark):
    s = spark.createDataFrame([("k1", "a <x1/>"), ("k2", "b <x1/>"), ("k3", "c")], "key string, masked string")
    c = spark.createDataFrame([("k1", "A <x1/>"), ("k2", "B"), ("k4", "D")], "key string, text string")
    assert {r["key"]: r["via"] for r in T.probe_cache(s, c).collect()} == {"k1": "cache", "k2": None, "k3": None}


def test_review_edits_are_checked(spark):
    o = spark.createDataFrame([("d", "fr", f"s{i}", k, "une <x1/> phrase", "gpt", "a <x1/> phrase") for i, k in enumerate(["paragraph", "paragraph", "comment"])], "doc string, lang string, seg_id string, kind string, text string, via string, source string")
    e = spark.createDataFrame([("d", "fr", "s0", "la <x1/> phrase"), ("d", "fr", "s1", "la phrase"), ("d", "fr", "s2", "a <x1/> phrase")], "doc string, lang string, seg_id string, text string")
    for c in ("category", "severity", "explanation"):
        e = e.withColumn(c, F.lit("x"))
    got = {r["seg_id"]: (r["text"], r["review"] is not None) for r in T.apply_review(o, e).collect()}
    assert got == {"s0": ("la <x1/> phrase", True), "s1": ("une <x1/> phrase", False), "s2": ("une <x1/> phrase", False)}


def test_small_predicates(spark):
    r = spark.range(1).select(
        T.source_language(F.lit(" "), F.lit(None).cast("string"), F.lit("fr")).alias("a"), T.source_language(*[F.lit(None).cast("string")] * 3).alias("b"),
        S.language_name(F.lit("pt-BR")).alias("c"), S.language_name(F.lit("xx")).alias("d"), S.percent(F.lit(0.98765)).alias("e"), S.percent(F.lit(float("nan"))).alias("f"),
        S.p_value(F.lit(0.0004)).alias("g"), S.p_value(F.lit(0.25)).alias("h"),
    ).first()
    assert tuple(r) == ("fr", "en", "Brazilian Portuguese", "xx", "98.8%", "n/a", "< 0.001", "0.250")
    docs = spark.createDataFrame([("a", "# Title\n"), ("b", "12\n"), ("c", None)], "doc string, content string")
    assert [x["doc"] for x in T.translatable(docs, D.extract_segments(docs)).collect()] == ["a"]


def test_language_names(spark):
    codes = ["de", "DE-at", "de-LI", "zh-Hant", "nb", "pt_PT", "es-419", "", None, "qq-QQ"]
    got = [r["n"] for r in spark.createDataFrame([(c,) for c in codes], "c string").select(S.language_name(F.col("c")).alias("n")).collect()]
    assert got == ["German", "Austrian German", "German", "Traditional Chinese", "Norwegian Bokmål", "Portuguese", "Latin American Spanish", "", None, "qq-QQ"]


def test_links_and_code(spark):
    rows = [(1, '# One\n\n[a](#one) [b](#two) <a id="x"></a> [c](#x) [d](#%C3%BC)\n\n## ü\n'), (2, "no links"), (3, None)]
    got = {r["k"]: (r["targets"], r["broken"]) for r in Q.broken_links(spark.createDataFrame(rows, "k int, text string"), ["k"]).collect()}
    assert got == {1: (4, 1), 2: (0, 0), 3: (0, 0)}
    assert markdown.code_blocks("a\n```py x\n1\n\n2\n```\n~~~\nz\n") == [("py", "1\n\n2"), ("", "z")]
    a = spark.createDataFrame([(1, "```js\nx; // old\n```\n"), (2, "```\na\n```\n"), (3, "```\na\n```\n")], "k int, text string")
    b = spark.createDataFrame([(1, "```js\nx; // neu\n```\n"), (2, "```\nb\n```\n"), (3, "none")], "k int, text string")
    assert {r["k"]: r["code_changed"] for r in Q.code_changes(Q.code_blocks(a, ["k"]), Q.code_blocks(b, ["k"]), ["k"]).collect()} == {1: 0, 2: 1, 3: 1}


def test_english_left_is_a_multiset(spark):
    side = lambda *x: spark.createDataFrame([("d", "prose", t) for t in x], "doc string, category string, plain string")
    got = Q.english_left(side("one two three", "one two three", "a b c", "four five six"), side("one two three", "a b c", "one two three", "one two three"), ["doc"]).collect()
    assert [(r["category"], r["english_left"]) for r in got] == [("prose", 2)]


def test_extractions_do_not_overlap_and_have_fingerprints(spark):
    docs = spark.createDataFrame([("a", "# T\n\nx **y**\n"), ("b", "# T\n\nx **y**\n"), ("c", "# T\n\nz\n")], "doc string, content string")
    seg = D.extract_segments(docs)
    assert Q.overlapping(seg).count() == 0
    print_ = {r["doc"]: r["fingerprint"] for r in Q.fingerprints(seg, ["doc"]).collect()}
    assert print_["a"] == print_["b"] != print_["c"]
    known = spark.createDataFrame([("a", print_["a"], 1), ("c", "old", 2)], "doc string, fingerprint string, result int")
    have, want = Q.reusable(Q.fingerprints(seg, ["doc"]), known, ["doc"])
    assert [r["doc"] for r in have.collect()] == ["a"] and {r["doc"] for r in want.collect()} == {"b", "c"}


def test_blocks_that_differ(spark):
    rows = [("a", "x\n\ny", "p\n\nq", "p\n\nr"), ("b", "x\n\ny", "p", "q\n\nr"), ("c", "x", "p", "p"), ("d", "x", None, "p")]
    got = Q.differing_blocks(spark.createDataFrame(rows, "doc string, source string, on string, off string"), ["doc"]).collect()
    assert sorted((r["doc"], r["item"], r["source"]) for r in got) == [("a", "b1", "y"), ("b", "b0", "x\n\ny"), ("d", "b0", "x")]


def test_answers_with_unknown_values_give_no_row(spark):
    good = {"results": [{"id": "b0", "better": "A", "errors_a": [], "errors_b": [{"category": "style", "severity": "major"}]}, {"id": "b1", "better": "C", "errors_a": [], "errors_b": []}]}
    rows = [(1, "text ```json\n" + json.dumps(good) + "\n``` more", False), (2, json.dumps(good), True), (3, "{broken", False), (4, None, False), (5, '{"results": [{"id": "b0", "better": "A", "errors_a": null, "errors_b": []}]}', False)]
    got = Q.answers(spark.createDataFrame(rows, "k int, answer string, swapped boolean"), ["k"]).collect()
    assert sorted((r["k"], r["item"], r["better"], len(r["errors_on"])) for r in got) == [(1, "b0", "on", 0), (2, "b0", "off", 1)]


def test_still_expected(spark):
    gone = spark.createDataFrame([("a", "overtranslated", "x", "1"), ("a", "overtranslated", "y", "2"), ("b", "structure", "", "3"), ("z", "error", "", "4")], "doc string, type string, detail string, defect string")
    e = spark.createDataFrame([("a", ["x"], ["q"]), ("b", [], [])], "doc string, keep array<string>, translate array<string>")
    assert {r[0] for r in Q.still_expected(gone, e).collect()} == {"1", "3"}


def test_reports_memories_and_runs(spark, tmp_path):
    (tmp_path / "tm.json").write_text('{"doc":"a","lang":"fr","tm":[["s1","un"],["s1","deux"],["s2",null]],"other":1}\n{"doc":"b","lang":"fr","tm":{"s1":"x"}}\n')
    assert sorted(map(tuple, files.memory(spark, str(tmp_path / "tm.json")).collect())) == [("a", "fr", "s1", "deux"), ("b", "fr", "s1", "x")]
    (tmp_path / "languages.json").write_text('{"defaultTargets":["fr","xx"],"languages":{"FR":{"name":"French"}}}')
    with pytest.raises(ValueError, match="xx"):
        files.languages(spark, str(tmp_path / "languages.json"))
    docs = spark.createDataFrame([("a", "# Title hé\n\nSome text here.\n")], "doc string, content string")
    seg = D.extract_segments(docs)
    out = T.translate(seg, ["fr"], T.Pseudo())
    files.write_report(T.report(out, ["doc", "lang"]), str(tmp_path / "report"), out)
    r = spark.read.json(str(tmp_path / "report")).first()
    assert r["status"] == "translated" and r["tm"][0][0] == "s1" and [x["seg_id"] for x in r["segments_detail"]] == ["s1", "s2"]
    dumped = json.loads(files.extraction_dump(seg, docs).first()["json"])["segments"]
    assert [(x["id"], x["start"], x["end"]) for x in dumped] == [("s1", 2, 11), ("s2", 13, 28)]
    runs = spark.createDataFrame([("a", "fr", "default", "f", "t")], "doc string, lang string, variant string, fingerprint string, text string")
    files.append_runs(runs, str(tmp_path / "runs"))
    files.append_runs(runs, str(tmp_path / "runs"))
    assert files.read_runs(spark, str(tmp_path / "runs"), runs.schema).count() == 1


def test_resamples_dealt_over_tasks_are_those_of_one(spark, monkeypatch):
    rows = [(k, i, 10 + i * 7 % 23, float(i % 5), float(i * 3 % 11)) for k in ("a", "b", None) for i in range(37)]
    monkeypatch.setattr(X, "DRAWS", 100)
    got = {r["k"]: (r["estimate"], r["low"], r["high"]) for r in X.bootstrap(spark.createDataFrame(rows, "k string, i int, words int, mqm_on double, mqm_off double"), ["k"], "i", iterations=230, chunk=60).collect()}
    want = X.bootstrap_reduction([r[2] for r in rows[:37]], [r[3] for r in rows[:37]], [r[4] for r in rows[:37]], 230)
    assert len(got) == 3 and all(v == pytest.approx(want) for v in got.values())


def test_quantiles_and_dangling(spark):
    q = E.quantiles(spark.createDataFrame([("a", v) for v in (1.0, 2.0, 4.0, 8.0)], "k string, v double"), ["k"], "v", {"m": 0.5, "p": 0.9}).first()
    assert (q["m"], round(q["p"], 6), q["mean"]) == (3.0, 6.8, 3.75)
    t = spark.createDataFrame([("x",), ("x",), ("y",)], "u string")
    assert [r["u"] for r in E.dangling(t, t.where("u = 'y'"), ["u"]).collect()] == ["x", "x"]


def test_link_targets(spark):
    """Escapes are read, a plus stays, and what is no escape stays as it is."""
    rows = [("a%20b",), ("100%",), ("a+b",), ("%zz",), ("%C3%BC",), (None,), ("",)]
    got = [r["t"] for r in spark.createDataFrame(rows, "x string").select(Q.link_target(F.col("x")).alias("t")).collect()]
    assert got == ["a b", "100%", "a+b", "%zz", "ü", None, ""]


def test_links_in_code_are_none(spark):
    text = "# A\n\n[x](#a) [y](#b)\n\n~~~md\n[z](#c)\n~~~\n\n`[z](#c)` ``[z](#d) ` [z](#e)`` [w](#100%)\n```\n[z](#f)\n"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, text string")
    got = {r["k"]: (r["targets"], r["broken"]) for r in Q.broken_links(rows, ["k"]).collect()}
    assert got == {1: (3, 2), 2: (0, 0), 3: (0, 0)}


def test_run_metrics_of_runs_without_text_or_expectations(spark):
    rows = [("a", "fr", "# T\n\nSome words stay here.\n", None, 1, 2, 3, "boom"), ("a", "sv", "# T\n\nSome words stay here.\n", "# T\n\nSome words stay here.\n", None, 0, 0, None), ("b", "sv", "", "", 0, 0, 0, None)]
    runs = spark.createDataFrame(rows, "doc string, lang string, source string, text string, reverted int, kept_source int, nmt int, error string")
    got = {(r["doc"], r["lang"]): r for r in Q.run_metrics(runs, ["doc", "lang"]).collect()}
    assert [got["a", "fr"][c] for c in Q.COUNTS] == [0, 0, 1, 0, 0, 0, 1, 1, 2, 3]
    assert [got["a", "sv"][c] for c in Q.COUNTS] == [0, 0, 0, 0, 0, 1, 0, 0, 0, 0] and got["a", "sv"]["english_by_kind"] == {"prose": 1}
    assert sum(got["b", "sv"][c] for c in Q.COUNTS) == 0
    assert Q.run_metrics(runs.limit(0), ["doc", "lang"]).count() == 0
