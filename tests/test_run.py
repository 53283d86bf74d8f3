"""Runs steered by options and language settings; answers of judges and analyses in the published shape."""

import json

import pytest

from foliowright.operators import judging as J
from foliowright.operators import run as R
from foliowright.operators import scoring as Q
from foliowright.operators import translation as T
from foliowright.options import Options
from foliowright.sources import files

TEXT = "# A heading of words\n\nThis paragraph of several words is wrapped\nover two lines of text.\n\n- item one of these\n"


@pytest.mark.parametrize("served, switch, engine, applies", [(s, w, e, s and (w or e == "nmt")) for s in (True, False) for w in (True, False) for e in ("pseudo", "nmt")])
def test_fallback_truth_table(served, switch, engine, applies):
    assert R.fallback_applies(Options(nmt_fallback=switch, engine=engine), served) == applies


def test_requests_are_limited_by_options(spark):
    class Counting:
        """Gives the number of texts of each request in front of every text, at most two texts a request or it fails."""

        name = "pseudo"

        def translate(self, texts, lang):
            return [f"{len(texts)} {t}" for t in texts]

    docs = spark.createDataFrame([("a", TEXT)], "doc string, content string")
    for limit, want in ((40, {"3"}), (2, {"2", "1"}), (1, {"1"})):
        got = R.run(docs, ["fr"], Counting(), Options(batch_segments=limit)).outcomes.collect()
        assert {r["text"][0] for r in got} == want
    got = R.run(docs, ["fr"], Counting(), Options(batch_chars=30)).outcomes.collect()
    assert {r["text"][0] for r in got} == {"1"}


def test_ratios_and_wrapping_by_language(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"defaultTargets": ["fr"], "languages": {"fr": {"name": "French", "formal": "f", "informal": "i"}, "JA": {"name": "Japanese", "formal": "f", "informal": "i", "wrap": "none", "lengthRatio": [0.1, 1.2]}}}))
    catalogue = files.languages(spark, str(tmp_path / "l.json"))
    ratios, unwrapped = R.settings(catalogue)
    assert ratios == {"ja": (0.1, 1.2)} and unwrapped == {"ja"} and R.settings(None) == ({}, frozenset())

    class Longer:
        name = "pseudo"

        def translate(self, texts, lang):
            return [t + " and " + t[:20] for t in texts]

    docs = spark.createDataFrame([("a", TEXT), ("b", None), ("c", "  ")], "doc string, content string")
    r = R.run(docs, ["fr", "ja"], Longer(), Options(nmt_fallback=False), catalogue=catalogue)
    via = {(x["lang"], x["seg_id"]): (x["via"], x["errors"]) for x in r.outcomes.collect()}
    assert via["fr", "s2"][0] == "pseudo" and via["ja", "s2"] == ("source", ["length ratio"])
    class OneLine:
        name = "pseudo"

        def translate(self, texts, lang):
            return [" ".join(t.upper().split()) for t in texts]

    text = {x["lang"]: x["text"] for x in R.run(docs, ["fr", "ja"], OneLine(), Options(), catalogue=catalogue).documents.collect()}
    assert len(text["fr"].split("\n\n")[1].splitlines()) > 1 and len(text["ja"].split("\n\n")[1].splitlines()) == 1


def test_own_language_is_left_out(spark):
    docs = spark.createDataFrame([("a", TEXT, "sv-SE"), ("b", TEXT, None)], "doc string, content string, found string")
    jobs = lambda o: {(x["doc"], x["lang"]) for x in R.run(docs, ["sv", "en"], T.Pseudo(), o, detected="found").outcomes.collect()}
    assert jobs(Options()) == {("a", "en"), ("b", "sv")}
    assert jobs(Options(source_lang="en-GB")) == {("a", "sv"), ("b", "sv")}


def test_formality_in_order(spark):
    docs = spark.createDataFrame([("a", "---\nformality: Informal\n---\n", "neutral"), ("b", "text", "informal"), ("c", "text", None), ("d", None, "neutral")], "doc string, content string, register string")
    got = lambda o: [r["formality"] for r in R.formality(docs, o, "register").orderBy("doc").collect()]
    assert got(Options()) == ["informal", "informal", "formal", "formal"] and got(Options(formality="formal")) == ["formal"] * 4


def test_answers_that_leave_out_items(spark):
    item = lambda i, better="A", a=(), b=(): {"id": i, "better": better, "errorsA": [{"category": c, "severity": "minor", "note": ""} for c in a], "errorsB": [{"category": c, "severity": "major", "note": ""} for c in b]}
    rows = [
        (1, [item("x"), item("y", "tie", ["style"])]), (2, [item("x")]), (3, [item("x"), item("y", "C")]), (4, [item("x"), item("y", b=["nonsense"])]), (5, [item("x"), item("y"), item("z", "??")]),
        (6, [item("x"), item("x", "B"), item("y")]), (7, []), (8, [{"id": "x", "better": "A", "errorsA": None, "errorsB": []}, item("y")]),
    ]
    df = spark.createDataFrame([(k, json.dumps({"results": r}), False, ["x", "y"]) for k, r in rows] + [(9, None, False, ["x"])], "k int, answer string, swapped boolean, asked array<string>")
    whole = sorted((r["k"], r["item"], r["better"]) for r in Q.answers(df, ["k"], asked="asked").collect())
    assert whole == [(1, "x", "on"), (1, "y", "tie"), (5, "x", "on"), (5, "y", "on"), (6, "x", "off"), (6, "y", "on")]
    loose = {(r["k"], r["item"]) for r in Q.answers(df, ["k"]).collect()}
    assert {(2, "x"), (3, "x"), (4, "x"), (8, "y")} <= loose and (5, "z") not in loose


def test_saved_and_answered_analyses(spark, tmp_path):
    one = {"sourceLanguage": "en", "register": "neutral", "registerEvidence": "e", "domain": "d", "audience": "a", "summary": "s", "doNotTranslate": ["X"], "terminology": [{"term": "t", "note": "n"}]}
    (tmp_path / "one.json").write_text(json.dumps(one, indent=2))
    (tmp_path / "many.jsonl").write_text(json.dumps({"doc": "p", **one}) + "\n" + json.dumps({"doc": "q", "register": "odd"}) + "\n")
    got = files.analyses(spark, str(tmp_path / "one.json")).collect()
    assert [(r["doc"], r["language"], r["register"], r["dnt"], r["terminology"][0]["note"]) for r in got] == [(None, "en", "neutral", ["X"], "n")]
    got = {r["doc"]: r for r in files.analyses(spark, str(tmp_path / "many.jsonl")).collect()}
    assert got["p"]["audience"] == "a" and got["q"]["register"] is None and got["q"]["dnt"] is None
    raw = spark.createDataFrame([(1, json.dumps(one)), (2, "no"), (3, None)], "k int, answer string")
    got = {r["k"]: r for r in J.analysis(raw, ["k"]).collect()}
    assert got[1]["register_evidence"] == "e" and got[2]["language"] is None and got[3]["summary"] is None


def test_extraction_switches(spark):
    text = '---\ntitle: Some words\n---\n\nA text.\n\n```python\ndef f():\n    """Words here."""\n    return 1  # more words\n```\n'
    docs = spark.createDataFrame([("a", text)], "doc string, content string")
    n = lambda **o: R.run(docs, ["fr"], T.Pseudo(), Options(**o)).segments.count()
    assert (n(), n(front_matter=False), n(code_comments=False), n(docstrings=False), n(front_matter=False, code_comments=False, docstrings=False)) == (4, 3, 3, 3, 1)
