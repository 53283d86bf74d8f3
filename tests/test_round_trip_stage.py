"""A round trip of documents is one narrow stage: nothing between a text and its translations is written, shuffled or joined by id."""

import subprocess
import sys

from foliowright.operators import documents as D
from foliowright.operators import run as R
from foliowright.operators import translation as T
from foliowright.options import Options
from foliowright.plans import queries

TEXTS = [
    "---\ntitle: A title of it\nkeywords: [one word, two]\n---\n\n# One head\n\nText with **bold `it`** and [a link](x.md) of v1.2.3.\nIt goes on.\n\n- a point\n- [ ] two\n",
    "| A head | Two |\n|-|-|\n| cell one | 12 |\n\n```js\n// a comment here\nlet x = 1;\n```\n\n> Quoted words\n\n<div title=\"some words\">Text <b>in</b> it</div>\n",
    "Only one line of prose.\r\n\r\nÄ 😀 line & <more>\r\n", "12 34\n", "", " \n", None, "# Alone\n", "para one\n\n" * 90,
]
PLAIN = Options(preserve_anchors=False)


def _rows(df):
    return sorted(str((r["doc"], r["lang"], r["text"], sorted(r["reverted"]), r["anchors"], r["identical"], r["error"])) for r in df.collect())


def _halting():
    class Halting:  # local, so that workers get it by value
        """Fails for some texts, loses tags or draws a rule in others, and answers each language in its own way."""

        name = "halting"

        def translate(self, texts, lang):
            return [None if "point" in t else "# no tags" if "link" in t else t if "Alone" in t else "-" * len(t) if "line of" in t else f"{lang} {t}" for t in texts]

    return Halting()


def test_one_stage_makes_what_the_operators_make_in_a_row(spark):
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS)], "doc string, content string")
    seg = D.extract_segments(docs)
    for engine, helper, anchors in ((T.Pseudo(), None, False), (_halting(), None, True), (_halting(), T.Memory({"a point": "un point"}), False), (T.Memory({}), None, False)):
        memory = T.translate(seg, ["fr", "SV"], engine, helper).where("text IS NOT NULL").select("doc", "lang", "seg_id", "text")
        want = _rows(D.assemble(docs, seg, memory, anchors=anchors, unwrapped=frozenset(["sv"])))
        made = R.round_trip(docs, ["fr", "SV"], engine, Options(preserve_anchors=anchors), helper, unwrapped=frozenset(["sv"]))
        assert any("['s1'" in row for row in want) == (engine.name == "halting"), want
        assert _rows(made) == want and len(want) == (0 if isinstance(engine, T.Memory) else 10)


def test_the_query_neither_writes_nor_joins_segments(spark, tmp_path):
    spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = queries.document_round_trip(spark, str(tmp_path))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and "LogicalRDD" not in plan, plan
    assert {tuple(r) for r in made.collect()} == {(x, 5, 0, 0, 0) for x in ("fr", "sv")}


def test_rows_that_share_an_id_or_have_none_are_documents_of_their_own(spark, tmp_path):
    rows = [(7, "# One head\n\nSome words.\n"), (7, "Other words that are longer than those.\n"), (None, "No id.\n"), (7, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in queries.document_round_trip(spark, str(tmp_path)).collect()} == {(x, 3, 0, 0, 0) for x in ("fr", "sv")}
    docs = spark.createDataFrame(rows, "doc long, content string")
    made = R.round_trip(docs, ["fr"], T.Pseudo(), PLAIN).collect()
    assert {r["text"] for r in made} == {"# ÜONE ÜHEAD\n\nÜSOME ÜWORDS.\n", "ÜOTHER ÜWORDS ÜTHAT ÜARE ÜLONGER ÜTHAN ÜTHOSE.\n", "ÜNO ÜID.\n"}


def test_the_module_is_read_without_a_session():
    subprocess.run([sys.executable, "-c", "import __spark_entry__"], check=True, cwd=queries.__file__.rsplit("/", 3)[0])
