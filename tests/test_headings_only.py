"""Where only some kinds of segments are asked for, the others are neither masked nor carried, and a text is scanned once for all that follows."""

from foliowright.functions import anchors, markdown, masking
from foliowright.operators import documents as D
from foliowright.operators import translation as T
from foliowright.plans import queries

TEXTS = ["Words first.\n\n# One head\n\nText of `it`.\n\n## Two v1.2.3 heads\n\n- a point\n", "# Alone\n", "No head.\n", "", None, "Set\n===\n\n> # Quoted head\n"]


def test_kinds_keep_the_ids_of_all_segments(spark):
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS)], "doc string, content string")
    every, some = D.extract_segments(docs), D.extract_segments(docs, kinds=("heading",))
    rows = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    assert rows(some) == rows(every.where("kind = 'heading'")) and rows(some)
    made = []
    for seg in (every, some):
        memory = T.translate(seg.where("kind = 'heading'"), ["fr"], T.Pseudo()).where("text IS NOT NULL").select("doc", "lang", "seg_id", "text")
        made.append(rows(D.assemble(docs, seg, memory, anchors=True)))
    assert made[0] == made[1] and len(made[0]) == 3


def test_the_query_masks_headings_only(spark, tmp_path, monkeypatch):
    asked = []
    real = D.extract_segments
    monkeypatch.setattr(D, "extract_segments", lambda *a, **k: asked.append(real(*a, **k)) or asked[-1])
    spark.createDataFrame([(i, t, "src") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    row = queries.assemble_with_anchors(spark, str(tmp_path)).first()
    assert (row["lang"], row["docs"], row["errors"]) == ("fr", len(TEXTS), 0) and row["anchors"] >= len(TEXTS)
    assert {r["kind"] for s in asked for r in s.select("kind").collect()} == {"heading"}


def test_a_text_is_scanned_once_for_outline_and_anchors(monkeypatch):
    source = "# Only a head here\n\nWith words.\n"
    seen = []
    real = markdown.segments
    monkeypatch.setattr(markdown, "segments", lambda t, *a, **k: seen.append(t) or real(t, *a, **k))
    markdown._kept.cache_clear()
    D._skeleton.cache_clear()
    s = real(source)[0]
    part = {"start": s.start, "end": s.end, "seg_id": "s1", "kind": s.kind, "text": masking.pseudo(source[s.start : s.end]), "singles": [], "pairs": []}
    text, reverted = D.splice(source, [part])
    assert reverted == [] and anchors.preserve(source, text)[1] == ["only-a-head-here"]
    assert sorted(seen) == sorted([source, text])
