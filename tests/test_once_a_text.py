"""What does not depend on the language is made once for a text, not once for each language."""

from foliowright.functions import markdown, masking
from foliowright.operators import documents as D


def test_pseudo_and_outline_of_a_source_are_made_once(monkeypatch):
    source = "# A heading\n\nSome words stand here.\n"
    asked = []
    real = markdown.segments
    monkeypatch.setattr(markdown, "segments", lambda t, *a, **k: asked.append(t) or real(t, *a, **k))
    D._skeleton.cache_clear()
    parts = [{"start": s.start, "end": s.end, "seg_id": str(i), "kind": s.kind, "text": masking.pseudo(source[s.start : s.end]), "singles": [], "pairs": []} for i, s in enumerate(real(source))]
    made = [D.splice(source, parts) for _ in range(2)]
    assert made[0] == made[1] and made[0][0] != source and made[0][1] == []
    assert asked.count(source) == 1
    masking.pseudo.cache_clear()
    assert masking.pseudo("Some words") == masking.pseudo("Some words")
    assert masking.pseudo.cache_info().hits == 1
