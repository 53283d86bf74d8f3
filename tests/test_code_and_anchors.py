import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliowright.functions import anchors, code_comments, markdown, masking
from foliowright.operators import documents as D
from foliowright.operators.documents import splice


def _prose(name, code):
    return [code[a:b] for a, b, _ in code_comments.prose(name, code)]


@pytest.mark.parametrize(
    "name,code,want",
    [
        ("js", 'const u = "http://x"; // the address', ["the address"]),
        ("ts", "/**\n * Adds numbers.\n * @param {number} x the first\n */", ["Adds numbers.", "the first"]),
        ("ts", "/**\n * @example\n * say hello there\n * @returns a sum\n */", ["a sum"]),
        ("bash", "#!/bin/sh\necho $# # print it\n# shellcheck disable", ["print it"]),
        ("sql", "SELECT '-- no' -- yes it is\n/* all\n   rows */", ["yes it is", "all", "rows"]),
        ("xml", "<a/><!-- a remark -->", ["a remark"]),
        ("lua", "--[[ two\nlines ]] x = 1 -- after", ["two", "lines", "after"]),
        ("bat", "REM say it\necho :: no\n:: or this", ["say it", "or this"]),
        ("js", "// const x = 1;\n// call(a)\n// TODO(me): tidy this up", ["tidy this up"]),
        ("python", 'x = """# no"""\n# eslint-disable\n# plain words', ["plain words"]),
        ("python", 'def f():\n    """Say é hi.\n\n    Args:\n        a: the name\n\n    >>> f()\n    2\n    """', ["Say é hi.", "the name"]),
        ("unheard", "// words", []),
    ],
)
def test_comment_prose(name, code, want):
    assert _prose(name, code) == want


@pytest.mark.parametrize("info,want", [("{.python}", "python"), ("JS title=x", "js"), ("", ""), ("ts{1,3}", "ts")])
def test_language(info, want):
    assert code_comments.language(info) == want


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(["js", "python", "sql", "xml", "bash", "lua", "bat"]), st.text(alphabet="/*#-<>!'\"`\\ab \n(){};", max_size=60))
def test_comments_never_overlap(name, code):
    spans = code_comments.prose(name, code)
    assert all(a < b for a, b, _ in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
    assert all(a <= x <= y <= b for a, b, x, y in code_comments.find_comments(name, code))


def _translated(text, change):
    parts = []
    for i, s in enumerate(markdown.segments(text)):
        m, singles, pairs = masking.mask(text[s.start : s.end])
        parts.append({"start": s.start, "end": s.end, "seg_id": f"s{i}", "kind": s.kind, "text": change(m), "singles": singles, "pairs": {k: {"open": a, "close": b} for k, (a, b) in pairs.items()}})
    return splice(text, parts)


def test_comments_are_translated_and_code_is_not():
    text = "# Head\n\n```js\nf(); // the call\n```\n"
    assert _translated(text, masking.pseudo) == ("# ÜHEAD\n\n```js\nf(); // ÜTHE ÜCALL\n```\n", [])
    assert code_comments.fingerprint("js", "f(); // a") == code_comments.fingerprint("js", "f(); /* b\n */")


def test_translation_that_leaves_its_comment_is_reverted():
    text = "```js\n/* the call */ f();\n```\n"
    assert _translated(text, lambda m: "a */ g() /* b")[0] == text


def test_front_matter_styles():
    text = "---\ntitle: Plain\nsummary: 'Single'\ndescription: \"Double\"\ncaption: |\n  First line\n  Second line\nname: |\n  Kept\n---\n"
    out, reverted = _translated(text, lambda m: f"{m}: it's \"so\"")
    assert not reverted
    assert out == (
        "---\ntitle: \"Plain: it's \\\"so\\\"\"\nsummary: 'Single: it''s \"so\"'\ndescription: \"Double: it's \\\"so\\\"\"\n"
        "caption: |\n  First line: it's \"so\"\n  Second line: it's \"so\"\nname: |\n  Kept\n---\n"
    )
    assert _translated(text, lambda m: m) == (text, [])


def test_slugs():
    assert anchors.slug("Hello, Wörld_1 & co!") == "hello-wörld_1--co"
    assert anchors.unique(["foo", "foo", "foo-1", "foo"]) == ["foo", "foo-1", "foo-1-1", "foo-2"]
    assert anchors.heading_text("A **b** `c.d` ![pic](x.png) [e](f)") == "A b c.d  e"


def test_anchors_keep_old_slugs():
    old, new = "# One\n\n## Two {#own}\n\n## Same\n", "# Eins\n\n## Zwei {#own}\n\n## Same\n"
    assert anchors.preserve(old, new) == ('# <a id="one"></a>Eins\n\n## Zwei {#own}\n\n## Same\n', ["one"])
    assert anchors.preserve(old, "# Eins\n") == ("# Eins\n", [])


def test_operators(spark):
    df = spark.createDataFrame([(1, "js", "// a word"), (2, None, "// x"), (3, "js", None)], "id int, lang string, code string")
    assert [tuple(r) for r in D.comment_prose(df, ["id"], "lang").collect()] == [(1, 3, 9, "comment", "a word")]
    docs = spark.createDataFrame([(1, "# A b\n\n# A b\n"), (2, None)], "id int, text string")
    assert [(r.seq, r.slug) for r in D.heading_slugs(docs, ["id"]).collect()] == [(0, "a-b"), (1, "a-b-1")]
