import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliowright.functions import markdown, masking, protect
from foliowright.functions import statistics as X
from foliowright.operators.documents import finished, splice

#: A text for every protection rule and the span that it protects there.
SAMPLES = [
    ("alert", "a box > [!CAUTION] follows", "[!CAUTION]"),
    ("docsinclude", "see [!INCLUDE next line", "[!INCLUDE "),
    ("url", "mirror ftp://host.example/pub/a_b?c=1, then", "ftp://host.example/pub/a_b?c=1"),
    ("www", "our page www.example.org/start is up", "www.example.org/start"),
    ("email", "write to jo.doe+x@mail.example.net today", "jo.doe+x@mail.example.net"),
    ("uncpath", "share \\\\nas01\\team$\\q1 is full", "\\\\nas01\\team$\\q1"),
    ("winpath", "kept in D:\\data\\raw files", "D:\\data\\raw"),
    ("envpath", "below %APPDATA%\\tool it lies", "%APPDATA%\\tool"),
    ("abspath", "look in /var/log/app now", "/var/log/app"),
    ("relpath", "open lib/core/io.rs please", "lib/core/io.rs"),
    ("deeppath", "under team/backend/jobs we keep", "team/backend/jobs"),
    ("dirpath", "the build/ folder", "build/"),
    ("filename", "rename notes.TXT first", "notes.TXT"),
    ("dotfile", "a .gitignore entry", ".gitignore"),
    ("specialfile", "the Makefile has it", "Makefile"),
    ("template", "hello {{ user.name }} there", "{{ user.name }}"),
    ("envvar", "value of $HOME_DIR matters", "$HOME_DIR"),
    ("printf", "prints %5.2f units", "%5.2f"),
    ("emoji", "done :rocket: yes", ":rocket:"),
    ("longflag", "with --dry-run=all set", "--dry-run=all"),
    ("shortflag", "pass -q to hush", "-q"),
    ("guid", "id 0f8fad5b-d9cb-469f-a165-70867728950e end", "0f8fad5b-d9cb-469f-a165-70867728950e"),
    ("version", "since v2.10.3-rc1 works", "v2.10.3-rc1"),
    ("ip", "from 10.20.30.40/16 only", "10.20.30.40/16"),
    ("hostport", "on localhost:8080 it runs", "localhost:8080"),
    ("hex", "colour #c0ffee please", "#c0ffee"),
    ("issue", "fixes #4711 at last", "#4711"),
    ("mention", "thanks @acme/core team", "@acme/core"),
    ("cmdlet", "run Get-ChildItem first", "Get-ChildItem"),
    ("call", "then flush() ends", "flush()"),
    ("qualified", "type std::vector holds", "std::vector"),
    ("snake", "set max_row_count lower", "max_row_count"),
    ("camel", "the rowLimit option", "rowLimit"),
    ("pascal", "a HashMap of them", "HashMap"),
    ("math", "where $e=mc^2$ holds", "$e=mc^2$"),
]


@pytest.mark.parametrize("rule,text,want", SAMPLES)
def test_every_rule_protects_its_sample(rule, text, want):
    found = protect.find_protected(text)
    assert (rule, want) in [(r, text[a:b]) for a, b, r in found]
    assert "".join(text[a:b] for a, b, _ in found).strip() == want.strip()


@pytest.mark.parametrize("text", ["tea and/or coffee", "a plain sentence, with commas; and more.", "10 o'clock (sharp) - maybe"])
def test_prose_is_not_protected(text):
    assert protect.find_protected(text) == []


_ODD = st.lists(st.sampled_from([*"ab XY09._-/\\$%@#:()[]{}<>'\"=+*,;\n", "www.", "://", "localhost", "0x", "--", "::", "->", "C:\\", "Get-", "README", ".env", "v1.2", "[!N]", "aB", "APIs"]), max_size=24).map("".join)


@settings(max_examples=400, deadline=None)
@given(_ODD)
def test_conditions_of_rules_lose_no_match(text):
    possible = set(protect.possible_rules(text))
    assert all(name in possible for name, p in protect._compiled.items() if any(m.end() > m.start() for m in p.finditer(text)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 9)), max_size=12))
def test_spans_are_leftmost_and_longest(pairs):
    spans = [(a, a + n, str(k)) for k, (a, n) in enumerate(pairs)]
    want, at = [], 0
    while True:
        ahead = [s for s in spans if s[0] >= at]
        if not ahead:
            break
        start = min(s[0] for s in ahead)
        best = max((s for s in ahead if s[0] == start), key=lambda s: s[1])
        want.append(best[:2])
        at = best[1]
    assert [s[:2] for s in protect.leftmost_longest(spans)] == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("tickets at $12 or $15 each", []),
        ("only $7$ left", []),
        ("a literal \\$k$ here", []),
        ("rate $\\beta < 1$ for node $n$", ["$\\beta < 1$", "$n$"]),
        ("terms $y_2$ then $u*v$", ["$y_2$", "$u*v$"]),
        ("$q = 4$, sold at $30 per box", ["$q = 4$"]),
        ("he paid $for many plain words$ again", []),
        ("with $\\text{one two three four} = x$ inside", ["$\\text{one two three four} = x$"]),
    ],
)
def test_formulas_between_dollars(text, want):
    assert [text[a:b] for a, b in protect.dollar_math(text)] == want


def test_terms_need_word_edges():
    found = protect.find_protected("Azure and Azures", ("Azure",))
    assert [(a, b) for a, b, r in found if r == "dnt"] == [(0, 5)]


def test_pseudo_and_html_codec():
    assert masking.pseudo("Hello <g1>wörld</g1> &amp; <x2/> straße") == "ÜHELLO <g1>ÜWÖRLD</g1> &amp; <x2/> ÜSTRASSE"
    m = "A <g1>b <g2>c</g2></g1> <x3/> &lt;d&gt;"
    assert masking.from_html(masking.to_html(m)) == m


def test_tags_of_a_translation():
    ok = [] == masking.check_tags({1, 4}, {2, 3}, "<x4/> drei <g3>zwei <g2>eins</g2></g3><x1/>")
    assert ok
    for bad in ("<x4/><g3></g3><g2></g2>", "<x1/><x4/><x4/><g2></g2><g3></g3>", "<x1/><x4/><g2><g3></g2></g3>", "<x1/><x4/><g2></g2><g3>", "<x1/><x4/><g2></g2></g3><g3>", "<x1/><x4/><g2/><g3></g3>", "<x1/><x4/><x9/><g2></g2><g3></g3>"):
        assert masking.check_tags({1, 4}, {2, 3}, bad)


def test_tags_that_belong_together():
    shut, loose = [(["x1", "g2", "x3"], True)], [(["x1", "g2", "x3"], False)]
    assert masking.check_groups(shut, {}, "a <x1/><g2>t</g2><x3/> b") == []
    assert masking.check_groups(loose, {}, "<x1/> a <g2>t</g2> b <x3/>") == []
    assert masking.check_groups(shut, {}, "<x1/><g2>t</g2> b<x3/>") and masking.check_groups(loose, {}, "<g2>t</g2><x1/><x3/>")
    assert masking.check_groups([], {2: '"'}, '<g2>say "no"</g2>') and not masking.check_groups([], {2: '"'}, "say \" <g2>'no'</g2>")


def test_new_markup_is_made_literal():
    e = masking.escaper
    assert e("markdown", "2*3*4 and [x]", "two [x]")("2*3*4 and [x]") == "2\\*3\\*4 and [x]"
    assert e("markdown", "a_b", "c_d")("a_b") == "a_b" and e("cell", "p|q", "p|q")("p|q") == "p\\|q"
    assert e("html", "", "")("R&D <b> &amp;") == "R&amp;D &lt;b> &amp;" and e("attr", "", "", "'")("it's & \"so\"") == "it&#39;s &amp; \"so\""
    assert e("mdtitle", "", "", '"')('a "b"') == 'a \\"b\\"' and e("mdtitle", "", "", "(")("f(x)") == "f\\(x\\)" and e("comment", "*", "")("*") == "*"


def test_lines_are_wrapped_anew():
    text = "alpha beta gamma - delta `one two three` epsilon 12. zeta # eta"
    lines = masking.rewrap(text, 16).split("\n")
    assert " ".join(lines) == text and len(lines) > 3 and all(len(x) <= 16 or "`" in x or x.split(" ")[-1] in ("-", "12.", "#") for x in lines)
    assert not any(x.split(" ")[0] in ("-", "12.", "#") for x in lines) and any("`one two three`" in x for x in lines)
    assert masking.rewrap("a\u00a0b c", 80) == "a\u00a0b c" and masking.rewrap("", 40) == ""


def test_emphasis_keeps_no_blanks_inside():
    assert masking.tight_emphasis("das<g1> ist </g1>so", {1: ("**", "**")}) == "das <g1>ist</g1> so"
    assert masking.tight_emphasis("<g1> x </g1>", {1: ("[", "](u)")}) == "<g1> x </g1>"


def test_inline_signature_sees_markup_only():
    sig = masking.inline_signature
    assert sig("ein **fetter** `code` [Text](u)") == sig("[text](u) and `code` **bold**")
    assert sig("a **b**") != sig("a *b*") and sig("`a`") != sig("`b`") and sig("[a](u)") != sig("[a](v)") and sig("a \\* &amp;") == []


def test_paragraph_start_is_escaped():
    assert masking.render_escape("2) Teile sind dabei.", "Two parts") == "2\\) Teile sind dabei."
    assert masking.render_escape("+ neu", "+ new") == "+ neu" and masking.render_escape("## zwei", "two") == "\\## zwei"


@pytest.mark.parametrize("value,quoted", [("on", True), ("Off", True), ("1_000", True), ("2e5", True), ("- a", True), ("a: b", True), ("end:", True), ("x #y", True), ("onward", False), ("v 1_000", False)])
def test_plain_yaml_values_keep_their_type(value, quoted):
    source = "---\ntitle: Old\n---\n"
    assert masking.render_yaml(value, source, source.index("Old")) == (f'"{value}"' if quoted else value)


TRICKY = [
    "﻿---\r\ntitle: \"A b\"\r\nid: 3\r\n---\r\n\r\n# Head `c`\r\n\r\n> quoted *text*\r\n> more\r\n",
    "| a | b |\n|---|---|\n| one | `two` |\n\n```py\n# keep\n```\n- item **x**\n  more\n1. [x](u \"t\") <b>y</b>\n",
    "Para one\nline two\n===\n\n[ref]: http://x.y\n<div>\nhtml\n</div>\n\ntext &amp; \\* $a+b$ :::\n",
    "",
    "   \n\n",
]


@pytest.mark.parametrize("text", TRICKY)
def test_identity_of_tricky_documents(text):
    parts = [_part(text, s, i) for i, s in enumerate(markdown.segments(text))]
    assert splice(text, parts) == (text, [])


def _part(text, s, i, fn=lambda m: m):
    m, singles, pairs = masking.mask(text[s.start : s.end])
    return {"start": s.start, "end": s.end, "seg_id": f"s{i}", "text": fn(m), "singles": singles, "pairs": {k: {"open": a, "close": b} for k, (a, b) in pairs.items()}}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab #*_`[]()|<>-\n\r\t!&$\\1.:~é﻿")), max_size=80))
def test_identity_property(text):
    segments = markdown.segments(text)
    assert all(a.end <= b.start for a, b in zip(segments, segments[1:], strict=False))
    assert splice(text, [_part(text, s, i) for i, s in enumerate(segments)])[0] == text
    m, singles, pairs = masking.mask(text)
    assert masking.unmask(m, singles, pairs) == text


def test_structure_break_is_reverted():
    text = "First.\n\nSecond.\n"
    parts = [_part(text, s, i) for i, s in enumerate(markdown.segments(text))]
    parts[1]["text"] = "a\n\n\n\nb"
    out, reverted = splice(text, parts)
    assert reverted == ["s1"] and out == text
    many = "".join(f"Word{i} here.\n\n" for i in range(300))
    parts = [_part(many, s, i, lambda m: "x\n\ny") for i, s in enumerate(markdown.segments(many))]
    parts[7]["text"] = "Fine text."
    out, reverted = splice(many, parts)  # more breaks than rounds: all of them go
    assert out == many and len(reverted) == 300


def test_blocks_keep_fences_whole():
    assert markdown.blocks("a\n\n```\nx\n\ny\n```\n\nb") == ["a", "```\nx\n\ny\n```", "b"]


@pytest.mark.parametrize(
    "html,want",
    [
        ('<h1>Hi <b>you</b></h1><script>var a;</script><p>Text</p><img alt="pic">', ["Hi <b>you</b>", "Text", "pic"]),
        ("<p>Use <code>x = 1</code> now</p>", ["Use <code>x = 1</code> now"]),
        ("<p><b>Lead</b> in</p><div><i></i></div>", ["<b>Lead</b> in"]),
        ('<meta name="v" content="width of it"><input placeholder="Your name">', ["Your name"]),
        ('<div class="a notranslate">Keep <b>me</b></div><p translate="no">and me</p><p>not me</p>', ["not me"]),
        ("<div translate=no>in <div>ner</div> out</div>free", ["free"]),
        ("<svg><text>no</text></svg><embed src=a>yes", ["yes"]),
    ],
)
def test_html_segments(html, want):
    assert [html[s.start : s.end] for s in markdown.html_segments(html)] == want


def test_html_skeletons():
    assert markdown.html_skeleton('<a href="x" title="One">') == markdown.html_skeleton('<a href="x" title="Eins">') != markdown.html_skeleton('<a href="y" title="One">')
    assert markdown.attributes('<img Alt=pic width="3" src=\'a b\' hidden>') == [("alt", 9, 12), ("width", 20, 21), ("src", 28, 31)]


def test_html_blocks_inside_markdown():
    text = "Before it.\n\n<div>\n<p>Inside <b>here</b></p>\n<pre>\n</div>\n\n<!-- a\n\nb -->\n<script>\nvar x;\n\nvar y;\n</script>\n\nAfter it.\n"
    assert [text[s.start : s.end] for s in markdown.segments(text)] == ["Before it.", "Inside <b>here</b>", "After it."]


@pytest.mark.parametrize("key,prose", [("teaser", True), ("seo_title", True), ("OG_Description", True), ("nav_title", True), ("alt", False), ("label", False), ("layout", False)])
def test_front_matter_keys(key, prose):
    text = f"---\n{key}: Some words\nkeywords:\n- red fox\n- id\nother:\n- none\n---\n"
    assert [text[s.start : s.end] for s in markdown.segments(text)] == ["Some words"] * prose + ["red fox", "id"]


def test_front_matter_lists_and_formality():
    text = '---\nkeywords: [red fox, "blue", 12]\ntone: Informal\n---\nFormality: x\n'
    assert [text[s.start : s.end] for s in markdown.segments(text)] == ["red fox", "blue", "Formality: x"]
    assert markdown.front_matter_formality(text) == "informal" and markdown.front_matter_formality("tone: informal\n") is None


def test_notes_say_where_a_segment_stands():
    text = "# Top\n\nChoose one of:\n\n- red\n- blue\n\nThen this.\n\n| Name | Use |\n|---|---|\n| fox | runs |\n"
    notes = {text[s.start : s.end]: s.note for s in markdown.segments(text)}
    assert notes["Choose one of:"] == 'section "Top"' == notes["Then this."]
    assert notes["red"] == notes["blue"] == 'section "Top"; list introduced by "Choose one of:"'
    assert notes["Use"] == "" and notes["fox"] == 'table column "Name"' and notes["runs"] == 'table column "Use", row "fox"'


def test_lines_end_at_line_ends_only():
    for eol in ("\n", "\r\n"):
        text = f"One\x0cline\u2028# still one\x85end{eol}more{eol}"
        assert [text[s.start : s.end] for s in markdown.segments(text)] == [text.rstrip()]
    assert len(markdown.segments("# a\rb\r")) == 2


def test_markup_that_a_translation_brings_in():
    def done(source, text):
        return finished(_part(source, markdown.segments(source)[0], 0, lambda m: text), source)

    assert done("Some words here\n", "Einige *neue* Worte") == "Einige \\*neue\\* Worte"
    assert done("Some **bold** words\n", "Ein<g1> fettes </g1>Wort") == "Ein **fettes** Wort"
    assert done("Some words here\n", "- eins") == "\\- eins"
    long = "one two three four five six seven eight\nnine ten eleven twelve thirteen\n"
    assert done(long, "eins zwei drei vier fuenf sechs sieben acht neun zehn elf") == "eins zwei drei vier fuenf sechs sieben\nacht neun zehn elf"


def test_bootstrap_is_reproducible():
    a = X.bootstrap_reduction([100, 200, 50], [1, 2, 0], [5, 1, 3], 300)
    assert a == X.bootstrap_reduction([100, 200, 50], [1, 2, 0], [5, 1, 3], 300)
    assert a[0] == pytest.approx((9 - 3) / 350 * 100) and a[1] <= a[0] <= a[2]
    assert np.isnan(X.bootstrap_reduction([], [], [])[0])


def test_random_numbers_follow_the_sequential_generator():
    def plain(seed, n):
        a, out, full = seed, [], 0xFFFFFFFF
        for _ in range(n):
            a = (a + 0x6D2B79F5) & full
            t = ((a ^ (a >> 15)) * (a | 1)) & full
            t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & full)) & full
            out.append((t ^ (t >> 14)) / 4294967296)
        return out

    assert X.mulberry32(7, 50).tolist() == plain(7, 50)
