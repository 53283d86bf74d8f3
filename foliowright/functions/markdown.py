"""A line-oriented Markdown scanner with exact offsets.

Every translatable stretch of a document is a segment (kind, start, end); all other bytes are skeleton.
What is not understood stays skeleton, so it is never changed: replacing segments by themselves gives the
document back byte for byte.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache

from . import code_comments

# Front matter keys with prose and with lists of prose; elements whose content is never translated, inline
# and void elements; attributes of HTML and of components that hold prose.
PROSE_KEYS = frozenset(
    "title subtitle titlesuffix description summary excerpt abstract caption heading lead teaser tagline seo_title seotitle seo_description og_title "
    "og_description twitter_title twitter_description sidebar_label nav_title linktitle menu_title".split()
)
LIST_KEYS = frozenset(["keywords"])
NO_TRANSLATE = frozenset("script style pre code kbd samp var tt textarea svg math template noscript iframe object".split())
VOID_ELEMENTS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
TEXT_ATTRIBUTES = frozenset("alt title aria-label aria-description aria-placeholder placeholder label summary abbr".split())
COMPONENT_ATTRIBUTES = TEXT_ATTRIBUTES | frozenset("description caption heading subtitle tooltip message emptytext helptext hint buttontext linktext".split())
INLINE_ELEMENTS = frozenset(
    "a abbr b bdi bdo br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr big nobr "
    "picture source".split()
)
_FORMALITY = re.compile(r"^(?:formality|translation_formality|translation-formality|tone):[ \t]*[\"']?([A-Za-z]+)", re.IGNORECASE | re.MULTILINE)
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+\Z")


@dataclass(frozen=True)
class Segment:
    kind: str
    start: int
    end: int
    note: str = ""


_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*([^\n`]*)$")
_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_LIST = re.compile(r"^([ \t]*)([-*+]|\d{1,9}[.)])([ \t]+)(\[[ xX]\][ \t]+)?(?=\S)")
_QUOTE = re.compile(r"^[ ]{0,3}>[ ]?")
_DEFINITION = re.compile(r"^ {0,3}\[[^\]\n]+\]:\s*\S+")
_NOTE = re.compile(r"^ {0,3}\[\^[^\]\n]+\]:[ \t]+(?=\S)")
_DIRECTIVE = re.compile(r"^ {0,3}:{2,}.*$|^\s*\{\{[<%].*[%>]\}\}\s*$|^\s*\[![A-Za-z]+\]\s*$")
_TABLE_RULE = re.compile(r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")
_HTML = re.compile(r"^ {0,3}<(?:[A-Za-z/!?])")
_KEY = re.compile(r"^([ \t]*(?:- )?)([A-Za-z_][\w-]*):(?:[ \t]+|$)(.*?)[ \t]*$")
_ITEM = re.compile(r"^[ \t]*-[ \t]+(.*?)[ \t]*$")
_WHOLE_ELEMENT = re.compile(r"^ {0,3}<(script|pre|style|textarea)(?=[\s>]|$)", re.IGNORECASE)
_BLOCK_SCALAR = re.compile(r"[|>][-+\d]{0,2}(?:\s+#.*)?$")
_LETTER = re.compile(r"[^\W\d_]")


def _front_matter(lines: list[tuple[int, str]]) -> tuple[int, list[Segment]]:
    """Lines of a YAML block at the top and the prose values inside it."""
    if not lines or lines[0][1].rstrip() != "---":
        return 0, []
    end = next((i for i in range(1, len(lines)) if lines[i][1].rstrip() in ("---", "...")), None)
    if end is None:
        return 0, []
    found: list[Segment] = []

    def value(at: int, text: str, key: str) -> None:
        """One plain or quoted scalar that starts at ``at``; flow collections, anchors and tags stay as they are."""
        if not text or not _LETTER.search(text) or text[0] in "[{|>&*!":
            return
        inside = text[0] in "\"'"
        if inside and (len(text) < 3 or text[-1] != text[0]):
            return
        found.append(Segment("frontmatter", at + inside, at + len(text) - inside, key))

    block = None  # key and indent of the block scalar that is being read
    items = None  # key and indent of the list that is being read
    for at, line in lines[1:end]:
        indent = len(line) - len(line.lstrip())
        if block and (indent > block[1] or not line.strip()):
            if block[0] in PROSE_KEYS and _LETTER.search(line):
                found.append(Segment("frontmatter", at + indent, at + len(line.rstrip()), block[0]))
            continue
        if items and (m := _ITEM.match(line)) and indent >= items[1]:
            value(at + m.start(1), m[1], items[0])
            continue
        m = _KEY.match(line)
        key = m[2].lower() if m else ""
        block = (key, len(m[1])) if m and _BLOCK_SCALAR.match(m[3]) else None
        items = (key, len(m[1])) if key in LIST_KEYS and not m[3] else None
        if key in LIST_KEYS and m[3].startswith("[") and m[3].endswith("]"):
            for part in re.finditer(r"[^,\[\]\s][^,\[\]]*", m[3]):
                value(at + m.start(3) + part.start(), part[0].rstrip(), key)
        elif key in PROSE_KEYS:
            value(at + m.start(3), m[3], key)
    return end + 1, found


def front_matter_formality(text: str) -> str | None:
    """The formality that a document asks for at the top level of its front matter, in lower case."""
    lines = text.lstrip("﻿").splitlines()
    if not lines or lines[0].rstrip() != "---":
        return None
    end = next((i for i in range(1, len(lines)) if lines[i].rstrip() in ("---", "...")), 0)
    m = _FORMALITY.search("\n".join(lines[1:end]))
    return m[1].lower() if m else None


def _clipped(s: str, n: int = 40) -> str:
    s = " ".join(s.split())
    return s if len(s) <= n else s[: n - 1] + "…"


def _cells(at: int, line: str, heads: list[str] | None = None) -> list[Segment]:
    """The cells of a row; with the heads of its table, each notes its column and what its row begins with."""
    out, start = [], 0
    cuts = [i for i in range(len(line)) if line[i] == "|" and (i == 0 or line[i - 1] != "\\")]
    parts = []
    for cut in [*cuts, len(line)]:
        parts.append((start, line[start:cut]))
        start = cut + 1
    first = next((p for _, p in parts if p.strip()), "")
    shift = bool(line.lstrip().startswith("|"))
    for k, (start, part) in enumerate(parts):
        if _LETTER.search(part):
            note = ""
            if heads is not None:
                column = heads[k - shift] if 0 <= k - shift < len(heads) else ""
                note = ", ".join(x for x in (f'table column "{_clipped(column)}"' if column else "", f'row "{_clipped(first)}"' if part is not first and _LETTER.search(first) else "") if x)
            a = start + len(part) - len(part.lstrip())
            out.append(Segment("cell", at + a, at + start + len(part.rstrip()), note))
    return out


def segments(text: str, front_matter: bool = True, comments: bool = True, docstrings: bool = True) -> list[Segment]:
    """Segments in document order; they never overlap. Comments and docstrings are those of fenced code."""
    shift = 1 if text.startswith("﻿") else 0
    lines, at = [], shift
    for raw in _LINE.findall(text[shift:]):
        lines.append((at, raw.rstrip("\r\n")))
        at += len(raw)
    skip, found = _front_matter(lines)
    out = found if front_matter else []
    open_: list[tuple[int, int]] = []  # lines of the paragraph that is being read
    note = ""
    section: list[str] = []
    lead = ""  # the paragraph in front of the list that is being read
    listed = False

    def close(kind: str = "paragraph") -> None:
        if open_:
            a, b = open_[0][0], open_[-1][1]
            if _LETTER.search(text[a:b]):
                out.append(Segment(kind, a, b, "; ".join(x for x in (note, f'list introduced by "{lead}"' if lead else "") if x)))
            open_.clear()

    i = skip
    while i < len(lines):
        at, line = lines[i]
        inner = 0
        while ">" in line[inner : inner + 4] and (m := _QUOTE.match(line[inner:])):
            inner += m.end()
        body = line[inner:]
        mark_ = body.lstrip()[:1]  # no pattern of a block is tried that can't begin with it
        if mark_ in ("`", "~") and (m := _FENCE.match(body)):
            close()
            mark, i = m[1], i + 1
            first = i
            while i < len(lines):
                rest = lines[i][1][inner:] if inner and lines[i][1].lstrip().startswith(">") else lines[i][1]
                i += 1
                if re.match(rf"^\s*{re.escape(mark[0])}{{{len(mark)},}}\s*$", rest):
                    break
            else:
                first = i  # no end: all the rest of the document stays as it is
            name = code_comments.language(m[2])
            if name and first < i - 1 and not inner:
                a, b = lines[first][0], lines[i - 1][0]
                for x, y, kind in code_comments.prose(name, text[a:b], comments, docstrings):
                    out.append(Segment("comment", a + x, a + y, f"{name} {kind}"))
            continue
        if not mark_ or mark_ in ":{[" and (_DIRECTIVE.match(body) or _DEFINITION.match(body) and not _NOTE.match(body) and not open_):
            close()
        elif open_ and mark_ in "=-" and _SETEXT.match(body) and len(open_) == 1:
            close("heading")
        elif mark_ in "*-_" and _RULE.match(body):
            close()
        elif mark_ == "#" and (m := _HEADING.match(body)):
            close()
            lead, listed = "", False
            if m[2] and _LETTER.search(m[2]):
                a, b = m.span(2)
                out.append(Segment("heading", at + inner + a, at + inner + b, note))
                section = [*section[: len(m[1]) - 1], m[2].strip()]
                note = ("section " + '"' + " > ".join(section)[:160] + '"') if section else ""
        elif not open_ and mark_ == "<" and _HTML.match(body):
            # comments and some elements run to their end, other blocks to a blank line
            until = "-->" if body.lstrip().startswith("<!--") else f"</{m[1].lower()}>" if (m := _WHOLE_ELEMENT.match(body)) else None
            first = i
            while i < len(lines) and (until or lines[i][1].strip()):
                i += 1
                if until and until in lines[i - 1][1].lower():
                    break
            if not inner:
                a, b = lines[first][0], lines[i - 1][0] + len(lines[i - 1][1])
                out += [Segment(s.kind, a + s.start, a + s.end, s.note) for s in html_segments(text[a:b])]
            continue
        elif not open_ and (line.startswith("    ") or line.startswith("\t")) and not _LIST.match(line):
            pass
        elif "|" in body and i + 1 < len(lines) and not open_ and _TABLE_RULE.match(lines[i + 1][1][inner:]) and "-" in lines[i + 1][1]:
            heads: list[str] | None = None
            while i < len(lines) and "|" in lines[i][1]:
                at, line = lines[i]
                if heads is None or not _TABLE_RULE.match(line[inner:]):
                    out += _cells(at + inner, line[inner:], heads)
                heads = heads if heads is not None else [c.strip() for c in re.split(r"(?<!\\)\|", line[inner:].strip().removeprefix("|").removesuffix("|"))]
                i += 1
            continue
        else:
            m = (_LIST.match(body) or _NOTE.match(body)) if mark_ in "-*+[" or mark_.isdecimal() else None
            if m:
                close()
                if not listed and out and out[-1].kind == "paragraph":
                    lead = _clipped(text[out[-1].start : out[-1].end], 80)
                inner += m.end()
                listed = True
            elif not open_ and not line.startswith((" ", "\t")):
                lead, listed = "", False
            elif open_:
                close() if inner and not lines[i - 1][1].lstrip().startswith(">") else None
            a = at + inner + len(line[inner:]) - len(line[inner:].lstrip())
            b = at + len(line.rstrip())
            if open_ and (inner or text[open_[-1][1] : a].strip(" \t\r\n")):
                close()  # a container's prefix is skeleton: one segment a line
            if b > a:
                open_.append((a, b))
        i += 1
    close()
    return sorted(out, key=lambda s: s.start)


KEPT = 1 << 20  # characters of a text whose segments are remembered


@lru_cache(maxsize=4)
def _kept(text: str) -> tuple[Segment, ...]:
    return tuple(segments(text))


def scanned(text: str) -> tuple[Segment, ...]:
    """Segments of a text; those of the last few texts of ordinary size are remembered, since outline and headings of a document follow each other."""
    return _kept(text) if len(text) <= KEPT else tuple(segments(text))


def outline(text: str) -> list[tuple[str, int, int]]:
    """(signature, start, end) of every block: kinds, and hashes of what must not change."""
    out: list[tuple[str, int, int]] = []
    at = 0

    def raw(a: int, b: int) -> None:
        gap = text[a:b].strip()
        if gap:
            out.append(("raw:" + hashlib.sha256(gap.encode("utf-8", "surrogatepass")).hexdigest()[:12], a, b))

    for s in scanned(text):
        a, b = s.start, s.end
        if s.kind == "frontmatter" and text[a - 1 : a] in ("'", '"') and text[b : b + 1] == text[a - 1 : a]:
            a, b = a - 1, b + 1  # a value's quotes may change
        raw(at, a)
        out.append((s.kind, a, b))
        at = b
    raw(at, len(text))
    return out


def skeleton(text: str) -> list[str]:
    return [sig for sig, _, _ in outline(text)]


def code_blocks(text: str) -> list[tuple[str, str]]:
    """(language, code) of every fenced block, also of one that nothing closes."""
    out: list[tuple[str, str]] = []
    open_: tuple[str, str] | None = None  # mark and language
    code: list[str] = []
    for raw in _LINE.findall(text):
        line = raw.rstrip("\r\n")
        if open_:
            if re.match(rf"^ {{0,3}}{re.escape(open_[0][0])}{{{len(open_[0])},}}\s*$", line):
                out.append((open_[1], "\n".join(code)))
                open_, code = None, []
            else:
                code.append(line)
        elif m := _FENCE.match(line):
            open_ = (m[1], (m[2].split() or [""])[0])
    if open_:
        out.append((open_[1], "\n".join(code)))
    return out


def blocks(text: str) -> list[str]:
    """Blank-line blocks; fences and a front matter block stay whole."""
    out: list[str] = []
    now: list[str] = []
    fence = None
    lines = text.split("\n")
    matter = bool(lines) and lines[0].rstrip() == "---"
    for i, line in enumerate(lines):
        m = re.match(r"^\s*(`{3,}|~{3,})", line)
        if fence:
            fence = None if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) else fence
        elif m:
            fence = m[1]
        if matter:
            now.append(line)
            matter = not (i and line.rstrip() in ("---", "..."))
        elif not fence and not line.strip():
            if now:
                out.append("\n".join(now))
            now = []
        else:
            now.append(line)
    if now:
        out.append("\n".join(now))
    return out


_TOKEN = re.compile(r"<!--.*?-->|<![^>]*>|<\?.*?\?>|</?[A-Za-z][^\s/>]*(?:\s+(?:[^\s=>\"']+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']+))?))*\s*/?>", re.DOTALL)
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
_KEEP = re.compile(r"\stranslate\s*=\s*[\"']?no\b|\sclass\s*=\s*[\"'][^\"']*\bnotranslate\b", re.IGNORECASE)


def attributes(tag: str) -> list[tuple[str, int, int]]:
    """(name in lower case, start, end of the value without quotes) of the attributes of a tag that have a value."""
    name = _NAME.match(tag)
    out = []
    for a in _ATTRIBUTE.finditer(tag, name.end() if name else 0):
        g = next(k for k in (2, 3, 4) if a[k] is not None)
        out.append((a[1].lower(), a.start(g), a.end(g)))
    return out


def tag_skeleton(tag: str) -> str:
    """A tag whose translatable attribute values are blanked."""
    out, at = [], 0
    for name, a, b in attributes(tag):
        if name in TEXT_ATTRIBUTES:
            out += [tag[at:a], "…"]
            at = b
    return "".join([*out, tag[at:]])


def html_skeleton(html: str) -> list[str]:
    return [tag_skeleton(m[0]) for m in _TOKEN.finditer(html)]


def html_segments(html: str) -> list[Segment]:
    """Maximal runs of text and inline elements, and prose attributes of tags outside such runs.

    Opaque elements and elements marked not to be translated are skipped: a block one ends the run, an inline
    one stays inside it as it is.
    """
    out: list[Segment] = []
    run: list[int] = []
    aside: list[Segment] = []  # attributes of the run's tags, which count where the run has no prose
    prose = False  # the run holds letters outside tags and opaque elements
    opaque: tuple[str, int] | None = None  # name and depth of the element that is skipped

    def close() -> None:
        nonlocal prose
        if run and prose:
            part = html[run[0] : run[1]]
            a = run[0] + len(part) - len(part.lstrip())
            out.append(Segment("html", a, run[0] + len(part.rstrip())))
        else:
            out.extend(aside)
        run.clear()
        aside.clear()
        prose = False

    def extend(a: int, b: int) -> None:
        if run:
            run[1] = b
        else:
            run[:] = [a, b]

    at = 0
    for m in _TOKEN.finditer(html):
        text = html[at : m.start()]
        if not opaque and text.strip():
            extend(at, m.start())
            prose = prose or bool(_LETTER.search(text))
        at = m.end()
        tag = m[0]
        name = n[1].lower() if (n := _NAME.match(tag)) else ""
        closing = tag.startswith("</")
        empty = tag.endswith("/>") or name in VOID_ELEMENTS
        if opaque:
            if name == opaque[0] and not empty:
                depth = opaque[1] + (-1 if closing else 1)
                opaque = (name, depth) if depth else None
                if not depth and name in INLINE_ELEMENTS and run:
                    extend(m.start(), m.end())
            continue
        inline = name in INLINE_ELEMENTS
        if not inline:
            close()
        elif run or not closing:
            extend(m.start(), m.end())
        if not closing and not empty and (name in NO_TRANSLATE or _KEEP.search(tag)):
            opaque = (name, 1)
        elif name and not closing and not _KEEP.search(tag):
            for attribute, a, b in attributes(tag):
                if attribute in TEXT_ATTRIBUTES and _LETTER.search(tag[a:b]):
                    (aside if inline else out).append(Segment("attr", m.start() + a, m.start() + b, attribute))
    if not opaque and html[at:].strip():
        extend(at, len(html))
        prose = prose or bool(_LETTER.search(html[at:]))
    close()
    return sorted(out, key=lambda s: s.start)
