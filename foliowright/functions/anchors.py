"""Heading slugs, and anchors that keep links to the slugs of a source alive in its translation."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from . import markdown, masking

_EXPLICIT = re.compile(r"\{#[^}\s]+\}\s*$|<a\s+(?:id|name)\s*=", re.IGNORECASE)
SHORT = 64  # characters of a heading that is remembered


def slug(text: str) -> str:
    """Lower case; letters, marks, numbers, connectors and hyphens stay, a blank becomes a hyphen."""
    kept = (c for c in text.lower() if c in "- " or unicodedata.category(c)[0] in "LMN" or unicodedata.category(c) == "Pc")
    return "".join(kept).replace(" ", "-")


def unique(slugs: list[str]) -> list[str]:
    """Every slug once: later ones get the next free number of their name."""
    last: dict[str, int] = {}
    out = []
    for s in slugs:
        name = s
        while name in last:
            last[s] += 1
            name = f"{s}-{last[s]}"
        last[name] = 0
        out.append(name)
    return out


def heading_text(raw: str) -> str:
    """Text and inline code of a heading, without markup, HTML and images."""
    masked, singles, pairs = masking.mask(raw)
    out, images = [], set()
    for kind, v in masking.tokens(masked):
        if kind == "open" and pairs[v][0].startswith("!["):
            images.add(v)
        elif kind == "close":
            images.discard(v)
        elif images or kind == "open":
            continue
        elif kind == "text":
            out.append(masking.unescape(v))
        else:
            s = singles[v]
            out.append(s.strip("`").strip() if s[0] == "`" else "" if s[0] == "<" or s.startswith("![") else s[1:] if re.fullmatch(r"\\[^\w\s]", s) else s)
    return "".join(out).strip()


@lru_cache(maxsize=1 << 15)
def _short(raw: str) -> tuple[str, str]:
    plain = heading_text(raw)
    return plain, slug(plain)


def _named(raw: str) -> tuple[str, str]:
    """Text and slug of a heading; short ones come back often and are remembered."""
    return _short(raw) if len(raw) <= SHORT else _short.__wrapped__(raw)


def headings(text: str) -> list[tuple[int, str, str, bool]]:
    """(start of the content, text, unique slug, has an id of its own) of every heading with letters."""
    found = [(s.start, text[s.start : s.end]) for s in markdown.scanned(text) if s.kind == "heading"]
    named = [_named(raw) for _, raw in found]
    return [(at, t, s, bool(_EXPLICIT.search(raw))) for (at, raw), (t, _), s in zip(found, named, unique([s for _, s in named]), strict=True)]


def preserve(source: str, translated: str) -> tuple[str, list[str]]:
    """The translation with an empty anchor before each heading whose slug differs from the source's, and
    these slugs. Headings pair up by position; where their number differs nothing is inserted."""
    old, new = headings(source), headings(translated)
    if len(old) != len(new):
        return translated, []
    out, at, added = [], 0, []
    for (_, _, was, own), (start, _, now, owns) in zip(old, new, strict=True):
        if was and was != now and not own and not owns:
            out += [translated[at:start], f'<a id="{was}"></a>']
            at = start
            added.append(was)
    return "".join([*out, translated[at:]]), added
