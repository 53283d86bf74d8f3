"""Documents to segments and back: extraction, protected spans, assembly with a structure proof."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import anchors as heading_anchors
from ..functions import code_comments, markdown, masking
from ..functions.protect import find_protected
from ..options import Options
from .stages import flat_rows

SEGMENTS = (
    "doc string, seq int, seg_id string, kind string, note string, start int, end int, original string, masked string, "
    "singles map<int,string>, pairs map<int,struct<open:string,close:string>>, passive boolean"
)
ASSEMBLED = "doc string, lang string, text string, reverted array<string>, anchors array<string>, identical boolean, error string"


def spread(df: DataFrame) -> DataFrame:
    """Deals rows over all cores where the input has fewer partitions than that (one small file, say);
    a large input has more and is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def finder(options: Options | None = None, html: bool = False) -> Callable[[str], Iterable[markdown.Segment]]:
    """What finds the segments of a text, as the options switch it."""
    o = options or Options()
    return markdown.html_segments if html else partial(markdown.segments, front_matter=o.front_matter, comments=o.code_comments, docstrings=o.docstrings)


def segments_of(text: str, find: Callable[[str], Iterable[markdown.Segment]], dnt: tuple[str, ...] = (), kinds: tuple[str, ...] | None = None) -> Iterator[tuple]:
    """The fields of SEGMENTS behind doc, of every segment of a text."""
    for i, s in enumerate(find(text)):
        if kinds and s.kind not in kinds:
            continue
        original = text[s.start : s.end]
        masked, singles, pairs = masking.mask(original, dnt)
        ends = [(k, {"open": a, "close": z}) for k, (a, z) in pairs.items()]
        yield i, f"s{i + 1}", s.kind, s.note, s.start, s.end, original, masked, list(singles.items()), ends, not any(c.isalpha() for c in masking.plain_text(masked))


def extract_segments(docs: DataFrame, doc: str = "doc", content: str = "content", dnt: tuple[str, ...] = (), html: bool = False, options: Options | None = None, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """One row per segment, ids s1..sN in document order; a null or blank document yields none.

    With ``kinds`` only segments of these kinds become rows and are masked; ids and seq count all. ``options`` switches front matter, comments and docstrings of code.

    One narrow Python stage: it needs the whole document, reads two columns and never shuffles. Put
    filters before it, Catalyst can't push them through.
    """
    find = finder(options, html)
    rows = lambda d, text: ((d, *s) for s in segments_of(text, find, dnt, kinds))
    picked = docs.select(F.col(doc).cast("string").alias("__doc"), F.col(content).alias("__content")).where(F.trim("__content") != "")
    return flat_rows(picked, [], ["__doc", "__content"], SEGMENTS, rows)


def protected_spans(df: DataFrame, keys: list[str], text: str = "text", dnt: tuple[str, ...] = ()) -> DataFrame:
    """keys, start, end, rule, span of every protected span; offsets in code points."""
    spans = lambda t: ((*s, t[s[0] : s[1]]) for s in find_protected(t, dnt)) if t is not None else ()
    return flat_rows(df.select(*keys, F.col(text).alias("__t")), keys, ["__t"], "start int, end int, rule string, span string", spans)


def rule_matches(text: Column, rule: str) -> Column:
    """All matches of one protection rule, inside the JVM."""
    from ..functions.protect import jvm_pattern

    return F.regexp_extract_all(text, F.lit(jvm_pattern(rule)), F.lit(0))


def assemble(docs: DataFrame, segments: DataFrame, memory: DataFrame, doc: str = "doc", content: str = "content", anchors: bool = False, unwrapped: frozenset[str] = frozenset()) -> DataFrame:
    """doc, lang, text, reverted, anchors, identical, error: translations spliced into their documents.

    memory (doc, lang, seg_id, text) holds masked translations. A translation whose tags or markup don't
    fit is left out; if the structure differs, the translations at the place are withdrawn until it
    is the source's, at worst all of them. Work of a document stays in one task; documents are
    spread by (doc, lang), and only segments with a translation travel. With ``anchors``, headings get an
    empty anchor of their old slug where the translation changes it. Paragraphs of languages in ``unwrapped`` (lower
    case), which don't put blanks between words, stay on one line.
    """
    picked = segments.select("doc", "seg_id", "kind", "start", "end", "masked", "singles", "pairs").join(memory, ["doc", "seg_id"])
    per = picked.groupBy("doc", "lang").agg(F.collect_list(F.struct("start", "end", "seg_id", "kind", "text", "masked", "singles", "pairs")).alias("parts"))
    full = docs.select(F.col(doc).cast("string").alias("doc"), F.col(content).alias("content")).join(per, "doc")
    rows = lambda d, lang, source, parts: [assembled(d, lang, source, parts, anchors, unwrapped)]
    used = {"doc": "__doc", "lang": "__lang", "content": "__content", "parts": "__parts"}
    return flat_rows(full.select(*[F.col(c).alias(n) for c, n in used.items()]), [], list(used.values()), ASSEMBLED, rows)


def assembled(doc: str | None, lang: str | None, source: str, parts, anchors: bool = False, unwrapped: frozenset[str] = frozenset()) -> tuple:
    """The fields of ASSEMBLED, of one document and language."""
    try:
        text, reverted = splice(source, parts, lang is None or lang.lower() not in unwrapped)
        text, added = heading_anchors.preserve(source, text) if anchors else (text, [])
        return doc, lang, text, reverted, added, text == source, None
    except Exception as e:  # a document that can't be assembled stays as it is
        return doc, lang, source, [], [], True, f"{type(e).__name__}: {e}"


# Where the text of a kind of segment stands; all others stand in Markdown.
CONTEXTS = {"cell": "cell", "frontmatter": "yaml", "comment": "comment", "html": "html", "attr": "attr"}
#: What would end a comment or docstring too early.
CLOSERS = ("*/", "-->", '"""', "'''", "*)", "-}", "#>", "--]]")
AT_ONCE = 64  # values of a column that become Python results at once
ROUNDS = 100  # of withdrawing translations from one document; then all of them go
NARROWEST = 40  # columns of a paragraph that is wrapped anew


def finished(part, source: str, wrap: bool = True) -> str | None:
    """The bytes of a translated segment for its place in the document; None if they would change its markup.

    A text that is the source's own keeps the source's bytes.
    """
    singles = dict(part["singles"] or {})
    pairs = {k: (v["open"], v["close"]) for k, v in dict(part["pairs"] or {}).items()}
    old, kind = source[part["start"] : part["end"]], part["kind"] if "kind" in part else "paragraph"
    before = part["masked"] if "masked" in part else masking.mask(old)[0]
    text = part["text"]
    if masking.check_tags(set(singles), set(pairs), text):
        return None
    if text == before:
        return old
    context = CONTEXTS.get(kind, "markdown")
    if context in ("markdown", "cell"):
        text = masking.tight_emphasis(text, pairs)
    quote = source[part["start"] - 1 : part["start"]] if kind == "attr" else ""
    made = masking.unmask(text, singles, pairs, masking.escaper(context, masking.plain_text(text), masking.plain_text(before), quote))
    if kind == "frontmatter":
        return masking.render_yaml(made, source, part["start"])
    if kind == "comment":
        return None if made.rstrip().endswith("\\") or any(c in made and c not in old for c in CLOSERS) else made
    if kind == "html":
        return made if markdown.html_skeleton(made) == markdown.html_skeleton(old) else None
    if kind == "attr":
        return made
    if masking.inline_signature(made) != masking.inline_signature(old):
        return None
    lines = old.splitlines()
    if wrap and kind == "paragraph" and len(lines) > 1 and "\n" not in made:
        made = masking.rewrap(made, max(NARROWEST, *map(len, lines)), "\r\n" if "\r\n" in old else "\n")
    return masking.render_escape(made, old)


@lru_cache(maxsize=4)  # a document comes once for each language
def _skeleton(source: str) -> tuple[str, ...]:
    return tuple(markdown.skeleton(source))


def splice(source: str, parts, wrap: bool = True) -> tuple[str, list[str]]:
    """(document with its translations, ids of those left out).

    Where the outline differs from the source's, the translations that overlap or touch the first block
    that differs are withdrawn; after ROUNDS of that, all of them.
    """
    todo, reverted = [], []
    for p in sorted(parts, key=lambda p: p["start"]):
        made = finished(p, source, wrap)
        if made is None:
            reverted.append(p["seg_id"])
        else:
            todo.append((p["start"], p["end"], made, p["seg_id"]))

    def build(items):
        out, spans, at, length = [], [], 0, 0
        for a, b, t, _ in items:
            out += [source[at:a], t]
            length += a - at
            spans.append((length, length + len(t)))
            length += len(t)
            at = b
        return "".join([*out, source[at:]]), spans

    want = _skeleton(source)
    text, spans = build(todo)
    for r in range(ROUNDS + 1):
        if text == source:
            break
        got = markdown.outline(text)
        if tuple(sig for sig, _, _ in got) == want:
            break
        k = next((i for i, (x, y) in enumerate(zip(want, got, strict=False)) if x != y[0]), min(len(want), len(got)))
        a, b = got[k][1:] if k < len(got) else (got[-1][1:] if got else (0, 0))
        guilty = {i for i, (x, y) in enumerate(spans) if x <= b and y >= a and r < ROUNDS}
        if not guilty and r < ROUNDS:  # the cause lies before the block
            guilty = {max((i for i, (x, _) in enumerate(spans) if x <= b), default=0)}
        reverted += [item[3] for i, item in enumerate(todo) if i in guilty or r == ROUNDS]
        todo = [] if r == ROUNDS else [item for i, item in enumerate(todo) if i not in guilty]
        text, spans = build(todo)
    return text, reverted


def structure_differs(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """keys, differs: whether two texts have other skeletons; null where one is null. One narrow stage."""

    @F.pandas_udf("boolean")
    def differ(x: pd.Series, y: pd.Series) -> pd.Series:
        both = zip(x, y, strict=True)
        return pd.Series([markdown.skeleton(s) != markdown.skeleton(t) if isinstance(s, str) and isinstance(t, str) else None for s, t in both], dtype=object)

    return df.select(*keys, differ(F.col(a), F.col(b)).alias("differs"))


def map_column(df: DataFrame, source: str, target: str, fn: Callable[[str], object], ddl: str) -> DataFrame:
    """Adds fn(source) as a vectorized column; null stays null."""

    @F.pandas_udf(ddl)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            for at in range(0, max(1, len(s)), AT_ONCE):  # a few values of any size, so results of a batch don't pile up
                yield s.iloc[at : at + AT_ONCE].map(lambda v: None if v is None else fn(v))

    return df.withColumn(target, apply(F.col(source)))


def comment_prose(df: DataFrame, keys: list[str], language: Column | str, code: str = "code") -> DataFrame:
    """keys, start, end, kind, prose of every line of prose in comments and docstrings of code.

    Code of an unknown or null language yields no rows, nor does null code. One narrow Python stage.
    """
    picked = df.select(*keys, (F.col(language) if isinstance(language, str) else language).alias("__l"), F.col(code).alias("__c"))
    lines = lambda n, c: ((*s, c[s[0] : s[1]]) for s in code_comments.prose(code_comments.language(n), c)) if n is not None and c is not None else ()
    return flat_rows(picked, keys, ["__l", "__c"], "start int, end int, kind string, prose string", lines)


def heading_slugs(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, seq, heading, slug, own_id of every heading with letters; null text has none."""
    found = lambda t: ((i, *h[1:]) for i, h in enumerate(heading_anchors.headings(t))) if t is not None else ()
    return flat_rows(df.select(*keys, F.col(text).alias("__t")), keys, ["__t"], "seq int, heading string, slug string, own_id boolean", found)
