"""Scalar functions as Catalyst expressions; no row leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of error severities; bounds of the length ratio; line-break and word patterns.
SEVERITY = {"minor": 1.0, "major": 5.0, "critical": 10.0}
RATIO = (0.4, 3.0)
RATIO_FROM = 25
TAGS = r"<(/?)([gx])(\d+)\s*(/?)>"


def utf16_length(c: Column) -> Column:
    return F.octet_length(F.encode(c, "UTF-16LE")) / 2


def word_count(c: Column) -> Column:
    """Words that hold a letter."""
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w.rlike(r"\p{L}"))).cast("long")


def one_line(c: Column) -> Column:
    return F.regexp_replace(c, r"[\r\n]+", " ")


def plain_words(c: Column) -> Column:
    """Tags become blanks and runs of blanks one."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"\s+", " "))


def xml_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def xml_unescape(c: Column) -> Column:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def masked_plain(c: Column) -> Column:
    return xml_unescape(F.regexp_replace(c, TAGS, ""))


def same_tags(a: Column, b: Column) -> Column:
    """True where two masked texts hold the same tags, each as often."""
    listed = lambda c: F.array_sort(F.regexp_extract_all(c, F.lit(TAGS), F.lit(0)))
    return listed(a) == listed(b)


def sanitize(translated: Column, source: Column) -> Column:
    """One line, with the outer white space of the source."""
    body = F.trim(F.regexp_replace(translated, r"\s*[\r\n]+\s*", " "))
    return F.concat(F.regexp_extract(source, r"^(\s*)", 1), body, F.regexp_extract(source, r"(\s*)$", 1))


def ratio_fails(source: Column, translated: Column, low: float = RATIO[0], high: float = RATIO[1]) -> Column:
    n = utf16_length(source)
    ratio = utf16_length(translated) / n
    return F.when(n < RATIO_FROM, False).otherwise((ratio < low) | (ratio > high))


def untranslated(source: Column, translated: Column) -> Column:
    """Equal texts of four or more words with three letters each."""
    words = F.size(F.filter(F.split(source, r"\s+"), lambda w: w.rlike(r"\p{L}{3,}")))
    return (words >= 4) & (source == translated)


def clip(c: Column, n: int = 80) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


def hint(c: Column) -> Column:
    flat = F.regexp_replace(c, r"\s+", " ")
    return F.when(F.length(flat) > 80, F.concat(F.substring(flat, 1, 77), F.lit("..."))).otherwise(flat)


def slug(c: Column) -> Column:
    return F.replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N}\p{Pc}\- ]", ""), F.lit(" "), F.lit("-"))


def penalty(severities: Column) -> Column:
    weight = lambda s: F.when(s == "critical", 10.0).when(s == "major", 5.0).when(s == "minor", 1.0).otherwise(0.0)
    return F.aggregate(severities, F.lit(0.0), lambda acc, s: acc + weight(s))


def verdict(first: Column, second: Column) -> Column:
    """Two position-swapped answers: the agreed side, 'inconsistent' if both decide differently, else tie."""
    decided = first.isin("on", "off") & second.isin("on", "off")
    return F.when(first.isNull() | second.isNull(), "error").when(decided & (first == second), first).when(decided, "inconsistent").otherwise("tie")


def majority(votes: Column) -> Column:
    on = F.size(F.filter(votes, lambda v: v == "on"))
    off = F.size(F.filter(votes, lambda v: v == "off"))
    return F.when(on > off, "on").when(off > on, "off").otherwise("tie")


def same_language(a: Column, b: Column) -> Column:
    base = lambda c: F.lower(F.split(c, "[-_]")[0])
    return base(a) == base(b)


# Document categories by name, first match wins.
CATEGORIES = (
    (r"^mixed-", "mixed"), (r"^docstrings-", "docstrings"), (r"^code-", "code"), (r"^frontmatter-", "front matter"), (r"^math-", "math"),
    (r"\.mdx$|^mdx-", "MDX"), (r"^(anchors-|toc-|links-)", "links and anchors"), (r"^(html-|images-)", "HTML and images"),
    (r"^(admonitions-|directives|msdocs-|hugo-)", "dialects"),
    (r"^(emphasis-|escapes-|line-breaks|crlf-|unicode-|tables-|footnotes|task-lists|nested-lists|single-word|inline-code|filenames-|identifiers-|numbers-|product-)", "syntax edge cases"),
)
# Vendor families by model name.
FAMILIES = (("claude", "anthropic"), ("gemini", "google"), ("grok", "xai"), ("mai", "microsoft"))


def category(doc: Column) -> Column:
    out = F.lit("prose and UI")
    for pattern, name in reversed(CATEGORIES):
        out = F.when(doc.rlike(pattern), name).otherwise(out)
    return out


def family(model: Column) -> Column:
    out = F.lit("openai")
    for prefix, name in reversed(FAMILIES):
        out = F.when(F.lower(model).startswith(prefix), name).otherwise(out)
    return out


def formality(option: Column, front_matter: Column, register: Column) -> Column:
    return F.coalesce(option, front_matter, F.when(register == "informal", "informal"), F.lit("formal"))


# English names of languages by code, those of regions and scripts first.
LANGUAGE_NAMES = dict(
    x.split(":")
    for x in (
        "en-us:American English,en-gb:British English,en-au:Australian English,en-ca:Canadian English,pt-pt:European Portuguese,pt-br:Brazilian Portuguese,"
        "es-es:European Spanish,es-mx:Mexican Spanish,es-419:Latin American Spanish,fr-ca:Canadian French,fr-ch:Swiss French,de-at:Austrian German,"
        "de-ch:Swiss High German,nl-be:Flemish,zh-hans:Simplified Chinese,zh-hant:Traditional Chinese,sr-latn:Serbian (Latin),sr-cyrl:Serbian (Cyrillic),"
        "af:Afrikaans,ar:Arabic,bg:Bulgarian,bn:Bangla,ca:Catalan,cs:Czech,cy:Welsh,da:Danish,de:German,el:Greek,en:English,es:Spanish,et:Estonian,eu:Basque,"
        "fa:Persian,fi:Finnish,fil:Filipino,fr:French,ga:Irish,gl:Galician,he:Hebrew,hi:Hindi,hr:Croatian,hu:Hungarian,hy:Armenian,id:Indonesian,is:Icelandic,"
        "it:Italian,ja:Japanese,ka:Georgian,kk:Kazakh,ko:Korean,lt:Lithuanian,lv:Latvian,mk:Macedonian,ms:Malay,mt:Maltese,nb:Norwegian Bokmål,nl:Dutch,"
        "nn:Norwegian Nynorsk,no:Norwegian,pl:Polish,pt:Portuguese,ro:Romanian,ru:Russian,sk:Slovak,sl:Slovenian,sq:Albanian,sr:Serbian,sv:Swedish,sw:Swahili,"
        "ta:Tamil,th:Thai,tr:Turkish,uk:Ukrainian,ur:Urdu,vi:Vietnamese,zh:Chinese"
    ).split(",")
)


def language_name(code: Column) -> Column:
    """The name of a language with its region or script, else by the base of its code, else the code itself."""
    names = F.create_map(*[F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, F.lower(code)), F.try_element_at(names, F.lower(F.split(code, "[-_]")[0])), code)


def percent(c: Column, digits: int = 1) -> Column:
    return F.when(c.isNull() | F.isnan(c), "n/a").otherwise(F.concat(F.format_string(f"%.{digits}f", c.cast("double") * 100), F.lit("%")))


def p_value(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c), "n/a").when(c < 0.001, "< 0.001").otherwise(F.format_string("%.3f", c.cast("double")))


def switch(c: Column) -> Column:
    """true, 1, yes, on / false, 0, no, off; anything else is null."""
    t = F.lower(F.trim(c))
    return F.when(t.isin("true", "1", "yes", "on"), True).when(t.isin("false", "0", "no", "off"), False)
