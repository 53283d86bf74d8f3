"""Functions for SQL: each is registered under its name and works on columns of text.

Expressions that Catalyst knows need no registration; what stands here are the scanners. They run in Arrow
batches. Null text gives null, or no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import anchors, code_comments, markdown, masking, protect


def _column(fn, ddl: str):
    @F.pandas_udf(ddl)
    def apply(s: pd.Series) -> pd.Series:
        return s.map(lambda v: fn(v) if isinstance(v, str) else None)

    return apply


def _pair(fn, ddl: str):
    @F.pandas_udf(ddl)
    def apply(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([fn(x, y) if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b, strict=True)], dtype=object)

    return apply


def _untranslated(source: str, made: str) -> bool:
    plain = masking.plain_text(source).strip()
    return len([w for w in plain.split() if masking.LONG_WORD.search(w)]) >= 4 and masking.plain_text(made).strip() == plain


def _tag_faults(source: str, made: str) -> list[str]:
    tags = masking.tokens(source)
    return masking.check_tags({n for k, n in tags if k == "x"}, {n for k, n in tags if k == "open"}, made)


FUNCTIONS = {
    "protected_spans": lambda: _column(protect.find_protected, "array<struct<start:int,end:int,rule:string>>"),
    "dollar_math": lambda: _column(protect.dollar_math, "array<struct<start:int,end:int>>"),
    "mask_text": lambda: _column(lambda t: masking.mask(t)[0], "string"),
    "masked_plain_text": lambda: _column(masking.plain_text, "string"),
    "md_blocks": lambda: _column(markdown.blocks, "array<string>"),
    "md_segments": lambda: _column(lambda t: [(s.kind, s.start, s.end) for s in markdown.segments(t)], "array<struct<kind:string,start:int,end:int>>"),
    "heading_anchors": lambda: _column(lambda t: [h[2] for h in anchors.headings(t)], "array<string>"),
    "code_comments": lambda: _pair(lambda lang, code: code_comments.prose(code_comments.language(lang), code), "array<struct<start:int,end:int,kind:string>>"),
    "tag_faults": lambda: _pair(_tag_faults, "array<string>"),
    "looks_untranslated": lambda: _pair(_untranslated, "boolean"),
}


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Registers all FUNCTIONS under prefix + name and returns their names."""
    for name, make in FUNCTIONS.items():
        spark.udf.register(prefix + name, make())
    return [prefix + name for name in FUNCTIONS]
