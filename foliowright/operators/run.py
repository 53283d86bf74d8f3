"""A run over documents as its options and language settings ask for it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import markdown
from ..functions import scalars as S
from ..options import Options
from . import documents as D
from . import translation as T
from .islands import fixed
from .stages import flat_rows

FALLBACK = "nmt"  # the engine that is one itself


@dataclass(frozen=True)
class Result:
    """segments of the extraction, outcomes by segment and language, and assembled documents."""

    segments: DataFrame
    outcomes: DataFrame
    documents: DataFrame


def fallback_applies(options: Options, served: bool) -> bool:
    """Whether failed segments go to the fallback: there is one, and it is switched on or chosen as the engine itself."""
    return served and (options.nmt_fallback or options.engine == FALLBACK)


def settings(catalogue: DataFrame | None) -> tuple[dict[str, tuple[float, float]], frozenset[str]]:
    """(length ratios by language, languages that are not wrapped) of a language catalogue, a row a language."""
    if catalogue is None:
        return {}, frozenset()
    rows = catalogue.select("code", "lengthRatio", "wrap").collect()  # one row a language
    return {r["code"]: tuple(r["lengthRatio"]) for r in rows if r["lengthRatio"]}, frozenset(r["code"] for r in rows if r["wrap"] == "none")


def formality(docs: DataFrame, options: Options, register: str | None = None, content: str = "content") -> DataFrame:
    """Adds formality: what the options ask for, else the front matter, else the analysis's register, else formal."""
    asked = D.map_column(docs, content, "__asked", markdown.front_matter_formality, "string")
    found = S.formality(F.lit(options.formality or None), F.col("__asked"), F.col(register) if register else F.lit(None).cast("string"))
    return asked.withColumn("formality", found).drop("__asked")


def run(
    docs: DataFrame, langs: list[str], engine: T.Translator, options: Options = Options(), fallback: T.Translator | None = None, catalogue: DataFrame | None = None,
    dnt: tuple[str, ...] = (), detected: str | None = None, segments: DataFrame | None = None,
) -> Result:
    """Extraction, translation and assembly of documents (doc, content) into each language.

    Options switch what is extracted (front matter, comments, docstrings), limit requests and attempts, let the fallback
    take part, and keep anchors; the catalogue sets length ratios and wrapping by language. A language that is the
    document's own (the option's, else the column ``detected``, else SOURCE_LANGUAGE) is left out. Segments and outcomes
    are written once; ``segments`` of an earlier run over the same documents, whose options extract the same, are taken
    as they are. Null and blank documents have no segments and stay out; an empty table gives no rows.
    """
    ratios, unwrapped = settings(catalogue)
    picked = docs.select("doc", "content", *([F.col(detected).alias("__found")] if detected else []))
    own = T.source_language(F.lit(options.source_lang), F.lit(None).cast("string"), F.col("__found") if detected else F.lit(None).cast("string"))
    pairs = picked.select("doc", own.alias("__own")).withColumn("lang", F.explode(F.array(*map(F.lit, langs))))
    done = pairs.where(F.coalesce(S.same_language(F.col("__own"), F.col("lang")), F.lit(False))).select("doc", "lang").distinct()
    segments = fixed(D.extract_segments(picked, dnt=dnt, options=options)) if segments is None else segments
    helper = fallback if fallback_applies(options, fallback is not None) else None
    outcomes = fixed(T.translate(segments, langs, engine, helper, options.max_attempts, ratios, options.batch_segments, options.batch_chars, done))
    memory = outcomes.where("text IS NOT NULL").select("doc", "lang", "seg_id", "text")
    return Result(segments, outcomes, D.assemble(picked, segments, memory, anchors=options.preserve_anchors, unwrapped=unwrapped))


def round_trip(
    docs: DataFrame, langs: list[str], engine: T.Translator, options: Options = Options(), fallback: T.Translator | None = None,
    ratios: dict[str, tuple[float, float]] | None = None, unwrapped: frozenset[str] = frozenset(), dnt: tuple[str, ...] = (),
) -> DataFrame:
    """What assemble makes of the translations of documents (doc, content) into each language, where nothing in between is kept.

    One narrow stage: a document goes from its segments to its last language inside one task, so neither segments nor
    answers are written, shuffled or joined back by id. Each row is a document of its own, also one whose id is null or
    another one's. A document has no row where no segment got a translation; null and blank ones have no segments.
    """
    find, anchors, fields = D.finder(options), options.preserve_anchors, StructType.fromDDL(D.SEGMENTS).names[1:]
    helper = fallback if fallback_applies(options, fallback is not None) else None
    answer = T.answerer(engine, helper, options.max_attempts, ratios, options.batch_segments, options.batch_chars)

    def rows(d, source):
        parts = [dict(zip(fields, s, strict=True)) for s in D.segments_of(source, find, dnt)]
        parts = [p for p in parts if not p["passive"]]
        asked = [p["masked"] for p in parts], [[k for k, _ in p["singles"]] for p in parts], [[k for k, _ in p["pairs"]] for p in parts]
        for lang in langs if parts else ():
            given = [p | {"text": text} for p, (text, *_) in zip(parts, answer(lang, *asked), strict=True) if text is not None]
            if given:
                yield D.assembled(d, lang, source, given, anchors, unwrapped)

    picked = docs.select(F.col("doc").cast("string").alias("__doc"), F.col("content").alias("__content")).where(F.trim("__content") != "")
    return flat_rows(picked, [], ["__doc", "__content"], D.ASSEMBLED, rows)
