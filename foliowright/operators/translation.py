"""Translation stages: content keys, cache, batches, pluggable engines, validation, review, provenance."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..functions import masking
from ..functions import scalars as S
from ..functions import tags
from .stages import batch_of, stretches

BATCH_SEGMENTS, BATCH_CHARS = 40, 12000
RETRY_SEGMENTS = 10
SOURCE_LANGUAGE = "en"


def jobs(docs: DataFrame, langs: list[str], source_lang: Column | None = None) -> DataFrame:
    """Every document with each target language, but for those of the document's own language.

    The targets are a list of the caller, so this is an explode of literals, no join.
    """
    rows = docs.withColumn("lang", F.explode(F.array(*map(F.lit, langs))))
    return rows if source_lang is None else rows.where(~F.coalesce(S.same_language(source_lang, F.col("lang")), F.lit(False)))


def source_language(option: Column, configured: Column, detected: Column) -> Column:
    """The first of these that is not blank, else SOURCE_LANGUAGE."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in (option, configured, detected)], F.lit(SOURCE_LANGUAGE))


def translatable(docs: DataFrame, segments: DataFrame, doc: str = "doc") -> DataFrame:
    """Documents that hold a segment to translate."""
    return docs.join(segments.where("NOT passive").select(F.col("doc").alias(doc)), doc, "left_semi")


def terms_for(terms: DataFrame, langs: list[str]) -> DataFrame:
    """lang, term, text: glossary entries of each language, those of its base code where it has none of its own.

    A wanted language is asked for under its own code and its base, so the join is on one key.
    """
    asked = {(x, code.lower()): code == x for x in langs for code in (re.split("[-_]", x)[0], x)}
    wanted = terms.sparkSession.createDataFrame([(*k, own) for k, own in asked.items()], "wanted string, code string, own boolean")
    hits = terms.withColumn("code", F.lower("lang")).join(F.broadcast(wanted), "code")
    best = hits.groupBy("wanted", "term").agg(F.min(F.struct((~F.col("own")).alias("is_base"), "text")).alias("x"))
    return best.select(F.col("wanted").alias("lang"), "term", F.col("x.text").alias("text"))


def neighbours(segments: DataFrame, doc: str = "doc", seq: str = "seq", text: str = "masked") -> DataFrame:
    """Adds prev and next: the texts beside a segment, '' at the ends."""
    w = W.Window.partitionBy(doc).orderBy(seq)
    return segments.withColumn("prev", F.lag(text, 1, "").over(w)).withColumn("next", F.lead(text, 1, "").over(w))


def content_key(*parts: Column) -> Column:
    """sha256 of the compact JSON array of the parts."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 256)


def cache_keyed(segments: DataFrame, version: str, engine: str, review: str = "", formality: str = "formal", glossary: str = "") -> DataFrame:
    """Adds key, on which a translation may be reused: what the engine sees of the segment and how it is set.

    segments: doc, lang, seq, kind, masked, note.
    """
    near = W.Window.partitionBy("doc", "lang").orderBy("seq")
    prev, after = F.lag("masked", 1, "").over(near), F.lead("masked", 1, "").over(near)
    settings = [F.lit(x) for x in (version, engine, review)]
    return segments.withColumn("key", content_key(*settings, F.col("lang"), F.lit(formality), F.col("kind"), F.col("note"), F.col("masked"), prev, after, F.lit(glossary)))


def acceptable(source: Column, translated: Column) -> Column:
    """True for a translation that holds the source's tags, each as often and its pairs nested, and is not too short or long."""
    return S.same_tags(source, translated) & tags.well_nested(translated) & ~S.ratio_fails(S.masked_plain(source), S.masked_plain(translated))


def probe_cache(segments: DataFrame, cache: DataFrame, source: str = "masked") -> DataFrame:
    """Left join on the key; a hit counts only while it is still acceptable."""
    joined = segments.join(cache.select("key", F.col("text").alias("__hit")), "key", "left")
    ok = F.col("__hit").isNotNull() & acceptable(F.col(source), F.col("__hit"))
    return joined.withColumn("text", F.when(ok, F.col("__hit"))).withColumn("via", F.when(ok, "cache")).drop("__hit")


class Packer:
    """Greedy packing of sizes in order: a batch closes when one more would exceed either limit. Three numbers of state."""

    def __init__(self, max_items: int, max_size: int):
        self.max_items, self.max_size = max_items, max_size
        self.start()

    def start(self) -> None:
        self.batch = self.items = self.total = 0

    def put(self, size: int) -> int:
        """The batch of the next size."""
        if self.items and (self.items >= self.max_items or self.total + size > self.max_size):
            self.batch, self.items, self.total = self.batch + 1, 0, 0
        self.items, self.total = self.items + 1, self.total + size
        return self.batch


def packed(sizes, max_items: int, max_size: int) -> list[int]:
    p = Packer(max_items, max_size)
    return [p.put(n) for n in sizes]


def batches(rows: DataFrame, by: list[str], order: str, text: str, max_items: int = BATCH_SEGMENTS, max_chars: int = BATCH_CHARS) -> DataFrame:
    """Adds batch: greedy packing in order, a batch closes when one more would exceed either limit.

    Rows are dealt by key and sorted, and stream through three numbers of state, so no key is held in memory. Rows of
    equal place in the order go by size, the smaller first, and each is packed by itself. Texts take part in the
    shuffle, so that nothing is joined back.
    """
    size = S.utf16_length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    key = F.xxhash64(*by)
    dealt = rows.withColumn("__n", size).withColumn("__k", key).repartition(*by).sortWithinPartitions("__k", *by, order, "__n")
    at = [rows.columns.index(c) for c in by]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, last = Packer(max_items, max_chars), None
        for b in parts:
            keys = zip(*(b.column(i).to_pylist() for i in at), strict=True)
            out = []
            for k, n in zip(keys, b.column(b.num_columns - 2).to_pylist(), strict=True):
                if k != last:
                    packer.start()
                    last = k
                out.append(packer.put(n))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(out, pa.int32())], names=[*b.schema.names[:-2], "batch"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return dealt.mapInArrow(run, f"{kinds}, batch int")


class TooLong(Exception):
    """An engine raises it for a request whose answer would not fit; the request is halved."""


class Translator(Protocol):
    """An engine: masked texts and a target language to masked texts (None: it failed).

    It may also have ``retry(texts, lang, previous, problems)``, which is then asked where answers were bad.
    """

    name: str

    def translate(self, texts: list[str], lang: str) -> list[str | None]: ...


class Pseudo:
    name = "pseudo"

    def translate(self, texts, lang):
        return [masking.pseudo(t) for t in texts]


class Identity:
    name = "identity"

    def translate(self, texts, lang):
        return list(texts)


class Memory:
    """Answers from a fixed dictionary; what it lacks fails."""

    name = "tm"

    def __init__(self, known: dict[str, str]):
        self.known = known

    def translate(self, texts, lang):
        return [self.known.get(t) for t in texts]


def ask(call, items: list) -> list[str | None]:
    """The answers of ``call`` to a request; one that is too long is halved, one that fails has no answers."""
    try:
        got = call(items)
        return [*got[: len(items)], *[None] * (len(items) - len(got))]
    except TooLong:
        if len(items) < 2:
            return [None] * len(items)
        half = len(items) // 2
        return ask(call, items[:half]) + ask(call, items[half:])


OUTCOMES = "doc string, lang string, seg_id string, kind string, text string, via string, retries int, errors array<string>, source string"


def answerer(
    engine: Translator, fallback: Translator | None = None, attempts: int = 2, ratios: dict[str, tuple[float, float]] | None = None,
    max_items: int = BATCH_SEGMENTS, max_chars: int = BATCH_CHARS,
) -> Callable[[str, list[str], Sequence[Iterable[int]], Sequence[Iterable[int]]], Iterator[tuple]]:
    """A function of a language and the masked texts, single tags and pairs of a document's segments, as ``translate`` asks and checks."""
    limits = {k.lower(): v for k, v in (ratios or {}).items()}

    def check(src, singles, pairs, got, lang):
        if got is None:
            return ["no answer for this segment"]
        errors = masking.check_tags(set(singles), set(pairs), got)
        units = lambda s: len(masking.plain_text(s).strip().encode("utf-16-le", "surrogatepass")) / 2
        low, high = limits.get(lang.lower(), S.RATIO)
        n = units(src)
        if n >= S.RATIO_FROM and not low <= units(got) / n <= high:
            errors.append("length ratio")
        return errors

    def answer(lang, src, singles, pairs):
        """(text, via, retries, errors) of the segments of one document and language."""
        text, via = [None] * len(src), ["source"] * len(src)
        retries, errors, given = [0] * len(src), [[] for _ in src], [None] * len(src)
        todo = list(range(len(src)))
        for e, rounds in ((engine, 1 + attempts), (fallback, 1)):
            for r in range(rounds if e and todo else 0):
                again = r and hasattr(e, "retry")
                call = (lambda at, e=e: e.retry([src[i] for i in at], lang, [given[i] for i in at], [errors[i] for i in at])) if again else (lambda at, e=e: e.translate([src[i] for i in at], lang))
                dealt = packed([len(src[i]) for i in todo], min(RETRY_SEGMENTS, max_items) if r else max_items, max_chars)
                requests: list[list[int]] = [[] for _ in range(dealt[-1] + 1 if dealt else 0)]
                for i, k in zip(todo, dealt, strict=True):
                    requests[k].append(i)
                left = []
                for at in requests:
                    for i, got in zip(at, ask(call, at), strict=True):
                        got = masking.sanitize(got, src[i])
                        errors[i], given[i] = check(src[i], singles[i], pairs[i], got, lang), got
                        retries[i] = max(retries[i], r)
                        if errors[i]:
                            left.append(i)
                        else:
                            text[i], via[i] = got, e.name
                todo = left
        return zip(text, via, retries, errors, strict=True)

    return answer


def translate(
    segments: DataFrame, langs: list[str], engine: Translator, fallback: Translator | None = None, attempts: int = 2, ratios: dict[str, tuple[float, float]] | None = None,
    max_items: int = BATCH_SEGMENTS, max_chars: int = BATCH_CHARS, done: DataFrame | None = None,
) -> DataFrame:
    """Outcome of every active segment and language: engine, else retries, else fallback, else source.

    One narrow stage: a failing text is asked again inside its task, so a lost task repeats only its own
    rows. Requests hold at most ``max_items`` texts and ``max_chars`` characters of a document, retries
    RETRY_SEGMENTS. Answers become one line where the source is one and are checked (tags, length by
    language, in lower case) before they count. ``done`` (doc, lang) names what is not to be translated.
    """
    rows = jobs(segments.where("NOT passive").select("doc", "seg_id", "kind", "masked", F.map_keys("singles").alias("s"), F.map_keys("pairs").alias("g")), langs)
    if done is not None:
        rows = rows.join(done.select("doc", "lang"), ["doc", "lang"], "left_anti")
    answer = answerer(engine, fallback, attempts, ratios, max_items, max_chars)
    made_fields = StructType.fromDDL(OUTCOMES)
    names, types = [f.name for f in made_fields], [to_arrow_type(f.dataType) for f in made_fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in stretches(b, ["masked"]):
                groups: dict[tuple, list[tuple]] = {}
                for doc, seg_id, kind, masked, singles, pairs, lang in zip(*(c.to_pylist() for c in s.columns), strict=True):
                    if doc is not None and lang is not None:
                        groups.setdefault((doc, lang), []).append((seg_id, kind, masked, singles, pairs))
                out = []
                for (doc, lang), part in groups.items():
                    ids, kinds, src, singles, pairs = zip(*part, strict=True)
                    for seg_id, kind, masked, (text, via, retries, errors) in zip(ids, kinds, src, answer(lang, list(src), singles, pairs), strict=True):
                        out.append((doc, lang, seg_id, kind, text, via, retries, errors, masked))
                if out:
                    yield batch_of(out, names, types)

    made = rows.select("doc", "seg_id", "kind", "masked", "s", "g", "lang").mapInArrow(run, OUTCOMES)
    same = S.untranslated(F.trim(S.masked_plain(F.col("source"))), F.trim(S.masked_plain(F.col("text"))))
    return made.withColumn("untranslated", F.coalesce(same, F.lit(False)))


def apply_review(outcomes: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (doc, lang, seg_id, text, category, severity, explanation) that change something, are not for
    cached text and, where outcomes carry their source, are acceptable and don't bring a comment back to it;
    the text before is kept in ``review``. Unknown ids drop out of the join; of several edits the last by text counts."""
    e = edits.groupBy("doc", "lang", "seg_id").agg(F.max(F.struct("text", "category", "severity", "explanation")).alias("__e"))
    j = outcomes.join(e, ["doc", "lang", "seg_id"], "left")
    new = F.col("__e.text")
    use = new.isNotNull() & (F.col("via") != "cache") & F.col("text").isNotNull() & (new != F.col("text"))
    if "source" in outcomes.columns:
        back = (F.col("kind") == "comment") & (F.trim(S.masked_plain(new)) == F.trim(S.masked_plain(F.col("source"))))
        use = use & F.coalesce(acceptable(F.col("source"), new), F.lit(False)) & ~F.coalesce(back, F.lit(False))
    review = F.when(use, F.struct("__e.category", "__e.severity", "__e.explanation", F.col("text").alias("before")))
    return j.withColumn("review", review).withColumn("text", F.when(use, new).otherwise(F.col("text"))).drop("__e")


VIAS = ("cache", "gpt", "nmt", "pseudo", "tm", "identity", "source")


def run_counters(outcomes: DataFrame, by: list[str], vias: tuple[str, ...] = VIAS) -> DataFrame:
    """Segments in all, by the engine that gave them, and tried again."""
    return outcomes.groupBy(*by).agg(F.count("*").alias("segments"), *[F.count_if(F.col("via") == v).alias(f"via_{v}") for v in vias], F.count_if(F.col("retries") > 0).alias("retried"))


def report(outcomes: DataFrame, by: list[str], vias: tuple[str, ...] = VIAS) -> DataFrame:
    """Roll-up by document and language with a status, review edits, and the segments that stayed as they were.

    Counts are pre-aggregated map-side; the lists hold ids of one document.
    """
    counts = run_counters(outcomes, by, vias)
    kept = F.sort_array(F.collect_list(F.when(F.col("via") == "source", F.struct(F.col("seg_id").alias("id"), "errors"))))
    lists = outcomes.groupBy(*by).agg(
        F.count_if("untranslated").alias("untranslated"),
        F.sort_array(F.collect_list(F.when(F.col("untranslated"), F.col("seg_id")))).alias("untranslated_ids"),
        kept.alias("kept_source"),
        (F.count_if(F.col("review").isNotNull()) if "review" in outcomes.columns else F.lit(0).cast("long")).alias("review_edits"),
    )
    return counts.join(lists, by).withColumn("status", status(F.col("via_source"), F.col("segments")))


def status(kept: Column, segments: Column) -> Column:
    return F.when(kept == 0, "translated").when(kept < segments, "partial").otherwise("failed")


def worst(statuses: DataFrame, by: list[str], column: str = "status") -> DataFrame:
    """The worst status of each group: failed before partial before translated."""
    rank = F.when(F.col(column) == "failed", 2).when(F.col(column) == "partial", 1).otherwise(0)
    out = statuses.groupBy(*by).agg(F.max(rank).alias("rank"))
    return out.withColumn(column, F.when(F.col("rank") == 2, "failed").when(F.col("rank") == 1, "partial").otherwise("translated"))


def usage(calls: DataFrame, by: list[str], prompt: str = "prompt", completion: str = "completion") -> DataFrame:
    """Calls and tokens of each deployment or purpose."""
    return calls.groupBy(*by).agg(F.count("*").alias("calls"), F.sum(prompt).alias("prompt"), F.sum(completion).alias("completion"))
