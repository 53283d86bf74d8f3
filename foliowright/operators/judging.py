"""Judges of two translations, requests to models and what is derived from runs without running them again."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import files
from . import translation as T

# Most items and characters of one request to a judge; most characters of a document beside a request.
JUDGE_ITEMS, JUDGE_CHARS = 8, 16000
CONTEXT_CHARS = 60000
SIDE_ERRORS = "array<struct<category:string,severity:string>>"


class Judge(Protocol):
    """Compares candidates A and B of items (source, a, b) in one language; a result is (better, errors_a, errors_b)
    with better one of A, B, tie, and errors (category, severity). None: it failed."""

    name: str

    def compare(self, items: list[tuple[str, str, str]], lang: str) -> list[tuple[str, list, list] | None]: ...


class SourceLeft:
    """A judge by rule: a candidate that is the source's own text is left untranslated, which is a major error."""

    name = "source-left"

    def compare(self, items, lang):
        out = []
        for source, a, b in items:
            left = [[("untranslated", "major")] if x.strip() == source.strip() else [] for x in (a, b)]
            out.append(("tie" if bool(left[0]) == bool(left[1]) else "B" if left[0] else "A", *left))
        return out


def judge(items: DataFrame, judge: Judge, keys: list[str], swapped: bool = False) -> DataFrame:
    """keys, better (on, off, tie), errors_on, errors_off of every item (source, on, off, lang) that the judge answers.

    One narrow stage: a request holds at most JUDGE_ITEMS items and JUDGE_CHARS characters of one language.
    With ``swapped`` the judge sees the sides the other way round and its answers are put back.
    """
    picked = items.select(*keys, F.col("lang").alias("__lang"), "source", "on", "off")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[: len(keys)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in frames:
            out = []
            for lang, part in b.groupby("__lang", sort=False, dropna=False):
                rows = list(zip(part["source"], part["off" if swapped else "on"], part["on" if swapped else "off"], strict=True))
                dealt = T.packed([sum(len(x or "") for x in r) for r in rows], JUDGE_ITEMS, JUDGE_CHARS)
                answers: list = []
                for k in range(dealt[-1] + 1 if dealt else 0):
                    batch = [r for r, d in zip(rows, dealt, strict=True) if d == k]
                    answers += T.ask(lambda at, batch=batch, lang=lang: judge.compare([batch[i] for i in at], lang), list(range(len(batch))))
                got = [(i, a) for i, a in enumerate(answers) if a is not None and a[0] in ("A", "B", "tie")]
                kept = part[keys].iloc[[i for i, _ in got]]
                on_at, off_at = (2, 1) if swapped else (1, 2)
                struct = lambda errors: [{"category": c, "severity": s} for c, s in errors]
                better = ["tie" if a[0] == "tie" else "on" if (a[0] == "A") != swapped else "off" for _, a in got]
                out.append(kept.assign(better=better, errors_on=[struct(a[on_at]) for _, a in got], errors_off=[struct(a[off_at]) for _, a in got]))
            yield pd.concat(out) if out else pd.DataFrame(columns=[*keys, "better", "errors_on", "errors_off"])

    return picked.mapInPandas(run, f"{kinds}, better string, errors_on {SIDE_ERRORS}, errors_off {SIDE_ERRORS}")


# ---- requests to a model


def requests(segments: DataFrame, by: list[str], order: str = "seq", context: Column | None = None, max_items: int = T.BATCH_SEGMENTS, max_chars: int = T.BATCH_CHARS) -> DataFrame:
    """by, batch, payload: JSON of the segments of each request in order, and of the document they are from,
    cut to CONTEXT_CHARS."""
    b = T.batches(segments, by, order, "masked", max_items, max_chars)
    item = F.struct(F.col(order).alias("__o"), F.col("seg_id").alias("id"), "kind", "note", F.col("masked").alias("text"))
    listed = b.groupBy(*by, "batch").agg(F.array_sort(F.collect_list(item)).alias("x"), *([F.first(F.substring(context, 1, CONTEXT_CHARS)).alias("document")] if context is not None else []))
    parts = [F.transform("x", lambda i: i.dropFields("__o")).alias("segments"), *([F.col("document")] if context is not None else [])]
    return listed.select(*by, "batch", F.to_json(F.struct(*parts)).alias("payload"))


def responses(raw: DataFrame, keys: list[str], answer: str = "answer") -> DataFrame:
    """keys, seg_id, text of a model's answers {"translations": [{"id", "text"}]}; of an id that stands twice the
    last counts, an answer that is no such object gives no row."""
    rows = raw.select(*keys, F.posexplode(F.from_json(answer, "translations array<struct<id:string,text:string>>")["translations"]).alias("at", "t"))
    return rows.where("t.id IS NOT NULL AND t.text IS NOT NULL").groupBy(*keys, F.col("t.id").alias("seg_id")).agg(F.max_by("t.text", "at").alias("text"))


def answered(segments: DataFrame, got: DataFrame, keys: list[str]) -> DataFrame:
    """Every segment that was asked for with its answer, and an error where there is none; answers to other ids drop out."""
    j = segments.join(got, [*keys, "seg_id"], "left")
    return j.withColumn("errors", F.when(F.col("text").isNull(), F.array(F.lit("no answer for this segment"))).otherwise(F.array().cast("array<string>")))


def analysis(raw: DataFrame, keys: list[str], answer: str = "answer") -> DataFrame:
    """keys and what a model found out about a document, as columns of ``files.analysis_columns``; an unreadable answer
    gives nulls, and the run goes on."""
    return raw.select(*keys, F.from_json(answer, files.ANALYSIS).alias("a")).select(*keys, *files.analysis_columns(F.col("a")))


# ---- derived runs


def without_review(outcomes: DataFrame) -> DataFrame:
    """The run as it was before its review."""
    return outcomes.withColumn("text", F.coalesce("review.before", "text")).withColumn("review", F.lit(None).cast(outcomes.schema["review"].dataType))


def without_engine(outcomes: DataFrame, via: str = "nmt") -> DataFrame:
    """The run without an engine: its segments stay as the source has them."""
    gone = F.col("via") == via
    return outcomes.withColumn("text", F.when(~gone, F.col("text"))).withColumn("via", F.when(gone, "source").otherwise(F.col("via")))


def robustness(runs: DataFrame, by: list[str]) -> DataFrame:
    """Sums of what went wrong and mean seconds of each variant."""
    return runs.groupBy(*by).agg(F.count("*").alias("runs"), *[F.sum(c).alias(c) for c in ("reverted", "kept_source", "retried", "nmt")], F.avg("seconds").alias("seconds"))


def pairs(variants: list[str], compared: list[tuple[str, str]], runs: DataFrame, keys: list[str]) -> DataFrame:
    """comparison, keys, on, off of the outputs of every two variants that are compared."""
    unknown = {v for p in compared for v in p} - set(variants)
    if unknown:
        raise ValueError(f"no such variant: {', '.join(sorted(unknown))}")
    text = lambda name: runs.where(F.col("variant") == name).select(*keys, F.col("text"))
    made = [text(a).withColumnRenamed("text", "on").join(text(b).withColumnRenamed("text", "off"), keys).select(F.lit(f"{a} / {b}").alias("comparison"), *keys, "on", "off") for a, b in compared]
    out = made[0]
    for m in made[1:]:
        out = out.union(m)
    return out


def examples(judgements: DataFrame, keys: list[str], most: int = 600) -> DataFrame:
    """At most ``most`` decided items for a report, the first by their keys."""
    return judgements.where("verdict IN ('on', 'off')").orderBy(*keys).limit(most)


def numbered_lines(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, line (from 1), content of every line."""
    return df.select(*keys, F.posexplode(F.split(text, r"\r?\n")).alias("__at", "content")).select(*keys, (F.col("__at") + 1).cast("long").alias("line"), "content")


def search_lines(df: DataFrame, keys: list[str], needle: str, text: str = "text", most: int = 60) -> DataFrame:
    """The first ``most`` lines that hold the needle, whatever its case, by keys and line."""
    return numbered_lines(df, keys, text).where(F.contains(F.lower("content"), F.lit(needle.lower()))).orderBy(*keys, "line").limit(most)
