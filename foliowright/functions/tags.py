"""Tags of masked texts as Catalyst expressions: a text's tags are an array, nesting is a fold with a stack.

Verdicts equal those of the scanner in ``masking``; no Python worker takes part.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import xml_unescape

TAG = r"</?[gx]\d+\s*/?>"
_TOKEN = "array<struct<kind:string,n:bigint,text:string>>"


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where lambdas refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _tag(t: Column) -> Column:
    n = F.regexp_extract(t, r"(\d+)", 1).try_cast("bigint")
    kind = F.when(t.rlike("^</?x"), "x").when(t.startswith("</"), "close").when(t.rlike("/>$"), "x").otherwise("open")
    return F.struct(kind.alias("kind"), F.when(t.rlike("^<g.*/>$"), -n).otherwise(n).alias("n"), F.lit(None).cast("string").alias("text"))


def tag_tokens(masked: Column) -> Column:
    """Tags in order as (kind, n, null text): x, open or close; a self-closed pair tag is x with -n."""
    return F.transform(F.regexp_extract_all(masked, F.lit(TAG), F.lit(0)), _tag)


def tokens(masked: Column) -> Column:
    """Tags and the texts between them (kind text) in order."""
    texts = F.transform(F.split(masked, TAG, -1), lambda s: F.when(s != "", F.struct(F.lit("text").alias("kind"), F.lit(None).cast("bigint").alias("n"), s.alias("text"))))
    both = F.zip_with(texts, tag_tokens(masked), lambda a, b: F.array(a, b))
    return F.filter(F.flatten(both), lambda t: t.isNotNull())


def written(kind: Column, n: Column) -> Column:
    s = n.cast("string")
    return F.when(kind == "open", F.concat(F.lit("<g"), s, F.lit(">"))).when(kind == "close", F.concat(F.lit("</g"), s, F.lit(">"))).when(n >= 0, F.concat(F.lit("<x"), s, F.lit("/>"))).otherwise(F.concat(F.lit("<g"), F.abs(n).cast("string"), F.lit("/>")))


def misplaced_end(found: Column) -> Column:
    """The first pair whose end stands where another pair is the innermost open one; null where all nest. A stack in a fold."""
    start = F.struct(F.array().cast("array<bigint>").alias("open"), F.lit(None).cast("bigint").alias("bad"))

    def step(a: Column, t: Column) -> Column:
        top = F.try_element_at(a["open"], F.lit(-1))
        popped = F.struct(F.slice(a["open"], F.lit(1), F.greatest(F.size(a["open"]) - 1, F.lit(0))).alias("open"), a["bad"].alias("bad"))
        failed = F.struct(a["open"].alias("open"), t["n"].alias("bad"))
        pushed = F.struct(F.array_append(a["open"], t["n"]).alias("open"), a["bad"].alias("bad"))
        return (
            F.when(a["bad"].isNotNull(), a).when(t["kind"] == "open", pushed)
            .when((t["kind"] == "close") & F.coalesce(top == t["n"], F.lit(False)), popped).when(t["kind"] == "close", failed).otherwise(a)
        )

    return F.aggregate(found, start, step)["bad"]


def well_nested(translated: Column) -> Column:
    return misplaced_end(tag_tokens(translated)).isNull()


def tag_faults(singles: Column, pairs: Column, translated: Column) -> Column:
    """Why the tags of a translation don't fit: those too often there, those missing, then a pair that overlaps. Empty where
    all is well. singles and pairs: arrays of the source's numbers; their order is free."""
    plain = lambda kind, n: F.struct(F.lit(kind).alias("kind"), n.cast("bigint").alias("n"))
    side = lambda of, kind: F.transform(of, lambda n: plain(kind, n))
    wanted = F.array_distinct(F.concat(side(singles, "x"), side(pairs, "open"), side(pairs, "close")))

    def faults(found: Column, wanted: Column) -> Column:
        bare = F.transform(found, lambda t: F.struct(t["kind"].alias("kind"), t["n"].alias("n")))
        often = lambda t, bare: F.size(F.filter(bare, lambda x: (x["kind"] == t["kind"]) & (x["n"] == t["n"]))) - F.array_contains(wanted, t).cast("int")
        surplus = bound(bare, lambda b: F.filter(F.transform(F.array_sort(F.array_distinct(b)), lambda t: F.struct(t["kind"].alias("kind"), t["n"].alias("n"), often(t, b).alias("more"))), lambda t: t["more"] > 0))
        lacking = F.array_sort(F.array_except(wanted, bare))
        bad = misplaced_end(found)
        return F.concat(
            F.transform(surplus, lambda t: F.concat(written(t["kind"], t["n"]), F.lit(" is "), t["more"].cast("string"), F.lit(" too many"))),
            F.transform(lacking, lambda t: F.concat(written(t["kind"], t["n"]), F.lit(" is not there"))),
            F.when(bad.isNull(), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("</g"), bad.cast("string"), F.lit("> ends what is not the innermost pair")))),
        )

    return bound(tag_tokens(translated), lambda found: bound(wanted, lambda w: faults(found, w)))


def group_faults(groups: Column, quotes: Column, translated: Column) -> Column:
    """Why tags that belong together don't fit. groups: array of (tags such as x1 or g2 in order, closed_up: nothing may stand
    between them); quotes: map of a pair's number to the quote that text inside it must not hold."""
    name = lambda t: F.concat(F.when(t["kind"] == "x", "x").when(t["kind"] == "open", "g").otherwise("/g"), t["n"].cast("string"))

    def leaks(found: Column) -> Column:
        start = F.struct(F.array().cast("array<bigint>").alias("open"), F.array().cast("array<string>").alias("said"))

        def step(a: Column, t: Column) -> Column:
            held = F.filter(a["open"], lambda n: F.coalesce(F.contains(xml_unescape(t["text"]), F.try_element_at(quotes, n.cast("int"))), F.lit(False)))
            told = F.transform(held, lambda n: F.concat(F.lit("<g"), n.cast("string"), F.lit("> holds its own quote "), F.try_element_at(quotes, n.cast("int"))))
            return (
                F.when(t["kind"] == "text", F.struct(a["open"].alias("open"), F.concat(a["said"], told).alias("said")))
                .when(t["kind"] == "open", F.struct(F.array_append(a["open"], t["n"]).alias("open"), a["said"].alias("said")))
                .when((t["kind"] == "close") & (F.size(a["open"]) > 0), F.struct(F.slice(a["open"], F.lit(1), F.size(a["open"]) - 1).alias("open"), a["said"].alias("said")))
                .otherwise(a)
            )

        return F.aggregate(found, start, step)["said"]

    def orders(names: Column) -> Column:
        at = lambda tag: F.array_position(names, tag) - 1  # noqa: E731  -1: not there
        span = lambda t: F.struct(at(t).alias("a"), F.when(t.startswith("g"), at(F.concat(F.lit("/"), t))).otherwise(at(t)).alias("b"))

        def judge(g: Column) -> Column:
            def say(spans: Column) -> Column:
                nexts = F.zip_with(F.slice(spans, F.lit(1), F.greatest(F.size(spans) - 1, F.lit(0))), F.slice(spans, F.lit(2), F.greatest(F.size(spans) - 1, F.lit(0))), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
                listed = F.array_join(g["tags"], ", ")
                disorder = F.exists(spans, lambda s: s["a"] < 0) | F.exists(nexts, lambda p: p["x"]["a"] >= p["y"]["a"])
                apart = g["closed_up"] & F.exists(nexts, lambda p: p["x"]["b"] + 1 != p["y"]["a"])
                return F.when(disorder, F.concat(listed, F.lit(" have to stay in this order"))).when(apart, F.concat(F.lit("nothing may stand between "), listed))

            return bound(F.transform(g["tags"], span), say)

        return F.filter(F.transform(groups, judge), lambda x: x.isNotNull())

    names = lambda found: F.transform(found, lambda t: F.when(t["kind"] == "text", "").otherwise(name(t)))
    return bound(tokens(translated), lambda found: F.array_distinct(F.concat(leaks(found), bound(names(found), orders))))
