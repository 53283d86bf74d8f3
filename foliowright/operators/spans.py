"""Spans of texts as relations: positions of pattern matches, interval elimination, splicing.

Everything is Catalyst: matches and the gaps between them are arrays of a row, places are running sums over the
exploded arrays, overlapping spans are told from others by a running maximum, and only such a cluster is folded in
order. No Python worker takes part. Offsets are in code points.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import protect

_ROW = "__row"
_RULES = list(protect.RULES)
_MATH, _DNT = len(_RULES), len(_RULES) + 1
_NAMES = [*_RULES, "math", "dnt"]
# White space of any script.
_WS = r"[\t-\r\x1c-\x1f \x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_DOLLAR = r"(?<!\\)(?:\\\\)*\$"


def hits(text: Column, pattern: Column, gap=F.length) -> Column:
    """Array of (gap, span): what ``gap`` gives of the text before each match, and the match; last the tail with a null span."""
    return F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), lambda g, m: F.struct(gap(g).alias("gap"), m.alias("span")))


def match_positions(df: DataFrame, keys: list[str], text: Column, pattern: str) -> DataFrame:
    """keys, pos, start, end, span of every match of a Java pattern that never matches nothing. keys may repeat; null texts give no rows."""
    rows = df.select(*keys, F.monotonically_increasing_id().alias(_ROW), hits(text, F.lit(pattern)).alias("__h")).repartition(_ROW)
    rows = rows.select(*keys, _ROW, F.posexplode("__h").alias("pos", "__x")).select(*keys, _ROW, "pos", "__x.gap", "__x.span")
    return _placed(rows, [_ROW]).where("span IS NOT NULL").select(*keys, "pos", "start", "end", "span")


def _placed(rows: DataFrame, by: list[str]) -> DataFrame:
    """Adds start and end to rows of (pos, gap, span)."""
    upto = W.Window.partitionBy(*by).orderBy("pos").rowsBetween(W.Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.coalesce(F.length("span"), F.lit(0))).over(upto).cast("int")
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("span"))


def _may_match(text: Column, rule: str) -> Column:
    if rule in protect._HOLDS:
        return reduce(or_, [F.contains(text, F.lit(c)) for c in protect._HOLDS[rule]])
    place = next((p for p, rules in protect._PLACES if rule in rules), None)
    return F.lit(True) if place is None else text.rlike(place)


def protected_spans(df: DataFrame, keys: list[str], text: str = "text", dnt: tuple[str, ...] = ()) -> DataFrame:
    """keys, start, end, rule, span of every protected span: the union of all rules, formulas and terms, and of
    overlapping ones those that a reader from left to right meets, at each start the widest.

    A text is read where it stands; rows of matches alone are shuffled, by a number of the row, so keys may repeat or be
    null. Null texts give no rows.
    """
    t = F.col("__t")
    base = df.where(F.col(text).isNotNull()).select(*keys, F.monotonically_increasing_id().alias(_ROW), F.col(text).alias("__t"))
    none = F.array().cast("array<struct<gap:int,span:string>>")
    rules = [(i, protect.java_pattern(r), _may_match(t, r)) for i, r in enumerate(_RULES)]
    rules += [(_DNT, protect.term_pattern(x), F.contains(t, F.lit(x))) for x in dnt if x.strip()]
    found = F.array(*[F.struct(F.lit(n).alias("list"), F.lit(i).alias("rule"), F.when(may, hits(t, F.lit(p))).otherwise(none).alias("hits")) for n, (i, p, may) in enumerate(rules)])
    rows = base.select(*keys, _ROW, F.explode(found).alias("__f")).where(F.size("__f.hits") > 1)
    rows = rows.repartition(_ROW).select(*keys, _ROW, "__f.list", "__f.rule", F.posexplode("__f.hits").alias("pos", "__x")).select(*keys, _ROW, "list", "rule", "pos", "__x.*")
    spans = _placed(rows, [_ROW, "list"]).where("span IS NOT NULL AND end > start").select(*keys, _ROW, "rule", "start", "end", "span")
    met = leftmost_longest(spans.unionByName(_formulas(base, keys)), keys)
    return met.select(*keys, "start", "end", F.element_at(F.array(*map(F.lit, _NAMES)), F.col("rule") + 1).alias("rule"), "span")


def leftmost_longest(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Of the spans of each row (``__row``): at each start the widest, of equal ones the lowest rule, then on behind its end.

    A running maximum of ends cuts the spans into clusters that do not touch; each cluster, a handful of spans, is one
    sorted array and one fold.
    """
    order = W.Window.partitionBy(_ROW).orderBy("start", F.desc("end"), "rule")
    before = F.max("end").over(order.rowsBetween(W.Window.unboundedPreceding, -1))
    cut = spans.withColumn("__new", (F.coalesce(before, F.lit(0)) <= F.col("start")).cast("int"))
    cut = cut.withColumn("__cluster", F.sum("__new").over(order.rowsBetween(W.Window.unboundedPreceding, 0)))
    entry = F.struct("start", (-F.col("end")).alias("left"), "rule", "span")
    clusters = cut.groupBy(_ROW, "__cluster").agg(F.sort_array(F.collect_list(entry)).alias("__s"), F.first(F.struct(*keys)).alias("__k"))
    kind = "array<struct<start:int,left:int,rule:int,span:string>>"
    state = F.struct(F.lit(-1).alias("at"), F.array().cast(kind).alias("kept"))
    meet = lambda acc, x: F.when(x["start"] >= acc["at"], F.struct((-x["left"]).alias("at"), F.array_append(acc["kept"], x).alias("kept"))).otherwise(acc)
    kept = F.when(F.size("__s") == 1, F.col("__s")).otherwise(F.aggregate("__s", state, meet)["kept"])
    return clusters.select(F.col("__k.*"), F.explode(kept).alias("__x")).select(*keys, "__x.start", (-F.col("__x.left")).alias("end"), "__x.rule", "__x.span")


def _formulas(base: DataFrame, keys: list[str]) -> DataFrame:
    """Formulas between single dollars: neighbouring marks that may open and close one, in each run of such pairs every other one."""
    rows = base.where(F.contains("__t", F.lit("$"))).select(*keys, _ROW, hits(F.col("__t"), F.lit(_DOLLAR), lambda g: g).alias("__h")).repartition(_ROW)
    rows = rows.select(*keys, _ROW, F.posexplode("__h").alias("pos", "__x")).select(*keys, _ROW, "pos", F.col("__x.gap").alias("words"), "__x.span")
    rows = _placed(rows.withColumn("gap", F.length("words")), [_ROW])
    w = W.Window.partitionBy(_ROW).orderBy("pos")
    close, after, then = F.lead("span").over(w), F.lead("words", 2).over(w), F.lead("span", 2).over(w)
    body = F.concat(F.lead("words").over(w), F.regexp_replace(close, F.lit(r"\$$"), F.lit("")))
    rows = rows.withColumn("body", body).withColumn("after", after).withColumn("then", then)
    behind_dollar = (F.col("span") == "$") & (((F.col("words") == "") & (F.col("pos") > 0)) | F.col("words").endswith("$"))
    before_dollar = (F.col("after") == "") & (F.coalesce("then", F.lit("")) == "$")
    fits = ~behind_dollar & ~before_dollar & (F.col("body") != "") & ~F.contains("body", F.lit("\n\n")) & ~F.col("body").rlike(rf"\A{_WS}|{_WS}\z")
    fits &= ~F.coalesce(F.col("after").rlike(r"^\p{Nd}"), F.lit(False)) & is_formula(F.col("body"))
    rows = rows.where("span IS NOT NULL").withColumn("fits", F.coalesce(fits, F.lit(False)))
    run = F.row_number().over(w) - F.row_number().over(W.Window.partitionBy(_ROW, "fits").orderBy("pos"))
    rows = rows.withColumn("run", run).where("fits")
    rows = rows.withColumn("nth", F.row_number().over(W.Window.partitionBy(_ROW, "run").orderBy("pos"))).where("nth % 2 = 1")
    start = F.col("end") - 1
    return rows.select(*keys, _ROW, F.lit(_MATH).alias("rule"), start.alias("start"), (F.col("end") + F.length("body") + 1).alias("end"), F.concat(F.lit("$"), "body", F.lit("$")).alias("span"))


def is_formula(body: Column) -> Column:
    """Mathematics between dollars: at most two words, and a command or mark of formulas, one symbol alone, or a term with a sign."""
    bare = F.regexp_replace(body, F.lit(rf"\A{_WS}+|{_WS}+\z"), F.lit(""))
    text = F.regexp_replace(bare, F.lit(r"\\(?:text|textrm|mathrm|operatorname|mbox)\{[^{}]*\}"), F.lit("\x01"))
    kinds = F.regexp_replace(text, F.lit(r"\\[A-Za-z]+"), F.lit("\x01"))
    few = F.regexp_count(kinds, F.lit("[A-Za-z]{2,}")) <= protect.MOST_WORDS
    symbol = ~F.contains(body, F.lit(".")) & kinds.rlike(r"\A[A-Za-z][0-9.]*'*\z")
    term = kinds.rlike(rf"\A[A-Za-z0-9.]+{_WS}*[-+*/×·]{_WS}*[A-Za-z0-9.(]")
    return few & (kinds.rlike(r"[\x01^_=<>{}|]") | symbol | term)


# -- splicing


def new_places(edits: DataFrame, keys: list[str]) -> DataFrame:
    """Adds new_start and new_end: where each replacement of [start, end) by text stands in the spliced text."""
    upto = W.Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(W.Window.unboundedPreceding, 0)
    grown = F.sum(F.length("text") - (F.col("end") - F.col("start"))).over(upto)
    return edits.withColumn("new_end", (F.col("end") + grown).cast("int")).withColumn("new_start", (F.col("new_end") - F.length("text")).cast("int"))


def splice(docs: DataFrame, edits: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, text, edits, error of every document: its text with every [start, end) replaced by the edit's text.

    edits: keys, start, end, text. One ordered array and one pass a document: offsets become bytes, gaps are slices of
    the bytes and pieces are joined once, so work grows with the text and the edits, not with their product. An
    insertion has start = end; insertions at one place stand in the order of their texts. Edits that overlap, lie
    outside the text or hold nulls give a null text and an error; a document without edits stays, one with null text too.
    keys must tell documents apart; null keys have no edits.
    """
    good = F.col("start").isNotNull() & F.col("end").isNotNull() & F.col("text").isNotNull() & (F.col("start") >= 0) & (F.col("end") >= F.col("start"))
    entry = F.struct("start", "end", "text")
    listed = edits.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(good, entry))).alias("__e"), F.count("*").cast("int").alias("__n"))
    rows = docs.select(*keys, F.col(text).alias("__t")).join(listed, keys, "left")
    rows = rows.withColumn("__n", F.coalesce("__n", F.lit(0))).withColumn("__e", F.coalesce("__e", F.array().cast("array<struct<start:int,end:int,text:string>>")))
    sound = F.aggregate("__e", F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok")), lambda a, x: F.struct(x["end"].alias("at"), (a["ok"] & (x["start"] >= a["at"])).alias("ok")))
    error = (
        F.when(F.size("__e") < F.col("__n"), "an edit has no place or no text")
        .when(~sound["ok"], "edits overlap")
        .when(sound["at"] > F.length("__t"), "an edit lies outside the text")
    )
    rows = rows.withColumn("error", F.when(F.col("__n") > 0, error))
    fine = F.col("error").isNull() & (F.col("__n") > 0)
    # the stretches between edits as slices: of the bytes, or of four bytes a code point where the text isn't ASCII
    ends = F.concat(F.array(F.lit(0)), F.transform("__e", lambda x: x["end"]))
    starts = F.concat(F.transform("__e", lambda x: x["start"]), F.array(F.lit(None).cast("int")))
    gaps = F.zip_with(ends, starts, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    ascii_ = F.octet_length("__t") == F.length("__t")
    # bound by a lambda, so the bytes are made once and not for each slice
    bound = lambda raw, use: F.get(F.transform(F.array(raw), use), F.lit(0))
    cut = lambda raw, size: F.transform(gaps, lambda g: F.substring(raw, g["a"] * size + 1, F.coalesce((g["b"] - g["a"]) * size, F.lit(2**31 - 1))))
    narrow = bound(F.col("__t").cast("binary"), lambda r: F.transform(cut(r, 1), lambda p: p.cast("string")))
    broad = bound(F.encode("__t", "UTF-32"), lambda r: F.transform(cut(r, 4), lambda p: F.decode(p, "UTF-32")))
    pieces = F.when(ascii_, narrow).otherwise(broad)
    new = F.concat(F.transform("__e", lambda x: x["text"]), F.array(F.lit("")))
    joined = F.array_join(F.flatten(F.zip_with(pieces, new, lambda p, n: F.array(p, n))), "")
    made = F.when(fine, joined).when(F.col("error").isNull(), F.col("__t"))
    return rows.select(*keys, made.alias("text"), F.col("__n").alias("edits"), "error")
