"""Scoring of translated documents: deterministic checks, judgements, scorecards, feature statistics, regression.

Sides of a comparison are structs (on, off) of METRICS. Everything is grouped by keys that the input carries
and added up before it is shuffled; only the outline of documents needs Python.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import code_comments, markdown
from ..functions import scalars as S
from ..functions import statistics as X
from . import documents as D
from . import evaluation as E
from .stages import flat_rows

# The counts whose sum is the problems of a side, and counts that are reported beside them.
PROBLEMS = ("keep_missing", "translate_left", "structure_broken", "code_changed", "links_broken", "english_left", "errors")
EVENTS = ("reverted", "kept_source", "nmt")
COUNTS = (*PROBLEMS, *EVENTS)
# The shape of a judge's answer and its categories; the older names of the two lists are read as well.
_ERRORS = "array<struct<category:string,severity:string,note:string>>"
ANSWER = f"results array<struct<id:string,better:string,errorsA:{_ERRORS},errorsB:{_ERRORS},errors_a:{_ERRORS},errors_b:{_ERRORS}>>"
CATEGORIES = (
    "mistranslation", "omission", "addition", "terminology", "grammar", "spelling", "punctuation", "fluency", "style", "register", "locale", "untranslated", "overtranslation", "markup",
)
TOLERANCE, TOKEN_SHARE = 0.005, 0.10


# ---- deterministic checks of one document


def expectation_counts(outputs: DataFrame, expectations: DataFrame, text: str = "text") -> DataFrame:
    """Adds keep_missing and translate_left: strings (keep, translate) of a document's expectations that its
    output lacks or still has. A document without expectations misses nothing; a null output misses all."""
    e = expectations.select(F.col("doc").alias("__doc"), F.col("keep").alias("__keep"), F.col("translate").alias("__translate"))
    j = outputs.join(e, F.col("doc") == F.col("__doc"), "left")
    out = F.coalesce(F.col(text), F.lit(""))
    some = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    j = j.withColumn("keep_missing", F.filter(some("__keep"), lambda k: ~F.contains(out, k)))
    return j.withColumn("translate_left", F.filter(some("__translate"), lambda k: F.contains(out, k))).drop("__doc", "__keep", "__translate")


#: Code of a Markdown text: fenced blocks up to their end or the text's, and spans on a line.
_CODE = r"(?ms)^ {0,3}(`{3,}|~{3,})[^\n]*\n.*?(?:^ {0,3}\1[`~]*[ \t]*$|\z)|(?<!`)(`+)(?!`)[^\n]*?(?<!`)\2(?!`)"


def link_target(raw: Column) -> Column:
    """The target that a link in the page names: per-cent escapes are read, a plus stays one, and where they are none the text stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)


def broken_links(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, targets, broken: links inside the page and those whose target is nowhere defined.

    Targets are slugs of headings, id and name attributes and {#id} marks; a target that several links name
    counts for each of them. Markdown links in code are no links. keys must tell the rows apart. A null text has none.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    found = lambda p, t=t: F.regexp_extract_all(t, F.lit(p), F.lit(1))
    links = F.concat(F.transform(found(r"\]\(#([^)\s]+)", F.regexp_replace(t, F.lit(_CODE), F.lit(""))), link_target), found(r"\bhref\s*=\s*[\"']#([^\"']+)[\"']"))
    marks = F.concat(found(r"\b(?:id|name)\s*=\s*[\"']([^\"']+)[\"']"), found(r"\{#([\w-]+)\}"))
    rows = df.select(*keys, F.col(text).alias("__text"), links.alias("__links"), marks.alias("__marks"))
    # only pages with links go on to the scanner of headings
    slugs = D.heading_slugs(rows.where(F.size("__links") > 0), keys, "__text").groupBy(*keys).agg(F.collect_set("slug").alias("__slugs"))
    j = rows.join(slugs, keys, "left")
    known = F.concat("__marks", F.coalesce("__slugs", F.array().cast("array<string>")))
    # the difference of sets is hashed; only what it leaves is looked for among the links
    j = j.withColumn("__gone", F.array_except("__links", known))
    missing = F.when(F.size("__gone") == 0, 0).otherwise(F.size(F.filter("__links", lambda x: F.array_contains("__gone", x))))
    return j.select(*keys, F.size("__links").cast("long").alias("targets"), missing.cast("long").alias("broken"))


def run_metrics(
    runs: DataFrame, keys: list[str], expectations: DataFrame | None = None, english: DataFrame | None = None, source: str = "source", text: str = "text",
) -> DataFrame:
    """keys and COUNTS of every run, as numbers, with english_by_kind (a map): the deterministic checks of one translation.

    runs: keys (which tell runs apart, ``doc`` among them), source, text, and of the run itself reverted, kept_source, nmt and
    error. expectations: doc, keep, translate. english: keys, category, english_left, as ``english_left`` gives them;
    without it the two texts are extracted here. A run without text breaks the structure, leaves nothing and
    changes nothing else; links count as broken beyond those that the source breaks itself.
    """
    r = runs.select(*keys, F.col(source).alias("source"), F.col(text).alias("text"), "reverted", "kept_source", "nmt", F.col("error").isNotNull().cast("long").alias("errors"))
    have = r.where("text IS NOT NULL AND source IS NOT NULL")
    e = expectations if expectations is not None else r.sparkSession.createDataFrame([], "doc string, keep array<string>, translate array<string>")
    missed = expectation_counts(r.select(*keys, "text"), e).select(*keys, F.size("keep_missing").alias("keep_missing"), F.size("translate_left").alias("translate_left"))
    shape = D.structure_differs(have.select(*keys, "source", "text"), keys, "source", "text").select(*keys, F.col("differs").cast("long").alias("structure_broken"))
    code = code_changes(code_blocks(have, keys, "source"), code_blocks(have, keys, "text"), keys)
    sides = have.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("source").alias("t")), F.struct(F.lit(1).alias("side"), F.col("text").alias("t")))).alias("x")).select(*keys, "x.*")
    links = broken_links(sides, [*keys, "side"], "t").groupBy(*keys).agg(F.sum(F.when(F.col("side") == 1, F.col("broken")).otherwise(-F.col("broken"))).alias("more"))
    links = links.select(*keys, F.greatest("more", F.lit(0)).alias("links_broken"))
    if english is None:
        english = english_left(_plain_segments(have, keys, "source"), _plain_segments(have, keys, "text"), keys)
    left = english.groupBy(*keys).agg(F.sum("english_left").alias("english_left"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "english_left")))).alias("english_by_kind"))
    out = r.drop("source", "text")
    for part in (missed, shape, code.withColumnRenamed("code_changed", "__code"), links, left):
        out = out.join(part, keys, "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    none = F.create_map().cast("map<string,bigint>")
    broken = F.coalesce("structure_broken", F.lit(1))
    return out.select(
        *keys, number(F.col("keep_missing")).alias("keep_missing"), number(F.col("translate_left")).alias("translate_left"), broken.cast("long").alias("structure_broken"),
        number(F.col("__code")).alias("code_changed"), number(F.col("links_broken")).alias("links_broken"), number(F.col("english_left")).alias("english_left"), number(F.col("errors")).alias("errors"),
        *[number(F.col(c)).alias(c) for c in EVENTS], F.coalesce("english_by_kind", none).alias("english_by_kind"),
    )


def _plain_segments(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, category, plain of the segments of a text, one narrow stage; keys travel as JSON."""
    named = df.select(F.to_json(F.struct(*keys)).alias("doc"), F.col(text).alias("content"))
    seg = D.extract_segments(named).where("NOT passive")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)
    return seg.select(F.from_json("doc", kinds).alias("k"), segment_category(F.col("kind"), F.col("note")).alias("category"), S.plain_words(F.col("masked")).alias("plain")).select("k.*", "category", "plain")


def code_blocks(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, seq, language, value, fingerprint of every fenced block; the fingerprint leaves comments out."""
    schema = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("language", "value", "fingerprint")]))

    @F.pandas_udf(schema)
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [(name, v, code_comments.fingerprint(code_comments.language(name), v)) for name, v in markdown.code_blocks(t)] if isinstance(t, str) else [])

    fenced = df.where(F.col(text).rlike(r"(?m)^ {0,3}(?:```|~~~)"))
    return fenced.select(*keys, F.posexplode(find(F.col(text))).alias("seq", "b")).select(*keys, "seq", "b.*")


def code_changes(source: DataFrame, output: DataFrame, keys: list[str]) -> DataFrame:
    """keys, code_changed of two listings of code blocks: blocks that differ at their place, or all where the
    numbers differ. A block differs if its language or fingerprint does."""
    a = source.select(*keys, "seq", F.struct("language", F.coalesce("fingerprint", "value").alias("f")).alias("__a"))
    b = output.select(*keys, "seq", F.struct("language", F.coalesce("fingerprint", "value").alias("f")).alias("__b"))
    j = a.join(b, [*keys, "seq"], "full")
    out = j.groupBy(*keys).agg(F.count("__a").alias("na"), F.count("__b").alias("nb"), F.count_if(F.col("__a") != F.col("__b")).alias("d"))
    return out.select(*keys, F.when(F.col("na") != F.col("nb"), F.greatest("na", "nb")).otherwise(F.col("d")).alias("code_changed"))


def english_left(source: DataFrame, output: DataFrame, keys: list[str]) -> DataFrame:
    """keys, category, english_left: segments of three or more words that source and output share, as often
    as the rarer side has them. Both sides: keys, category, plain."""
    long = lambda df: df.where(F.size(F.regexp_extract_all("plain", F.lit(r"\p{L}{2,}"), F.lit(0))) >= 3).groupBy(*keys, "category", "plain").count()
    a, b = long(source).withColumnRenamed("count", "__a"), long(output).withColumnRenamed("count", "__b")
    return a.join(b, [*keys, "category", "plain"]).groupBy(*keys, "category").agg(F.sum(F.least("__a", "__b")).alias("english_left"))


def segment_category(kind: Column, note: Column) -> Column:
    return F.when(F.contains(note, F.lit("docstring")), "docstring").when(kind == "comment", "comment").when(kind == "frontmatter", "frontMatter").when(kind == "attr", "attribute").otherwise("prose")


def overlapping(segments: DataFrame, doc: str = "doc") -> DataFrame:
    """Segments that begin before one in front of them ends: none, where extraction is sound."""
    from pyspark.sql import window as W

    before = W.Window.partitionBy(doc).orderBy("start", "end").rowsBetween(W.Window.unboundedPreceding, -1)
    return segments.withColumn("__end", F.max("end").over(before)).where("start < __end").drop("__end")


def fingerprints(segments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, fingerprint of an extraction: what a translator would see of it."""
    part = F.concat_ws("\u0001", F.when(F.col("passive"), "passive").otherwise(F.col("kind")), "masked", "note")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", part.alias("p")))), lambda x: x["p"])
    return segments.groupBy(*keys).agg(F.sha2(F.array_join(ordered, "\u0000"), 256).alias("fingerprint"))


# ---- variants


def variants(jobs: DataFrame, switches: list[str]) -> DataFrame:
    """jobs and one row more for each switch, which stands flipped in it; options is a map of booleans."""
    flipped = F.explode(F.array(F.lit(None).cast("string"), *map(F.lit, switches)))
    rows = jobs.withColumn("switch", flipped)
    flip = lambda k, v: F.when(k == F.col("switch"), ~v).otherwise(v)
    return rows.withColumn("options", F.when(F.col("switch").isNull(), F.col("options")).otherwise(F.transform_values("options", flip)))


def reusable(wanted: DataFrame, known: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose fingerprint was run before, with that result; rows to run)."""
    both = [*keys, "fingerprint"]
    return wanted.join(known, both), wanted.join(known.select(*both), both, "left_anti")


# ---- judgements


def differing_blocks(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, item, source, on, off of the blocks in which two translations differ; where the numbers of blocks
    do, the whole document is one item."""

    def items(source, on, off):
        cut = [markdown.blocks(t) if t is not None else [] for t in (source, on, off)]
        even = len(cut[0]) == len(cut[1]) == len(cut[2])
        for i, (x, a, b) in enumerate(zip(*cut, strict=True) if even else [(source, on, off)]):
            if a != b:
                yield f"b{i}", x, a, b

    rows = df.where(~F.col("on").eqNullSafe(F.col("off"))).select(*keys, *[F.col(c).alias(f"__{c}") for c in ("source", "on", "off")])
    return flat_rows(rows, keys, ["__source", "__on", "__off"], "item string, source string, on string, off string", items)


def answers(raw: DataFrame, keys: list[str], answer: str = "answer", swapped: str = "swapped", asked: str | None = None) -> DataFrame:
    """keys, item, better (on, off, tie), errors_on, errors_off of judges' answers: the first JSON object of each,
    with sides put back where they were swapped.

    Answers that are no such object, and results with unknown values, give no row. ``asked`` names a column with the ids of
    the items that were asked for: then an answer counts only as a whole, if each of them has a result and each of these
    is well formed, and results for other ids drop out. Of results for one id the last counts.
    """
    text = F.coalesce(F.nullif(F.regexp_extract(F.col(answer), r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit("")), F.regexp_extract(F.col(answer), r"(?s)(\{.*\})", 1))
    known = lambda errors: F.coalesce(F.forall(errors, lambda e: e["category"].isin(*CATEGORIES) & e["severity"].isin(*S.SEVERITY)), F.lit(False))
    bare = lambda errors: F.transform(errors, lambda e: F.struct(e["category"].alias("category"), e["severity"].alias("severity")))
    one = lambda r: F.struct(r["id"].alias("id"), r["better"].alias("better"), F.coalesce(r["errorsA"], r["errors_a"]).alias("a"), F.coalesce(r["errorsB"], r["errors_b"]).alias("b"))
    fine = lambda r: F.coalesce(r["id"].isNotNull() & r["better"].isin("A", "B", "tie") & known(r["a"]) & known(r["b"]), F.lit(False))
    rows = raw.select(*keys, F.col(swapped).alias("__swap"), *([F.col(asked).alias("__asked")] if asked else []), F.transform(F.from_json(text, ANSWER)["results"], one).alias("__r"))
    rows = rows.withColumn("__fine", F.filter("__r", fine))
    if asked:
        ids = F.transform("__fine", lambda r: r["id"])
        whole = (F.size(F.array_except("__asked", ids)) == 0) & ~F.exists("__r", lambda r: F.coalesce(F.array_contains("__asked", r["id"]), F.lit(False)) & ~fine(r))
        rows = rows.where(F.coalesce(whole, F.lit(False))).withColumn("__fine", F.filter("__fine", lambda r: F.array_contains("__asked", r["id"])))
    last = F.filter("__fine", lambda r, i: ~F.exists(F.slice("__fine", i + 2, F.size("__fine")), lambda x: x["id"] == r["id"]))
    rows = rows.select(*keys, "__swap", F.explode(last).alias("r"))
    on = (F.col("r.better") == "A") != F.col("__swap")
    better = F.when(F.col("r.better") == "tie", "tie").when(on, "on").otherwise("off")
    first, second = bare(F.col("r.a")), bare(F.col("r.b"))
    return rows.select(*keys, F.col("r.id").alias("item"), better.alias("better"), F.when(F.col("__swap"), second).otherwise(first).alias("errors_on"), F.when(F.col("__swap"), first).otherwise(second).alias("errors_off"))


def fold_judgements(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """One row an item and judge from its two orders: verdict, mean penalties and all errors of both sides.

    An item that one order lacks is an error with null penalties. Both: keys, better, errors_on, errors_off.
    """
    named = lambda df, n: df.select(*keys, *[F.col(c).alias(f"{c}_{n}") for c in ("better", "errors_on", "errors_off")])
    j = named(first, 1).join(named(second, 2), keys, "full")
    points = lambda c: S.penalty(F.transform(c, lambda e: e["severity"]))
    mean = lambda side: (points(F.col(f"{side}_1")) + points(F.col(f"{side}_2"))) / 2
    every = lambda side: F.concat(*[F.coalesce(F.col(f"{side}_{n}"), F.array().cast(j.schema[f"{side}_1"].dataType)) for n in (1, 2)])
    verdict = S.verdict(F.col("better_1"), F.col("better_2"))
    judged = verdict != "error"
    return j.select(
        *keys, F.col("better_1").alias("order1"), F.col("better_2").alias("order2"), verdict.alias("verdict"),
        F.when(judged, mean("errors_on")).alias("mqm_on"), F.when(judged, mean("errors_off")).alias("mqm_off"),
        every("errors_on").alias("errors_on"), every("errors_off").alias("errors_off"),
    )


# ---- sums over records


def problems(side: str) -> Column:
    return reduce(lambda a, b: a + b, [F.col(f"{side}.{c}") for c in PROBLEMS])


def comparison_summary(records: DataFrame, by: list[str]) -> DataFrame:
    """Sums of every count of both sides, problems, documents, affected ones, mean seconds, and correctness."""
    sums = [F.sum(f"{side}.{c}").alias(f"{c}_{side}") for side in ("on", "off") for c in COUNTS]
    means = [F.avg(f"{side}.seconds").alias(f"seconds_{side}") for side in ("on", "off")]
    out = records.groupBy(*by).agg(F.count("*").alias("documents"), F.count_if("changed").alias("affected"), *sums, *means, *[F.sum(problems(s)).alias(f"problems_{s}") for s in ("on", "off")])
    better, worse = F.col("problems_on") < F.col("problems_off"), F.col("problems_on") > F.col("problems_off")
    return out.withColumn("correctness", F.when(better, "better").when(worse, "worse").otherwise("same"))


def english_by_kind(records: DataFrame, by: list[str], side: str) -> DataFrame:
    """by, kind, segments: the maps english_by_kind of a side added up key by key."""
    return records.select(*by, F.explode(f"{side}.english_by_kind").alias("kind", "n")).groupBy(*by, "kind").agg(F.sum("n").alias("segments"))


def feature_stats(judgements: DataFrame, records: DataFrame, by: str = "comparison", item: tuple[str, ...] = ("doc", "lang", "item")) -> DataFrame:
    """One row a comparison: panel of the judges with sign test, Holm adjustment, win rate and Wilson interval,
    penalties per 100 words, problems, quality, correctness and recommendation. Failed judgements don't count."""
    valid = judgements.where("verdict <> 'error'")
    items = valid.groupBy(by, *item).agg(
        F.count_if(F.col("verdict") == "on").alias("on"), F.count_if(F.col("verdict") == "off").alias("off"),
        F.max("words").alias("words"), F.avg(F.coalesce("mqm_on", F.lit(0.0))).alias("m_on"), F.avg(F.coalesce("mqm_off", F.lit(0.0))).alias("m_off"),
    )
    votes = items.groupBy(by).agg(
        F.count("*").alias("items"), F.count_if(F.col("on") > F.col("off")).alias("wins"), F.count_if(F.col("off") > F.col("on")).alias("losses"),
        F.sum("words").alias("words"), F.sum("m_on").alias("m_on"), F.sum("m_off").alias("m_off"),
    )
    per = F.when(F.col("words") > 0, F.col("words") / 100).otherwise(1.0)
    votes = votes.withColumn("ties", F.col("items") - F.col("wins") - F.col("losses")).withColumn("mqm_on", F.col("m_on") / per).withColumn("mqm_off", F.col("m_off") / per).drop("m_on", "m_off")
    out = comparison_summary(records, [by]).select(by, "documents", "affected", "problems_on", "problems_off", "correctness").join(votes, by, "left")
    out = out.fillna(0, ["items", "wins", "losses", "ties", "words"])
    n = F.col("wins") + F.col("losses")
    low, high = X.wilson(F.col("wins"), n)
    out = out.withColumn("p", X.sign_test(F.col("wins"), n)).withColumn("win_rate", F.col("wins") / F.nullif(n, F.lit(0))).withColumn("ci_low", low).withColumn("ci_high", high)
    # comparisons without a decided item take no part in the adjustment
    judged = X.holm(out.where("wins + losses > 0"))
    rest = out.where("wins + losses = 0").withColumn("p_adj", F.lit(None).cast("double"))
    return E.decision(judged.unionByName(rest))


def grouped_votes(judgements: DataFrame, by: list[str]) -> DataFrame:
    """wins, losses, ties, inconsistent and p of single judgements by comparison and judge, say."""
    v = F.col("verdict")
    out = judgements.where(v != "error").groupBy(*by).agg(*[F.count_if(v == name).alias(c) for c, name in (("wins", "on"), ("losses", "off"), ("ties", "tie"), ("inconsistent", "inconsistent"))])
    return out.withColumn("p", X.sign_test(F.col("wins"), F.col("wins") + F.col("losses")))


def costs(records: DataFrame, by: list[str]) -> DataFrame:
    """Mean tokens of translation and review of both sides."""
    return records.groupBy(*by).agg(*[F.avg(f"{s}.tokens.{k}").alias(f"{k}_{s}") for s in ("on", "off") for k in ("translate", "review")])


def defect_counts(defects: DataFrame) -> Column:
    return F.size("keep_missing") + F.size("translate_left") + F.col("structure_broken") + F.col("code_changed") + F.col("links_broken") + F.col("error").isNotNull().cast("int")


def scorecard(defects: DataFrame, expectations: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Pass rates, clean share, sums, mean tokens and quantiles of seconds of all documents or of groups.

    A rate of nothing expected is null. Expectations (doc, keep, translate) are joined by document.
    """
    e = expectations.select(F.col("doc").alias("__doc"), F.size("keep").alias("__k"), F.size("translate").alias("__t"))
    j = defects.join(e, F.col("doc") == F.col("__doc"), "left").withColumn("__n", defect_counts(defects))
    rate = lambda c, n: 1 - F.sum(F.size(c)) / F.nullif(F.sum(F.coalesce(F.col(n), F.lit(0))), F.lit(0))
    tokens = F.col("tokens.translate") + F.col("tokens.review")
    return j.groupBy(*(by or [])).agg(
        F.count("*").alias("documents"), rate("keep_missing", "__k").alias("keep_pass"), rate("translate_left", "__t").alias("translate_pass"),
        (F.count_if(F.col("__n") == 0) / F.greatest(F.lit(1), F.count("*"))).alias("clean_documents"),
        *[F.sum(c).alias(c) for c in ("structure_broken", "code_changed", "links_broken", "reverted", "kept_source", "nmt")],
        F.count_if(F.col("error").isNotNull()).alias("errors"), F.sum("__n").alias("defects"),
        F.sum(F.aggregate(F.map_values("english_by_kind"), F.lit(0).cast("long"), lambda a, x: a + x)).alias("english_segments"),
        F.avg(tokens).alias("tokens_mean"), F.percentile("seconds", 0.5).alias("seconds_median"), F.percentile("seconds", 0.9).alias("seconds_p90"),
    )


def defect_keys(defects: DataFrame) -> DataFrame:
    """doc, lang, type, detail, defect (lang|doc|type|detail): a row for each string, and one for each broken count."""
    one = lambda kind, shown, on: F.when(on, F.array(F.struct(F.lit(kind).alias("type"), shown.cast("string").alias("detail"))))
    each = lambda kind, c: F.transform(c, lambda s: F.struct(F.lit(kind).alias("type"), s.alias("detail")))
    none = F.array().cast("array<struct<type:string,detail:string>>")
    parts = [
        each("overtranslated", "keep_missing"), each("untranslated", "translate_left"), one("structure", F.lit(""), F.col("structure_broken") > 0),
        one("code", F.col("code_changed"), F.col("code_changed") > 0), one("links", F.col("links_broken"), F.col("links_broken") > 0),
        one("error", F.substring("error", 1, 120), F.col("error").isNotNull()),
    ]
    rows = defects.select("doc", "lang", F.explode(F.concat(*[F.coalesce(p, none) for p in parts])).alias("d")).select("doc", "lang", "d.*")
    return rows.withColumn("defect", F.concat_ws("|", "lang", "doc", "type", "detail"))


def still_expected(gone: DataFrame, expectations: DataFrame) -> DataFrame:
    """defect keys (doc, type, detail, defect) whose expectation still exists: their string for over- and
    untranslated ones, their document for all others."""
    strings = lambda kind, c: F.transform(c, lambda x: F.struct(F.lit(kind).alias("type"), x.alias("detail")))
    e = expectations.select("doc", F.explode(F.concat(strings("overtranslated", "keep"), strings("untranslated", "translate"))).alias("x"))
    by_string = gone.where("type IN ('overtranslated', 'untranslated')").join(e.select("doc", "x.type", "x.detail").distinct(), ["doc", "type", "detail"], "left_semi")
    by_doc = gone.where("type NOT IN ('overtranslated', 'untranslated')").join(expectations.select("doc").distinct(), "doc", "left_semi")
    return by_string.select("defect").union(by_doc.select("defect"))


def snapshot_changes(before: DataFrame, now: DataFrame, by: list[str], rates: list[str], counts: list[str], tokens: str = "tokens_mean", quality: str = "quality") -> DataFrame:
    """by, metric, before, now, status of two snapshots: rates move by more than TOLERANCE, counts by any,
    tokens by more than TOKEN_SHARE; quality by its rank."""
    rank = lambda c: F.when(c == "better", 2.0).when(c == "worse", 0.0).otherwise(1.0)
    pick = lambda df: [F.struct(F.lit(m).alias("metric"), F.lit(k).alias("k"), F.col(m).cast("double").alias("v")) for k, ms in (("rate", rates), ("count", counts), ("tokens", [tokens] if tokens in df.columns else [])) for m in ms] + ([F.struct(F.lit(quality).alias("metric"), F.lit("rank").alias("k"), rank(F.col(quality)).alias("v"))] if quality in df.columns else [])
    long = lambda df, name: df.select(*by, F.explode(F.array(*pick(df))).alias("x")).select(*by, "x.metric", "x.k", F.col("x.v").alias(name))
    j = long(before, "before").join(long(now, "now"), [*by, "metric", "k"])
    a, b, k = F.col("before"), F.col("now"), F.col("k")
    gain = (
        F.when(k == "rate", F.when(F.abs(b - a) > TOLERANCE, b - a).otherwise(0.0))
        .when(k == "count", a - b)
        .when(k == "tokens", F.when((b > a * (1 + TOKEN_SHARE)) | (b < a * (1 - TOKEN_SHARE)), a - b).otherwise(0.0))
        .otherwise(b - a)
    )
    return j.withColumn("status", F.when(gain > 0, "improvement").when(gain < 0, "regression").otherwise("unchanged")).drop("k")
