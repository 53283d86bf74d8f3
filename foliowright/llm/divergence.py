"""Source divergence audit, plain relational: how far the sources of a language stand apart in their words.

Texts are exploded into terms and counted by language, source and term. A language keeps the terms of enough
of its documents; each of its groups is crossed with that vocabulary, so that absent terms count as zeros, and
gets smoothed shares of a thousand million. Groups are compared term by term in a self-join on language and term.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import load, materialize

# A term, documents that a kept term needs, smoothing, the whole that shares are parts of.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_SAME = r"[A-Za-z\x80-\x{10FFFF}]+"  # the same characters named, which Java matches five times as fast
MIN_DOCS = 30
SMOOTHING = 5
WHOLE = 1_000_000_000
TOP = 50
SALTS = 64  # cells in which a language's vocabulary meets its groups
_MARK = ""  # no term is empty: this one stands in every vocabulary, with share 0, so that all groups meet


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: lambdas evaluate what they refer to for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def entries(text: Column) -> Column:
    """(t, n) of every distinct term of a text: sorted terms, cut where a new one starts."""

    def cut(terms: Column, starts: Column) -> Column:
        return F.transform(starts, lambda p, i: F.struct(F.get(terms, p).alias("t"), (F.coalesce(F.get(starts, i + 1), F.size(terms)) - p).cast("long").alias("n")))

    def starts(terms: Column) -> Column:
        every = F.when(F.size(terms) > 0, F.sequence(F.lit(0), F.size(terms) - 1)).otherwise(F.array().cast("array<int>"))
        return F.filter(every, lambda i: (i == 0) | (F.get(terms, i) != F.get(terms, i - 1)))

    found = F.sort_array(F.regexp_extract_all(F.translate(text, ascii_uppercase, ascii_lowercase), F.lit(_SAME), 0))
    return bound(found, lambda terms: bound(starts(terms), lambda at: cut(terms, at)))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(WHOLE * (count + SMOOTHING) / (total + SMOOTHING * kept)) in exact whole numbers of any size."""
    parts = F.lit(WHOLE).cast("decimal(10,0)") * (count + SMOOTHING).cast("decimal(20,0)")
    return 1 + F.call_function("div", parts, (total + SMOOTHING * kept).cast("decimal(20,0)"))


def divergence(
    docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, text: str = "text", lang: str = "lang", source: str = "source",
) -> DataFrame:
    """lang, source, part, item, value, rank: ``pair`` rows of other sources, ``term`` rows of overrepresented terms.

    Null texts, languages and sources are empty ones. Every row of the table is a document, repeated ones too. A group
    without terms has only smoothed zeros; a language without kept terms gives ``pair`` rows of value 0; a language of
    one source gives no pairs, an empty table no rows. Ties go by the item's UTF-8 bytes. No other column is read.

    Texts are read once; counts are aggregated before the shuffle and written. The vocabulary meets the groups in
    SALTS cells a language, so no task holds a language. A pair is compared once and mirrored.
    """
    filled = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = docs.select(filled(lang).alias("lang"), filled(source).alias("source"), entries(filled(text)).alias("e"))
    rows = rows.select("lang", "source", F.explode_outer("e").alias("e")).select("lang", "source", F.col("e.t").alias("term"), F.col("e.n").alias("n"))
    counts = materialize(rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.count("n").alias("docs")), "term-counts")

    kept = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    kept = materialize(kept.where(F.col("docs") >= min_docs).select("lang", "term", "lang_n"), "kept-terms")
    used = materialize(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n"), "kept-counts")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    groups = counts.select("lang", "source").distinct()
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = materialize(groups.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total")), "term-groups")

    salt = F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")
    vocabulary = kept.join(langs, "lang").select("lang", "term", share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"), "kept")
    marks = groups.select("lang").distinct().select("lang", F.lit(_MARK).alias("term"), F.lit(0).cast("long").alias("q"), F.lit(0).cast("long").alias("kept"))
    cells = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dense = vocabulary.union(marks).withColumn("salt", salt).join(cells, ["lang", "salt"]).drop("salt")
    dense = dense.join(used, ["lang", "source", "term"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    p = F.when(F.col("term") == _MARK, F.lit(0).cast("long")).otherwise(share(F.col("n"), F.col("total"), F.col("kept")))
    dense = materialize(dense.select("lang", "source", "term", "n", "q", p.alias("p")), "dense-shares")

    a = dense.select("lang", "term", "source", "p")
    b = dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("other"))
    pairs = a.join(b, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("other"))).alias("value"))
    pairs = materialize(pairs, "group-pairs")
    pairs = pairs.union(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    terms = dense.where("n > 0 AND p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    own = W.Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(own).alias("rank"))
    return ranked(pairs, "pair").union(ranked(terms, "term").where(F.col("rank") <= top))


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(load(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
), t AS (SELECT id, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(s.total, 0) + 5 * l.v)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v)::HUGEINT AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN totals s ON s.lang = g.lang AND s.source = g.source
), compared AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(c.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN compared c ON c.lang = a.lang AND c.source = a.source AND c.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM dense WHERE n > 0 AND p > q
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""
