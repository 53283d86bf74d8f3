"""Queries of whole runs: what each option changes, formality, answers and analyses of models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import masking
from ..operators import charts as C
from ..operators import documents as D
from ..operators import evaluation as E
from ..operators import judging as J
from ..operators import run as R
from ..operators import scoring as Q
from ..operators import translation as T
from ..options import Options
from .queries import _t, register


class Slow:
    """An engine that gets headings right on the second retry only, and paragraphs never."""

    name = "pseudo"

    def translate(self, texts, lang):
        return ["short" if "Head" in t else None if "paragraph" in t else masking.pseudo(t) for t in texts]

    def retry(self, texts, lang, previous, problems):
        return [(masking.pseudo(t) if p == "tiny" else "tiny") if "Head" in t else None for t, p in zip(texts, previous, strict=True)]


def _documents(spark, d) -> DataFrame:
    s = F.col("doc_id").cast("string")
    text = F.concat(
        F.lit("---\ntitle: A fine title "), s, F.when(F.col("doc_id") % 2 == 0, "\nformality: informal").otherwise(""), F.lit("\n---\n\n# Head line of a good many words that say little "), s,
        F.lit("\n\nA paragraph of words\non two lines.\n\n```python\ndef f():\n    \"\"\"Words in a string.\"\"\"\n    return 1  # words in a comment\n```\n"),
    )
    return D.spread(_t(spark, d, "documents").select("doc_id")).select(s.alias("doc"), text.alias("content"), F.when(F.col("doc_id") % 5 == 0, "fr-CA").otherwise("en").alias("found"), "doc_id")


#: Variants of the default options by name.
_VARIANTS = {
    "default": {}, "front_matter": {"front_matter": False}, "code_comments": {"code_comments": False}, "docstrings": {"docstrings": False}, "nmt_fallback": {"nmt_fallback": False},
    "engine": {"nmt_fallback": False, "engine": "nmt"}, "max_attempts": {"max_attempts": 1}, "source_lang": {"source_lang": "fr"},
}


@register("""
WITH n AS (SELECT count(*) AS all_docs, count(*) FILTER (doc_id % 5 <> 0) AS en FROM documents),
v(variant, segs, engine, fallback, source, retried) AS (VALUES
  ('default', 5, 4, 1, 0, 2), ('front_matter', 4, 3, 1, 0, 2), ('code_comments', 4, 3, 1, 0, 2), ('docstrings', 4, 3, 1, 0, 2), ('nmt_fallback', 5, 4, 0, 1, 2), ('engine', 5, 4, 1, 0, 2),
  ('max_attempts', 5, 3, 2, 0, 2), ('source_lang', 5, 4, 1, 0, 2))
SELECT variant, (segs * all_docs)::BIGINT AS segments, (engine * docs)::BIGINT AS by_engine, (fallback * docs)::BIGINT AS by_fallback, (source * docs)::BIGINT AS kept_source, (retried * docs)::BIGINT AS retried
FROM (SELECT v.*, n.all_docs, CASE WHEN variant = 'source_lang' THEN all_docs ELSE all_docs + en END AS docs FROM v, n)
""")
def option_effects(spark, d):
    """What each option changes in a run into two languages, one of which is some documents' own."""
    docs, out, extracted = _documents(spark, d), [], {}
    for name, given in _VARIANTS.items():
        o = Options(**given)
        how = (o.front_matter, o.code_comments, o.docstrings)  # what an extraction depends on
        r = R.run(docs, ["fr", "sv"], Slow(), o, T.Identity(), detected="found", segments=extracted.get(how))
        extracted[how] = r.segments
        o = r.outcomes.agg(F.count_if(F.col("via") == "pseudo").alias("by_engine"), F.count_if(F.col("via") == "identity").alias("by_fallback"), F.count_if(F.col("via") == "source").alias("kept_source"), F.count_if(F.col("retries") > 0).alias("retried"))
        out.append(r.segments.agg(F.lit(name).alias("variant"), F.count("*").alias("segments")).crossJoin(o))  # one row each
    return reduce(DataFrame.union, out)


@register("""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'informal' WHEN doc_id % 3 = 0 THEN 'informal' ELSE 'formal' END AS formality FROM documents
""")
def formality_of_documents(spark, d):
    """Front matter before the register that an analysis found, else formal."""
    docs = _documents(spark, d).withColumn("register", F.when(F.col("doc_id") % 3 == 0, "informal").otherwise("neutral"))
    return R.formality(docs, Options(), "register").select("doc_id", "formality")


@register("""
SELECT doc_id, lang AS language, CASE WHEN doc_id % 3 < 2 THEN (['formal', 'informal'])[doc_id % 3 + 1] END AS register, source AS audience, (doc_id % 4)::INTEGER AS names, 'term ' || doc_id AS term FROM documents WHERE doc_id % 7 <> 0
UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL FROM documents WHERE doc_id % 7 = 0
""")
def document_analyses(spark, d):
    """Answers of a model about documents, some of them unreadable or with a register that is none."""
    i = F.col("doc_id")
    made = F.to_json(F.struct(
        F.col("lang").alias("sourceLanguage"), F.element_at(F.array(*map(F.lit, ("formal", "informal", "odd"))), (i % 3 + 1).cast("int")).alias("register"), F.lit("because").alias("registerEvidence"),
        F.col("source").alias("audience"), F.array_repeat(F.lit("Name"), (i % 4).cast("int")).alias("doNotTranslate"),
        F.array(F.struct(F.concat(F.lit("term "), i.cast("string")).alias("term"), F.lit("a note").alias("note"))).alias("terminology"),
    ))
    raw = _t(spark, d, "documents").select("doc_id", F.when(i % 7 == 0, "no answer").otherwise(made).alias("answer"))
    a = J.analysis(raw, ["doc_id"])
    return a.select("doc_id", "language", "register", "audience", F.size("dnt").alias("names"), F.get("terminology", F.lit(0))["term"].alias("term")).withColumn("names", F.when(F.col("names") >= 0, F.col("names")))


@register("""
SELECT doc_id, item, CASE WHEN (doc_id % 2 = 0) THEN 'on' ELSE 'off' END AS better, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS n_on, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS n_off
FROM documents, (VALUES ('b0'), ('b1')) AS i(item) WHERE doc_id % 5 NOT IN (1, 2, 3)
""")
def whole_answers(spark, d):
    """Judges' answers count only where every item that was asked for has a well-formed result."""
    i = F.col("doc_id")
    errors = lambda n, category: F.array_repeat(F.struct(category.alias("category"), F.lit("minor").alias("severity"), F.lit("why").alias("note")), n)
    result = lambda item, category: F.struct(F.lit(item).alias("id"), F.lit("A").alias("better"), errors(2, F.lit("style")).alias("errorsA"), errors(1, category).alias("errorsB"))
    second = result("b1", F.when(i % 5 == 2, "no such category").otherwise("fluency"))
    listed = F.when(i % 5 == 1, F.array(result("b0", F.lit("style")))).otherwise(F.array(result("b0", F.lit("style")), second, result("b9", F.lit("style"))))
    made = F.when(i % 5 == 3, "{no answer").otherwise(F.to_json(F.struct(listed.alias("results"))))
    raw = _t(spark, d, "documents").select("doc_id", made.alias("answer"), (i % 2 == 1).alias("swapped"), F.array(F.lit("b0"), F.lit("b1")).alias("asked"))
    a = Q.answers(raw, ["doc_id"], asked="asked")
    return a.select("doc_id", "item", "better", F.size("errors_on").alias("n_on"), F.size("errors_off").alias("n_off"))


# ---- quantiles and charts


@register("""
SELECT event_type, round(quantile_cont(value::DOUBLE, 0.5), 6) AS median, round(quantile_cont(value::DOUBLE, 0.975), 6) AS high, round(quantile_cont(value::DOUBLE, 0.0), 6) AS low FROM events GROUP BY 1
""")
def quantiles_by_selection(spark, d):
    """Exact quantiles by cutting intervals until few values are left."""
    q = E.exact_quantiles(_t(spark, d, "events"), ["event_type"], "value", {"median": 0.5, "high": 0.975, "low": 0.0}, few=200)
    return q.select("event_type", *[F.round(c, 6).alias(c) for c in ("median", "high", "low")])


@register("""
WITH c AS (SELECT lang, source, count(*) FILTER (n_chars > 500)::DOUBLE AS n FROM documents GROUP BY ALL),
l AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS LAST) - 1 AS at FROM (SELECT DISTINCT lang FROM documents))
SELECT l.at::INTEGER AS row_at, l.lang AS row, coalesce(max(n) FILTER (source = 'src3'), 0) AS src3, coalesce(max(n) FILTER (source = 'none'), 0)::DOUBLE AS "none", coalesce(max(n) FILTER (source = 'src1'), 0) AS src1
FROM l LEFT JOIN c ON c.lang IS NOT DISTINCT FROM l.lang GROUP BY 1, 2
""")
def heat_map(spark, d):
    """Long documents by language and some sources, one of which has none."""
    return C.heat_map(_t(spark, d, "documents"), "lang", "source", F.count_if(F.col("n_chars") > 500), columns=["src3", "none", "src1"])


@register("""
WITH c AS (SELECT o_orderstatus AS s, o_orderpriority AS p, count(*)::DOUBLE AS n FROM orders GROUP BY ALL),
a AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS at FROM (SELECT DISTINCT o_orderstatus AS s FROM orders)), b AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS at FROM (SELECT DISTINCT o_orderpriority AS p FROM orders)),
g AS (SELECT a.at AS row_at, b.at AS column_at, a.s AS row, b.p AS "column", coalesce(n, 0) AS value FROM a CROSS JOIN b LEFT JOIN c ON c.s = a.s AND c.p = b.p)
SELECT row_at::INTEGER AS row_at, column_at::INTEGER AS column_at, row, "column", value, sum(value) OVER w - value AS low, sum(value) OVER w AS high, round(value / sum(value) OVER (PARTITION BY row_at), 9) AS share
FROM g WINDOW w AS (PARTITION BY row_at ORDER BY column_at)
""")
def stacked_bars(spark, d):
    """Orders by status, stacked by priority."""
    return C.stacked(_t(spark, d, "orders"), "o_orderstatus", "o_orderpriority", F.count("*")).withColumn("share", F.round("share", 9))


@register("""
WITH s AS (SELECT source AS label, round(avg(doc_id % 7 - 3), 9) AS value, min(doc_id % 7 - 3) + 2.5 AS low, max(doc_id % 5)::DOUBLE AS high FROM documents GROUP BY 1)
SELECT row_number() OVER (ORDER BY value DESC, label)::INTEGER - 1 AS at, label, value, low::DOUBLE AS low, high, CASE WHEN low > 0 THEN 1 WHEN high < 0 THEN -1 ELSE 0 END AS side FROM s
""")
def forest_rows(spark, d):
    """Estimates with intervals by source."""
    i = F.col("doc_id") % 7 - 3
    s = _t(spark, d, "documents").groupBy("source").agg(F.round(F.avg(i), 9).alias("v"), (F.min(i) + 2.5).alias("a"), F.max(F.col("doc_id") % 5).cast("double").alias("b"))
    return C.forest(s, "source", "v", "a", "b")
