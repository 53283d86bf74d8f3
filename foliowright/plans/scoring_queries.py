"""Queries of scoring, judging and run planning, with their SQL counterparts.

Records, judgements and defects are derived from the driver's tables by fixed arithmetic: synthetic facts to run
the operators on.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import documents as D
from ..operators import judging as J
from ..operators import scoring as Q
from ..operators import translation as T
from .queries import _JUDGE_SQL, _t, judgements, register

# ---- protection rules: a sample of each in every document

#: Rule, text before the span, span before and after the document's number, text behind.
SAMPLES = (
    ("alert", "a ", "[!NOTE ", "]", " b"),
    ("url", "a ", "https://h.example/p", "?q=1", ". b"),
    ("www", "a ", "www.example", ".org/p", " b"),
    ("email", "a ", "jo.x", "@mail.example", " b"),
    ("uncpath", "a ", "\\\\nas", "\\team", " b"),
    ("winpath", "a ", "C:\\dir", "\\sub", " b"),
    ("envpath", "a ", "%TMP%\\d", "", " b"),
    ("abspath", "a ", "/var/log", "/app", " b"),
    ("relpath", "a ", "lib/core", ".qq", " b"),
    ("deeppath", "a ", "team/back", "/jobs", " b"),
    ("dirpath", "a ", "build", "/", " b"),
    ("filename", "a ", "notes", ".TXT", " b"),
    ("dotfile", "a ", ".env.x", "", " b"),
    ("template", "a ", "{{ user", " }}", " b"),
    ("envvar", "a ", "$HOME", "", " b"),
    ("printf", "a ", "%", "d", " b"),
    ("emoji", "a ", ":rocket", ":", " b"),
    ("longflag", "a ", "--dry", "=all", " b"),
    ("guid", "id ", "0f8fad5b-d9cb-469f-a165-", "", " b"),
    ("version", "a ", "v2.", ".3", " b"),
    ("ip", "a ", "10.20.", ".40/16", " b"),
    ("hostport", "a ", "localhost:1", "", " b"),
    ("hex", "a ", "0x1f", "", " b"),
    ("issue", "a ", "#4", "", " b"),
    ("mention", "a ", "@acme", "", " b"),
    ("cmdlet", "a ", "Get-Child", "", " b"),
    ("call", "a ", "flush", "()", " b"),
    ("qualified", "a ", "std::v", "", " b"),
    ("snake", "a ", "max_row", "", " b"),
    ("camel", "a ", "row", "Limit", " b"),
    ("pascal", "a ", "Hash", "Map", " b"),
    ("math", "a ", "$x_", "$", " b"),
    ("dnt", "a ", "Azure Item ", "", " b"),
)
#: Samples that hold no number: their spans are always the same.
FIXED = (("docsinclude", "[!INCLUDE ", "next"), ("specialfile", "Makefile", " b"), ("shortflag", "-q", " b"))
_quoted = lambda x: "'" + x.replace("'", "''") + "'"
_SAMPLE_SQL = ", ".join(f"({_quoted(r)}, {_quoted(a)}, {_quoted(b)})" for r, _, a, b, _ in SAMPLES)
_FIXED_SQL = ", ".join(f"({_quoted(r)}, {_quoted(a)})" for r, a, _ in FIXED)
_NUMBER_SQL = "CASE rule WHEN 'guid' THEN lpad((doc_id % 100000)::VARCHAR, 12, '0') WHEN 'ip' THEN (doc_id % 200)::VARCHAR WHEN 'hostport' THEN (1000 + doc_id % 1000)::VARCHAR ELSE (doc_id % 100000)::VARCHAR END"


@register(f"""
WITH s(rule, a, b) AS (VALUES {_SAMPLE_SQL}), f(rule, a) AS (VALUES {_FIXED_SQL})
SELECT doc_id, rule, a || {_NUMBER_SQL} || b AS span FROM documents CROSS JOIN s UNION ALL SELECT doc_id, rule, a FROM documents CROSS JOIN f
""")
def protected_samples(spark, d):
    """Every protection rule finds its sample, and nothing else, in a sentence made for each document and rule."""
    part = lambda *v: F.struct(*[F.lit(x).alias(n) for x, n in zip(v, ("rule", "lead", "a", "b", "tail"), strict=True)])
    rows = D.spread(_t(spark, d, "documents").select("doc_id")).select("doc_id", F.explode(F.array(*[part(*s) for s in SAMPLES], *[part(r, "a ", a, None, t) for r, a, t in FIXED])).alias("s"))
    n = F.when(F.col("s.rule") == "guid", F.lpad((F.col("doc_id") % 100000).cast("string"), 12, "0")).when(F.col("s.rule") == "ip", (F.col("doc_id") % 200).cast("string"))
    n = n.when(F.col("s.rule") == "hostport", (F.col("doc_id") % 1000 + 1000).cast("string")).otherwise((F.col("doc_id") % 100000).cast("string"))
    number = F.when(F.col("s.b").isNull(), "").otherwise(n)
    text = F.concat("s.lead", "s.a", number, F.coalesce("s.b", F.lit("")), "s.tail")
    term = F.concat(F.lit("Azure Item "), n)
    rows = rows.select("doc_id", F.col("s.rule").alias("wanted"), F.when(F.col("s.rule") == "dnt", F.regexp_replace(text, term, "Azure Item ")).otherwise(text).alias("text"), n.alias("n"))
    found = D.protected_spans(rows, ["doc_id", "wanted", "n"], dnt=("Azure Item",))
    span = F.when(F.col("rule") == "dnt", F.concat("span", F.lit(" "), "n")).otherwise(F.col("span"))
    return found.select("doc_id", F.when(F.col("rule") == F.col("wanted"), F.col("rule")).otherwise(F.concat("wanted", F.lit(" as "), "rule")).alias("rule"), span.alias("span"))


# ---- records of two sides

def _count(i: int, side: int):
    return (F.lit(3 + side) * (F.col("doc_id") % 11 + i) + F.col("doc_id")) % (2 if i == 2 else 4)


def _count_sql(i: int, side: int) -> str:
    return f"(({3 + side} * (doc_id % 11 + {i}) + doc_id) % {2 if i == 2 else 4})"


def _side(n: int):
    counts = [_count(i, n).alias(c) for i, c in enumerate(Q.COUNTS)]
    english = F.create_map(F.lit("prose"), F.col("doc_id") % (3 + n), F.lit("comment"), F.col("doc_id") % (2 + n))
    tokens = F.struct((F.col("n_chars") + n).alias("translate"), (F.col("n_chars") % (50 + n)).alias("review"))
    return F.struct(*counts, english.alias("english_by_kind"), tokens.alias("tokens"), ((F.col("n_chars") % 17) / (2 + n)).alias("seconds"))


def records(spark, d):
    rows = _t(spark, d, "documents").select(F.col("source").alias("comparison"), "doc_id", "lang", "n_chars")
    return rows.select("comparison", "doc_id", "lang", (F.col("doc_id") % 3 > 0).alias("changed"), _side(0).alias("on"), _side(1).alias("off"))


_PROBLEM_SQL = {side: " + ".join(_count_sql(i, n) for i in range(len(Q.PROBLEMS))) for n, side in enumerate(("on", "off"))}
_SUMS_SQL = ", ".join(f"sum({_count_sql(i, n)})::BIGINT AS {c}_{side}" for n, side in enumerate(("on", "off")) for i, c in enumerate(Q.COUNTS))


@register(f"""
SELECT source AS comparison, count(*) AS documents, count(*) FILTER (doc_id % 3 > 0) AS affected, {_SUMS_SQL},
  round(avg((n_chars % 17) / 2.0), 6) AS seconds_on, round(avg((n_chars % 17) / 3.0), 6) AS seconds_off,
  sum({_PROBLEM_SQL['on']})::BIGINT AS problems_on, sum({_PROBLEM_SQL['off']})::BIGINT AS problems_off,
  CASE WHEN sum({_PROBLEM_SQL['on']}) < sum({_PROBLEM_SQL['off']}) THEN 'better' WHEN sum({_PROBLEM_SQL['on']}) > sum({_PROBLEM_SQL['off']}) THEN 'worse' ELSE 'same' END AS correctness
FROM documents GROUP BY 1
""")
def comparison_summary(spark, d):
    """Counts of both sides of every comparison, and which side has fewer problems."""
    s = Q.comparison_summary(records(spark, d), ["comparison"])
    return s.withColumn("seconds_on", F.round("seconds_on", 6)).withColumn("seconds_off", F.round("seconds_off", 6))


@register("""
WITH e AS (SELECT source AS comparison, 'prose' AS kind, doc_id % 3 AS n FROM documents UNION ALL SELECT source, 'comment', doc_id % 2 FROM documents)
SELECT comparison, kind, sum(n)::BIGINT AS segments FROM e GROUP BY 1, 2
""")
def english_by_kind(spark, d):
    return Q.english_by_kind(records(spark, d), ["comparison"], "on")


@register("""
SELECT source AS comparison, round(avg(n_chars), 6) AS translate_on, round(avg(n_chars % 50), 6) AS review_on, round(avg(n_chars + 1), 6) AS translate_off, round(avg(n_chars % 51), 6) AS review_off
FROM documents GROUP BY 1
""")
def cost_rows(spark, d):
    c = Q.costs(records(spark, d), ["comparison"])
    return c.select("comparison", *[F.round(x, 6).alias(x) for x in ("translate_on", "review_on", "translate_off", "review_off")])


@register(f"""
WITH {_JUDGE_SQL}, v AS (
  SELECT source AS comparison, doc_id, count(*) FILTER (verdict = 'on') AS a, count(*) FILTER (verdict = 'off') AS b, max(words) AS words, avg(mqm_on) AS m_on, avg(mqm_off) AS m_off FROM j GROUP BY 1, 2),
p AS (SELECT comparison, count(*) AS items, count(*) FILTER (a > b) AS wins, count(*) FILTER (b > a) AS losses, sum(words)::BIGINT AS words, sum(m_on) AS m_on, sum(m_off) AS m_off FROM v GROUP BY 1),
t AS (SELECT *, wins + losses AS n, CASE WHEN wins + losses = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(wins, losses)::BIGINT + 1), lambda i: exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2.0))))) END AS p FROM p),
h AS (SELECT comparison, max(raw) OVER (ORDER BY p, comparison ROWS UNBOUNDED PRECEDING) AS p_adj FROM (
  SELECT comparison, p, least(1.0, p * (count(*) OVER () - row_number() OVER (ORDER BY p, comparison) + 1)) AS raw FROM t WHERE n > 0)),
r AS (SELECT source AS comparison, count(*) AS documents, sum({_PROBLEM_SQL['on']}) AS a, sum({_PROBLEM_SQL['off']}) AS b FROM documents GROUP BY 1),
q AS (SELECT r.comparison, documents, coalesce(items, 0) AS items, coalesce(wins, 0) AS wins, coalesce(losses, 0) AS losses, coalesce(items - wins - losses, 0) AS ties,
  round(m_on / (CASE WHEN words > 0 THEN words / 100.0 ELSE 1 END), 6) AS mqm_on, round(m_off / (CASE WHEN words > 0 THEN words / 100.0 ELSE 1 END), 6) AS mqm_off,
  round(p_adj, 6) AS p_adj, CASE WHEN a < b THEN 'better' WHEN a > b THEN 'worse' ELSE 'same' END AS correctness,
  CASE WHEN coalesce(n, 0) > 0 THEN CASE WHEN p_adj < 0.05 THEN CASE WHEN wins > losses THEN 'better' ELSE 'worse' END ELSE 'no significant difference' END
    WHEN coalesce(items, 0) > 0 THEN 'no significant difference' ELSE 'not judged' END AS quality
  FROM r LEFT JOIN t USING (comparison) LEFT JOIN h USING (comparison))
SELECT *, CASE WHEN (quality = 'better' AND correctness = 'worse') OR (quality = 'worse' AND correctness = 'better') THEN 'review manually'
  WHEN quality = 'better' OR (correctness = 'better' AND quality <> 'worse') THEN 'on' ELSE 'off' END AS recommendation FROM q
""")
def feature_stats(spark, d):
    """Panel votes, penalties per 100 words, adjusted p-values and recommendation of every comparison."""
    j = judgements(spark, d).withColumn("comparison", F.col("source"))
    f = Q.feature_stats(j, records(spark, d), item=("doc_id",))
    return f.select("comparison", "documents", "items", "wins", "losses", "ties", *[F.round(c, 6).alias(c) for c in ("mqm_on", "mqm_off", "p_adj")], "correctness", "quality", "recommendation")


@register(f"""
WITH {_JUDGE_SQL}
SELECT source AS comparison, judge, count(*) FILTER (verdict = 'on') AS wins, count(*) FILTER (verdict = 'off') AS losses, count(*) FILTER (verdict = 'tie') AS ties, count(*) FILTER (verdict = 'inconsistent') AS inconsistent
FROM j GROUP BY 1, 2
""")
def votes_by_judge(spark, d):
    return Q.grouped_votes(judgements(spark, d).withColumn("comparison", F.col("source")), ["comparison", "judge"]).drop("p")


# ---- judgements of two orders

_ORDER_SQL = "CASE (doc_id * {k} + 1) % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'tie' END"


@register(f"""
WITH a AS (SELECT doc_id, {_ORDER_SQL.format(k=2)} AS x, {_ORDER_SQL.format(k=5)} AS y, doc_id % 4 AS na, doc_id % 3 AS nb, doc_id % 10 = 0 AS lost FROM labels),
s AS (SELECT doc_id, CASE x WHEN 'A' THEN 'on' WHEN 'B' THEN 'off' ELSE 'tie' END AS o1, CASE WHEN lost THEN NULL WHEN y = 'A' THEN 'off' WHEN y = 'B' THEN 'on' ELSE 'tie' END AS o2, na, nb FROM a)
SELECT doc_id, o1 AS order1, o2 AS order2, CASE WHEN o2 IS NULL THEN 'error' WHEN o1 = o2 THEN o1 WHEN o1 <> 'tie' AND o2 <> 'tie' THEN 'inconsistent' ELSE 'tie' END AS verdict,
  CASE WHEN o2 IS NOT NULL THEN (5.0 * na + 1.0 * nb) / 2 END AS mqm_on, CASE WHEN o2 IS NOT NULL THEN (1.0 * nb + 5.0 * na) / 2 END AS mqm_off,
  (na + CASE WHEN o2 IS NULL THEN 0 ELSE nb END)::BIGINT AS n_errors_on FROM s
""")
def judgement_fold(spark, d):
    """Answers of a judge in two orders, parsed, put right and folded to a verdict; a tenth of the second answers is lost."""
    l = _t(spark, d, "labels").select("doc_id")
    side = lambda k: F.when((F.col("doc_id") * k + 1) % 3 == 0, "A").when((F.col("doc_id") * k + 1) % 3 == 1, "B").otherwise("tie")
    errors = lambda n, severity: F.array_repeat(F.struct(F.lit("style").alias("category"), F.lit(severity).alias("severity")), (F.col("doc_id") % n).cast("int"))
    made = lambda k: F.to_json(F.struct(F.array(F.struct(F.lit("b0").alias("id"), side(k).alias("better"), errors(4, "major").alias("errors_a"), errors(3, "minor").alias("errors_b"))).alias("results")))
    first = l.select("doc_id", F.concat(F.lit("Here it is:\n```json\n"), made(2), F.lit("\n```")).alias("answer"), F.lit(False).alias("swapped"))
    second = l.select("doc_id", F.when(F.col("doc_id") % 10 == 0, "no answer {").otherwise(F.concat(F.lit("Result "), made(5))).alias("answer"), F.lit(True).alias("swapped"))
    f = Q.fold_judgements(Q.answers(first, ["doc_id"]), Q.answers(second, ["doc_id"]), ["doc_id", "item"])
    return f.select("doc_id", "order1", "order2", "verdict", "mqm_on", "mqm_off", F.size("errors_on").cast("long").alias("n_errors_on"))


@register("""
WITH b AS (SELECT doc_id, len(x) AS n, x FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^ \\t\\x0b\\f\\r]')) AS x FROM documents))
SELECT doc_id, n::BIGINT AS blocks, (SELECT count(*) FROM (SELECT unnest(x) AS l) WHERE contains(l, 'e'))::BIGINT AS differ FROM b WHERE n > 0 AND len(list_filter(x, lambda l: contains(l, 'e'))) > 0
""")
def differing_blocks(spark, d):
    """Lines as blocks; the two sides differ where a line holds an e."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t\x0B\f\r]"))
    rows = D.spread(_t(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.transform(lines, lambda x: F.concat(F.lit("p "), x)).alias("x")).where(F.size("x") > 0)
    text = F.array_join("x", "\n\n")
    sides = rows.select("doc_id", F.size("x").cast("long").alias("blocks"), text.alias("source"), text.alias("on"), F.replace(text, F.lit("e"), F.lit("E")).alias("off"))
    items = Q.differing_blocks(sides, ["doc_id", "blocks"])
    return items.where("contains(source, 'e')").groupBy("doc_id", "blocks").agg(F.count("*").alias("differ"))


# ---- defects and scorecards


def expectations(spark, d):
    return _t(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.array(F.lit("the"), F.lit("de"), F.lit("qqq")).alias("keep"), F.array(F.lit("que"), F.lit("zzz")).alias("translate"))


def defects(spark, d):
    rows = _t(spark, d, "documents").select(F.col("doc_id").alias("doc"), "doc_id", "lang", "source", "text", "n_chars")
    rows = Q.expectation_counts(rows, expectations(spark, d))
    counts = {c: _count(i, 0) for i, c in enumerate(Q.COUNTS)}
    return rows.select(
        "doc", "lang", "source", "keep_missing", "translate_left", *[counts[c].alias(c) for c in ("structure_broken", "code_changed", "links_broken", "reverted", "kept_source", "nmt")],
        F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("failed at "), "doc_id")).alias("error"), F.create_map(F.lit("prose"), F.col("doc_id") % 3).alias("english_by_kind"),
        F.struct(F.col("n_chars").alias("translate"), (F.col("n_chars") % 50).alias("review")).alias("tokens"), ((F.col("n_chars") % 17) / 2).alias("seconds"))


_INDEX = {c: i for i, c in enumerate(Q.COUNTS)}
_DEFECT_SQL = "d AS (SELECT doc_id, lang, source, n_chars, list_filter(['the', 'de', 'qqq'], lambda k: NOT contains(text, k)) AS km, list_filter(['que', 'zzz'], lambda k: contains(text, k)) AS tl, " + ", ".join(f"{_count_sql(_INDEX[c], 0)} AS {c}" for c in ("structure_broken", "code_changed", "links_broken", "reverted", "kept_source", "nmt")) + ", doc_id % 9 = 0 AS err FROM documents)"
_N_SQL = "(len(km) + len(tl) + structure_broken + code_changed + links_broken + err::INT)"
_CARD_SQL = f"""count(*) AS documents, round(1 - sum(len(km)) / (3.0 * count(*)), 6) AS keep_pass, round(1 - sum(len(tl)) / (2.0 * count(*)), 6) AS translate_pass,
  round(count(*) FILTER ({_N_SQL} = 0) / greatest(1, count(*))::DOUBLE, 6) AS clean_documents, sum(structure_broken)::BIGINT AS structure_broken, sum(code_changed)::BIGINT AS code_changed,
  sum(links_broken)::BIGINT AS links_broken, sum(reverted)::BIGINT AS reverted, sum(kept_source)::BIGINT AS kept_source, sum(nmt)::BIGINT AS nmt, count(*) FILTER (err) AS errors,
  sum({_N_SQL})::BIGINT AS defects, sum(doc_id % 3)::BIGINT AS english_segments, round(avg(n_chars + n_chars % 50), 6) AS tokens_mean,
  round(quantile_cont((n_chars % 17) / 2.0, 0.5)::DOUBLE, 6) AS seconds_median, round(quantile_cont((n_chars % 17) / 2.0, 0.9)::DOUBLE, 6) AS seconds_p90"""


def _rounded(card):
    return card.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in card.dtypes])


@register(f"WITH {_DEFECT_SQL} SELECT {_CARD_SQL} FROM d")
def scorecard(spark, d):
    return _rounded(Q.scorecard(defects(spark, d), expectations(spark, d)))


@register(f"WITH {_DEFECT_SQL} SELECT lang, {_CARD_SQL} FROM d GROUP BY 1")
def scorecard_by_language(spark, d):
    return _rounded(Q.scorecard(defects(spark, d), expectations(spark, d), ["lang"]))


@register(f"""
WITH {_DEFECT_SQL}, k AS (
  SELECT lang, doc_id, 'overtranslated' AS type, unnest(km) AS detail FROM d UNION ALL SELECT lang, doc_id, 'untranslated', unnest(tl) FROM d
  UNION ALL SELECT lang, doc_id, 'structure', '' FROM d WHERE structure_broken > 0 UNION ALL SELECT lang, doc_id, 'code', code_changed::VARCHAR FROM d WHERE code_changed > 0
  UNION ALL SELECT lang, doc_id, 'links', links_broken::VARCHAR FROM d WHERE links_broken > 0 UNION ALL SELECT lang, doc_id, 'error', 'failed at ' || doc_id FROM d WHERE err)
SELECT type, lang || '|' || doc_id || '|' || type || '|' || detail AS defect FROM k
""")
def defect_keys(spark, d):
    return Q.defect_keys(defects(spark, d)).select("type", "defect")


@register(f"""
WITH {_DEFECT_SQL}, n AS (SELECT lang, 1 - sum(len(km)) / (3.0 * count(*)) AS keep_pass, sum(code_changed) AS code_changed, avg(n_chars) AS tokens_mean, 'better' AS quality FROM d GROUP BY 1),
b AS (SELECT lang, 1 - sum(len(km)) / (3.0 * count(*)) - CASE WHEN lang = 'en' THEN 0.1 ELSE 0.001 END AS keep_pass, sum(code_changed) - 1 AS code_changed, avg(n_chars) * CASE WHEN lang = 'de' THEN 0.8 ELSE 1.05 END AS tokens_mean, CASE WHEN lang = 'fr' THEN 'worse' ELSE 'better' END AS quality FROM d GROUP BY 1)
SELECT lang, 'keep_pass' AS metric, CASE WHEN lang = 'en' THEN 'improvement' ELSE 'unchanged' END AS status FROM n UNION ALL SELECT lang, 'code_changed', 'regression' FROM n
UNION ALL SELECT lang, 'tokens_mean', CASE WHEN n.tokens_mean > b.tokens_mean * 1.1 THEN 'regression' WHEN n.tokens_mean < b.tokens_mean * 0.9 THEN 'improvement' ELSE 'unchanged' END FROM n JOIN b USING (lang)
UNION ALL SELECT lang, 'quality', CASE WHEN b.quality = 'worse' THEN 'improvement' ELSE 'unchanged' END FROM n JOIN b USING (lang)
""")
def snapshot_changes(spark, d):
    """A snapshot by language held against an earlier one with known differences."""
    now = Q.scorecard(defects(spark, d), expectations(spark, d), ["lang"]).select("lang", "keep_pass", "code_changed").withColumn("quality", F.lit("better"))
    mean = _t(spark, d, "documents").groupBy("lang").agg(F.avg("n_chars").alias("tokens_mean"))
    now = now.join(mean, "lang")
    one = lambda lang, yes, no: F.when(F.col("lang") == lang, yes).otherwise(no)
    before = now.select("lang", (F.col("keep_pass") - one("en", 0.1, 0.001)).alias("keep_pass"), (F.col("code_changed") - 1).alias("code_changed"), (F.col("tokens_mean") * one("de", 0.8, 1.05)).alias("tokens_mean"), one("fr", "worse", "better").alias("quality"))
    return Q.snapshot_changes(before, now, ["lang"], ["keep_pass"], ["code_changed"]).select("lang", "metric", "status")


# ---- links and code


@register("""
WITH p AS (SELECT page_id, regexp_extract_all(html, '<li>(?s:.*?)</li>') AS li FROM pages)
SELECT page_id, len(li)::BIGINT AS targets, (len(li) - len(li) // 2)::BIGINT AS broken FROM p
""")
def broken_links(spark, d):
    """Links inside a page to its list entries; every second entry is marked as a target."""
    entries = F.regexp_extract_all("html", F.lit("<li>(?s:.*?)</li>"), F.lit(0))
    made = F.transform(entries, lambda x, i: F.concat(F.lit('<a href="#e'), i, F.lit('">x</a>'), F.when(i % 2 == 1, F.concat(F.lit('<i id="e'), i, F.lit('"></i>'))).otherwise("")))
    return Q.broken_links(_t(spark, d, "pages").select("page_id", F.array_join(made, "\n").alias("text")), ["page_id"])


@register("""
SELECT doc_id, (doc_id % 4)::BIGINT AS blocks, CASE WHEN doc_id % 4 = 0 THEN 0 WHEN doc_id % 5 = 0 THEN doc_id % 4 WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS code_changed FROM documents
""")
def code_changes(spark, d):
    """Fenced blocks of two versions: in some the first block's code differs, in some only a comment, in some a block is gone."""
    number = (F.col("doc_id") % 4).cast("int")
    fence = lambda comment, first: F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(number, F.lit(1))), lambda i: F.concat(F.lit("Text here.\n\n```js\nx = "), F.when(i == 1, first).otherwise("1"), F.lit(";  // "), comment, F.lit("\n```\n\n"))), "")
    rows = _t(spark, d, "documents").select("doc_id", number.alias("n"), F.when(number > 0, fence(F.lit("old words"), F.lit("1"))).otherwise("Text.").alias("a"), F.when(number > 0, fence(F.lit("new words"), F.when(F.col("doc_id") % 3 == 0, "2").otherwise("1"))).otherwise("Text.").alias("b"))
    cut = F.when((F.col("doc_id") % 5 == 0) & (F.col("n") > 0), F.regexp_replace("b", r"(?s)\A(.*?)```.*?```", "$1")).otherwise(F.col("b"))
    got = Q.code_changes(Q.code_blocks(rows, ["doc_id"], "a"), Q.code_blocks(rows.withColumn("b", cut), ["doc_id"], "b"), ["doc_id"])
    return rows.join(got, "doc_id", "left").select("doc_id", F.col("n").cast("long").alias("blocks"), F.coalesce("code_changed", F.lit(0)).cast("long").alias("code_changed"))


# ---- runs


@register("""
WITH s AS (SELECT unnest([NULL, 'mdx', 'review']) AS switch)
SELECT doc_id, coalesce(switch, 'default') AS variant, CASE WHEN switch IS NOT DISTINCT FROM 'review' THEN false ELSE true END AS review, CASE WHEN switch IS NOT DISTINCT FROM 'mdx' THEN doc_id % 2 = 1 ELSE doc_id % 2 = 0 END AS mdx FROM documents CROSS JOIN s
""")
def run_variants(spark, d):
    """Every document with the default settings and with each switch flipped."""
    jobs = _t(spark, d, "documents").select("doc_id", F.create_map(F.lit("review"), F.lit(True), F.lit("mdx"), F.col("doc_id") % 2 == 0).alias("options"))
    v = Q.variants(jobs, ["review", "mdx"])
    return v.select("doc_id", F.coalesce("switch", F.lit("default")).alias("variant"), F.col("options")["review"].alias("review"), F.col("options")["mdx"].alias("mdx"))


@register("""
SELECT t.lang, count(*) AS jobs, sum(n_chars)::BIGINT AS chars FROM documents CROSS JOIN (SELECT unnest(['de-AT', 'fr', 'sv']) AS lang) t
WHERE lower(split_part(documents.lang, '-', 1)) <> lower(split_part(t.lang, '-', 1)) GROUP BY 1
""")
def translation_jobs(spark, d):
    """Documents by target language, but for those that are in it already."""
    docs = _t(spark, d, "documents").select("doc_id", F.col("lang").alias("own"), "n_chars")
    return T.jobs(docs, ["de-AT", "fr", "sv"], F.col("own")).groupBy("lang").agg(F.count("*").alias("jobs"), F.sum("n_chars").alias("chars"))


@register("""
WITH t AS (SELECT source AS term, lang, min(doc_id)::VARCHAR AS text FROM documents GROUP BY 1, 2), w AS (SELECT unnest(['de', 'fr-CA', 'sv']) AS lang)
SELECT w.lang, t.term, t.text FROM w JOIN t ON t.lang = split_part(w.lang, '-', 1)
""")
def glossary_terms(spark, d):
    """Terms of a language, with those of the base code for a variant that has none."""
    terms = _t(spark, d, "documents").groupBy(F.col("source").alias("term"), "lang").agg(F.min("doc_id").cast("string").alias("text"))
    return T.terms_for(terms, ["de", "fr-CA", "sv"])


@register("""
SELECT conv_id, turn, sha256(to_json(['1', 'gpt', '', 'fr', 'formal', role, '', text, lag(text, 1, '') OVER w, lead(text, 1, '') OVER w, 'g7'])) AS key
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
""")
def cache_keys_of_runs(spark, d):
    c = _t(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.lit("fr").alias("lang"), F.col("turn").alias("seq"), F.col("role").alias("kind"), F.lit("").alias("note"), F.col("text").alias("masked"))
    return T.cache_keyed(c, "1", "gpt", glossary="g7").select(F.col("doc").alias("conv_id"), F.col("seq").alias("turn"), "key")


@register("""
WITH o AS (SELECT conv_id, turn, text, CASE turn % 3 WHEN 0 THEN 'cache' ELSE 'gpt' END AS via, CASE turn % 4 WHEN 1 THEN text || '!' WHEN 3 THEN substr(text, 1, 9) END AS edit FROM conversations),
u AS (SELECT *, edit IS NOT NULL AND via <> 'cache' AND edit <> text AND (length(trim(text)) < 25 OR length(edit)::DOUBLE / length(trim(text)) BETWEEN 0.4 AND 3.0) AS used FROM o)
SELECT via, count(*) AS segments, count(*) FILTER (used) AS edited, sum(length(CASE WHEN used THEN edit ELSE text END))::BIGINT AS chars FROM u GROUP BY 1
""")
def review_edits(spark, d):
    """Edits of reviewers: those of cached texts and those that cut a text short are not taken."""
    c = _t(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.lit("fr").alias("lang"), F.col("turn").alias("seg_id"), F.lit("paragraph").alias("kind"), S.xml_escape(F.col("text")).alias("text"), F.when(F.col("turn") % 3 == 0, "cache").otherwise("gpt").alias("via"), F.col("text").alias("plain"))
    edit = F.when(F.col("seg_id") % 4 == 1, F.concat("plain", F.lit("!"))).when(F.col("seg_id") % 4 == 3, F.substring("plain", 1, 9))
    edits = c.select("doc", "lang", "seg_id", S.xml_escape(edit).alias("text"), F.lit("style").alias("category"), F.lit("minor").alias("severity"), F.lit("").alias("explanation")).where("text IS NOT NULL")
    out = T.apply_review(c.withColumn("source", F.col("text")), edits)
    return out.groupBy("via").agg(F.count("*").alias("segments"), F.count("review").alias("edited"), F.sum(F.length(S.xml_unescape(F.col("text")))).alias("chars"))


# ---- requests, derived runs, lines


@register("""
WITH s AS (SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS batch, role, text FROM conversations)
SELECT conv_id, batch::INT AS batch, count(*) AS segments, string_agg('s' || turn, ',' ORDER BY turn) AS ids, sum(length(text))::BIGINT AS chars FROM s GROUP BY 1, 2
""")
def request_payloads(spark, d):
    """Requests of three segments; what they hold is read back from their JSON."""
    c = _t(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("s"), "turn").alias("seg_id"), F.col("role").alias("kind"), F.lit("").alias("note"), F.col("text").alias("masked"))
    r = J.requests(c, ["conv_id"], "turn", max_items=3, max_chars=10**9)
    x = F.from_json("payload", "segments array<struct<id:string,kind:string,text:string>>")["segments"]
    chars = F.aggregate(F.transform(x, lambda s: F.length(s["text"]).cast("long")), F.lit(0).cast("long"), lambda a, n: a + n)
    return r.select("conv_id", "batch", F.size(x).cast("long").alias("segments"), F.array_join(F.transform(x, lambda s: s["id"]), ",").alias("ids"), chars.alias("chars"))


@register("""
WITH a AS (SELECT conv_id, turn, text, turn % 4 <> 2 AND conv_id % 9 <> 0 AS there FROM conversations)
SELECT conv_id, count(*) AS asked, count(*) FILTER (there) AS answered, count(*) FILTER (NOT there) AS missing, coalesce(sum(length(text) + 1) FILTER (there), 0)::BIGINT AS chars FROM a GROUP BY 1
""")
def model_answers(spark, d):
    """Answers of a model joined by id: some ids are missing, some unknown, some answers unreadable."""
    c = _t(spark, d, "conversations").select("conv_id", F.concat(F.lit("s"), "turn").alias("seg_id"), "turn", F.col("text").alias("masked"))
    one = F.struct(F.when(F.col("turn") % 4 == 2, "unknown").otherwise(F.col("seg_id")).alias("id"), F.concat("masked", F.lit("!")).alias("text"))
    raw = c.groupBy("conv_id").agg(F.to_json(F.struct(F.collect_list(one).alias("translations"))).alias("answer"))
    raw = raw.withColumn("answer", F.when(F.col("conv_id") % 9 == 0, "{cut off").otherwise(F.col("answer")))
    j = J.answered(c, J.responses(raw, ["conv_id"]), ["conv_id"])
    return j.groupBy("conv_id").agg(F.count("*").alias("asked"), F.count("text").alias("answered"), F.count_if(F.size("errors") > 0).alias("missing"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))


@register("""
WITH i AS (SELECT doc_id, lang, doc_id % 3 = 0 AS a, doc_id % 5 = 0 AS b FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '')
SELECT lang, count(*) AS items, count(*) FILTER (NOT a AND b) AS wins, count(*) FILTER (a AND NOT b) AS losses, count(*) FILTER (a = b) AS ties, sum(5.0 * a::INT) AS mqm_on, sum(5.0 * b::INT) AS mqm_off FROM i GROUP BY 1
""")
def judged_by_rule(spark, d):
    """A judge by rule in both orders: every third text of one side and every fifth of the other is the source's own."""
    docs = _t(spark, d, "documents").where(F.trim("text", F.lit(" \t\n\r")) != "")
    made = lambda n: F.when(F.col("doc_id") % n == 0, F.col("text")).otherwise(F.concat(F.lit("x "), "text"))
    items = docs.select("doc_id", "lang", F.col("text").alias("source"), made(3).alias("on"), made(5).alias("off"))
    f = Q.fold_judgements(J.judge(items, J.SourceLeft(), ["doc_id", "lang"]), J.judge(items, J.SourceLeft(), ["doc_id", "lang"], True), ["doc_id", "lang"])
    v = F.col("verdict")
    return f.groupBy("lang").agg(F.count("*").alias("items"), F.count_if(v == "on").alias("wins"), F.count_if(v == "off").alias("losses"), F.count_if(v == "tie").alias("ties"), F.sum("mqm_on").alias("mqm_on"), F.sum("mqm_off").alias("mqm_off"))


@register("""
SELECT user_id % 7 AS variant, count(*) AS runs, sum(event_id % 2)::BIGINT AS reverted, sum(event_id % 3)::BIGINT AS kept_source, sum(event_id % 5)::BIGINT AS retried, sum(event_id % 4)::BIGINT AS nmt, round(avg(value), 6) AS seconds
FROM events GROUP BY 1
""")
def robustness(spark, d):
    e = _t(spark, d, "events").select((F.col("user_id") % 7).alias("variant"), *[(F.col("event_id") % n).alias(c) for c, n in (("reverted", 2), ("kept_source", 3), ("retried", 5), ("nmt", 4))], F.col("value").alias("seconds"))
    return J.robustness(e, ["variant"]).withColumn("seconds", F.round("seconds", 6))


@register("""
SELECT via, count(*) AS segments, coalesce(sum(length(text)), 0)::BIGINT AS chars FROM (
  SELECT CASE WHEN turn % 5 = 1 THEN 'source' ELSE 'gpt' END AS via, CASE WHEN turn % 5 = 1 THEN NULL WHEN turn % 2 = 0 THEN text || ' before' ELSE text END AS text FROM conversations) GROUP BY 1
""")
def derived_runs(spark, d):
    """A run without its review and without the fallback engine."""
    c = _t(spark, d, "conversations")
    review = F.when(F.col("turn") % 2 == 0, F.struct(F.lit("style").alias("category"), F.concat("text", F.lit(" before")).alias("before")))
    out = c.select("conv_id", "text", F.when(F.col("turn") % 5 == 1, "nmt").otherwise("gpt").alias("via"), review.alias("review"))
    return J.without_engine(J.without_review(out)).groupBy("via").agg(F.count("*").alias("segments"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))


@register("""
WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\r?\\n')) AS content, generate_subscripts(regexp_split_to_array(text, '\\r?\\n'), 1) AS line FROM documents)
SELECT doc_id, count(*) AS lines, max(line)::BIGINT AS last, sum(length(content))::BIGINT AS chars FROM l GROUP BY 1
""")
def numbered_lines(spark, d):
    return J.numbered_lines(_t(spark, d, "documents"), ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("lines"), F.max("line").alias("last"), F.sum(F.length("content")).alias("chars"))
