"""Registered queries of the document and evaluation operators, with their SQL counterparts.

Judgements, records and defects are derived from the driver's tables by fixed arithmetic; they are synthetic
facts to run the operators on, not published results.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import markdown
from ..functions import scalars as S
from ..functions import statistics as X
from ..operators import documents as D
from ..operators import evaluation as E
from ..operators import run as R
from ..operators import scoring
from ..operators import translation as T
from ..operators.islands import fixed
from ..options import Options

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(sql: str | None = None):
    def add(fn):
        name = fn.__name__
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


_JUDGE_SQL = """
j AS (
  SELECT l.doc_id, d.lang, d.source, k.judge, (d.n_chars % 97) + 3 AS words,
         CASE (l.doc_id * 31 + k.judge * 17) % 5 WHEN 0 THEN 'on' WHEN 1 THEN 'on' WHEN 2 THEN 'off' WHEN 3 THEN 'tie' ELSE 'inconsistent' END AS verdict,
         CAST((l.doc_id * 7 + k.judge) % 11 AS DOUBLE) AS mqm_on, CAST((l.doc_id * 5 + k.judge * 3) % 13 AS DOUBLE) AS mqm_off
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id CROSS JOIN (SELECT unnest([1, 2, 3]) AS judge) k
)"""


def judgements(spark, d):
    l, docs = _t(spark, d, "labels").select("doc_id"), _t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    j = l.join(docs, "doc_id").withColumn("judge", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    k = (F.col("doc_id") * 31 + F.col("judge") * 17) % 5
    return j.select(
        "doc_id", "lang", "source", "judge", ((F.col("n_chars") % 97) + 3).alias("words"),
        F.when(k <= 1, "on").when(k == 2, "off").when(k == 3, "tie").otherwise("inconsistent").alias("verdict"),
        ((F.col("doc_id") * 7 + F.col("judge")) % 11).cast("double").alias("mqm_on"),
        ((F.col("doc_id") * 5 + F.col("judge") * 3) % 13).cast("double").alias("mqm_off"),
    )


# ---- documents: extraction, masking, assembly


@register()
def document_round_trip(spark, d):
    """Extract, pseudo-translate, check and splice every document, with a report per language."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc"), F.col("text").alias("content"))
    made = R.round_trip(D.spread(docs), ["fr", "sv"], T.Pseudo(), Options(preserve_anchors=False))
    return made.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.size("reverted")).alias("reverted"), F.count_if("identical").alias("identical"), F.count_if(F.col("error").isNotNull()).alias("errors"))


@register(r"SELECT count(*) AS docs, count(*) AS assembled, count(*) AS identical FROM documents WHERE regexp_matches(text, '\p{L}')")
def identity_proof(spark, d):
    """Every document with a letter is assembled from its own segments and the same, byte for byte."""
    docs = D.spread(_t(spark, d, "documents").where(F.col("text").rlike(r"\p{L}")).select(F.col("doc_id").cast("string").alias("doc"), F.col("text").alias("content")))
    seg = fixed(D.extract_segments(docs))
    made = D.assemble(docs, seg, seg.select("doc", F.lit("xx").alias("lang"), "seg_id", F.col("masked").alias("text")))
    joined = docs.join(made.where("error IS NULL"), "doc", "left")
    return joined.agg(F.count("*").alias("docs"), F.count("text").alias("assembled"), F.count_if(F.col("text") == F.col("content")).alias("identical"))


@register()
def extract_documents(spark, d):
    seg = D.extract_segments(D.spread(_t(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")
    return seg.groupBy("kind").agg(F.count("*").alias("segments"), F.sum(F.length("masked")).alias("chars"), F.sum(F.size("singles")).alias("tags"), F.count_if("passive").alias("passive"))


@register()
def extract_pages(spark, d):
    seg = D.extract_segments(D.spread(_t(spark, d, "pages").select("page_id", "html")), "page_id", "html", html=True)
    return seg.groupBy("kind").agg(F.count("*").alias("segments"), F.countDistinct("doc").alias("docs"), F.sum(F.length("original")).alias("chars"))


@register()
def protected_union(spark, d):
    """All 36 protection rules with overlap elimination, over whole texts."""
    spans = D.protected_spans(D.spread(_t(spark, d, "documents").select("doc_id", "text")), ["doc_id"])
    return spans.groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def _rule(name, table, key, col, re2, made=None):
    """A query of one rule; ``made`` (a text before the id, one behind it) stands behind every text, where the table has no match."""

    def query(spark, d):
        text = F.concat_ws(" ", F.col(col), F.concat(F.lit(made[0]), F.col(key).cast("string"), F.lit(made[1]))) if made else F.col(col)
        rows = _t(spark, d, table).select(key, F.posexplode(D.rule_matches(text, name)).alias("pos", "span"))
        return rows.select(key, F.col("pos").cast("long").alias("pos"), "span")

    query.__name__ = f"protect_{name}_{table}"
    text = f"concat_ws(' ', {col}, '{made[0]}' || {key} || '{made[1]}')" if made else col
    register(f"SELECT {key}, pos - 1 AS pos, m[pos] AS span FROM (SELECT {key}, m, unnest(range(1, len(m) + 1)) AS pos FROM (SELECT {key}, regexp_extract_all({text}, '{re2}') AS m FROM {table}))")(query)


# The same patterns in the dialect of the SQL engine.
_rule("email", "documents", "doc_id", "text", r"\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+\b")
_rule("version", "documents", "doc_id", "text", r"\bv\d+(?:\.\d+)+(?:[-+][\w.-]+)?\b|\b\d+\.\d+\.\d+(?:\.\d+)?(?:[-+][\w.-]+)?\b")
_rule("ip", "documents", "doc_id", "text", r"\b(?:\d{1,3}\.){3}\d{1,3}(?:\/\d{1,2})?(?::\d{1,5})?\b")
_rule("pascal", "documents", "doc_id", "text", r"\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+\b|\b[A-Z]{2,}[a-z]+[A-Za-z0-9]*\b")
_rule("snake", "documents", "doc_id", "text", r"\b[A-Za-z][A-Za-z0-9]*(?:\\?_[A-Za-z0-9]+)+\b", ("my_name_", "_x and other_one"))
_rule("guid", "documents", "doc_id", "text", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", ("in 550e8400-e29b-41d4-a716-446655440000 but not 550e8400-e29b-41d4-a716-44665544 ", ""))
_rule("hostport", "documents", "doc_id", "text", r"\b(?:localhost|127\.0\.0\.1|0\.0\.0\.0)(?::\d{1,5})?\b", ("at localhost:80 and 127.0.0.1:8", " or 0.0.0.0"))
_rule("call", "documents", "doc_id", "text", r"\b[A-Za-z_$][\w$]*(?:(?:\.|::|->)[A-Za-z_$][\w$]*)*\(\)", ("by run.it", "() and a::b() or not()"))


_COMMENTED = r"""
SELECT d.doc_id, count(*) AS comments, sum(len(w))::BIGINT AS chars FROM (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]{4,}')) AS w FROM documents
) d GROUP BY d.doc_id
"""


@register(_COMMENTED)
def code_comment_prose(spark, d):
    """Comments of C-like code, one word a comment, between strings that look like comments."""
    docs = D.spread(_t(spark, d, "documents").select("doc_id", "text"))
    lines = F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0)), lambda w: F.concat(F.lit('f("// no"); // '), w))
    found = D.comment_prose(docs.select("doc_id", F.array_join(lines, "\n").alias("code")), ["doc_id"], F.lit("js"))
    return found.groupBy("doc_id").agg(F.count("*").alias("comments"), F.sum(F.length("prose")).alias("chars"))


@register(r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]{4,}')) AS w FROM documents),
n AS (SELECT doc_id, lower(w) AS s, count(*) AS n FROM w GROUP BY ALL)
SELECT doc_id, sum(n)::BIGINT AS headings, sum(n - 1)::BIGINT AS numbered, max(CASE WHEN n > 1 THEN s || '-' || (n - 1) ELSE s END) AS last FROM n GROUP BY 1
""")
def heading_slug_numbers(spark, d):
    """Slugs of a document whose words are headings; repeated ones are numbered in order."""
    lines = F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0)), lambda w: F.concat(F.lit("## "), w))
    docs = D.spread(_t(spark, d, "documents").select("doc_id", "text"))  # words are looked for behind it
    h = D.heading_slugs(docs.select("doc_id", F.array_join(lines, "\n\n").alias("text")), ["doc_id"])
    plain = F.regexp_replace("slug", "-[0-9]+$", "")
    h = h.withColumn("n", F.coalesce(F.nullif(F.regexp_extract("slug", "-([0-9]+)$", 1), F.lit("")).cast("int"), F.lit(0)))
    top = h.groupBy("doc_id", plain.alias("s")).agg(F.count("*").alias("c"), F.max("n").alias("m"), F.max_by("slug", "n").alias("slug"))
    return top.groupBy("doc_id").agg(F.sum("c").alias("headings"), F.sum("m").alias("numbered"), F.max("slug").alias("last"))


@register()
def assemble_with_anchors(spark, d):
    """Translated headings keep an anchor of their old slug."""
    text = F.concat(F.lit("# About "), F.col("source"), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    docs = D.spread(_t(spark, d, "documents").where("source IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc"), text.alias("content")))
    seg = fixed(D.extract_segments(docs, kinds=("heading",)))  # written once, read by translation and assembly
    memory = T.translate(seg, ["fr"], T.Pseudo()).where("text IS NOT NULL").select("doc", "lang", "seg_id", "text")
    made = D.assemble(docs, seg, memory, anchors=True)
    return made.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.size("anchors")).alias("anchors"), F.sum(F.size("reverted")).alias("reverted"), F.count_if(F.col("error").isNotNull()).alias("errors"))


# ---- scalars


@register("""
SELECT lang, count(*) AS docs, sum(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda w: regexp_matches(w, '\\p{L}'))))::BIGINT AS words
FROM documents GROUP BY lang
""")
def word_count_by_lang(spark, d):
    return _t(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("docs"), F.sum(S.word_count(F.col("text"))).alias("words"))


@register("""
WITH e AS (SELECT page_id, html, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS x FROM pages)
SELECT page_id, length(x) AS escaped_chars,
  replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&') = html AS same FROM e
""")
def xml_escape_roundtrip(spark, d):
    p = _t(spark, d, "pages").withColumn("x", S.xml_escape(F.col("html")))
    return p.select("page_id", F.length("x").cast("long").alias("escaped_chars"), (S.xml_unescape(F.col("x")) == F.col("html")).alias("same"))


@register("""
SELECT conv_id, turn, CASE WHEN length(f) > 80 THEN substr(f, 1, 77) || '...' ELSE f END AS hint,
  CASE WHEN length(o) > 40 THEN substr(o, 1, 39) || '…' ELSE o END AS clipped
FROM (SELECT conv_id, turn, regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g') AS f, regexp_replace(text, '[\\r\\n]+', ' ', 'g') AS o FROM conversations)
""")
def hints(spark, d):
    c = _t(spark, d, "conversations")
    return c.select("conv_id", "turn", S.hint(F.col("text")).alias("hint"), S.clip(S.one_line(F.col("text")), 40).alias("clipped"))


@register("""
WITH p AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations)
SELECT conv_id, turn, CASE WHEN length(text) < 25 THEN false ELSE (length(nxt)::DOUBLE / length(text) < 0.4 OR length(nxt)::DOUBLE / length(text) > 3.0) END AS fails,
  (text = nxt AND len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda w: regexp_matches(w, '\\p{L}{3,}'))) >= 4) AS untranslated
FROM p WHERE nxt IS NOT NULL
""")
def length_ratio_flags(spark, d):
    w = W.Window.partitionBy("conv_id").orderBy("turn")
    p = _t(spark, d, "conversations").withColumn("nxt", F.lead("text").over(w)).where("nxt IS NOT NULL")
    return p.select("conv_id", "turn", S.ratio_fails(F.col("text"), F.col("nxt")).alias("fails"), S.untranslated(F.col("text"), F.col("nxt")).alias("untranslated"))


@register("""
SELECT source, CASE WHEN source LIKE 'src1%' THEN 'ones' ELSE 'others' END AS grp, count(*) AS n,
  CASE WHEN max(CASE WHEN lower(split_part(lang, '-', 1)) = 'en' THEN 1 ELSE 0 END) = 1 THEN true ELSE false END AS has_english
FROM documents GROUP BY source
""")
def same_language_filter(spark, d):
    x = _t(spark, d, "documents")
    return x.groupBy("source").agg(F.when(F.col("source").startswith("src1"), "ones").otherwise("others").alias("grp"), F.count("*").alias("n"), F.coalesce(F.max(S.same_language(F.col("lang"), F.lit("EN-gb")).cast("int")), F.lit(0)).alias("h")).select("source", "grp", "n", (F.col("h") == 1).alias("has_english"))


@register("""
SELECT doc, CASE WHEN regexp_matches(doc, '^mixed-') THEN 'mixed' WHEN regexp_matches(doc, '^docstrings-') THEN 'docstrings' WHEN regexp_matches(doc, '^code-') THEN 'code'
  WHEN regexp_matches(doc, '\\.mdx$|^mdx-') THEN 'MDX' WHEN regexp_matches(doc, '^(html-|images-)') THEN 'HTML and images' ELSE 'prose and UI' END AS category, n FROM (
  SELECT CASE doc_id % 6 WHEN 0 THEN 'mixed-' WHEN 1 THEN 'docstrings-' WHEN 2 THEN 'code-' WHEN 3 THEN 'mdx-' WHEN 4 THEN 'html-' ELSE 'faq' END || lang AS doc, count(*) AS n FROM documents GROUP BY 1)
""")
def doc_categories(spark, d):
    name = F.concat(F.element_at(F.array(*map(F.lit, ("mixed-", "docstrings-", "code-", "mdx-", "html-", "faq"))), (F.col("doc_id") % 6 + 1).cast("int")), F.col("lang"))
    x = _t(spark, d, "documents").groupBy(name.alias("doc")).agg(F.count("*").alias("n"))
    return x.select("doc", S.category(F.col("doc")).alias("category"), "n")


# ---- cache, batches, outcomes


@register("""
SELECT conv_id, turn, sha256(to_json([role, text, lag(text, 1, '') OVER w, lead(text, 1, '') OVER w])) AS key
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
""")
def cache_keys(spark, d):
    n = T.neighbours(_t(spark, d, "conversations"), "conv_id", "turn", "text")
    return n.select("conv_id", "turn", T.content_key(F.col("role"), F.col("text"), F.col("prev"), F.col("next")).alias("key"))


@register("""
WITH c AS (SELECT sha256(text) AS key, min(CASE WHEN length(text) % 3 = 0 THEN substr(text, 1, 10) ELSE text || '.' END) AS hit FROM conversations WHERE conv_id % 2 = 0 GROUP BY 1)
SELECT role, count(*) AS rows, count(*) FILTER (hit IS NOT NULL AND (length(trim(text)) < 25 OR length(hit)::DOUBLE / length(text) BETWEEN 0.4 AND 3.0)) AS hits
FROM conversations s LEFT JOIN c ON c.key = sha256(s.text) GROUP BY 1
""")
def cache_probe(spark, d):
    """Hits of a cache that holds half of the texts; those cut to ten characters are too short to count."""
    s = _t(spark, d, "conversations").withColumn("key", F.sha2("text", 256)).withColumn("masked", S.xml_escape(F.col("text")))
    kept = F.when(F.length("text") % 3 == 0, F.substring("text", 1, 10)).otherwise(F.concat("text", F.lit(".")))
    c = s.where("conv_id % 2 = 0").groupBy("key").agg(F.min(kept).alias("text")).withColumn("text", S.xml_escape(F.col("text")))
    return T.probe_cache(s.drop("text"), c).groupBy("role").agg(F.count("*").alias("rows"), F.count("text").alias("hits"))


@register("""
WITH RECURSIVE r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, length(text) AS n FROM conversations),
p AS (
  SELECT conv_id, i, n, 0 AS batch, 1 AS items, n AS chars FROM r WHERE i = 1
  UNION ALL
  SELECT r.conv_id, r.i, r.n, CASE WHEN p.items >= 3 OR p.chars + r.n > 400 THEN p.batch + 1 ELSE p.batch END,
    CASE WHEN p.items >= 3 OR p.chars + r.n > 400 THEN 1 ELSE p.items + 1 END, CASE WHEN p.items >= 3 OR p.chars + r.n > 400 THEN r.n ELSE p.chars + r.n END
  FROM p JOIN r ON r.conv_id = p.conv_id AND r.i = p.i + 1
)
SELECT conv_id, batch, count(*) AS items, sum(n)::BIGINT AS chars FROM p GROUP BY 1, 2
""")
def batch_packing(spark, d):
    b = T.batches(_t(spark, d, "conversations"), ["conv_id"], "turn", "text", 3, 400)
    return b.groupBy("conv_id", "batch").agg(F.count("*").alias("items"), F.sum(F.length("text")).alias("chars"))


_VIA_SQL = "CASE event_type WHEN 'click' THEN 'cache' WHEN 'view' THEN 'gpt' WHEN 'signup' THEN 'nmt' ELSE 'source' END"


@register(f"""
WITH o AS (SELECT user_id % 50 AS doc, 's' || event_id AS id, {_VIA_SQL} AS via, value > 50 AS again, event_id % 7 = 0 AS same, event_id % 5 = 0 AS edited FROM events)
SELECT doc, count(*) AS segments, count(*) FILTER (via = 'cache') AS via_cache, count(*) FILTER (via = 'gpt') AS via_gpt, count(*) FILTER (via = 'nmt') AS via_nmt,
  count(*) FILTER (via = 'source') AS via_source, count(*) FILTER (again) AS retried, count(*) FILTER (same) AS untranslated, min(id) FILTER (same) AS first_untranslated,
  min(id) FILTER (via = 'source') AS first_kept, count(*) FILTER (edited) AS review_edits,
  CASE WHEN count(*) FILTER (via = 'source') = 0 THEN 'translated' WHEN count(*) FILTER (via = 'source') < count(*) THEN 'partial' ELSE 'failed' END AS status
FROM o GROUP BY 1
""")
def report_rollup(spark, d):
    """The report of outcomes that events stand for."""
    via = F.when(F.col("event_type") == "click", "cache").when(F.col("event_type") == "view", "gpt").when(F.col("event_type") == "signup", "nmt").otherwise("source")
    o = _t(spark, d, "events").select(
        (F.col("user_id") % 50).alias("doc"), F.concat(F.lit("s"), "event_id").alias("seg_id"), via.alias("via"), (F.col("value") > 50).cast("int").alias("retries"),
        (F.col("event_id") % 7 == 0).alias("untranslated"), F.array(F.lit("x")).alias("errors"), F.when(F.col("event_id") % 5 == 0, "edit").alias("review"))
    r = T.report(o, ["doc"])
    return r.select("doc", "segments", "via_cache", "via_gpt", "via_nmt", "via_source", "retried", "untranslated", F.get("untranslated_ids", F.lit(0)).alias("first_untranslated"), F.get("kept_source", F.lit(0))["id"].alias("first_kept"), "review_edits", "status")


@register("SELECT event_type AS deployment, count(*) AS calls, sum(user_id)::BIGINT AS prompt, sum(event_id % 1000)::BIGINT AS completion FROM events GROUP BY 1")
def token_usage(spark, d):
    return T.usage(_t(spark, d, "events").select(F.col("event_type").alias("deployment"), F.col("user_id").alias("prompt"), (F.col("event_id") % 1000).alias("completion")), ["deployment"])


@register("""
SELECT conv_id, max(CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 0 END) AS rank,
  CASE max(CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 0 END) WHEN 2 THEN 'failed' WHEN 1 THEN 'partial' ELSE 'translated' END AS status FROM conversations GROUP BY 1
""")
def worst_status(spark, d):
    named = F.when(F.col("role") == "user", "partial").when(F.col("role") == "assistant", "failed").otherwise("translated")
    return T.worst(_t(spark, d, "conversations").select("conv_id", named.alias("status")), ["conv_id"])


# ---- HTML


@register(r"""
SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '<!--(?s:.*?)-->|<![^>]*>|</?[A-Za-z][^>]*>'), lambda x: regexp_replace(x, '( (?:alt|title)=")[^"]*"', '\1…"', 'g')), ' ') AS skeleton FROM pages
""")
def html_skeletons(spark, d):
    """The tags of a page with their prose attributes blanked."""
    p = D.map_column(D.spread(_t(spark, d, "pages").select("page_id", "html")), "html", "skeleton", lambda h: " ".join(markdown.html_skeleton(h)), "string")
    return p.select("page_id", "skeleton")


@register("""
WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages), k AS (SELECT DISTINCT url FROM pages)
SELECT t.page_id, t.target, count(*) AS n FROM t ANTI JOIN k ON k.url = t.target GROUP BY 1, 2
""")
def html_targets_broken(spark, d):
    p = _t(spark, d, "pages")
    t = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
    return E.dangling(t, p.select(F.col("url").alias("target")), ["target"]).groupBy("page_id", "target").agg(F.count("*").alias("n"))


@register("""
WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)) AS t FROM pages)
SELECT page_id, t AS heading, replace(regexp_replace(lower(t), '[^\\p{L}\\p{M}\\p{N}\\p{Pc}\\- ]', '', 'g'), ' ', '-') AS slug FROM h
""")
def heading_slugs(spark, d):
    h = _t(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("(?s)<h1[^>]*>(.*?)</h1>"), F.lit(1))).alias("heading"))
    return h.select("page_id", "heading", S.slug(F.col("heading")).alias("slug"))


# ---- evaluation


@register(f"""
WITH {_JUDGE_SQL}
SELECT judge, lang, grouping(judge)::INT AS all_judge, grouping(lang)::INT AS all_lang,
  count(*) FILTER (verdict = 'on') AS wins, count(*) FILTER (verdict = 'off') AS losses, count(*) FILTER (verdict NOT IN ('on', 'off')) AS ties,
  sum(words)::BIGINT AS words, round(sum(mqm_on) / greatest(1, sum(words) / 100.0), 6) AS on_per_100, round(sum(mqm_off) / greatest(1, sum(words) / 100.0), 6) AS off_per_100
FROM j GROUP BY GROUPING SETS ((), (judge), (lang))
""")
def tally_grouping_sets(spark, d):
    t = E.tally(judgements(spark, d), [[], ["judge"], ["lang"]], ["judge", "lang"])
    return t.select("judge", "lang", "all_judge", "all_lang", "wins", "losses", "ties", "words", F.round("on_per_100", 6).alias("on_per_100"), F.round("off_per_100", 6).alias("off_per_100"))


@register(f"""
WITH {_JUDGE_SQL}, p AS (SELECT doc_id, count(*) FILTER (verdict = 'on') AS n_on, count(*) FILTER (verdict = 'off') AS n_off FROM j GROUP BY 1)
SELECT doc_id, n_on AS "on", n_off AS "off", CASE WHEN n_on > n_off THEN 'on' WHEN n_off > n_on THEN 'off' ELSE 'tie' END AS majority FROM p
""")
def panel_majority(spark, d):
    return E.panel(judgements(spark, d), ["doc_id"])


@register(f"""
WITH {_JUDGE_SQL}, q AS (SELECT *, CASE WHEN verdict IN ('on', 'off') THEN verdict ELSE 'tie' END AS mine FROM j),
o AS (SELECT a.doc_id, a.judge, count(*) FILTER (b.verdict = 'on') AS n_on, count(*) FILTER (b.verdict = 'off') AS n_off FROM q a JOIN q b ON a.doc_id = b.doc_id AND a.judge <> b.judge GROUP BY 1, 2)
SELECT q.judge, count(*) AS n, round(avg((mine <> 'tie')::INT), 6) AS decisive, round(avg((verdict <> 'inconsistent')::INT), 6) AS consistent,
  round(avg((mine = CASE WHEN n_on > n_off THEN 'on' WHEN n_off > n_on THEN 'off' ELSE 'tie' END)::INT), 6) AS agreement
FROM q JOIN o USING (doc_id, judge) GROUP BY 1
""")
def judge_reliability(spark, d):
    r = E.judge_reliability(judgements(spark, d), ["doc_id"])
    return r.select("judge", "n", *[F.round(c, 6).alias(c) for c in ("decisive", "consistent", "agreement")])


@register(f"""
WITH {_JUDGE_SQL}, p AS (SELECT a.judge AS judge_a, b.judge AS judge_b, a.verdict AS va, b.verdict AS vb FROM j a JOIN j b ON a.doc_id = b.doc_id AND a.judge < b.judge),
n AS (SELECT judge_a, judge_b, count(*) AS n, avg((va = vb)::INT) AS po FROM p GROUP BY 1, 2),
c AS (SELECT l.judge_a, l.judge_b, sum(l.c::DOUBLE * r.c) AS x FROM (SELECT judge_a, judge_b, va AS v, count(*) AS c FROM p GROUP BY ALL) l
  JOIN (SELECT judge_a, judge_b, vb AS v, count(*) AS c FROM p GROUP BY ALL) r USING (judge_a, judge_b, v) GROUP BY 1, 2)
SELECT n.judge_a, n.judge_b, n.n, round((po - x / (n::DOUBLE * n)) / (1 - x / (n::DOUBLE * n)), 6) AS kappa FROM n JOIN c USING (judge_a, judge_b)
""".replace("n::DOUBLE * n)", "n.n::DOUBLE * n.n)"))
def cohen_kappa(spark, d):
    k = E.pairwise_kappa(judgements(spark, d), ["doc_id"])
    return k.select("judge_a", "judge_b", "n", F.round("kappa", 6).alias("kappa"))


@register(f"""
WITH {_JUDGE_SQL}, c AS (SELECT lang, doc_id, verdict, count(*) AS c FROM j GROUP BY ALL),
i AS (SELECT lang, doc_id, sum(c) AS m, sum(c * c) AS sq FROM c GROUP BY ALL),
a AS (SELECT lang, count(*) AS items, avg((sq - m) / (m * (m - 1))) AS p FROM i GROUP BY 1),
s AS (SELECT lang, sum(pow(t / (items * 3.0), 2)) AS pe FROM (SELECT lang, verdict, sum(c) AS t FROM c GROUP BY ALL) JOIN a USING (lang) GROUP BY 1)
SELECT lang, items, round(CASE WHEN pe = 1 THEN 1 ELSE (p - pe) / (1 - pe) END, 6) AS kappa FROM a JOIN s USING (lang)
""")
def fleiss_kappa(spark, d):
    k = X.fleiss_kappa(judgements(spark, d).where("lang IS NOT NULL"), ["lang"], "doc_id", "verdict")
    return k.select("lang", "items", F.round("kappa", 6).alias("kappa"))


_WINS = f"""{_JUDGE_SQL}, w AS (SELECT source, count(*) FILTER (verdict = 'on') AS k, count(*) FILTER (verdict IN ('on', 'off')) AS n FROM j GROUP BY 1),
t AS (SELECT source, k, n, CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(k, n - k)::BIGINT + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0))))) END AS p FROM w)"""


def _wins(spark, d):
    j = judgements(spark, d)
    return j.groupBy("source").agg(F.count_if(F.col("verdict") == "on").alias("k"), F.count_if(F.col("verdict").isin("on", "off")).alias("n"))


@register(f"WITH {_WINS} SELECT source, k, n, round(p, 6) AS p FROM t")
def sign_test(spark, d):
    return _wins(spark, d).select("source", "k", "n", F.round(X.sign_test(F.col("k"), F.col("n")), 6).alias("p"))


@register(f"""WITH {_WINS} SELECT source,
 round(CASE WHEN n = 0 THEN 0.0 ELSE greatest(0.0, (k / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) - 1.96 * sqrt((k / n) * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n)) END, 6) AS low,
 round(CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, (k / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) + 1.96 * sqrt((k / n) * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n)) END, 6) AS high
 FROM (SELECT source, k::DOUBLE AS k, n::DOUBLE AS n FROM w)""")
def wilson_interval(spark, d):
    low, high = X.wilson(F.col("k"), F.col("n"))
    return _wins(spark, d).select("source", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@register(f"""WITH {_WINS}, r AS (SELECT source, p, least(1.0, p * (count(*) OVER () - row_number() OVER (ORDER BY p, source) + 1)) AS raw, row_number() OVER (ORDER BY p, source) AS i FROM t)
SELECT source, round(max(raw) OVER (ORDER BY i), 6) AS p_adj FROM r""")
def holm_adjust(spark, d):
    p = _wins(spark, d).withColumn("p", X.sign_test(F.col("k"), F.col("n")))
    return X.holm(p).select("source", F.round("p_adj", 6).alias("p_adj"))


@register("""
SELECT event_type, round(quantile_cont(value::DOUBLE, 0.5), 6) AS median, round(quantile_cont(value::DOUBLE, 0.9), 6) AS p90, round(avg(value), 6) AS mean FROM events GROUP BY 1
""")
def duration_quantiles(spark, d):
    q = E.quantiles(_t(spark, d, "events"), ["event_type"], "value", {"median": 0.5, "p90": 0.9})
    return q.select("event_type", *[F.round(c, 6).alias(c) for c in ("median", "p90", "mean")])


@register()
def bootstrap_reduction(spark, d):
    """Paired bootstrap by language, items in the order of their id."""
    items = judgements(spark, d).groupBy("lang", "doc_id").agg(F.first("words").alias("words"), F.avg("mqm_on").alias("mqm_on"), F.avg("mqm_off").alias("mqm_off"))
    return X.bootstrap(items, ["lang"], "doc_id")


@register("""
SELECT r.event_id, max(h.event_id) AS previous_id FROM (SELECT * FROM events WHERE event_type = 'purchase') r
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1, 2) h ON r.user_id = h.user_id AND r.ts > h.ts GROUP BY 1
""")
def latest_snapshot_before(spark, d):
    e = _t(spark, d, "events")
    h = e.where("event_type = 'view'").groupBy("user_id", F.col("ts").alias("created_at")).agg(F.max("event_id").alias("view_id"))
    r = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("created_at"), "event_id")
    pre = E.latest_before(r.select("user_id", "created_at").distinct(), h, ["user_id"])
    return r.join(pre, ["user_id", "created_at"]).select("event_id", F.col("previous.view_id").alias("previous_id"))


@register("""
WITH b AS (SELECT DISTINCT 'd' || l_orderkey || '|' || l_returnflag AS defect FROM lineitem WHERE l_linenumber = 1),
a AS (SELECT DISTINCT 'd' || l_orderkey || '|' || l_returnflag AS defect FROM lineitem WHERE l_linenumber = 2),
e AS (SELECT DISTINCT 'd' || o_orderkey || '|' || 'N' AS defect FROM orders)
SELECT defect, 'new' AS change FROM (SELECT defect FROM a EXCEPT SELECT defect FROM b)
UNION ALL SELECT g.defect, CASE WHEN e.defect IS NULL THEN 'retired' ELSE 'fixed' END FROM (SELECT defect FROM b EXCEPT SELECT defect FROM a) g LEFT JOIN e ON e.defect = g.defect
""")
def defect_diff(spark, d):
    """Defects of two runs, for which the first and second line of orders stand."""
    l = _t(spark, d, "lineitem")
    key = F.concat(F.lit("d"), F.col("l_orderkey"), F.lit("|"), F.col("l_returnflag")).alias("defect")
    e = _t(spark, d, "orders").select(F.concat(F.lit("d"), F.col("o_orderkey"), F.lit("|N")).alias("defect"))
    return E.defect_changes(l.where("l_linenumber = 1").select(key), l.where("l_linenumber = 2").select(key), e)


@register("""
WITH w AS (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT line, count(*) AS n FROM (SELECT line FROM w WHERE source = 'src1' INTERSECT ALL SELECT line FROM w WHERE source = 'src2') GROUP BY 1
""")
def english_left(spark, d):
    """Lines that two texts share, each as often as the rarer side has it; the lines of two sources stand for them."""
    w = _t(spark, d, "documents").select("source", F.explode(F.split("text", "\n")).alias("line"))
    return E.multiset_common(w.where("source = 'src1'"), w.where("source = 'src2'"), ["line"]).groupBy("line").agg(F.count("*").alias("n"))


@register("""
WITH w AS (SELECT source, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT source, unnest(ls) AS line FROM w),
a AS (SELECT line, count(*) AS n FROM l WHERE source = 'src1' AND len(regexp_extract_all(line, '\\p{L}{2,}')) >= 3 GROUP BY 1),
b AS (SELECT line, count(*) AS n FROM l WHERE source = 'src2' AND len(regexp_extract_all(line, '\\p{L}{2,}')) >= 3 GROUP BY 1)
SELECT length(a.line) % 5 AS run, CASE WHEN length(a.line) % 2 = 0 THEN 'prose' ELSE 'comment' END AS category, sum(least(a.n, b.n))::BIGINT AS english_left
FROM a JOIN b USING (line) GROUP BY 1, 2
""")
def english_segments_left(spark, d):
    """Segments that source and output share; the lines of two sources stand for them."""
    w = _t(spark, d, "documents").select("source", F.explode(F.split("text", "\n")).alias("plain"))
    n = F.length("plain")
    w = w.select("source", (n % 5).alias("run"), F.when(n % 2 == 0, "prose").otherwise("comment").alias("category"), "plain")
    return scoring.english_left(w.where("source = 'src1'"), w.where("source = 'src2'"), ["run"])


@register("""
WITH m AS (SELECT lang, count(*) AS docs, avg((n_chars > 1000)::INT) AS rate_long, sum((n_chars < 300)::INT) AS short FROM documents GROUP BY 1),
b AS (SELECT lang, avg((n_chars > 1500)::INT) AS rate_long, sum((n_chars < 200)::INT) AS short FROM documents GROUP BY 1)
SELECT m.lang, 'rate_long' AS metric, CASE WHEN abs(m.rate_long - b.rate_long) <= 0.005 THEN 'same' WHEN m.rate_long > b.rate_long THEN 'better' ELSE 'worse' END AS status FROM m JOIN b USING (lang)
UNION ALL SELECT m.lang, 'short', CASE WHEN b.short > m.short THEN 'better' WHEN b.short < m.short THEN 'worse' ELSE 'same' END FROM m JOIN b USING (lang)
""")
def regression_status(spark, d):
    x = _t(spark, d, "documents")
    m = lambda lo, hi: x.groupBy("lang").agg(F.avg((F.col("n_chars") > hi).cast("int")).alias("rate_long"), F.sum((F.col("n_chars") < lo).cast("int")).alias("short"))
    return E.regression(m(300, 1000), m(200, 1500), ["lang"], ["rate_long"], ["short"]).select("lang", "metric", "status")


@register(f"""
WITH {_WINS}, r AS (SELECT source, k, n, p, least(1.0, p * (count(*) OVER () - row_number() OVER (ORDER BY p, source) + 1)) AS raw, row_number() OVER (ORDER BY p, source) AS i FROM t),
h AS (SELECT source, k AS wins, n - k AS losses, max(raw) OVER (ORDER BY i) AS p_adj FROM r),
q AS (SELECT source, wins, losses, CASE WHEN wins + losses > 0 THEN CASE WHEN p_adj < 0.05 THEN CASE WHEN wins > losses THEN 'better' ELSE 'worse' END ELSE 'no significant difference' END ELSE 'no significant difference' END AS quality,
  CASE WHEN wins % 3 = 0 THEN 'better' WHEN wins % 3 = 1 THEN 'worse' ELSE 'same' END AS correctness FROM h)
SELECT source, wins, losses, quality, correctness, CASE WHEN (quality = 'better' AND correctness = 'worse') OR (quality = 'worse' AND correctness = 'better') THEN 'review manually'
  WHEN quality = 'better' OR (correctness = 'better' AND quality <> 'worse') THEN 'on' ELSE 'off' END AS recommendation FROM q
""")
def feature_decision(spark, d):
    p = X.holm(_wins(spark, d).withColumn("p", X.sign_test(F.col("k"), F.col("n"))))
    p = p.select("source", F.col("k").alias("wins"), (F.col("n") - F.col("k")).alias("losses"), "p_adj", F.col("n").alias("items"), F.lit(1).alias("affected"))
    p = p.withColumn("correctness", F.when(F.col("wins") % 3 == 0, "better").when(F.col("wins") % 3 == 1, "worse").otherwise("same"))
    return E.decision(p).select("source", "wins", "losses", "quality", "correctness", "recommendation")


@register("""
WITH e AS (SELECT l_returnflag AS category, l_orderkey % 7 AS comparison, CASE l_linenumber % 3 WHEN 0 THEN 10.0 WHEN 1 THEN 5.0 ELSE 1.0 END AS w FROM lineitem)
SELECT comparison, category, sum(w) AS points FROM e GROUP BY 1, 2
""")
def error_category_points(spark, d):
    s = F.when(F.col("l_linenumber") % 3 == 0, "critical").when(F.col("l_linenumber") % 3 == 1, "major").otherwise("minor")
    l = _t(spark, d, "lineitem").select((F.col("l_orderkey") % 7).alias("comparison"), F.array(F.struct(F.col("l_returnflag").alias("category"), s.alias("severity"))).alias("errors"))
    return E.category_points(l, "errors", ["comparison"])
