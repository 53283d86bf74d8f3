"""Queries of the relational operators: spans, splicing, tags, runs of rows, batches, dependents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spans as P
from ..operators.documents import spread
from .queries import _t, register

# Texts that several rules match at once, picked by id.
_SAMPLES = (
    "mail a.b_c@host-x.example.com now", "v1.2.3.4-beta_x", "10.1.2.3:80 or 1.2.3", "fooBar.callMe()", "snake_case_Name", "www.a_b.com for PascalCaseName",
    "at Foo.Bar.run()", "x_y@z_w.example.org", "550e8400-e29b-41d4-a716-446655440000", "ABCdef v2.0.1_rc", "localhost:8080", "callIt() then_that",
)
# Rules of these texts in their order, in the dialect of the SQL engine.
_PATTERNS = (
    ("www", r"\bwww\.[\w-]+(?:\.[\w-]+)+"),
    ("email", r"\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+\b"),
    ("guid", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"),
    ("version", r"\bv\d+(?:\.\d+)+(?:[-+][\w.-]+)?\b|\b\d+\.\d+\.\d+(?:\.\d+)?(?:[-+][\w.-]+)?\b"),
    ("ip", r"\b(?:\d{1,3}\.){3}\d{1,3}(?:\/\d{1,2})?(?::\d{1,5})?\b"),
    ("hostport", r"\b(?:localhost|127\.0\.0\.1|0\.0\.0\.0)(?::\d{1,5})?\b"),
    ("call", r"\b[A-Za-z_$][\w$]*(?:(?:\.|::|->)[A-Za-z_$][\w$]*)*\(\)"),
    ("qualified", r"\b[A-Z][\w]*(?:\.[A-Z][\w]*){1,}\b"),
    ("snake", r"\b[A-Za-z][A-Za-z0-9]*(?:\\?_[A-Za-z0-9]+)+\b"),
    ("camel", r"\b[a-z]+[0-9]*(?:[A-Z][a-z0-9]*)+\b"),
    ("pascal", r"\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+\b|\b[A-Z]{2,}[a-z]+[A-Za-z0-9]*\b"),
)
_PICKS = (1, 5, 7, 11)


def _places_sql(rule: int, name: str, pattern: str) -> str:
    return f"""SELECT doc_id, {rule} AS rule, '{name}' AS name, pos, g, m FROM (
  SELECT doc_id, unnest(range(1, len(m) + 1)) AS pos, g, m FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}') AS m FROM d))"""


_NL = "\n  UNION ALL "
_MADE_SQL = " || ' ' || ".join(f"([{', '.join(repr(s) for s in _SAMPLES)}])[doc_id * {k} % {len(_SAMPLES)} + 1]" for k in _PICKS)


@register(rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_MADE_SQL} AS t FROM documents),
found AS (
  {_NL.join(_places_sql(i, n, p) for i, (n, p) in enumerate(_PATTERNS))}
), placed AS (
  SELECT doc_id, rule, name, m[pos] AS span, (sum(len(g[pos])) OVER w + coalesce(sum(len(m[pos])) OVER (PARTITION BY doc_id, rule ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INTEGER AS start
  FROM found WINDOW w AS (PARTITION BY doc_id, rule ORDER BY pos)
), s AS (
  SELECT *, start + len(span)::INTEGER AS stop, row_number() OVER (PARTITION BY doc_id ORDER BY start, start + len(span) DESC, rule) AS r FROM placed
), nxt AS (SELECT a.doc_id, a.r, min(b.r) AS n FROM s a LEFT JOIN s b ON b.doc_id = a.doc_id AND b.start >= a.stop GROUP BY 1, 2),
walk(doc_id, r) AS (SELECT doc_id, 1 FROM s WHERE r = 1 UNION ALL SELECT w.doc_id, nxt.n FROM walk w JOIN nxt ON nxt.doc_id = w.doc_id AND nxt.r = w.r WHERE nxt.n IS NOT NULL)
SELECT s.doc_id, s.start, s.stop AS "end", s.name AS rule, s.span FROM s JOIN walk USING (doc_id, r)
""")
def protected_overlaps(spark, d):
    """All rules at once over texts in which rules overlap: positions, elimination, names."""
    pick = lambda k: F.element_at(F.array(*map(F.lit, _SAMPLES)), (F.col("doc_id") * k % len(_SAMPLES) + 1).cast("int"))
    made = _t(spark, d, "documents").select("doc_id", F.concat_ws(" ", *[pick(k) for k in _PICKS]).alias("text"))
    return P.protected_spans(made, ["doc_id"])


@register()
def protected_union_relational(spark, d):
    """All protection rules with overlap elimination over whole texts, without a Python worker."""
    spans = P.protected_spans(spread(_t(spark, d, "documents").select("doc_id", "text")), ["doc_id"])
    return spans.groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def _edits(spark, d):
    words = P.match_positions(_t(spark, d, "documents"), ["doc_id"], F.col("text"), "[A-Za-z]{6,}")
    return words.select("doc_id", "pos", "start", "end", F.concat(F.lit("<"), "span", F.lit(">")).alias("text"))


@register("SELECT doc_id, md5(regexp_replace(text, '[A-Za-z]{6,}', '<\\0>', 'g')) AS text, len(regexp_extract_all(text, '[A-Za-z]{6,}'))::INTEGER AS edits FROM documents")
def splice_words(spark, d):
    """Every long word of every document replaced at its place."""
    made = P.splice(_t(spark, d, "documents"), _edits(spark, d), ["doc_id"])
    return made.select("doc_id", F.md5("text").alias("text"), "edits")


@register("""
WITH m AS (SELECT doc_id, list_transform(string_split_regex(text, '[A-Za-z]{6,}'), lambda x: len(x)) AS g, list_transform(regexp_extract_all(text, '[A-Za-z]{6,}'), lambda x: len(x)) AS m FROM documents),
e AS (SELECT doc_id, unnest(g[:len(m)]) AS gap, unnest(m) AS n, unnest(range(1, len(m) + 1)) AS pos FROM m),
p AS (SELECT doc_id, pos, n, sum(gap + n) OVER (PARTITION BY doc_id ORDER BY pos) AS stop FROM e)
SELECT doc_id, count(*) AS edits, sum(stop - n)::BIGINT AS starts, sum(stop - n + 2 * (pos - 1))::BIGINT AS new_starts, sum(stop + 2 * pos)::BIGINT AS new_ends FROM p GROUP BY 1
""")
def splice_places(spark, d):
    """Where the replacements of each document stand afterwards: offsets moved by the growth of those before."""
    e = P.new_places(_edits(spark, d), ["doc_id"])
    return e.groupBy("doc_id").agg(F.count("*").alias("edits"), F.sum("start").alias("starts"), F.sum("new_start").alias("new_starts"), F.sum("new_end").alias("new_ends"))


# ---- tags

_TAGS = ("<g1>", "</g1>", "<x2/>", "<g3>", "</g3>", "word", "<g4/>", " ")
_STEPS = (1, 3, 5, 7, 11, 13)


def _tagged(masked=False):
    pick = lambda k: F.element_at(F.array(*map(F.lit, _TAGS)), (F.floor(F.col("doc_id") / k) % len(_TAGS) + 1).cast("int"))
    made = F.concat(F.when(F.col("doc_id") % 3 == 0, "<g1><x2/><g3></g3></g1>").otherwise(""), *[pick(k) for k in _STEPS])
    return F.when(F.col("doc_id") % 7 == 0, "<g3><g1>a</g1>b</g3> <x2/>").otherwise(made)


_TAGGED_SQL = f"""CASE WHEN doc_id % 7 = 0 THEN '<g3><g1>a</g1>b</g3> <x2/>' ELSE CASE WHEN doc_id % 3 = 0 THEN '<g1><x2/><g3></g3></g1>' ELSE '' END
  || {' || '.join(f"([{', '.join(repr(t) for t in _TAGS)}])[(doc_id // {k}) % {len(_TAGS)} + 1]" for k in _STEPS)} END"""


@register(rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all({_TAGGED_SQL}, '</?[gx]\d+\s*/?>') AS ts FROM documents),
counts AS (
  SELECT doc_id, w.tag, len(list_filter(ts, lambda x: x = w.tag)) - w.n AS more
  FROM t, (VALUES ('</g1>', 1), ('</g3>', 1), ('<g1>', 1), ('<g3>', 1), ('<x2/>', 1), ('<g4/>', 0)) AS w(tag, n)
), walk(doc_id, i, stack, bad) AS (
  SELECT doc_id, 0, []::VARCHAR[], NULL::VARCHAR FROM t
  UNION ALL
  SELECT w.doc_id, w.i + 1,
    CASE WHEN ts[w.i + 1] LIKE '<g%' AND ts[w.i + 1] NOT LIKE '%/>' THEN list_append(stack, regexp_extract(ts[w.i + 1], '\d+')) WHEN ts[w.i + 1] LIKE '</g%' THEN stack[:-2] ELSE stack END,
    CASE WHEN ts[w.i + 1] LIKE '</g%' AND (len(stack) = 0 OR stack[-1] <> regexp_extract(ts[w.i + 1], '\d+')) THEN regexp_extract(ts[w.i + 1], '\d+') END
  FROM walk w JOIN t USING (doc_id) WHERE w.i < len(ts) AND w.bad IS NULL
)
SELECT t.doc_id, (SELECT count(*) FROM counts c WHERE c.doc_id = t.doc_id AND more > 0) AS surplus, (SELECT count(*) FROM counts c WHERE c.doc_id = t.doc_id AND more < 0) AS lacking,
  (SELECT max(bad) FROM walk w WHERE w.doc_id = t.doc_id) AS misplaced
FROM t
""")
def tag_verdicts(spark, d):
    """Tag checks of made translations: surplus, missing and misplaced tags, by folds with a stack."""
    from ..functions import tags

    said = tags.tag_faults(F.array(F.lit(2)), F.array(F.lit(1), F.lit(3)), _tagged())
    rows = _t(spark, d, "documents").select("doc_id", said.alias("said"))
    like = lambda p: F.size(F.filter("said", lambda s: s.rlike(p))).cast("long")
    ends = F.filter("said", lambda s: s.rlike("ends what"))
    return rows.select("doc_id", like("too many$").alias("surplus"), like("not there$").alias("lacking"), F.regexp_extract(F.get(ends, F.lit(0)), r"(\d+)", 1).alias("misplaced"))


# ---- runs of rows

_LINE = "len % 5 <> 0"


@register(r"""
WITH l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line, unnest(list_transform(ls, lambda x: len(x))) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
c AS (SELECT doc_id, line, n % 3 AS col, CASE WHEN n % 4 = 0 THEN '#' ELSE '//' END AS marker, n % 7 <> 0 AS own_line, n % 11 = 0 AS alone FROM l WHERE n % 5 <> 0),
b AS (
  SELECT *, CASE WHEN line = lag(line) OVER w + 1 AND col = lag(col) OVER w AND marker = lag(marker) OVER w AND lag(own_line) OVER w AND NOT alone AND NOT lag(alone) OVER w THEN 0 ELSE 1 END AS new
  FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY line)
), g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line) AS grp FROM b)
SELECT doc_id, min(line)::INTEGER AS first_line, max(line)::INTEGER AS last_line, count(*) AS comments FROM g GROUP BY doc_id, grp
""")
def comment_groups(spark, d):
    """Line comments, made of the lengths of lines, grouped where they follow each other with one marker at one column."""
    from ..operators import islands as I

    lines = _t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "body")).select("doc_id", (F.col("at") + 1).alias("line"), F.length("body").alias("n")).where("n % 5 <> 0")
    made = lines.select(
        "doc_id", "line", (F.col("n") % 3).alias("column"), F.when(F.col("n") % 4 == 0, "#").otherwise("//").alias("marker"), (F.col("n") % 7 != 0).alias("own_line"), (F.col("n") % 11 == 0).alias("standalone"),
    )
    groups = I.comment_groups(made, ["doc_id"])
    return groups.groupBy("doc_id", "island").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count("*").alias("comments")).drop("island")


@register("""
WITH b AS (SELECT user_id, ts, event_id, CASE WHEN ts > lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM b)
SELECT user_id, count(*) AS events, min(event_id) AS low, max(event_id) AS high FROM g GROUP BY user_id, grp
""")
def user_sessions(spark, d):
    """Events of a user within six hours of each other."""
    from ..operators import islands as I

    s = I.sessions(_t(spark, d, "events").select("user_id", "ts", "event_id"), ["user_id"], "ts", 6 * 3600)
    return s.groupBy("user_id", "island").agg(F.count("*").alias("events"), F.min("event_id").alias("low"), F.max("event_id").alias("high")).drop("island")


# ---- table functions

_PACK_SQL = """
WITH RECURSIVE r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, length(text) AS n FROM conversations),
p AS (
  SELECT conv_id, i, n, 0 AS batch, 1 AS items, n AS chars FROM r WHERE i = 1
  UNION ALL
  SELECT r.conv_id, r.i, r.n, CASE WHEN p.items >= 2 OR p.chars + r.n > 300 THEN p.batch + 1 ELSE p.batch END,
    CASE WHEN p.items >= 2 OR p.chars + r.n > 300 THEN 1 ELSE p.items + 1 END, CASE WHEN p.items >= 2 OR p.chars + r.n > 300 THEN r.n ELSE p.chars + r.n END
  FROM p JOIN r ON r.conv_id = p.conv_id AND r.i = p.i + 1
)
SELECT conv_id, batch, count(*) AS items, sum(n)::BIGINT AS chars FROM p GROUP BY 1, 2
"""


@register(_PACK_SQL)
def batches_in_sql(spark, d):
    """Batches by a table function over a partitioned and ordered table."""
    from ..functions import table_functions

    table_functions.register(spark)
    _t(spark, d, "conversations").selectExpr("conv_id", "turn", "CAST(length(text) AS BIGINT) AS n").createOrReplaceTempView("foliowright_turns")
    return spark.sql("SELECT conv_id, batch, count(*) AS items, sum(n) AS chars FROM pack_batches(TABLE(foliowright_turns) PARTITION BY conv_id ORDER BY (turn), 'n', 2, 300) GROUP BY conv_id, batch")


@register("""
WITH r AS (SELECT user_id, event_type, ts, event_id, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS run FROM r)
SELECT user_id, run::BIGINT AS run, event_type, count(*) AS events FROM g GROUP BY user_id, run, event_type
""")
def runs_in_sql(spark, d):
    """Runs of one event type of a user, by a table function."""
    from ..functions import table_functions

    table_functions.register(spark)
    _t(spark, d, "events").select("user_id", "ts", "event_id", "event_type").createOrReplaceTempView("foliowright_events")
    return spark.sql("SELECT user_id, run, event_type, count(*) AS events FROM number_runs(TABLE(foliowright_events) PARTITION BY user_id ORDER BY (ts, event_id), 'event_type') GROUP BY user_id, run, event_type")


@register("""
WITH a AS (SELECT conv_id, role || turn % 3 AS block, row_number() OVER (PARTITION BY conv_id, role || turn % 3 ORDER BY turn) AS k, turn FROM conversations),
b AS (SELECT conv_id, role || turn % 2 AS block, row_number() OVER (PARTITION BY conv_id, role || turn % 2 ORDER BY turn) AS k, turn FROM conversations)
SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, count(*) FILTER (b.k IS NULL) AS lost, count(*) FILTER (a.k IS NULL) AS added
FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.block = b.block AND a.k = b.k GROUP BY 1 HAVING count(*) FILTER (b.k IS NULL OR a.k IS NULL) > 0
""")
def block_changes_in_sql(spark, d):
    """Blocks of two sides of a conversation that have no match on the other one, by a table function."""
    from ..functions import table_functions

    table_functions.register(spark)
    c = _t(spark, d, "conversations")
    side = lambda s, n: c.select("conv_id", "turn", F.lit(s).alias("side"), F.concat("role", (F.col("turn") % n).cast("string")).alias("block"))
    side("a", 3).union(side("b", 2)).createOrReplaceTempView("foliowright_blocks")
    found = "differing_blocks_of(TABLE(foliowright_blocks) PARTITION BY conv_id ORDER BY (turn, side), 'block', 'conv_id')"
    return spark.sql(f"SELECT conv_id, count_if(kind = 'lost') AS lost, count_if(kind = 'added') AS added FROM {found} GROUP BY conv_id")


# ---- deterministic metrics


@register("""
SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 3 ELSE 1 + (doc_id % 2 = 0)::INT END AS keep_missing, (doc_id % 11 <> 0 AND doc_id % 2 = 1)::BIGINT AS translate_left,
  (doc_id % 11 = 0 OR doc_id % 4 = 0 OR doc_id % 3 = 0)::BIGINT AS structure_broken, (doc_id % 11 <> 0 AND doc_id % 3 = 0)::BIGINT AS code_changed, (doc_id % 11 <> 0 AND doc_id % 5 = 0)::BIGINT AS links_broken,
  (doc_id % 11 <> 0 AND doc_id % 2 = 1)::BIGINT AS english_left, (doc_id % 13 = 0)::BIGINT AS errors, doc_id % 7 AS reverted, doc_id % 6 AS kept_source, doc_id % 8 AS nmt,
  CASE WHEN doc_id % 11 <> 0 AND doc_id % 2 = 1 THEN 1 END AS prose
FROM documents
""")
def run_metrics(spark, d):
    """All deterministic counts of a run at once, over made translations of every document that differ in known ways."""
    from ..operators import scoring

    i, s = F.col("doc_id"), F.col("doc_id").cast("string")
    on = lambda n, a, b: F.when(i % n == 0, a).otherwise(b)
    text = lambda mark, link, x, words: F.concat(F.lit(mark), s, F.lit("\n\nSee [x](#"), link, F.lit(") and [y](#100%).\n\n```js\nx = "), x, F.lit(";\n```\n\n"), words, F.lit("\n"))
    own, english = F.concat(F.lit("title-"), s), F.lit("These english words stay here.")
    source = text("# Title ", own, F.lit("1"), english)
    made = F.when(i % 4 == 0, text("## Title ", on(5, F.lit("gone+here"), own), on(3, F.lit("2"), F.lit("1")), on(2, F.lit("Diese sind deutsch geworden."), english)))
    made = made.otherwise(text("# Title ", on(5, F.lit("gone+here"), own), on(3, F.lit("2"), F.lit("1")), on(2, F.lit("Diese sind deutsch geworden."), english)))
    runs = _t(spark, d, "documents").select(
        "doc_id", s.alias("doc"), source.alias("source"), F.when(i % 11 != 0, made).alias("text"), (i % 7).alias("reverted"), (i % 6).alias("kept_source"), (i % 8).alias("nmt"), F.when(i % 13 == 0, "failed").alias("error"),
    )
    expected = _t(spark, d, "documents").select(s.alias("doc"), F.array(F.concat(F.lit("# Title "), s), F.lit("absent"), F.lit("words stay")).alias("keep"), F.array(F.lit("english words")).alias("translate"))
    m = scoring.run_metrics(runs, ["doc_id", "doc"], expected)
    return m.select("doc_id", *scoring.COUNTS, F.col("english_by_kind")["prose"].cast("int").alias("prose"))


@register("""
SELECT doc_id, (4 + (doc_id % 3 = 0)::INT)::BIGINT AS targets, (1 + (doc_id % 2 = 1)::INT + (doc_id % 3 = 0)::INT)::BIGINT AS broken FROM documents
""")
def malformed_links(spark, d):
    """Targets with per-cent signs that are no escapes, plus signs, escapes, and links in code."""
    from ..operators import scoring

    i = F.col("doc_id")
    text = F.concat(
        F.lit("# Über a+b\n\n[p](#100%) [q](#a+b) [r](#%C3%BCber-ab)\n\n```\n[no](#nowhere)\n```\n\n`[no](#nowhere)` <i id='a+b'></i>\n"),
        F.when(i % 2 == 0, "<a href='#m'>m</a> {#m}\n").otherwise("<a href='#m'>m</a>\n"), F.when(i % 3 == 0, "[s](#%zz)\n").otherwise(""),
    )
    return scoring.broken_links(_t(spark, d, "documents").select("doc_id", text.alias("text")), ["doc_id"])


# ---- dependents, calls, the store


def _nested(spark, d):
    i = F.col("doc_id")
    parent = F.when(i % 100 == 50, i + 1).when(i % 100 == 51, i - 1).when(i >= 6, F.floor(i / 6))
    return _t(spark, d, "documents").select(F.lit("d").alias("doc"), i.alias("id"), parent.cast("long").alias("parent"))


_NESTED_SQL = """
WITH RECURSIVE s AS (SELECT doc_id AS id, CASE WHEN doc_id % 100 = 50 THEN doc_id + 1 WHEN doc_id % 100 = 51 THEN doc_id - 1 WHEN doc_id >= 6 THEN doc_id // 6 END AS parent FROM documents),
up(id, anc, d) AS (SELECT id, id, 0 FROM s UNION ALL SELECT u.id, s.parent, u.d + 1 FROM up u JOIN s ON s.id = u.anc WHERE s.parent IS NOT NULL AND u.d < 12)
"""


@register(_NESTED_SQL + """
SELECT s.id, CASE WHEN max(d) < 12 THEN max(d) END::INTEGER AS level, max(d) >= 12 AS cyclic FROM up JOIN s ON s.id = up.anc GROUP BY s.id
""")
def render_levels(spark, d):
    """Levels of nested segments, with segments that hold each other; documents stand for segments."""
    from ..operators import dependents

    return dependents.levels(_nested(spark, d), ["doc"]).select("id", "level", "cyclic")


@register(_NESTED_SQL + """
SELECT s.id, CASE WHEN max(d) < 12 THEN sum(len(up.id::VARCHAR) + 2) ELSE max(len(s.id::VARCHAR)) + 2 + coalesce(max(k.marks), 0) END::INTEGER AS chars, max(d) >= 12 AS failed
FROM up JOIN s ON s.id = up.anc LEFT JOIN (SELECT parent, sum(len(id::VARCHAR) + 4) AS marks FROM s GROUP BY 1) k ON k.parent = s.id GROUP BY s.id
""")
def render_nested(spark, d):
    """Every segment with all that it holds, rendered level by level."""
    from ..operators import dependents

    rows = _nested(spark, d)
    marks = rows.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("{{"), F.col("id").cast("string"), F.lit("}}")))), "").alias("marks"))
    rows = rows.join(marks, "id", "left").withColumn("text", F.concat(F.lit("("), F.col("id").cast("string"), F.coalesce("marks", F.lit("")), F.lit(")")))
    made = dependents.render(rows, ["doc"])
    return made.select(F.col("id").cast("long").alias("id"), F.length("text").alias("chars"), F.col("error").isNotNull().alias("failed"))


@register("""
WITH c AS (SELECT doc_id, doc_id % 9 AS bad, CASE WHEN doc_id % 9 < 4 THEN doc_id % 9 + 1 WHEN doc_id % 2 = 1 THEN 1 ELSE 5 END AS attempts FROM documents)
SELECT doc_id, attempts::INTEGER AS attempts, ((attempts - 1) * (doc_id % 3 + 0.5))::DOUBLE AS waited,
  CASE WHEN bad >= 4 THEN NULL ELSE 'answer ' || doc_id END AS answer, CASE WHEN bad >= 4 AND doc_id % 2 = 1 THEN 'status 400' WHEN bad >= 4 THEN 'status 503' END AS error
FROM c
""")
def service_calls(spark, d):
    """Calls of a service that refuses some requests several times and some for good, in a dry run: attempts, waits and answers."""
    from ..operators import calls

    rows = _t(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("request"))
    made = calls.called(rows, "doc_id", "request", RefusingService, calls.Policy(attempts=5, unit=0.0))
    return made.select("doc_id", "attempts", "waited", "answer", "error")


class RefusingService:
    """Answers a request after number % 9 refusals that ask for a wait; from 4 on it never does, an odd number at once for good."""

    def __init__(self):
        self.asked: dict[int, int] = {}

    def __call__(self, request: str) -> str:
        from ..operators.calls import Refused

        n = int(request)
        self.asked[n] = self.asked.get(n, 0) + 1
        if n % 9 >= 4:
            raise Refused(503 if n % 2 == 0 else 400, n % 3 + 0.5)
        if self.asked[n] <= n % 9:
            raise Refused(429, n % 3 + 0.5)
        return f"answer {n}"


@register("""
SELECT 1 AS run, count(*) AS computed, count(*) AS stored FROM documents UNION ALL SELECT 2, 0, count(*) FROM documents
UNION ALL SELECT 3, count(*) FILTER (doc_id % 10 = 0), count(*) + count(*) FILTER (doc_id % 10 = 0) FROM documents
""")
def incremental_runs(spark, d):
    """A store of results by document and fingerprint: a first run, the same again, and one after a tenth of the texts changed."""
    import uuid

    from ..operators.islands import shared_dir
    from ..sources.store import RunStore

    store = RunStore(spark, f"{shared_dir(spark)}/foliowright/store-{uuid.uuid4().hex}", ["doc_id", "fingerprint"], 16)
    docs = _t(spark, d, "documents").select("doc_id", "text")
    changed = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text")))
    out = []
    for run, texts in enumerate((docs, docs, changed), 1):
        wanted = texts.withColumn("fingerprint", F.sha2(F.coalesce("text", F.lit("")), 256))
        store.run(wanted, lambda todo, run=run: todo.select("doc_id", "fingerprint", F.lit(run).alias("run"), F.length("text").alias("chars")))
        out.append(store.read().agg(F.lit(run).alias("run"), F.count_if(F.col("run") == run).alias("computed"), F.count("*").alias("stored")))
    return out[0].union(out[1]).union(out[2])
