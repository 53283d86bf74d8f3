"""Quality rules as weak supervision.

Each rule votes good (2), bad (0) or abstains (1) on a whole text; one that can't judge a text's script does not
apply (3). Rules that read one figure are one voter. Expectation-maximisation on the counts of vote patterns of the
whole corpus estimates, without any label, how often every voter votes which way on good and on bad documents and
the share of good ones. A voter that stays silent says something too, one that does not apply nothing. A document is
kept by its posterior probability.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CONTINUATION, load, map_texts, materialize

# The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
KEEP_AT = 0.5
STRETCH = 1000  # words over which distinct ones are counted
#: Rules: name, figure, lowest, highest, vote inside that range (2 good, 0 bad); outside it a rule abstains.
#: The figures are shares of words, lines or characters.
RULES = (
    ("symbols", "symbol_share", 0.05, 1e9, 0),
    ("marks", "mark_share", 0.10, 1e9, 0),
    ("repeat_windows", "repeat_share", 0.30, 1e9, 0),
    ("duplicate_lines", "dup_share", 0.30, 1e9, 0),
    ("shouting", "upper_share", 0.40, 1e9, 0),
    ("few_distinct", "same_share", 0.80, 1e9, 0),
    ("punctuated", "mark_share", 0.005, 0.07, 2),
    ("sentence_case", "upper_share", 0.002, 0.15, 2),
)
#: Figures that mean something only where at least half of a text's characters are ASCII ones.
ASCII_FIGURES = frozenset({"mark_share", "upper_share"})
#: Rules (by number) of each voter.
VOTERS = tuple(tuple(i for i, r in enumerate(RULES) if r[1] == f) for f in dict.fromkeys(r[1] for r in RULES))
#: What is believed of a voter before the corpus is seen: how often it votes bad, abstains and votes good on a good
#: and on a bad text, for voters that only vote against and for those that vote both ways. The beliefs and the share
#: of good texts weigh as much as BELIEVED texts, whatever the size of the corpus: a large corpus overrules them.
BELIEF = {False: ((0.05, 0.95, 0.0), (0.30, 0.70, 0.0)), True: ((0.05, 0.25, 0.70), (0.30, 0.20, 0.50))}
GOOD_SHARE = 0.7
BELIEVED = 100
COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"

_ASCII_OR_CONTINUATION = bytes(range(0xC0))
_UPPER = bytes(range(65, 91))
_NOT_MARK = bytes(b for b in range(256) if not (33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126))


def repeated_words(ws: list[bytes]) -> int:
    """Words inside a three-word window that the text holds at least twice."""
    windows = list(zip(ws, islice(ws, 1, None), islice(ws, 2, None), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen: set = set()
    twice = {w for w in windows if w in seen or seen.add(w)}
    n, end = 0, 0
    for i, w in enumerate(windows):
        if w in twice:
            n += i + 3 - max(i, end)
            end = i + 3
    return n


def same_share(ws: list[bytes]) -> float:
    """Share of words that repeat an earlier one: of the whole text, or the mean over stretches of STRETCH words.

    A longer text's stretches are as few as cover it, evenly spread, so that its length alone does not
    move the figure and one word more than STRETCH hardly does.
    """
    n = len(ws)
    if n <= STRETCH:
        return 1 - len(set(ws)) / n if n else 1.0
    k = -(-n // STRETCH)
    starts = [i * (n - STRETCH) // (k - 1) for i in range(k)]
    return 1 - sum(len(set(ws[a : a + STRETCH])) for a in starts) / (k * STRETCH)


def counts(raw: bytes | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, upper letters, marks, share of repeated words, other than ASCII)."""
    raw = raw or b""
    ws = raw.split()
    joined = b"".join(ws)
    chars = len(joined.translate(None, CONTINUATION))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return (
        len(ws),
        chars,
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(ws),
        len(joined) - len(joined.translate(None, _UPPER)),
        len(joined.translate(None, _NOT_MARK)),
        same_share(ws),
        len(joined.translate(None, _ASCII_OR_CONTINUATION)),
    )


def votes() -> F.Column:
    """The pattern of votes as a string of one digit a rule: 0 bad, 1 abstains, 2 good, 3 does not apply."""
    words = F.greatest("n_words", F.lit(1))
    chars = F.greatest("word_chars", F.lit(1))
    figures = {
        "symbol_share": F.col("n_symbols") / chars,
        "repeat_share": F.col("n_repeat_words") / words,
        "dup_share": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "upper_share": F.col("n_upper") / chars,
        "same_share": F.col("same_share"),
        "mark_share": F.col("n_marks") / chars,
    }
    foreign = 2 * F.col("n_wide") > F.col("word_chars")
    vote = lambda f, lo, hi, v: F.when((figures[f] >= lo) & (figures[f] <= hi), str(v)).otherwise("1")
    return F.concat(*[F.when(foreign, "3").otherwise(vote(f, lo, hi, v)) if f in ASCII_FIGURES else vote(f, lo, hi, v) for _, f, lo, hi, v in RULES])


class VoteModel:
    """How every voter votes on good and on bad documents, by expectation-maximisation over pattern counts.

    Documents are a mixture of two classes inside which voters are independent. The estimates are those of the largest
    posterior under BELIEF; nothing is clipped. ``good`` and ``bad`` hold how often each rule casts its vote where it
    applies, ``prior`` the share of good documents.
    """

    def __init__(self, patterns: dict[str, int], rounds: int = 5000):
        keys = sorted(patterns)
        both_ways = [any(RULES[i][4] for i in v) for v in VOTERS]
        start = np.array([[BELIEF[b][side] for b in both_ways] for side in (0, 1)])  # good or bad, voter, outcome
        self.p, self.prior = start.copy(), GOOD_SHARE
        if keys:
            cast = self._cast(keys)
            w = np.array([patterns[k] for k in keys], float)
        for _ in range(rounds if keys else 0):
            q = self._posterior(cast)
            sides = np.stack([w * q, w * (1 - q)])
            seen = np.einsum("sk,kvo->svo", sides, cast)
            p = (seen + BELIEVED * start) / (seen.sum(axis=2, keepdims=True) + BELIEVED)
            prior = (sides[0].sum() + BELIEVED * GOOD_SHARE) / (w.sum() + BELIEVED)
            moved = max(np.abs(p - self.p).max(), abs(prior - self.prior))
            self.p, self.prior = p, prior
            if moved < 1e-10:
                break
        self.good, self.bad = (np.array([self.p[s][next(v for v, own in enumerate(VOTERS) if i in own)][r[4]] for i, r in enumerate(RULES)]) for s in (0, 1))

    @staticmethod
    def _cast(keys) -> np.ndarray:
        """1 at the outcome of each voter (pattern, voter, outcome); all 0 where it does not apply."""
        out = np.zeros((len(keys), len(VOTERS), 3))
        for k, key in enumerate(keys):
            for v, own in enumerate(VOTERS):
                said = {key[i] for i in own}
                if "3" not in said:
                    out[k, v, 0 if "0" in said else 2 if "2" in said else 1] = 1
        return out

    def _posterior(self, cast: np.ndarray) -> np.ndarray:
        good, bad = np.log(np.maximum(self.p, 1e-300))
        odds = np.log(self.prior / (1 - self.prior)) + np.einsum("kvo,vo->k", cast, good - bad)
        return 1 / (1 + np.exp(-odds))

    def table(self, patterns) -> dict[str, float]:
        keys = sorted(patterns)
        return dict(zip(keys, self._posterior(self._cast(keys)).tolist(), strict=True)) if keys else {}

    def rates(self) -> dict[str, tuple[float, float]]:
        """Rule: how often it votes on good and on bad documents."""
        return {name: (float(g), float(b)) for (name, *_), g, b in zip(RULES, self.good, self.bad, strict=True)}


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """doc_id, the counts, base_failed, votes, posterior and kept for every row.

    A null or empty text has zero counts, so base_failed and not kept; texts of any length are read whole.
    Repeated rows each give a row with the same verdict, an empty table no rows; the id, null or not, is
    carried, and no other column is read. A posterior of just ``keep_at`` is kept. The counts (no text) are
    written once; at most 3 ** rules pattern counts reach the driver and the posterior table of the
    patterns, bounded alike, goes back as a literal map.
    """

    def run(texts):
        rows = [(*counts(t), len([x for x in (t or b"").split(b"\n") if x and not x.isspace()])) for t in texts]
        return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(10)]

    fields = f"{COUNTS}, n_upper bigint, n_marks bigint, same_share double, n_wide bigint, n_lines bigint"
    made = map_texts(docs, {"doc_id": F.col(doc_id)}, fields, run, text).withColumn("votes", votes())
    made = materialize(made, "quality-rules")
    patterns = {r["votes"]: r["count"] for r in made.groupBy("votes").count().collect()}
    model = VoteModel(patterns)
    table = model.table(patterns) or {"": 0.0}
    posterior = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col("votes")]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return made.withColumn("base_failed", failed).withColumn("posterior", posterior).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep_at))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = quality_rules(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
