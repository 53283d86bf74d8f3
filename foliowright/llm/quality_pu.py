"""Quality classifier by positive-unlabelled learning.

A small network on counts of byte classes, their pairs and repetition figures of the whole
text is trained to minimise the non-negative unbiased risk
pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))  with the logistic loss: trusted positives are documents
labelled 1 in the learning folds, unlabelled text is any document of those folds whatever its label.
The class prior pi is estimated from scores of held-back positives and unlabelled documents alone; a
document labelled 0 is nothing but unlabelled text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, load, map_texts

POSITIVES = 3000  # bound: trusted positives that are learned from
UNLABELLED = 6000  # bound: unlabelled documents that are learned from
THRESHOLD = 0.3
HIDDEN = 16
STEPS = 1500

# Byte classes: lower, upper, digit, space, line end, other control, continuation, lead bytes, and each
# ASCII punctuation mark by itself.
_CLASS = np.zeros(256, np.int64)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 0 if "a" <= _c <= "z" else 1 if "A" <= _c <= "Z" else 2 if "0" <= _c <= "9" else 3 if _c == " " else 4 if _c == "\n" else 5 if _b < 32 or _b == 127 else 6 if 128 <= _b < 192 else 7 if _b >= 192 else 8
_MARKS = [b for b in range(33, 127) if _CLASS[b] == 8]
for _i, _b in enumerate(_MARKS):
    _CLASS[_b] = 8 + _i
CLASSES = 8 + len(_MARKS)
#: Coarse classes for pairs: all marks are one.
_COARSE = np.minimum(_CLASS, 8)
SHARES = CLASSES + 81
WIDTH = SHARES + 8


def features(raw: bytes | None) -> np.ndarray:
    """WIDTH figures of a whole text; an empty text has zeros and an indicator."""
    out = np.zeros(WIDTH, np.float32)
    if not raw:
        out[-1] = 1
        return out
    b = np.frombuffer(raw, np.uint8)
    n = len(b)
    single = np.bincount(b, minlength=256)
    out[:CLASSES] = np.bincount(_CLASS, weights=single, minlength=CLASSES) / n
    if n > 1:
        c = _COARSE.astype(np.uint8)[b]
        pair = c[:-1] * np.uint8(9) + c[1:]
        out[CLASSES:SHARES] = np.bincount(pair, minlength=81) / (n - 1)
    ws = raw.split()
    k = max(1, len(ws))
    distinct = set(ws)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    same = sum(a == z for a, z in zip(ws, ws[1:], strict=False))
    pairs = list(zip(ws, ws[1:], strict=False))
    out[SHARES:] = (
        len(distinct) / k,
        same / k,
        1 - len(set(lines)) / max(1, len(lines)),
        1 - len(set(pairs)) / max(1, len(pairs)),
        min(20.0, n / k) / 20,
        np.log1p(len(ws)) / 10,
        min(1.0, len(ws) / 50),
        0.0,
    )
    return out


def feature_matrix(texts: list[bytes | None]) -> np.ndarray:
    x = np.stack([features(t) for t in texts]) if texts else np.zeros((0, WIDTH), np.float32)
    x[:, :SHARES] = np.sqrt(x[:, :SHARES])  # rare marks count too
    return x


class PUNetwork:
    def __init__(self, prior: float, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.prior = prior
        self.mean, self.scale = np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32)
        self.p = {"A": (rng.standard_normal((WIDTH, HIDDEN)) / np.sqrt(WIDTH)).astype(np.float32), "a": np.zeros(HIDDEN, np.float32), "w": (rng.standard_normal(HIDDEN) / 4).astype(np.float32), "b": np.full(1, np.log(prior / (1 - prior)), np.float32)}

    def _forward(self, x):
        h = np.maximum(0, x @ self.p["A"] + self.p["a"])
        return h, h @ self.p["w"] + self.p["b"][0]

    def _gradient(self, x, h, dg):
        dh = np.outer(dg, self.p["w"]) * (h > 0)
        return {"A": x.T @ dh, "a": dh.sum(0), "w": h.T @ dg, "b": dg.sum(keepdims=True)}

    def fit(self, pos: np.ndarray, unl: np.ndarray, steps: int = STEPS, batch: int = 256, rate: float = 0.003, decay: float = 1e-3, seed: int = 5):
        both = np.concatenate([pos, unl])
        self.mean, self.scale = both.mean(0), both.std(0) + 0.02
        pos, unl = (pos - self.mean) / self.scale, (unl - self.mean) / self.scale
        rng, pi = np.random.default_rng(seed), self.prior
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        sig = lambda g: 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        for s in range(1, steps + 1):
            xp, xu = pos[rng.integers(0, len(pos), batch)], unl[rng.integers(0, len(unl), 2 * batch)]
            (hp, gp), (hu, gu) = self._forward(xp), self._forward(xu)
            negative = np.logaddexp(0, gu).mean() - pi * np.logaddexp(0, gp).mean()
            dp_plus, dp_minus, du_minus = -sig(-gp) / len(gp), sig(gp) / len(gp), sig(gu) / len(gu)
            if negative >= 0:  # pi R_p(+) + R_u(-) - pi R_p(-)
                grad = [self._gradient(xp, hp, pi * (dp_plus - dp_minus)), self._gradient(xu, hu, du_minus)]
            else:  # the estimate fell below zero: step back from what was overfitted
                grad = [self._gradient(xp, hp, pi * dp_minus), self._gradient(xu, hu, -du_minus)]
            lr = rate * min(1.0, 2.0 * (1 - s / (steps + 1)))
            for k in self.p:
                a = grad[0][k] + grad[1][k] + (decay * self.p[k] if k in "Aw" else 0)
                m[k] += 0.1 * (a - m[k])
                v[k] += 0.001 * (a * a - v[k])
                self.p[k] = (self.p[k] - lr * (m[k] / (1 - 0.9**s)) / (np.sqrt(v[k] / (1 - 0.999**s)) + 1e-7)).astype(np.float32)
        return self

    def score_rows(self, x: np.ndarray) -> np.ndarray:
        g = self._forward((x - self.mean) / self.scale)[1]
        return 1 / (1 + np.exp(-np.clip(g.astype(np.float64), -30, 30)))

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        return self.score_rows(feature_matrix(texts))


def class_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """The share of positives among the unlabelled, from scores of rows that no training saw.

    Above a threshold that few but positives reach, the unlabelled share is the prior times the positive
    share. The threshold with the least ratio of the two, each widened by its sampling error, is taken.
    The result is the ratio less two standard errors, in proportion: a prior that is too large lets the risk
    of the negatives vanish, one that is a little too small costs next to nothing.
    """
    at = np.unique(pos)
    above = lambda z: 1 - np.searchsorted(np.sort(z), at) / len(z)
    p, u = above(pos), above(unl)
    k = int(np.argmin((u + np.sqrt(1 / len(unl)) + np.sqrt(1 / len(pos))) / p))
    error = np.sqrt((1 - u[k]) / max(u[k] * len(unl), 1) + (1 - p[k]) / (p[k] * len(pos)))
    return float(np.clip(u[k] / p[k] / (1 + 2 * error), 0.01, 0.99))


def learn(pos: np.ndarray, unl: np.ndarray, steps: int = STEPS) -> PUNetwork:
    """Estimates the prior by a first network that sees half of the rows, then trains on all of them."""
    if min(len(pos), len(unl)) < 2:
        return PUNetwork(0.5).fit(pos, unl, steps) if len(pos) and len(unl) else PUNetwork(0.5)
    first = PUNetwork(0.5).fit(pos[::2], unl[::2], steps // 3)
    prior = class_prior(first.score_rows(pos[1::2]), first.score_rows(unl[1::2]))
    return PUNetwork(prior).fit(pos, unl, steps)


def train(docs: DataFrame, labels: DataFrame, learn_from, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> PUNetwork:
    """Fits on bounded samples (POSITIVES, UNLABELLED rows, drawn by hash) of the rows where ``learn_from`` holds.

    Only labels of 1 are read. Labels repeated for an id count once; ids of repeated rows are positives in
    each row. Without positives or rows the score is one half for all.
    """
    known = labels.where(learn_from & (F.col(quality) == 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("__id")).distinct()
    draw = F.pmod(F.xxhash64("__id", F.lit(29)), F.lit(1 << 30))
    picked = known.orderBy(draw, "__id").limit(POSITIVES)  # bounded by the limit
    rows = docs.where(learn_from).select(F.col(doc_id).alias("__id"), F.col(text).alias("text"))
    total = rows.count()
    drawn = draw < int(min(1.0, 1.1 * UNLABELLED / max(1, total)) * (1 << 30))
    # one scan yields both samples; at most POSITIVES ids are broadcast
    both = rows.join(F.broadcast(picked.withColumn("__p", F.lit(1))), "__id", "left").where(F.col("__p").isNotNull() | drawn)
    vectors = map_texts(both, {"p": F.coalesce("__p", F.lit(0)), "u": drawn, "k": draw}, "x binary", lambda ts: [[r.tobytes() for r in feature_matrix(ts)]])
    got = vectors.orderBy("k").limit(POSITIVES * 2 + UNLABELLED * 2).collect()
    pos = [np.frombuffer(r["x"], np.float32) for r in got if r["p"]]
    unl = [np.frombuffer(r["x"], np.float32) for r in got if r["u"]]
    stacked = lambda rows: np.stack(rows) if rows else np.zeros((0, WIDTH), np.float32)
    return learn(stacked(pos), stacked(unl))


def quality_scores(docs: DataFrame, model: PUNetwork, carry: dict | None = None, text: str = "text", threshold: float = THRESHOLD, raw: bool = False) -> DataFrame:
    """The carried columns with score (0 to 1) and predicted for every row; no shuffle.

    A null text is scored as an empty one, a long one by its whole text. Repeated rows get equal scores; an
    empty table gives no rows. A score of just the threshold is predicted 1. No other column is read.
    """

    def run(texts):
        s = model.scores(texts)
        return [s.tolist(), (s >= threshold).astype(int).tolist()]

    return map_texts(docs, carry or {"doc_id": F.col("doc_id")}, "score double, predicted int", run, text, raw)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    model = train(docs, labels, bucket_of("doc_id", 5) != 0)
    return quality_scores(docs, model, {"doc_id": F.col("doc_id"), "held_out": F.coalesce(bucket_of("doc_id", 5) == 0, F.lit(False))})
