"""Language ID with a bidirectional gated recurrent network over bytes.

The network reads windows of bytes forwards and backwards, labels every position with a softmax over
the languages, and a document's probabilities are the mean over all of its positions. It is trained
in numpy by backpropagation through time. Gates are piecewise-linear sigmoids and the candidate a
piecewise-linear tanh, which keeps a step to a few passes over contiguous arrays.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, load, map_texts, small_batches

WINDOW = 128  # bytes that the network reads at once
HIDDEN = 8
BLOCK = 1024  # windows side by side, each in both directions
TRAIN_DOCS = 1500  # bound: labelled documents a language
TRAIN_WINDOWS = 4  # bound: windows a training document
PASS_LANES = 1024  # windows of a step of the pass over all rows
PASS_RATE = 0.001
FLOOR = 0.75  # of the score that 999 in 1000 of them reach
STEPS = 450
BATCH = 128
PAD = 256  # symbol of positions behind a text's end
ZERO, QUARTER, ONE = np.float32(0), np.float32(0.25), np.float32(1)


class ByteGRU:
    """Weights of both directions: table (symbols x 3H, biases inside), recurrent (3H x H), output."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, h = labels, hidden
        self.h = h
        self.p = {}
        for d in "fb":
            self.p[f"E{d}"] = (rng.standard_normal((3 * h, PAD + 1)) * 0.5).astype(np.float32)
            self.p[f"U{d}"] = (rng.standard_normal((3 * h, h)) / np.sqrt(h)).astype(np.float32)
        self.p["W"] = (rng.standard_normal((len(labels), 2 * h)) * 0.3).astype(np.float32)
        self.p["c"] = np.zeros((len(labels), 1), np.float32)
        self.room: dict = {}

    def _room(self, name: str, *shape: int) -> np.ndarray:
        """An array to write to, the same one for the same name and shape: fresh memory for every block would cost more than its use."""
        if name not in self.room or self.room[name].shape != shape:
            self.room[name] = np.empty(shape, np.float32)
        return self.room[name]

    def __getstate__(self):
        return self.__dict__ | {"room": {}}

    def _states(self, x, keep: bool):
        """States (T, 2, N, H) of both directions for symbols x (T, N): [t, 0] of the forward one at t, [t, 1] of the backward one
        at T-1-t. With keep also what backpropagation needs: gates and candidate (T, 3, 2, N, H), the candidate's recurrent part
        (T, 2, N, H), and the rows of both directions' tables that were read (T, 2, N).

        A window's H numbers lie side by side, so a symbol's row of the table is copied at once. The gates' slope and
        offset lie in their weights."""
        h, (steps, n) = self.h, x.shape
        read = np.empty((steps, 2, n), np.intp)
        read[:, 0] = x
        np.add(x[::-1], PAD + 1, out=read[:, 1])
        table = np.stack([self.p["Ef"], self.p["Eb"]]).astype(np.float32).reshape(2, 3, h, PAD + 1).transpose(1, 0, 3, 2).reshape(3, 2 * (PAD + 1), h)
        u = np.stack([self.p["Uf"], self.p["Ub"]]).astype(np.float32).reshape(2, 3, h, h).transpose(1, 0, 3, 2).copy()
        table[:2] = table[:2] * QUARTER + np.float32(0.5)
        u[:2] *= QUARTER
        out = self._room("states", steps, 2, n, h)
        kept, parts = (self._room(f"{name}{keep}", steps if keep else 1, *k, 2, n, h) for name, k in (("kept", (3,)), ("parts", ())))
        state, gh = np.zeros((2, n, h), np.float32), np.empty((2, 2, n, h), np.float32)
        for t in range(steps):
            gx, part = kept[t if keep else 0], parts[t if keep else 0]
            for rows, to in zip(table, gx, strict=True):
                np.take(rows, read[t], axis=0, out=to, mode="clip")
            np.matmul(state, u[:2], out=gh)
            np.matmul(state, u[2], out=part)
            gate, cand = gx[:2], gx[2]
            gate += gh
            np.clip(gate, ZERO, ONE, out=gate)
            nxt = out[t]
            np.multiply(gate[1], part, out=nxt)
            cand += nxt
            np.clip(cand, -ONE, ONE, out=cand)
            np.subtract(state, cand, out=nxt)
            nxt *= gate[0]
            nxt += cand
            state = nxt
        return out, kept, parts, read

    def _probabilities(self, states, real=None):
        """Probabilities (T, languages, N) of every position, 0 where ``real`` (T, N) is 0."""
        w, (steps, _, n, h) = self.p["W"], states.shape
        logits, second = (self._room(name, steps, len(self.labels), n) for name in ("logits", "second"))
        np.matmul(w[:, :h], states[:, 0].transpose(0, 2, 1), out=logits)
        logits += np.matmul(w[:, h:], states[::-1, 1].transpose(0, 2, 1), out=second)
        logits += self.p["c"].astype(np.float32)
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        share = logits.sum(axis=1)
        np.divide(ONE if real is None else real, share, out=share)
        logits *= share[:, None, :]
        return logits

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (T, languages, N) of every position of the windows x (T, N)."""
        out = np.empty((len(x), len(self.labels), x.shape[1]), np.float32)
        for a in range(0, x.shape[1], BLOCK):
            out[:, :, a : a + BLOCK] = self._probabilities(self._states(x[:, a : a + BLOCK], False)[0])
        return out

    def loss_gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ask_loss: bool = True):
        """Mean cross entropy over positions that hold a byte (None if not asked for), and its gradient through time; ``weight`` of
        each window for the gradient.

        Both are sums over blocks of windows, so what is kept of the steps stays small."""
        real = (x < PAD).astype(np.float32)
        total = max(1.0, float(real.sum()))
        share = real * np.float32(1 / total) if weight is None else real * (weight / total).astype(np.float32)
        losses, g = [], {}
        for a in range(0, x.shape[1], BLOCK):
            part = slice(a, a + BLOCK)
            lost, more = self._block_gradient(x[:, part], y[part], real[:, part] if ask_loss else None, share[:, part])
            losses.append(lost)
            g = {k: g[k] + v for k, v in more.items()} if g else more
        return sum(losses) / total if ask_loss else None, g

    def _block_gradient(self, x, y, real, share):
        """Sum of the cross entropy where ``real`` is 1 (None without it), and the gradient of its sum by ``share``."""
        h, (steps, n) = self.h, x.shape
        states, kept, parts, read = self._states(x, True)
        dl = self._probabilities(states)
        lost = None if real is None else -float((np.log(np.maximum(dl[:, y, np.arange(n)], 1e-9)) * real).sum())
        dl -= y == np.arange(len(self.labels))[:, None]
        dl *= share[:, None, :]
        g = {"c": dl.sum(axis=(0, 2))[:, None]}
        g["W"] = np.concatenate([np.matmul(dl, s).sum(axis=0) for s in (states[:, 0], states[::-1, 1])], axis=1)
        w = [np.ascontiguousarray(self.p["W"][:, k * h : (k + 1) * h], np.float32) for k in (0, 1)]
        dl = dl.transpose(0, 2, 1)
        back = np.stack([self.p["Uf"], self.p["Ub"]]).astype(np.float32)
        back[:, : 2 * h] *= QUARTER
        gu = np.zeros((2, 3 * h, h), np.float32)
        # a step's slopes at the sums of: update gate, reset gate, candidate, the candidate's recurrent part
        slopes, through = np.empty((4, 2, n, h), np.float32), np.empty((2, n, 3 * h), np.float32)
        recurrent = np.arange(2 * n)[:, None] + 2 * n * np.array([0, 1, 3])
        # a symbol's slopes are added up two numbers at a time, as one complex number (an odd H as it is)
        pair = np.complex64 if h % 2 == 0 else np.float32
        ge = np.zeros((3, 2 * (PAD + 1) * h), np.float32)
        sums, added = ge.view(pair), slopes[:3].reshape(3, -1).view(pair)
        width = sums.shape[1] // (2 * (PAD + 1))
        places = np.arange(sums.shape[1]).reshape(-1, width)  # in the sums, by row of the tables
        to = np.empty((2 * n, width), np.intp)
        dh, carry, more, start = (np.zeros((2, n, h), np.float32) for _ in range(4))
        c, slope = (np.empty((2, 2, n, h), np.float32) for _ in range(2))
        update, reset, outer, inner = slopes
        for t in range(steps - 1, -1, -1):
            prev = states[t - 1] if t else start
            gate, cand = kept[t, :2], kept[t, 2]
            np.matmul(dl[t], w[0], out=dh[0])
            np.matmul(dl[steps - 1 - t], w[1], out=dh[1])
            dh += carry
            # a gate's slope is 1/4 (in the weights) strictly between 0 and 1, a candidate's 1 strictly between -1 and 1, else 0
            np.subtract(ONE, gate, out=c)
            np.multiply(gate, c, out=slope)
            np.ceil(slope, out=slope)
            np.multiply(dh, gate[0], out=carry)
            np.subtract(prev, cand, out=update)
            update *= dh
            update *= slope[0]
            np.abs(cand, out=outer)
            np.subtract(ONE, outer, out=outer)
            np.ceil(outer, out=outer)
            outer *= c[0]
            outer *= dh
            np.multiply(outer, gate[1], out=inner)
            np.multiply(outer, parts[t], out=reset)
            reset *= slope[1]
            np.take(slopes.reshape(-1, h), recurrent, axis=0, out=through.reshape(2 * n, 3, h), mode="clip")
            carry += np.matmul(through, back, out=more)
            gu += np.matmul(through.transpose(0, 2, 1), prev)
            np.take(places, read[t].ravel(), axis=0, out=to, mode="clip")
            for total, part in zip(sums, added, strict=True):
                np.add.at(total, to.ravel(), part)
        gu[:, : 2 * h] *= QUARTER
        ge[:2] *= QUARTER
        ge = ge.reshape(3, 2, PAD + 1, h).transpose(1, 0, 3, 2).reshape(2, 3 * h, PAD + 1)
        for k, d in enumerate("fb"):
            g[f"U{d}"] = gu[k]
            g[f"E{d}"] = ge[k]
        return lost, g

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = 0.02, seed: int = 11):
        """Adam on random batches of windows x (N, T) with labels y (N,)."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        by = [np.flatnonzero(y == c) for c in range(len(self.labels))]
        by = [b for b in by if len(b)]
        for s in range(1, steps + 1):
            pick = np.concatenate([rng.choice(b, max(1, batch // len(by))) for b in by])
            self._step(self.loss_gradient(np.ascontiguousarray(x[pick].T), y[pick], ask_loss=False)[1], m, v, s, rate * min(1.0, 2.0 * (1 - s / (steps + 1))))
        return self

    def _step(self, g, m, v, s: int, lr: float) -> None:
        """Step ``s`` of Adam, with means ``m`` and ``v``, along the clipped gradient ``g``."""
        norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        for k, a in g.items():
            a = a / max(1.0, norm)
            m[k] += 0.1 * (a - m[k])
            v[k] += 0.01 * (a * a - v[k])
            self.p[k] -= (lr * (m[k] / (1 - 0.9**s)) / (np.sqrt(v[k] / (1 - 0.99**s)) + 1e-6)).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)]).astype(np.float64)

    def set_flat(self, values: np.ndarray) -> None:
        at = 0
        for k in sorted(self.p):
            n = self.p[k].size
            self.p[k] = values[at : at + n].reshape(self.p[k].shape).astype(np.float32)
            at += n

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        """Language and probability of whole texts; the windows of a batch run BLOCK side by side."""
        sums = np.zeros((len(texts), len(self.labels)))
        lengths = np.array([len(t or b"") for t in texts])
        for owners, x in window_blocks(enumerate(t or b"" for t in texts) if self.labels else (), BLOCK):
            p = self._probabilities(self._states(x, False)[0], (x < PAD).astype(np.float32)).sum(axis=0)
            first = np.flatnonzero(np.diff(owners, prepend=-1))
            sums[owners[first]] += np.add.reduceat(p, first, axis=1, dtype=np.float64).T
        sums /= np.maximum(lengths, 1)[:, None]
        best = sums.argmax(axis=1) if len(texts) and self.labels else []
        names, scores = [], []
        for i, t in enumerate(texts):
            if not has_letter(t) or not self.labels:
                names.append("und")
                scores.append(0.0)
            else:
                names.append(self.labels[best[i]])
                scores.append(float(min(1.0, max(0.0, sums[i, best[i]]))))
        return names, scores


_NOT_LETTERS = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122))


def has_letter(raw: bytes | None) -> bool:
    if not raw:
        return False
    if raw.translate(None, _NOT_LETTERS):
        return True
    return any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def window_blocks(texts: Iterable[tuple[int, bytes]], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows of all texts in order, ``size`` at once (fewer at the end): the numbers that stand beside their texts (N) and
    their symbols (T, N), a text's last window padded. The numbers' array is used again."""
    rows, numbers, filled = np.empty((size, WINDOW), np.int16), np.empty(size, np.intp), 0
    for number, text in texts:
        at = 0
        while at < len(text):
            n = min(size - filled, -(-(len(text) - at) // WINDOW))
            part = np.frombuffer(text, np.uint8, min(n * WINDOW, len(text) - at), at)
            to = rows[filled : filled + n].reshape(-1)
            to[: len(part)] = part
            to[len(part) :] = PAD
            numbers[filled : filled + n] = number
            at += len(part)
            filled += n
            if filled == size:
                yield numbers, np.ascontiguousarray(rows.T)
                filled = 0
    if filled:
        yield numbers[:filled], np.ascontiguousarray(rows[:filled].T)


def windows_of(text: bytes):
    """Symbols of every window of a text, the last one padded."""
    for _, x in window_blocks([(0, text)], 1):
        yield x[:, 0].astype(np.intp)


def learn_all(rows: DataFrame, model: ByteGRU, counts: dict[str, int], text: str = "text", lang: str = "lang") -> ByteGRU:
    """One pass over every window of every row, from the weights of ``model``.

    Each task steps through its rows by itself, and the mean of the tasks' weights by their windows is the new model, so
    a task of the table sends one set of weights (some 100 KB) to the driver and no text. Languages weigh
    alike whatever their share.
    """
    place = {k: i for i, k in enumerate(model.labels)}
    share = np.array([sum(counts.values()) / (len(counts) * counts[k]) for k in model.labels])

    def run(batches):
        m, v = ({k: np.zeros_like(a) for k, a in model.p.items()} for _ in range(2))
        seen = 0
        rows = ((place[k], t.as_py()) for b in batches for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True))
        for s, (y, x) in enumerate(window_blocks(rows, PASS_LANES), 1):
            model._step(model.loss_gradient(x, y, share[y], False)[1], m, v, s, PASS_RATE)
            seen += len(y)
        if seen:
            yield pa.RecordBatch.from_pydict({"n": pa.array([seen], pa.int64()), "w": pa.array([model.flat().tobytes()], pa.binary())})

    small_batches(rows.sparkSession)
    picked, cores = rows.select(F.col(lang), F.col(text).cast("binary")), rows.sparkSession.sparkContext.defaultParallelism
    if picked.rdd.getNumPartitions() < cores:  # a small table in few pieces; a large one is not shuffled
        picked = picked.repartition(cores)
    total, mean = 0, 0.0
    for r in picked.mapInArrow(run, "n long, w binary").collect():
        total, mean = total + r["n"], mean + r["n"] * np.frombuffer(r["w"])
    if total:
        model.set_flat(mean / total)
    return model


def train(docs: DataFrame, learn, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = TRAIN_DOCS, steps: int = STEPS) -> ByteGRU:
    """Fits the network on all rows where ``learn`` holds: it starts from weights of at most about ``per_lang`` documents of
    each language, TRAIN_WINDOWS windows of each, and then passes over every window of every row (``learn_all``).

    The network has one output for each language, so the languages of a corpus (not its documents) set its
    width and the rows that reach the driver: one count and at most 2 * per_lang samples a language.
    """
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    labels = sorted(counts)
    model = ByteGRU(labels)
    if not labels:
        return model
    draw = F.pmod(F.xxhash64(F.col(doc_id), F.lit(17)), F.lit(1 << 20))
    chance = F.create_map(*[F.lit(v) for k in labels for v in (k, int(min(1.0, per_lang / counts[k]) * (1 << 20)))])

    def windows(texts):
        out = []
        for t in texts:
            starts = np.unique(np.linspace(0, max(0, len(t) - WINDOW), TRAIN_WINDOWS).astype(int)) if t else []
            out.append([t[s : s + WINDOW] for s in starts])
        return [out]

    sample = rows.where(draw < chance[F.col(lang)])
    got = map_texts(sample, {"lang": F.col(lang), "k": F.xxhash64(doc_id)}, "w array<binary>", windows, text).orderBy("k", "lang").limit(2 * per_lang * len(labels)).collect()
    xs, ys = [], []
    for r in got:
        for w in r["w"]:
            if len(w) >= 8:
                xs.append(np.concatenate([np.frombuffer(w, np.uint8).astype(np.int16), np.full(WINDOW - len(w), PAD, np.int16)]))
                ys.append(labels.index(r["lang"]))
    if xs:
        model.fit(np.stack(xs).astype(np.intp), np.array(ys), steps=steps)
    return learn_all(rows, model, counts, text, lang)


def language_id(docs: DataFrame, model: ByteGRU, carry: dict | None = None, text: str = "text", raw: bool = False) -> DataFrame:
    """The carried columns with lang_pred and score for every row; no shuffle.

    ``und`` with score 0.0 for a null text or one without a letter, and where nothing could be
    learned. Only the text decides. Repeated rows each get the same answer; an empty table gives no rows.
    """
    return map_texts(docs, carry or {"doc_id": F.col("doc_id")}, "lang_pred string, score double", lambda ts: list(model.predict(ts)), text, raw)


def least_score(judged: DataFrame, held, text: str = "text", lang: str = "lang") -> float:
    """The score below which a text is taken to be of no learned language.

    FLOOR of the score that all but one in a thousand of the held-out rows reach whose language is predicted right, over
    all of them; 0.0 where there are none, so nothing is rejected by it. ``judged`` are rows with text, lang_pred and score. The
    lowest thousandth of the scores reaches the driver, one number a row.
    """
    right = judged.where(held & F.col(text).isNotNull() & (F.col(lang) == F.col("lang_pred"))).select("score")
    n = right.count()
    if not n:
        return 0.0
    at = 0.001 * (n - 1)
    low = [r[0] for r in right.orderBy("score").limit(int(at) + 2).collect()]
    i = int(at)
    return FLOOR * (low[i] + (at - i) * (low[min(i + 1, len(low) - 1)] - low[i]))


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id mod 4 is 2; a null id is neither held out nor learned from."""
    return F.coalesce(bucket_of(doc_id, 4) == 2, F.lit(False))


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = train(docs, bucket_of("doc_id", 4) != 2)
    return language_id(docs, model, {"doc_id": F.col("doc_id"), "held_out": held_out()})
