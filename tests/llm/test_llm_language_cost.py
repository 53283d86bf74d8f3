"""The byte network of op4: states by their definition, windows across blocks, and what a step costs."""

from time import process_time

import numpy as np
import pytest

from foliowright.llm import language_id as L


def _plain(model, symbols):
    """Probabilities of every position of one window, number by number."""
    h, p = model.h, {k: v.astype(float) for k, v in model.p.items()}
    states = {}
    for d in "fb":
        state, got = np.zeros(h), []
        for c in symbols if d == "f" else symbols[::-1]:
            e, r = p[f"E{d}"][:, c], p[f"U{d}"] @ state
            update, reset = np.clip(0.25 * (e + r)[: 2 * h] + 0.5, 0, 1).reshape(2, h)
            cand = np.clip(e[2 * h :] + reset * r[2 * h :], -1, 1)
            state = update * state + (1 - update) * cand
            got.append(state)
        states[d] = np.array(got if d == "f" else got[::-1])
    logits = np.exp(np.concatenate([states["f"], states["b"]], axis=1) @ p["W"].T + p["c"][:, 0])
    return logits / logits.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("hidden", [3, 4, L.HIDDEN])
def test_positions_follow_the_definition(hidden):
    rng = np.random.default_rng(hidden)
    model = L.ByteGRU(list("abc"), hidden)
    x = rng.integers(0, L.PAD + 1, (20, 5))
    got = model.positions(x)
    for lane in range(5):
        assert np.allclose(got[:, :, lane], _plain(model, x[:, lane]), atol=1e-5)


def test_windows_and_predictions_across_blocks(monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 7)
    rng = np.random.default_rng(1)
    sizes = [0, 1, L.WINDOW - 1, L.WINDOW, L.WINDOW + 1, 0, 7 * L.WINDOW, 20 * L.WINDOW + 5, 3, L.WINDOW * 6 + 64]
    texts = [rng.integers(97, 123, n).astype(np.uint8).tobytes() for n in sizes]
    plain = [(i, [*t[at : at + L.WINDOW], *[L.PAD] * (L.WINDOW - len(t[at : at + L.WINDOW]))]) for i, t in enumerate(texts) for at in range(0, len(t), L.WINDOW)]
    blocks = [(n.copy(), x) for n, x in L.window_blocks(enumerate(texts), 7)]
    assert [x.shape[1] for _, x in blocks[:-1]] == [7] * (len(blocks) - 1)
    assert [(int(i), w.tolist()) for n, x in blocks for i, w in zip(n, x.T, strict=True)] == plain
    model = L.ByteGRU(list("abc"))
    names, scores = model.predict([*texts, None])
    for i, t in enumerate(texts):
        if t:
            p = np.concatenate([_plain(model, np.array(w)) for k, w in plain if k == i])[np.array([w for k, w in plain if k == i]).ravel() < L.PAD].mean(axis=0)
            assert names[i] == "abc"[p.argmax()] and scores[i] == pytest.approx(p.max(), abs=1e-5)
        else:
            assert (names[i], scores[i]) == ("und", 0.0)
    assert (names[-1], scores[-1]) == ("und", 0.0)


def test_gradient_over_blocks_is_the_gradient_over_all(monkeypatch):
    rng = np.random.default_rng(2)
    x, y, weight = rng.integers(97, 123, (L.WINDOW, 50)), rng.integers(0, 4, 50), rng.random(50)
    x[90:, ::4] = L.PAD
    model = L.ByteGRU(list("abcd"))
    loss, whole = model.loss_gradient(x, y, weight)
    monkeypatch.setattr(L, "BLOCK", 16)
    parts_loss, parts = model.loss_gradient(x, y, weight)
    assert parts_loss == pytest.approx(loss, rel=1e-5)
    assert model.loss_gradient(x, y, weight, ask_loss=False)[0] is None
    for k, v in whole.items():
        assert np.allclose(parts[k], v, rtol=1e-3, atol=1e-5 * abs(v).max()), k


def test_a_step_costs_few_gathers():
    """Against the time that it takes to gather the tables' columns number by number: a prediction took 5.0 of them, a gradient
    13.4, with the windows' numbers in rows of their own; 3.4 and 10.3 with them side by side."""
    rng = np.random.default_rng(3)
    model = L.ByteGRU(list("abcd"))
    x, y = rng.integers(97, 123, (L.WINDOW, L.PASS_LANES)).astype(np.intp), rng.integers(0, 4, L.PASS_LANES)
    out = np.empty((3 * L.HIDDEN, L.PASS_LANES), np.float32)

    def gathers():
        for d in "fb":
            for row in x:
                np.take(model.p[f"E{d}"], row, axis=1, out=out, mode="clip")

    times = {f: [] for f in (gathers, lambda: model.positions(x), lambda: model.loss_gradient(x, y))}
    for _ in range(9):
        for f, got in times.items():
            t = process_time()
            f()
            got.append(process_time() - t)
    one, predicted, gradient = (min(t) for t in times.values())
    print(f"gathers: prediction {predicted / one:.2f}, gradient {gradient / one:.2f}")
    assert predicted < 4.2 * one and gradient < 11.8 * one
