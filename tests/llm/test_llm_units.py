import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from foliowright.llm import embedding_dedup, language_id, license_scan, minhash_dedup, packing, quality_pu, quality_rules, sharding, token_count

TEXTS = ["", " ", "a", "Hello world, it's <|endoftext|> DON'T", "naïve café ÀÉ́  x\x1cy", "x" * 3000, "日本語 テスト 123 4567", "a\n\n  b\t\tc   ", "!!!??? ...", "ﬁ ǅ ß İ", "Zz" * 40 + " 12.5%"]


def test_token_counts_equal_the_library():
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    c = token_count.MergeCounter(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("abtheing ÉéÖ'0 9.,\n<|>") for _ in range(200)) for _ in range(60)]
    assert [c.count(t.encode()) for t in texts] == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]


def test_packing_ids_equal_the_library():
    e = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("abthe ing'Éé\n\t 09.,€") for _ in range(150)) for _ in range(60)]
    assert e.fast is not None
    for t in texts:
        assert e.ids(t.encode()).tolist() == e.lib.encode(t, add_special_tokens=False).ids


def test_hilbert_neighbours_touch():
    side = np.arange(8)
    cells = np.array([(a, b, c) for a in side for b in side for c in side], np.uint64)
    order = np.argsort(packing.hilbert(cells, 3))
    steps = np.abs(np.diff(cells[order].astype(int), axis=0)).sum(axis=1)
    assert (steps == 1).all() and len(set(packing.hilbert(cells, 3))) == 512


def test_network_gradient_against_differences():
    m = language_id.ByteGRU(["a", "b"], hidden=3)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(97, 103, (6, 4)), np.array([0, 1, 0, 1])
    _, g = m.loss_gradient(x, y)
    for k in m.p:
        i = tuple(np.argwhere(np.abs(g[k]) > 1e-4)[0])
        got = []
        for e in (1e-2, -1e-2):
            m.p[k][i] += e
            got.append(m.loss_gradient(x, y)[0])
            m.p[k][i] -= e
        assert (got[0] - got[1]) / 2e-2 == pytest.approx(g[k][i], rel=0.08, abs=2e-4)


def test_letters():
    assert not language_id.has_letter(None) and not language_id.has_letter("12 !… 1".encode())
    assert language_id.has_letter("9ñ".encode())


def test_set_similarity_is_exact():
    a = minhash_dedup.shingles(b"one two three four five six seven")
    assert len(a) == 4 and len(minhash_dedup.shingles(b"one two")) == 1 and len(minhash_dedup.shingles(None)) == 0
    assert minhash_dedup.similar(a, a) and not minhash_dedup.similar(a, a[:3])
    ten = np.arange(10, dtype=np.uint64)
    assert minhash_dedup.similar(ten[:8], ten) and not minhash_dedup.similar(ten[:7], ten)


def test_group_is_confirmed_without_all_pairs():
    s = lambda *x: np.array(x, np.uint64)
    sets = [s(*range(9)), s(*range(10)), s(*range(50, 60))]
    rep = np.array([3, 5, 9])
    sig = np.stack([minhash_dedup.signature(x << np.uint64(33)) for x in sets])
    sig[1] = sig[0]
    assert minhash_dedup._confirm(rep, sets, sig, rep, np.zeros(3, bool)).tolist() == [3, 3, 9]
    # equal labels are connected as they are; with a wanderer, pairs without one are left alone
    assert minhash_dedup._confirm(rep, sets, sig, np.array([3, 5, 3]), np.zeros(3, bool)).tolist() == [3, 3, 3]
    assert minhash_dedup._confirm(rep, sets, sig, rep, np.array([False, False, True])).tolist() == [3, 5, 9]
    assert minhash_dedup._confirm(rep, sets, sig, rep, np.array([True, False, False])).tolist() == [3, 3, 9]


def test_repeated_words_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        ws = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 14))]
        wins = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
        hit = {i + k for i, w in enumerate(wins) if wins.count(w) > 1 for k in range(3)}
        assert quality_rules.repeated_words(ws) == len(hit)


def test_repeated_words_share_at_any_length():
    """The share of shuffled words of a small vocabulary stays where the text passes 1,000 words, and far beyond."""
    rng = random.Random(7)
    few = [b"w%d" % rng.randrange(150) for _ in range(20000)]
    many = [b"w%d" % rng.randrange(5000) for _ in range(20000)]
    for n in (999, 1000, 1001, 1999, 2001, 20000):
        assert quality_rules.same_share(few[:n]) == pytest.approx(0.85, abs=0.003)
        assert quality_rules.same_share(many[:n]) < 0.2
    assert quality_rules.same_share([b"a"] * 4 + [b"b"]) == pytest.approx(0.6)
    # every word counts: repeats in any part of a long text move the figure
    for at in (0, 700, 1500):
        assert quality_rules.same_share(many[:at] + [b"x"] * 1000 + many[at:1500]) > quality_rules.same_share(many[:2500]) + 0.2


def test_template_join_against_brute_force():
    freq = {}
    index = license_scan.TemplateIndex(license_scan.TEMPLATES, freq, 0.8)
    rng = random.Random(2)
    vocabulary = sorted(index.vocabulary) + [b"foo", b"bar"]
    for _ in range(500):
        base = list(rng.choice(index.sets))
        block = [w for w in base if rng.random() < 0.9] + [rng.choice(vocabulary) for _ in range(3)]
        want = [(t, len(s & set(block)) / len(s)) for t, s in enumerate(index.sets) if len(s & set(block)) >= index.alpha[t]]
        assert index.contained(block) == want


def test_license_blocks_against_brute_force():
    """Every template that some window of the text contains, at the highest containment of any window."""
    index = license_scan.TemplateIndex(license_scan.TEMPLATES, {}, 0.8)
    rng = random.Random(4)
    notices = [license_scan.words(t.encode()) for _, t in license_scan.TEMPLATES]
    for _ in range(300):
        ws = []
        for _ in range(rng.randint(1, 4)):
            ws += [rng.choice([b"foo", b"the", b"under"]) for _ in range(rng.randint(0, 15))]
            ws += [w for w in rng.choice(notices) if rng.random() < 0.9]
        got = {}
        for t, a, b, c in index.blocks(ws):
            assert b - a < index.width[t] and c == len(index.sets[t] & set(ws[a : b + 1])) / len(index.sets[t])
            got.setdefault(t, []).append((a, b, c))
        for t, s in enumerate(index.sets):
            most = max(len(s & set(ws[i : i + index.width[t]])) for i in range(len(ws) + 1))
            assert (t in got) == (most >= index.alpha[t])
            if t in got:
                spans = sorted(got[t])
                assert max(c for *_, c in spans) == most / len(s) and all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_pack_fills_shards_evenly():
    rng = np.random.default_rng(0)
    items = rng.random((4000, 3)) ** 4
    items /= items.sum(axis=0)
    load = np.zeros((8, 3))
    np.add.at(load, sharding.pack(items, 8), items)
    assert np.abs(load[:, 0] * 8 - 1).max() < 0.01


def test_tile_counts_against_brute_force():
    rng = np.random.default_rng(0)
    x = embedding_dedup.unit((np.repeat(rng.standard_normal((20, 8)), 5, axis=0) + 0.12 * rng.standard_normal((100, 8))).ravel(), 8)
    n, ids = np.ones(100, int), np.arange(100)
    h, m, lab, _ = embedding_dedup.tile_join(x, x, n, n, ids, ids, np.ones(100, bool), 0.95)
    s = x @ x.T >= 0.95
    assert (h == s.sum(1)).all() and (m == 0).all()
    reach = s.astype(int)
    for _ in range(7):
        reach = (reach @ reach > 0).astype(int)
    assert (lab == [np.flatnonzero(r).min() for r in reach]).all()


def test_pu_learning_separates():
    rng = np.random.default_rng(0)
    good = [(" ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60))).encode() for _ in range(150)]
    bad = [(" ".join("".join(rng.choice(list("ABC$!"), 5)) for _ in range(60))).encode() for _ in range(50)]
    m = quality_pu.PUNetwork(2 / 3).fit(quality_pu.feature_matrix(good[:100]), quality_pu.feature_matrix(good[50:] + bad))
    assert m.scores(good).min() > 0.5 > 0.3 > m.scores(bad).max()
    assert 0 <= m.scores([None, b""])[0] <= 1


@pytest.mark.parametrize("good", [0.95, 0.4])
def test_verdicts_at_other_shares_of_good_texts(good):
    """Votes against that come together reject, beside votes for the text as well; what is only spoken for is kept.

    A lone vote against that never comes with another one is no evidence for a mixture of independent voters and
    rejects nothing; a rule is heard where others bear it out.
    """
    n = 20000
    fine = {"11111122": 0.85, "11111112": 0.05, "11111121": 0.09, "11101122": 0.01}
    foul = {"00111112": 0.4, "11110121": 0.1, "00110121": 0.1, "11110111": 0.1, "11111022": 0.1, "11001022": 0.1, "11001122": 0.1}
    table = {**{k: round(v * n * good) for k, v in fine.items()}, **{k: round(v * n * (1 - good)) for k, v in foul.items()}}
    got = quality_rules.VoteModel(table).table(table)
    assert all(got[k] >= quality_rules.KEEP_AT for k in ("11111122", "11111112", "11111121"))
    assert all(got[k] < quality_rules.KEEP_AT for k in ("00111112", "00110121", "11001122", "11001022"))


def test_vote_model_without_rows():
    assert quality_rules.VoteModel({}).table([]) == {}
    assert zlib.crc32(b"") == 0


def test_tables_of_a_run_stand_in_one_folder(spark):
    from foliowright.llm.common import materialize

    spark.conf.set("foliowright.run", "run-7")
    try:
        df = materialize(spark.range(3), "t")
    finally:
        spark.conf.unset("foliowright.run")
    assert df.count() == 3 and all("/foliowright/run-7/t-" in f for f in df.inputFiles())
    assert "/foliowright/tables/" in materialize(spark.range(1), "t").inputFiles()[0]
