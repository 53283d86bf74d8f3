"""Registered queries held against plain Python over whole small tables, laws of their results, held-out accuracy."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliowright.llm import language_id, license_scan, minhash_dedup, mixing, quality_pu, quality_rules, sharding
from foliowright.llm.common import bucket_of
from foliowright.llm.queries import QUERIES

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(LARGER), reason="the test tables are not here")

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = "[^\x20\x09-\x0d]+"


@pytest.fixture(scope="module")
def small(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def _result(spark, name, folder=SMALL):
    return {r["doc_id"]: r for r in QUERIES[name](spark, folder).collect()}


def test_license_query(spark, small):
    """Phrase places by a scan of every position, templates by a scan of every window."""
    got = _result(spark, "op1_license_scan")
    assert got.keys() == small.keys()
    phrases = [(p.split(), label) for p, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))]
    sets = [(label, frozenset(license_scan.words(t.encode()))) for label, t in license_scan.TEMPLATES]
    index = license_scan.TemplateIndex(license_scan.TEMPLATES, {}, license_scan.THRESHOLD, license_scan.NAMES)
    some = 0
    for i, r in small.items():
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r["text"] or "").translate(LOWER))
        at = [(k, label) for p, label in phrases for k in range(len(ws)) if ws[k : k + len(p)] == p]
        g = got[i]
        assert (g["n_words"], g["n_base"]) == (len(ws), len(at))
        assert (g["first_word"], g["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert g["base_labels"] == ",".join(sorted({label for _, label in at})) and 0 <= g["score"] <= 1
        raw = [w.encode() for w in ws]
        held = set()
        for t, (label, s) in enumerate(sets):
            wide = index.width[t]
            starts = range(max(1, len(raw) - wide + 1)) if s & set(raw) else ()
            if any(len(have := s & set(raw[k : k + wide])) >= math.ceil(0.8 * len(s) - 1e-9) and index.names[t] <= have for k in starts):
                held.add(label)
        labels = set(g["labels"].split(",")) - {""}
        base = {label for _, label in at}
        assert base <= labels <= base | held and bool(g["n_blocks"]) == bool(held)
        some += bool(held)
    assert some


def test_token_query(spark, small):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = _result(spark, "op3_token_count")
    for i, r in small.items():
        n = len(lib.encode(r["text"] or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((r["text"] or "").encode()), n, n > 2048)


def test_language_query_on_held_out_rows(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    got = _result(spark, "op4_language_id", LARGER)
    assert got.keys() == docs.keys()
    right = total = 0
    for i, r in docs.items():
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i]["score"] <= 1
        if not any(c.isalpha() for c in r["text"] or ""):
            assert got[i]["lang_pred"] == "und"
        elif got[i]["held_out"] and r["lang"]:
            total += 1
            right += got[i]["lang_pred"] == r["lang"]
    assert total > 100 and right / total > 0.97


def _auc(scores, ones):
    pos, neg = np.array([s for s, y in zip(scores, ones, strict=True) if y]), np.array([s for s, y in zip(scores, ones, strict=True) if not y])
    return ((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()) if len(pos) and len(neg) else math.nan


def test_quality_query_on_held_out_rows(spark):
    got = _result(spark, "op5_quality", LARGER)
    known = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    held = [(got[i]["score"], q == 1, got[i]["predicted"]) for i, q in known.items() if i in got and got[i]["held_out"] and q is not None]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for i, r in got.items())
    assert len(held) > 40 and _auc([s for s, *_ in held], [y for _, y, _ in held]) > 0.98
    assert sum(p for _, y, p in held if y) >= 0.95 * sum(y for _, y, _ in held)


def test_labels_of_zero_do_not_matter(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    fold = bucket_of("doc_id", 5) != 0
    models = [quality_pu.train(docs, rows, fold) for rows in (labels, labels.where("quality = 1"), labels.withColumn("quality", F.when(F.col("quality") == 1, 1).otherwise(7)))]
    for m in models[1:]:
        assert m.prior == models[0].prior and all((m.p[k] == models[0].p[k]).all() for k in m.p)


def test_class_prior_from_scores():
    rng = np.random.default_rng(4)
    for share in (0.3, 0.6, 0.9):
        pos = rng.normal(2, 1, 4000)
        unl = np.where(rng.random(8000) < share, rng.normal(2, 1, 8000), rng.normal(-2, 1, 8000))
        assert share - 0.08 < quality_pu.class_prior(pos, unl) < share + 0.02


def test_sharding_query(spark, small):
    """Laws of the result, and every placement by a plain loop over the same items."""
    got = _result(spark, "op6_sharding")
    assert got.keys() == small.keys()
    size = {i: len((r["text"] or "").encode()) + 1 for i, r in small.items()}
    for i, r in small.items():
        assert (got[i]["size"], got[i]["text_crc32"], got[i]["law"], got[i]["grown_shard"]) == (size[i], zlib.crc32((r["text"] or "").encode()), "bytes", None)
    where = defaultdict(set)
    for i, r in small.items():
        where[r["text"]].add(got[i]["shard"])
    total = sum(size.values())
    group = Counter()
    for i, r in small.items():
        group[r["text"]] += size[i]
    assert all(len(s) == 1 for t, s in where.items() if group[t] <= total / 8)
    by = Counter()
    for i in small:
        by[got[i]["shard"]] += size[i]
    assert by.keys() == set(range(8)) and max(by.values()) - min(by.values()) <= 0.02 * total / 8
    for s in by:
        assert sorted(r["slot"] for r in got.values() if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got.values())))


def test_packing_of_shards_against_a_plain_loop():
    rng = np.random.default_rng(6)
    for n in (1, 40, 300):
        items = rng.random((n, 3)) ** 3
        items /= items.sum(axis=0)
        left = [[1 / 8] * 3 for _ in range(8)]
        want = [0] * n
        for i in sorted(range(n), key=lambda i: (-items[i].max(), -items[i].sum(), i)):
            room = [s for s in range(8) if all(left[s][d] >= items[i][d] - 1e-12 for d in range(3))]
            dots = {s: float(np.array(left[s]) @ items[i]) for s in room} or {s: left[s][0] for s in range(8)}
            want[i] = max(sorted(dots), key=dots.__getitem__)
            for d in range(3):
                left[want[i]][d] -= items[i][d]
        assert sharding.pack(items, 8).tolist() == want


def _links(texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall(BLANK, (t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])
    low = {i: i for i in sets}
    near = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while any(low[a] != low[b] for a, b in near):
        for a, b in near:
            low[a] = low[b] = min(low[a], low[b])
    return {i: (len(sets[i]), low[i], low[i] == i) for i in sets}


def test_minhash_query(spark, small):
    got = _result(spark, "op7_minhash_dedup")
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == _links({i: r["text"] for i, r in small.items()})


def test_branching_path_finds_near_copies(spark):
    """Two thousand documents that share most of their words, so that nodes are far above LEAF, and pairs among them."""
    rng = np.random.default_rng(8)
    common = [f"c{k}" for k in range(160)]
    rows, pairs = [], []
    for i in range(1000):
        own = [f"o{i}x{k}" for k in range(90)]
        a, b = common + own, common + own
        b = [*b[:-1], f"z{i}"] if rng.random() < 0.5 else [*b[:170], f"z{i}", *b[171:]]
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
        pairs.append((2 * i, 2 * i + 1))
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.minhash_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.99 * len(pairs)
    assert len(set(got.values())) >= 990  # documents of different pairs stay apart


def _counts(text):
    ws = re.findall(BLANK, text)
    wins = [tuple(ws[k : k + 3]) for k in range(len(ws) - 2)]
    often = Counter(wins)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(BLANK, line):
            dup += line in seen
            seen.add(line)
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), dup, len({k + d for k, w in enumerate(wins) if often[w] > 1 for d in range(3)}))


def test_quality_rules_query(spark, small):
    got = _result(spark, "op8_quality_rules")
    assert got.keys() == small.keys()
    for i, r in small.items():
        want = _counts(r["text"] or "")
        g = got[i]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == want
        assert g["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert g["kept"] == (not g["base_failed"] and g["posterior"] >= 0.5)


def _plain_em(patterns):
    """The same mixture by loops: posterior of each pattern. Voters: rules of one figure."""
    figures = list(dict.fromkeys(r[1] for r in quality_rules.RULES))
    both = {f: any(r[1] == f and r[4] for r in quality_rules.RULES) for f in figures}

    def outcome(key, f):
        said = [d for d, r in zip(key, quality_rules.RULES, strict=True) if r[1] == f]
        return None if "3" in said else 0 if "0" in said else 2 if "2" in said else 1

    belief = {f: [list(x) for x in quality_rules.BELIEF[both[f]]] for f in figures}
    p, prior, n, old = {f: [list(x) for x in belief[f]] for f in figures}, 0.7, sum(patterns.values()), None
    while True:
        q = {}
        for key in patterns:
            like = [prior, 1 - prior]
            for f in figures:
                o = outcome(key, f)
                for side in (0, 1):
                    like[side] *= 1 if o is None else p[f][side][o]
            q[key] = like[0] / sum(like)
        if old and max(abs(q[k] - old[k]) for k in q) < 1e-12:
            return q
        old = q
        for f in figures:
            for side in (0, 1):
                seen = [0.0, 0.0, 0.0]
                for key, c in patterns.items():
                    if (o := outcome(key, f)) is not None:
                        seen[o] += c * (q[key] if side == 0 else 1 - q[key])
                p[f][side] = [(a + 100 * b) / (sum(seen) + 100) for a, b in zip(seen, belief[f][side], strict=True)]
        prior = (sum(c * q[k] for k, c in patterns.items()) + 70) / (n + 100)


def test_vote_model_against_loops(spark):
    """Verdicts of a whole table's rows: expectation-maximisation written again."""
    rows = QUERIES["op8_quality_rules"](spark, LARGER).collect()
    made = quality_rules.quality_rules(spark.read.parquet(f"{LARGER}/documents.parquet")).collect()
    want = _plain_em(Counter(r["votes"] for r in made))
    assert all(r["posterior"] == pytest.approx(want[r["votes"]], abs=1e-6) for r in made)
    kept = {r["doc_id"]: not r["base_failed"] and want[r["votes"]] >= 0.5 for r in made}
    assert all(r["kept"] == kept[r["doc_id"]] for r in rows)


def test_one_strong_vote_is_no_veto():
    """A rule that fires on a good third of texts beside votes for them is no sign of bad ones; nor are silent texts."""
    got = quality_rules.VoteModel({"10111112": 400, "11111122": 700}).table(["10111112", "11111122"])
    assert min(got.values()) > 0.9
    got = quality_rules.VoteModel({"11111122": 400, "13113113": 300, "03113113": 300}).table(["11111122", "13113113", "03113113"])
    assert got["11111122"] > 0.9 and got["13113113"] > 0.5


@pytest.mark.parametrize("n, share", [(4000, 0.7), (40000, 0.7), (40000, 0.4), (40000, 0.95)])
def test_vote_model_recovers_a_strong_rule_that_fires_on_good_texts(n, share):
    """Symbols stand in 30 % of good texts: the rate of every rule comes back, at any share of good texts."""
    rng = np.random.default_rng(1)
    good = {"symbol_share": (0.3, 0.7, 0), "mark_share": (0.02, 0.18, 0.8), "repeat_share": (0.02, 0.98, 0), "dup_share": (0.03, 0.97, 0), "upper_share": (0.01, 0.19, 0.8), "same_share": (0.02, 0.98, 0)}
    bad = {"symbol_share": (0.4, 0.6, 0), "mark_share": (0.5, 0.3, 0.2), "repeat_share": (0.4, 0.6, 0), "dup_share": (0.5, 0.5, 0), "upper_share": (0.3, 0.4, 0.3), "same_share": (0.4, 0.6, 0)}
    is_good = rng.random(n) < share
    said = {f: np.where(is_good, rng.choice(3, n, p=good[f]), rng.choice(3, n, p=bad[f])) for f in good}
    keys = ["".join(str(v) if said[f][i] == v else "1" for _, f, _, _, v in quality_rules.RULES) for i in range(n)]
    m = quality_rules.VoteModel(Counter(keys))
    assert m.prior == pytest.approx(share, abs=0.02)
    for (name, (g, b)), (_, f, _, _, v) in zip(m.rates().items(), quality_rules.RULES, strict=True):
        assert g == pytest.approx(good[f][v], abs=0.02) and b == pytest.approx(bad[f][v], abs=0.08), name


def test_vote_model_recovers_rates():
    """Rates of simulated classes come back without labels, near the truth and on no bound."""
    rng = np.random.default_rng(5)
    good = np.array([0.001, 0.002, 0.02, 0.03, 0.001, 0.001, 0.9, 0.85])
    bad = np.array([0.5, 0.5, 0.4, 0.2, 0.3, 0.3, 0.3, 0.5])
    vote = [str(r[4]) for r in quality_rules.RULES]
    is_good = rng.random(40000) < 0.8
    fired = rng.random((40000, 8)) < np.where(is_good[:, None], good, bad)
    keys = ["".join(v if f else "1" for v, f in zip(vote, row, strict=True)) for row in fired]
    m = quality_rules.VoteModel(Counter(keys))
    assert m.prior == pytest.approx(0.8, abs=0.02)
    assert m.bad[:6] == pytest.approx(bad[:6], abs=0.15) and m.good[2:6] == pytest.approx(good[2:6], abs=0.02)
    table = m.table(set(keys))
    assert np.mean([(table[k] >= 0.5) == g for k, g in zip(keys, is_good, strict=True)]) > 0.95
    # an abstention counts: a text for which nothing speaks is less likely good than one with both votes for it
    assert m.table(["11111111"])["11111111"] < m.table(["11111122"])["11111122"]


def _plain_mix(rows):
    """The mix by loops. rows: (doc_id, text, source); gives copies of every row."""
    size = [len(re.findall(BLANK, t or "")) for _, t, _ in rows]
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    whole = Counter()
    for (*_, s), n in zip(rows, size, strict=True):
        whole[s] += n
    open_, left, target = set(names), sum(size), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= 3 * whole[s]}
        target |= {s: 3.0 * whole[s] for s in over} or {s: level * weight[s] for s in open_}
        left -= sum(3 * whole[s] for s in over)
        open_ = open_ - over if over else set()
    copies = [0] * len(rows)
    for s in names:
        mine = [k for k, r in enumerate(rows) if r[2] == s]
        k_of = {k: max(1, size[k]).bit_length() for k in mine}
        words = Counter()
        for k in mine:
            words[k_of[k]] += size[k]
        e, classes, rest = {}, sorted(words), target[s]
        while classes:
            tilted = sum(words[c] * 2.0 ** (-mixing.TILT * c) for c in classes)
            a = rest / tilted if tilted else 0.0
            if target[s] > 0 and a * 2.0 ** (-mixing.TILT * classes[0]) >= 3 - 1e-9:
                rest -= 3 * words[classes[0]]
                e[classes.pop(0)] = 3.0
            else:
                e |= {c: a * 2.0 ** (-mixing.TILT * c) if target[s] > 0 else 0.0 for c in classes}
                classes = []
        missing, ranked = target[s], []
        for k in mine:
            copies[k] = math.floor(e[k_of[k]] + 1e-9)
            missing -= copies[k] * size[k]
            pi = e[k_of[k]] - copies[k]
            if pi >= 1e-9:
                i, t = rows[k][0], rows[k][1]
                h = (xxhash.xxh64_intdigest(t.encode(), 42) + 2**63) % 2**64 - 2**63 if t is not None else 42
                u = (int(hashlib.md5(f"{i}:{h}:mix".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                ranked.append(((u / (1 - u)) / (pi / (1 - pi)), i, k))
        taken = 0
        behind = []
        for o, _, k in sorted(ranked):
            if behind or taken + size[k] > missing:
                behind.append((o, k))
            else:
                copies[k] += 1
                taken += size[k]
        yield s, target[s], missing - taken, mine, behind
    yield copies


def test_mixing_query(spark, small):
    """The ranking takes what a plain loop takes; what completes a sample comes from behind it and brings the words nearer."""
    rows = [(i, r["text"], r["source"]) for i, r in small.items()]
    got = _result(spark, "op10_mixing")
    *sources, copies = list(_plain_mix(rows))
    for _, target, gap, mine, behind in sources:
        at = {k for _, k in behind}
        extra = 0
        for k in mine:
            g = got[rows[k][0]]
            assert g["target"] == pytest.approx(target) and g["taken"] <= 3 * g["size"]
            more = g["taken"] - copies[k] * g["size"]
            assert more == 0 or (k in at and more == g["size"])
            extra += more
        assert abs(gap - extra) <= abs(gap) + 1e-6


def test_mixing_inclusion_follows_the_probabilities(spark):
    """Sixty sources of like documents: how often a size class is taken, and how near every target is met."""
    rows = [(1000 * s + k, " ".join(["w"] * n), f"s{s:03d}") for s in range(60) for k, n in enumerate([3, 5, 9, 17, 40, 90, 150, 300] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    taken = mixing.mix(docs).select("doc_id", "size", "target", "copies").collect()
    sizes = docs.select("source", mixing.words_in().alias("size")).withColumn("class", mixing.size_class(F.col("size")))
    e = {(r["r_source"], r["r_class"]): r["copies"] + r["pi"] for r in mixing.rates(sizes).collect()}
    seen, want, words, target = defaultdict(list), {}, Counter(), {}
    for r in taken:
        s = f"s{r['doc_id'] // 1000:03d}"
        kind = (r["doc_id"] // 1000 % 3, r["size"].bit_length())
        seen[kind].append(r["copies"])
        want[kind] = e[s, r["size"].bit_length()]
        words[s] += r["copies"] * r["size"]
        target[s] = r["target"]
    assert len(set(round(w % 1, 6) for w in want.values())) > 12  # unequal inside a source
    for kind, c in seen.items():
        assert np.mean(c) == pytest.approx(want[kind], abs=0.06)
    assert max(abs(words[s] - t) / t for s, t in target.items()) < 0.01


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _run(spark, folder, docs, labels):
    import corpus_pipeline as P

    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return P.run(spark, str(folder))


def test_pipeline_on_an_empty_table_and_clashing_columns(spark, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert _run(spark, tmp_path / "none", spark.createDataFrame([], COLUMNS), labels).count() == 0
    rows = [(i, f"one two three four five {i} six seven eight", "en", "s", 9) for i in range(8)] + [(None, None, None, None, None), (8, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, COLUMNS)
    for c in ("size", "copies", "source_size", "target", "v", "bucket", "h", "key", "score", "predicted", "lang_pred", "length", "uid", "__n", "__u", "class", "extra"):
        docs = docs.withColumn(c, F.lit("clash"))
    assert {r["doc_id"] for r in _run(spark, tmp_path / "clash", docs, labels).collect()} <= set(range(8))


def test_language_stage_rejects_what_fits_no_one_language(spark):
    """Texts of one language stay; texts that go through all four in equal parts go."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    good = docs.join(spark.read.parquet(f"{LARGER}/labels.parquet").where("quality = 1"), "doc_id").collect()
    of = {k: [r["text"][:300] for r in good if r["lang"] == k and len(r["text"]) > 400] for k in ("en", "de", "fr", "es")}
    mixed = [(10**6 + i, " ".join(of[k][i % len(of[k])] for k in of), None, "s", 1) for i in range(20)]
    kept = {r["doc_id"] for r in P.stage_language(spark, docs.union(spark.createDataFrame(mixed, docs.schema)), LARGER).select("doc_id").collect()}
    assert len(kept & {r["doc_id"] for r in good}) >= 0.995 * len(good)
    assert len(kept & {m[0] for m in mixed}) <= 2


def test_pipeline_stage_by_stage(spark, small, tmp_path):
    """run() against plain Python: every stage recomputed on what the one before it kept."""
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    got = _run(spark, tmp_path / "t", docs, labels).collect()
    lang = language_id.train(docs, bucket_of("doc_id", 4) != 2)
    said = {i: tuple(x[0] for x in lang.predict([r["text"].encode() if r["text"] is not None else None])) for i, r in small.items()}
    held = sorted(said[i][1] for i, r in small.items() if zlib.crc32(str(i).encode()) % 4 == 2 and r["lang"] == said[i][0] and r["text"] is not None)
    at = 0.001 * (len(held) - 1)
    least = 0.75 * (held[int(at)] + (held[int(at) + 1] - held[int(at)]) * (at % 1))
    left = {i: r for i, r in small.items() if said[i][0] != "und" and said[i][1] >= least}
    lettered = {i for i, r in small.items() if any(c.isalpha() for c in r["text"] or "")}
    assert left.keys() <= lettered and len(left) >= 0.98 * len(lettered)
    kept = spark.createDataFrame([tuple(r) for r in left.values()], docs.schema)
    model = quality_pu.train(kept, labels, bucket_of("doc_id", 5) != 0)
    left = {i: r for i, r in left.items() if model.scores([r["text"].encode()])[0] >= 0.3}
    group = _links({i: r["text"] for i, r in left.items()})
    left = {i: r for i, r in left.items() if group[i][2]}
    rows = [(i, r["text"], r["source"]) for i, r in left.items()]
    *sources, copies = list(_plain_mix(rows))
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
    behind = {k for *_, b in sources for _, k in b}
    for k, (i, text, _) in enumerate(rows):
        ids = np.array([*lib.encode(text, add_special_tokens=False).ids, 0], "<u4")
        mine = pieces.pop(i, [])
        n = sum(p["length"] for p in mine) / len(ids)
        assert n == copies[k] or (k in behind and n == copies[k] + 1)
        assert all(p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) for p in mine)
    assert not pieces
    at = 0
    for p in sorted(got, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["sequence_id"] * 1024 + p["offset"] == at and p["offset"] + p["length"] <= 1024
        at += p["length"]
