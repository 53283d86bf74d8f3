"""Every operator over awkward tables: nulls, empty and long texts, ties, repeated rows, clashing extra columns, no rows."""

import random
import re
import textwrap
import zlib
from collections import Counter
from functools import partial

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from foliowright.llm import embedding_dedup, language_id, license_scan, minhash_dedup, mixing, packing, quality_pu, quality_rules, sharding, token_count
from foliowright.llm.common import bucket_of, connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, n_words long, kept boolean, part int"
WORDS = "the quick brown fox jumps over a lazy dog while eleven grey owls watch from tall old trees near water".split()
LONG = " ".join(WORDS[i * 7 % len(WORDS)] + str(i // 19) for i in range(400))


def _rows():
    base = " ".join(WORDS * 3 + [f"w{i}" for i in range(60)])
    near = base.replace("w7 ", "other ")
    rows = [(1, base), (2, base), (3, near), (4, ""), (5, None), (6, " \n\t "), (7, LONG * 20), (8, "short MIT License text"), (8, "short MIT License text"), (None, "no id here"), (9, "123 456 !!"), (10, "Licensed under CC BY-NC 4.0\nmit license, the Apache License")]
    rows += [(20 + i, base.upper()) for i in range(30)]
    return [(i, t, None if i == 3 else "en" if (i or 0) % 2 else "fr", None if i == 6 else f"s{(i or 0) % 4}", 1, 7, 8, False, 9) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_license_scan(docs, none):
    got = license_scan.digest(license_scan.license_scan(docs)).collect()
    assert len(got) == len(_rows())
    ten = next(r for r in got if r["doc_id"] == 10)
    assert (ten["n_base"], ten["base_labels"], ten["labels"]) == (2, "apache,mit", "apache,cc-by-nc,mit")
    assert (ten["first_word"], ten["last_word"]) == (7, 10)
    assert next(r for r in got if r["doc_id"] == 5)["first_word"] is None
    assert license_scan.digest(license_scan.license_scan(none)).count() == 0


def test_license_notices_wrapped_over_lines(spark):
    """Every long template is found when its notice is wrapped, also behind comment marks, and twice when it stands twice."""
    long = [(label, t) for label, t in license_scan.TEMPLATES if len(t) > 72]
    assert {"mit", "bsd", "isc", "gpl", "mpl"} <= {label for label, _ in long}
    made = [f"int a;\n{lead}" + f"\n{lead}".join(textwrap.wrap(t, 72 - len(lead))) + "\nint b;" for lead in ("", " * ") for _, t in long]
    rows = [*enumerate(made), (90, made[0] + "\n" + made[0]), (91, "int a;\n" * 9)]
    got = {r["doc_id"]: r for r in license_scan.digest(license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for i in range(len(made)):
        label = long[i % len(long)][0]
        assert label in got[i]["labels"].split(",") and got[i]["score"] == 1.0 and got[i]["n_blocks"] >= 1
    assert (got[90]["labels"], got[90]["n_blocks"], got[90]["score"]) == ("mit", 2, 1.0)
    assert (got[91]["labels"], got[91]["n_blocks"], got[91]["score"]) == ("", 0, 0.0)


def test_license_names_and_one_line_texts(spark):
    """A short notice needs the words that name its license, close together."""
    far = " ".join(["word"] * 30)
    rows = [
        (1, "Released under the Apache License 2.0", "apache", 1.0),
        (2, "Released under the BSD License", "", 0.0),
        (3, f"They released a film {far} under {far} the rug without a license", "", 0.0),
        (4, f"MIT {far} released {far} under the {far} license", "", 0.0),
        (5, "Papers released by MIT under the old rule", "", 0.0),
        (6, "Licensed under CC BY 4.0", "", 0.0),
        (7, "Licensed under CC BY-SA 4.0", "cc-by-sa", 1.0),
        (8, "Licensed under CC BY-NC 4.0", "cc-by-nc", 1.0),
        (9, "This library is licensed under the GNU Lesser General Public License", "gpl,lgpl", 1.0),
        (10, f"{far} This is released under the terms of the MIT License {far}", "mit", 1.0),
        (11, "Released under MIT-style license", "mit", 0.8),
    ]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.digest(license_scan.license_scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"))).collect()}
    assert got == {i: (labels, score) for i, _, labels, score in rows}


def test_token_counts(docs, none):
    path = public_tokenizers.path(token_count.VOCABULARY)
    got = token_count.token_counts(docs, path).collect()
    assert len(got) == len(_rows()) and next(r for r in got if r["doc_id"] == 5)["n_tokens"] == 0
    assert token_count.token_counts(none, path).count() == 0


def test_language_id(spark, docs, none):
    model = language_id.train(docs, bucket_of("doc_id", 4) != 2, steps=3)
    assert model.labels == ["en", "fr"]
    got = {r["doc_id"]: r for r in language_id.language_id(docs, model).collect()}
    assert got[5]["lang_pred"] == got[9]["lang_pred"] == got[4]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    empty = language_id.train(none, bucket_of("doc_id", 4) != 2)
    assert language_id.language_id(docs, empty).where("lang_pred <> 'und'").count() == 0
    assert language_id.language_id(none, model).count() == 0


def test_quality(spark, docs, none):
    labels = _labels(spark, [(1, 1, 0), (1, 1, 0), (3, 0, 0), (None, 1, 0), (7, None, 0), (22, 1, 0), (24, 1, 1)])
    model = quality_pu.train(docs, labels, bucket_of("doc_id", 5) != 0)
    got = quality_pu.quality_scores(docs, model).collect()
    assert len(got) == len(_rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    bare = quality_pu.train(none, _labels(spark, []), bucket_of("doc_id", 5) != 0)
    assert quality_pu.quality_scores(none, bare).count() == 0 and quality_pu.quality_scores(docs, bare).count() == len(_rows())


def test_quality_rules(docs, none):
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    assert got[5]["n_words"] == 0 and got[5]["base_failed"] and not got[5]["kept"]
    assert got[7]["word_chars"] == sum(len(w) for w in re.findall(r"\S+", LONG * 20))
    assert quality_rules.quality_rules(none).count() == 0


def test_few_distinct_votes_on_long_texts(spark):
    rng = random.Random(3)
    draw = lambda n, k: " ".join(f"w{rng.randrange(k)}" for _ in range(n))
    rows = [(n, draw(n, 150)) for n in (999, 1000, 1001, 1500, 12000)] + [(-n, draw(n, 5000)) for n in (999, 1001, 12000)]
    at = next(i for i, r in enumerate(quality_rules.RULES) if r[0] == "few_distinct")
    got = {r["doc_id"]: r["votes"][at] for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: "0" if i > 0 else "1" for i, _ in rows}


def test_quality_rules_of_other_scripts(spark):
    """Rules on capitals and ASCII marks don't apply to a script that has neither; such texts are kept like the others."""
    words = lambda seed, letters: " ".join("".join(random.Random(seed * 999 + i).choices(letters, k=5)) for i in range(80))
    latin = [(i, ". ".join(x.capitalize() for x in textwrap.wrap(words(i, "abcdefghijklmnop"), 40)) + ".") for i in range(60)]
    rows = latin + [(100 + i, words(i, "เกมรถคนดีมาก")) for i in range(60)] + [(200 + i, words(i, "abc#*$%&")) for i in range(40)]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {r["votes"][1] + r["votes"][6] + r["votes"][4] + r["votes"][7] for i, r in got.items() if 100 <= i < 200} == {"3333"}
    assert all(r["kept"] == (i < 200) for i, r in got.items())


def test_sharding_of_repeated_rows(spark):
    """Rows that share id and text are most of the corpus: bytes stay near equal, slots gapless."""
    rows = [(1, "a b c d e f g h")] * 8000 + [(None, "x y z")] * 500 + [(10 + i, f"lone text {i}") for i in range(1000)]
    got = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    held = Counter()
    for r in got:
        held[r["shard"]] += r["size"]
    assert len(got) == len(rows) and max(held.values()) - min(held.values()) <= 0.02 * sum(held.values()) / 8
    for s in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_sharding(docs, none):
    got = sharding.shards(docs).collect()
    assert len(got) == len(_rows())
    for s in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert next(r for r in got if r["doc_id"] == 5)["size"] == 1 and next(r for r in got if r["doc_id"] == 1)["text_crc32"] == zlib.crc32(_rows()[0][1].encode())
    assert sharding.shards(none).count() == 0


def _brute(rows):
    sets = {}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in rows:
        if i is not None:
            w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(low))
            sets[i] = frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])
    comp = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(comp[a], comp[b])
            if comp[a] != m or comp[b] != m:
                comp[a] = comp[b] = m
                changed = True
    return {i: (len(s), comp[i], comp[i] == i) for i, s in sets.items()}


def test_minhash_against_brute_force(docs, none):
    got = minhash_dedup.minhash_groups(docs).collect()
    want = _brute([(r[0], r[1]) for r in _rows()])
    assert len(got) == len(_rows())
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == want[r["doc_id"]]
    assert minhash_dedup.minhash_groups(none).count() == 0


def test_minhash_large_groups_in_blocks(spark, monkeypatch):
    """Small limits send a near-copy group with an outlier through branching, blocks and wanderers."""
    monkeypatch.setattr(minhash_dedup, "LEAF", 6)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(40):
        w = list(base)
        w[i * 3 % 120] = f"x{i}"
        rows.append((i, " ".join(w)))
    chain = list(base)
    for k in (10, 40, 70, 100):
        chain[k] = f"y{k}"
    rows.append((90, " ".join(chain)))
    for k in (12, 55):
        chain[k] = f"z{k}"
    rows.append((91, " ".join(chain)))
    got = minhash_dedup.minhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = _brute(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == want


def test_minhash_rows_that_share_an_id(spark):
    """Each text of an id is linked by its own set; the pipeline drops only those that are equal or linked."""
    import corpus_pipeline as P

    text = lambda c, *new: " ".join([*(f"{c}{i}" for i in range(80)), *new])
    rows = [(3, text("a")), (5, text("a", "x")), (5, text("b")), (5, text("c")), (9, text("b", "y")), (7, text("c", "z")), (8, text("d")), (8, text("e")), (8, text("e", "w")), (None, text("a"))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = minhash_dedup.minhash_groups(docs).select("doc_id", "component_id", "kept").collect()
    want = [(3, 3, True), (5, 3, False), (5, 5, True), (5, 5, True), (9, 5, False), (7, 5, False), (8, 8, True), (8, 8, True), (8, 8, True), (None, None, True)]
    assert Counter(map(tuple, got)) == Counter(want)
    left = [(r["doc_id"], r["text"]) for r in P.stage_near_dedup(spark, docs, "").collect()]
    assert len(left) == len(set(left)) == 6
    assert {rows[0], rows[2], rows[3], rows[6], rows[9]} < set(left) and len({rows[7], rows[8]} & set(left)) == 1


def test_every_node_branches(spark):
    """No node draws an empty set of positions, and equal signatures stay together."""
    reps = spark.createDataFrame([(r, [7 * k for k in range(minhash_dedup.POSITIONS)]) for r in (1, 2)], "rep long, sig array<int>")
    members = spark.range(300).select(F.col("id").alias("node"), F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("rep"))
    got = {}
    for r in minhash_dedup._branch(members, reps).collect():
        got.setdefault(r["rep"], set()).add(r["node"])
    assert got[1] == got[2] and len(got[1]) >= 300


def test_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 200), (200, 150), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 150: 100, 200: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def test_embedding_links(spark):
    rng = np.random.default_rng(1)
    centre = rng.standard_normal((12, 6))
    rows = [(int(i), [float(v) for v in centre[i % 12] + 0.1 * rng.standard_normal(6)], 0) for i in range(80)]
    rows += [(80, rows[3][1], 0), (81, rows[3][1], 1), (82, None, 0), (83, [0.0] * 6, 0), (84, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (85, [float("nan")] * 6, 0), (86, [1.0], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int")
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_links(df).collect()}
    fine = [(i, np.array(e)) for i, e, _ in rows[:82]]
    x = np.array([e / np.linalg.norm(e) for _, e in fine])
    s = x @ x.T >= 0.95
    for k, (i, _) in enumerate(fine):
        assert got[i]["n_links"] == s[k].sum() - 1
        seen, todo = {k}, [k]
        while todo:
            for j in np.flatnonzero(s[todo.pop()]):
                if j not in seen:
                    seen.add(int(j))
                    todo.append(int(j))
        assert got[i]["component_id"] == min(fine[j][0] for j in seen)
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (82, 83, 84, 85, 86)) and got[None]["component_id"] is None
    assert embedding_dedup.embedding_links(df.limit(0)).count() == 0


def test_embedding_links_of_each_length(spark):
    """Two models' vectors in one table: every length is joined, unequal lengths never are."""
    rng = np.random.default_rng(3)
    rows = []
    for dim, n in ((6, 40), (3, 20), (1, 2), (9, 1)):
        centre = rng.standard_normal((n // 4 + 1, dim))
        rows += [(len(rows) + i, [float(v) for v in centre[i % len(centre)] + 0.1 * rng.standard_normal(dim)]) for i in range(n)]
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    unit = [np.array(e) / np.linalg.norm(e) for _, e in rows]
    near = {i: {j for j, _ in rows if len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95} for i, _ in rows}
    assert len(got) == len(rows) and sum(len(near[i]) - 1 for i in range(40, 60)) > 0
    for i, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            fresh = near[todo.pop()] - seen
            seen |= fresh
            todo += fresh
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(near[i]) - 1, min(seen), min(seen) == i)


def test_cells_keep_every_pair(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL", 20)
    monkeypatch.setattr(embedding_dedup, "TILE", 16)
    rng = np.random.default_rng(2)
    x = np.repeat(rng.standard_normal((30, 5)), 8, axis=0) + 0.12 * rng.standard_normal((240, 5))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    u = np.array(df.orderBy("vec_id").toPandas()["embedding"].tolist())
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = (u @ u.T >= 0.95).sum(1) - 1
    assert [r["n_links"] for r in embedding_dedup.embedding_links(df).orderBy("vec_id").collect()] == want.tolist()


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(_rows()) and sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert sum({(r["source_size"], r["target"]) for r in got} and {round(r["target"], 6): r["target"] for r in got}.values()) > 0
    assert mixing.mix(none).count() == 0


def test_targets_fill_by_weight(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, "d": 4, None: 700}
    rows = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
    weight = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True))
    want, open_, left = {}, set(sizes), float(sum(sizes.values()))
    while True:
        share = {k: left * weight[k] / sum(weight[j] for j in open_) for k in open_}
        over = [k for k in open_ if share[k] >= 3 * sizes[k]]
        if not over:
            want |= share
            break
        for k in over:
            want[k] = 3.0 * sizes[k]
            left -= want[k]
            open_.remove(k)
    assert {k: round(v, 6) for k, v in got.items()} == {k: round(v, 6) for k, v in want.items()}


def test_packing_round_trip(docs, none):
    path = public_tokenizers.path(packing.VOCABULARY)
    got = packing.packed(docs, path).collect()
    enc = packing.Encoder(path)
    want = Counter((i, tuple([*enc.ids(t.encode() if t else None).tolist(), 0])) for i, t, *_ in _rows())
    total = sum(len(k[1]) * n for k, n in want.items())
    assert sum(r["length"] for r in got) == total
    spans = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    at = 0
    for s, o, n in spans:
        assert s * 1024 + o == at and o + n <= 1024
        at += n
    ids = {i: np.array(k, "<u4") for i, k in want}
    for r in got:
        x = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(x) and zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    assert packing.packed(none, path).count() == 0


def test_pipeline_stages(spark, docs, tmp_path, monkeypatch):
    import corpus_pipeline as P

    monkeypatch.setattr(language_id, "train", partial(language_id.train, steps=3))  # letters alone decide
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    _labels(spark, [(i, 1, 0) for i in (1, 2, 3, 7, 21, 22)] + [(8, 0, 0)]).write.parquet(f"{tmp_path}/labels.parquet")
    seen = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["language_id", "quality_classifier", "minhash_near_dedup", "mixing", "packing"]
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, seen, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "packing":
            assert out.columns == list(P.COLUMNS)
        if name == "language_id":
            assert {r[0] for r in out.select("doc_id").collect()} == {1, 2, 3, 7, 8, None, 10, *range(20, 50)}
        if name == "minhash_near_dedup":
            ids = [r[0] for r in out.select("doc_id").where("doc_id IS NOT NULL").collect()]
            assert len(ids) == len(set(ids)) and not {2, 3, 20} & set(ids)
        seen = out
    assert seen.agg(F.sum("length")).first()[0] > 0
