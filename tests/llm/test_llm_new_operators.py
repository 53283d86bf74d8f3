"""Source divergence, hard negatives and archives against plain Python, over awkward rows."""

import base64
import gzip
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliowright.llm import archives, divergence, hard_negatives

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _divergence(rows, min_docs, top):
    """The contract in plain Python; rows of (text, lang, source)."""
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER)), lang or "", src or "") for t, lang, src in rows]
    out = []
    for lang in {d[1] for d in docs}:
        mine = [d for d in docs if d[1] == lang]
        df = Counter(w for ts, *_ in mine for w in set(ts))
        kept = sorted(w for w in df if df[w] >= min_docs)
        count = defaultdict(Counter)
        for ts, _, src in mine:
            count[src].update(w for w in ts if df[w] >= min_docs)
        every = sum(count.values(), Counter())

        def shares(c, kept=kept):
            n = sum(c.values())
            return {w: 1 + 1000000000 * (c[w] + 5) // (n + 5 * len(kept)) for w in kept}

        q = shares(every)
        p = {src: shares(c) for src, c in count.items()}
        for src in p:
            pair = sorted((-sum(abs(p[src][w] - p[o][w]) for w in kept), o.encode(), o) for o in p if o != src)
            term = sorted((q[w] - p[src][w], w.encode(), w) for w in kept if count[src][w] and p[src][w] > q[w])[:top]
            out += [(lang, src, part, i, -v, r + 1) for part, found in (("pair", pair), ("term", term)) for r, (v, _, i) in enumerate(found)]
    return sorted(out)


def test_divergence(spark):
    long = "Ärger ärger zebra " * 20_000
    rows = [("The the CAT sat", "en", "a"), ("the dog İ the", "en", "b"), ("cat dog\x00cat", "en", None), (None, "en", "c"), ("123 !!", None, None), ("", None, "é"), (long, "de", "a"), ("zebra Ärger", "de", "\U0001f600"), ("zebra", "de", "￮")]
    rows += [("the dog İ the", "en", "b")] * 3
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "text string, lang string, source string, n long, term string, value int").repartition(3)
    for least, top in ((1, 50), (2, 1), (3, 2), (99, 50)):
        got = sorted(tuple(r) for r in divergence.divergence(df, least, top).collect())
        assert got == _divergence(rows, least, top)
    assert divergence.divergence(df.limit(0)).count() == 0


def test_terms_are_those_of_the_stated_pattern(spark):
    """Both patterns agree on every character that a text may hold."""
    step = 64
    rows = [("\x00".join(chr(c) + "A" for c in range(a, a + step) if not 0xD800 <= c < 0xE000),) for a in range(0, 0x3000, step)] + [("\U0001f600a\U0010ffff\ud7ff\ue000 \x7f\x80",), ("",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    both = [F.regexp_extract_all("t", F.lit(p), F.lit(0)).alias(n) for n, p in (("a", divergence.TERM), ("b", divergence._SAME))]
    assert all(r["a"] == r["b"] for r in df.select(*both).collect())


def test_divergence_of_counts_beyond_64_bits(spark):
    n, total = 10**17, 9 * 10**17
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(7)).alias("p")).first()["p"]
    assert got == 1 + 1000000000 * (n + 5) // (total + 35)


def _negatives(rows):
    """The contract in plain Python; rows of (vec_id, embedding, label)."""
    v = []
    for vec, e, label in rows:
        if label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        v.append((vec, (label + 1) % 10 if vec is not None and vec % 7 == 0 else label, [math.floor(256 * x) for x in e]))
    out = []
    for a, (vec, label, e) in enumerate(v):
        if vec is None or vec % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(e, f)), w is None, w or 0, lab) for b, (w, lab, f) in enumerate(v) if b != a]
        for p, missing, pos, _ in sorted(x for x in scored if x[3] == label)[:5]:
            fit = sorted(x for x in scored if x[3] != label and -80 * p <= -100 * x[0] <= -100 * p)[:5]
            out += [(vec, None if missing else pos, r + 1, None if n[1] else n[2], -p, -n[0]) for r, n in enumerate(fit)]
    return sorted(out, key=str)


@pytest.mark.parametrize("tile, chunk", [(8, 3), (512, 32)])
def test_hard_negatives(spark, tile, chunk):
    """Several tiles and chunks, labels with and without blocks of their own, ties, copies, odd vectors."""
    rng = random.Random(3)
    center = [[rng.uniform(-1, 1) for _ in range(7)] for _ in range(6)]
    rows = [(i, [c + rng.choice((0.0, 0.05, 0.2)) for c in center[i * i % 6]], rng.choice((1, 1, 1, 2, 3, 9))) for i in range(0, 1400, 2)]
    rows += [(i, [1.0, 0.5], 4) for i in range(7, 12)] + [(400, [1.0, 0.5, 0.25], 4), (500, [], 4), (600, [-1.0] * 7, 8)]
    rows += [(200, rows[100][1], 1), (200, rows[100][1], 1), (None, rows[100][1], 2), (None, rows[50][1], 1)]
    rows += [(700, None, 1), (800, [1.0, float("nan")], 1), (900, [1.0, None], 1), (1000, [float("inf")], 1), (1100, [1.0], None)]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, embedding array<float>, label int, score long, uid string").repartition(3)
    exact = [(i, None if e is None else [None if x is None else float(np.float32(x)) for x in e], lab) for i, e, lab in rows]
    want = _negatives(exact)
    assert len(want) > 50
    assert sorted((tuple(r) for r in hard_negatives.hard_negatives(df, tile=tile, chunk=chunk).collect()), key=str) == want
    if tile == 512:
        assert hard_negatives.hard_negatives(df.limit(0)).count() == 0
        assert hard_negatives.hard_negatives(df.where("vec_id % 100 <> 0")).count() == 0


def test_score_tiles_of_large_components():
    a, r = np.full((3, 40), 1 << 26), np.full((2, 40), -(1 << 26))
    tile = hard_negatives.partial_tile(a, r)
    assert (tile == -40 * (1 << 52)).all()
    assert (hard_negatives.from_planes(hard_negatives.planes(tile), 3) == tile).all()


def _archived(spark, df, folder, **kw):
    archives.write_arc(df, f"{folder}/arc")
    archives.convert(spark, f"{folder}/arc", f"{folder}/warc", **kw)
    return archives.read_warc(spark, f"{folder}/warc")


def test_archives_of_pages(spark, tmp_path):
    """A full round trip over awkward pages: every payload comes back, one response a payload, the rest revisits."""
    trap = "<p>x</p>\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\nhttp://a 0.0.0.0 20000101000000 text/html 5\nHTTP/1.1 200 OK\r\n\r\nX-Page-Id: 5"
    rows = [(9, "http://a/ b", "same"), (4, "http://b", "same"), (7, None, None), (8, "", ""), (1, "http://c\n\t", trap), (2, "http://ü", "é\x00\U0001f600" * 50_000), (None, "http://n", "same"), (None, None, "lone")]
    rows += [(3, "http://r", "twice"), (3, "http://r", "twice")] + [(100 + i, "http://hot", "hot payload") for i in range(400)] + [(600 + i, "http://u", f"<p>{i}") for i in range(300)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, payload_bytes long, record_type string").repartition(4)
    got = [r for r in _archived(spark, df, tmp_path).collect()]
    assert all(r["intact"] for r in got) and len({r["record_id"] for r in got}) == len(got)
    infos = [r for r in got if r["record_type"] == "warcinfo"]
    assert len(infos) == 4
    got = [r for r in got if r["record_type"] != "warcinfo"]
    known = lambda i, h: (str(i), len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode())
    assert Counter((str(r["page_id"]), r["payload_bytes"], r["payload_digest"]) for r in got) == Counter(known(i, h) for i, _, h in rows)
    first = {}
    for i, _, h in rows:
        first[h or ""] = min(first.get(h or "", math.inf), math.inf if i is None else i)
    for digest in {r["payload_digest"] for r in got}:
        same = [r for r in got if r["payload_digest"] == digest]
        whole = [r for r in same if r["record_type"] == "response"]
        assert len(whole) == 1 and whole[0]["refers_to"] is None
        text = next(h or "" for _, _, h in rows if known(0, h)[2] == digest)
        assert (whole[0]["page_id"] if whole[0]["page_id"] is not None else math.inf) == first[text]
        assert all(r["record_type"] == "revisit" and r["refers_to"] == whole[0]["page_id"] for r in same if r is not whole[0])
    uris = {r["page_id"]: r["uri"] for r in got}
    assert (uris[9], uris[7], uris[1]) == ("http://a/%20b", "urn:page:7", "http://c%0A%09")
    assert {r["date"] for r in got} == {"2000-01-01T00:00:00Z"}


def test_archives_least_size_and_no_pages(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    got = {r["page_id"]: r["record_type"] for r in _archived(spark, df, tmp_path / "a", least=3).where("record_type <> 'warcinfo'").collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    assert _archived(spark, df.limit(0), tmp_path / "b").where("record_type <> 'warcinfo'").count() == 0


def test_old_archives(spark, tmp_path):
    """Both versions as they are found: odd header lines, damage, truncation, members, other schemes."""
    http = b"HTTP/1.0 200 OK\nServer: x\n\n<p>hello</p>"
    block1 = b"1 1 Alexa\nURL IP-address Archive-date Content-type Archive-length\n<xml/>\n"
    one = [
        b"filedesc://old.arc 0.0.0.0 19961022 text/plain %d\n" % len(block1) + block1,
        b"http://a/x y 1.2.3.4 19961022103000 text/html; charset=x %d\n" % len(http) + http,
        b"http://short/ 1.2.3.4 1996102210 text/html %d\n" % (len(http) - 4) + http,  # four bytes more than declared
        b"dns:a 1.2.3.4 19969999 text/dns 7\na 1.2.3",
        b"ftp://a/f 1.2.3.4 19961022103000 application/x 3\nabc",
        b"http://end/ 1.2.3.4 19961022103000 text/html 999\n" + http,
    ]
    block2 = b"2 0 x\n" + archives.FIELDS[2] + b"\n"
    two = [
        b"filedesc://new.arc 0.0.0.0 20010203040506 text/plain 200 - - 0 new.arc %d\n" % len(block2) + block2,
        b"http://b/ 1.2.3.4 20010203040506 text/html 404 abc http://c/ 120 new.arc %d\n" % len(http) + http,
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.arc").write_bytes(b"\n".join(one))
    (tmp_path / "in/2.arc.gz").write_bytes(b"".join(gzip.compress(r + b"\n") for r in two))
    (tmp_path / "in/3.arc.gz").write_bytes(gzip.compress(b"\n".join(two))[:-30])
    (tmp_path / "in/4.arc").write_bytes(b"\x00junk\n" * 9)
    (tmp_path / "in/5.arc").write_bytes(b"")
    found = list(archives.arc_records(archives.Source(b"\n".join(one))))
    assert [r["version"] for r in found] == [1] * 6 and [r["skipped"] for r in found] == [0, 0, 0, 5, 0, 0] and [r["truncated"] for r in found] == [False] * 5 + [True]
    new = list(archives.arc_records(archives.Source(b"\n".join(two))))
    assert (new[1]["status"], new[1]["version"], new[1]["block"]) == (404, 2, http)
    archives.convert(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    got = {r["uri"]: r for r in archives.read_warc(spark, str(tmp_path / "out")).collect() if r["path"] and r["uri"]}
    assert {u: r["record_type"] for u, r in got.items() if u != "http://b/"} == {"http://a/x y": "response", "http://short/": "response", "dns:a": "resource", "ftp://a/f": "resource", "http://end/": "response"}
    assert (got["http://a/x y"]["date"], got["http://short/"]["date"], got["dns:a"]["date"]) == ("1996-10-22T10:30:00Z", "1996-10-22T10:00:00Z", "1996-12-28T00:00:00Z")
    assert got["http://a/x y"]["payload_digest"] == archives.sha1(b"<p>hello</p>") and got["http://a/x y"]["payload_bytes"] == 12
    assert all(r["intact"] for r in got.values())
