"""Hard negatives, archives and phrases against brute-force versions, on small tables with nulls, ties, copies and odd columns."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from heatloom.llm import negatives, phrases, warc

TEXTS = "doc_id long, text string, lang string, a int, phrase string, cut int, n int"


def text_rows(n=400, seed=5):
    rng = random.Random(seed)
    words = ["New", "york", "city", "é", "naïve", "a b", "你好", "of", "the", "x-y"]
    out = [(None, None, "en"), (1, "", None), (2, ".,;:!?\n\x0b\x0c\r", "de"), (3, "one", "en"), (3, "one", "en"), (4, "new york city new york city " * 2000, "und")]
    for i in range(n):
        parts = [rng.choice(["new york city", "New York", "of the", rng.choice(words), " ".join(rng.choices(words, k=rng.randint(1, 9)))]) for _ in range(rng.randint(0, 12))]
        out.append((i + 5, "".join(p + rng.choice([" ", "\t", "  ", ". ", ",", "\n", "\r\n", "\x0b"]) for p in parts), rng.choice(["en", "en", "de", None])))
    return [(*r, 1, "p", 2, 3) for r in out]


def brute_phrases(rows, longest, least, top, cover):
    count, total = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            own = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(own)
            for k in range(1, longest + 1):
                count.update((lang, tuple(own[i : i + k])) for i in range(len(own) - k + 1))
    known = {g: n for g, n in count.items() if len(g[1]) > 1 and n >= least}
    out = {}
    for (lang, g), a in known.items():
        inside = lambda h: any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))
        if any(x == lang and len(h) > len(g) and inside(h) and 100 * b >= cover * a for (x, h), b in known.items()):
            continue
        score, k = min((1000 * a * total[lang] // (count[lang, g[:k]] * count[lang, g[k:]]), k) for k in range(1, len(g)))
        out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), count[lang, g[:k]], count[lang, g[k:]], total[lang]))
    return {(lang, i, p.decode(), -a, x, y, n, -s) for lang, own in out.items() for i, (s, a, p, x, y, n) in enumerate(sorted(own)[:top], 1)}


@pytest.mark.parametrize(("longest", "least", "top", "cover"), [(5, 20, 30, 100), (3, 5, 2000, 60), (2, 10**9, 5, 100)])
def test_phrases(spark, monkeypatch, longest, least, top, cover):
    rows = text_rows()
    docs = spark.createDataFrame(rows, TEXTS).repartition(3)
    monkeypatch.setattr(phrases, "SLICE_BYTES", 2000)
    got = phrases.mine_phrases(docs, longest=longest, least=least, top=top, cover=cover)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute_phrases(rows, longest, least, top, cover)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert phrases.mine_phrases(docs.where("false")).collect() == []


def test_phrases_with_a_full_filter_stay_exact(spark, monkeypatch):
    rows = text_rows(100)
    monkeypatch.setattr(phrases, "has_bits", lambda bits, places: __import__("numpy").ones(len(places), bool))
    got = phrases.mine_phrases(spark.createDataFrame(rows, TEXTS), least=10)
    assert {tuple(r) for r in got.collect()} == brute_phrases(rows, 5, 10, 2000, 100)


def test_phrase_scores_pass_64_bits(spark):

    from heatloom.llm.common import join_hot

    big = spark.range(1).select(F.expr("cast(1000 as decimal(38,0)) * cast(4000000000000 as decimal(38,0)) * cast(9000000000000 as decimal(38,0)) div (cast(5000000000000 as decimal(38,0)) * cast(4000000000001 as decimal(38,0)))"))
    assert big.first()[0] == 1000 * 4000000000000 * 9000000000000 // (5000000000000 * 4000000000001)
    left = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(9000)] + [(10 + i, -i) for i in range(500)], "k long, v long")
    right = spark.createDataFrame([(i, i * 10) for i in range(400)], "k long, w long")
    assert sorted(map(tuple, join_hot(left, right, ["k"]).collect())) == sorted(map(tuple, left.join(right, "k").select("k", "v", "w").collect()))


VECTORS = "vec_id long, embedding array<double>, label int, key long, x string, asks boolean"


def vector_rows(n=700, seed=2, dim=6, spread=0.1):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(12)]
    out = [(None, [1.0] * dim, 1), (9001, None, 1), (9002, [float("nan")] * dim, 1), (9003, [1.0, None], 1), (9004, [float("inf")], 2), (9100, [], 1), (9200, [0.5], 2), (9005, [1.0] * dim, None)]
    for i in range(n):
        c = rng.choice(centres)
        out.append((i, [round(v + rng.gauss(0, spread), 3) for v in c], 1 if rng.random() < 0.4 else rng.randrange(5)))
    out += [(1000 + i, out[20][1], i % 3) for i in range(60)] + [out[30], out[30], (100, out[40][1], 4)]
    return [(*r, 5, "x", True) for r in out]


def brute_negatives(rows, is_anchor, positives, k, low, high, scale):
    import math

    ok = [(i, lab, [math.floor(v * scale) for v in x]) for i, x, lab, *_ in rows if i is not None and lab is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    out = []
    for a, lab, x in ok:
        if not is_anchor(a):
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, other) for i, other, y in ok)
        for s, p, _ in [t for t in scored if t[2] == lab and t[1] != a][:positives]:
            fits = [t for t in scored if t[2] != lab and low * -s <= 100 * -t[0] <= high * -s][:k]
            out += [(a, p, r, t[1], -s, -t[0]) for r, t in enumerate(fits, 1)]
    return Counter(out)


@pytest.mark.parametrize(("tree", "block", "leaf", "anchors", "tile", "scored", "scale"), [(65536, 4096, 64, 32768, 1024, 1024, 256.0), (200, 64, 4, 16, 8, 16, 8.0), (128, 16, 1, 5, 3, 1, 40_000_000.0)])
def test_hard_negatives(spark, monkeypatch, tree, block, leaf, anchors, tile, scored, scale):
    for name, value in {"TREE": tree, "BLOCK": block, "LEAF": leaf, "ANCHORS": anchors, "TILE": tile, "SCORED": scored}.items():
        monkeypatch.setattr(negatives, name, value)
    rows = vector_rows()
    vectors = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = negatives.hard_negatives(vectors, F.col("vec_id") % 10 == 0, scale=scale)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(tuple(r) for r in got.collect()) == brute_negatives(rows, lambda i: i % 10 == 0, 5, 10, 30, 90, scale)
    if scale == 8.0:
        one, two = negatives.work(vectors, F.col("vec_id") % 10 == 0, scale=scale)
        assert 0 < one[1] < one[0] / 3 and 0 < two[1] < two[0] / 3
        assert negatives.hard_negatives(vectors.where("false"), F.lit(True)).collect() == [] == negatives.hard_negatives(vectors, F.lit(False)).collect()
        with pytest.raises(ValueError):
            negatives.hard_negatives(vectors, F.lit(True), scale=1e12)
        with pytest.raises(TypeError):
            negatives.hard_negatives(vectors.withColumn("label", F.lit("a")), F.lit(True))


def test_percent_of_scores_is_exact():
    import numpy as np

    s = np.array([0, 1, 3, 7, -7, 99, 100, 101, 2**62, -(2**62), 333_333_333_333_333_333], np.int64)
    low, high = negatives.percent(s, 30, 90)
    assert low.tolist() == [-(-30 * int(v) // 100) for v in s] and high.tolist() == [90 * int(v) // 100 for v in s]


def page_rows():
    rng = random.Random(1)
    long = "".join(rng.choice("abc é\r\n") for _ in range(3000))
    out = [(1, "http://a/x y\r\nz", "one"), (2, None, "one"), (3, "http://b/", None), (4, "u", ""), (5, "u", long), (6, "v", long), (7, "w", long + "."), (None, "n", "none"), (None, "n2", "none"), (8, "é", "WARC/1.1\r\n\r\nHTTP/1.1\r\n\r\n"), (9, "d", "twin"), (9, "e", "twin"), (10, "f", "x" * 64), (11, "g", "ab")]
    return [(*r, 7, b"d", "s") for r in out]


PAGES = "page_id long, url string, html string, record long, data binary, sha1 string"


def expected_records(rows, least):
    import base64
    import hashlib

    best = {}
    for i, _, h, *_ in rows:
        best[h or ""] = max(best.get(h or "", (False, 0)), (i is not None, i or 0))
    out, seen = [], set()
    for i, _, h, *_ in rows:
        h = h or ""
        first = len(h.encode()) < least or ((i is not None, i or 0) == best[h] and h not in seen)
        seen |= {h} if first else set()
        out.append((i, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if first else "revisit", None if first or not best[h][0] else best[h][1]))
    return Counter(out)


@pytest.mark.parametrize(("chunk", "least"), [(warc.CHUNK_BYTES, 0), (64, 0), (7, 4)])
def test_archive_round_trip(spark, tmp_path, chunk, least):
    rows = page_rows()
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    warc.write_archive(pages, f"{tmp_path}/a", min_bytes=least, chunk_bytes=chunk)
    archive = spark.read.parquet(f"{tmp_path}/a")
    assert archive.where(F.length("data") > chunk).count() == 0
    got = warc.read_records(archive)
    fields = ["id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert Counter(tuple(r) for r in got.select(*fields).collect()) == expected_records(rows, least)
    assert got.where("not intact").count() == 0 and {r.url for r in got.where("id = 1").collect()} == {"http://a/x%20y%0D%0Az"}
    payloads = {}
    for r in warc.read_payloads(archive).orderBy("record", "chunk").collect():
        payloads[r.id] = payloads.get(r.id, b"") + bytes(r.data)
    want = {i: h.encode() for i, _, h, *_ in rows if h}
    assert payloads and all(payloads[i] == want[i] for i in payloads) and payloads[7] == want[7]
    # as files and back
    (tmp_path / "files").mkdir()
    names = warc.export_files(archive, f"{tmp_path}/files")
    again = warc.read_records(warc.import_files(spark, [f"{tmp_path}/files/{n}" for n in names], chunk))
    assert Counter(tuple(r) for r in again.select(*fields).collect()) == expected_records(rows, least)
    import gzip

    raw = gzip.open(f"{tmp_path}/files/{names[0]}").read()
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: ") and raw.endswith(b"\r\n\r\n")


def test_archive_of_others_and_of_nothing(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nhello"
    raw = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\n\r\na: b\n\r\n\r\n"
    raw += b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha1:AAAA\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    (tmp_path / "x.warc").write_bytes(raw)
    info, page = warc.read_records(warc.import_files(spark, [f"{tmp_path}/x.warc"])).orderBy("record").collect()
    assert (info.record_type, info.payload_bytes, info.intact, info.id) == ("warcinfo", 5, True, None)
    assert (page.record_type, page.payload_bytes, page.intact) == ("response", 5, False)
    warc.write_archive(spark.createDataFrame([], PAGES), f"{tmp_path}/none")
    assert warc.read_records(spark.read.schema(warc.ARCHIVE).parquet(f"{tmp_path}/none")).collect() == []
    with pytest.raises(TypeError):
        warc.write_archive(spark.createDataFrame([("a", "b", "c")], "page_id string, url string, html string"), f"{tmp_path}/no")


def test_encoder_keeps_as_many_chunks_as_told():
    """One that may keep all learns each chunk once; a small one learns them again and gives the same ids."""
    from heatloom.llm import binary, tokens
    from heatloom.llm.queries import tokenizer_path

    texts, counts, ids = [" ".join(f"word{chr(97 + i)}{chr(97 + k)}" for k in range(26)) for i in range(10)] * 2, [], []
    for most in (30, 1000):
        e, learnt = tokens.Encoder(tokenizer_path(), most), []
        learn = e._learn
        e._learn = lambda chunks, learn=learn, learnt=learnt: (learnt.extend(chunks), learn(chunks))
        ids.append([e.encode([t])[0].tolist() for t in texts])
        counts.append(len(learnt))
    assert ids[0] == ids[1] and counts == [520, 260]
    assert binary.CHUNKS > tokens.MAX_CHUNKS and tokens.Encoder.of(tokenizer_path(), binary.CHUNKS) is not tokens.Encoder.of(tokenizer_path())
