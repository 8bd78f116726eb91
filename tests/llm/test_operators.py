"""Each operator against a brute-force version, on small tables with nulls, ties, copies and odd columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from heatloom.llm import binary, html, lines, minhash, mixing, packing, quality, suffix, topk, urls
from heatloom.llm.queries import RULES, tokenizer_path

WORDS = "ab cde fghi jklmn opqrst uvwxyzé ßtraße the of Zu und. naïve 你好 don't".split()
SCHEMA = "doc_id long, text string, source string, n_lines int, t string, id int, h string, __extra string"


def corpus(n=120, seed=3):
    rng = random.Random(seed)
    para = [" ".join(rng.choices(WORDS, k=rng.randint(8, 40))) for _ in range(30)]
    texts = [None, "", " \n\t", "one", "x" * 300, "y" * 300 + "x" * 300, "ab " * 1500]
    while len(texts) < n:
        r = rng.random()
        if r < 0.15 and len(texts) > 10:
            texts.append(rng.choice(texts))
        elif r < 0.3:
            w = (rng.choice(para) + " " + rng.choice(para)).split()
            w[rng.randrange(len(w))] = "edit"
            texts.append(" ".join(w))
        else:
            own = [" ".join(rng.choices(WORDS, k=rng.randint(0, 30))) for _ in range(rng.randint(1, 6))]
            texts.append("\n".join(rng.choice([x, x, " " + rng.choice(para).upper() + "\t"]) for x in own))
    order = list(range(n))
    rng.shuffle(order)
    rows = [(i, t, rng.choice([None, "a", "b", "b", "b", "Ω"]), 5, "t", 1, "h", "e") for i, t in zip(order, texts)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(x):
    return hashlib.sha256(x).hexdigest()


def near_classes(texts):
    """The smallest id of each text's class, by comparing all texts."""
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    known = sorted(i for i, t in texts.items() if minhash.words_of(t))
    for n, a in enumerate(known):
        for b in known[n + 1 :]:
            if find(a) != find(b) and minhash.similarity(texts[a], texts[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in texts}


def test_quality_counts_and_verdicts(docs, rows, none):
    got = {r["doc_id"]: r for r in quality.judge_documents(docs, max_documents=3).collect()}
    word = re.compile(r"[^\x20\x09-\x0D]+")
    keys = lambda t: {x.strip(" \t\n\x0b\x0c\r").encode().lower(): x for x in (t or "").split("\n") if word.search(x)}
    classes, held = near_classes({i: t for i, t, *_ in rows}), {}
    for i, t, source, *_ in rows:
        for k in keys(t):
            held.setdefault((source, k), set()).add(classes[i])
    for i, t, source, *_ in rows:
        t = t or ""
        w = word.findall(t)
        windows = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        cover = {j + k for j in range(len(w) - 4) if windows[tuple(w[j : j + 5])] > 1 for k in range(5)}
        ls = t.split("\n")
        dup = sum(bool(word.search(x)) and x in ls[:j] for j, x in enumerate(ls))
        failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
        lost = sum(len(word.findall(x)) for x in ls if word.search(x) and len(held[source, x.strip(" \t\n\x0b\x0c\r").encode().lower()]) > 3)
        kept = not failed and len(w) - lost >= 10 and 100 * (len(w) - lost) >= 20 * len(w)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)), t
        assert (r.base_failed, r.n_boilerplate_words, r.kept) == (failed, lost, kept), t
    kept = {i for i, r in got.items() if r.kept}
    cleaned = quality.apply_rules(docs, max_documents=3)
    assert cleaned.columns == docs.columns
    assert {r.doc_id for r in cleaned.collect()} == kept
    assert quality.apply_rules(none).collect() == [] and quality.judge_documents(none).collect() == []


def test_repeated_words_with_a_large_vocabulary():
    words = [f"w{i}" for i in range(9000)] + [f"w{i}" for i in range(100, 107)]
    assert quality.repeated_words(words) == 14


def test_copies_are_not_boilerplate(spark):
    text = " ".join(f"w{i}" for i in range(40)) + "\nshort line here"
    docs = spark.createDataFrame([(i, text, "a") for i in range(50)], "doc_id long, text string, source string")
    assert quality.apply_rules(docs).count() == 50


def own_words(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def test_a_shared_longest_line_is_boilerplate_and_near_copies_are_not(spark, tmp_path):
    from corpus_pipeline import quality_rules
    from heatloom.llm.queries import op1_quality_rules

    rng = random.Random(8)
    footer, menu = own_words(rng, 40), "home news contact"
    shared = ["\n".join([menu, own_words(rng, 15), own_words(rng, 15), footer]) for _ in range(30)]
    body = [own_words(rng, 30) for _ in range(4)] + [own_words(rng, 32)]
    near = ["\n".join([*body[:4], f"edit{k} {body[4]}"]) for k in range(30)]
    rows = [(i, t, "a" if i < 30 else "b") for i, t in enumerate(shared + near)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_boilerplate_words, r.kept) for r in op1_quality_rules(spark, str(tmp_path)).collect()}
    assert got == {i: (43 if i < 30 else 0, True) for i, *_ in rows}
    texts = {r.doc_id: r.text for r in quality_rules(spark, docs, "").collect()}
    assert texts == {i: "\n".join(t.split("\n")[1:3]) if i < 30 else t for i, t, _ in rows}


def test_line_limit_is_a_share_of_a_large_host(spark):
    from corpus_pipeline import quality_rules

    rng = random.Random(9)
    # 3,000 documents of null as host: 25 hold a common line (0.8 %), 45 a licence (1.5 %); 22 of 40 of host 'b' hold a menu
    rows = [(i, own_words(rng, 14) + ("\nan ordinary line" if i < 25 else "\nsome licence" if i < 70 else ""), None) for i in range(3000)]
    rows += [(i, own_words(rng, 14) + ("\nhome news" if i < 3022 else ""), "b") for i in range(3000, 3040)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    texts = {r.doc_id: r.text for r in quality_rules(spark, docs, "").collect()}
    assert texts == {i: t if i < 25 else t.split("\n")[0] for i, t, _ in rows}


def test_near_copies_count_once_in_the_host_as_well(spark):
    rng = random.Random(12)
    body = [own_words(rng, 12) for _ in range(5)]
    rows = [(i, own_words(rng, 14) + "\na line of forty documents", "a") for i in range(40)]
    rows += [(i, "\n".join([*body, f"edit{i}"]), "a") for i in range(40, 2600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.n_boilerplate_words, r.kept) for r in quality.judge_documents(docs, max_documents_pct=2).collect()}
    # 41 documents of the host, 40 of which hold the line; by texts it were 40 of 2,600
    assert got == {i: (5 if i < 40 else 0, True) for i, *_ in rows}


def test_line_dedup(docs, rows, none):
    first = {}
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            k = x.strip(" \t\n\x0b\x0c\r")
            if len(k) >= 10:
                first.setdefault(k.encode().lower(), set()).add(i)
    got = {r.doc_id: r for r in lines.dedup_lines(docs).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if not (len(k := x.strip(" \t\n\x0b\x0c\r")) >= 10 and len(s := first[k.encode().lower()]) > 1 and i > min(s))]
        assert (got[i].text or "", got[i].n_lines, got[i].n_dropped) == ("\n".join(kept), len(ls), len(ls) - len(kept))
    assert lines.dedup_lines(none).collect() == []


def test_line_dedup_with_a_full_filter_stays_exact(docs, monkeypatch):
    whole = sorted(lines.dedup_lines(docs).select("doc_id", "text").collect())
    monkeypatch.setattr(lines, "MAX_FILTER_BITS", lines.SEGMENT_BITS)
    monkeypatch.setattr(lines, "has_bits", lambda bits, places: np.ones(len(places), bool))
    assert sorted(lines.dedup_lines(docs).select("doc_id", "text").collect()) == whole


def brute_similarity(a, b):
    def weights(t):
        w = minhash.words_of(t)
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    x, y = weights(a), weights(b)
    keys = set(x) | set(y)
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in keys) for i in keys if x[i] and y[i])


def near_corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = [(0, None), (1, ""), (2, "one two"), (3, "one two"), (4, "One TWO")]
    for base in range(12):
        w = rng.choices(vocabulary, k=rng.randint(60, 200))
        rows.append((len(rows), " ".join(w)))
        for _ in range(rng.choice([0, 1, 6, 20])):
            v = list(w)
            for _ in range(rng.randint(0, 4)):
                v[rng.randrange(len(v))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(v)))
    w = rng.choices(vocabulary, k=100)
    for k in range(25):  # a chain whose ends have nothing in common
        rows.append((len(rows), " ".join(w)))
        w = w[4:] + rng.choices(vocabulary, k=4)
    return rows


def test_near_duplicates(spark):
    rows = near_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    text = dict(rows)
    root = {i: i for i in text}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in text:
        for b in text:
            if a < b and text[a] and text[b]:
                exact = brute_similarity(text[a], text[b])
                assert abs(exact - minhash.similarity(text[a], text[b])) < 1e-9
                if exact >= 0.8:
                    a1, b1 = sorted((find(a), find(b)))
                    root[b1] = a1
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert got == {i: find(i) for i in text}
    assert {r.doc_id for r in minhash.keep_first(docs).collect()} == {find(i) for i in text}


def test_weighted_similarity_and_sketch():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(8)]
    a = " ".join(rng.choices(vocabulary, k=400))
    b = a[: len(a) // 2] + " " + " ".join(rng.choices(vocabulary, k=150))
    exact = brute_similarity(a, b)
    assert abs(exact - minhash.similarity(a, b)) < 1e-9
    h, d, w = minhash.weighted(*minhash.shingle_hashes([a, b]))
    held = minhash.prob_min_hash(h, d, w, 2, 4096)
    assert abs((held[0] == held[1]).mean() - exact) < 0.04


def test_near_duplicates_of_an_empty_table(none):
    assert minhash.near_duplicates(none).collect() == [] and minhash.keep_first(none).columns == none.columns


def encoded(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids


def test_packing(docs, rows, none):
    got = packing.pack(docs, tokenizer_path(), capacity=512, with_ids=True).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, t, *_ in rows:
        own = sorted(by[i], key=lambda r: r.piece)
        ids = encoded(t) + [0]
        assert [x for r in own for x in r.ids] == ids
        assert all(r.length == 512 for r in own[:-1]) and [r.start for r in own] == [512 * k for k in range(len(own))]
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in own)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 512
    assert len(bins) <= -(-sum(r.length for r in got) // 512) + 1
    assert packing.pack(none, tokenizer_path()).collect() == []


def test_urls_against_every_rule(spark):
    rng = random.Random(1)
    rules = [*RULES, ("b.example.org", "/es", "allow"), ("org", "/es/x/y/", "allow"), ("example.org", "", "allow"), ("example.org", "", "allow")]
    hosts = ["example.org", "EXAMPLE.org", "a.example.org", "x.b.example.org", "notexample.org", "org", "a.com", "com", "a.b.com:80", "", ".org", "example.org.", "net"]
    paths = ["", "/", "/es/", "/es/x/y/z", "/en/1", "/en/12?x=1", "/en/2#a", "/fr/x", "/de/", "/de"]
    urls_ = [None, "", "no scheme", "://", "http://", "a://b://c/"] + [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)] + ["http://example.org/es/1"] * 200
    pages = spark.createDataFrame([(i, u, "own", None) for i, u in enumerate(urls_)], "page_id long, url string, rule string, key string").repartition(6)
    got = {r.page_id: r for r in urls.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert len(got) == len(urls_)
    for i, u in enumerate(urls_):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        m = re.match(r"([^/?#]*)([^?#]*)", rest)
        host, path = "".join(c.lower() if c.isascii() else c for c in m[1]), m[2]
        fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, 0, None, "allow"))
        r = got[i]
        assert (r.host, r.path, r.rule, r.verdict, r.key) == (host, path, best[2], best[3], None), u
    assert urls.judge_urls(pages.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).collect() == []


def test_html_field_on_held_out_pages(spark):
    field, rng = html.fitted(), random.Random(4242)
    right = total = 0
    for _ in range(150):
        page, labels = html.labelled_page(rng)
        decoded = field.decode(html.features(html.leaf_blocks(page)))
        right += sum(a == b for a, b in zip(decoded, labels))
        total += len(labels)
    assert right / total > 0.97
    page = "<nav><ul><li><a href=x>Menu</a></ul></nav><article><h1>A  &amp; b</h1><p>One <b>two<br>three.<p>Four\n five &eacute;.</article><div class=ad>Buy</div><script>x</script>"
    pages = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<p"), (5, "a < b <<")], "page_id long, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(pages).collect()}
    want = "A & b\n\nOne two three.\n\nFour five é."
    assert got[1] == (want, len(want)) and got[2] == ("", 0) == got[3]
    assert html.extract(pages.limit(0)).collect() == []


def test_html_takes_any_depth():
    import time

    field = html.fitted()
    deep = ["<div>" * 100_000 + "x", "".join(f'<div class="c{i} menu">' for i in range(100_000)) + "x", "<div>" * 50_000 + "<td>x" * 50_000, "<span>" * 50_000 + "<li>x" * 50_000]
    for page in deep:
        began = time.time()
        html.main_text(page, field)
        assert time.time() - began < 30
    assert len(html.leaf_blocks(deep[2])) == 50_000


@pytest.mark.parametrize("before,inner", [
    ("<html><head><title>T</title><meta charset=x><style>p{}</style><noscript><p>n</noscript>", ""),
    ("<head><title>T</title><img src=x>", ""),
    ("<html><body>", "<noscript><p>x</noscript>"),
    ("<html><body>", "<noscript><div>x</noscript>"),
    ("<html><body>", "<svg width=1 />"),
])
def test_html_text_after_unseen_elements(before, inner):
    page = f"{before}<article><h1>A title of some words</h1>{inner}<p>One sentence of the text. And another one.</p></article>"
    assert html.main_text(page, html.fitted()) == "A title of some words\n\nOne sentence of the text. And another one."


def test_html_text_without_tags_ends_the_head():
    assert [b[0] for b in html.leaf_blocks("<head><title>T</title>\nPlain text.")] == ["Plain text."]
    assert [b[0] for b in html.leaf_blocks("<head><template><div>x</div></template><noscript><img>y</noscript></head><body>z")] == ["z"]


def test_html_viterbi_is_the_best_path():
    field = html.Field({"a": 0, "b": 1}, np.array([[0.2, 0.9], [0.7, 0.1]]), np.array([[0.5, -0.3], [-0.4, 0.6]]))
    blocks = [["a"], ["b"], ["a", "b"], ["b"], []]
    from itertools import product

    unary = field.score([[field.known[n] for n in x] for x in blocks], field.weight)
    best = max(product((0, 1), repeat=5), key=lambda y: sum(unary[i][s] for i, s in enumerate(y)) + sum(field.step[a, b] for a, b in zip(y, y[1:])))
    assert field.decode(blocks) == list(best)


def test_binary_round_trip(spark, docs, rows, none, tmp_path):
    binary.write_ids(docs, str(tmp_path / "a"), tokenizer_path(), shards=3)
    got = sorted(binary.read_ids(spark, str(tmp_path / "a")).collect(), key=lambda r: r.start)
    at = 0
    for r, (i, t, *_) in zip(got, sorted(rows, key=lambda r: r[0]), strict=True):
        ids = encoded(t) + [1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    binary.write_ids(none, str(tmp_path / "b"), tokenizer_path())
    assert binary.read_ids(spark, str(tmp_path / "b")).collect() == []


def test_code_lengths_are_best_and_limited():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 0, 55])
    free, tight = binary.code_lengths(counts, 16), binary.code_lengths(counts, 4)
    import heapq

    heap, cost = [int(c) for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        s = heapq.heappop(heap) + heapq.heappop(heap)
        cost += s
        heapq.heappush(heap, s)
    assert (counts * free).sum() == cost and tight.max() == 4 and free[9] == tight[9] == 0
    for bits in (free, tight):
        assert abs(sum(2.0 ** -int(b) for b in bits if b) - 1) < 1e-12
    ids = np.random.default_rng(1).choice(len(counts), 5000, p=counts / counts.sum())
    payload, points, _ = binary.encode_block(ids, binary.canonical(tight), tight)
    assert (binary.Decoder(tight).block(payload, points, len(ids)) == ids).all()
    assert binary.code_lengths(np.array([0, 7]), 4).tolist() == [0, 1]


@pytest.mark.parametrize("wide,small", [(10_000, True), (3, True), (10_000, False)])
def test_suffix_array_dedup(docs, rows, none, monkeypatch, wide, small):
    monkeypatch.setattr(suffix, "WIDE", wide)
    monkeypatch.setattr(suffix, "SORTED", 2000)
    if not small:
        monkeypatch.setattr(suffix, "MAX_FILTER_BITS", 0)
    first = {}
    data = {i: (t or "").encode() for i, t, *_ in rows}
    for i, b in data.items():
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], i), i)
    got = {r.doc_id: r for r in suffix.remove_repeats(docs, length=50).collect()}
    assert len(got) == len(rows)
    for i, b in data.items():
        gone = [False] * len(b)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = [True] * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        assert (bytes(got[i].kept), got[i].n_bytes, got[i].n_removed, len(got[i].spans)) == (kept, len(b), sum(gone), spans), i
    assert suffix.remove_repeats(none).collect() == []


def test_suffix_order_is_the_order():
    rng = np.random.default_rng(0)
    for n, letters in ((1, 1), (200, 1), (500, 2), (700, 5), (400, 256)):
        data = rng.integers(0, letters, n).astype(np.uint8)
        order = suffix.suffix_order(data, 50)
        assert sorted(order) == list(range(n))
        raw = data.tobytes()
        keys = [raw[p : p + 50] for p in order]
        assert all(a <= b or a[:49] == b[:49] and min(len(a), len(b)) < 50 for a, b in zip(keys, keys[1:]))


def test_mixing(docs, rows, none):
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert got == {r.doc_id: r for r in mixing.mix(docs).collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    sources = {i: s for i, _, s, *_ in rows}
    total = {s: sum(n for i, n in size.items() if sources[i] == s) for s in set(sources.values())}
    taken, targets = Counter(), {}
    for i, r in got.items():
        assert r["size"] == size[i] and r.source_size == total[sources[i]] and 0 <= r.taken <= 2 * r["size"]
        taken[sources[i]] += r.taken
        targets[sources[i]] = r.target
    assert abs(sum(targets.values()) - 1.5 * sum(size.values())) < 1e-6
    for s, want in targets.items():
        assert want <= 2 * total[s] + 1e-6
        assert abs(taken[s] - want) <= max(n for i, n in size.items() if sources[i] == s)
    assert mixing.mix(none).collect() == [] and mixing.apply_mix(none).collect() == []
    copies = Counter(r.doc_id for r in mixing.apply_mix(docs).collect())
    assert copies == {i: r.times for i, r in got.items() if r.times}


def test_flow_is_cheapest():
    flow = mixing.route({("a",): 10, ("a", "b"): 10, ("b",): 2}, {"a": 12, "b": 9}, passes=2)
    assert abs(sum(f.get("a", 0) for f in flow.values()) - 12) < 1e-6 and abs(sum(f.get("b", 0) for f in flow.values()) - 9) < 1e-6
    assert all(sum(f.values()) <= n + 1e-6 for f, n in zip((flow[("a",)], flow[("a", "b")], flow[("b",)]), (10, 10, 2)))


def test_flow_against_all_flows():
    from itertools import product

    rng = random.Random(11)
    for _ in range(60):
        patterns = {p: rng.randint(0, 3) for p in [("a",), ("a", "b"), ("b",), ("b", "c")][: rng.randint(1, 4)]}
        targets = {s: rng.randint(0, 7) for s in sorted({s for p in patterns for s in p})}
        best = None
        ways = [[f for f in product(range(2 * n + 1), repeat=len(p)) if sum(f) <= 2 * n] for p, n in patterns.items()]
        for choice in product(*ways):
            into = Counter()
            for p, f in zip(patterns, choice):
                for s, x in zip(p, f):
                    into[s] += x
            if all(into[s] <= targets[s] for s in targets):
                # the first pass is free, each word of the second costs one
                value = (-sum(into.values()), sum(max(0, sum(f) - n) for n, f in zip(patterns.values(), choice)))
                best = min(best, value) if best else value
        flow = mixing.route(patterns, targets, 2)
        total = sum(sum(f.values()) for f in flow.values())
        cost = sum(max(0.0, sum(flow[p].values()) - n) for p, n in patterns.items())
        assert (-total, cost) == pytest.approx(best), (patterns, targets)


def test_flow_of_many_patterns():
    """10,000 overlapping patterns in a few seconds; the flow fills all targets that words allow."""
    import time

    rng = random.Random(2)
    names = [f"s{i}" for i in range(300)]
    patterns = {tuple(sorted(rng.sample(names, rng.randint(1, 4)))): rng.randint(1, 1000) for _ in range(10_000)}
    fed = sorted({s for p in patterns for s in p})
    targets = {s: float(rng.randint(1, 20_000)) for s in fed}
    start = time.monotonic()
    flow = mixing.route(patterns, targets, 2)
    assert time.monotonic() - start < 60
    into = Counter()
    for p, f in flow.items():
        assert sum(f.values()) <= 2 * patterns[p] + 1e-3
        for s, x in f.items():
            into[s] += x
    assert all(into[s] <= targets[s] + 1e-3 for s in fed)
    # a source below its target has no pattern with words left
    for p, f in flow.items():
        if sum(f.values()) < 2 * patterns[p] - 1e-3:
            assert all(into[s] >= targets[s] - 1e-3 for s in p)
    alone = mixing.route({(s,): 10 for s in names}, {s: 15.0 for s in names}, 2)
    assert all(f == {p[0]: 15.0} for p, f in alone.items())


def test_sets_with_nulls_are_told_apart(spark):
    rows = [(i, "w w w", [None, "a"] if i % 2 else ["a"]) for i in range(40)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source array<string>")).collect()
    assert sorted(r.doc_id for r in got) == list(range(40))


def test_mixing_of_overlapping_sources(spark):
    rows = [(i, "w " * (i % 7), (["a"], ["a", "b"], ["b", "c"], [], None)[i % 5]) for i in range(200)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source array<string>")).collect()
    assert len(got) == 200 and all(r.taken <= 2 * r["size"] for r in got)


def test_top_k(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8) * rng.choice([0.1, 1, 3])]) for i in range(150)]
    rows += [(i, rows[7][1]) for i in range(150, 200)]  # ties
    rows += [(200, None), (220, [1.0, float("nan")]), (240, [1.0, None]), (260, [1.0, float("inf")]), (280, []), (300, [2.0])]
    vectors = spark.createDataFrame([(i, x, "own") for i, x in rows], "vec_id long, embedding array<float>, score string").repartition(5)
    got = {}
    for r in topk.top_k(vectors, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = {i: np.floor(64 * np.array(x, np.float32).astype(float)) for i, x in rows if x is not None and all(v is not None and np.isfinite(v) for v in x)}
    good = {i: np.pad(x, (0, 8 - len(x))) for i, x in good.items()}
    assert set(got) == {i for i in good if i % 20 == 0}
    for q, found in got.items():
        want = sorted(((-int(good[q] @ x), i) for i, x in good.items() if i != q))[:20]
        assert sorted(found) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert topk.top_k(vectors.limit(0), F.col("vec_id") % 20 == 0).collect() == []


ODD = ["row", "key", "id", "lines", "h", "t", "found", "copy", "times", "lot", "at", "masks", "kept.x", "__lines", "__drops", "__spans", "__times", "__first", "__id", "__text", "slice", "kind", "mixed", "band"]


def odd(spark, rows):
    """Columns with dots, spaces and the names that operators use themselves; null ids, and ids with two texts."""
    names = ["doc.id", "the text", "so.urce", *ODD]
    rows = [(i, t, s, *[f"{n}-{k}" for n in ODD]) for k, (i, t, s) in enumerate(rows)]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` {'long' if n == 'doc.id' else 'string'}" for n in names)), dict(id_col="doc.id", text_col="the text")


def test_odd_names_null_and_repeated_ids(spark):
    rng = random.Random(12)
    long = own_words(rng, 60)
    rows = [(1, long + " a b", "x"), (1, long + " c d", "x"), (2, long + " a b", "y"), (None, long + " a b", None), (None, own_words(rng, 30), "x"), (3, None, "x"), (4, "", "y"), (5, own_words(rng, 40) + "\n" + long, "x"), (5, own_words(rng, 40) + "\n" + long, "x")]
    docs, cols = odd(spark, rows)
    texts = Counter(t for _, t, _ in rows)
    kept = quality.apply_rules(docs, host_col="so.urce", **cols)
    assert kept.columns == docs.columns and Counter(r["the text"] for r in kept.collect()) == Counter({t: n for t, n in texts.items() if t})
    assert quality.judge_documents(docs, host_col="so.urce", **cols).where("kept").count() == 7
    out = lines.dedup_lines(docs, **cols)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    got = {r.row: (r["the text"], r.n_dropped) for r in out.collect()}
    assert [got[f"row-{k}"][1] for k in range(9)] == [0, 0, 1, 0, 0, 0, 0, 0, 0]
    near = {r["doc.id"]: r.class_id for r in minhash.near_duplicates(docs, **cols).collect()}
    assert near == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    first = minhash.keep_first(docs, **cols)
    assert first.columns == docs.columns and Counter(r["doc.id"] for r in first.collect()) == {1: 2, None: 2, 3: 1, 4: 1, 5: 2}
    out = suffix.remove_repeats(docs, **cols)
    assert out.columns == [*docs.columns, "kept", "n_bytes", "n_removed", "spans"]
    got = {r.row: (bytes(r.kept), r.n_removed) for r in out.collect()}
    assert [got[f"row-{k}"][1] > 0 for k in range(9)] == [False, False, True, False, False, False, False, True, True]
    assert got["row-2"][0] == b"" and got["row-0"][0].decode() == rows[0][1]
    mixed = mixing.apply_mix(docs, source_col="so.urce", **cols)
    assert mixed.columns == docs.columns and all(r["the text"] for r in mixed.collect())
    assert mixing.mix(docs, source_col="so.urce", **cols).count() == 9
    pieces = packing.pack(docs, tokenizer_path(), **cols)
    assert pieces.columns[0] == "doc.id" and pieces.count() == 9
    binary.write_ids(docs, f"{spark.conf.get('spark.checkpoint.dir')}/odd-ids", tokenizer_path(), **cols)
    back = binary.read_ids(spark, f"{spark.conf.get('spark.checkpoint.dir')}/odd-ids")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in back.collect()) == sorted((i or 0, len(encoded(t)) + 1) for i, t, _ in rows)
    pages = docs.withColumn("ur.l", F.lit("http://example.org/es/1")).withColumn("html", F.lit("<article><h1>A title here</h1><p>Some text, it is long enough. Yes.</article>"))
    judged = urls.judge_urls(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"), url_col="ur.l")
    assert judged.columns == [*pages.columns, "host", "path", "rule", "verdict"] and {r.verdict for r in judged.collect()} == {"block"}
    assert html.extract(pages).columns == [*[c for c in pages.columns if c != "html"], "text", "n_chars"] and html.extract(pages).where("n_chars > 0").count() == 9


def test_ids_that_are_no_numbers_are_an_error(spark):
    docs = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    for call in (minhash.near_duplicates, suffix.remove_repeats):
        with pytest.raises(TypeError, match="doc_id"):
            call(docs)


def test_very_long_texts(spark, tmp_path):
    rng = random.Random(13)
    words = [f"w{i}" for i in range(5000)]
    line = " ".join(rng.choices(words, k=100_000))
    huge = "\n".join([line, *(" ".join(rng.choices(words, k=12)) for _ in range(40_000))])  # some 3.3 MB
    rows = [(1, huge, "a"), (2, huge + " end", "a"), (3, line, "b"), (4, "short text of some words that nobody else has at all", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2).cache()
    assert {r.doc_id for r in quality.apply_rules(docs).collect()} == {1, 2, 3, 4}
    assert {r.doc_id: r.n_dropped for r in lines.dedup_lines(docs).collect()} == {1: 0, 2: 40_000, 3: 1, 4: 0}
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    got = {r.doc_id: r.kept for r in suffix.remove_repeats(docs).collect()}
    assert bytes(got[1]).decode() == huge and bytes(got[2]) == b" end" and bytes(got[3]) == b""
    packed = packing.pack(docs, tokenizer_path()).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    sizes = {i: len(encoded(t)) + 1 for i, t, _ in rows}
    assert {r.doc_id: r.n for r in packed} == sizes
    binary.write_ids(docs, str(tmp_path / "long"), tokenizer_path())
    assert {r.doc_id: r.n_tokens for r in binary.read_ids(spark, str(tmp_path / "long")).collect()} == sizes
    assert sum(r.taken for r in mixing.mix(docs).collect()) > 0


def test_pack_chooses_the_least_sum_of_squares():
    rng = np.random.default_rng(14)
    for _ in range(30):
        lengths, capacity = rng.integers(1, 30, rng.integers(1, 40)), 30
        bins, offsets = packing.sum_of_squares(lengths, capacity)
        gaps: dict[int, int] = {}  # bin -> gap
        for i in np.argsort(-lengths, kind="stable"):
            s, open_ = int(lengths[i]), [g for g in gaps.values() if 0 < g < capacity]
            tried = {}
            for g in sorted({g for g in open_ if g >= s}):
                left = Counter(open_)
                left[g] -= 1
                if g > s:
                    left[g - s] += 1
                tried[g] = sum(n * n for n in left.values())
            b = int(bins[i])
            if tried:
                assert tried[gaps[b]] == min(tried.values()) and gaps[b] == min(g for g, v in tried.items() if v == min(tried.values()))
            else:
                assert b not in gaps
            assert offsets[i] == capacity - gaps.get(b, capacity)
            gaps[b] = gaps.get(b, capacity) - s


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == names
    assert docs.count() > 0
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_pipeline_against_brute_force(spark, rows, tmp_path):
    """Each stage on its own input, with nulls, empty texts, copies and repeated ids; then the whole."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rng = random.Random(15)
    made = [(i, t, "en", s, 7) for i, t, s, *_ in rows] + [(i + 1000, own_words(rng, 25) + ("\nthe same notice in all" if i < 30 else ""), None, "big", None) for i in range(45)]
    made += [(None, own_words(rng, 20), "en", "a", 1), (2000, own_words(rng, 20), "en", "a", 1), (2000, own_words(rng, 20), "en", "a", 1)]
    spark.createDataFrame(made, schema).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    word = re.compile(r"[^\x20\x09-\x0D]+")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower()

    # quality rules
    quality_ = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    classes = near_classes(dict(enumerate(t for _, t, *_ in made)))
    held, hosts = {}, {}
    for k, (_, t, _, s, _) in enumerate(made):
        own = {key(x) for x in (t or "").split("\n") if word.search(x)}
        if own:
            hosts.setdefault(s, set()).add(classes[k])
        for x in own:
            held.setdefault((s, x), set()).add(classes[k])
    common = {k for k, d in held.items() if len(d) > 20 and 100 * len(d) > len(hosts[k[0]])}
    assert ("big", b"the same notice in all") in common
    want = []
    for i, t, lang, s, n in made:
        w = word.findall(t or "")
        windows = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        cover = {j + k for j in range(len(w) - 4) if windows[tuple(w[j : j + 5])] > 1 for k in range(5)}
        lines_ = (t or "").split("\n")
        left = [x for x in lines_ if (s, key(x)) not in common]
        n_left = sum(len(word.findall(x)) for x in left)
        if len(w) >= 10 and 100 * len(cover) <= 20 * len(w) and n_left >= 10 and 100 * n_left >= 20 * len(w):
            want.append((i, "\n".join(left), lang, s, n))
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert order(quality_.collect()) == order(want)

    # line dedup, in the rows' order of ids; rows with one id are one document
    deduped = corpus_pipeline.line_dedup(spark, quality_, str(tmp_path))
    first = {}
    for i, t, *_ in want:
        for x in t.split("\n"):
            if i is not None and len(x.strip(" \t\n\x0b\x0c\r")) >= 10:
                first.setdefault(key(x), set()).add(i)
    want = [(i, "\n".join(x for x in t.split("\n") if i is None or len(first.get(key(x), ())) < 2 or i == min(first[key(x)])), *rest) for i, t, *rest in want]
    assert order(deduped.collect()) == order(want)

    # near dedup: one document of each class stays, rows without an id stay
    near = corpus_pipeline.near_dedup(spark, deduped, str(tmp_path))
    with_id = {i: t for i, t, *_ in want if i is not None and i != 2000}
    roots = near_classes(with_id)
    want = [r for r in want if r[0] is None or r[0] == 2000 or roots[r[0]] == r[0]]
    assert order(near.collect()) == order(want)

    # mixing: whole passes by the flow, never over two, words near the targets
    mixed = corpus_pipeline.mix_sources(spark, near, str(tmp_path)).collect()
    copies, sizes = Counter(map(tuple, mixed)), Counter()
    for r in want:
        sizes[r[3]] += len(word.findall(r[1]))
    assert set(copies) <= set(want) and max(copies.values()) <= 2
    targets = mixing.share_out(dict(sizes))
    for s, target in targets.items():
        taken = sum(n * len(word.findall(r[1])) for r, n in copies.items() if r[3] == s)
        assert abs(taken - target) <= max(len(word.findall(r[1])) for r in want if r[3] == s)

    # packing and the whole
    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r.length for r in run) == sum(n * (len(encoded(r[1])) + 1) for r, n in copies.items())
    assert Counter(r.doc_id for r in run if r.piece == 0) == Counter(i for (i, *_), n in copies.items() for _ in range(n))


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("tile,queries,candidates,seeds", [(7, 16, 32, 1), (1024, 65_536, 4096, 8_000_000), (5, 9, 20, 2000)])
def test_top_k_in_small_blocks_and_its_work(spark, monkeypatch, tile, queries, candidates, seeds):
    for name, value in (("TILE", tile), ("QUERIES", queries), ("CANDIDATES", candidates), ("SEED_BYTES", seeds)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(5)
    turn = np.linalg.qr(rng.normal(size=(16, 16)))[0]
    x = rng.normal(size=(600, 16)) * (0.6 ** np.arange(16)) @ turn * rng.choice([0.2, 1, 2], size=(600, 1))
    x[590:] = x[3]  # ties
    vectors = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id int, embedding array<double>").repartition(4)
    whole = np.floor(64 * x)
    got = {}
    for r in topk.top_k(vectors, F.col("vec_id") % 20 == 0, k=8).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 600, 20))
    for q, found in got.items():
        want = sorted((-int(whole[q] @ whole[i]), i) for i in range(600) if i != q)[:8]
        assert sorted(found) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    met = topk.work(vectors, F.col("vec_id") % 20 == 0, k=8)
    assert met[0] <= 30 * 600 and all(a >= b for a, b in zip(met, met[1:]))
    if seeds > 100:
        assert met[-1] < 0.5 * met[0]


def test_top_k_ids_are_whole_numbers(spark):
    with pytest.raises(TypeError, match="vec_id"):
        topk.top_k(spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<double>"), F.lit(True))
