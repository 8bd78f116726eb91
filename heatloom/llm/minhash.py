"""Near duplicates by ProbMinHash, banding and exact verification.

A text's words (A-Z and other letters in lower case) give shingles of five words, weighted by how often
they occur. Each shingle is a Poisson process with its weight as rate: its arrivals hit registers at random,
and every register keeps the shingle whose arrival is first. A shingle stops as soon as its next arrival is
later than all registers of the document. Two documents agree in a register with the probability Jaccard
similarity of their weighted shingles (the Jaccard similarity, where all counts are one).

Registers are banded; documents that share a band value are candidates. Copies (same words in the same order) are
one class member from the start. In each bucket every member is compared with the one that meets most others over all bands;
links that verify (exact similarity of the whole texts at least `threshold`) give components. Members of a
bucket outside its largest component are then compared with all members of other components, so that no candidate pair
of different classes stays unseen: blocks of texts meet blocks of texts, overlaps come from one matrix product a block,
and only links leave a task.

Defined results: a text of one to four words is one shingle; texts without words (null, empty, white space)
are each a class of their own; ids are whole numbers; a class's id is its smallest id; of rows that repeat an id the one
whose text's hash is smallest counts, and all have its class; rows with a null id are left out (keep_first keeps them); extra
columns do not matter.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, cut, slices, tidy, unpacked, whole_numbers, whole_row
from .lines import MAX_FILTER_BITS, SEGMENT_BITS, bit_places, has_bits, set_bits

BANDS, ROWS = 25, 5
SHINGLE = 5
BLOCK = 256
CHARS = 2_000_000
SALTS = 64  # tasks over which the outsiders of a bucket are dealt
CELLS = 8_000_000  # of a matrix of weights; blocks with larger ones are halved
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def shingle_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles and the number of the text that each is of."""
    known: dict[str, int] = {}
    words, counts = [], []
    for t in texts:
        own = words_of(t)
        words += own
        counts.append(len(own))
    at = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    value = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in known), np.uint64, len(known))
    h = value[at]
    counts = np.array(counts, np.int64)
    first = np.cumsum(counts) - counts
    n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, (counts > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(texts)), n)
    begin = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    size = np.minimum(counts[doc], SHINGLE)
    out = mix(size.astype(np.uint64))
    h = np.concatenate([h, np.zeros(SHINGLE, np.uint64)])
    for j in range(SHINGLE):
        out = np.where(j < size, mix(out * np.uint64(0x9E3779B97F4A7C15) + h[begin + j]), out)
    return out, doc


def weighted(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text with their counts, by text and hash."""
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return hashes[at], doc[at], np.diff(np.append(at, len(doc)))


def prob_min_hash(hashes: np.ndarray, doc: np.ndarray, weight: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """The shingle in each register, a row for each text; 0 where the text has no shingle."""
    first = np.full(texts * registers, np.inf)
    holder = np.zeros(texts * registers, np.uint64)
    time = np.zeros(len(hashes))
    latest = np.full(texts, np.inf)
    k = 0
    while len(hashes):
        k += 1
        draw = mix(hashes + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        time = time - np.log(((draw >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52) / weight
        live = time < latest[doc]  # early termination
        hashes, doc, weight, time, draw = (x[live] for x in (hashes, doc, weight, time, draw))
        place = doc * registers + (mix(draw) % np.uint64(registers)).astype(np.int64)
        order = np.argsort(-time, kind="stable")  # the earliest is written last
        p, t = place[order], time[order]
        early = t < first[p]
        p, t, o = p[early], t[early], order[early]
        first[p], holder[p] = t, hashes[o]
        latest = first.reshape(texts, registers).max(axis=1)
    return holder.reshape(texts, registers)


def jaccard(x: np.ndarray, y: np.ndarray, sum_a: float, sum_b: float) -> float:
    """Probability Jaccard similarity of two weighted sets: the weights x and y of what both hold, and each set's sum."""
    if not len(x):
        return 0.0
    only_a, only_b = sum_a - x.sum(), sum_b - y.sum()
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    # by ratio: those above keep x_j / x_i as the larger term, those below y_j / y_i
    above = np.cumsum(x[::-1])[::-1] + only_a
    below = np.cumsum(y) - y + only_b
    return float((1.0 / (above / x + below / y)).sum())


def similarity(a: str | None, b: str | None) -> float:
    """Exact probability Jaccard similarity of two texts' weighted shingles."""
    h, d = shingle_hashes([a, b])
    h, d, w = weighted(h, d)
    ha, wa, hb, wb = h[d == 0], w[d == 0].astype(float), h[d == 1], w[d == 1].astype(float)
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    return jaccard(wa[ia], wb[ib], wa.sum(), wb.sum())


def block_links(a: list, b: list, threshold: float) -> list[tuple[int, int]]:
    """Links between the components that two blocks of (id, root, text) are of, as pairs of roots: enough of them
    to join all components that similar texts connect. With p and q the weights over their sums and m the sum of
    min(p, q), the similarity is at least m / (2 - m) and at most m, so only pairs between need the exact value."""
    if not a or not b:
        return []
    parts = [weighted(*shingle_hashes([r["t"] for r in x])) for x in (a, b)]
    column = np.intersect1d(parts[0][0], parts[1][0])  # only what both blocks hold adds to an overlap
    if max(len(a), len(b)) * len(column) > CELLS and max(len(a), len(b)) > 1:
        a, b = (a, b) if len(a) >= len(b) else (b, a)
        return block_links(a[: len(a) // 2], b, threshold) + block_links(a[len(a) // 2 :], b, threshold)

    def weights(part, n):
        """Weights by text and shared shingle, each text's sum, and whether all its weights are 1."""
        h, d, w = part
        out = np.zeros((n, max(1, len(column))), np.float32)
        held = np.isin(h, column)
        out[d[held], np.searchsorted(column, h[held])] = w[held]
        most = np.zeros(n)
        np.maximum.at(most, d, w)
        return out, np.bincount(d, w, n), most <= 1

    (wa, na, ua), (wb, nb, ub) = (weights(p, len(x)) for p, x in zip(parts, (a, b), strict=True))
    root_a, root_b = (np.array([r["root"] for r in x]) for x in (a, b))
    parent: dict[int, int] = {}
    links = []

    def top(root: int) -> int:
        while (up := parent.get(root, root)) != root:
            root = up
        return root

    def join(i: int, j: int) -> None:
        one, other = top(root_a[i]), top(root_b[j])
        if one != other:
            parent[max(one, other)] = min(one, other)
            links.append((int(min(one, other)), int(max(one, other))))

    differ = root_a[:, None] != root_b[None, :]
    shared = (wa @ wb.T).astype(np.float64)
    unit = ua[:, None] & ub[None, :]
    for i, j in np.argwhere(differ & unit & (shared >= (threshold - 1e-9) * (na[:, None] + nb[None, :] - shared))):
        join(i, j)
    open_ = differ & ~unit & (shared > 0)
    if not open_.any():
        return links
    # m is at most the sum of sqrt(p * q)
    open_ &= np.sqrt(wa) @ np.sqrt(wb).T / np.sqrt(na[:, None] * nb[None, :]) >= threshold - 1e-4
    pa, pb = wa / na[:, None].astype(np.float32), wb / nb[:, None].astype(np.float32)
    unsure = []
    for i in np.flatnonzero(open_.any(axis=1)):
        js = np.flatnonzero(open_[i])
        has = np.flatnonzero(pa[i])
        m = np.minimum(pa[i, has], pb[np.ix_(js, has)]).sum(axis=1, dtype=np.float64)
        for j in js[m / (2.0 - m) >= threshold + 1e-5]:
            join(i, j)
        unsure += [(i, j) for j in js[(m >= threshold - 1e-5) & (m / (2.0 - m) < threshold + 1e-5)]]
    for i, j in unsure:
        if top(root_a[i]) != top(root_b[j]):
            both = np.flatnonzero((wa[i] > 0) & (wb[j] > 0))
            if jaccard(wa[i, both].astype(float), wb[j, both].astype(float), na[i], nb[j]) >= threshold:
                join(i, j)
    return links


def smallest_in_reach(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): id, root (the smallest id). Large stars and small stars
    in turn, until no link changes; each turn only groups and joins by one end of a link."""

    def star(edges: DataFrame, small: bool) -> DataFrame:
        both = edges if small else edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.select(F.col("b").alias("u"), F.col("a").alias("v")) if small else both.select(F.col("a").alias("u"), F.col("b").alias("v"))
        low = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        joined = near.join(low, "u")
        out = joined.select(F.col("v"), "m") if small else joined.where("v > u").select("v", "m")
        if small:
            out = out.union(low.select(F.col("u").alias("v"), "m"))
        out = out.where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
        return out.distinct() if small else out

    edges = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    old = mark(edges)
    while old[0]:
        edges = cut(star(cut(star(edges, False)), True))
        if (new := mark(edges)) == old:
            break
        old = new
    return edges.select(F.col("b").alias("id"), F.col("a").alias("root"))


def may_hold(ids: DataFrame) -> Callable[[str], Column]:
    """A test of a column for ids (id): true for each of them, and for few others. It is a Bloom filter, 64 MB at most, so a join has to
    follow; a full filter only costs time."""
    bits = min(MAX_FILTER_BITS, max(SEGMENT_BITS, 1 << (12 * ids.count()).bit_length()))
    segments = bits // SEGMENT_BITS  # a power of two

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            places = bit_places(pdf["h"].to_numpy(), segments)
            owner = (places[:, 0] // np.uint64(SEGMENT_BITS)).astype(np.int64)
            for s in np.unique(owner):
                set_bits(held.setdefault(int(s), np.zeros(SEGMENT_BITS // 8, np.uint8)), places[owner == s] % np.uint64(SEGMENT_BITS))
        for s, found in held.items():
            yield pd.DataFrame({"segment": [s], "bits": [zlib.compress(found.tobytes(), 1)]})

    hashed = ids.select(F.xxhash64("id").alias("h")).repartition(min(segments, 64), F.col("h").bitwiseAND(segments - 1))
    whole = np.zeros((segments, SEGMENT_BITS // 8), np.uint8)
    for row in hashed.mapInPandas(fill, "segment int, bits binary").toLocalIterator():  # at most MAX_FILTER_BITS in all
        whole[row["segment"]] = np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
    sent = ids.sparkSession.sparkContext.broadcast(whole.ravel())

    @F.pandas_udf("boolean")
    def held(h: pd.Series) -> pd.Series:
        return pd.Series(has_bits(sent.value, bit_places(h.to_numpy(), segments)))

    return lambda name: held(F.xxhash64(name))


def texts_of(base: DataFrame, ids: DataFrame) -> DataFrame:
    """One row (id, t) of base (id, t, th) for each of ids (id); of several that of the smallest th. A filter of the ids keeps most other
    texts out of the shuffle."""
    held = may_hold(ids)
    return cut(base.where(held("id")).join(ids, "id", "left_semi").groupBy("id").agg(F.min(F.struct("th", "t")).alias("x")).select("id", "x.t"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id_col, class_id (the smallest id of its class), text_id (the smallest id with the same words)."""
    whole_numbers(docs, id_col)
    base = docs.select(column(id_col).cast("long").alias("id"), column(text_col).alias("t"), F.xxhash64(column(text_col)).alias("th")).where("id IS NOT NULL")

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["t"].tolist()
            for a, b in slices([len(t or "") for t in texts], CHARS):
                h, d, w = weighted(*shingle_hashes(texts[a:b]))
                held = prob_min_hash(h, d, w, b - a, bands * rows).reshape(b - a, bands, rows)
                value = np.zeros((b - a, bands), np.uint64) + np.arange(bands, dtype=np.uint64)
                for r in range(rows):
                    value = mix(value * np.uint64(0x9E3779B97F4A7C15) + held[:, :, r])
                some = np.isin(np.arange(b - a), d)
                digests = [xxhash.xxh3_128_digest(" ".join(words_of(t)).encode("utf-8", "surrogatepass")) if s else None for t, s in zip(texts[a:b], some, strict=True)]
                yield pd.DataFrame({"id": pdf["id"].to_numpy()[a:b], "th": pdf["th"].to_numpy()[a:b], "digest": digests, "bands": [x if s else None for x, s in zip(value.view(np.int64), some, strict=True)]})

    drawn = cut(base.mapInPandas(tidy(sketch), "id long, th long, digest binary, bands array<long>"))
    twice = drawn.groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.min("th").alias("low")).where("rows > 1").select(F.col("id").alias("i2"), "low")
    drawn = drawn.join(twice, F.col("id") == F.col("i2"), "left").where("i2 IS NULL OR th = low").drop("i2", "low")
    copies = cut(drawn.where("digest is not null").groupBy("digest").agg(F.min("id").alias("text_id"), F.count(F.lit(1)).alias("n")))
    unique = drawn.where("digest is not null").join(copies, "digest").where("id = text_id").select("id", F.explode("bands").alias("band"))
    shared = unique.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = cut(unique.join(shared, "band"))
    popular = met.groupBy("id").agg(F.sum("n").alias("met"))
    members = cut(met.join(popular, "id").select("band", "id", "met"))
    centres = members.groupBy("band").agg(F.max(F.struct("met", (-F.col("id")).alias("minus"))).alias("top")).select("band", (-F.col("top.minus")).alias("low"))

    texts = texts_of(base, cut(members.select("id").distinct()))

    one = F.collect_list(F.struct("id", "t"))

    def in_lots(rows: DataFrame, key: str) -> DataFrame:
        """rows (key, t) with a lot: of at most about BLOCK rows and CHARS characters of a key."""
        lots = cut(rows.groupBy(key).agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.length("t")) / CHARS)).alias("lots")))
        return rows.join(lots, key).withColumn("lot", F.pmod(F.xxhash64("id"), F.col("lots")))

    @F.pandas_udf("array<long>")
    def alike(centre: pd.Series, members: pd.Series) -> pd.Series:
        return pd.Series([[m["id"] for m in own if similarity(c, m["t"]) >= threshold] for c, own in zip(centre, members, strict=True)])

    # the text of a centre is sent once for each lot of the members that it is compared with
    stars = cut(members.join(cut(centres), "band").where("id <> low").select("low", "id").distinct())
    dealt = in_lots(stars.join(texts, "id"), "low").groupBy("low", "lot").agg(one.alias("members"))
    centred = dealt.join(texts.select(F.col("id").alias("low"), F.col("t").alias("centre")), "low")
    links = cut(centred.select("low", F.explode(alike("centre", "members")).alias("id")).select(F.least("low", "id").alias("a"), F.greatest("low", "id").alias("b")))
    roots = smallest_in_reach(links)
    held = cut(members.join(roots, "id", "left").select("band", "id", F.coalesce("root", "id").alias("root")))
    per = held.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"))
    most = per.groupBy("band").agg(F.max(F.struct("n", "root")).alias("top"), F.count(F.lit(1)).alias("classes")).where("classes > 1").select("band", F.col("top.root").alias("top"))
    open_ = cut(held.join(most, "band"))
    # blocks of at most about BLOCK members and CHARS characters; an outsider meets the blocks of its bucket
    # (buckets with one largest component are taken together: what shares several is compared once)
    told = in_lots(cut(open_.select("top", "id", "root").distinct()).join(texts, "id"), "top")
    blocks = cut(told.groupBy("top", "lot").agg(F.collect_list(F.struct("id", "root", "t")).alias("all")).select("top", "lot", "all", F.expr("filter(all, m -> m.root <> top)").alias("out")))

    @F.pandas_udf("array<struct<a:long,b:long>>")
    def linked(out: pd.Series, all_: pd.Series) -> pd.Series:
        return pd.Series([[{"a": a, "b": b} for a, b in block_links(list(x), list(y), threshold)] for x, y in zip(out, all_, strict=True)])

    # the outsiders' blocks of a bucket are dealt over salts, so that their meetings with all its blocks are many tasks' work
    outs = blocks.where("size(out) > 0").select("top", "lot", "out")
    salts = outs.groupBy("top").agg(F.least(F.count(F.lit(1)), F.lit(SALTS)).alias("salts"))
    outs = outs.join(salts, "top").select("top", F.pmod(F.xxhash64("lot"), F.col("salts")).alias("salt"), "out")
    alls = blocks.join(salts, "top").select("top", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), "all")
    meets = outs.join(alls, ["top", "salt"])
    more = cut(meets.select(F.explode(linked("out", "all")).alias("l")).select("l.a", "l.b").distinct())
    if more.limit(1).count():
        roots = smallest_in_reach(roots.select(F.col("root").alias("a"), F.col("id").alias("b")).union(more))
    out = drawn.select("id", "digest").join(copies.select("digest", "text_id"), "digest", "left").withColumn("text_id", F.coalesce("text_id", "id"))
    out = out.join(roots.withColumnRenamed("id", "rid"), F.col("text_id") == F.col("rid"), "left")
    return out.groupBy(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col)).agg(F.min(F.coalesce("root", "text_id")).alias("class_id"), F.min("text_id").alias("text_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one document of each class: that with the smallest id. Of rows that repeat an id all stay, and rows with a null id.
    Only rows that a filter of the other ids may hold are shuffled to be told from them."""
    classes = near_duplicates(docs, id_col, text_col, **options)
    gone = cut(classes.where(column(id_col) != F.col("class_id")).select(column(id_col).alias("id")))
    held = may_hold(gone)
    rows = docs.select(column(id_col).alias("id"), whole_row(docs).alias("row")).withColumn("held", F.col("id").isNotNull() & held("id"))
    kept = rows.where("held").join(gone, "id", "left_anti")
    return rows.where("NOT held").unionByName(kept).select(*unpacked(docs.columns))
