"""Suffix-array dedup: bytes covered by a string of `length` bytes that also starts in an earlier document.

Every window of `length` bytes has an anchor, the first of its 25-byte strings with the smallest hash; equal
windows have equal anchors at the same place. The windows of one anchor are a fragment of the text. Only
fragments whose anchor two documents hold can matter: hashes of anchors are counted over the cluster in
packed lists, and a Bloom filter of those seen twice is sent out while it stays under MAX_FILTER_BITS (beyond that the
anchors are joined). Equal fragments are first merged to one with the smallest document.

Fragments with one anchor come together, thousands of anchors a time, and the suffixes of their bytes are sorted in two
stages: only suffixes smaller than their successor are sorted directly (by their first `length` bytes), the others are
induced by one scan over the buckets of first bytes. Adjacent common prefixes of `length` bytes then give classes of equal
windows, each with its smallest document. Anchors with very many different fragments are dealt over several tasks, whose
classes are merged by an exact grouping on the window.

A class's windows go back to the places of their fragments by the fragment's 128-bit digest. Between the steps, what
later steps read is written to the shared folder, so that shuffle files of earlier steps can go.

Defined results: ids are whole numbers; a null text has no bytes; matches never cross documents; rows that repeat a doc_id
are one document, do not match each other, and each has its own spans; rows with a null id keep all bytes and match
nothing; other columns pass through (those named kept, n_bytes, n_removed or spans are replaced).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut, remove, slices, unpacked, whole_numbers, whole_row, write_cut

GRAM = 25
#: Bytes of text for each partition of the shuffles.
PART_BYTES = 16_000_000
CHUNK = 200_000
#: Bytes of fragments whose suffixes are sorted together.
SORTED = 1_000_000
#: Different fragments of one anchor beyond which they are dealt over several tasks.
WIDE = 10_000
BUCKETS = 1024
MAX_FILTER_BITS = 1 << 29
_A = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place."""
    h = {1: (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)}
    for n in (1, 2, 4, 8):
        h[2 * n] = h[n][:-n] * np.uint64(pow(_A, n, 1 << 64)) + h[n][n:]
    n = len(data) - GRAM + 1
    out = h[16][:n] * np.uint64(pow(_A, 9, 1 << 64)) + h[8][16 : 16 + n] * np.uint64(_A) + h[1][24 : 24 + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def fragments(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: anchor hash, first byte, end and text number of each fragment."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.astype(np.uint64), none, none, none
    h = gram_hashes(data)
    bits = np.uint64(30)  # of a place, below the hash: of equal hashes the first place is the smallest
    v = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)
    span, n = length - GRAM + 1, 1
    while 2 * n <= span:
        v, n = np.minimum(v[:-n], v[n:]), 2 * n
    if span > n:
        v = np.minimum(v[: len(v) - (span - n)], v[span - n :])
    anchor = (v & np.uint64((1 << int(bits)) - 1)).astype(np.int64)  # of the window from each place
    starts = np.concatenate([[0], ends[:-1]])
    # windows of each text: from its start to its end - length
    valid = np.zeros(len(data) + 1, np.int32)
    enough = ends - starts >= length
    np.add.at(valid, starts[enough], 1)
    np.add.at(valid, (ends - length + 1)[enough], -1)
    at = np.flatnonzero(np.cumsum(valid[: len(anchor)]) > 0)
    if not len(at):
        return none.astype(np.uint64), none, none, none
    a = anchor[at]
    new = np.ones(len(at), bool)
    new[1:] = (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    begin = at[first]
    own = h[a[first]] * np.uint64(_A)  # small hashes are chosen more often: spread them again
    return own ^ (own >> np.uint64(29)), begin, at[last] + length, np.searchsorted(ends, begin, side="right")


def ranks(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    new = np.zeros(len(key), np.uint64)
    new[1:] = key[order][1:] != key[order][:-1]
    out = np.empty(len(key), np.uint64)
    out[order] = np.cumsum(new)
    return out


def joined(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Three ranks as one number that sorts as they do."""
    if max(x.max(initial=0) for x in (a, b, c)) < 1 << 21:
        return (a << np.uint64(42)) | (b << np.uint64(21)) | c
    return ranks((ranks((a << np.uint64(32)) | b) << np.uint64(32)) | c)


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Places of all suffixes in the order of their first `depth` bytes, by two-stage sorting."""
    n = len(data)
    step = np.append(np.diff(data.astype(np.int16)), -1)  # the last suffix is larger than the empty one
    nxt = np.where(step != 0, np.arange(n), n)
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    rises = step[nxt] > 0
    # stage one: suffixes smaller than their successor, by ranks of their 24-byte parts
    padded = np.concatenate([data, np.zeros(depth + 96, np.uint8)])
    word = np.zeros(n + depth + 80, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | padded[k : k + len(word)]
    r8 = ranks(word)
    part = joined(r8[:-16], r8[8:-8], r8[16:])
    r24 = ranks(part)
    direct = np.flatnonzero(rises)
    key = joined(*(r24[direct + k] if k < depth else np.zeros(len(direct), np.uint64) for k in (0, 24, 48)))
    direct = direct[np.argsort(key)]
    heads = np.searchsorted(data[direct], np.arange(257))
    # stage two: one scan over the buckets places every other suffix after its successor
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[data[n - 1]].append(np.array([n - 1]))
    order: list[np.ndarray] = []

    def before(places: np.ndarray, own: int) -> np.ndarray:
        """Put the predecessors in their buckets; give those of the same bucket."""
        p = places[places > 0] - 1
        p = p[~rises[p]]
        c = data[p]
        by = np.argsort(c, kind="stable")
        p, c = p[by], c[by]
        edges = np.flatnonzero(np.diff(c, prepend=c[:1] - 1 if len(c) else c)) if len(c) else []
        same = np.zeros(0, np.int64)
        for part in np.split(p, edges[1:]) if len(c) else []:
            d = int(data[part[0]])
            if d == own:
                same = part
            else:
                induced[d].append(part)
        return same

    for c in range(256):
        front = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        while len(front):
            order.append(front)
            front = before(front, c)
        own = direct[heads[c] : heads[c + 1]]
        if len(own):
            order.append(own)
            before(own, c)
    return np.concatenate(order)


def window_minima(parts: list[bytes], docs: np.ndarray, length: int) -> list[np.ndarray]:
    """For each fragment, the smallest document of each of its windows, among these fragments."""
    sizes = np.array([len(x) for x in parts])
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(parts), np.uint8)
    owner = np.repeat(np.arange(len(parts)), sizes)
    window = np.arange(len(data)) <= (ends - length)[owner]
    order = suffix_order(data, length)
    order = order[window[order]]
    rows = np.lib.stride_tricks.sliding_window_view(data, length)[order]
    differs = rows[1:] != rows[:-1]
    prefix = np.where(differs.any(axis=1), differs.argmax(axis=1), length)  # adjacent common prefixes
    first = np.concatenate([[0], np.flatnonzero(prefix < length) + 1])
    low = np.minimum.reduceat(docs[owner[order]], first)
    out = np.zeros(len(data), np.int64)
    out[order] = np.repeat(low, np.diff(np.append(first, len(order))))
    return [out[e - s : e - length + 1] for e, s in zip(ends, sizes, strict=True)]


def laid_out(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, bytes, np.ndarray]]:
    """Ids, hashes, bytes and ends of runs of texts."""
    raw = [t.encode("utf-8", "surrogatepass") for t in pdf["t"]]
    ids, hashes = pdf["id"].to_numpy(np.int64), pdf["th"].to_numpy(np.int32)
    for a, b in slices([len(x) for x in raw], CHUNK):
        yield ids[a:b], hashes[a:b], b"".join(raw[a:b]), np.cumsum([len(x) for x in raw[a:b]])


def shared_anchors(docs: DataFrame, length: int, parts: int) -> DataFrame:
    """bucket, keys (48 bits of the hashes of anchors that two documents may hold), n."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, docs_ = [], []
            for ids, _, data, ends in laid_out(pdf):
                h, _, _, text = fragments(np.frombuffer(data, np.uint8), ends, length)
                keys.append(h >> np.uint64(16))
                docs_.append(ids[text] if len(text) else text)
            if not keys or not sum(map(len, keys)):
                continue
            key, doc = np.concatenate(keys), np.concatenate(docs_)
            order = np.argsort(key)
            key, doc = key[order], doc[order]
            first = np.flatnonzero(np.diff(key, prepend=key[:1] ^ np.uint64(1)))
            many = np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)
            key = key[first]
            edge = np.searchsorted(key >> np.uint64(38), np.arange(BUCKETS + 1))
            rows = [(b, (key[i:j] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), (key[i:j] >> np.uint64(32)).astype("<u2").tobytes(), np.packbits(many[i:j]).tobytes()) for b, (i, j) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if j > i]
            yield pd.DataFrame(rows, columns=["bucket", "low", "high", "many"])

    def repeated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, sure = None, [], []

        def result():
            key = np.sort(np.concatenate(held))
            key = np.unique(np.concatenate([key[1:][key[1:] == key[:-1]], *sure]))
            return pd.DataFrame({"bucket": [at], "keys": [key.tobytes()], "n": [len(key)]})

        for pdf in batches:
            for bucket, low, high, many in zip(*(pdf[c] for c in ("bucket", "low", "high", "many")), strict=True):
                if bucket != at:
                    if at is not None:
                        yield result()
                    at, held, sure = bucket, [], []
                key = np.frombuffer(low, "<u4").astype(np.uint64) | (np.frombuffer(high, "<u2").astype(np.uint64) << np.uint64(32))
                held.append(key)
                sure.append(key[np.unpackbits(np.frombuffer(many, np.uint8), count=len(key)).astype(bool)])
        if at is not None:
            yield result()

    packed = docs.mapInPandas(gather, "bucket int, low binary, high binary, many binary")
    return packed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInPandas(repeated, "bucket int, keys binary, n long")


def digests(parts: list[bytes]) -> np.ndarray:
    """128-bit digests, as two whole numbers each."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), np.int64).reshape(-1, 2)


def find_fragments(docs: DataFrame, length: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """Every fragment whose anchor another document may hold: doc, h, frag (its bytes), and doc, th, pos, h, f, g (its digest).
    Bytes and digests are cut from the texts where they are needed: reading a text twice costs less than keeping its fragments."""
    spark = docs.sparkSession
    shared = cut(shared_anchors(docs, length, parts))
    n = shared.agg(F.sum("n")).first()[0] or 0
    per = 1 << max(10, (12 * n // BUCKETS).bit_length())  # bits of a bucket's part of the filter
    small = per * BUCKETS <= MAX_FILTER_BITS
    sent = None
    if small:

        def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for bucket, raw in zip(pdf["bucket"], pdf["keys"], strict=True):
                    own = np.zeros(per, np.uint8)
                    for place in places(np.frombuffer(raw, np.uint64), per):
                        own[place] = 1
                    yield pd.DataFrame({"bucket": [bucket], "bits": [zlib.compress(np.packbits(own).tobytes(), 1)]})

        filled = np.zeros((BUCKETS, per // 8), np.uint8)
        for row in shared.mapInPandas(bits, "bucket int, bits binary").toLocalIterator():  # at most MAX_FILTER_BITS in all
            filled[row["bucket"]] = np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
        sent = spark.sparkContext.broadcast(filled)

    def emit(batches: Iterator[pd.DataFrame], placed: bool) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for ids, hashes, data, ends in laid_out(pdf):
                h, begin, end, text = fragments(np.frombuffer(data, np.uint8), ends, length)
                if small:
                    key = h >> np.uint64(16)
                    hit = np.ones(len(h), bool)
                    for place in places(key, per):
                        hit &= (sent.value[(key >> np.uint64(38)).astype(np.int64), place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
                    h, begin, end, text = h[hit], begin[hit], end[hit], text[hit]
                parts = [data[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
                if placed:
                    pos, fg = (begin - np.concatenate([[0], ends[:-1]])[text]).astype(np.int32), digests(parts)
                    out.append(pd.DataFrame({"doc": ids[text], "th": hashes[text], "pos": pos, "h": h.view(np.int64), "f": fg[:, 0], "g": fg[:, 1]}))
                else:
                    out.append(pd.DataFrame({"doc": ids[text], "h": h.view(np.int64), "frag": parts}))
                if sum(map(len, out)) > 200_000:
                    yield pd.concat(out)
                    out = []
            if out:
                yield pd.concat(out)

    cuts = docs.mapInPandas(lambda batches: emit(batches, False), "doc long, h long, frag binary")
    found = docs.mapInPandas(lambda batches: emit(batches, True), "doc long, th int, pos int, h long, f long, g long")
    if small:
        return cuts, found

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for raw in pdf["keys"]:
                yield pd.DataFrame({"key": np.frombuffer(raw, np.uint64).astype(np.int64)})

    keys = shared.mapInPandas(listed, "key long")
    return tuple(x.join(keys, F.shiftrightunsigned("h", 16) == F.col("key"), "left_semi") for x in (cuts, found))


def places(key: np.ndarray, per: int) -> list[np.ndarray]:
    """The places of a key in its bucket's part of the filter."""
    x = key * np.uint64(_A)
    y = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return [((v >> np.uint64(20)) & np.uint64(per - 1)).astype(np.int64) for v in (x, y, x + y)]


def repeated_spans(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """doc, th (the text's hash), at, masks: for each text with bytes to remove, the windows at + i with bit i of the mask."""
    whole_numbers(docs, id_col)
    base = docs.select(column(id_col).cast("long").alias("id"), column(text_col).alias("t")).where(F.col("id").isNotNull() & (F.octet_length("t") >= length)).withColumn("th", F.hash("t"))
    size = base.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    cuts, found = find_fragments(base, length, parts)
    unique, unique_path = write_cut(cuts.groupBy("h", "frag").agg(F.min("doc").alias("low"), F.max("doc").alias("top")))
    wide = cut(unique.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > WIDE).select(F.col("h").alias("wh"), F.ceil(F.col("n") / WIDE).alias("lots")))
    dealt = unique.join(wide, F.col("h") == F.col("wh"), "left").select("h", "frag", "low", "top", F.col("lots").isNotNull().alias("split"), F.coalesce(F.pmod(F.xxhash64("frag"), F.col("lots")), F.lit(0)).alias("lot"))

    def classes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0

        def result(pdf):
            """Smallest documents of the windows of whole anchors. An anchor of one document matches nothing;
            one with a single fragment is a class without sorting; suffixes of all others are sorted."""
            new = ((pdf["h"].diff() != 0) | (pdf["lot"].diff() != 0)).to_numpy()
            first, group = np.flatnonzero(new), np.cumsum(new) - 1
            low, top = pdf["low"].to_numpy(np.int64), pdf["top"].to_numpy(np.int64)
            shared = (np.minimum.reduceat(low, first) < np.maximum.reduceat(top, first))[group] | pdf["split"].to_numpy(bool)
            several = (np.bincount(group) > 1)[group] | pdf["split"].to_numpy(bool)
            sort = np.flatnonzero(shared & several)
            minima = [None] * len(pdf)
            if len(sort):
                for i, m in zip(sort, window_minima(pdf["frag"].iloc[sort].tolist(), low[sort], length), strict=True):
                    minima[i] = m
            # one number stands for all windows of a fragment where they agree; parts of an anchor are merged below
            lows, n = np.full(len(pdf), -1, np.int64), pdf["frag"].map(len).to_numpy(np.int64) - length + 1
            one = shared & ~several
            lows[one] = low[one]
            for i in sort:
                if not pdf["split"].iat[i] and (minima[i] == minima[i][0]).all():
                    lows[i], one[i], minima[i] = minima[i][0], True, None
            fg = digests(pdf["frag"].tolist())
            out = pd.DataFrame({"f": fg[:, 0], "g": fg[:, 1], "top": top, "split": pdf["split"], "n": n, "low": pd.Series(lows, dtype="Int64").where(one), "minima": minima, "frag": pdf["frag"]})
            useful = shared & (~one | (lows < top))
            return out.assign(frag=out["frag"].where(pdf["split"], None))[useful]

        for pdf in batches:
            held.append(pdf)
            size += pdf["frag"].map(len).sum()
            if size >= SORTED:
                pdf = pd.concat(held, ignore_index=True)
                # up to the last anchor, which the next batch may continue
                k = np.flatnonzero(((pdf["h"].diff() != 0) | (pdf["lot"].diff() != 0)).to_numpy())[-1]
                upto = np.cumsum(pdf["frag"].map(len).to_numpy())
                begin = 0
                while k and begin < k:
                    stop = min(k, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + SORTED)) + 1)
                    while stop < k and pdf["h"].iat[stop] == pdf["h"].iat[stop - 1] and pdf["lot"].iat[stop] == pdf["lot"].iat[stop - 1]:
                        stop += 1
                    yield result(pdf[begin:stop].reset_index(drop=True))
                    begin = stop
                held = [pdf[k:].reset_index(drop=True)]
                size = held[0]["frag"].map(len).sum()
        if held and len(pdf := pd.concat(held, ignore_index=True)):
            yield result(pdf)

    sorted_ = dealt.repartition(parts, "h", "lot").sortWithinPartitions("h", "lot")
    classed = sorted_.mapInPandas(classes, "f long, g long, top long, split boolean, n long, low long, minima array<long>, frag binary")
    classed, classed_path = write_cut(classed.where(F.col("split") | F.col("low").isNotNull() | F.exists("minima", lambda m: m < F.col("top"))))
    remove(docs.sparkSession, unique_path)
    each = classed.where("split").select("f", "g", "n", "top", "frag", F.posexplode("minima").alias("i", "own")).withColumn("window", F.expr(f"substring(frag, i + 1, {length})"))
    lowest = each.groupBy("window").agg(F.min("own").alias("least"))
    merged = each.join(lowest, "window").groupBy("f", "g", "n", "top").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "least"))), lambda x: x["least"]).alias("minima"))
    merged = merged.where(F.exists("minima", lambda m: m < F.col("top"))).withColumn("low", F.lit(None).cast("long"))
    minima = classed.where("not split").select("f", "g", "n", "low", "minima").unionByName(merged.drop("top"))
    bit, none = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i), F.lit(0).cast("long")
    each_window = F.aggregate(F.transform("minima", lambda m, i: F.when(m < F.col("doc"), bit(i)).otherwise(none)), none, lambda a, x: a + x)
    mask = F.when(F.col("low").isNull(), each_window).when(F.col("low") < F.col("doc"), bit(F.col("n").cast("int")) - 1).otherwise(none)
    hits = found.drop("h").join(minima, ["f", "g"]).select("doc", "th", "pos", mask.alias("mask")).where("mask <> 0")
    spans = cut(hits.groupBy("doc", "th").agg(F.collect_list("pos").alias("at"), F.collect_list("mask").alias("masks")))
    remove(docs.sparkSession, classed_path)
    return spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """docs with kept (the remaining bytes), n_bytes, n_removed and spans (start, stop of each maximal removed run)."""
    if length - GRAM > 60 or length < GRAM:
        raise ValueError(f"length must be {GRAM} to {GRAM + 60}")
    found = repeated_spans(docs, id_col, text_col, length)

    @F.pandas_udf("kept binary, starts array<long>, stops array<long>")
    def without(text: pd.Series, at: pd.Series, masks: pd.Series) -> pd.DataFrame:
        kept, starts, stops = [], [], []
        window = np.arange(length - GRAM + 1)
        for t, pos, mask in zip(text, at, masks, strict=True):
            if pos is None or t is None:
                kept.append(None)
                starts.append(None)
                stops.append(None)
                continue
            data = t.encode("utf-8", "surrogatepass")
            rows, i = np.nonzero((np.asarray(mask, np.int64)[:, None] >> window) & 1)
            first = np.asarray(pos, np.int64)[rows] + i
            edge = np.bincount(first, minlength=len(data) + 1) - np.bincount(first + length, minlength=len(data) + 1)
            gone = np.cumsum(edge[:-1]) > 0
            turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes())
            starts.append(turn[::2])
            stops.append(turn[1::2])
        return pd.DataFrame({"kept": kept, "starts": starts, "stops": stops})

    id_, text, hit = F.col("row").getField(id_col).cast("long"), F.col("row").getField(text_col), F.col("at").isNotNull()
    rows = docs.select(whole_row(docs).alias("row"))
    out = rows.join(found, (id_ == F.col("doc")) & (F.hash(text) == F.col("th")), "left").withColumn("new", without(F.when(hit, text), F.col("at"), F.col("masks")))
    raw = F.coalesce(F.encode(text, "UTF-8"), F.lit(b""))
    kept = F.when(hit, F.col("new.kept")).otherwise(raw)
    runs = F.zip_with("new.starts", "new.stops", lambda a, b: F.struct(a.alias("start"), b.alias("stop")))
    names = ("kept", "n_bytes", "n_removed", "spans")
    return out.select(
        *unpacked([c for c in docs.columns if c not in names]), kept.alias("kept"), F.octet_length(raw).cast("long").alias("n_bytes"),
        (F.octet_length(raw) - F.octet_length(kept)).cast("long").alias("n_removed"), F.coalesce(F.when(hit, runs), F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)")).alias("spans"),
    )
