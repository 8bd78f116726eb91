"""Line dedup: a line that several documents hold stays only in the first of them.

Hashes of lines go to the task that owns their segment, packed and each once a batch of documents; it fills two Bloom filters, of
hashes seen once and seen twice. The "twice" filters of all segments, MAX_FILTER_BITS at most, are sent out. Only lines that they
may hold are shuffled; an exact grouping by 128-bit digest then confirms them and picks the smallest document.
Beyond about 45 million lines the filter fills: more lines count as suspects, up to all of them, each shuffled as 24 bytes (no
text is); the result stays exact.

Defined results: a null or empty text is one empty line; keys shorter than `min_chars` are never
repeats; rows that repeat a doc_id are one document; rows with a null doc_id keep all lines and are
not counted; ties go to the smallest doc_id; other columns pass through unchanged (n_lines and n_dropped are replaced).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, column, cut, tidy, unpacked, whole_row

SEGMENT_BITS = 1 << 20
PROBES = 3
#: The proven bound of what is broadcast: 64 MB.
MAX_FILTER_BITS = 1 << 29


def line_key(line: str, min_chars: int) -> bytes | None:
    """The line stripped and with A-Z in lower case; None if it is too short to count."""
    line = line.strip(SPACE)
    return line.encode("utf-8", "surrogatepass").lower() if len(line) >= min_chars else None


def bit_places(hashes: np.ndarray, segments: int) -> np.ndarray:
    """The PROBES bits of each hash; all in one segment."""
    h = hashes.astype(np.uint64)
    base = (h % np.uint64(segments)) * np.uint64(SEGMENT_BITS)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    shift = np.arange(PROBES, dtype=np.uint64) * np.uint64(20)
    return base[:, None] + ((h[:, None] >> shift) & np.uint64(SEGMENT_BITS - 1))


def has_bits(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return ((bits[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1).astype(bool).all(axis=1)


def set_bits(bits: np.ndarray, places: np.ndarray) -> None:
    flat = places.ravel()
    np.bitwise_or.at(bits, flat >> np.uint64(3), np.uint8(1) << (flat & np.uint64(7)).astype(np.uint8))


def document_keys(text: str | None, min_chars: int) -> set[bytes]:
    return {k for line in (text or "").split("\n") if (k := line_key(line, min_chars)) is not None}


def twice_seen_filter(docs: DataFrame, min_chars: int, segments: int) -> np.ndarray:
    """Bits of the hashes that two documents may hold; at most MAX_FILTER_BITS. docs: __id, __text."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hashes = [xxhash.xxh3_64_intdigest(k) for t in pdf["__text"] for k in document_keys(t, min_chars)]
            if not hashes:
                continue
            values, counts = np.unique(np.array(hashes, np.uint64), return_counts=True)
            owner = (values % np.uint64(segments)).astype(np.int64)
            order = np.argsort(owner, kind="stable")
            values, many, owner = values[order], counts[order] > 1, owner[order]
            edge = np.flatnonzero(np.diff(owner, prepend=-1, append=-1))
            rows = [(int(owner[i]), values[i:j].tobytes(), np.packbits(many[i:j]).tobytes()) for i, j in zip(edge[:-1], edge[1:], strict=True)]
            yield pd.DataFrame(rows, columns=["segment", "hashes", "many"])

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, once, twice = None, None, None

        def result():
            return pd.DataFrame({"segment": [at], "twice": [zlib.compress(twice.tobytes(), 1)]})

        for pdf in batches:
            for s, raw, many in zip(pdf["segment"], pdf["hashes"], pdf["many"], strict=True):
                if s != at:
                    if at is not None and twice.any():
                        yield result()
                    at = s
                    once, twice = (np.zeros(SEGMENT_BITS // 8, np.uint8) for _ in range(2))
                values = np.frombuffer(raw, np.uint64)
                places = bit_places(values, segments) % np.uint64(SEGMENT_BITS)
                again = np.unpackbits(np.frombuffer(many, np.uint8), count=len(values)).astype(bool)
                set_bits(twice, places[again | has_bits(once, places)])
                set_bits(once, places)
        if at is not None and twice.any():
            yield result()

    packed = docs.mapInPandas(tidy(hashed), "segment int, hashes binary, many binary")
    filled = packed.repartition(segments, "segment").sortWithinPartitions("segment").mapInPandas(tidy(fill), "segment int, twice binary")
    bits = np.zeros((segments, SEGMENT_BITS // 8), np.uint8)
    for row in filled.toLocalIterator():  # at most MAX_FILTER_BITS in all
        bits[row["segment"]] = np.frombuffer(zlib.decompress(row["twice"]), np.uint8)
    return bits.ravel()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, bits_per_line: int = 12) -> DataFrame:
    """docs with repeated lines dropped from text_col, and the columns n_lines (before dropping)
    and n_dropped. A null text that loses nothing stays null."""
    spark = docs.sparkSession
    rows = docs.select(column(id_col).alias("__id"), whole_row(docs).alias("row"))
    known = docs.select(column(id_col).alias("__id"), column(text_col).alias("__text")).where("__id is not null and __text is not null")
    n_lines = F.length("__text") - F.length(F.replace("__text", F.lit("\n"))) + 1
    total = known.agg(F.sum(n_lines)).first()[0] or 0
    bits = min(MAX_FILTER_BITS, max(SEGMENT_BITS, 1 << (bits_per_line * total - 1).bit_length() if total else 0))
    segments = bits // SEGMENT_BITS
    seen_twice = spark.sparkContext.broadcast(twice_seen_filter(known, min_chars, segments))

    def suspects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, keys = [], []
            for i, text in zip(pdf["__id"], pdf["__text"], strict=True):
                own = document_keys(text, min_chars)
                keys += own
                ids += [i] * len(own)
            if not keys:
                continue
            hit = has_bits(seen_twice.value, bit_places(np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64), segments))
            at = np.flatnonzero(hit)
            yield pd.DataFrame({"__id": np.array(ids)[at], "digest": [xxhash.xxh3_128_digest(keys[i]) for i in at]})

    id_type = docs.schema[id_col].dataType.simpleString()
    found = cut(known.mapInPandas(tidy(suspects), f"__id {id_type}, digest binary"))
    first = cut(found.groupBy("digest").agg(F.min("__id").alias("first"), F.max("__id").alias("last")).where("first < last").drop("last"))
    drops = found.join(first, "digest").where("__id > first").groupBy("__id").agg(F.collect_set("digest").alias("__drops")).withColumnRenamed("__id", "__drop_id")

    @F.pandas_udf("text string, dropped long")
    def without(text: pd.Series, drops: pd.Series) -> pd.DataFrame:
        rows = []
        for t, gone in zip(text, drops, strict=True):
            if gone is None:
                rows.append((None, 0))
                continue
            gone, lines = set(gone), t.split("\n")
            kept = [x for x in lines if (k := line_key(x, min_chars)) is None or xxhash.xxh3_128_digest(k) not in gone]
            rows.append(("\n".join(kept), len(lines) - len(kept)))
        return pd.DataFrame(rows, columns=["text", "dropped"])

    text, gone = F.col("row").getField(text_col), F.col("__drops").isNotNull()
    out = rows.join(drops, F.col("__id") == F.col("__drop_id"), "left").withColumn("__new", without(F.when(gone, text), F.col("__drops")))
    count = F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1
    return out.select(
        *unpacked([c for c in docs.columns if c not in ("n_lines", "n_dropped")], **{text_col: F.when(gone, F.col("__new.text")).otherwise(text)}),
        F.coalesce(count, F.lit(1)).cast("long").alias("n_lines"),
        F.coalesce(F.when(gone, F.col("__new.dropped")), F.lit(0)).cast("long").alias("n_dropped"),
    )
