"""Token ids in compressed binary files, by canonical length-limited Huffman coding.

Documents are sorted by id over the cluster, tokenized, and laid out in blocks of whole documents.
The ids of all blocks are counted, package-merge gives code lengths of at most `limit` bits for the
global counts, and the canonical code is rebuilt from the lengths alone. Every block is coded by itself and
has the bit offset of every CHECKPOINT-th id, so that a reader can start there; decoding looks up
`limit` bits at a time in a table, at all checkpoints of a block at once.

A file set is two Parquet folders: `code` (symbol, bits) and `blocks` (shard, block, first id, doc_ids,
lengths, checkpoints, n_bits, payload). What passes through the driver is one count for each id of the
vocabulary and one length for each shard.

Defined results: a null or empty text has the end id alone; documents are in ascending id order, null
ids first, rows with the same id in the order of their text's hash; extra columns are not written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import column, cut, slices
from .tokens import Encoder

CHECKPOINT = 128
BLOCK_IDS = 1 << 17
#: Characters tokenized at a time.
CHARS = 4_000_000
#: Chunks that a worker keeps: learning them anew costs more than all else, and no other work shares these workers.
CHUNKS = 1_000_000


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Bits of each symbol's code (0: not used), by package-merge."""
    used = np.flatnonzero(counts)
    bits = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        bits[used] = 1
        return bits
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols need more than {limit} bits")
    leaves = used[np.argsort(counts[used], kind="stable")]
    weight = counts[leaves].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        items = np.concatenate([weight, packages])
        order = np.argsort(items, kind="stable")
        levels.append(order < len(weight))
        items = items[order]
        half = len(items) // 2
        packages = items[0 : 2 * half : 2] + items[1 : 2 * half : 2]
    need = 2 * len(leaves) - 2
    for is_leaf in reversed(levels):
        n = int(is_leaf[:need].sum())
        bits[leaves[:n]] += 1
        need = 2 * (need - n)
    return bits


def canonical(bits: np.ndarray) -> np.ndarray:
    """The code of each symbol: by length, then by symbol."""
    code = np.zeros(len(bits), np.uint64)
    nxt = 0
    for n in range(1, int(bits.max(initial=0)) + 1):
        own = np.flatnonzero(bits == n)
        code[own] = nxt + np.arange(len(own))
        nxt = (nxt + len(own)) << 1
    return code


def encode_block(ids: np.ndarray, code: np.ndarray, bits: np.ndarray) -> tuple[bytes, np.ndarray, int]:
    """Payload, bit offsets of the checkpoints, and bits in all."""
    n = bits[ids].astype(np.uint64)
    stop = np.cumsum(n, dtype=np.uint64)
    at, c = stop - n, code[ids]
    total = int(stop[-1]) if len(ids) else 0
    out = np.zeros(total // 64 + 2, np.uint64)
    if len(ids):
        word, end = (at >> np.uint64(6)).astype(np.int64), (at & np.uint64(63)) + n
        over = end > 64
        fit = np.where(over, c >> np.where(over, end - np.uint64(64), np.uint64(0)), c << np.where(over, np.uint64(0), np.uint64(64) - end))
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] = np.bitwise_or.reduceat(fit, first)
        out[word[over] + 1] |= c[over] << (np.uint64(128) - end[over])
    return out.astype(">u8").tobytes(), at[::CHECKPOINT].astype(np.uint32), total


class Decoder:
    """Looks codes up by their next `limit` bits."""

    def __init__(self, bits: np.ndarray) -> None:
        self.limit = max(1, int(bits.max(initial=0)))
        code = canonical(bits)
        symbols = np.lexsort((np.arange(len(bits)), bits))
        symbols = symbols[bits[symbols] > 0]
        spread = np.int64(1) << (self.limit - bits[symbols].astype(np.int64))
        self.symbol = np.zeros(1 << self.limit, np.uint32)
        self.bits = np.ones(1 << self.limit, np.uint8)
        filled = int(spread.sum())
        assert len(symbols) == 0 or int(code[symbols[0]]) == 0
        self.symbol[:filled] = np.repeat(symbols, spread)
        self.bits[:filled] = np.repeat(bits[symbols], spread)

    def block(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        words = np.frombuffer(payload, ">u8").astype(np.uint64)
        at = checkpoints.astype(np.uint64)
        out = np.zeros((CHECKPOINT, len(at)), np.uint32)
        last = np.uint64(len(words) * 64 - 64)
        shift = np.uint64(64 - self.limit)
        for i in range(CHECKPOINT):
            at = np.minimum(at, last)  # the last run may be shorter
            w, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            follow = words[np.minimum(w + 1, len(words) - 1)]
            key = ((words[w] << off) | ((follow >> np.uint64(1)) >> (np.uint64(63) - off))) >> shift
            out[i] = self.symbol[key]
            at = at + self.bits[key]
        return out.T.ravel()[:n]


def write_ids(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1, limit: int = 18, shards: int | None = None) -> None:
    """Write the ids of all texts below path (a folder that all executors and the driver share)."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type = docs.schema[id_col].dataType.simpleString()
    end = [] if end_id is None else [end_id]

    def lay_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        shard, encoder, block = TaskContext.get().partitionId(), Encoder.of(tokenizer, CHUNKS), 0
        held: list[np.ndarray] = []
        ids_held, sizes, total = [], [], 0

        def flush():
            nonlocal held, ids_held, sizes, total, block
            row = pd.DataFrame({"shard": [shard], "block": [block], "doc_ids": [ids_held], "lengths": [sizes], "ids": [np.concatenate(held).astype("<u4").tobytes()]})
            held, ids_held, sizes, total, block = [], [], [], 0, block + 1
            return row

        for pdf in batches:
            texts, keys = pdf["__text"].tolist(), pdf["__id"].tolist()
            for a, b in slices([len(t or "") for t in texts], CHARS):
                flat, begin = encoder.encode(texts[a:b])
                for k in range(a, b):
                    own = np.concatenate([flat[begin[k - a] : begin[k - a + 1]], np.array(end, np.uint32)])
                    held.append(own)
                    ids_held.append(None if pd.isna(keys[k]) else keys[k])
                    sizes.append(len(own))
                    total += len(own)
                    if total >= BLOCK_IDS:
                        yield flush()
        if held:
            yield flush()

    ordered = (
        docs.select(column(id_col).alias("__id"), column(text_col).alias("__text"))
        .repartitionByRange(shards, "__id", F.xxhash64("__text")).sortWithinPartitions("__id", F.xxhash64("__text"))
    )
    blocks = cut(ordered.mapInPandas(lay_out, f"shard int, block int, doc_ids array<{id_type}>, lengths array<long>, ids binary"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(0, np.int64)
        for pdf in batches:
            for raw in pdf["ids"]:
                own = np.bincount(np.frombuffer(raw, "<u4"))
                if len(own) > len(held):
                    held, own = own, held
                held[: len(own)] += own
        yield pd.DataFrame({"id": np.flatnonzero(held), "n": held[np.flatnonzero(held)]})

    counted = blocks.select("ids").mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # one row for each id of the vocabulary
    counts = np.zeros(int(counted["id"].max()) + 1 if len(counted) else 1, np.int64)
    counts[counted["id"].to_numpy(np.int64)] = counted["n"]
    bits = code_lengths(counts, max(limit, int(np.count_nonzero(counts)).bit_length()))
    spark.createDataFrame(pd.DataFrame({"symbol": np.arange(len(bits)), "bits": bits.astype(np.int32)})).coalesce(1).write.parquet(f"{path}/code")
    shared = spark.sparkContext.broadcast((canonical(bits), bits))  # bounded by the vocabulary

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, length = shared.value
        for pdf in batches:
            for shard, block, keys, sizes, raw in zip(*(pdf[c] for c in ("shard", "block", "doc_ids", "lengths", "ids")), strict=True):
                payload, checkpoints, n = encode_block(np.frombuffer(raw, "<u4"), code, length)
                yield pd.DataFrame({"shard": [shard], "block": [block], "doc_ids": [keys], "lengths": [sizes], "checkpoints": [checkpoints.tobytes()], "n_bits": [n], "payload": [payload]})

    blocks.mapInPandas(encode, f"shard int, block int, doc_ids array<{id_type}>, lengths array<long>, checkpoints binary, n_bits long, payload binary").write.parquet(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 (of its ids as little-endian unsigned 32-bit integers) and, if asked for, ids."""
    code = spark.read.parquet(f"{path}/code").toPandas()  # one row for each id of the vocabulary
    bits = np.zeros(len(code), np.uint8)
    bits[code["symbol"]] = code["bits"]
    shared = spark.sparkContext.broadcast(bits)
    blocks = spark.read.parquet(f"{path}/blocks")
    id_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = Decoder(shared.value)
        for pdf in batches:
            for shard, block, keys, sizes, points, payload in zip(*(pdf[c] for c in ("shard", "block", "doc_ids", "lengths", "checkpoints", "payload")), strict=True):
                sizes = np.asarray(sizes, np.int64)
                stop = np.cumsum(sizes)
                ids = decoder.block(payload, np.frombuffer(points, np.uint32), int(stop[-1])).astype("<u4")
                parts = [ids[a:b] for a, b in zip(stop - sizes, stop, strict=True)]
                out = {"shard": shard, "block": block, "doc_id": list(keys), "inner": stop - sizes, "n_tokens": sizes, "ids_crc32": [zlib.crc32(x.tobytes()) for x in parts]}
                yield pd.DataFrame(out | ({"ids": parts} if with_ids else {}))

    docs = blocks.mapInPandas(decode, f"shard int, block int, doc_id {id_type}, inner long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    sizes = blocks.select("shard", "block", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", earlier(W.Window.orderBy("shard")).alias("before"))  # one row for each shard
    starts = sizes.withColumn("own", earlier(W.Window.partitionBy("shard").orderBy("block"))).join(F.broadcast(shards), "shard").select("shard", "block", (F.col("own") + F.col("before")).alias("start"))
    return docs.join(starts, ["shard", "block"]).select("doc_id", (F.col("start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
