"""Sum-of-squares packing of documents into sequences of a fixed number of tokens.

Documents longer than a sequence are cut into full pieces, which are sequences of their own, and a
last shorter one. The shorter pieces are dealt at random into groups of about GROUP; each group is
packed by a task of its own, piece after piece from the longest, where the sum over all gaps of
the squared number of open bins with that gap becomes smallest; a new bin is opened only where no open
bin has room. A group leaves at most a few bins half empty, out of tens of thousands.

Defined results: a null or empty text is the end id alone; rows that repeat an id are separate documents
(their pieces differ in sequence_id and offset); ties go to the smaller gap; extra columns do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .binary import CHARS
from .common import column, cut, slices, tidy
from .tokens import Encoder

GROUP = 40_000


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece (of 1 to capacity tokens)."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by gap
    n = np.zeros(capacity + 1, np.int64)  # their number; gap 0 counts as none
    bins, offsets, count = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        if (fits := np.flatnonzero(n[s:capacity])).size:
            # putting the piece in gap g adds 2 * (n[g - s] - n[g] + 1) to the sum, or 1 - 2 * n[g] if it fills the bin
            change = 2 * (n[fits] - n[fits + s] + 1) - (fits == 0)
            gap = int(fits[np.argmin(change)]) + s
            b = open_bins[gap].pop()
            n[gap] -= 1
        else:
            b, gap, count = count, capacity, count + 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            open_bins[gap - s].append(b)
            n[gap - s] += 1
    return bins, offsets


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Per piece: id_col, piece, start, length, ids_crc32 and, if asked for, ids."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder.of(tokenizer)
        for pdf in batches:
            texts, keys = pdf["__text"].tolist(), pdf["__id"]
            for a, b in slices([len(t or "") for t in texts], CHARS):
                flat, begin = encoder.encode(texts[a:b])
                rows = []
                for k in range(a, b):
                    own = np.append(flat[begin[k - a] : begin[k - a + 1]], np.uint32(end_id)).astype("<u4")
                    for p, start in enumerate(range(0, len(own), capacity)):
                        part = own[start : start + capacity]
                        rows.append((keys.iat[k], p, start, len(part), zlib.crc32(part.tobytes())) + ((part,) if with_ids else ()))
                out = pd.DataFrame(rows, columns=["__id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])
                yield out.astype({"__id": "Int64"}) if id_type in ("bigint", "int") else out

    base = docs.select(column(id_col).alias("__id"), column(text_col).alias("__text"))
    out = base.mapInPandas(tidy(cut_up), f"__id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)
    return out.withColumnRenamed("__id", id_col)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """pieces_of(docs) with sequence_id and offset. The sequence's ids are its pieces' ids by offset."""
    made = cut(pieces_of(docs, tokenizer, capacity, id_col, text_col, end_id, with_ids).withColumn("__row", F.monotonically_increasing_id()))
    full = made.where(F.col("length") == capacity)
    rest = made.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // GROUP))
    dealt = rest.select("__row", "length", F.pmod(F.xxhash64("__row"), F.lit(groups)).cast("int").alias("__group"))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__row")
        bins, offsets = sum_of_squares(pdf["length"].to_numpy(np.int64), capacity)
        # even numbers here, odd ones for full pieces
        return pd.DataFrame({"__at": pdf["__row"].to_numpy(), "sequence_id": 2 * (bins * groups + pdf["__group"].to_numpy(np.int64)), "offset": offsets})

    placed = dealt.groupBy("__group").applyInPandas(place, "__at long, sequence_id long, offset long")
    packed = rest.join(placed, F.col("__row") == F.col("__at")).drop("__at")
    alone = full.withColumns({"sequence_id": 2 * F.col("__row") + 1, "offset": F.lit(0).cast("long")})
    return packed.unionByName(alone).drop("__row")
