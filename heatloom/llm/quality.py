"""Quality rules from cross-document line frequency.

Every line is normalised (stripped, A-Z in lower case) and hashed; distinct documents are counted
per host and line; lines above the limit are boilerplate and removed; a document of which too little
is left is rejected. A line is above the limit if over `max_documents_pct` percent of the host's
distinct documents hold it, and over `max_documents` in any case: from 2,000 documents (by default)
a host's verdicts depend on shares alone. Exact copies (the same normalised lines in the same order) count once everywhere.
Near copies do not make their lines boilerplate either: the documents that hold a line near or above the limit are compared with each
other, and near copies among them, as minhash.near_duplicates finds them, count as one document: of those that hold a line and of the
host's alike. As that lowers the limit, this goes on until no line is left that it newly concerns.
(By shared boilerplate alone two texts are near copies only where under a fifth of each is its own, and such texts are
rejected once those lines are gone.) A document's host is any column (here its source).

Per document there are also counts of words, symbols, repeated lines and words in repeated 5-word
windows; a document fails the base rules if it has under `min_words` words or if over
`max_repeat_pct` percent of its words stand in repeated windows.

Defined results: a null text has no words and fails; a null host is a host of its own; rows that repeat a doc_id, and rows
with a null one, are judged one by one, each by its own text; equal rows have one verdict; other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import minhash
from .common import SPACE, column, cut, tidy, unpacked, whole_row

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
WINDOW = 5
#: Lines are compared from this part of the limit on, as near copies lower it: mostly that saves a second round.
MARGIN = 0.75
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[str]) -> int:
    """How many of the words stand in a window of five that the text has twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids: dict[str, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, len(words))
    bits = max(1, (len(ids) - 1).bit_length())
    if bits * WINDOW <= 64:
        key = np.zeros(n, np.uint64)
        for j in range(WINDOW):
            key = (key << np.uint64(bits)) | at[j : j + n]
    else:  # ranks of pairs, of fours, then of fives: exact for any vocabulary
        key = at
        for step, right in ((1, None), (2, None), (4, at)):
            tail = key if right is None else right
            m = min(len(key), len(tail) - step)
            _, key = np.unique((key[:m] << np.uint64(32)) | tail[step : step + m], return_inverse=True)
            key = key.astype(np.uint64)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    if not twice.any():
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += twice
    edges[WINDOW : WINDOW + n] -= twice
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure(text: str | None) -> tuple:
    """The five counts, then hashes and word counts of the distinct lines that have a word, and the digest of all these lines."""
    text = text or ""
    words = WORD.findall(text)
    seen: set[str] = set()
    lines: dict[str, list[int]] = {}
    dup, whole = 0, xxhash.xxh3_64()
    for line in text.split("\n"):
        key = line.strip(SPACE)
        if not key:
            continue
        dup += line in seen
        seen.add(line)
        key = key.encode("utf-8", "surrogatepass").lower()
        whole.update(key + b"\n")
        if key in lines:
            lines[key][1] += 1
        else:
            lines[key] = [len(WORD.findall(line)), 1]
    signed = lambda k: xxhash.xxh3_64_intdigest(k) - (1 << 63)
    return len(words), sum(map(len, words)), len(SYMBOL.findall(text)), dup, repeated_words(words), [signed(k) for k in lines], [a * b for a, b in lines.values()], whole.intdigest() - (1 << 63)


def line_hash(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.strip(SPACE).encode("utf-8", "surrogatepass").lower()) - (1 << 63)


def row_key(id_col: str, text_col: str, host_col: str):
    """One number for equal rows."""
    id_, host = column(id_col), column(host_col)
    return F.xxhash64(id_, F.isnull(id_), host, F.isnull(host), column(text_col))


def verdicts(docs: DataFrame, id_col: str, text_col: str, host_col: str, min_words: int, max_repeat_pct: int, max_documents: int, least_left_pct: int, max_documents_pct: int) -> DataFrame:
    """Per row: key, id, the counts, base_failed, n_boilerplate_words, boilerplate and kept."""

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.DataFrame([measure(t) for t in pdf["text"]], columns=[*STATS, "hashes", "words", "digest"])
            yield pd.concat([pdf[["key", "id", "host"]], out], axis=1)

    id_type, host_type = (docs.schema[c].dataType.simpleString() for c in (id_col, host_col))
    schema = f"key long, id {id_type}, host {host_type}, {', '.join(f'{c} long' for c in STATS)}, hashes array<long>, words array<long>, digest long"
    base = docs.select(row_key(id_col, text_col, host_col).alias("key"), column(id_col).alias("id"), column(host_col).alias("host"), column(text_col).alias("text"))
    found = cut(base.mapInPandas(tidy(measured), schema).withColumn("row", F.monotonically_increasing_id()))
    same_line = lambda h, k: F.col("host").eqNullSafe(F.col(h)) & (F.col("hash") == F.col(k))
    lines = found.select("row", "key", "host", "digest", F.explode(F.arrays_zip(F.col("hashes").alias("hash"), "words")).alias("l")).select("row", "key", "host", "digest", "l.hash", "l.words")
    # lines that over max_documents texts hold, with the number of texts; few, and all that may be above the limit
    some = lines.groupBy("host", "hash", "digest").agg(F.lit(1).alias("one")).groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_documents)
    many = cut(some.withColumnsRenamed({"host": "h1", "hash": "k1"}))
    classes, judged = None, -1
    while True:
        # documents of a host: classes of near copies where documents were compared, else distinct texts
        own = found.where(F.size("hashes") > 0)
        unit = F.struct(F.lit(None).cast("long").alias("document"), "digest")
        if classes is not None:
            unit = F.struct("document", F.when(F.col("document").isNull(), F.col("digest")).alias("digest"))
            own = own.join(classes, F.col("key") == F.col("i1"), "left")
        of = cut(own.select("host", unit.alias("unit")).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("of")).withColumnRenamed("host", "h0"))
        share = max_documents_pct * (MARGIN if classes is None else 1)
        above = many.join(of, F.col("h1").eqNullSafe(F.col("h0"))).where(100 * F.col("n") > share * F.col("of")).select("h1", "k1")
        number = above.count()
        if number <= judged:
            break  # all lines that the documents of this count put above the limit have been compared
        # fewer documents lower the limit, so that the lines to compare only become more
        judged = number
        near = cut(lines.join(above, same_line("h1", "k1"), "left_semi"))
        texts = minhash.texts_of(base.select(F.col("key").alias("id"), F.col("text").alias("t"), F.lit(0).alias("th")), cut(near.select(F.col("key").alias("id")).distinct()))
        classes = cut(minhash.near_duplicates(texts, "id", "t").select(F.col("id").alias("i1"), F.col("class_id").alias("document")))
    held = near.join(classes, F.col("key") == F.col("i1")).groupBy("host", "hash", "document").agg(F.lit(1).alias("one")).groupBy("host", "hash").count().where(F.col("count") > max_documents)
    common = held.join(of, F.col("host").eqNullSafe(F.col("h0"))).where(100 * F.col("count") > max_documents_pct * F.col("of")).select(F.col("host").alias("h2"), F.col("hash").alias("k2"))
    gone = near.join(common, same_line("h2", "k2")).groupBy("row").agg(F.sum("words").alias("gone"), F.collect_set("hash").alias("boilerplate")).withColumnRenamed("row", "r2")
    all_ = found.drop("hashes", "words", "host", "digest").join(gone, F.col("row") == F.col("r2"), "left")
    lost = F.coalesce("gone", F.lit(0))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    left = F.col("n_words") - lost
    return all_.select(
        "key", "id", *STATS, failed.alias("base_failed"), lost.cast("long").alias("n_boilerplate_words"), "boilerplate",
        (~failed & (left >= min_words) & (100 * left >= least_left_pct * F.col("n_words"))).alias("kept"),
    )


def judge_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = 10, max_repeat_pct: int = 20, max_documents: int = 20, least_left_pct: int = 20, max_documents_pct: int = 1) -> DataFrame:
    """Per row: id_col, the counts, base_failed, n_boilerplate_words (in lines above the limit),
    boilerplate (their hashes) and kept."""
    found = verdicts(docs, id_col, text_col, host_col, min_words, max_repeat_pct, max_documents, least_left_pct, max_documents_pct)
    return found.drop("key").withColumnRenamed("id", id_col)


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = 10, max_repeat_pct: int = 20, max_documents: int = 20, least_left_pct: int = 20, max_documents_pct: int = 1) -> DataFrame:
    """docs without the rejected documents, and without the lines above the limit in the others."""
    found = verdicts(docs, id_col, text_col, host_col, min_words, max_repeat_pct, max_documents, least_left_pct, max_documents_pct)
    hit = cut(cut(found).where("NOT kept OR boilerplate IS NOT NULL").groupBy("key").agg(F.first("kept").alias("kept"), F.first("boilerplate").alias("lines")))  # equal rows have one verdict

    @F.pandas_udf("string")
    def without(text: pd.Series, lines: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else "\n".join(x for x in t.split("\n") if line_hash(x) not in gone) for t, gone in zip(text, map(lambda g: set() if g is None else set(g), lines), strict=True)], dtype=object)

    # documents that neither go nor lose a line never meet the verdicts: a filter keeps nearly all of them out of the shuffle
    held = minhash.may_hold(hit.select(F.col("key").alias("id")))
    rows = docs.select(row_key(id_col, text_col, host_col).alias("key"), whole_row(docs).alias("row")).withColumn("held", held("key"))
    met = rows.where("held").join(hit, "key", "left").where("kept IS NULL OR kept")
    text, changed = F.col("row").getField(text_col), F.col("lines").isNotNull()
    met = met.withColumn("new", without(F.when(changed, text), F.when(changed, F.col("lines"))))
    met = met.select(*unpacked(docs.columns, **{text_col: F.when(changed, F.col("new")).otherwise(text)}))
    return rows.where("NOT held").select(*unpacked(docs.columns)).unionAll(met)
