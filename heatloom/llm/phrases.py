"""Phrase collocations by level-wise passes over all texts.

Pass k counts the k-grams of which both (k-1)-grams are frequent (Apriori). Pairs of words, by far the most, are first counted by
hash alone, and by text in the next pass if they may be frequent. The frequent (k-1)-grams are known by a Bloom
filter, FILTER_BITS at most, that is sent to all tasks: what it lets through by mistake is counted and falls to the limit
afterwards, so that a full filter costs time only. Each task counts the grams of a slice of texts by dense numbers
(a gram's number comes from its first part's number and its last word's), so that only a slice's distinct grams
become strings; these are added up by string. Tables of frequent grams are written level by level, and the cuts of each
candidate are scored by joins with them.

Defined results: A-Z count as a-z; a null text has no words; a null language is `und`; grams never cross documents or pieces;
ids are not used, so repeated rows count as often as they are there; ties of the score go to the larger count, then to the
smaller phrase in byte order; extra columns do not matter. Numbers are exact up to 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import column, join_hot, slices, write_cut, remove
from .lines import SEGMENT_BITS, bit_places, has_bits, set_bits

#: The proven bound of what is broadcast: 64 MB.
FILTER_BITS = 1 << 29
BITS_PER_GRAM = 12
#: Bytes of text that are counted at a time.
SLICE_BYTES = 4_000_000
RANK_SALTS = 32
#: Counted grams that a task holds at a time.
HELD = 8_000_000
WHOLE = (1 << 64) - 1
#: Each byte's class: A-Z to a-z, the separators of pieces to \n, tabs to blanks.
BYTES = bytes(ord("\n") if chr(i) in ".,;:!?\n\x0b\x0c\r" else 32 if i == 9 else i + 32 if 65 <= i <= 90 else i for i in range(256))


class Words:
    """The words of some texts: dense numbers, the piece and the language of each."""

    def __init__(self, texts: list[bytes], langs: list[str]) -> None:
        raw = b"\n".join(texts).translate(BYTES)
        b = np.frombuffer(raw, np.uint8)
        gap = (b == 32) | (b == 10)
        edge = np.flatnonzero(np.diff(gap, prepend=True, append=True))
        starts, ends = edge[0::2], edge[1::2]
        self.n = len(starts)
        self.piece = np.cumsum(b == 10, dtype=np.int64)[starts]
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        coded = pa.StringArray.from_buffers(self.n, pa.py_buffer(offsets), pa.py_buffer(b[~gap])).dictionary_encode()
        self.word, self.vocabulary = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        first = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        self.langs, lang = np.unique(np.array(langs, object), return_inverse=True)
        self.lang = lang[np.searchsorted(first, starts, "right") - 1]
        #: Hashes of each distinct word and language.
        self.word_hash, self.lang_hash = (np.array([xxhash.xxh3_64_intdigest(x) for x in own], np.uint64) for own in (self.vocabulary.to_pylist(), self.langs.tolist()))


def follow(first: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a gram from that of all but its last word, and its last word's."""
    h = first * np.uint64(0x9E3779B97F4A7C15) + word
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def gram_hash(lang: str, phrase: str) -> int:
    first, *rest = (np.array([xxhash.xxh3_64_intdigest(w)], np.uint64) for w in phrase.split(" "))
    h = follow(np.array([xxhash.xxh3_64_intdigest(lang)], np.uint64), first)
    for w in rest:
        h = follow(h, w)
    return int(h[0])


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values, a first place of each, the number of each value among them, and counts."""
    code, distinct = pd.factorize(values)
    first = np.empty(len(distinct), np.int64)
    first[code[::-1]] = np.arange(len(values))[::-1]
    return distinct, first, code, np.bincount(code, minlength=len(distinct))


class Grams:
    """The distinct grams of one length in some texts: places (at) of all, number of each (code), and by number a first place, count and hash."""

    def __init__(self, at, code, first, count, gram) -> None:
        self.at, self.code, self.first, self.count, self.gram = at, code, first, count, gram


def words_of(words: Words) -> Grams:
    size = len(words.vocabulary)
    distinct, first, code, count = numbered(words.lang * size + words.word)
    return Grams(np.arange(words.n), code, first, count, follow(words.lang_hash[distinct // size], words.word_hash[distinct % size]))


def longer(words: Words, g: Grams, length: int) -> Grams:
    """The grams of `length` words that begin with one of g."""
    size = len(words.vocabulary)
    on = g.at + length - 1 < words.n
    at, code = g.at[on], g.code[on]
    on = words.piece[at] == words.piece[at + length - 1]
    at, code = at[on], code[on]
    parts, first, own, count = numbered(code * size + words.word[at + length - 1])
    return Grams(at, own, at[first], count, follow(g.gram[parts // size], words.word_hash[parts % size]))


def open_only(words: Words, g: Grams, bits: np.ndarray, mask: int = WHOLE) -> tuple[Grams, np.ndarray]:
    """g at the places where a gram of the filter starts and another one at the next word; and which of its grams are in the filter.
    mask: the part of a hash that the filter knows."""
    known = has_bits(bits, bit_places(g.gram & np.uint64(mask), len(bits) * 8 // SEGMENT_BITS))
    here = np.zeros(words.n + 1, bool)
    here[g.at] = known[g.code]
    on = here[g.at] & here[g.at + 1]
    return Grams(g.at[on], g.code[on], g.first, g.count, g.gram), known


def as_strings(words: Words, k: int, first: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    own = [words.vocabulary.take(pa.array(words.word[first + i])) for i in range(k)]
    phrase = own[0] if k == 1 else pc.binary_join_element_wise(*own, " ")
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(first), k, np.int32)), pa.array(words.langs[words.lang[first]], pa.string()), phrase, pa.array(count.astype(np.int64))], ["k", "lang", "phrase", "a"])


def counted_grams(words: Words, k: int, bits: np.ndarray | None, below: bool, mask: int) -> Iterator[pa.RecordBatch]:
    """k, lang, phrase, a of the k-grams; from k = 2 on of those whose two (k-1)-grams are in the filter; with `below` also of the
    (k-1)-grams in the filter."""
    g = words_of(words)
    if k == 1:
        yield as_strings(words, 1, g.first, g.count)
        return
    for length in range(2, k):
        g = longer(words, g, length)
    on, known = open_only(words, g, bits, mask)
    if below and known.any():
        yield as_strings(words, k - 1, g.first[known], g.count[known])
    g = longer(words, on, k)
    if len(g.first):
        yield as_strings(words, k, g.first, g.count)


def hashed_pairs(words: Words, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the 2-grams of which both words are in the filter."""
    on, _ = open_only(words, words_of(words), bits)
    g = longer(words, on, 2)
    return g.gram, g.count


def frequent_filter(hashes: DataFrame, number: int) -> np.ndarray:
    """Bits of hashes (h); FILTER_BITS at most."""
    bits = min(FILTER_BITS, max(SEGMENT_BITS, 1 << (BITS_PER_GRAM * number - 1).bit_length()))
    segments = bits // SEGMENT_BITS

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, own = None, None
        for pdf in batches:
            for s, rows in pdf.groupby("segment", sort=True):
                if s != at:
                    if at is not None:
                        yield pd.DataFrame({"segment": [at], "bits": [own.tobytes()]})
                    at, own = s, np.zeros(SEGMENT_BITS // 8, np.uint8)
                set_bits(own, bit_places(rows["h"].to_numpy().astype(np.uint64), segments) % np.uint64(SEGMENT_BITS))
        if at is not None:
            yield pd.DataFrame({"segment": [at], "bits": [own.tobytes()]})

    @F.pandas_udf("int")
    def segment(h: pd.Series) -> pd.Series:
        return pd.Series((h.to_numpy().astype(np.uint64) % np.uint64(segments)).astype(np.int32))

    parts = hashes.select("h", segment("h").alias("segment")).repartition("segment").sortWithinPartitions("segment").mapInPandas(fill, "segment int, bits binary")
    out = np.zeros((segments, SEGMENT_BITS // 8), np.uint8)
    for row in parts.toLocalIterator():  # at most FILTER_BITS in all
        out[row["segment"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def phrase_hashes(grams: DataFrame) -> DataFrame:
    """h of lang and phrase."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"h": np.array([gram_hash(a, b) for a, b in zip(pdf["lang"], pdf["phrase"], strict=True)], np.uint64).astype(np.int64)})

    return grams.select("lang", "phrase").mapInPandas(run, "h long")


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """The words of SLICE_BYTES of text at a time; batches: lang, text."""
    for batch in batches:
        langs, texts = batch.column(0), batch.column(1)
        for start, stop in slices(pc.binary_length(texts).to_numpy(zero_copy_only=False), SLICE_BYTES):
            yield Words(texts.slice(start, stop - start).cast(pa.binary()).to_pylist(), langs.slice(start, stop - start).to_pylist())


def count_level(docs: DataFrame, k: int, bits: np.ndarray | None, below: bool = False, mask: int = WHOLE) -> tuple[DataFrame, object]:
    """k, lang, phrase, a; and the broadcast to destroy when they are written. docs: lang, text."""
    sent = None if bits is None else docs.sparkSession.sparkContext.broadcast(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in texts_of(batches):
            yield from counted_grams(words, k, None if sent is None else sent.value, below, mask)

    counted = docs.mapInArrow(count, "k int, lang string, phrase string, a long")
    return counted.groupBy("k", "lang", "phrase").agg(F.sum("a").alias("a")), sent


def added(hashes: list[np.ndarray], counts: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Equal hashes once, with their counts together, `most` at most."""
    values, at = np.unique(np.concatenate(hashes), return_inverse=True)
    return values, np.minimum(np.bincount(at, np.concatenate(counts).astype(float), len(values)), most).astype(np.int64)


def frequent_pairs(docs: DataFrame, bits: np.ndarray, least: int, total: int) -> tuple[DataFrame, str, int]:
    """Hashes (h) of all 2-grams that may be frequent, the folder that holds them, and the part of a hash that they are (a mask). The pairs of words are by far the most
    grams, and few are frequent: they are counted by a part of their hash, packed by segments of it and capped at `least`,
    so that 5 bytes are shuffled for each instead of its text. Pairs of one hash are counted together: none is lost."""
    segment_bits = min(16, max(6, (total >> 16).bit_length()))
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    small = np.uint8 if least < 256 else np.int64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        hashes, counts, held = [], [], 0

        def rows():
            values, own = added(hashes, counts, least)
            part = (values >> np.uint64(64 - segment_bits)).astype(np.int64)
            low = ((values >> np.uint64(32 - segment_bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            edge = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
            cuts = list(zip(edge[:-1], edge[1:], strict=True))
            return pa.RecordBatch.from_arrays([pa.array(part[edge[:-1]].astype(np.int32)), pa.array([low[i:j].tobytes() for i, j in cuts], pa.binary()), pa.array([own[i:j].astype(small).tobytes() for i, j in cuts], pa.binary())], ["segment", "low", "counts"])

        for words in texts_of(batches):
            h, n = hashed_pairs(words, sent.value)
            hashes.append(h)
            counts.append(n)
            held += len(h)
            if held >= HELD:
                merged = added(hashes, counts, least)
                if len(merged[0]) > HELD // 2:
                    yield rows()
                    hashes, counts, held = [], [], 0
                else:
                    hashes, counts, held = [merged[0]], [merged[1]], len(merged[0])
        if held:
            yield rows()

    def total_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, low, counts, held = None, [], [], 0

        def frequent():
            values, own = added(low, counts, least)
            whole = (np.uint64(at) << np.uint64(64 - segment_bits)) | (values[own >= least].astype(np.uint64) << np.uint64(32 - segment_bits))
            return pd.DataFrame({"h": whole.astype(np.int64)})

        for pdf in batches:
            for s, raw, n in zip(pdf["segment"], pdf["low"], pdf["counts"], strict=True):
                if s != at:
                    if at is not None:
                        yield frequent()
                    at, low, counts, held = s, [], [], 0
                low.append(np.frombuffer(raw, np.uint32))
                counts.append(np.frombuffer(n, small))
                held += len(low[-1])
                if held >= HELD:
                    values, own = added(low, counts, least)
                    low, counts, held = [values], [own], 0
        if at is not None:
            yield frequent()

    packed = docs.mapInArrow(count, "segment int, low binary, counts binary")
    out = write_cut(packed.repartition("segment").sortWithinPartitions("segment").mapInPandas(total_up, "h long"))
    sent.destroy()
    return (*out, WHOLE >> (32 - segment_bits) << (32 - segment_bits))


def levels(docs: DataFrame, longest: int, least: int) -> tuple[list[DataFrame], DataFrame, list[str]]:
    """The frequent grams of each length (k, lang, phrase, a), all words of each language (lang, n), and the folders that hold them."""
    counts, path = write_cut(count_level(docs, 1, None)[0])
    totals, paths = counts.groupBy("lang").agg(F.sum("a").alias("n")), [path]
    found = [counts.where(F.col("a") >= least)]
    hashes = phrase_hashes(found[0])
    number, mask = hashes.count(), WHOLE
    if number and longest > 1:
        whole = counts.agg(F.sum("a")).first()[0]
        hashes, path, mask = frequent_pairs(docs, frequent_filter(hashes, number), least, whole)
        paths.append(path)
        number = hashes.count()
    for k in range(3, max(3, longest) + 1):
        if not number or longest < 2:
            break
        bits = frequent_filter(hashes, number)
        counted, sent = count_level(docs, k, bits, below=k == 3, mask=mask)
        table, path = write_cut(counted.where((F.col("a") >= least) & (F.col("k") <= longest)))
        sent.destroy()
        paths.append(path)
        found.append(table)
        hashes = phrase_hashes(table.where(F.col("k") == k))
        number, mask = hashes.count(), WHOLE
    return found, totals, paths


def mine_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 5, least: int = 100, top: int = 2000, cover: int = 100) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's `top` best phrases of 2 to `longest` words.

    a: how often the phrase occurs, `least` at least; l, r: how often the two parts of its lowest-scoring cut do; n: words of the
    language; score: floor(1000 a n / (l r)). A phrase inside a longer one with `cover` % of its occurrences is dropped: it is then
    inside one that is longer by one word, too, so that only these are compared."""
    rows = docs.select(F.coalesce(column(lang_col).cast("string"), F.lit("und")).alias("lang"), column(text_col).alias("text")).where("text is not null")
    found, totals, paths = levels(rows, longest, least)
    known, *rest = found
    for t in rest:
        known = known.unionByName(t)
    phrases = known.where("k > 1")

    first = F.expr("substring_index(phrase, ' ', cut)")
    cuts = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).withColumn("first", first).withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    whole = known.select("lang", "phrase", "a")
    cuts, path1 = write_cut(join_hot(cuts, whole.withColumnsRenamed({"phrase": "first", "a": "l"}), ["lang", "first"]))
    cuts, path2 = write_cut(join_hot(cuts, whole.withColumnsRenamed({"phrase": "rest", "a": "r"}), ["lang", "rest"]))
    cuts = join_hot(cuts, totals, ["lang"])
    big = {c: F.col(c).cast("decimal(38,0)") for c in "alrn"}
    score = F.expr("cast(1000 as decimal(38,0)) * da * dn div (dl * dr)")
    cuts = cuts.withColumns({f"d{c}": v for c, v in big.items()}).withColumn("score", score)
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("own"))

    inner = F.array(F.expr("substring_index(phrase, ' ', k - 1)"), F.expr("substring(phrase, length(substring_index(phrase, ' ', 1)) + 2)"))
    covers = phrases.where("k > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    open_ = scored.join(covers, ["lang", "phrase"], "left").where(f"most is null or 100 * most < {int(cover)} * a")
    open_ = open_.select("lang", "phrase", "a", F.col("own.l").alias("l"), F.col("own.r").alias("r"), "n", F.col("own.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = W.Window.partitionBy("lang", "salt").orderBy(*order)
    # each salt keeps its own best, so that a language's last window holds RANK_SALTS * top rows at most
    best = open_.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(RANK_SALTS))).withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(W.Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    out, _ = write_cut(best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    for p in (*paths, path1, path2):
        remove(docs.sparkSession, p)
    return out
