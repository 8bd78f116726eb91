"""Exact top-k by inner product over vectors sorted by norm.

Vectors are rotated by the right singular vectors of the whole table (from a d x d matrix of second
moments, summed over the cluster), so that leading coordinates carry most of a product.

Each query first meets the SEED_BYTES longest vectors, a broadcast of that size: the k-th best of these scores is a floor that
its result can't fall below, so that only vectors longer than floor / |query| can matter (Cauchy-Schwarz). Queries are laid
out in blocks by that length, all vectors in blocks of descending norm, and a query block meets only the vector blocks that
are long enough; the others are not even sent to it. A query block holds QUERIES queries, so that rows are sent once for
so many queries, and is dealt over slices of the vector blocks, whose results are merged.

Where two blocks meet, partial sums over growing leads of rotated coordinates plus the product of the two residual norms bound
each score. After each lead the pairs below the query's floor are dropped; scores of the pairs that are left are computed
exactly, in whole numbers. The leads follow from the table's spectrum: what they leave is a half, an eighth and a
thirty-second of the vectors' energy. `work` gives how many pairs each step dropped.

Defined results: ids are whole numbers; vectors that are null or hold null or non-finite components take no part; an empty vector
scores 0 with all; of vectors with different lengths the missing components count as 0; rows that repeat an id
are separate candidates, and a query meets no row of its own id (queries that repeat an id are each answered); rows with a null
id take no part; ties go to the smaller id; extra columns do not matter. Scores must stay below 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, cut, whole_numbers

#: Bytes of the longest vectors that give each query its floor.
SEED_BYTES = 8_000_000
CANDIDATES = 4096
#: Queries of a block, and how many of them are met at a time.
QUERIES, TILE = 65_536, 1024
#: Pairs left of a tile below which they are taken one by one.
SPARSE = 1 / 16
SCHEMA = "block long, norm double, ids binary, floors binary, x binary, n int"


def matrix(rows: list, dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim))
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def leads_of(energy: np.ndarray) -> list[int]:
    """Numbers of leading coordinates (energies in descending order) that leave at most 1/2, 1/8, 1/32 of all energy."""
    left = 1.0 - np.cumsum(energy) / max(energy.sum(), 1e-300)
    leads = sorted({int(np.argmax(left <= share + 1e-12)) + 1 for share in (1 / 2, 1 / 8, 1 / 32)}) if len(energy) else []
    return [m for m in leads if m < len(energy)]


class Best:
    """The k best (score, id) of each query of a block so far."""

    def __init__(self, known: np.ndarray, k: int) -> None:
        """known: scores that k others of each query are known to reach."""
        n = len(known)
        self.k, self.known = k, known
        self.scores, self.ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def floor(self) -> np.ndarray:
        return np.maximum(self.scores[:, -1], self.known)

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Candidates by query row."""
        order = np.lexsort((ids, -scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        place = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
        rows, ids, scores, place = (x[place < self.k] for x in (rows, ids, scores, place))
        own, at = np.unique(rows, return_inverse=True)
        s, i = np.full((len(own), self.k), -np.inf), np.full((len(own), self.k), np.iinfo(np.int64).max)
        s[at, place], i[at, place] = scores, ids
        s, i = np.hstack([self.scores[own], s]), np.hstack([self.ids[own], i])
        by = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.scores[own], self.ids[own] = np.take_along_axis(s, by, 1), np.take_along_axis(i, by, 1)


def residuals(turned: np.ndarray, leads: list[int]) -> list[np.ndarray]:
    """Norms of what each lead leaves of each row."""
    return [np.linalg.norm(turned[:, m:], axis=1) for m in leads]


class Block:
    """Rows of vectors with their rotated form; numbers are whole."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, basis: np.ndarray, leads: list[int], first: int = 0) -> None:
        self.x, self.ids, self.turned, self.first = x, ids, x @ basis, first
        self.length, self.left = np.linalg.norm(x, axis=1), residuals(self.turned, leads)


def search_block(best: Best, q: Block, c: Block, leads: list[int], work: np.ndarray) -> None:
    """Meet one block of candidates. work: pairs met, and pairs that are left after the norms and after each lead."""
    slack = 1e-9 * (1 + q.length * c.length.max(initial=0))
    least = best.floor() - slack
    open_ = (q.length[:, None] * c.length[None, :] >= least[:, None]) & (q.ids[:, None] != c.ids[None, :])
    work[0] += open_.size
    left = np.count_nonzero(open_)
    work[1] += left
    rows = cols = partial = None
    start = 0
    for i, m in enumerate(leads):
        if not left:
            break
        if rows is None and left < SPARSE * open_.size:
            rows, cols = np.nonzero(open_)
            partial = None if partial is None else partial[rows, cols]
        if rows is None:
            more = q.turned[:, start:m] @ c.turned[:, start:m].T
            partial = more if partial is None else partial + more
            open_ &= partial + q.left[i][:, None] * c.left[i][None, :] >= least[:, None]
            left = np.count_nonzero(open_)
        else:
            more = np.einsum("ij,ij->i", q.turned[rows, start:m], c.turned[cols, start:m])
            partial = more if partial is None else partial + more
            keep = partial + q.left[i][rows] * c.left[i][cols] >= least[rows]
            rows, cols, partial = rows[keep], cols[keep], partial[keep]
            left = len(rows)
        start = m
        work[2 + i] += left
    if not left:
        return
    if rows is None and left >= SPARSE * open_.size:
        # most bounds stay open: one product, then each query's k best of this block and its ties
        scores = np.where(open_, q.x @ c.x.T, -np.inf)  # whole numbers below 2^53: exact
        kth = np.partition(scores, -best.k, axis=1)[:, -best.k] if scores.shape[1] > best.k else np.full(len(q.x), -np.inf)
        rows, cols = np.nonzero(np.isfinite(scores) & (scores >= np.maximum(kth, best.floor())[:, None]))
        if len(rows):
            best.add(rows, c.ids[cols], scores[rows, cols])
        return
    if rows is None:
        rows, cols = np.nonzero(open_)
    for a in range(0, len(rows), 1 << 18):
        r, k = rows[a : a + (1 << 18)], cols[a : a + (1 << 18)]
        scores = np.einsum("ij,ij->i", q.x[r], c.x[k])  # whole numbers below 2^53: exact
        keep = scores >= best.floor()[r]
        if keep.any():
            best.add(r[keep], c.ids[k[keep]], scores[keep])


def prepared(vectors: DataFrame, is_query: Column, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """id, asks, x (whole numbers), norm2 of the rows that take part."""
    whole_numbers(vectors, id_col)
    v, id_ = column(vector_col), column(id_col)
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    valid = id_.isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = vectors.where(valid).select(id_.cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), whole.alias("x"))
    return rows.withColumn("norm2", F.aggregate("x", F.lit(0.0), lambda a, x: a + x * x))


def meet(vectors: DataFrame, is_query: Column, k: int, id_col: str, vector_col: str, scale: float) -> DataFrame | None:
    """query_id, ids, scores (the k best of a slice, packed by query), and work of each slice's tasks; None for an empty table."""
    spark = vectors.sparkSession
    rows = prepared(vectors, is_query, id_col, vector_col, scale)
    about = rows.agg(F.max(F.size("x")).alias("dim"), F.max(F.array_max(F.transform("x", F.abs))).alias("most"), F.count_if("asks").alias("asks")).first()
    dim = about.dim
    if dim is None:
        return None
    store = "<i2" if (about.most or 0) < 1 << 15 else "<f8"

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim, dim))
        for pdf in batches:
            m = matrix(pdf["x"].tolist(), dim)
            total += m.T @ m
        yield pd.DataFrame({"i": range(dim), "row": list(total)})

    summed = rows.select("x").mapInPandas(moments, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()  # dim x dim numbers
    second = np.zeros((dim, dim))
    second[summed["i"], summed["j"]] = summed["v"]
    energy, basis = np.linalg.eigh(second) if dim else (np.zeros(0), np.zeros((0, 0)))
    basis, leads = basis[:, ::-1].copy(), leads_of(energy[::-1].clip(0))

    longest = rows.orderBy(F.desc("norm2"), "id").select("id", "x").limit(max(1, SEED_BYTES // (8 * max(1, dim)))).toPandas()  # SEED_BYTES at most
    seeds = spark.sparkContext.broadcast((longest["id"].to_numpy(np.int64), matrix(longest["x"].tolist(), dim)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def floors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, seed = seeds.value
        for pdf in batches:
            for a in range(0, len(pdf), TILE):
                own = pdf[a : a + TILE]
                x = matrix(own["x"].tolist(), dim)
                scores = np.where(own["id"].to_numpy(np.int64)[:, None] != ids[None, :], x @ seed.T, -np.inf)
                floor = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(own), -np.inf)
                length = np.sqrt(own["norm2"].to_numpy())
                need = np.where((floor > 0) & (length > 0), floor / np.where(length > 0, length, 1.0), 0.0) * (1 - 1e-9)
                yield own.assign(floor=floor, need=need)[["id", "x", "norm2", "floor", "need"]]

    def blocks(size: int, by: str):
        def lay_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            n, held = TaskContext.get().partitionId() << 24, []

            def row(own):
                norm = float(np.sqrt(own[by].max())) if by == "norm2" else float(own[by].min())
                return pd.DataFrame({"block": [n], "norm": [norm], "ids": [own["id"].to_numpy(np.int64).tobytes()], "floors": [own["floor"].to_numpy(float).tobytes() if "floor" in own else b""], "x": [matrix(own["x"].tolist(), dim).astype(store).tobytes()], "n": [len(own)]})

            for pdf in batches:
                held.append(pdf)
                while sum(map(len, held)) >= size:
                    whole = pd.concat(held, ignore_index=True)
                    yield row(whole[:size])
                    held, n = [whole[size:]], n + 1
            if sum(map(len, held)):
                yield row(pd.concat(held, ignore_index=True))

        return lay_out

    ordered = rows.repartitionByRange(parts, F.desc("norm2"), "id").sortWithinPartitions(F.desc("norm2"), "id")
    candidates = cut(ordered.mapInPandas(blocks(CANDIDATES, "norm2"), SCHEMA))
    many = max(1, -(-about.asks // QUERIES))
    asked = rows.where("asks").mapInPandas(floors, "id long, x array<double>, norm2 double, floor double, need double")
    asked = asked.repartitionByRange(many, F.desc("need"), "id").sortWithinPartitions(F.desc("need"), "id")
    queries = cut(asked.mapInPandas(blocks(QUERIES, "need"), SCHEMA)).withColumnRenamed("block", "q")
    slices = max(1, -(-parts // many))
    deal = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    names = ["norm", "ids", "floors", "x", "n"]
    # one short row for each QUERIES queries decides which vector blocks are long enough for them
    long_enough = candidates.select("*", F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int").alias("slice")).join(F.broadcast(queries.select("q", F.col("norm").alias("need"))), F.col("norm") >= F.col("need"))
    both = queries.select("q", deal.alias("slice"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("block"), *names).unionByName(long_enough.select("q", "slice", F.lit(1).alias("kind"), "block", *names))
    both = both.repartition(max(parts, 1), "q", "slice").sortWithinPartitions("q", "slice", "kind", "block")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, tiles, bests, work = 0, [], [], np.zeros(2 + len(leads), np.int64)

        def result():
            for q, best in zip(tiles, bests, strict=True):
                found = np.isfinite(best.scores)
                yield pd.DataFrame({"q": at, "i": q.first + np.arange(len(q.ids)), "query_id": q.ids, "ids": [i[f] for i, f in zip(best.ids, found, strict=True)], "scores": [s[f].astype(np.int64) for s, f in zip(best.scores, found, strict=True)], "work": [None] * len(q.ids)})

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                x, ids = np.frombuffer(row.x, store).reshape(row.n, dim).astype(float), np.frombuffer(row.ids, np.int64)
                if row.kind == 0:
                    yield from result()
                    at = row.q
                    floor = np.frombuffer(row.floors)
                    cuts = range(0, len(ids), TILE)
                    tiles = [Block(x[a : a + TILE], ids[a : a + TILE], basis, leads, a) for a in cuts]
                    bests = [Best(floor[a : a + TILE], k) for a in cuts]
                    continue
                block = Block(x, ids, basis, leads)
                for q, best in zip(tiles, bests, strict=True):
                    search_block(best, q, block, leads, work)
        yield from result()
        yield pd.DataFrame({"q": [-1], "i": [-1], "query_id": [-1], "ids": [np.zeros(0, np.int64)], "scores": [np.zeros(0, np.int64)], "work": [work]})

    return both.mapInPandas(search, "q long, i long, query_id long, ids array<long>, scores array<long>, work array<long>")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """query_id, rank (from 1), id_col, score of each query row's k best others. is_query: of id_col and other columns."""
    found = meet(vectors, is_query, k, id_col, vector_col, scale)
    schema = f"query_id long, rank int, `{id_col}` long, score long"
    if found is None:
        return vectors.sparkSession.createDataFrame([], schema)
    pairs = F.zip_with("ids", "scores", lambda i, s: F.struct((-s).alias("minus"), i.alias("id")))
    best = found.where("work IS NULL").select("q", "i", "query_id", pairs.alias("own")).groupBy("q", "i", "query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("own"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("rank", "b")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("b.id").alias(id_col), (-F.col("b.minus")).alias("score"))


def work(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> list[int]:
    """Pairs of queries and vectors that were met at all, and that were left after the norms and after each lead."""
    found = meet(vectors, is_query, k, id_col, vector_col, scale)
    if found is None:
        return []
    totals = found.where("work IS NOT NULL").select(F.posexplode("work").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).orderBy("i").collect()  # one row for each step
    return [r.n for r in totals]
