"""Hard negatives by branch and bound over ball trees.

Vectors are ordered by label and their most varied coordinate over the cluster; each task builds a tree of balls over TREE rows
at a time by halving the most varied coordinate of a node, and writes its subtrees of at most BLOCK rows. For an anchor a and a
ball of centre c and radius r, a.c - |a| r and a.c + |a| r bound the inner products of all rows inside. A node is left out if its
bounds lie outside the score window, strictly beneath the score that `k` rows of the window are known to reach, or
if all its rows have the wrong label. What is left is scored in whole numbers.

Anchors are laid out in blocks of ANCHORS and dealt over slices of the trees, whose results are merged. The first search gives each anchor's positives,
without a window and of the same label; their scores are the windows of the second, among the other labels.

Defined results: ids and labels are whole numbers; rows with a null id, label or vector, or with null or non-finite components,
take no part; an empty vector scores 0 with all; missing components of shorter vectors count as 0; rows that repeat an id are
separate candidates, an anchor's positives have other ids than its own, and anchors that repeat an id are each answered; ties go to
the smaller id; extra columns do not matter. Scores from 2^53 to 2^63 are computed in 64-bit whole numbers; a table that
could pass these is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, cut, whole_numbers
from .topk import matrix

TREE, BLOCK, LEAF = 65_536, 4096, 64
#: Anchors of a block, how many of them are met at a time, and rows that are scored at a time.
ANCHORS, TILE, SCORED = 32_768, 1024, 1024
NONE = np.iinfo(np.int64).min
NO_ID = np.iinfo(np.int64).max
PARTS = "ids binary, labels binary, x binary, a binary, b binary, c binary, d binary, e binary"
NAMES = ["ids", "labels", "x", "a", "b", "c", "d", "e"]


def ball_tree(x: np.ndarray, labels: np.ndarray, leaf: int) -> tuple[np.ndarray, list[list[int]]]:
    """An order of the rows, and nodes in preorder: start, stop, parent (-1: none) in that order. Labels are parted first."""
    order, nodes = np.arange(len(x)), []
    todo = [(0, len(x), -1)] if len(x) else []
    while todo:
        start, stop, parent = todo.pop()
        me = len(nodes)
        nodes.append([start, stop, parent])
        own = order[start:stop]
        several = labels[own].min() != labels[own].max()
        if stop - start <= leaf:
            continue
        if several:
            own = own[np.argsort(labels[own], kind="stable")]
            edge = np.flatnonzero(np.diff(labels[own])) + 1
            half = int(edge[np.argmin(np.abs(edge - len(own) / 2))])
        else:
            v = x[own]
            wide = int(np.argmax(v.var(axis=0))) if v.shape[1] else 0
            half = len(own) // 2
            own = own[np.argpartition(v[:, wide], half)] if v.shape[1] else own
        order[start:stop] = own
        todo += [(start + half, stop, me), (start, start + half, me)]
    return order, nodes


class Tree:
    """A block of rows and its nodes; level by level, leaves last."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, nodes: np.ndarray) -> None:
        """nodes: start, stop, parent of each, parents first; rows in the order of the leaves."""
        self.x, self.ids, self.labels = x, ids, labels
        self.start, self.stop, self.parent = nodes.T
        self.centre = np.array([x[a:b].mean(axis=0) for a, b in zip(self.start, self.stop, strict=True)])
        self.radius = np.array([np.sqrt(((x[a:b] - c) ** 2).sum(axis=1).max()) for a, b, c in zip(self.start, self.stop, self.centre, strict=True)])
        self.low = np.minimum.reduceat(np.append(labels, NO_ID), np.column_stack([self.start, self.stop]).ravel())[::2]
        self.high = np.maximum.reduceat(np.append(labels, NONE), np.column_stack([self.start, self.stop]).ravel())[::2]
        self.leaves = np.setdiff1d(np.arange(len(nodes)), self.parent)
        self.leaves = self.leaves[np.argsort(self.start[self.leaves])]


def products(a: np.ndarray, b: np.ndarray, wide: bool) -> np.ndarray:
    return a.astype(np.int64) @ b.astype(np.int64).T if wide else (a @ b.T).astype(np.int64)  # whole numbers below 2^53: exact


class Search:
    """Some anchors, their windows, and the k best rows of each window so far."""

    def __init__(self, x, ids, labels, low, high, k: int, same: bool, wide: bool) -> None:
        """low, high: a row an anchor, a column a window; an empty window has low > high."""
        self.x, self.ids, self.labels, self.low, self.high, self.k, self.same, self.wide = x, ids, labels, low, high, k, same, wide
        self.length = np.sqrt((x * x).sum(axis=1))
        shape = (*low.shape, k)
        self.scores, self.found = np.full(shape, NONE), np.full(shape, NO_ID)

    def floors(self) -> np.ndarray:
        return np.maximum(self.low, self.scores[:, :, -1])

    def open_nodes(self, t: Tree) -> np.ndarray:
        """Anchor by node: whether rows inside may matter."""
        middle = self.x @ t.centre.T
        reach = self.length[:, None] * t.radius[None, :]
        slack = 1e-9 * (1 + np.abs(middle) + reach)
        above, beneath = middle + reach + slack, middle - reach - slack
        mine = self.labels[:, None]
        open_ = (t.low <= mine) & (mine <= t.high) if self.same else (t.low != mine) | (t.high != mine)
        floors, any_ = self.floors(), np.zeros_like(open_)
        for p in range(self.low.shape[1]):
            some = (self.low[:, p] <= self.high[:, p])[:, None]
            any_ |= some & (above >= floors[:, p, None]) & (beneath <= self.high[:, p, None])
        open_ &= any_
        for node, parent in enumerate(t.parent):
            if parent >= 0:
                open_[:, node] &= open_[:, parent]
        return open_

    def meet(self, t: Tree, work: np.ndarray) -> None:
        """work: pairs of anchors and rows, and how many of them were scored."""
        work[0] += len(self.x) * len(t.x)
        root = (t.low[0] <= self.labels) & (self.labels <= t.high[0]) if self.same else (self.labels != t.low[0]) | (self.labels != t.high[0])
        if not root.any():
            return
        open_ = self.open_nodes(t)[:, t.leaves]
        sizes = (t.stop - t.start)[t.leaves]
        group = np.cumsum(sizes) // SCORED
        lots = [np.flatnonzero(group == g) for g in np.unique(group)]
        nearest = [-(self.x @ t.centre[t.leaves[lot]].T).max(initial=-np.inf) for lot in lots]
        for i in np.argsort(nearest, kind="stable"):  # those that may raise the floors most come first
            lot = lots[i]
            rows = np.flatnonzero(open_[:, lot].any(axis=1))
            lot = lot[open_[:, lot].any(axis=0)]
            if len(rows):
                cols = np.concatenate([np.arange(t.start[n], t.stop[n]) for n in t.leaves[lot]])
                self.score(t, rows, cols, np.repeat(open_[np.ix_(rows, lot)], sizes[lot], axis=1), work)

    def score(self, t: Tree, rows: np.ndarray, cols: np.ndarray, open_: np.ndarray, work: np.ndarray) -> None:
        s = products(self.x[rows], t.x[cols], self.wide)
        work[1] += np.count_nonzero(open_)
        same = self.labels[rows][:, None] == t.labels[cols][None, :]
        open_ = open_ & (same & (self.ids[rows][:, None] != t.ids[cols][None, :]) if self.same else ~same)
        floors = self.floors()[rows]
        for p in range(self.low.shape[1]):
            fits = open_ & (s >= floors[:, p, None]) & (s <= self.high[rows, p][:, None])
            n = np.count_nonzero(fits)
            if n > 4 * self.k * len(rows) and s.shape[1] > self.k:
                fits &= s >= np.partition(np.where(fits, s, NONE), -self.k, axis=1)[:, -self.k, None]
            if n:
                r, c = np.nonzero(fits)
                self.add(p, rows[r], t.ids[cols[c]], s[r, c])

    def add(self, p: int, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        order = np.lexsort((ids, ~scores, rows))  # ~s falls as s grows, and never overflows
        rows, ids, scores = rows[order], ids[order], scores[order]
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        place = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
        rows, ids, scores, place = (v[place < self.k] for v in (rows, ids, scores, place))
        own, at = np.unique(rows, return_inverse=True)
        s, i = np.full((len(own), self.k), NONE), np.full((len(own), self.k), NO_ID)
        s[at, place], i[at, place] = scores, ids
        s, i = np.hstack([self.scores[own, p], s]), np.hstack([self.found[own, p], i])
        by = np.lexsort((i, ~s), axis=1)[:, : self.k]
        self.scores[own, p], self.found[own, p] = np.take_along_axis(s, by, 1), np.take_along_axis(i, by, 1)


def percent(scores: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The least whole number of at least low % of each score, the largest of at most high %; exact, without overflow."""
    whole, rest = np.divmod(scores, 100)
    return low * whole - (-low * rest) // 100, high * whole + (high * rest) // 100


class Miner:
    """The rows of a table that take part, and their trees."""

    def __init__(self, vectors: DataFrame, is_anchor: Column, id_col: str, label_col: str, vector_col: str, scale: float) -> None:
        whole_numbers(vectors, id_col)
        whole_numbers(vectors, label_col)
        self.spark = vectors.sparkSession
        v, id_, label = column(vector_col), column(id_col), column(label_col)
        finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
        valid = id_.isNotNull() & label.isNotNull() & v.isNotNull() & finite
        whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double"))
        rows = vectors.where(valid).select(id_.cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("asks"), whole.alias("x"))
        about = rows.agg(F.max(F.size("x")).alias("dim"), F.max(F.array_max(F.transform("x", F.abs))).alias("most"), F.count_if("asks").alias("asks")).first()
        self.dim, self.asks, most = about.dim, about.asks, about.most or 0.0
        if self.dim is None:
            return
        if most * most * max(1, self.dim) >= 2.0**63:
            raise ValueError("inner products may pass 64 bits")
        self.wide = most * most * max(1, self.dim) >= 2.0**53
        self.store = "<i2" if most < 1 << 15 else "<i8"
        spread = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.var_pop("v").alias("v")).orderBy(F.desc("v"), "i").limit(1).collect()
        lead = F.coalesce(F.get("x", F.lit(spread[0].i)), F.lit(0.0)) if spread else F.lit(0.0)
        self.parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        ordered = rows.withColumn("lead", lead).repartitionByRange(self.parts, "label", "lead", "id").sortWithinPartitions("label", "lead", "id")
        self.trees = cut(ordered.select("id", "label", "x").mapInPandas(self.plant(), f"block long, low long, high long, n int, {PARTS}"))
        self.anchors = cut(rows.where("asks").select(F.monotonically_increasing_id().alias("key"), "id", "label", "x"))

    def plant(self):
        dim, store = self.dim, self.store

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            number, held = TaskContext.get().partitionId() << 24, []

            def blocks(pdf):
                nonlocal number
                x, ids, labels = matrix(pdf["x"].tolist(), dim), pdf["id"].to_numpy(np.int64), pdf["label"].to_numpy(np.int64)
                order, nodes = ball_tree(x, labels, LEAF)
                x, ids, labels = x[order], ids[order], labels[order]
                top, below = {}, {}  # each node's topmost node of at most BLOCK rows, and all nodes of that
                for i, (start, stop, parent) in enumerate(nodes):
                    root = top.get(parent, i if stop - start <= BLOCK else None)
                    if root is not None:
                        top[i] = root
                        below.setdefault(root, []).append(i)
                for root, own in below.items():
                    start, stop, _ = nodes[root]
                    place = {node: n for n, node in enumerate(own)}
                    shape = np.array([(nodes[i][0] - start, nodes[i][1] - start, place.get(nodes[i][2], -1)) for i in own], np.int64)
                    row = {"ids": ids[start:stop], "labels": labels[start:stop], "x": x[start:stop].astype(store), "a": shape}
                    yield pd.DataFrame({"block": [number], "low": [labels[start:stop].min()], "high": [labels[start:stop].max()], "n": [stop - start], **{c: [v.tobytes()] for c, v in row.items()}, **{c: [b""] for c in "bcde"}})
                    number += 1

            for pdf in batches:
                held.append(pdf)
                while sum(map(len, held)) >= TREE:
                    whole = pd.concat(held, ignore_index=True)
                    yield from blocks(whole[:TREE])
                    held = [whole[TREE:]]
            if sum(map(len, held)):
                yield from blocks(pd.concat(held, ignore_index=True))

        return run

    def search(self, anchors: DataFrame, k: int, same: bool, window: tuple[int, int] | None) -> DataFrame:
        """key, p, anchor_id, positive_id, positive_score, ids, scores (the k best of a slice) and work. anchors: key, id, label,
        x and, with a window (in percent of each positive's score), positives (id, score)."""
        dim, store, wide = self.dim, self.store, self.wide

        def lay_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            number, held = TaskContext.get().partitionId() << 24, []

            def row(own):
                if window is None:
                    most = 1
                    pos_id, pos_score = np.zeros((len(own), 1), np.int64), np.zeros((len(own), 1), np.int64)
                    low, high = np.full((len(own), 1), NONE), np.full((len(own), 1), NO_ID)
                else:
                    most = max(map(len, own["positives"]))
                    pos_id, pos_score = np.zeros((len(own), most), np.int64), np.zeros((len(own), most), np.int64)
                    there = np.zeros((len(own), most), bool)
                    for i, ps in enumerate(own["positives"]):
                        for j, p in enumerate(ps):
                            pos_id[i, j], pos_score[i, j], there[i, j] = p["id"], p["score"], True
                    low, high = percent(pos_score, *window)
                    low[~there], high[~there] = 0, -1
                arrays = {"ids": own["id"], "labels": own["label"], "a": own["key"]}
                packed = {c: v.to_numpy(np.int64).tobytes() for c, v in arrays.items()} | {"b": low.tobytes(), "c": high.tobytes(), "d": pos_id.tobytes(), "e": pos_score.tobytes()}
                return pd.DataFrame({"block": [number], "low": [own["label"].min()], "high": [own["label"].max()], "n": [len(own)], "x": [matrix(own["x"].tolist(), dim).astype(store).tobytes()], **{c: [v] for c, v in packed.items()}})

            for pdf in batches:
                held.append(pdf)
                while sum(map(len, held)) >= ANCHORS:
                    whole = pd.concat(held, ignore_index=True)
                    yield row(whole[:ANCHORS])
                    held, number = [whole[ANCHORS:]], number + 1
            if sum(map(len, held)):
                yield row(pd.concat(held, ignore_index=True))

        many = max(1, -(-self.asks // ANCHORS))
        laid = cut(anchors.repartitionByRange(many, "label", "key").sortWithinPartitions("label", "key").mapInPandas(lay_out, f"block long, low long, high long, n int, {PARTS}")).withColumnRenamed("block", "q")
        slices = max(1, -(-self.parts // many))
        deal = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
        wanted = laid.select("q", F.col("low").alias("least"), F.col("high").alias("most"))  # one short row for each ANCHORS anchors
        fits = F.expr("low <= most and least <= high") if same else F.expr("low < high or least < most or low <> least")
        trees = self.trees.withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int")).join(F.broadcast(wanted), fits)
        names = ["n", *NAMES]
        both = laid.select("q", deal.alias("slice"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("block"), *names).unionByName(trees.select("q", "slice", F.lit(1).alias("kind"), "block", *names))
        both = both.repartition(self.parts, "q", "slice").sortWithinPartitions("q", "slice", "kind", "block")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tiles, work = [], np.zeros(2, np.int64)

            def result():
                for t, keys, pos_id, pos_score in tiles:
                    n, p = np.nonzero(t.found[:, :, 0] != NO_ID)
                    if not len(n):
                        continue
                    got = [t.found[i, j] != NO_ID for i, j in zip(n, p, strict=True)]
                    ids = [t.found[i, j][g] for i, j, g in zip(n, p, got, strict=True)]
                    scores = [t.scores[i, j][g] for i, j, g in zip(n, p, got, strict=True)]
                    yield pd.DataFrame({"key": keys[n], "p": p.astype(np.int32), "anchor_id": t.ids[n], "positive_id": pos_id[n, p], "positive_score": pos_score[n, p], "ids": ids, "scores": scores, "work": [None] * len(n)})

            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    x = np.frombuffer(row.x, store).reshape(row.n, dim).astype(float)
                    ids, labels = np.frombuffer(row.ids, np.int64), np.frombuffer(row.labels, np.int64)
                    if row.kind == 0:
                        yield from result()
                        keys = np.frombuffer(row.a, np.int64)
                        low, high, pos_id, pos_score = (np.frombuffer(v, np.int64).reshape(row.n, -1) for v in (row.b, row.c, row.d, row.e))
                        cuts = [slice(a, a + TILE) for a in range(0, row.n, TILE)]
                        tiles = [(Search(x[c], ids[c], labels[c], low[c], high[c], k, same, wide), keys[c], pos_id[c], pos_score[c]) for c in cuts]
                        continue
                    tree = Tree(x, ids, labels, np.frombuffer(row.a, np.int64).reshape(-1, 3))
                    for t, *_ in tiles:
                        t.meet(tree, work)
            yield from result()
            yield pd.DataFrame({"key": [-1], "p": [-1], "anchor_id": [-1], "positive_id": [-1], "positive_score": [0], "ids": [np.zeros(0, np.int64)], "scores": [np.zeros(0, np.int64)], "work": [work]})

        return both.mapInPandas(run, "key long, p int, anchor_id long, positive_id long, positive_score long, ids array<long>, scores array<long>, work array<long>")

    def best(self, found: DataFrame, k: int) -> DataFrame:
        """The k best of all slices: own, an array of (minus, id)."""
        pairs = F.zip_with("ids", "scores", lambda i, s: F.struct((-s).alias("minus"), i.alias("id")))
        one = found.where("work is null").withColumn("own", pairs)
        return one.groupBy("key", "p", "anchor_id", "positive_id", "positive_score").agg(F.slice(F.array_sort(F.flatten(F.collect_list("own"))), 1, k).alias("own"))


def mined(vectors: DataFrame, is_anchor: Column, positives: int, k: int, low: int, high: int, id_col: str, label_col: str, vector_col: str, scale: float) -> tuple[Miner, DataFrame, DataFrame] | None:
    """The miner and what both searches found; None if there is nothing to search."""
    m = Miner(vectors, is_anchor, id_col, label_col, vector_col, scale)
    if m.dim is None or not m.asks:
        return None
    first = cut(m.search(m.anchors, positives, True, None))
    near = m.best(first, positives).select("key", F.transform("own", lambda o: F.struct(o["id"].alias("id"), (-o["minus"]).alias("score"))).alias("positives"))
    return m, first, cut(m.search(m.anchors.join(near, "key"), k, False, (low, high)))


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, k: int = 10, low: int = 30, high: int = 90, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score: for each anchor and each of its `positives` best
    others of its label, the k best rows of other labels with low % to high % of the positive's score."""
    done = mined(vectors, is_anchor, positives, k, low, high, id_col, label_col, vector_col, scale)
    if done is None:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    m, _, found = done
    out = m.best(found, k).select("anchor_id", "positive_id", "positive_score", F.posexplode("own").alias("rank", "o"))
    return out.select("anchor_id", "positive_id", (F.col("rank") + 1).alias("rank"), F.col("o.id").alias("negative_id"), "positive_score", (-F.col("o.minus")).alias("negative_score"))


def work(vectors: DataFrame, is_anchor: Column, positives: int = 5, k: int = 10, low: int = 30, high: int = 90, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: float = 256.0) -> list[list[int]]:
    """For both searches: pairs of anchors and rows in the trees that were sent, and how many of them were scored."""
    done = mined(vectors, is_anchor, positives, k, low, high, id_col, label_col, vector_col, scale)
    if done is None:
        return []
    return [list(f.where("work is not null").agg(F.sum(F.col("work")[0]), F.sum(F.col("work")[1])).first()) for f in done[1:]]
