"""Cheapest paths over a graph that is cut into regions.

A walker's state is a node and the kind of the edge that led there: a change of indoor costs `door`, and each level of a change
costs `jump` unless one of the two edges is stepped; the first edge is free of both. Each region is searched by one task: from every
way in (a node and the kind of an edge that crosses the border) to every way out. These arcs between ways in are a table that is
built once; a search is a few rounds over it, one for each region that a path crosses, instead of one for each node.
States keep the way in that they came from, no paths; a path is unrolled at the end, all its legs at once.

Several searches (q) run together, each over one of several cost columns (variant). Edges: variant, a, b, cost and the kind
(indoor, level, stepped), taken both ways; null costs are closed. A null in a kind costs no change. Regions must fit a task."""

from __future__ import annotations

import heapq
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import both_ways, ensure_checkpoints, shared_folder

KIND = ["indoor", "level", "stepped"]
#: Regions that one task of trees takes together.
BLOCK = 256
ROWS = "variant int, region long, role int, a long, b long, cost double, kind long, tid long"


def regions_of(nodes: DataFrame, per_region: int) -> DataFrame:
    """node, region: nodes (node, x, y) in the order of a curve that keeps neighbours together (bits of x and y in turn),
    cut into runs of about per_region."""
    ensure_checkpoints(nodes.sparkSession)
    span = nodes.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("n")).first()
    if not span.n:
        return nodes.select("node", F.lit(0).cast("long").alias("region"))
    unit = max(span.x1 - span.x0, span.y1 - span.y0) / 65535 or 1.0
    at = {c: F.floor((F.col(c) - low) / unit).cast("long") for c, low in (("x", span.x0), ("y", span.y0))}
    bit = lambda c, i: F.shiftleft(F.shiftright(at[c], i).bitwiseAND(F.lit(1)), 2 * i + (c == "y"))
    place = sum((bit(c, i) for i in range(16) for c in "xy"), F.lit(0).cast("long"))
    parts = max(1, round(span.n / per_region / BLOCK))  # many regions each: their number grows with the nodes
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    # written at once: numbers of rows must not change when a task runs again
    runs = nodes.withColumn("place", place).repartitionByRange(parts, "place", "node").sortWithinPartitions("place", "node").select("node", F.spark_partition_id().alias("part"), row.alias("row")).checkpoint()
    offsets, before = [], 0
    for r in runs.groupBy("part").count().orderBy("part").collect():  # a row a partition
        offsets.append((r.part, before))
        before += r["count"]
    regions = max(1, round(span.n / per_region))
    offsets = F.broadcast(nodes.sparkSession.createDataFrame(offsets, "part int, before long"))
    return runs.join(offsets, "part").select("node", F.floor((F.col("before") + F.col("row")) * regions / span.n).cast("long").alias("region"))


def kind_number():
    """A kind as one number, nulls included."""
    flag = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(2))
    return (flag("indoor") + 3 * flag("stepped") + 9 * F.coalesce(F.col("level") + (1 << 20), F.lit(0))).cast("long")


class Changes:
    """What it costs to follow an edge of one kind by one of another; kind -1: no edge yet."""

    def __init__(self, door: float, jump: float) -> None:
        self.door, self.jump, self.known = door, jump, {}

    def __call__(self, was: int, now: int) -> float:
        cost = self.known.get((was, now))
        if cost is None:
            cost = 0.0
            if was >= 0:
                (i, s, n), (j, t, m) = ((k % 3, k // 3 % 3, k // 9) for k in (was, now))
                cost += self.door if i != j and 2 not in (i, j) else 0.0
                cost += 0.0 if 1 in (s, t) or 2 in (s, t) or not n or not m else abs(n - m) * self.jump
            self.known[was, now] = cost
        return cost


class Region:
    """The edges of one region, and those that leave it."""

    def __init__(self, rows: pd.DataFrame, change: Changes) -> None:
        self.change, self.next, self.leave = change, {}, {}
        for role, a, b, cost, kind, tid in zip(*(rows[c].tolist() for c in ("role", "a", "b", "cost", "kind", "tid")), strict=True):
            if role == 0:
                self.next.setdefault(a, []).append((b, cost, kind))
            elif role == 2:
                self.leave.setdefault(a, []).append((b, cost, kind, tid))

    def settle(self, seeds: list[tuple[float, int, int, int]]) -> dict[tuple[int, int], tuple[float, int, int, int]]:
        """(node, kind): cost, the state before (node, kind; -1, -1: none) and the seed; seeds: cost, node, kind, name."""
        heap = [(c, n, k, -1, -1, s) for c, n, k, s in seeds]
        heapq.heapify(heap)
        done: dict = {}
        while heap:
            cost, node, kind, pn, pk, seed = heapq.heappop(heap)
            if (node, kind) in done:
                continue
            done[node, kind] = (cost, pn, pk, seed)
            for b, c, k in self.next.get(node, ()):
                if (b, k) not in done:
                    heapq.heappush(heap, (cost + c + self.change(kind, k), b, k, node, kind, seed))
        return done

    def exits(self, done: dict) -> dict[int, tuple[float, int, int]]:
        """tid: cost of the next region's way in, the node left from and the seed."""
        out: dict = {}
        for (node, kind), (cost, _, _, seed) in done.items():
            for _, c, k, tid in self.leave.get(node, ()):
                new = (cost + c + self.change(kind, k), node, seed)
                if tid not in out or new < out[tid]:
                    out[tid] = new
        return out


@dataclass
class Overlay:
    """Tables: rows of regions (role 0: inside, 2: leaving, tid: the way in that it leads to), ways in, arcs between them, regions of nodes."""

    rows: DataFrame
    ways: DataFrame
    arcs: DataFrame
    regions: DataFrame
    costs: dict[int, tuple[float, float]]


def _placed(edges: DataFrame, regions: DataFrame) -> DataFrame:
    """Edges in both directions with the regions ra and rb of their ends; of equal ones the cheapest."""
    both = both_ways(edges.select("variant", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("cost").cast("double").alias("cost"), kind_number().alias("kind"))).where("cost is not null and a <> b")
    side = lambda n: regions.select(F.col("node").cast("long").alias(n), F.col("region").alias(f"r{n}"))
    return both.groupBy("variant", "a", "b", "kind").agg(F.min("cost").alias("cost")).join(side("a"), "a").join(side("b"), "b")


def build(edges: DataFrame, regions: DataFrame, costs: dict[int, tuple[float, float]]) -> Overlay:
    """costs: (door, jump) of each variant."""
    ensure_checkpoints(edges.sparkSession)
    both = _placed(edges, regions).checkpoint()
    cross = both.where("ra <> rb")
    ways = cross.select("variant", F.col("rb").alias("region"), F.col("b").alias("node"), "kind").distinct().withColumn("sid", F.monotonically_increasing_id()).checkpoint()
    leaving = cross.join(ways.select("variant", F.col("node").alias("b"), "kind", F.col("sid").alias("tid")), ["variant", "b", "kind"])
    no_tid = F.lit(-1).cast("long")
    rows = both.where("ra = rb").select("variant", F.col("ra").alias("region"), F.lit(0).alias("role"), "a", "b", "cost", "kind", no_tid.alias("tid"))
    rows = rows.unionByName(leaving.select("variant", F.col("ra").alias("region"), F.lit(2).alias("role"), "a", "b", "cost", "kind", "tid")).checkpoint()
    entering = ways.select("variant", "region", F.lit(1).alias("role"), F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0.0).alias("cost"), "kind", F.col("sid").alias("tid"))

    def arcs_of(key, pdf: pd.DataFrame) -> pd.DataFrame:
        region, out = Region(pdf, Changes(*costs[int(key[0])])), []
        for a, kind, sid in zip(*(pdf.loc[pdf["role"] == 1, c].tolist() for c in ("a", "kind", "tid")), strict=True):
            out += [(sid, tid, c, w) for tid, (c, w, _) in region.exits(region.settle([(0.0, a, kind, sid)])).items()]
        return pd.DataFrame(out, columns=["sid", "tid", "arc", "via"])

    arcs = rows.unionByName(entering).groupBy("variant", "region").applyInPandas(arcs_of, "sid long, tid long, arc double, via long").checkpoint()
    return Overlay(rows, ways, arcs, regions, costs)


def in_regions(o: Overlay, seeds: DataFrame, run, schema: str) -> DataFrame:
    """run(region, seeds) in each region that seeds (variant, region, ...) name; rows of the others are not sent."""
    seeds = seeds.select(*[F.col(c).alias(c) for c in seeds.columns])  # columns of its own: seeds may come from the rows
    named = seeds.select("variant", "region").distinct()
    own, costs = o.rows.join(named, ["variant", "region"], "left_semi"), o.costs

    def both(key, rows: pd.DataFrame, own_seeds: pd.DataFrame) -> pd.DataFrame:
        return run(Region(rows, Changes(*costs[int(key[0])])), own_seeds)

    return own.groupBy("variant", "region").cogroup(seeds.groupBy("variant", "region")).applyInPandas(both, schema)


@dataclass
class Found:
    """What searches reached: starts (q, variant, node, region), best (q, sid, cost, prev, via; prev -1: from the start), ends
    (q, cost, sid of the last way in, -1: none) where there were targets, and work (round, tried, dropped)."""

    starts: DataFrame
    best: DataFrame
    ends: DataFrame | None
    work: list[tuple[int, int, int]]


def search(o: Overlay, starts: DataFrame, marks: DataFrame | None = None) -> Found:
    """starts: q, variant, node and, for a search to one place, target. marks (node, marks): costs of each node to some landmarks,
    none above the searches' own costs; with them states that can't beat the best path known to the target are dropped."""
    spark = o.rows.sparkSession
    home = o.regions.select(F.col("node").cast("long").alias("node"), "region")
    starts = starts.join(home, "node").checkpoint()
    with_target = "target" in starts.columns

    def leave(region: Region, seeds: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in seeds.itertuples(index=False):
            done = region.settle([(0.0, row.node, -1, -1)])
            out += [(row.q, tid, c, -1, w) for tid, (c, w, _) in region.exits(done).items()]
            if with_target:
                direct = min((c for (n, _), (c, *_) in done.items() if n == row.target), default=None)
                if direct is not None:
                    out.append((row.q, -1, direct, -1, row.target))
        return pd.DataFrame(out, columns=["q", "sid", "cost", "prev", "via"])

    schema = "q long, sid long, cost double, prev long, via long"
    first = in_regions(o, starts, leave, schema).checkpoint()
    best, work = first.where("sid >= 0"), []
    direct = first.where("sid < 0").select("q", F.col("cost").alias("total"), F.col("sid").alias("last"))
    finish = aim = None
    if with_target:
        goals = starts.select("q", "variant", "target").join(home.withColumnRenamed("node", "target"), "target")
        ways = goals.join(o.ways, ["variant", "region"]).select("variant", "region", "q", "target", "sid", "node", "kind")

        def rest(region: Region, seeds: pd.DataFrame) -> pd.DataFrame:
            out = []
            for row in seeds.itertuples(index=False):
                c = min((c for (n, _), (c, *_) in region.settle([(0.0, row.node, row.kind, row.sid)]).items() if n == row.target), default=None)
                if c is not None:
                    out.append((row.q, row.sid, c))
            return pd.DataFrame(out, columns=["q", "sid", "rest"])

        finish = in_regions(o, ways, rest, "q long, sid long, rest double").checkpoint()
        if marks is not None:
            at = o.ways.select("sid", "node").join(marks, "node").select("sid", "marks")
            aim = (at, goals.select("q", F.col("target").alias("node")).join(marks, "node").select("q", F.col("marks").alias("aim")))

    def ends_of(reached: DataFrame) -> DataFrame:
        total = reached.join(finish, ["q", "sid"]).select("q", (F.col("cost") + F.col("rest")).alias("total"), F.col("sid").alias("last")).unionByName(direct)
        return total.groupBy("q").agg(F.min(F.struct("total", "last")).alias("e")).select("q", "e.total", "e.last")

    def bounded(tried: DataFrame) -> DataFrame:
        """tried with whether it can still be part of a better path than the best known."""
        known = ends_of(best)
        out = tried.join(known.select("q", "total"), "q", "left")
        least = F.lit(0.0)
        if aim is not None:
            out = out.join(aim[0], "sid", "left").join(aim[1], "q", "left")
            gaps = F.transform(F.arrays_zip("marks", "aim"), lambda m: F.abs(m["marks"] - m["aim"]))
            least = F.coalesce(F.array_max(gaps), F.lit(0.0))
        hope = F.col("cost") + least <= F.col("total") * (1 + 1e-12)
        return out.select(*tried.columns, F.coalesce(hope, F.lit(True)).alias("hope"))

    fresh = best
    while True:
        tried = fresh.select("q", "sid", "cost").join(o.arcs, "sid").groupBy("q", F.col("tid").alias("sid")).agg(F.min(F.struct((F.col("cost") + F.col("arc")).alias("cost"), F.col("sid").alias("prev"), "via")).alias("n")).select("q", "sid", "n.cost", "n.prev", "n.via")
        if with_target:
            tried = bounded(tried).checkpoint()
            counts = tried.agg(F.count("*").alias("n"), F.count_if(~F.col("hope")).alias("dropped")).first()
            work.append((len(work) + 1, counts.n, counts.dropped))
            tried = tried.where("hope").drop("hope")
        merged = best.withColumn("new", F.lit(0)).unionByName(tried.withColumn("new", F.lit(1))).groupBy("q", "sid").agg(F.min(F.struct("cost", "new", "prev", "via")).alias("b"))
        merged = merged.select("q", "sid", "b.cost", "b.prev", "b.via", "b.new").checkpoint()
        best, fresh = merged.drop("new"), merged.where("new = 1").drop("new")
        if fresh.isEmpty():
            break
    ends = ends_of(best).checkpoint() if with_target else None
    return Found(starts, best, ends, work)


def costs(o: Overlay, found: Found) -> DataFrame:
    """q, node, cost and the node before (null: the start) of all nodes that a search without targets reaches."""
    ways = o.ways.withColumnRenamed("sid", "s").join(found.best, F.col("s") == F.col("sid")).select("q", "variant", "region", "node", "kind", "cost", "via")
    own = found.starts.select("q", "variant", "region", "node", F.lit(-1).cast("long").alias("kind"), F.lit(0.0).alias("cost"), F.lit(-1).cast("long").alias("via"))

    def fill(region: Region, seeds: pd.DataFrame) -> pd.DataFrame:
        out = []
        for q, rows in seeds.groupby("q"):
            via = rows["via"].tolist()
            done = region.settle([(c, n, k, i) for i, (c, n, k) in enumerate(zip(rows["cost"].tolist(), rows["node"].tolist(), rows["kind"].tolist(), strict=True))])
            nodes: dict = {}
            for (node, _), (cost, pn, _, seed) in done.items():
                new = (cost, pn if pn >= 0 else via[seed])
                if node not in nodes or new < nodes[node]:
                    nodes[node] = new
            out += [(q, n, c, None if p < 0 else p) for n, (c, p) in nodes.items()]
        return pd.DataFrame(out, columns=["q", "node", "cost", "prev"]).astype({"prev": "Int64"})

    return in_regions(o, ways.unionByName(own), fill, "q long, node long, cost double, prev long")


def paths(o: Overlay, found: Found) -> DataFrame:
    """q, place (from 0), a, b: the edges of the path of each search with a target, in their order."""
    ways = o.ways.select(F.col("sid"), "variant", "region", "node", "kind")
    goal = found.starts.select("q", F.col("target").alias("exit"))
    legs = found.ends.join(goal, "q").select("q", F.lit(0).alias("back"), F.col("last").alias("sid"), F.lit(-1).cast("long").alias("tid"), "exit").checkpoint()
    parts = [legs]
    while not legs.where("sid >= 0").isEmpty():  # a round for each region that the longest path crosses
        legs = legs.where("sid >= 0").join(found.best.select("q", "sid", "prev", "via"), ["q", "sid"]).select("q", (F.col("back") + 1).alias("back"), F.col("prev").alias("sid"), F.col("sid").alias("tid"), F.col("via").alias("exit")).checkpoint()
        parts.append(legs)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    later = whole.where("sid >= 0").join(ways, "sid").select("q", "back", "variant", "region", "node", "kind", "tid", "exit")
    own = found.starts.select("q", "variant", "region", "node", F.lit(-1).cast("long").alias("kind"))
    whole = later.unionByName(whole.where("sid < 0").select("q", "back", "tid", "exit").join(own, "q"))

    def unroll(region: Region, legs: pd.DataFrame) -> pd.DataFrame:
        out = []
        for leg in legs.itertuples(index=False):
            done = region.settle([(0.0, leg.node, leg.kind, 0)])
            step = [(c + cost + region.change(k, kind), k, b) for (n, k), (c, *_) in done.items() if n == leg.exit for b, cost, kind, tid in region.leave.get(n, ()) if tid == leg.tid]
            if leg.tid < 0:
                step = [(c, k, None) for (n, k), (c, *_) in done.items() if n == leg.exit]
            _, kind, beyond = min(step, key=lambda s: s[:2])
            nodes, at = [] if beyond is None else [beyond], (leg.exit, kind)
            while at[0] >= 0:
                nodes.append(at[0])
                at = done[at][1:3]
            nodes.reverse()
            out += [(leg.q, leg.back, i, a, b) for i, (a, b) in enumerate(zip(nodes, nodes[1:], strict=False))]
        return pd.DataFrame(out, columns=["q", "back", "i", "a", "b"])

    steps = in_regions(o, whole, unroll, "q long, back int, i int, a long, b long")
    # the places of a path: its own rows only, as many as it has edges
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("back"), "i")) - 1
    return steps.select("q", place.alias("place"), "a", "b")


def landmark_costs(o: Overlay, landmarks: DataFrame) -> DataFrame:
    """node, marks: costs to each of a few landmarks (variant, node), in the order of their nodes; null where there is no way."""
    q = landmarks.select("variant", F.col("node").cast("long").alias("node"), F.col("node").cast("long").alias("q"))
    order = [r.q for r in q.select("q").distinct().orderBy("q").limit(64).collect()]  # a few by contract
    got = costs(o, search(o, q)).groupBy("node").agg(*[F.max(F.when(F.col("q") == n, F.col("cost"))).alias(f"m{i}") for i, n in enumerate(order)])
    return got.select("node", F.array(*[f"m{i}" for i in range(len(order))]).alias("marks")).checkpoint()


@dataclass
class Trees:
    """Cheapest ways from roots (q, variant, node, block) to everything, block by block: packed blocks in a folder that is listed once, regions with their
    block, and labels: the ways into blocks that are known, with the state before and its cost (pn, pk in block pb, pcost; -1: a root)."""

    blocks: DataFrame
    home: DataFrame
    roots: DataFrame
    labels: DataFrame
    costs: dict[int, tuple[float, float]]


LABELS = "q long, variant int, block long, node long, kind long, cost double, edges long, walked double, pn long, pk long, pb long, pcost double"
LABEL_NAMES = [c.split()[0] for c in LABELS.split(", ")]
#: States that are settled at once, of all searches of a block together; one search takes what it needs.
STATES = 2_000_000


def pack(pdf: pd.DataFrame, cost: str) -> tuple[bytes, int | None, int | None]:
    """Arrays of a block from its rows (a, b, kind, to, length and a cost; null: closed), and its lowest and highest level. A state is a node and the
    kind of an edge that leads there; edges start at a node and end in a state. Edges between two nodes are as long as the shortest of them."""
    a, b, length = pdf["a"].to_numpy("i8"), pdf["b"].to_numpy("i8"), pdf["length"].to_numpy("f8")
    order = np.lexsort((length, b, a))  # NaN last
    a, b, length = a[order], b[order], length[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    length = length[np.flatnonzero(new)][np.cumsum(new) - 1]
    price, kind, to, own = pdf[cost].to_numpy("f8")[order], pdf["kind"].to_numpy("i8")[order], pdf["to"].to_numpy("i8")[order], pdf["block"].to_numpy("i8")
    if (price < 0).any():
        raise ValueError("a cheapest way needs costs that are not negative")
    keep = ~np.isnan(price)
    a, b, length, price, kind, to = a[keep], b[keep], length[keep], price[keep], kind[keep], to[keep]
    nodes, src = np.unique(a, return_inverse=True)
    kinds, kind = np.unique(kind, return_inverse=True)
    inside, many = to == own[:1], max(len(kinds), 1)
    goal = np.searchsorted(nodes, b[inside]) * many + kind[inside]
    states = np.unique(np.concatenate([goal, src[~inside] * many + kind[~inside]]))  # edges that leave lead here as well
    arrays = {
        "nodes": nodes, "kinds": kinds, "states": states, "first": np.searchsorted(src[inside], np.arange(len(nodes) + 1)),
        "goal": np.searchsorted(states, goal).astype("i4"), "kind": kind[inside].astype("i4"), "cost": price[inside], "length": length[inside],
        "out": src[~inside].astype("i4"), "out_node": b[~inside], "out_kind": kind[~inside].astype("i4"), "out_cost": price[~inside], "out_length": length[~inside], "out_block": to[~inside],
    }
    file = io.BytesIO()
    np.savez(file, **arrays)
    levels = kinds[kinds >= 9] // 9
    return file.getvalue(), *((int(levels.min()), int(levels.max())) if len(levels) else (None, None))


def _runs(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of ranges one after the other, and the range of each."""
    size = last - first
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) + (first - np.cumsum(size) + size)[of], of


def _least(keys: tuple, group: np.ndarray) -> np.ndarray:
    """Places of the least keys (the first one counts most) of each group, in the groups' order."""
    order = np.lexsort((*reversed(keys), group))
    new = np.ones(len(order), bool)
    new[1:] = group[order[1:]] != group[order[:-1]]
    return order[new]


class Block:
    """A packed block. Roots among the labels have states of their own, behind all others: no kind leads to them."""

    def __init__(self, packed: bytes | None, labels: pd.DataFrame, change: Changes) -> None:
        if packed is None:
            packed, *_ = pack(pd.DataFrame(columns=["a", "b", "length", "kind", "to", "block", "cost"]), "cost")
        with np.load(io.BytesIO(packed)) as f:
            self.__dict__ |= {n: f[n] for n in f.files}
        many = max(len(self.kinds), 1)
        roots = np.unique(labels.loc[labels["kind"] == -1, "node"].to_numpy("i8"))
        at = np.searchsorted(self.nodes, roots)
        known = at < len(self.nodes)
        known[known] = self.nodes[at[known]] == roots[known]
        node, kind = np.divmod(self.states, many)
        self.many, self.roots, self.n = many, roots, len(self.states) + len(roots)
        self.place = np.concatenate([node, np.where(known, at, len(self.nodes))])  # the node's number; a root without edges comes after all
        self.via = np.concatenate([kind, np.full(len(roots), len(self.kinds))]).astype("i4")
        self.names = np.concatenate([self.nodes[node], roots])
        self.first = np.append(self.first, self.first[-1])
        self.by_place = np.argsort(self.place, kind="stable")
        self.sizes = np.searchsorted(self.place[self.by_place], np.arange(len(self.nodes) + 1))
        self.table = np.array([[change(int(was), int(now)) for now in self.kinds] for was in [*self.kinds, -1]], float).reshape(-1, many)
        self.step = 2 * float(self.cost.mean()) if len(self.cost) else 1.0

    def number(self, node: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Numbers of states that the block has."""
        n = np.searchsorted(self.nodes, node) * self.many + np.searchsorted(self.kinds, kind)
        return np.where(kind == -1, len(self.states) + np.searchsorted(self.roots, node), np.searchsorted(self.states, n))

    def settle(self, labels: pd.DataFrame):
        """For each q, as many together as STATES allows: q, its labels, and of each state the cost, edges and metres from the root, and the state before
        (-1: never reached, -2 - i: label i of this q). Of equal costs the least edges count, then the least metres."""
        own = [(int(q), rows) for q, rows in labels.groupby("q")]
        lot = max(1, STATES // max(self.n, 1))
        for i in range(0, len(own), lot):
            some = own[i : i + lot]
            got = self._settle([rows for _, rows in some])
            for j, (q, rows) in enumerate(some):
                yield q, rows, *(x[j * self.n : (j + 1) * self.n] for x in got)

    def _settle(self, labels: list[pd.DataFrame]):
        n = self.n
        cost, edges, walked, before = np.full(n * len(labels), np.inf), np.zeros(n * len(labels), "i4"), np.zeros(n * len(labels)), np.full(n * len(labels), -1, "i8")
        waits = np.zeros(n * len(labels), bool)

        def better(at, c, e, w, b):
            """Takes what is better than what is known, and gives the states that it is for."""
            was = cost[at]
            good = c < was
            if (same := c == was).any():
                good |= same & ((e < edges[at]) | ((e == edges[at]) & (w < walked[at])))
            at, c, e, w, b = at[good], c[good], e[good], w[good], b[good]
            best = _least((c, e, w), at)
            at = at[best]
            cost[at], edges[at], walked[at], before[at] = c[best], e[best], w[best], b[best]
            at = at[~waits[at]]
            waits[at] = True
            return at

        front = [better(j * n + self.number(rows["node"].to_numpy("i8"), rows["kind"].to_numpy("i8")), *(rows[c].to_numpy() for c in ("cost", "edges", "walked")), -2 - np.arange(len(rows))) for j, rows in enumerate(labels)]
        front = np.concatenate(front) if front else np.empty(0, "i8")
        while len(front):
            near = cost[front]
            near = near <= near.min() + self.step
            now, front = front[near], front[~near]
            waits[now] = False
            state = now % n
            place = self.place[state]
            e, of = _runs(self.first[place], self.first[place + 1])
            at = now[of]
            kind = self.kind[e]
            found = better(at - state[of] + self.goal[e], cost[at] + self.cost[e] + self.table[self.via[state][of], kind], edges[at] + 1, walked[at] + self.length[e], state[of])
            front = np.concatenate([front, found])
        return cost, edges, walked, before

    def exits(self, cost, edges, walked):
        """The cheapest way out to each state of other blocks: node, kind, block, cost, edges, metres, and the state left from."""
        at, of = _runs(self.sizes[self.out], self.sizes[self.out + 1])
        at = self.by_place[at]
        new = cost[at] + self.out_cost[of] + self.table[self.via[at], self.out_kind[of]]
        keep = np.flatnonzero(new < np.inf)
        at, of, new = at[keep], of[keep], new[keep]
        e, w = edges[at] + 1, walked[at] + self.out_length[of]
        names, node = np.unique(self.out_node, return_inverse=True)
        best = _least((new, e, w, self.names[at]), node[of] * self.many + self.out_kind[of])
        at, of = at[best], of[best]
        return self.out_node[of], self.kinds[self.out_kind[of]], self.out_block[of], new[best], e[best], w[best], at

    def label(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and kinds of states."""
        return self.names[at], np.append(self.kinds, -1)[self.via[at]]

    def ends(self, cost, edges, walked) -> np.ndarray:
        """Of each node that is reached the best state, in the nodes' order."""
        at = np.flatnonzero(cost < np.inf)
        return at[_least((cost[at], edges[at], walked[at]), self.names[at])]


_TURNS: dict[int, list[int]] = {}


def _slots(spark, parts: int, many: int) -> list[int]:
    """Numbers that a shuffle by them deals over its partitions in turn."""
    if parts not in _TURNS:
        by: list = [[] for _ in range(parts)]
        for r in spark.range(40 * parts).select("id", F.expr(f"pmod(hash(id), {parts})").alias("p")).collect():
            by[r.p].append(r.id)
        _TURNS[parts] = [by[i % parts][i // parts] for i in range(min(map(len, by)) * parts)]
    turns = _TURNS[parts]
    return turns[:many] + list(range(40 * parts, 40 * parts + max(0, many - len(turns))))


def _in_blocks(blocks: DataFrame, seeds: DataFrame, pairs: list[tuple[int, int]], run, schema: str, costs: dict[int, tuple[float, float]]) -> DataFrame:
    """run(block, its number, seeds) in these pairs (variant, block); only their blocks are read. Each is a task's, as far as there are partitions."""
    spark = seeds.sparkSession
    slots = _slots(spark, int(spark.conf.get("spark.sql.shuffle.partitions")), len(pairs))
    named = spark.createDataFrame([(s, v, b) for s, (v, b) in zip(slots, pairs, strict=True)], "slot long, variant int, block long")
    of = lambda name: F.broadcast(named.select(F.col("slot").alias(name), "variant", "block"))  # noqa: E731 - a row a pair
    rows = blocks.where(F.col("variant").isin(sorted({v for v, _ in pairs})) & F.col("block").isin(sorted({b for _, b in pairs}))).join(of("slot"), ["variant", "block"]).select("slot", "arrays")

    def both(key, rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return own.iloc[:0].reindex(columns=[c.split()[0] for c in schema.split(", ")])
        labels = own[~own["leg"]] if "leg" in own else own
        block = Block(rows["arrays"].iloc[0] if len(rows) else None, labels, Changes(*costs[int(own["variant"].iloc[0])]))
        return run(block, int(own["block"].iloc[0]), own)

    return rows.groupBy("slot").cogroup(seeds.join(of("own_slot"), ["variant", "block"]).groupBy("own_slot")).applyInPandas(both, schema)


def _pairs(df: DataFrame) -> list[tuple[int, int]]:
    return sorted((r.variant, r.block) for r in df.select("variant", "block").distinct().collect())  # a few thousand nodes each


def trees(edges: DataFrame, regions: DataFrame, roots: DataFrame, costs: dict[int, tuple[float, float]], block: int = BLOCK) -> Trees:
    """Searches without arcs between ways in, for few roots (q, variant, node). `block` regions that follow each other are one task's, which settles
    all of them from the labels known at its border and hands on what crosses it; only blocks whose labels became cheaper take part in the
    next round. A round is a block's width of progress, and no more than each block's states is worked on. Labels carry the edges and the metres of
    their ways (length, if edges have it), so that figures of ways need no way written out."""
    length = F.col("length") if "length" in edges.columns else F.lit(0.0)
    return _trees(edges.withColumn("length", length), regions, roots, costs, {v: "cost" for v in costs}, block)


def _trees(edges: DataFrame, regions: DataFrame, roots: DataFrame, costs: dict[int, tuple[float, float]], columns: dict[int, str], block: int) -> Trees:
    """trees over edges with a cost column of each variant, or a column variant."""
    spark = edges.sparkSession
    ensure_checkpoints(spark)
    # a node that is given twice has one home; joins by node follow, which would deal the nodes anyway
    home = regions.groupBy(F.col("node").cast("long").alias("node")).agg(F.floor(F.min("region") / block).cast("long").alias("block"))
    side = lambda n, to: home.select(F.col("node").alias(n), F.col("block").alias(to))
    own = ["variant"] if "variant" in edges.columns else []
    prices = sorted(set(columns.values()))
    one = edges.select(*own, F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), kind_number().alias("kind"), F.col("length").cast("double").alias("length"), *[F.col(c).cast("double").alias(c) for c in prices])
    one = one.where("a <> b").join(side("a", "block"), "a").join(side("b", "to"), "b")
    ways = F.array(F.struct("a", "b", "block", "to"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("to").alias("block"), F.col("block").alias("to")))
    both = one.select(F.explode(ways).alias("w"), *own, "kind", "length", *prices).select("w.*", *own, "kind", "length", *prices)
    free = {v for v, c in costs.items() if not any(c)}

    def packed(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(batches)
        for variant in [int(key[1])] if own else sorted(columns):
            if variant in costs:
                # where no change costs anything a node is one state
                row = (variant, int(key[0]), *pack(pdf.assign(kind=0) if variant in free else pdf, columns[variant]))
                yield pd.DataFrame([row], columns=["variant", "block", "arrays", "low", "high"]).astype({"low": "Int64", "high": "Int64"})

    path = f"{shared_folder(spark)}/blocks-{uuid.uuid4().hex}"
    both.groupBy("block", *own).applyInPandas(packed, "variant int, block long, arrays binary, low long, high long").write.partitionBy("variant", "block").parquet(path)
    blocks = spark.read.schema("arrays binary, low long, high long, variant int, block long").parquet(path)
    levels = blocks.agg(F.min("low").alias("low"), F.max("high").alias("high")).first()
    gap = levels.high - levels.low if levels.low is not None else 0
    none = lambda c: F.lit(-1).cast("long").alias(c)
    roots = roots.select(F.col("q").cast("long").alias("q"), "variant", F.col("node").cast("long").alias("node")).join(home, "node").checkpoint()
    labels = roots.select("q", "variant", "block", "node", none("kind"), F.lit(0.0).alias("cost"), F.lit(0).cast("long").alias("edges"), F.lit(0.0).alias("walked"), none("pn"), none("pk"), none("pb"), F.lit(0.0).alias("pcost"), F.lit(1).alias("new")).checkpoint()

    def spread(own: Block, block: int, known: pd.DataFrame) -> pd.DataFrame:
        parts, variant = [], int(known["variant"].iloc[0])
        door, jump = costs[variant]
        known = known[known.groupby("q")["new"].transform("max") == 1]
        for q, mine, cost, edges, walked, _ in own.settle(known):
            node, kind, to, c, e, w, at = own.exits(cost, edges, walked)
            # a neighbour that sent a label from this node for less, whatever changes cost there, has no use for this one
            back, sent = mine["pn"].to_numpy("i8"), mine["pcost"].to_numpy("f8")
            first = _least((sent,), back)
            back, sent = back[first], sent[first]
            i = np.minimum(np.searchsorted(back, node), len(back) - 1)
            use = (back[i] != node) | (c <= (sent[i] + door + jump * gap) * (1 + 1e-12))
            pn, pk = own.label(at)
            parts.append(pd.DataFrame({"q": q, "variant": variant, "block": to, "node": node, "kind": kind, "cost": c, "edges": e, "walked": w, "pn": pn, "pk": pk, "pb": block, "pcost": cost[at]})[use])
        return pd.concat(parts) if parts else pd.DataFrame(columns=LABEL_NAMES)

    while pairs := _pairs(labels.where("new = 1")):
        tried = labels.withColumn("new", F.lit(0)).unionByName(_in_blocks(blocks, labels, pairs, spread, LABELS, costs).withColumn("new", F.lit(1)))
        merged = tried.groupBy("q", "variant", "block", "node", "kind").agg(F.min(F.struct("cost", "edges", "walked", "new", "pn", "pk", "pb", "pcost")).alias("l"))
        labels = merged.select("q", "variant", "block", "node", "kind", *[f"l.{c}" for c in ("cost", "edges", "walked", "pn", "pk", "pb", "pcost", "new")]).checkpoint()
    return Trees(blocks, home, roots, labels.drop("new").select(*LABEL_NAMES), costs)


def tree_costs(t: Trees) -> DataFrame:
    """q, node, cost and the node before (null: the root) of all nodes that roots reach."""

    def fill(block: Block, _: int, labels: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for q, own, cost, edges, walked, before in block.settle(labels):
            at = block.ends(cost, edges, walked)
            prev, seeds = before[at], own["pn"].to_numpy("i8")
            prev = np.where(prev >= 0, block.names[prev], seeds[np.maximum(-2 - prev, 0)])
            parts.append(pd.DataFrame({"q": q, "node": block.names[at], "cost": cost[at], "prev": pd.array(prev, "Int64")}))
            parts[-1].loc[prev < 0, "prev"] = pd.NA
        return pd.concat(parts)

    return _in_blocks(t.blocks, t.labels, _pairs(t.labels), fill, "q long, node long, cost double, prev long", t.costs)


def _legs(t: Trees, ends: DataFrame) -> DataFrame:
    """Ends (id, q, node) at home, each once: id, q, variant, block, exit."""
    return ends.select("id", F.col("q").cast("long").alias("q"), F.col("node").cast("long").alias("exit")).distinct().join(t.home.withColumnRenamed("node", "exit"), "exit").join(t.roots.select("q", "variant").distinct(), "q").select("id", "q", "variant", "block", "exit")


def _beside(t: Trees, legs: DataFrame) -> DataFrame:
    """Legs (leg) and the labels of the trees in one table; what one of them lacks is -1."""
    own = t.labels.withColumn("leg", F.lit(False))
    both = legs.withColumn("leg", F.lit(True))
    lacks = lambda df, other: df.withColumns({c: F.lit(-1).cast(other.schema[c].dataType) for c in other.columns if c not in df.columns})
    return lacks(both, own).unionByName(lacks(own, both))


def tree_walks(t: Trees, ends: DataFrame) -> DataFrame:
    """Of ends (id, q, node) those that are reached: id, cost, edges and metres (walked) of their ways. Each edge of a tree counts once, in the task of
    its block, however many ways go along it."""
    legs = _legs(t, ends).checkpoint()
    seeds = _beside(t, legs)

    def measure(block: Block, _: int, rows: pd.DataFrame) -> pd.DataFrame:
        parts, legs = [], {int(q): own for q, own in rows[rows["leg"]].groupby("q")}
        for q, _own, cost, edges, walked, _before in block.settle(rows[~rows["leg"] & rows["q"].isin(list(legs))]):
            at = block.ends(cost, edges, walked)
            names, exits = block.names[at], legs[q]["exit"].to_numpy("i8")
            i = np.minimum(np.searchsorted(names, exits), len(names) - 1)
            hit = names[i] == exits
            at = at[i[hit]]
            parts.append(pd.DataFrame({"id": legs[q]["id"].to_numpy("i8")[hit], "cost": cost[at], "edges": edges[at], "walked": walked[at]}))
        return pd.concat(parts) if parts else pd.DataFrame(columns=["id", "cost", "edges", "walked"])

    return _in_blocks(t.blocks, seeds, _pairs(legs), measure, "id long, cost double, edges long, walked double", t.costs)


def tree_paths(t: Trees, ends: DataFrame, reverse: bool = False) -> tuple[DataFrame, DataFrame]:
    """Of ends (id, q, node) those that are reached (id, cost), and the edges of their ways from the root (reverse: to it): id, place (from 0), a, b."""
    legs = _legs(t, ends).withColumns({"kind": F.lit(-2).cast("long"), "back": F.lit(0)}).checkpoint()
    parts = []
    names = ["what", "id", "q", "variant", "block", "exit", "kind", "back", "i", "a", "b", "cost"]
    schema = "what int, id long, q long, variant int, block long, exit long, kind long, back int, i int, a long, b long, cost double"

    def unroll(own: Block, block: int, rows: pd.DataFrame) -> pd.DataFrame:
        out, named = [], own.names.tolist()
        wanted = {int(q): mine for q, mine in rows[rows["leg"]].groupby("q")}
        for q, mine, cost, edges, walked, before in own.settle(rows[~rows["leg"] & rows["q"].isin(list(wanted))]):
            best = own.ends(cost, edges, walked)
            best, seeds, before = dict(zip(own.names[best].tolist(), best.tolist(), strict=True)), mine[["pn", "pk", "pb"]].to_numpy("i8").tolist(), before.tolist()
            for leg in wanted[q].itertuples(index=False):
                if leg.exit not in best:
                    continue
                at, steps = best[leg.exit] if leg.kind == -2 else int(own.number(np.array([leg.exit]), np.array([leg.kind]))[0]), []
                if leg.kind == -2:
                    out.append((2, leg.id, q, leg.variant, block, None, None, leg.back, None, None, None, float(cost[at])))
                while before[at] >= 0:
                    steps.append((named[before[at]], named[at]))
                    at = before[at]
                pn, pk, pb = seeds[-2 - before[at]]
                if pn >= 0:
                    steps.append((pn, named[at]))
                    out.append((1, leg.id, q, leg.variant, pb, pn, pk, leg.back + 1, None, None, None, None))
                out += [(0, leg.id, q, leg.variant, None, None, None, leg.back, i, a, b, None) for i, (a, b) in enumerate(steps)]
        return pd.DataFrame(out, columns=names).astype(dict.fromkeys(["id", "q", "variant", "block", "exit", "kind", "back", "i", "a", "b"], "Int64"))

    while pairs := _pairs(legs):  # a round for each block that the longest way crosses
        got = _in_blocks(t.blocks, _beside(t, legs), pairs, unroll, schema, t.costs).checkpoint()
        parts.append(got)
        legs = got.where("what = 1").select("id", "q", "variant", "block", "exit", "kind", "back")
    whole = parts[0] if parts else t.home.sparkSession.createDataFrame([], schema)
    for p in parts[1:]:
        whole = whole.unionByName(p)
    order = ["back", "i"] if reverse else [F.desc("back"), F.desc("i")]
    place = F.row_number().over(Window.partitionBy("id").orderBy(*order)) - 1  # its own rows only, as many as it has edges
    ends = [F.col("b").alias("a"), F.col("a").alias("b")] if reverse else ["a", "b"]
    return whole.where("what = 2").select("id", "cost"), whole.where("what = 0").select("id", place.alias("place"), *ends)


@dataclass
class Preferred:
    """Figures (pair, k, attempts, ratio, base, edges) of the ways that were taken, their trees, ends (id, q, node; id: the pair) and whether roots are targets."""

    figures: DataFrame
    found: Trees
    ends: DataFrame
    reverse: bool


def preferences(edges: DataFrame, regions: DataFrame, pairs: DataFrame, k: float, badness, door: float = 45.0, jump: float = 12.0, most_detour: float = 1.4, attempts: int = 5) -> Preferred:
    """As preferred, with the number of a path's edges instead of the path: no path is written out."""
    tries = attempts if k > 0 else 0
    weight = [k / 2 ** (i - 1) if i else 0.0 for i in range(tries + 1)]
    many = edges.select("a", "b", *KIND, "length", *[(F.col("length") * (1 + F.lit(w) * badness)).alias(f"cost{i}") for i, w in enumerate(weight)])
    pairs = pairs.select("pair", F.col("start").cast("long").alias("start"), F.col("target").cast("long").alias("target"))
    sides = pairs.agg(F.count_distinct("start").alias("start"), F.count_distinct("target").alias("target")).first()
    root, end = ("target", "start") if sides.target < sides.start else ("start", "target")
    each_variant = F.explode(F.sequence(F.lit(0), F.lit(tries))).alias("variant")
    of = lambda c: F.col(c) * (tries + 1) + F.col("variant")
    roots = pairs.select(F.col(root).alias("node")).distinct().select("node", each_variant).select(of("node").alias("q"), "variant", "node")
    found = _trees(many, regions, roots, {i: (door, jump) if i else (0.0, 0.0) for i in range(tries + 1)}, {i: f"cost{i}" for i in range(tries + 1)}, BLOCK)
    walks = tree_walks(found, pairs.select("pair", root, end, each_variant).select(of("pair").alias("id"), of(root).alias("q"), F.col(end).alias("node")))
    pair = F.floor(F.col("id") / (tries + 1)).cast("long").alias("pair")
    variant = (F.col("id") % (tries + 1)).cast("int").alias("variant")
    each = walks.select(pair, variant, "walked", F.col("edges").cast("int").alias("edges")).checkpoint()
    base = each.where("variant = 0").select("pair", F.col("walked").alias("base"))
    ratio = F.when(F.col("base") > 0, F.col("walked") / F.col("base")).otherwise(1.0)
    good = each.join(base, "pair").withColumn("ratio", ratio).where(f"variant = 0 or ratio <= {float(most_detour)}")
    first = F.min(F.struct(F.when(F.col("variant") == 0, tries + 1).otherwise(F.col("variant")).alias("order"), "ratio", "base", "edges")).alias("f")
    best = good.groupBy("pair").agg(first).select("pair", "f.*")
    shortest = F.col("order") == tries + 1
    kept = F.when(shortest, 0.0).otherwise(F.lit(float(k)) / F.pow(F.lit(2.0), F.col("order") - 1))
    out = best.select("pair", kept.alias("k"), F.when(shortest, max(tries - 1, 0)).otherwise(F.col("order") - 1).cast("int").alias("attempts"), "ratio", "base", "edges", F.when(shortest, 0).otherwise(F.col("order")).alias("variant"))
    ends = pairs.join(out.select("pair", "variant"), "pair").select(F.col("pair").alias("id"), of(root).alias("q"), F.col(end).alias("node"))
    return Preferred(pairs.select("pair").join(out.drop("variant"), "pair", "left"), found, ends, root == "target")


def preferred(edges: DataFrame, regions: DataFrame, pairs: DataFrame, k: float, badness, landmarks: list[int] | None = None, door: float = 45.0, jump: float = 12.0, most_detour: float = 1.4, attempts: int = 5) -> tuple[DataFrame, Trees]:
    """For each pair (pair, start, target) the path that a walker prefers who weighs badness by k, with k halved until the path is
    at most `most_detour` times as long as the shortest; the shortest itself with k = 0 or after all attempts: pair, k, attempts,
    ratio, base, and the path's edges in their order (null: there is none). All attempts run at once, as variants; the shortest is
    variant 0. Pairs that share a start share its search, or those that share a target if there are fewer targets: a way costs the same in
    both directions. Searches by blocks need no landmarks any more. edges: a, b, length, indoor, level, stepped and what badness needs."""
    p = preferences(edges, regions, pairs, k, badness, door, jump, most_detour, attempts)
    _, steps = tree_paths(p.found, p.ends, p.reverse)
    path = steps.groupBy(F.col("id").alias("pair")).agg(F.array_sort(F.collect_list(F.struct("place", "a", "b"))).alias("path"))
    return p.figures.drop("edges").join(path, "pair", "left"), p.found
