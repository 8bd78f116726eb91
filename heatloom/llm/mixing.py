"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that they belong to). Words flow
from patterns to sources: a pattern's first pass costs nothing, each further pass more (a convex cost
of repetition), and a source takes up to its target. Blocking flows, pass by pass, give the cheapest
flow; the network has one node for each pattern and source, never one for a document. Each pattern's
flow is then turned into whole passes over its documents and one partial pass, filled in the order of
a seeded hash: sums over ranges of the hash find the range in which the partial pass ends, and only
that range is sorted.

Targets: sources by code point, null last, get the weights in turn and share `share` times all words; a
target stops at `max_passes` times its source's words, and the excess is shared by weight among the
others until none is above.

Defined results: a null text has no words; a null source (or an empty set of sources) is a source
of its own; rows that repeat an id are separate documents; ties of the hash go to the smaller id, then to
the larger size; a document with no words is never taken; extra columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .common import column, cut, unpacked, whole_row

WEIGHTS = (3, 1, 2)
#: More distinct membership patterns than this do not fit the driver's flow network.
MAX_PATTERNS = 1_000_000
HASH_RANGE_BITS = 12


def words(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def share_out(sizes: dict, weights=WEIGHTS, share: float = 1.5, max_passes: float = 2.0) -> dict:
    """Each source's target."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, target = share * sum(sizes.values()), list(order), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        full = [s for s in free if unit * weight[s] > max_passes * sizes[s]]
        if not full:
            return target | {s: unit * weight[s] for s in free}
        for s in full:
            target[s] = max_passes * sizes[s]
            left -= target[s]
        free = [s for s in free if s not in full]
    return target


def augment(out: list[list[int]], to: list[int], left: list[float], end: int, tiny: float) -> None:
    """Enlarge a flow from node 0 to `end` until no arc path is open, by blocking flows along shortest paths: arc k leads to to[k] and
    has left[k] of its capacity; arc k ^ 1 is its reverse."""
    while True:
        level, ring = [-1] * len(out), [0]
        level[0] = 0
        for a in ring:
            for k in out[a]:
                if left[k] > tiny and level[to[k]] < 0:
                    level[to[k]] = level[a] + 1
                    ring.append(to[k])
        if level[end] < 0:
            return
        at, path, node = [0] * len(out), [], 0
        while True:
            if node == end:
                amount = min(left[k] for k in path)
                for k in path:
                    left[k] -= amount
                    left[k ^ 1] += amount
                # back to the first arc that is full
                full = next(i for i, k in enumerate(path) if left[k] <= tiny)
                node = to[path[full] ^ 1]
                del path[full:]
            own = out[node]
            while at[node] < len(own) and not (left[own[at[node]]] > tiny and level[to[own[at[node]]]] == level[node] + 1):
                at[node] += 1
            if at[node] < len(own):
                path.append(own[at[node]])
                node = to[path[-1]]
            elif path:
                node = to[path.pop() ^ 1]
                at[node] += 1
            else:
                break


def route(patterns: dict[tuple, int], targets: dict, passes: int = 2) -> dict[tuple, dict]:
    """Words that each pattern gives to each source: a flow of least cost among the largest flows.

    Arcs: root -> pattern, with the pattern's words as capacity for each pass; pattern -> its sources; source -> end, up to the target.
    Pass k costs k a word, and only these arcs cost anything. So the cheapest flow comes in phases: the largest flow of first
    passes, enlarged by second passes, and so on; what an earlier pass gives is never taken back, only sent on to other sources.
    Sources that only patterns of one source feed need no flow."""
    order = sorted(patterns, key=repr)
    shared = {s for p in order if len(p) > 1 for s in p}
    found = {p: {p[0]: min(float(targets[p[0]]), float(patterns[p]) * passes)} for p in order if len(p) == 1 and p[0] not in shared}
    rest = [p for p in order if p not in found]
    names = {s: len(rest) + 1 + i for i, s in enumerate(x for x in targets if x in shared)}
    end = len(rest) + len(names) + 1
    to: list[int] = []
    left: list[float] = []
    out: list[list[int]] = [[] for _ in range(end + 1)]

    def arc(a: int, b: int, capacity: float) -> int:
        for x, y, c in ((a, b, capacity), (b, a, 0.0)):
            out[x].append(len(to))
            to.append(y)
            left.append(c)
        return len(to) - 2

    roots = [arc(0, i, 0.0) for i in range(1, len(rest) + 1)]
    links = {(p, s): arc(i, names[s], float(patterns[p]) * passes) for i, p in enumerate(rest, 1) for s in p}
    for s, node in names.items():
        arc(node, end, float(targets[s]))
    tiny = 1e-9 * max(1.0, sum(targets.values()))
    for _ in range(passes):
        for k, p in zip(roots, rest, strict=True):
            left[k] += float(patterns[p])
        augment(out, to, left, end, tiny)
    return {p: found[p] if p in found else {s: left[links[p, s] ^ 1] for s in p} for p in order}


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = 1.5, max_passes: int = 2, seed: str = "mix") -> DataFrame:
    """Per row: id_col, size, source_size and target of its source (of the first of several), times (how
    often the mix takes it) and taken = times * size. source_col: a string or an array of strings."""
    spark = docs.sparkSession
    many = isinstance(docs.schema[source_col].dataType, T.ArrayType)
    source = column(source_col)
    pattern = F.when(F.size(source) > 0, F.sort_array(F.array_distinct(source))).otherwise(F.array(F.lit(None).cast("string"))) if many else F.array(source.cast("string"))
    lot = F.xxhash64(F.lit(seed), column(id_col).cast("string"))
    rows = docs.select(column(id_col).alias("__id"), pattern.alias("pattern"), words(column(text_col)).alias("size"), lot.alias("lot"))
    rows = cut(rows.withColumn("range", F.shiftrightunsigned("lot", 64 - HASH_RANGE_BITS).cast("int")))  # the hash in order, as an unsigned number

    held = rows.groupBy("pattern").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(held) > MAX_PATTERNS:
        raise ValueError(f"over {MAX_PATTERNS} membership patterns")
    patterns = {tuple(r["pattern"]): r["size"] for r in held}
    sizes: dict = {}
    for p, n in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    targets = share_out(sizes, weights, share, max_passes)
    flow = route(patterns, targets, max_passes)
    plan = [(i, list(p), *(divmod(round(sum(flow[p].values())), n) if n else (0, 0)), sizes[p[0]], float(targets[p[0]])) for i, (p, n) in enumerate(patterns.items())]
    plan = spark.createDataFrame(plan, "of int, pattern array<string>, passes long, rest long, source_size long, target double")
    plan = plan.withColumn("key", F.to_json("pattern"))  # tells nulls and all names apart

    # the partial pass: sums by range of the hash, running over at most 2^HASH_RANGE_BITS ranges of each pattern
    rows = rows.withColumn("key", F.to_json("pattern")).join(F.broadcast(plan.select("key", "of")), "key").drop("key", "pattern")
    plan = plan.drop("key", "pattern")
    sums = rows.groupBy("of", "range").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(W.Window.partitionBy("of").orderBy("range").rowsBetween(W.Window.unboundedPreceding, -1))
    ranges = sums.withColumn("before", F.coalesce(before, F.lit(0))).join(F.broadcast(plan), "of")
    ranges = ranges.withColumn("whole", F.col("before") + F.col("words") <= F.col("rest"))
    last = ranges.where("not whole and before < rest").select("of", "range", "before", "rest")
    inner = rows.join(last, ["of", "range"])
    run = F.sum("size").over(W.Window.partitionBy("of", "range").orderBy("lot", "__id", F.desc("size")).rowsBetween(W.Window.unboundedPreceding, 0))
    # a document is taken once more if that brings the sum nearer to what is wanted
    inner = inner.withColumn("more", (2 * (F.col("before") + run) - F.col("size") <= 2 * F.col("rest")).cast("long"))
    outer = rows.join(ranges.where("whole or before >= rest").select("of", "range", F.col("whole").cast("long").alias("more")), ["of", "range"])
    chosen = inner.select("__id", "of", "size", "more").unionByName(outer.select("__id", "of", "size", "more")).join(F.broadcast(plan), "of")
    times = F.when(F.col("size") > 0, F.least(F.col("passes") + F.col("more"), F.lit(max_passes))).otherwise(0)
    return chosen.select(F.col("__id").alias(id_col), "size", "source_size", "target", times.cast("long").alias("times"), (times * F.col("size")).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs with each document as often as the mix takes it: copies are rows with the same id. Rows that
    share an id are each taken as often as the one taken most."""
    times = mix(docs, id_col, **options).where("times > 0").groupBy(column(id_col).alias("mixed")).agg(F.max("times").alias("times"))
    rows = docs.select(column(id_col).alias("id"), whole_row(docs).alias("row")).join(times, F.col("id").eqNullSafe(F.col("mixed")))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*unpacked(docs.columns))
