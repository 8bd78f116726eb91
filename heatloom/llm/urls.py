"""URL filters as a sort-merge range join.

A url's canonical key is its host with the labels reversed and each ended by a dot, then a mark and
the path. A rule's host and all its subdomains are then one interval of keys. Urls and rules are cut
into slices of the key space, each slice is sorted, and one sweep keeps a stack of the rule hosts
whose intervals are open; each holds its path prefixes by length, so that the longest rule that fits
is found from the top of the stack down. A rule goes to every slice that its interval touches. Slice
borders come from a bounded sample of keys and only balance the work; many rows with one key are
spread over all slices whose borders equal it.

The longest rule is the one with most characters in host and path; of equal ones the longer host,
then the first verdict. Defined results: null, or no `://`: host and path are empty and no rule
fits; a rule with a null host or path is void; repeated rules count once; other columns pass through
(those named host, path, rule or verdict are replaced).
"""

from __future__ import annotations

import bisect
import string
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, unpacked, whole_row

#: Expected rows of the sample from which slice borders are taken, and the number that is never passed.
BORDER_SAMPLE = 4_000
BORDER_MOST = 8_000
OUT = ("host", "path", "rule", "verdict")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


class OpenRules:
    """The stack of rule hosts whose intervals hold the sweep's key."""

    def __init__(self) -> None:
        #: rule host, its paths, and the lengths of its paths, longest first
        self.stack: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []

    def close(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def open(self, low: str, path: str, rule: str, verdict: str) -> None:
        self.close(low)
        if not self.stack or self.stack[-1][0] != low:
            self.stack.append((low, {}, []))
        _, held, sizes = self.stack[-1]
        if (at := bisect.bisect_left(sizes, -len(path))) == len(sizes) or sizes[at] != -len(path):
            sizes.insert(at, -len(path))
        held[path] = min(held.get(path, (rule, verdict)), (rule, verdict), key=lambda x: x[1])

    def longest(self, path: str) -> tuple[str, str] | None:
        best, size = None, -1
        for _, held, sizes in reversed(self.stack):  # longer hosts first
            for n in sizes[bisect.bisect_left(sizes, -len(path)) :]:
                if (found := held.get(path[:-n] if n else "")) is not None:
                    if len(found[0]) > size:
                        best, size = found, len(found[0])
                    break
        return best


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", slices: int | None = None) -> DataFrame:
    """pages with host, path, rule (null if none fits) and verdict. rules: host, path, verdict."""
    spark = pages.sparkSession
    n = slices or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    host, path = host_and_path(F.col("url"))
    names = [c for c in pages.columns if c not in OUT or c == url_col]
    row = whole_row(pages.select(*[column(c) for c in names]))
    urls = pages.select(column(url_col).alias("url"), row.alias("row")).select("row", host.alias("host"), path.alias("path")).withColumn("key", F.concat(reversed_host(F.col("host")), F.lit("\x01"), F.col("path")))
    total = urls.count()
    chance = F.pmod(F.xxhash64("key", F.monotonically_increasing_id()), F.lit(1 << 40)) < int(min(1.0, BORDER_SAMPLE / max(1, total)) * (1 << 40))
    sample = sorted(r[0] for r in urls.where(chance).select("key").limit(BORDER_MOST).collect())
    borders = [sample[len(sample) * i // n] for i in range(1, n)] if sample else []

    @F.pandas_udf("int")
    def slice_of(key: pd.Series, salt: pd.Series) -> pd.Series:
        def one(k, s):
            lo, hi = bisect.bisect_left(borders, k), bisect.bisect_right(borders, k)
            return lo + s % (hi - lo + 1)

        return pd.Series([one(k, s) for k, s in zip(key, salt, strict=True)], dtype="int32")

    @F.pandas_udf("array<int>")
    def slices_of(low: pd.Series) -> pd.Series:
        # the interval's end: the last character, a dot, raised by one
        return pd.Series([list(range(bisect.bisect_left(borders, k), bisect.bisect_right(borders, k[:-1] + "/") + 1)) for k in low])

    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30)).cast("int")
    left = urls.select(slice_of("key", salt).alias("slice"), "key", F.lit(1).alias("kind"), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), "row")
    void = F.lit(None).cast(left.schema["row"].dataType)
    low_rules = rules.where("host is not null and path is not null and verdict is not null").select("host", "path", "verdict").distinct().withColumn("key", reversed_host(F.col("host")))
    right = low_rules.select(F.explode(slices_of("key")).alias("slice"), "key", F.lit(0).alias("kind"), "host", "path", F.concat("host", "path").alias("rule"), "verdict", void.alias("row"))

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, opened = None, OpenRules()
        for pdf in batches:
            found = []
            for s, key, kind, p, rule, verdict in zip(*(pdf[c] for c in ("slice", "key", "kind", "path", "rule", "verdict")), strict=True):
                if s != at:
                    at, opened = s, OpenRules()
                if kind == 0:
                    opened.open(key, p, rule, verdict)
                    found.append((None, None))
                else:
                    opened.close(key)
                    found.append(opened.longest(p) or (None, default))
            pdf[["rule", "verdict"]] = pd.DataFrame(found, columns=["rule", "verdict"], index=pdf.index)
            yield pdf[pdf["kind"] == 1]

    both = left.unionByName(right).repartition(n, "slice").sortWithinPartitions("slice", "key", "kind")
    out = both.mapInPandas(sweep, both.schema)
    return out.select(*unpacked(names), "host", "path", "rule", "verdict")
