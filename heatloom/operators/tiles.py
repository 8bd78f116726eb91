"""Neighbourhoods of rasters by tiles with a halo.

Cells (row, col and values, one row a cell) are grouped into square tiles; a cell goes to its own tile and, if it can act on others, to
those whose halo it lies in. So the input is shuffled at most (1 + 2 halo / tile)^2 times, whatever the number of rays, and
a task holds one tile and its halo as arrays: (tile + 2 halo)^2 numbers. Along each ray a running maximum over the
shifted array replaces a row for each cell and step."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .raster import STEP, ray

#: Cells of a tile's side.
TILE = 512


def by_tile(cells: DataFrame, values: dict[str, Column], acts: Column, halo: int, kernel: Callable[..., dict[str, np.ndarray]], outs: list[str], tile: int) -> DataFrame:
    """row, col and outs (doubles) of all cells. kernel gets the arrays of values (0 where no cell is, and for cells of other
    tiles that do not act) with `halo` cells on each side of the box that the tile's own cells span, and gives arrays of the box."""
    own = cells.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), acts.alias("acts"), *[F.coalesce(v.cast("double"), F.lit(0.0)).alias(n) for n, v in values.items()])
    own = own.where("row is not null and col is not null")

    def places(c: str) -> Column:
        reach = lambda d: F.floor((F.col(c) + d) / tile).cast("int")
        return F.when(F.col("acts"), F.sequence(reach(-halo), reach(halo))).otherwise(F.array(reach(0)))

    names = list(values)
    sent = own.withColumn("tr", F.explode(places("row"))).withColumn("tc", F.explode(places("col")))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        home = (r // tile == key[0]) & (c // tile == key[1])
        if not home.any():
            return pd.DataFrame({"row": [], "col": [], **{o: [] for o in outs}})
        r0, c0 = r[home].min(), c[home].min()
        shape = (r[home].max() - r0 + 1 + 2 * halo, c[home].max() - c0 + 1 + 2 * halo)
        at_r, at_c = r - r0 + halo, c - c0 + halo
        near = (at_r >= 0) & (at_r < shape[0]) & (at_c >= 0) & (at_c < shape[1])
        arrays = []
        for n in names:
            a = np.zeros(shape)
            a[at_r[near], at_c[near]] = pdf[n].to_numpy()[near]
            arrays.append(a)
        found = kernel(*arrays)
        at = (r[home] - r0, c[home] - c0)
        return pd.DataFrame({"row": r[home], "col": c[home], **{o: found[o][at] for o in outs}})

    schema = "row long, col long, " + ", ".join(f"{o} double" for o in outs)
    types = {c: cells.schema[c].dataType for c in ("row", "col")}
    out = sent.groupBy("tr", "tc").applyInPandas(run, schema)
    return out.select(*[F.col(c).cast(t).alias(c) for c, t in types.items()], *outs)


def horizons(over: np.ndarray, halo: int, rays: list[list[tuple[int, int, float]]]) -> np.ndarray:
    """Mean over rays of t^2 / (1 + t^2), t the highest tangent that a ray meets. over: heights above the eye, with a halo."""
    n, m = over.shape[0] - 2 * halo, over.shape[1] - 2 * halo
    lost, top, part = np.zeros((n, m)), float(over.max(initial=0.0)), np.empty((n, m))
    if top <= 0:
        return lost
    for steps in rays:
        t, least = np.zeros((n, m)), 0.0
        for i, (dr, dc, per) in enumerate(steps):
            if top * per <= least:
                break  # nothing farther out can be higher than all that is met already
            np.multiply(over[halo + dr : halo + dr + n, halo + dc : halo + dc + m], per, out=part)
            np.maximum(t, part, out=t)
            if i % 16 == 15:
                least = float(t.min())
        t *= t
        lost += t / (1.0 + t)
    return lost / len(rays)


def sky_rays(cell: float, azimuths: int, radius: float) -> tuple[list[list[tuple[int, int, float]]], int]:
    """For each azimuth the cells of its ray with the tangent of a metre there, and the halo that they need."""
    steps = max(1, round(radius / (cell * STEP)))
    rays = [[(dr, dc, 1.0 / (cell * math.hypot(dr, dc))) for dr, dc in ray(360.0 * i / azimuths, steps) if (dr, dc) != (0, 0)] for i in range(azimuths)]
    return rays, max((max(abs(dr), abs(dc)) for steps in rays for dr, dc, _ in steps), default=0)


def sky_view(cells: DataFrame, cell: float, azimuths: int = 64, radius: float = 400.0, eye: float = 1.1, height: str = "h", out: str = "svf", tile: int = TILE) -> DataFrame:
    """row, col and the share of the sky that is seen at eye height: per azimuth the highest horizon within the radius."""
    rays, halo = sky_rays(cell, azimuths, radius)
    over = F.col(height).cast("double") - eye

    def kernel(a: np.ndarray) -> dict[str, np.ndarray]:
        return {out: np.clip(1.0 - horizons(a, halo, rays), 0.0, 1.0)}

    return by_tile(cells, {"over": F.greatest(over, F.lit(0.0))}, over > 0, halo, kernel, [out], tile)


def crown_blocking(over: np.ndarray, halo: int, cell: float, radius: float) -> np.ndarray:
    """Share of the sky that flat pieces at `over` above the eye hide, cosine weighted, summed over a disc and at most 1."""
    n, m = over.shape[0] - 2 * halo, over.shape[1] - 2 * halo
    z2, total = over * over, np.zeros((n, m))
    area = cell * cell / math.pi
    for dr in range(-halo, halo + 1):
        for dc in range(-halo, halo + 1):
            rho2 = cell * cell * (dr * dr + dc * dc)
            if rho2 > radius * radius:
                continue
            z = z2[halo + dr : halo + dr + n, halo + dc : halo + dc + m]
            if z.any():
                total += z * area / np.maximum((rho2 + z) ** 2, 1e-6)
    return np.minimum(total, 1.0)


def blocked_above(cells: DataFrame, cell: float, radius: float = 40.0, eye: float = 1.1, height: str = "h", out: str = "blocked", tile: int = TILE) -> DataFrame:
    """row, col and the share of the sky that crowns in a disc hide: each as a flat piece at its height."""
    halo, over = int(radius // cell), F.col(height).cast("double") - eye

    def kernel(a: np.ndarray) -> dict[str, np.ndarray]:
        return {out: crown_blocking(a, halo, cell, radius)}

    return by_tile(cells, {"over": F.greatest(over, F.lit(0.0))}, over > 0, halo, kernel, [out], tile)


def sky_with_crowns(cells: DataFrame, cell: float, azimuths: int = 64, radius: float = 400.0, disc: float = 40.0, eye: float = 1.1, through: float = 0.03, house: str = "house", crown: str = "crown", tile: int = TILE) -> DataFrame:
    """row, col, svf_house (buildings alone), svf_all (crowns as solid as buildings), blocked and svf: of crowns above the
    eye and above the roof beneath, as flat pieces, at most what solid ones would hide; leaves let `through` pass.
    All of a tile in one pass."""
    rays, halo = sky_rays(cell, azimuths, radius)
    halo = max(halo, int(disc // cell))
    h, c = (F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in (house, crown))

    def kernel(houses: np.ndarray, both: np.ndarray, crowns: np.ndarray) -> dict[str, np.ndarray]:
        inner = halo - int(disc // cell)
        cut = crowns[inner : crowns.shape[0] - inner, inner : crowns.shape[1] - inner]
        solid, whole = (np.clip(1.0 - horizons(a, halo, rays), 0.0, 1.0) for a in (houses, both))
        blocked = np.minimum(crown_blocking(cut, halo - inner, cell, disc), np.clip(solid - whole, 0.0, 1.0))
        return {"svf_house": solid, "svf_all": whole, "blocked": blocked, "svf": np.clip(solid - (1.0 - through) * blocked, 0.0, 1.0)}

    above = lambda v: F.greatest(v - eye, F.lit(0.0))
    values = {"houses": above(h), "both": above(F.greatest(h, c)), "crowns": F.when((c > eye) & (c > h), c - eye).otherwise(0.0)}
    return by_tile(cells, values, F.greatest(h, c) > eye, halo, kernel, ["svf_house", "svf_all", "blocked", "svf"], tile)
