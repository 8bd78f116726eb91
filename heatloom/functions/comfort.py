"""Closed formulas of air, sky, sun, surfaces and trees as Column -> Column functions; a null input gives null.

Fixed values: Magnus 6.112, 17.62, 243.12; Prata 46.5, 1.2, 3; wind roughness 0.03 m at 1.1 m, floor 0.5 m/s;
convection 2.8 + 3u; UV 0.56, 3.4, 12.5, 2.42, diffuse floor 0.45, 0.015 SED a index minute; clear sky 1098, 0.059, 1367, 0.7, 0.678;
air mass 0.50572, 6.07995, 1.6364; comfort 9..26; Stefan-Boltzmann 5.670374419e-8; body 0.70, 0.97, 0.28, 0.06, 0.50;
surroundings: albedo 0.20 (ground 0.15), emissivity 0.90 (ground 0.95), half of what walls receive is reflected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SIGMA = 5.670374419e-8
WIND_SHARE = 1.1 / 0.03, 10.0 / 0.03


def clamp(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def sat_vapour(ta: Column) -> Column:
    """hPa over water at ta °C."""
    return 6.112 * F.exp(17.62 * ta / (243.12 + ta))


def sat_vapour_log(ta: Column) -> Column:
    """hPa over water by the series in Kelvin with a logarithm, which the climate index is defined with. Fixed values."""
    t = ta + 273.15
    series = (-2.8365744e3, -6.028076559e3, 1.954263612e1, -2.737830188e-2, 1.6261698e-5, 7.0229056e-10, -1.8680009e-13)
    total = 2.7150305 * F.log(t)
    for i, g in enumerate(series):
        total = total + g * F.pow(t, F.lit(float(i - 2)))
    return F.exp(total) * 0.01


def sat_vapour_bolton(ta: Column) -> Column:
    """hPa over water by the pair 17.67, 243.5, which the station reports go with."""
    return 6.112 * F.exp(17.67 * ta / (243.5 + ta))


def vapour(ta: Column, rh: Column) -> Column:
    return sat_vapour(ta) * clamp(rh, 0.0, 100.0) / 100.0


def humidity_after(ta: Column, rh: Column, shift: Column) -> Column:
    """Relative humidity at ta - shift for the same vapour pressure."""
    return clamp(100.0 * vapour(ta, rh) / sat_vapour(ta - shift), 0.0, 100.0)


def sky_emissivity(ta: Column, e: Column, cloud: Column) -> Column:
    w = 46.5 * e / (ta + 273.15)
    clear = 1.0 - (1.0 + w) * F.exp(-F.sqrt(1.2 + 3.0 * w))
    return clear + (1.0 - clear) * cloud


def wind_low(u10: Column) -> Column:
    """Wind at 1.1 m from that at 10 m, by the logarithmic profile."""
    share = F.log(F.lit(WIND_SHARE[0])) / F.log(F.lit(WIND_SHARE[1]))
    return F.when(u10.isNotNull(), F.greatest(F.lit(0.5), u10 * share))


def convection(u: Column) -> Column:
    return 2.8 + 3.0 * u


def stress(utci: Column) -> Column:
    """Distance from the range without thermal stress."""
    return F.when(utci.isNotNull(), F.greatest(F.lit(0.0), utci - 26.0, 9.0 - utci))


def uv_clear(elevation: Column) -> Column:
    s = F.greatest(F.lit(0.0), F.sin(F.radians(elevation)))
    return F.when(elevation.isNotNull(), 12.5 * F.pow(s, F.lit(2.42)))


def uv_under_cloud(index: Column, cloud_pct: Column) -> Column:
    return index * (1.0 - 0.56 * F.pow(clamp(cloud_pct, 0.0, 100.0) / 100.0, F.lit(3.4)))


def uv_index_for(slot: Column, now: Column, measured: Column, stamp: Column, feed: Column, cloud_pct: Column, elevation: Column, station: str = "station") -> Column:
    """Struct of index and source: the measurement for the current slot, else the feed's clear-sky value under cloud, else the modelled
    one; the source says which."""
    whole = lambda c: F.bround(c, 0).cast("int").cast("string")
    cloud = F.concat(F.lit(" x cloud ("), whole(cloud_pct), F.lit("%)"))
    pair = lambda i, s: F.struct(i.cast("double").alias("index"), s.alias("source"))
    model = F.concat(F.lit("modelled clear-sky at "), whole(elevation), F.lit(" deg elevation"), cloud)
    under = lambda c: F.round(F.greatest(F.lit(0.0), uv_under_cloud(c, cloud_pct)), 1)
    return (
        F.when((slot == now) & measured.isNotNull(), pair(measured, F.concat(F.lit(f"{station} measured "), stamp)))
        .when(feed.isNotNull(), pair(under(feed), F.concat(F.lit("feed clear-sky"), cloud)))
        .when(elevation.isNotNull(), pair(under(uv_clear(elevation)), model)).otherwise(pair(F.lit(None), F.lit("no index in the feed and no measurement")))
    )


def extraterrestrial(day_of_year: Column, elevation: Column) -> Column:
    """W/m2 on the horizontal outside the air; 0 with the sun down."""
    near = 1366.1 * (1.0 + 0.033 * F.cos(2.0 * F.pi() * day_of_year / 365.0))
    return F.greatest(F.lit(0.0), near * F.sin(F.radians(elevation)))


def diffuse_share(kt: Column) -> Column:
    """Expected diffuse share of the light by clearness (Erbs and others, 1982). Fixed values."""
    middle = 0.9511 + kt * (-0.1604 + kt * (4.388 + kt * (-16.638 + kt * 12.336)))
    return F.when(kt <= 0.22, 1.0 - 0.09 * kt).when(kt <= 0.8, middle).otherwise(F.when(kt.isNotNull(), 0.165))


def ghi_clear(elevation: Column) -> Column:
    s = F.sin(F.radians(elevation))
    return F.when(elevation.isNotNull(), F.when(elevation > 0, 1098.0 * s * F.exp(-0.059 / s)).otherwise(0.0))


# --- sky ---


def air_mass(elevation: Column) -> Column:
    """Relative optical air mass (Kasten and Young)."""
    return 1.0 / (F.sin(F.radians(elevation)) + 0.50572 * F.pow(elevation + 6.07995, F.lit(-1.6364)))


def beam_clear(elevation: Column) -> Column:
    """Clear-sky beam on the horizontal (Meinel); 0 with the sun down."""
    up = 1367.0 * F.pow(F.lit(0.7), F.pow(air_mass(elevation), F.lit(0.678))) * F.sin(F.radians(elevation))
    return F.when(elevation > 0, up).otherwise(0.0)


def beam_fraction(direct: Column, elevation: Column) -> Column:
    """Share of the clear-sky beam that arrives; null below 10 W/m2 of it."""
    clear = beam_clear(elevation)
    return F.when(clear >= 10.0, F.greatest(F.lit(0.0), direct) / clear)


def sky_condition(direct: Column, cloud_pct: Column, precip: Column, elevation: Column, row_elevation: Column) -> Column:
    """The sky's state; elevation: of the sun now, row_elevation: over the time that the radiation is averaged over."""
    rain, kb = F.coalesce(precip, F.lit(0.0)), beam_fraction(direct, F.coalesce(row_elevation, elevation))
    by_cloud = F.when(F.coalesce(cloud_pct, F.lit(0.0)) >= 60, "cloudy").otherwise("partly_cloudy")
    return (
        F.when(rain >= 0.5, "rain").when(rain > 0, "drizzle").when(elevation.isNull(), by_cloud).when(elevation <= 5.0, "night")
        .when(kb.isNull(), by_cloud).when(kb >= 0.5, "sunny").when(kb >= 0.15, "partly_cloudy").otherwise("cloudy")
    )


def sky_reason(direct: Column, cloud_pct: Column, precip: Column, elevation: Column, row_elevation: Column) -> Column:
    """What decided sky_condition, with its value."""
    rain, kb = F.coalesce(precip, F.lit(0.0)), beam_fraction(direct, F.coalesce(row_elevation, elevation))
    cover = F.concat(F.lit("cloud cover "), F.format_string("%.0f", F.bround(F.coalesce(cloud_pct.cast("double"), F.lit(0.0)), 0)), F.lit("% ("))
    return (
        F.when(rain > 0, F.format_string("precipitation %.1f mm", rain.cast("double"))).when(elevation.isNull(), F.concat(cover, F.lit("no sun position)")))
        .when(elevation <= 5.0, F.format_string("sun %.1f deg -- below 5", elevation.cast("double"))).when(kb.isNull(), F.concat(cover, F.lit("sun too low to read the beam)")))
        .otherwise(F.format_string("beam %.2f of clear-sky", kb))
    )


def sky_longwave(ta_k: Column, e: Column, cloud: Column) -> Column:
    """W/m2 from an unobstructed sky; e in hPa, cloud as a share."""
    return sky_emissivity(ta_k - 273.15, e, clamp(cloud, 0.0, 1.0)) * SIGMA * F.pow(ta_k, F.lit(4.0))


def vapour_of(vapour_hpa: Column, dew_point: Column, ta: Column, rh: Column, default_rh: float = 50.0) -> Column:
    """Vapour pressure from the first that is known: itself, dew point, humidity, the default humidity."""
    return F.coalesce(vapour_hpa, sat_vapour(dew_point), sat_vapour(F.coalesce(ta, F.lit(0.0))) * F.coalesce(rh, F.lit(default_rh)) / 100.0)


def forcing(ta: Column, wind_kmh: Column, rh: Column, direct: Column, diffuse: Column, cloud_pct: Column) -> Column:
    """What drives a surface: struct of ta_k, e, u, h, s_dir, s_dif, l_sky. Missing values count as 0, humidity as 50 %."""
    zero = F.lit(0.0)
    ta_k, e = F.coalesce(ta, zero) + 273.15, vapour_of(F.lit(None).cast("double"), F.lit(None).cast("double"), ta, rh)
    u = wind_low(F.coalesce(wind_kmh, zero) / 3.6)
    parts = {"ta_k": ta_k, "e": e, "u": u, "h": convection(u), "s_dir": F.greatest(zero, F.coalesce(direct, zero)), "s_dif": F.greatest(zero, F.coalesce(diffuse, zero)), "l_sky": sky_longwave(ta_k, e, F.coalesce(cloud_pct, zero) / 100.0)}
    return F.struct(*[c.alias(n) for n, c in parts.items()])


# --- ultraviolet ---


def uv_split(direct_share: Column) -> tuple[Column, Column]:
    """Beam and diffuse share of the index: under a clear sky 0.45 of it is diffuse still."""
    beam = (1.0 - 0.45) * clamp(direct_share, 0.0, 1.0)
    return beam, 1.0 - beam


def uv_exposure(shade: Column, svf: Column, direct_share: Column) -> Column:
    beam, diffuse = uv_split(direct_share)
    return beam * (1.0 - shade) + diffuse * svf


def sed(index_minutes: Column) -> Column:
    return 0.015 * index_minutes


# --- people ---


def projected_area(elevation: Column) -> Column:
    """Share of a standing body that faces a beam from this elevation."""
    b = F.radians(elevation)
    return F.when(b > 0, 0.28 * F.cos(b) + 0.06 * F.sin(b)).otherwise(0.0)


def radiant_temperature(ta: Column, svf: Column, shade: Column, direct: Column, diffuse: Column, elevation: Column, ground: Column, wall: Column, sky: Column) -> Column:
    """Mean radiant temperature (°C) of a standing person. Temperatures in °C, radiation on the horizontal, sky: its emissivity.

    The body takes up the beam on its projected area, the sky's diffuse light, light from ground and walls, and longwave from
    above (sky through svf, walls and the sky that they reflect through the rest) and below, half of it each."""
    svf, sunlit, day = clamp(svf, 0.0, 1.0), 1.0 - clamp(shade, 0.0, 1.0), elevation > 0
    sine = F.greatest(F.sin(F.radians(elevation)), F.sin(F.radians(F.lit(2.0))))  # no beam from below two degrees
    normal = F.when(day, direct / sine).otherwise(0.0)
    on_ground = F.when(day, direct).otherwise(0.0) * sunlit + diffuse * svf
    on_wall = 0.5 * normal * F.cos(F.radians(clamp(elevation, 0.0, 90.0))) * sunlit + 0.5 * diffuse * svf
    short = projected_area(elevation) * normal * sunlit + 0.5 * svf * diffuse + 0.5 * 0.15 * on_ground + 0.5 * (1.0 - svf) * 0.20 * on_wall
    emit = lambda t, e: e * SIGMA * F.pow(t + 273.15, F.lit(4.0))
    above = svf * emit(ta, sky) + (1.0 - svf) * (emit(wall, 0.90) + 0.10 * emit(ta, sky))
    below = emit(ground, 0.95) + 0.05 * above
    return F.pow((0.70 * short + 0.97 * (0.5 * above + 0.5 * below)) / (0.97 * SIGMA), F.lit(0.25)) - 273.15


def climate_index(ta: Column, radiant: Column, wind: Column, vapour_hpa: Column, terms: list[tuple[float, int, int, int, int]]) -> Column:
    """ta plus a polynomial of the index's published table (index_terms.terms()): terms are (coefficient, powers of ta, wind, radiant - ta, kPa).
    Inputs are brought into the index's range first; see index_inputs."""
    x = index_inputs(ta, radiant, wind)
    factors = [x["ta"], x["wind"], x["excess"], vapour_hpa / 10.0]

    def nested(rows: list, k: int) -> Column:
        """The polynomial in factors[k:], by Horner's rule in factor k."""
        if k == len(factors):
            return F.lit(float(sum(r[0] for r in rows)))
        by: dict[int, list] = {}
        for r in rows:
            by.setdefault(r[1 + k], []).append(r)
        out = None
        for p in range(max(by), -1, -1):
            own = nested(by[p], k + 1) if p in by else None
            out = own if out is None else out * factors[k] if own is None else out * factors[k] + own
        return out

    return x["ta"] + nested(terms, 0) if terms else x["ta"]


def index_inputs(ta: Column, radiant: Column, wind: Column) -> dict[str, Column]:
    """The index's inputs in its range (-50..50 °C, -30..70 K above the air, 0.5..17 m/s), and whether one was outside."""
    excess = radiant - ta
    outside = (ta < -50) | (ta > 50) | (excess < -30) | (excess > 70) | (wind < 0.5) | (wind > 17)
    return {"ta": clamp(ta, -50.0, 50.0), "excess": clamp(excess, -30.0, 70.0), "wind": clamp(wind, 0.5, 17.0), "outside": outside}


#: Upper bounds (°C) and names of the stress categories. Fixed values.
CATEGORIES = [(-40.0, "extreme cold stress"), (-27.0, "very strong cold stress"), (-13.0, "strong cold stress"), (0.0, "moderate cold stress"), (9.0, "slight cold stress"), (26.0, "no thermal stress"), (32.0, "moderate heat stress"), (38.0, "strong heat stress"), (46.0, "very strong heat stress")]


def stress_category(index: Column) -> Column:
    """A bound belongs to the next category."""
    out = F.when(index.isNull(), None)
    for bound, name in CATEGORIES:
        out = out.when(index < bound, name)
    return out.otherwise("extreme heat stress")


# --- surfaces ---


def absorbed(f: Column, shade: Column, svf: Column, albedo: Column, eps: Column) -> Column:
    """Absorbed W/m2 of a ground cell under a forcing struct; does not depend on its temperature."""
    all_ = f["s_dir"] + f["s_dif"]
    short = f["s_dir"] * (1.0 - shade) + f["s_dif"] * svf + 0.20 * 0.5 * (1.0 - svf) * all_
    wall = 0.90 * SIGMA * F.pow(f["ta_k"], F.lit(4.0)) + 0.10 * f["l_sky"]
    return (1.0 - albedo) * short + eps * (svf * f["l_sky"] + (1.0 - svf) * wall)


def wall_absorbed(f: Column, sun_azimuth: Column, elevation: Column, faces: Column, ground_k: Column, albedo: float = 0.20, eps: float = 0.90) -> Column:
    """Absorbed W/m2 of a facade that faces an azimuth: half sky, half ground and facades at ground_k."""
    day = elevation > 0
    sine = F.greatest(F.sin(F.radians(elevation)), F.sin(F.radians(F.lit(2.0))))
    facing = F.greatest(F.lit(0.0), F.cos(F.radians(elevation)) * F.cos(F.radians(sun_azimuth - faces)))
    beam = F.when(day, f["s_dir"] / sine * facing).otherwise(0.0)
    short = beam + 0.5 * f["s_dif"] + 0.5 * 0.15 * (f["s_dir"] + f["s_dif"])
    around = eps * SIGMA * F.pow(ground_k, F.lit(4.0)) + (1.0 - eps) * f["l_sky"]
    return (1.0 - albedo) * short + eps * (0.5 * f["l_sky"] + 0.5 * around)


def surface_step(t: Column, absorbed: Column, air: Column, h: Column | float, eps: Column | float, heat: Column | float, dt: float, k_deep: Column | float = 0.0, t_deep: Column | float = 0.0, beta: Column | float = 0.0, power=F.pow, positive=lambda net: F.greatest(net, F.lit(0.0))) -> Column:
    """Surface temperature (K) one semi-implicit step later: emission is taken along its tangent. k_deep conducts to a
    reservoir at t_deep; beta is the share of positive net radiation that evaporates. With numpy's power and positive: of arrays."""
    net = absorbed - eps * SIGMA * power(t, 4.0)
    gain = net - h * (t - air) - k_deep * (t - t_deep) - beta * positive(net)
    return t + dt * gain / (heat + dt * ((1.0 - beta) * 4.0 * eps * SIGMA * power(t, 3.0) + h + k_deep))


def explicit_step(heat: Column | float, eps: Column | float, h: Column | float, t: Column, k_deep: Column | float = 0.0) -> Column:
    """The longest step (s) that an explicit march could take at t (K); surface_step has no such limit."""
    return 2.0 * heat / (h + k_deep + 4.0 * eps * SIGMA * F.pow(t, F.lit(3.0)))


def march(series: Column, start: Column, h: Column | float = 8.0, eps: float = 0.95, heat: float = 2.5e5, dt: float = 3600.0) -> Column:
    """Surface temperature (K) after all steps of an array of structs (absorbed, air in K)."""
    return F.aggregate(series, start, lambda t, f: surface_step(t, f["absorbed"], f["air"], h, eps, heat, dt))


def march_day(clock: Column, start: Column, slots: int, eps: Column | float, heat: Column | float, k_deep: Column | float = 0.0, t_deep: Column | float = 0.0, beta: Column | float = 0.0, loops: int = 3, step: float = 300.0) -> Column:
    """Surface temperatures (K) at the beginning of each slot of a day that repeats `loops` times, from the last of them.

    clock: array of `slots` structs (q: absorbed, air: K, h), already the means of a slot and the next one. One fold over
    loops * slots steps of the clock carries the temperature and, in the last loop, what it was before each slot."""
    inner = max(1, round(86400 / slots / step))
    dt = 86400 / slots / inner
    begin = F.struct(start.cast("double").alias("t"), F.array().cast("array<double>").alias("out"))

    def slot(state: Column, i: Column) -> Column:
        f = F.get(clock, i % slots)
        after = F.aggregate(F.sequence(F.lit(1), F.lit(inner)), state["t"], lambda t, _: surface_step(t, f["q"], f["air"], f["h"], eps, heat, dt, k_deep, t_deep, beta))
        emitted = F.when(i >= (loops - 1) * slots, F.concat(state["out"], F.array(state["t"]))).otherwise(state["out"])
        return F.struct(after.alias("t"), emitted.alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(loops * slots - 1)), begin, slot, lambda state: state["out"])


def convection_for(series: Column, start: Column, target: Column, at: Column | int, low: float = 2.0, high: float = 60.0, steps: int = 40, eps: float = 0.95, heat: float = 2.5e5, dt: float = 3600.0) -> Column:
    """The convection coefficient with which a surface is at `target` (K) after step `at` (from 0) of a march over series (absorbed,
    air): bisection, each step of which is a whole march; a task halves the ranges of a batch of rows together. More convection cools a surface that is
    hotter than the air; a target that no coefficient in the range meets gives the range's end."""

    def solve(absorbed: pa.Array, air: pa.Array, start: pa.Array, target: pa.Array, at: pa.Array) -> pa.Array:
        floats = lambda x: x.cast(pa.float64()).to_numpy(zero_copy_only=False)
        last = at.cast(pa.int64()).fill_null(-1).to_numpy()
        offsets = absorbed.offsets.to_numpy()
        known = (absorbed.is_valid().to_numpy(False) & target.is_valid().to_numpy(False) & at.is_valid().to_numpy(False)) & (np.diff(offsets) > last)
        count = np.where(known, last + 1, 0)
        order = np.argsort(-count, kind="stable")  # the rows that go on are the first ones
        goal, begin, missing = floats(target)[order], floats(start)[order], start.is_null().to_numpy(False)[order]
        marched = []
        for j in range(int(count.max(initial=0))):
            rows = order[: np.count_nonzero(count > j)]
            q, a = absorbed.values.take(pa.array(offsets[rows] + j)), air.values.take(pa.array(air.offsets.to_numpy()[rows] + j))
            missing[: len(rows)] |= q.is_null().to_numpy(False) | a.is_null().to_numpy(False)
            marched.append((floats(q), floats(a)))
        under, over = np.full(len(order), float(low)), np.full(len(order), float(high))
        with np.errstate(all="ignore"):
            for _ in range(steps):
                middle, t = (under + over) / 2, begin.copy()
                for q, a in marched:
                    n = len(q)
                    t[:n] = surface_step(t[:n], q, a, middle[:n], eps, heat, dt, power=np.power, positive=lambda net: np.maximum(net, 0.0))
                hot = ~missing & ((t > goal) | (np.isnan(t) & ~np.isnan(goal)))  # as Spark orders NaN
                under, over = np.where(hot, middle, under), np.where(hot, over, middle)
        out = np.empty(len(order))
        out[order] = (under + over) / 2
        return pa.array(out, mask=~known)

    at = F.lit(at) if isinstance(at, int) else at
    return F.arrow_udf(solve, "double")(series["absorbed"], series["air"], start.cast("double"), target, at)


def flux_mean(temperatures: Column) -> Column:
    """°C of one surface that emits as much as equal parts at these temperatures (array, K)."""
    total = F.aggregate(temperatures, F.lit(0.0), lambda a, t: a + F.pow(t, F.lit(4.0)))
    return F.pow(total / F.size(temperatures), F.lit(0.25)) - 273.15


def damping(conductivity: Column, density: Column, heat: Column, period: float = 86400.0, most: float = 0.3) -> Column:
    """Depth (m) to which a cycle of this period reaches, capped: the square root of 2 * diffusivity / frequency."""
    import math

    return F.least(F.lit(most), F.sqrt(2.0 * (conductivity / (density * heat)) / (2.0 * math.pi / period)))


# --- trees ---

#: A (m), b, c of the height by trunk diameter, then slope and intercept of the crown base.
TREES = {
    "large_broadleaf": (33.0, 0.00796, 0.7882, 0.1448, 1.3336),
    "eucalypt": (35.0, 0.01413, 1.0757, 0.3487, -0.1599),
    "conifer": (30.0, 0.02098, 1.4216, 0.1247, 0.7946),
    "evergreen_medium": (22.0, 0.01465, 0.9478, 0.1364, 1.5689),
    "small_tree": (13.0, 0.02806, 0.9351, 0.1708, 1.1401),
    "palm": (0.0, 0.0, 1.0, 0.8667, -2.4822),
}


def tree_coefficient(cls: Column, k: int) -> Column:
    """The k-th fixed value of a class; of an unknown class, that of medium evergreens."""
    known = F.create_map(*[F.lit(x) for name, row in TREES.items() for x in (name, row[k])])
    return F.coalesce(F.element_at(known, cls), F.lit(TREES["evergreen_medium"][k]))


def tree_height(dbh_cm: Column, cls: Column) -> Column:
    """Height (2..40 m) by trunk diameter; palms are 10 m."""
    a, b, c = (tree_coefficient(cls, k) for k in range(3))
    grown = 1.3 + a * F.pow(1.0 - F.exp(-b * dbh_cm), c)
    return F.when(cls == "palm", 10.0).otherwise(clamp(grown, 2.0, 40.0))


def capped_by_age(height: Column, age: Column, imputed: Column) -> Column:
    """A tree of imputed diameter is at most as high as 0.75 m a year allow, 2 m at least."""
    cap = 1.3 + 0.75 * age
    return F.when(imputed & (age > 0) & (height > cap), F.greatest(cap, F.lit(2.0))).otherwise(height)


def crown_base(height: Column, cls: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(0.9 * height, tree_coefficient(cls, 3) * height + tree_coefficient(cls, 4)))


# --- walking ---


def equivalent_length(length: Column, rise: Column, conveying: Column, per_metre: float = 3.0) -> Column:
    """Length plus what climbing costs, in metres; a moving way costs no climbing."""
    return length + F.when(F.coalesce(conveying, F.lit(False)) | (F.coalesce(rise, F.lit(0.0)) <= 0), 0.0).otherwise(per_metre * rise)


def edge_cost(length: Column, rise: Column, conveying: Column, badness: Column, k: float) -> Column:
    """What an edge costs a walker who minds: its equivalent length, raised by its badness (none known: 0)."""
    return equivalent_length(length, rise, conveying) * (1.0 + k * F.coalesce(badness, F.lit(0.0)))


def preference_ladder(rungs: list[float], unacclimatised: Column, vulnerable: Column, per_flag: float = 1.8) -> Column:
    """The preferences that a walker's options span: each rung times a factor for each flag that is set."""
    flag = lambda c: F.when(F.coalesce(c, F.lit(False)), per_flag).otherwise(1.0)
    factor = F.round(flag(unacclimatised) * flag(vulnerable), 4)
    return F.transform(F.array(*[F.lit(float(r)) for r in rungs]), lambda r: F.round(r * factor, 4))


def piecewise(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Linear between the knots, constant beyond the first and the last."""
    out = F.when(x <= knots[0][0], knots[0][1])
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        out = out.when(x <= x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return out.otherwise(F.when(x.isNotNull(), knots[-1][1]))
