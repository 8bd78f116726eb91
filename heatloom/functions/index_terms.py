"""Coefficients of the thermal climate index: a polynomial of the sixth degree in air temperature (°C), wind (m/s at 10 m),
radiant less air temperature (K) and vapour pressure (kPa), as published with the index's operational procedure (2012)."""

from __future__ import annotations

DEGREE = 6

#: Fixed values, in the order of powers(): one for each set of powers that add up to six at most.
COEFFICIENTS = [
    0.607562052, -0.0227712343, 8.06470249e-04, -1.54271372e-04, -3.24651735e-06, 7.32602852e-08, 1.35959073e-09, -2.25836520, 0.0880326035,
    0.00216844454, -1.53347087e-05, -5.72983704e-07, -2.55090145e-09, -0.751269505, -0.00408350271, -5.21670675e-05, 1.94544667e-06, 1.14099531e-08,
    0.158137256, -6.57263143e-05, 2.22697524e-07, -4.16117031e-08, -0.0127762753, 9.66891875e-06, 2.52785852e-09, 4.56306672e-04, -1.74202546e-07,
    -5.91491269e-06, 0.398374029, 1.83945314e-04, -1.73754510e-04, -7.60781159e-07, 3.77830287e-08, 5.43079673e-10, -0.0200518269, 8.92859837e-04,
    3.45433048e-06, -3.77925774e-07, -1.69699377e-09, 1.69992415e-04, -4.99204314e-05, 2.47417178e-07, 1.07596466e-08, 8.49242932e-05, 1.35191328e-06,
    -6.21531254e-09, -4.99410301e-06, -1.89489258e-08, 8.15300114e-08, 7.55043090e-04, -5.65095215e-05, -4.52166564e-07, 2.46688878e-08,
    2.42674348e-10, 1.54547250e-04, 5.24110970e-06, -8.75874982e-08, -1.50743064e-09, -1.56236307e-05, -1.33895614e-07, 2.49709824e-09,
    6.51711721e-07, 1.94960053e-09, -1.00361113e-08, -1.21206673e-05, -2.18203660e-07, 7.51269482e-09, 9.79063848e-11, 1.25006734e-06,
    -1.81584736e-09, -3.52197671e-10, -3.36514630e-08, 1.35908359e-10, 4.17032620e-10, -1.30369025e-09, 4.13908461e-10, 9.22652254e-12,
    -5.08220384e-09, -2.24730961e-11, 1.17139133e-10, 6.62154879e-10, 4.03863260e-13, 1.95087203e-12, -4.73602469e-12, 5.12733497, -0.312788561,
    -0.0196701861, 9.99690870e-04, 9.51738512e-06, -4.66426341e-07, 0.548050612, -0.00330552823, -0.00164119440, -5.16670694e-06, 9.52692432e-07,
    -0.0429223622, 0.00500845667, 1.00601257e-06, -1.81748644e-06, -1.25813502e-03, -1.79330391e-04, 2.34994441e-06, 1.29735808e-04, 1.29064870e-06,
    -2.28558686e-06, -0.0369476348, 0.00162325322, -3.14279680e-05, 2.59835559e-06, -4.77136523e-08, 8.64203390e-03, -6.87405181e-04, -9.13863872e-06,
    5.15916806e-07, -3.59217476e-05, 3.28696511e-05, -7.10542454e-07, -1.24382300e-05, -7.38584400e-09, 2.20609296e-07, -7.32469180e-04,
    -1.87381964e-05, 4.80925239e-06, -8.75492040e-08, 2.77862930e-05, -5.06004592e-06, 1.14325367e-07, 2.53016723e-06, -1.72857035e-08,
    -3.95079398e-08, -3.59413173e-07, 7.04388046e-07, -1.89309167e-08, -4.79768731e-07, 7.96079978e-09, 1.62897058e-09, 3.94367674e-08,
    -1.18566247e-09, 3.34678041e-10, -1.15606447e-10, -2.80626406, 0.548712484, -0.00399428410, -9.54009191e-04, 1.93090978e-05, -0.308806365,
    0.0116952364, 4.95271903e-04, -1.90710882e-05, 0.00210787756, -6.98445738e-04, 2.30109073e-05, 4.17856590e-04, -1.27043871e-05, -3.04620472e-06,
    0.0514507424, -0.00432510997, 8.99281156e-05, -7.14663943e-07, -2.66016305e-04, 2.63789586e-04, -7.01199003e-06, -1.06823306e-04, 3.61341136e-06,
    2.29748967e-07, 3.04788893e-04, -6.42070836e-05, 1.16257971e-06, 7.68023384e-06, -5.47446896e-07, -3.59937910e-08, -4.36497725e-06,
    1.68737969e-07, 2.67489271e-08, 3.23926897e-09, -0.0353874123, -0.221201190, 0.0155126038, -2.63917279e-04, 0.0453433455, -0.00432943862,
    1.45389826e-04, 2.17508610e-04, -6.66724702e-05, 3.33217140e-05, -0.00226921615, 3.80261982e-04, -5.45314314e-09, -7.96355448e-04, 2.53458034e-05,
    -6.31223658e-06, 3.02122035e-04, -4.77403547e-06, 1.73825715e-06, -4.09087898e-07, 0.614155345, -0.0616755931, 0.00133374846, 0.00355375387,
    -5.13027851e-04, 1.02449757e-04, -0.00148526421, -4.11469183e-05, -6.80434415e-06, -9.77675906e-06, 0.0882773108, -0.00301859306, 0.00104452989,
    2.47090539e-04, 0.00148348065,
]


def powers(degree: int = DEGREE) -> list[tuple[int, int, int, int]]:
    """Powers of air temperature (which runs fastest), wind, excess and vapour pressure that add up to the degree at most."""
    up = range(degree + 1)
    return [(t, w, x, v) for v in up for x in up[: degree + 1 - v] for w in up[: degree + 1 - v - x] for t in up[: degree + 1 - v - x - w]]


def terms() -> list[tuple[float, int, int, int, int]]:
    """(coefficient, powers) as comfort.climate_index takes them."""
    return [(c, *p) for c, p in zip(COEFFICIENTS, powers(), strict=True)]
