"""The ordered recurrences in numpy, over many parameter vectors at once (arrays of shape [vectors])."""

from __future__ import annotations

import numpy as np

STEP = 1 / 365
#: Parameters that each model version uses, 0-based.
ACTIVE = {3: (0, 1, 2), 4: (0, 1, 2, 3), 5: (0, 1, 2, 5, 6), 7: (0, 1, 2, 4, 5, 6, 7), 8: tuple(range(8))}
INTEGRATORS = ("EUL", "RK2", "RK4", "CRN")
NEEDS_FLOW = (4, 7, 8)


def active_only(p: np.ndarray, version: int) -> np.ndarray:
    """Parameter vectors [vectors, 8] with the unused parameters set to zero."""
    if version not in ACTIVE:
        raise ValueError(f"version {version}")
    out = np.zeros_like(p)
    out[:, ACTIVE[version]] = p[:, ACTIVE[version]]
    return out


def season(p, t):
    return p[5] * np.cos(2 * np.pi * (t - p[6]))


def line(version: int, p, ta, theta, t):
    """The rate as a - b * tw: it is linear in the water temperature. p has the 8 parameters along its first axis."""
    a, b = p[0] + p[1] * ta, p[2]
    if version == 5:
        a = a + season(p, t)
    if version in (7, 8):
        a, b = a + theta * (p[4] + season(p, t)), b + theta * p[7]
    if version in (4, 8):
        w = np.exp(-p[3] * np.log(theta))
        a, b = a * w, b * w
    return a, b


def rate(version: int, p, ta, theta, t, tw):
    """Change of water temperature a day."""
    a, b = line(version, p, ta, theta, t)
    return a - b * tw


def stepped(version: int, integrator: str, p: np.ndarray, ta: np.ndarray, theta: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(alpha, beta), both [days - 1, vectors]: before it is clamped, a step gives alpha * tw + beta."""
    ta, theta, t = (x[:, None] for x in (ta, theta, t))
    now, then = (ta[:-1], theta[:-1], t[:-1]), (ta[1:], theta[1:], t[1:])
    if integrator == "EUL":
        a, b = line(version, p, *then)
        return 1 - b, a
    a0, b0 = line(version, p, *now)
    if integrator == "CRN":
        a1, b1 = line(version, p, *then)
        return (1 - 0.5 * b0) / (1 + 0.5 * b1), 0.5 * (a0 + a1) / (1 + 0.5 * b1)
    a1, b1 = line(version, p, then[0], then[1], now[2] + STEP)
    # a stage is c + d * tw; the next one sees tw + h * stage
    stage = lambda a, b, c, d, h: (a - b * h * c, -b * (1 + h * d))
    c1, d1 = a0, -b0
    if integrator == "RK2":
        c2, d2 = stage(a1, b1, c1, d1, 1.0)
        return 1 + 0.5 * (d1 + d2), 0.5 * (c1 + c2)
    am, bm = line(version, p, 0.5 * (now[0] + then[0]), 0.5 * (now[1] + then[1]), now[2] + 0.5 * STEP)
    c2, d2 = stage(am, bm, c1, d1, 0.5)
    c3, d3 = stage(am, bm, c2, d2, 0.5)
    c4, d4 = stage(a1, b1, c3, d3, 1.0)
    return 1 + (d1 + 2 * d2 + 2 * d3 + d4) / 6, (c1 + 2 * c2 + 2 * c3 + c4) / 6


def simulate(version: int, integrator: str, p: np.ndarray, ta, theta, t, start, ice: float = 0.0, begin=(0,), block: int = 1 << 19) -> np.ndarray:
    """Water temperature [days, vectors] for parameter vectors [vectors, 8].

    Segments may lie behind each other: ``begin`` has their first positions, ``start`` the value of each, one for
    all, or a row of one for each vector. The coefficients of all steps are made first, for a bounded block of days at a time, so that the recurrence
    itself is one multiplication, addition and clamp a day for all vectors."""
    if integrator not in INTEGRATORS:
        raise ValueError(f"integrator {integrator}")
    p = active_only(np.atleast_2d(np.asarray(p, float)), version).T
    ta, theta, t = (np.asarray(x, float) for x in (ta, theta, t))
    n, width = len(ta), p.shape[1]
    out = np.empty((n, width))
    begin, start = np.asarray(begin), np.asarray(start, float)
    start = start if start.ndim == 2 else np.broadcast_to(start, begin.shape)[:, None]
    days, multiply, add, maximum = max(2, block // max(1, width)), np.multiply, np.add, np.maximum
    with np.errstate(all="ignore"):  # unstable vectors become infinite or nan, and score as invalid
        for low in range(0, n, days):
            high, lead = min(n, low + days), max(0, low - 1)
            if high - lead > 1:
                alpha, beta = (np.broadcast_to(x, (high - lead - 1, width)) for x in stepped(version, integrator, p, ta[lead:high], theta[lead:high], t[lead:high]))
            inner = begin[(begin >= low) & (begin < high)]
            out[inner] = start[(begin >= low) & (begin < high)]
            cuts = [low - 1, *inner.tolist(), high]
            for first, last in zip(cuts, cuts[1:]):  # from a known row to the next segment
                if last - first > 1 and first >= 0:
                    tw = out[first]
                    for a, b, row in zip(alpha[first - lead : last - lead - 1], beta[first - lead : last - lead - 1], out[first + 1 : last]):
                        multiply(a, tw, out=row)
                        add(row, b, out=row)
                        maximum(row, ice, out=row)
                        tw = row
    return out


def ar1(z: np.ndarray, sigma: float, rho: float, before: np.ndarray | None = None) -> np.ndarray:
    """Noise with lag-1 correlation rho and deviation sigma from standard normal draws, along the first axis; ``before``
    is the noise that the first row follows."""
    out, scale = np.empty(z.shape), sigma * np.sqrt(1 - rho * rho)
    for i, x in enumerate(z):
        last = out[i - 1] if i else before
        out[i] = sigma * x if last is None else rho * last + scale * x
    return out
