"""Nelder-Mead minimisation for few dimensions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def minimise(f: Callable[[np.ndarray], float], start: np.ndarray, x_tol: float, f_tol: float, most: int) -> tuple[np.ndarray, float, bool, int]:
    """Best point, its value, whether it converged, and the iterations taken.

    Coefficients adapt to the dimension d: expansion 1 + 2/d, contraction
    3/4 - 1/(2d), shrinkage 1 - 1/d. The first simplex moves each coordinate by
    5 % (by 0.00025 if it is zero).
    """
    d = len(start)
    expand, contract, shrink = 1 + 2 / d, 0.75 - 1 / (2 * d), 1 - 1 / d
    points = [np.array(start, float)]
    for i in range(d):
        moved = np.array(start, float)
        moved[i] = moved[i] * 1.05 if moved[i] else 0.00025
        points.append(moved)
    ranked = sorted(((f(p), i, p) for i, p in enumerate(points)), key=lambda x: x[:2])
    simplex = [(v, p) for v, _, p in ranked]
    for turn in range(1, most + 1):
        low = simplex[0]
        if max(np.abs(p - low[1]).max() for _, p in simplex[1:]) <= x_tol and max(abs(v - low[0]) for v, _ in simplex[1:]) <= f_tol:
            return low[1], low[0], True, turn - 1
        worst = simplex[-1]
        centre = sum(p for _, p in simplex[:-1]) / d

        def at(step: float, centre: np.ndarray = centre, worst=worst) -> tuple[float, np.ndarray]:
            p = centre + step * (centre - worst[1])
            return f(p), p

        mirrored = at(1.0)
        if mirrored[0] < low[0]:
            far = at(expand)
            new = far if far[0] < mirrored[0] else mirrored
        elif mirrored[0] < simplex[-2][0]:
            new = mirrored
        else:
            outside = mirrored[0] < worst[0]
            near = at(contract if outside else -contract)
            new = near if (near[0] <= mirrored[0] if outside else near[0] < worst[0]) else None
        if new is None:
            simplex = [low] + [(f(p), p) for p in (low[1] + shrink * (q - low[1]) for _, q in simplex[1:])]
        else:
            simplex[-1] = new
        simplex.sort(key=lambda x: x[0])
    return simplex[0][1], simplex[0][0], False, most
