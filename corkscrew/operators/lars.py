"""Least-angle regression from one Gram aggregation.

``X'X``, ``X'y`` and the sums of one pass over the rows (``models.gram``: each
block adds its matrix products, partitions are summed in a tree) hold all that
the path needs; its steps are p x p algebra on the driver.

The path runs from no feature to the least-squares solution. ``lasso`` drops a
feature whose coefficient reaches zero, so that every point of the path solves
``|y - Xw|^2 / (2n) + alpha |w|_1`` for its alpha. Rows without a target are
left out, missing features count as 0, constant features never enter, and of
features with equal correlations the first in order enters first. A feature that
is a combination of the active ones is set aside when it would enter.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: A correlation or a step below this share of the largest one counts as zero.
TINY = 1e-12


def lars_path(gram: np.ndarray, xy: np.ndarray, n: float, lasso: bool = False, alpha_min: float = 0.0, max_steps: int | None = None) -> list[dict]:
    """Knots of the path: ``step``, ``feature`` (that entered at this knot; None at
    the end of the path), ``dropped``, ``alpha`` (largest absolute correlation
    over n) and ``coef`` there. ``gram`` and ``xy`` are of centred columns."""
    p = len(xy)
    coef = np.zeros(p)
    usable = np.diag(gram) > TINY * max(1.0, np.abs(np.diag(gram)).max(initial=0.0))
    active: list[int] = []
    start = np.abs(xy[usable]).max(initial=0.0)
    knots: list[dict] = []
    dropped = None
    limit = max_steps if max_steps is not None else 8 * p + 8
    while len(knots) < limit:
        corr = xy - gram @ coef
        free = [j for j in range(p) if usable[j] and j not in active and j != dropped]
        top = max((abs(corr[j]) for j in (active or free)), default=0.0)
        at_end = dropped is None and not free and bool(knots)
        if at_end or top <= TINY * max(start, 1e-300) or (top / n <= alpha_min and not knots):
            knots.append({"step": len(knots), "feature": None, "dropped": dropped, "alpha": top / n, "coef": coef.copy()})
            break
        entered = None
        if dropped is None and free:
            entered = max(free, key=lambda j: (round(abs(corr[j]) / top, 12), -j))
            if np.linalg.matrix_rank(gram[np.ix_(active + [entered], active + [entered])], hermitian=True) <= len(active):
                usable[entered] = False
                continue
            active.append(entered)
        knots.append({"step": len(knots), "feature": entered, "dropped": dropped, "alpha": top / n, "coef": coef.copy()})
        signs = np.sign(corr[active])
        way = np.linalg.solve(gram[np.ix_(active, active)], signs)  # all active correlations fall by 1 a unit
        fall = gram[:, active] @ way
        length = top
        for j in range(p):
            if usable[j] and j not in active:
                for gap, rate in ((top - corr[j], 1 - fall[j]), (top + corr[j], 1 + fall[j])):
                    if rate > TINY and (j != dropped or gap > 1e-9 * top):  # where it left, it does not come back
                        length = min(length, max(gap, 0.0) / rate)
        dropped = None
        if lasso:
            for at, j in enumerate(active):
                zero = -coef[j] / way[at] if way[at] else -1.0
                if TINY * top < zero < length:
                    length, dropped = zero, j
        stop = top - length <= alpha_min * n
        if stop:
            length, dropped = top - alpha_min * n, None
        coef[active] += length * way
        if dropped is not None:
            coef[dropped] = 0.0
            active.remove(dropped)
        if stop:
            end = np.abs(xy - gram @ coef)[active].max(initial=0.0)
            knots.append({"step": len(knots), "feature": None, "dropped": None, "alpha": end / n, "coef": coef.copy()})
            break
    return knots


def centred(n: float, sx: np.ndarray, xx: np.ndarray, sy: np.ndarray, xy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gram sums of the columns and one target, less their means."""
    return xx - np.outer(sx, sx) / n, xy[:, 0] - sx * sy[0] / n


def path_rows(knots: Sequence[dict], features: Sequence[str]) -> list[tuple]:
    """(step, entered, dropped, alpha, feature, coefficient) for every knot and feature."""
    name = lambda j: None if j is None else features[j]
    return [(k["step"], name(k["feature"]), name(k["dropped"]), float(k["alpha"]), f, float(c)) for k in knots for f, c in zip(features, k["coef"])]


PATH_SCHEMA = "step int, entered string, dropped string, alpha double, feature string, coefficient double"
