"""Elementary symmetric polynomials of exp(predictors) with two derivatives, on a log scale, for many groups at once.

The coefficient e_k of prod(1 + exp(lp_j) z) sums over all choices of k members.  Weighted by its terms, such a choice
is random; what is kept of each k is log e_k and the mean and covariance of the sum of covariates of a choice, which are
the first and second derivatives of log e_k.  Products mix the choices of two parts, with weights that add to one, so
nothing overflows or cancels.

``chosen`` has one coefficient alone, by a sum over points of a circle: its work doesn't grow with k.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Numbers in the largest array of a product.
MOST_CELLS = 4_000_000
#: Minus log of what ``chosen`` leaves out, against its result.
LEFT_OUT = 42.0


@dataclass
class Choices:
    """For each row and k = 0..: log e_k (-inf where k is more than the members), mean (…, p) and covariance (…, p, p)."""

    log: np.ndarray
    mean: np.ndarray
    cov: np.ndarray

    def take(self, at: np.ndarray) -> Choices:
        return Choices(self.log[at], self.mean[at], self.cov[at])

    def widened(self, k: int) -> Choices:
        """With coefficients 0..k."""
        n, have, p = self.log.shape[0], self.log.shape[1], self.mean.shape[2]
        if have > k:
            return Choices(self.log[:, : k + 1], self.mean[:, : k + 1], self.cov[:, : k + 1])
        out = Choices(np.full((n, k + 1), -np.inf), np.zeros((n, k + 1, p)), np.zeros((n, k + 1, p, p)))
        out.log[:, :have], out.mean[:, :have], out.cov[:, :have] = self.log, self.mean, self.cov
        return out


def copies(lp: np.ndarray, x: np.ndarray, count: np.ndarray, most: int) -> Choices:
    """Choices from ``count`` equal members, a row each: (1 + exp(lp) z)^count."""
    most = int(min(most, count.max(initial=1)))
    k = np.arange(most + 1)
    with np.errstate(divide="ignore"):
        steps = np.log(np.maximum(count[:, None] - k[None, :-1], 0) / (k[None, :-1] + 1))
    ways = np.concatenate([np.zeros((len(lp), 1)), np.cumsum(steps, axis=1)], axis=1)
    p = x.shape[1]
    return Choices(ways + k * lp[:, None], k[None, :, None] * x[:, None, :], np.zeros((len(lp), most + 1, p, p)))


def merged(a: Choices, b: Choices, most: int) -> Choices:
    """Choices from the members of a and b together, row by row, up to ``most``."""
    n, p, ka, kb = a.log.shape[0], a.mean.shape[2], a.log.shape[1] - 1, b.log.shape[1] - 1
    width = min(ka + kb, most)
    portion = max(1, MOST_CELLS // ((width + 1) * (ka + 1) * (p + 1)))
    if n > portion:
        parts = [merged(a.take(slice(i, i + portion)), b.take(slice(i, i + portion)), most) for i in range(0, n, portion)]
        return Choices(*(np.concatenate([getattr(x, f) for x in parts]) for f in ("log", "mean", "cov")))
    # one long row has its coefficients made in portions too
    some = max(1, MOST_CELLS // (max(n, 1) * (max(ka, kb) + 1) * (p + 1)))
    parts = [_coefficients(a, b, np.arange(i, min(i + some, width + 1))) for i in range(0, width + 1, some)]
    return Choices(*(np.concatenate([getattr(x, f) for x in parts], axis=1) for f in ("log", "mean", "cov"))) if len(parts) > 1 else parts[0]


def _coefficients(a: Choices, b: Choices, wanted: np.ndarray) -> Choices:
    """The coefficients ``wanted`` of the products of a and b, row by row."""
    ka, kb = a.log.shape[1] - 1, b.log.shape[1] - 1
    k, i = wanted[:, None], np.arange(ka + 1)[None, :]
    j = k - i
    fits, j = (j >= 0) & (j <= kb), np.clip(j, 0, kb)
    terms = np.where(fits, a.log[:, None, :] + b.log[:, j], -np.inf)
    top = terms.max(axis=2, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    w = np.exp(terms - top)
    total = w.sum(axis=2, keepdims=True)
    with np.errstate(divide="ignore"):
        log = (np.log(total) + top)[:, :, 0]
    w /= np.where(total > 0, total, 1.0)
    sums = a.mean[:, None, :, :] + b.mean[:, j, :]
    mean = (w[..., None] * sums).sum(axis=2)
    off = sums - mean[:, :, None, :]
    cov = np.matmul((w[..., None] * off).swapaxes(2, 3), off)
    cov += np.einsum("bki,bipq->bkpq", w, a.cov)
    back = k - np.arange(kb + 1)[None, :]
    of_b = np.where((back >= 0) & (back <= ka), w[:, np.arange(len(wanted))[:, None], np.clip(back, 0, ka)], 0.0)
    cov += np.einsum("bkj,bjpq->bkpq", of_b, b.cov)
    return Choices(log, mean, cov)


def product(group: np.ndarray, parts: Choices, most: int) -> Choices:
    """One row per group, in order, of the members of all its parts; ``group`` is sorted.  Neighbours are merged level by level."""
    while True:
        same = np.zeros(len(group), dtype=bool)
        same[:-1] = group[1:] == group[:-1]
        starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, dtype=int)
        place = np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))
        first = place % 2 == 0
        pair = np.flatnonzero(first & same)
        if not len(pair):
            return parts.widened(most)
        both = merged(parts.take(pair), parts.take(pair + 1), most)
        heads = np.flatnonzero(first)
        out = parts.take(heads).widened(both.log.shape[1] - 1)
        at = np.searchsorted(heads, pair)
        for f in ("log", "mean", "cov"):
            getattr(out, f)[at] = getattr(both, f)
        group, parts = group[heads], out


def _tilt(lp: np.ndarray, count: np.ndarray, d: int) -> float:
    """s for which members that are drawn one by one, with odds exp(lp + s), are about d in the mean."""
    middle = np.log(d / (count.sum() - d))
    low, high = middle - lp.max(), middle - lp.min()
    s = min(max(middle - float(count @ lp) / count.sum(), low), high)
    for _ in range(200):
        q = 1 / (1 + np.exp(-np.clip(lp + s, -700, 700)))
        off, var = float(count @ q) - d, float(count @ (q * (1 - q)))
        if abs(off) <= 0.05 * (1 + np.sqrt(var)):
            break
        low, high = (low, s) if off > 0 else (s, high)
        s = s - off / var if var > 0 else np.inf
        if not low < s < high:
            s = (low + high) / 2
    return s


def _squares(y: np.ndarray, count: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Sums of count y y' z over the rows, for each column of z, in portions of rows."""
    p, portion = y.shape[1], max(1, MOST_CELLS // (y.shape[1] ** 2 + 1))
    out = np.zeros((p * p, z.shape[1]), dtype=complex)
    for i in range(0, len(y), portion):
        some = y[i : i + portion]
        out += (some[:, :, None] * (some * count[i : i + portion, None])[:, None, :]).reshape(len(some), p * p).T @ z[i : i + portion]
    return out


def chosen(lp: np.ndarray, x: np.ndarray, count: np.ndarray, d: int) -> tuple[float, np.ndarray, np.ndarray]:
    """log e_d, mean and covariance of the choices of d of the members, ``count`` equal ones a row.

    Members are drawn one by one, with odds that make d the usual number K of them: e_d is the product of 1 + odds, without the
    tilt of d members, times P(K = d).  That is the mean of the characteristic function, turned back by d, over points of a circle: so many that K misses d by a
    turn, and so few of them that the rest of the function is, with a chance or size below exp(-LEFT_OUT).  About 25 points are looked at, whatever d is.
    """
    n, p = int(count.sum()), x.shape[1]
    if d >= n:
        return (float(count @ lp) if d == n else -np.inf), count @ x, np.zeros((p, p))
    if not np.isfinite(lp).all():
        return np.nan, np.full(p, np.nan), np.full((p, p), np.nan)
    s = _tilt(lp, count, d)
    tilted = np.clip(lp + s, -700, 700)
    q, rest = 1 / (1 + np.exp(-tilted)), 1 / (1 + np.exp(tilted))
    spread = count * q * rest
    var = float(spread.sum())
    far = LEFT_OUT / 3 + np.sqrt(LEFT_OUT**2 / 9 + 2 * LEFT_OUT * var) + abs(float(count @ q) - d)
    points = int(min(far, max(d, n - d))) + 1
    points += points % 2 == 0  # an odd number has no point at half a turn, where 1 - q + q e^it may be 0
    j = np.arange(points // 2 + 1)
    j = j[2 * var * np.sin(np.pi * j / points) ** 2 <= LEFT_OUT]
    center = spread @ x / var if var > 0 else np.zeros(p)  # what goes along with K has no spread once K is given
    y = x - center
    weights, first, second = [], [], []
    portion = max(1, MOST_CELLS // (4 * len(lp)))
    for i in range(0, len(j), portion):
        t = 2 * np.pi * j[i : i + portion] / points
        half = np.sin(t / 2) ** 2
        log = 0.5 * (count @ np.log1p(-4 * np.outer(q * rest, half)))
        turn = count @ np.arctan2(np.outer(q, np.sin(t)), 1 - 2 * np.outer(q, half)) - d * t
        weights.append(np.exp(log + 1j * turn) * np.where(t > 0, 2, 1))
        z = np.outer(q, np.exp(1j * t))
        z /= rest[:, None] + z
        first.append((y * count[:, None]).T @ z)
        second.append(_squares(y, count, z * (1 - z)))
    w, g, h = np.concatenate(weights), np.concatenate(first, axis=1), np.concatenate(second, axis=1)
    total = float(w.real.sum())
    mean = (g * w).real.sum(axis=1) / total
    off = g - mean[:, None]
    cov = ((off[:, None, :] * off[None, :, :]).reshape(p * p, len(w)) + h) * w
    log = float(count @ np.logaddexp(0, lp + s)) - d * s + np.log(total / points)
    return float(log), mean + d * center, cov.real.sum(axis=1).reshape(p, p) / total
