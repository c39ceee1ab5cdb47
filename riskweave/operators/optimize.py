"""Search of parameters in a box by a Gaussian process: what trials to run next, not how."""

from __future__ import annotations

import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np

#: Length scales, as shares of the box, among which the likelihood chooses.
SCALES = (0.08, 0.15, 0.3, 0.6, 1.2, 2.4)
#: Points at which the acquisition is looked at: drawn over the box, and around the best so far.
CANDIDATES, NEAR = 2000, 500


def matern(a: np.ndarray, b: np.ndarray, scale: float) -> np.ndarray:
    """Matern kernel of smoothness 5/2 between rows of two matrices."""
    d = np.sqrt(np.maximum(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2), 0)) * np.sqrt(5) / scale
    return (1 + d + d * d / 3) * np.exp(-d)


class GaussianProcess:
    """Posterior of a function on the unit cube given its values at some points.

    Values are brought to mean 0 and deviation 1, the length scale is the one of greatest
    likelihood, and all solves go through one Cholesky factor.
    """

    def __init__(self, noise: float = 1e-6):
        self.noise = noise

    def fit(self, x: np.ndarray, y: np.ndarray) -> GaussianProcess:
        self.x, self.mean, self.spread = x, float(y.mean()), float(y.std()) or 1.0
        z = (y - self.mean) / self.spread
        best = None
        for scale in SCALES:
            factor = np.linalg.cholesky(matern(x, x, scale) + self.noise * np.eye(len(x)))
            weights = np.linalg.solve(factor.T, np.linalg.solve(factor, z))
            likelihood = -0.5 * float(z @ weights) - float(np.log(np.diag(factor)).sum())
            if best is None or likelihood > best[0]:
                best = (likelihood, scale, factor, weights)
        _, self.scale, self.factor, self.weights = best
        return self

    def predict(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Means and deviations at some points."""
        k = matern(at, self.x, self.scale)
        half = np.linalg.solve(self.factor, k.T)
        return self.mean + self.spread * (k @ self.weights), self.spread * np.sqrt(np.maximum(1 - (half * half).sum(axis=0), 0))


def _value(lo: float, hi: float, share: float):
    x = lo + share * (hi - lo)
    return int(x) if lo >= 1 else x


def _params(space: dict[str, tuple[float, float]], point) -> dict:
    return {k: _value(lo, hi, min(max(float(u), 0.0), 1.0)) for (k, (lo, hi)), u in zip(space.items(), point, strict=True)}


def _shares(space: dict[str, tuple[float, float]], params: dict) -> list[float]:
    """Where parameters lie in the box, whole numbers where they are taken to be."""
    return [(params[k] - lo) / (hi - lo) if hi > lo else 0.0 for k, (lo, hi) in space.items()]


def propose(space: dict, done: list[dict], count: int, kappa: float, rng: np.random.Generator) -> list[dict]:
    """The next ``count`` parameters: each of greatest upper confidence bound ``mean + kappa * deviation``,
    the ones before it in the batch taken as if they had the values that the process expects."""
    x = np.array([_shares(space, d["params"]) for d in done])
    y = np.array([d["target"] for d in done], float)
    out = []
    for _ in range(count):
        gp = GaussianProcess().fit(x, y)
        near = x[int(np.argmax(y))] + rng.normal(0, 0.1, (NEAR, len(space)))
        points = np.vstack([rng.random((CANDIDATES, len(space))), np.clip(near, 0, 1)])
        points = np.array([_shares(space, _params(space, p)) for p in points])  # as they would be tried
        mean, deviation = gp.predict(points)
        bound = mean + kappa * deviation
        i = int(np.argmax(bound))
        out.append(_params(space, points[i]))
        x, y = np.vstack([x, points[i]]), np.append(y, mean[i])
    return out


def maximise(target: Callable[[dict], float], space: dict[str, tuple[float, float]], trials: int = 10, seed: int = 7, strategy: str = "gp", init_points: int | None = None, kappa: float = 2.576, batch: int = 1, wrap: Callable | None = None) -> tuple[dict, list[dict]]:
    """(best trial, all trials in order), each with ``params`` and ``target``, of a seeded search.

    ``gp``: ``init_points`` (a third of the trials) drawn over the box, then batches proposed by a
    Gaussian process; the trials of a batch run side by side, and their order does not matter.
    ``shrink``: half of the trials over the box, the others around the best in a shrinking box. Bounds
    of at least 1 give whole numbers. A target that is None or NaN counts as the least so far.
    """
    if strategy == "shrink":
        return _shrinking(target, space, trials, seed)
    if strategy != "gp":
        raise ValueError(f"unknown strategy {strategy!r}")
    rng, done = np.random.default_rng(seed), []
    first = max(1, min(trials, init_points if init_points is not None else -(-trials // 3)))
    run = wrap(target) if wrap else target
    with ThreadPoolExecutor(max(1, batch)) as pool:
        while len(done) < trials:
            many = min(batch, trials - len(done))
            if len(done) < first:
                many = min(many, first - len(done))
                tried = [_params(space, rng.random(len(space))) for _ in range(many)]
            else:
                tried = propose(space, done, many, kappa, rng)
            for params, value in zip(tried, pool.map(run, tried), strict=True):
                bad = value is None or value != value
                done.append({"params": params, "target": min((d["target"] for d in done), default=0.0) if bad else float(value)})
    return max(done, key=lambda d: d["target"]), done


def _shrinking(target: Callable[[dict], float], space: dict, trials: int, seed: int) -> tuple[dict, list[dict]]:
    rng, done = random.Random(seed), []

    def value(lo, hi, centre, width):
        x = rng.uniform(lo, hi) if centre is None else min(hi, max(lo, centre + rng.uniform(-width, width) * (hi - lo)))
        return int(x) if lo >= 1 else x

    for t in range(trials):
        best = max(done, key=lambda d: d["target"]) if done and t >= trials // 2 else None
        width = 0.5 * (1 - t / trials)
        params = {k: value(lo, hi, best and best["params"][k], width) for k, (lo, hi) in space.items()}
        done.append({"params": params, "target": target(params)})
    return max(done, key=lambda d: d["target"]), done
