"""Sparse Bayesian regression on sufficient statistics."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Changes of the noise below this share leave the posterior as it is.
NOISE_CHANGE = 1e-3
#: Noise variance never falls below this share of the mean square of the output.
NOISE_FLOOR = 1e-10
#: Steps per term after which a run gives up and says so.
STEPS_PER_TERM = 50


class SparseFit(NamedTuple):
    coef: np.ndarray
    used: np.ndarray
    sigma2: float
    converged: bool
    steps: int


class _Posterior:
    """Posterior of the active terms, kept up to date by rank-one changes.

    ``cov`` and ``mean`` belong to the active terms in the order of ``active``; ``s`` and ``q`` are the sparsity and quality
    factors of all terms against the current model.
    """

    def __init__(self, gram: np.ndarray, rhs: np.ndarray):
        self.gram, self.rhs = gram, rhs
        self.alpha = np.full(len(rhs), np.inf)
        self.active: list[int] = []

    def refresh(self, noise: float) -> None:
        """Recompute for a new noise variance."""
        self.noise, a = noise, self.active
        self.cov = np.linalg.inv(np.diag(self.alpha[a]) + self.gram[np.ix_(a, a)] / noise)
        self.mean = self.cov @ self.rhs[a] / noise
        cross = self.gram[:, a] / noise
        self.s = np.diag(self.gram) / noise - np.einsum("ij,jk,ik->i", cross, self.cov, cross)
        self.q = self.rhs / noise - cross @ self.mean

    def own(self) -> tuple[np.ndarray, np.ndarray]:
        """Factors with each active term left out."""
        s, q = self.s.copy(), self.q.copy()
        a = self.active
        scale = self.alpha[a] / (self.alpha[a] - self.s[a])
        s[a], q[a] = self.s[a] * scale, self.q[a] * scale
        return s, q

    def add(self, m: int, alpha: float) -> None:
        a = self.active
        own = 1 / (alpha + self.s[m])
        mean = own * self.q[m]
        pull = self.cov @ self.gram[a, m] / self.noise
        error = (self.gram[:, m] - self.gram[:, a] @ pull) / self.noise
        self.cov = np.block([[self.cov + own * np.outer(pull, pull), -own * pull[:, None]], [-own * pull[None, :], np.array([[own]])]])
        self.mean = np.append(self.mean - mean * pull, mean)
        self.s -= own * error**2
        self.q -= mean * error
        self.alpha[m] = alpha
        self.active.append(m)

    def change(self, m: int, alpha: float) -> None:
        """A new precision for an active term; infinity takes it out."""
        j = self.active.index(m)
        column, centre = self.cov[:, j].copy(), self.mean[j]
        gone = np.isinf(alpha)
        kappa = 1 / column[j] if gone else 1 / (column[j] + 1 / (alpha - self.alpha[m]))
        error = self.gram[:, self.active] @ column / self.noise
        self.cov -= kappa * np.outer(column, column)
        self.mean -= kappa * centre * column
        self.s += kappa * error**2
        self.q += kappa * centre * error
        self.alpha[m] = alpha
        if gone:
            keep = [i for i in range(len(self.active)) if i != j]
            self.cov, self.mean = self.cov[np.ix_(keep, keep)], self.mean[keep]
            self.active.pop(j)


def sparse_bayes(gram: np.ndarray, centred: np.ndarray, syy: float, n: int, mean_y: float, tolerance: float, steps_per_term: int = STEPS_PER_TERM) -> SparseFit:
    """Sequential marginal-likelihood steps (Tipping and Faul 2003) with the noise estimated along the way.

    Every step adds, takes out or re-weights the term with the largest gain; the posterior follows by a rank-one change.  Between
    steps the noise variance becomes residual / (n - terms + sum of alpha * variance); a noticeable change recomputes the posterior.
    Converged: no step gains, or gains stay below ``tolerance`` times the largest one while the noise has settled.  ``steps`` counts all
    steps; a run that meets its limit returns ``converged`` false.  An output without spread has its mean alone.
    """
    p = len(centred)
    coef, used = np.zeros(p), np.zeros(p, bool)
    if not syy > 0:
        coef[0], used[0] = mean_y, True
        return SparseFit(coef, used, 0.0, True, 0)
    # The constant takes the mean with it: everything below is about the mean, the constant alone is kept beside it.
    scale = np.sqrt(np.clip(np.diag(gram), 1e-300, None))
    means = gram[:, 0] / gram[0, 0]
    inner = gram - np.outer(means, means) * gram[0, 0]
    terms = np.flatnonzero(np.diag(inner) > 1e-12 * scale**2)
    terms = terms[terms != 0]
    if not len(terms):
        coef[0], used[0] = mean_y, True
        return SparseFit(coef, used, syy / max(n - 1, 1), True, 0)
    unit = scale[terms]
    g, b = inner[np.ix_(terms, terms)] / np.outer(unit, unit), (centred - means * centred[0])[terms] / unit
    model = _Posterior(g, b)
    floor = NOISE_FLOOR * syy / n
    noise = max(0.1 * syy / n, floor)
    first = int(np.argmax(b**2 / np.diag(g)))
    model.active = [first]
    model.alpha[first] = g[first, first] / max(b[first] ** 2 / g[first, first] - noise, 1e-12 * b[first] ** 2 / g[first, first] + 1e-300)
    model.refresh(noise)
    largest, steps, converged = 0.0, 0, False
    while steps < steps_per_term * len(terms):
        s, q = model.own()
        theta = q**2 - s
        inside = np.isfinite(model.alpha)
        up = theta > 1e-12 * np.abs(s)
        wanted = np.where(up, s**2 / np.where(up, theta, 1), np.inf)
        gain = np.full(len(terms), -np.inf)
        new = up & ~inside
        gain[new] = (model.q[new] ** 2 - model.s[new]) / model.s[new] + np.log(model.s[new] / model.q[new] ** 2)
        again = up & inside
        d = 1 / wanted[again] - 1 / model.alpha[again]
        safe = np.where(np.abs(d) > 1e-300, d, 1e-300)
        gain[again] = np.where(np.abs(d) > 1e-300, model.q[again] ** 2 / (model.s[again] + 1 / safe) - np.log1p(np.maximum(model.s[again] * safe, -1 + 1e-15)), 0.0)
        out = ~up & inside
        if len(model.active) > 1:
            gain[out] = model.q[out] ** 2 / (model.s[out] - model.alpha[out]) - np.log(np.maximum(1 - model.s[out] / model.alpha[out], 1e-300))
        best = int(np.argmax(gain))
        small = not gain[best] > 0 or gain[best] < tolerance * largest
        if gain[best] > 0:
            largest = max(largest, gain[best])
            if inside[best]:
                model.change(best, wanted[best] if up[best] else np.inf)
            else:
                model.add(best, wanted[best])
            steps += 1
        a = model.active
        residual = max(syy - 2 * model.mean @ b[a] + model.mean @ g[np.ix_(a, a)] @ model.mean, 0.0)
        freedom = n - 1 - len(a) + float(model.alpha[a] @ np.diag(model.cov))
        better = max(residual / max(freedom, 1e-9), floor)
        if abs(better - model.noise) > NOISE_CHANGE * model.noise:
            model.refresh(better)
        elif small:
            converged = True
            break
    a = terms[model.active]
    coef[a] = model.mean / scale[a]
    used[a] = True
    coef[0], used[0] = mean_y - coef[1:] @ means[1:], True
    about = coef.copy()
    about[0] -= mean_y
    residual = max(syy - 2 * about @ centred + about @ gram @ about, 0.0)
    return SparseFit(coef, used, residual / max(n - used.sum(), 1), converged, steps)
