"""Special functions in numpy: digamma, the regularised lower incomplete gamma function, gamma fits."""

from __future__ import annotations

import numpy as np


def _shifted(x: np.ndarray, term) -> tuple[np.ndarray, np.ndarray]:
    """x raised by whole steps to at least 8, and the sum of term() over the steps."""
    x, total = np.array(x, float), np.zeros(np.shape(x))
    while (low := x < 8).any():
        total[low] += term(x[low])
        x[low] += 1
    return x, total


def digamma(x: np.ndarray) -> np.ndarray:
    """Asymptotic series after the recurrence has raised x to at least 8."""
    x, steps = _shifted(np.atleast_1d(x), lambda v: 1 / v)
    r = 1 / (x * x)
    return np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132)))) - steps


def trigamma(x: np.ndarray) -> np.ndarray:
    x, steps = _shifted(np.atleast_1d(x), lambda v: 1 / (v * v))
    r = 1 / (x * x)
    return 1 / x + r / 2 + r / x * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r / 30))) + steps


def log_gamma(x: np.ndarray) -> np.ndarray:
    x, steps = _shifted(np.atleast_1d(x), np.log)
    r = 1 / (x * x)
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r * (1 / 1188 - r * 691 / 360360))))) / x - steps


def gamma_cdf(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function P(a, x): a power series below a + 1, a continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.zeros(a.shape)
    front = np.exp(a * np.log(np.maximum(x, 1e-300)) - x - log_gamma(a).reshape(a.shape))
    low = (x > 0) & (x < a + 1)
    if low.any():
        term = 1 / a[low]
        total, n = term.copy(), a[low].copy()
        for _ in range(1000):
            n += 1
            term = term * x[low] / n
            total += term
            if (np.abs(term) < np.abs(total) * 1e-16).all():
                break
        out[low] = total * front[low]
    high = x >= a + 1
    if high.any():
        b = x[high] + 1 - a[high]
        c, d = np.full(b.shape, 1e300), 1 / b
        h = d.copy()
        for i in range(1, 1000):
            k = -i * (i - a[high])
            b = b + 2
            d = 1 / _away(k * d + b)
            c = _away(b + k / c)
            step = c * d
            h *= step
            if (np.abs(step - 1) < 1e-16).all():
                break
        out[high] = 1 - h * front[high]
    return np.clip(out, 0, 1)


def _away(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 1e-300, 1e-300, x)


def gamma_shape(mean: np.ndarray, mean_log: np.ndarray) -> np.ndarray:
    """Maximum-likelihood shape of a two-parameter gamma distribution from the mean and the mean logarithm.

    Newton steps on log(a) - digamma(a) = log(mean) - mean_log, from the usual rational start.
    """
    s = np.maximum(np.log(mean) - mean_log, 1e-12)
    a = (3 - s + np.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(50):
        step = (np.log(a) - digamma(a) - s) / (1 / a - trigamma(a))
        a = np.maximum(a - step, a / 10)
        if (np.abs(step) < 1e-13 * a).all():
            break
    return a
