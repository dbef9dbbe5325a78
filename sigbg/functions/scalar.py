"""Column expressions: score transforms and array math (all JVM-side).

Covers M1 logit, M2 guarded logit, M3 softmax, M8 log-sum-exp, M9 Gaussian
mixture log density, A6 argmax, P10 decision column and the L10 fixed
linear scorer.  Nothing here leaves whole-stage codegen except the
higher-order array functions, which are still evaluated in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the guard used by the reference's score transform (M2).
LOGIT_EPS = 1e-8


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sigmoid(z) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(z)))


def linear_score(coefs: dict[str, float], intercept: float = 0.0, places: int | None = None) -> Column:
    """Probability from fixed coefficients, sigmoid(b + sum w_i x_i); ``places`` rounds the sum first."""
    z = F.lit(float(intercept))
    for name, w in coefs.items():
        z = z + F.lit(float(w)) * F.col(name)
    return sigmoid(z if places is None else F.round(z, places))


def logit(p) -> Column:
    """M1: ln(p/(1-p)); +inf at 1, -inf at 0 (as the scipy function), null for null."""
    p = _c(p)
    return (F.when(p == 1.0, F.lit(float("inf")))
            .when(p == 0.0, F.lit(float("-inf")))
            .when((p < 0.0) | (p > 1.0), F.lit(float("nan")))
            .otherwise(F.log(p / (F.lit(1.0) - p))))


def guarded_logit(p, eps: float = LOGIT_EPS) -> Column:
    """M2: ln(p/(1-p+eps)+eps), finite on [0,1]."""
    p = _c(p)
    return F.log(p / (F.lit(1.0) - p + F.lit(eps)) + F.lit(eps))


def decision(score, cut: float = 0.5) -> Column:
    """P10: 1 if score > cut (strict) else 0."""
    return (_c(score) > F.lit(float(cut))).cast("int")


def log_sum_exp(arr) -> Column:
    """M8: max + ln(sum(exp(x - max))) over an array column."""
    a = _c(arr)
    m = F.array_max(a)
    s = F.aggregate(a, F.lit(0.0).cast("double"), lambda acc, x: acc + F.exp(x.cast("double") - m))
    return m + F.log(s)


def softmax(arr) -> Column:
    """M3: numerically stable softmax of an array column."""
    a = _c(arr)
    m = F.array_max(a)
    s = F.aggregate(a, F.lit(0.0).cast("double"), lambda acc, x: acc + F.exp(x.cast("double") - m))
    return F.transform(a, lambda x: F.exp(x.cast("double") - m) / s)


def argmax(arr) -> Column:
    """0-based index of the first maximum (NumPy argmax)."""
    a = _c(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def gmm_log_density(x, weights: Sequence[float], means: Sequence[float], sigmas: Sequence[float]) -> Column:
    """M9: log sum_k w_k N(x | mu_k, sigma_k), via log-sum-exp over components."""
    if not (len(weights) == len(means) == len(sigmas)):
        raise ValueError("mixture parameter lengths differ")
    x = _c(x).cast("double")
    terms = []
    for w, mu, s in zip(weights, means, sigmas):
        z = (x - F.lit(float(mu))) / F.lit(float(s))
        terms.append(F.lit(float(_log(w))) - F.lit(float(_log(s))) - F.lit(0.5 * _log(2 * 3.141592653589793))
                     - F.lit(0.5) * z * z)
    return log_sum_exp(F.array(*terms))


def _log(v: float) -> float:
    import math
    return math.log(v)
