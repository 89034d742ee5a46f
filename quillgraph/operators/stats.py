"""Tests, agreement and generalized linear models over aggregates (ST-01 to ST-10, ST-12)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- tails of distributions, from series and continued fractions


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * front
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def beta_i(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for an in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + an * d or 1e-300)
            c = 1 + an / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def chi2_tail(x: float, dof: int) -> float:
    return gamma_q(dof / 2, x / 2)


def t_tail(t: float, dof: float) -> float:
    """Two-sided."""
    return beta_i(dof / (dof + t * t), dof / 2, 0.5)


def normal_tail(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


# ---- tests


def chi2_independence(table: list[list[float]]) -> tuple[float, float, int]:
    """(statistic, p, degrees of freedom) of a contingency table; with one degree, Yates' correction."""
    o = np.array(table, float)
    o = o[o.sum(1) > 0][:, o.sum(0) > 0]
    dof = (o.shape[0] - 1) * (o.shape[1] - 1)
    if dof <= 0:
        return 0.0, 1.0, 0
    e = np.outer(o.sum(1), o.sum(0)) / o.sum()
    gap = np.abs(o - e)
    if dof == 1:
        gap = gap - np.minimum(0.5, gap)
    x = float((gap**2 / e).sum())
    return x, chi2_tail(x, dof), dof


def binomial_test(k: int, n: int, p: float = 0.5) -> float:
    """Exact two-sided test: the sum of all outcomes that are at most as likely as k.

    Likelihood rises to its mode and falls again, so these outcomes are two tails: the other one's end
    is found by bisection, and both are values of the incomplete beta function.
    """
    if n == 0:
        return 1.0
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    lower = lambda i: 0.0 if i < 0 else 1.0 if i >= n else beta_i(1 - p, n - i, i + 1)
    upper = lambda i: 1.0 if i <= 0 else 0.0 if i > n else beta_i(p, i, n - i + 1)
    most, bound = min(n, math.floor((n + 1) * p)), log(k) + 1e-7
    if log(most) <= bound:
        return 1.0
    if k < most:
        a, b = most, n + 1  # the first outcome above the mode that is at most as likely
        while b - a > 1:
            a, b = ((a + b) // 2, b) if log((a + b) // 2) > bound else (a, (a + b) // 2)
        return min(1.0, lower(k) + upper(b))
    a, b = -1, most  # the last one below it
    while b - a > 1:
        a, b = (a, (a + b) // 2) if log((a + b) // 2) > bound else ((a + b) // 2, b)
    return min(1.0, lower(a) + upper(k))


def bonferroni(ps: list[float], compat: bool = False) -> list[float]:
    """p times their number, at most 1. `compat`: the correction is applied again at each of the tests,
    so the i-th of k is multiplied by i, i + 1, … k."""
    k = len(ps)
    if not compat:
        return [min(1.0, p * k) for p in ps]
    out: list[float] = []
    for i, p in enumerate(ps, 1):
        out = [min(1.0, x * i) for x in [*out, p]]
    return out


def t_test(a: tuple[int, float, float], b: tuple[int, float, float]) -> tuple[float, float, float]:
    """(t, p, degrees) of two groups given as (n, mean, sample variance), with pooled variance."""
    (n, x, v), (m, y, w) = a, b
    dof = n + m - 2
    se = math.sqrt(((n - 1) * v + (m - 1) * w) / dof * (1 / n + 1 / m))
    t = (x - y) / se
    return t, t_tail(t, dof), dof


def t_quantile(p: float, dof: float) -> float:
    """Value that a t-distributed figure exceeds in absolute value with probability p."""
    low, high = 0.0, 1.0
    while t_tail(high, dof) > p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_tail(mid, dof) > p else (low, mid)
    return high


def t_interval(a: tuple[int, float, float], b: tuple[int, float, float], level: float = 0.95) -> tuple[float, float]:
    """Interval of the difference of the means of two groups, with pooled variance."""
    (n, x, v), (m, y, w) = a, b
    dof = n + m - 2
    half = t_quantile(1 - level, dof) * math.sqrt(((n - 1) * v + (m - 1) * w) / dof * (1 / n + 1 / m))
    return x - y - half, x - y + half


def group_t_test(df: DataFrame, group: str, value: str, first, second) -> tuple[float, float, float]:
    """`t_test` of two groups of a DataFrame; only six numbers reach the driver."""
    rows = {r[0]: (r[1], r[2], r[3]) for r in df.where(F.col(group).isin(first, second)).groupBy(group).agg(F.count(value), F.avg(value), F.var_samp(value)).collect()}
    return t_test(rows[first], rows[second])


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two label columns, as one row (n, observed, expected, kappa); null labels are left out."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    left, right = cells.groupBy("a").agg(F.sum("n").alias("l")), cells.groupBy(F.col("b").alias("a")).agg(F.sum("n").alias("r"))
    chance = left.join(right, "a").agg(F.coalesce(F.sum(F.col("l") * F.col("r")), F.lit(0)).alias("c"))
    both = total.join(F.broadcast(chance))  # one row each
    observed, expected = F.col("same") / F.col("n"), F.col("c") / (F.col("n") * F.col("n"))
    return both.select("n", observed.alias("observed"), expected.alias("expected"), F.when(expected < 1, (observed - expected) / (1 - expected)).alias("kappa"))


def precision_recall(df: DataFrame, truth: str, guess: str, positive: str, by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 of one label, with the macro average over the label and its complement."""
    t, g = F.col(truth) == positive, F.col(guess) == positive
    n = lambda c: F.sum(c.cast("long"))
    counts = df.groupBy(*(by or [])).agg(n(t & g).alias("tp"), n(~t & g).alias("fp"), n(t & ~g).alias("fn"), n(~t & ~g).alias("tn"))
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    f1 = div(2 * tp, 2 * tp + fp + fn)
    return counts.select(
        *(by or []), "tp", "fp", "fn", "tn", div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"), f1.alias("f1"),
        ((f1 + div(2 * tn, 2 * tn + fp + fn)) / 2).alias("macro_f1"), div(tp + tn, tp + fp + fn + tn).alias("accuracy"),
    )


# ---- generalized linear models with log link


def _sums(data: DataFrame, k: int, part) -> np.ndarray:
    """Sum over all rows of the `k` numbers that `part` makes of a batch (y, x as arrays); k rows reach the driver."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(k)
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            total += part(cols[0], np.column_stack([np.ones(b.num_rows), *cols[1:]]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(total)], ["i", "v"])

    out = np.zeros(k)
    for i, v in data.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v")).collect():
        out[i] = v
    return out


def log_link_glm(df: DataFrame, y: str, xs: list[str], family: str, alpha: float = 1.0, tolerance: float = 1e-10, max_rounds: int = 60) -> list[dict]:
    """Coefficients of a `negative_binomial` (dispersion `alpha`) or `gaussian` model with log link.

    Iteratively reweighted least squares: each round is one scan that multiplies matrices of Arrow
    batches and adds the p × p results up, the only thing that reaches the driver; the plan stays the
    same however many columns there are. Rows with a null are left out. The frame should be stored by
    the caller if it is costly to make. Every result has name, coef, exp_coef, se, z, p and the 95 %
    interval, z by the normal distribution.
    """
    data = df.select(F.col(y).cast("double").alias("_y"), *(F.col(f"`{x}`").cast("double").alias(f"_x{i}") for i, x in enumerate(xs))).na.drop()
    p = len(xs) + 1
    n, total = _sums(data, 2, lambda y, x: np.array([len(y), y.sum()]))
    beta = np.zeros(p)
    beta[0] = np.log(max(total / max(n, 1), 1e-8))

    def moments(y, x, beta):
        eta = np.clip(x @ beta, -300, 300)
        mu = np.exp(eta)
        w = mu / (1 + alpha * mu) if family == "negative_binomial" else mu * mu
        return np.concatenate([((x * w[:, None]).T @ x).ravel(), (x * w[:, None]).T @ (eta + (y - mu) / mu)])

    a = np.zeros((p, p))
    for _ in range(max_rounds):
        s = _sums(data, p * p + p, lambda y, x, beta=beta: moments(y, x, beta))
        a, c = s[: p * p].reshape(p, p), s[p * p :]
        new = np.linalg.lstsq(a, c, rcond=None)[0]
        done = np.abs(new - beta).max() <= tolerance * max(1.0, np.abs(new).max())
        beta = new
        if done:
            break
    scale = 1.0
    if family == "gaussian":
        scale = _sums(data, 1, lambda y, x: np.array([((y - np.exp(x @ beta)) ** 2).sum()]))[0] / (n - p)
    se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(a)) * scale, 0))
    out = []
    for name, b, s in zip(["const", *xs], beta, se):
        z = b / s if s > 0 else float("nan")
        out.append({"name": name, "coef": float(b), "exp_coef": math.exp(min(b, 700)), "se": float(s), "z": float(z), "p": normal_tail(z) if s > 0 else float("nan"), "low": float(b - 1.959963984540054 * s), "high": float(b + 1.959963984540054 * s)})
    return out
