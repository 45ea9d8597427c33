"""Walk-forward fits: logistic regressions, least squares, bootstraps, two-state EM; one task for each series and refit.

A group is one series' rows up to a refit: daily rows, so a few thousand. Series and refits spread over the cluster.
Two-state fits begin where the refit before ended, so there one task takes a series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import SERIES, sigmoid

PURGE, C, LEAST_ROWS, LEAST_POSITIVE = 20, 1.0, 100, 20
#: Two-state fits: rows at least, rounds of the first and of later refits, what is added to variances, transitions at first.
REGIME_ROWS, FIRST_ROUNDS, NEXT_ROUNDS, JITTER = 50, 300, 100, 1e-6
STAY = ((0.98, 0.02), (0.05, 0.95))


def refits(df: DataFrame) -> DataFrame:
    """First session of each year of a series: series_id, year, refit_pos, refit_date, and next_pos, null on the last."""
    got = df.groupBy(SERIES, F.year("date").alias("year")).agg(F.min("pos").alias("refit_pos"), F.min("date").alias("refit_date"))
    return got.withColumn("next_pos", F.lead("refit_pos").over(Window.partitionBy(SERIES).orderBy("year")))


def training(df: DataFrame, purge: int = PURGE) -> DataFrame:
    """df with each refit whose labels were all known: pos at most refit_pos - purge - 1."""
    r = refits(df).select(SERIES, "year", "refit_pos")
    return df.join(r, SERIES).filter(F.col("pos") <= F.col("refit_pos") - purge - 1)


def irls(x: np.ndarray, y: np.ndarray, c: float = C) -> np.ndarray:
    """Intercept and coefficients of an L2 logistic regression; the intercept isn't penalised."""
    design = np.column_stack([np.ones(len(x)), x])
    penalty = np.full(design.shape[1], 1 / c)
    penalty[0] = 0
    b = np.zeros(design.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -500, 500)))
        gradient = design.T @ (p - y) + penalty * b
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty) + 1e-12 * np.eye(len(b)), gradient)
        b -= step
        if np.abs(step).max() < 1e-10:
            break
    return b


def logit_walk_forward(df: DataFrame, names: list[str], purge: int = PURGE) -> DataFrame:
    """series_id, year, n, coef (intercept first) of each refit with enough rows and positives."""
    return logit_by_group(training(df, purge).dropna(subset=[*names, "y"]), names)


def logit_by_group(rows: DataFrame, names: list[str]) -> DataFrame:
    """The same for rows (series_id, year, pos, y, names) that are already those to learn from."""
    rows = rows.select(SERIES, "year", "pos", "y", *names)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        y = group["y"].to_numpy(float)
        if len(y) < LEAST_ROWS or y.sum() < LEAST_POSITIVE or y.sum() == len(y):
            return pd.DataFrame(columns=[SERIES, "year", "n", "coef"])
        return pd.DataFrame({SERIES: [group[SERIES].iloc[0]], "year": [group["year"].iloc[0]], "n": [len(y)], "coef": [irls(group[names].to_numpy(float), y).tolist()]})

    return rows.groupBy(SERIES, "year").applyInPandas(one, f"{SERIES} string, year int, n long, coef array<double>")


def score_segments(df: DataFrame, params: DataFrame, names: list[str], linear: bool = False) -> DataFrame:
    """df with pred: each session by the parameters of its year; null before the first refit."""
    z = F.col("coef")[0] + sum(F.col("coef")[i + 1] * F.col(n) for i, n in enumerate(names))
    joined = df.withColumn("year", F.year("date")).join(params.select(SERIES, "year", "coef"), [SERIES, "year"], "left")
    return joined.withColumn("pred", z if linear else sigmoid(z)).drop("coef", "year")


def ols_walk_forward(df: DataFrame, names: list[str], y: str, purge: int = PURGE) -> DataFrame:
    """Least squares per refit from sums of products, so tasks send a few numbers, not rows."""
    terms = [F.lit(1.0), *(F.col(n) for n in names)]
    k = len(terms)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = [F.sum(terms[i] * terms[j]).alias(f"xx{i}_{j}") for i, j in pairs] + [F.sum(t * F.col(y)).alias(f"xy{i}") for i, t in enumerate(terms)]
    got = training(df, purge).dropna(subset=[*names, y]).groupBy(SERIES, "year").agg(F.count("*").alias("n"), *sums).filter(F.col("n") >= LEAST_ROWS)

    def solve(frames):
        for f in frames:
            out = []
            for row in f.to_dict("records"):
                a = np.zeros((k, k))
                for i, j in pairs:
                    a[i, j] = a[j, i] = row[f"xx{i}_{j}"]
                out.append(np.linalg.solve(a, [row[f"xy{i}"] for i in range(k)]).tolist())
            yield pd.DataFrame({SERIES: f[SERIES], "year": f["year"], "n": f["n"], "coef": out})

    return got.mapInPandas(solve, f"{SERIES} string, year int, n long, coef array<double>")


def block_bootstrap(df: DataFrame, value: str, by: list[str], block: int = 40, draws: int = 2000, seed: int = 0, ratio_to: str | None = None, quantile: float | None = None) -> DataFrame:
    """Circular block bootstrap of the mean of a column, of 1 - mean / mean of ``ratio_to``, or of a quantile: estimate and 95 % interval."""
    kinds = dict(df.dtypes)
    names = [value] + ([ratio_to] if ratio_to else [])

    def statistic(x: np.ndarray, axis: int) -> np.ndarray:
        if quantile is not None:
            return np.quantile(x[..., 0], quantile, axis=axis)
        means = x.mean(axis)
        return 1 - means[..., 0] / means[..., 1] if ratio_to else means[..., 0]

    def one(group: pd.DataFrame) -> pd.DataFrame:
        x = group.sort_values("pos")[names].to_numpy(float)
        n, k = len(x), -(-len(x) // block)
        rng, stats = np.random.default_rng(seed), []
        lot = max(1, 2_000_000 // max(n, 1))
        for i in range(0, draws, lot):
            starts = rng.integers(0, n, size=(min(lot, draws - i), k))
            at = ((starts[:, :, None] + np.arange(block)) % n).reshape(len(starts), -1)[:, :n]
            stats.append(statistic(x[at], 1))
        drawn = np.concatenate(stats)
        low, high = np.percentile(drawn, [2.5, 97.5])
        return pd.DataFrame({**{c: [group[c].iloc[0]] for c in by}, "n": [n], "estimate": [float(statistic(x, 0))], "low": [low], "high": [high]})

    return df.dropna(subset=names).select(*by, "pos", *names).groupBy(*by).applyInPandas(one, ", ".join(f"{c} {kinds[c]}" for c in by) + ", n long, estimate double, low double, high double")


def _stationary(a: np.ndarray) -> np.ndarray:
    return np.array([a[1, 0], a[0, 1]]) / (a[0, 1] + a[1, 0])


def posteriors(x: np.ndarray, a: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """State probabilities of each row, expected transitions, and the log-likelihood: scaled forward and backward passes."""
    logs = np.empty((len(x), 2))
    for k in range(2):
        d = x - mean[k]
        logs[:, k] = -0.5 * (np.einsum("ti,ij,tj->t", d, np.linalg.inv(cov[k]), d) + np.linalg.slogdet(cov[k])[1] + x.shape[1] * np.log(2 * np.pi))
    most = logs.max(1)
    b = np.exp(logs - most[:, None])
    (a00, a01), (a10, a11) = a.tolist()
    (p0, p1), alpha, scale = _stationary(a).tolist(), [], []
    for b0, b1 in b.tolist():  # plain numbers: a step on arrays of two takes ten times as long
        f0, f1 = p0 * b0, p1 * b1
        s = f0 + f1
        f0, f1 = f0 / s, f1 / s
        alpha.append((f0, f1))
        scale.append(s)
        p0, p1 = f0 * a00 + f1 * a10, f0 * a01 + f1 * a11
    g0 = g1 = 1.0
    beta = [(g0, g1)]
    for (b0, b1), s in zip(b[:0:-1].tolist(), scale[:0:-1], strict=True):
        g0, g1 = b0 * g0 / s, b1 * g1 / s
        g0, g1 = a00 * g0 + a01 * g1, a10 * g0 + a11 * g1
        beta.append((g0, g1))
    alpha, beta, scale = np.array(alpha), np.array(beta[::-1]), np.array(scale)
    moves = a * (alpha[:-1].T @ (b[1:] * beta[1:] / scale[1:, None]))
    return alpha * beta, moves, float((np.log(scale) + most).sum())


def em_chain(x: np.ndarray, a: np.ndarray, mean: np.ndarray, cov: np.ndarray, rounds: int, tolerance: float = 1e-6) -> tuple:
    """Baum-Welch of a two-state Gaussian chain: a, mean, cov, shares of the states, rounds taken, whether it converged.

    The first state is drawn from the stationary distribution. State 1 is the one whose first observation is wider.
    """
    last, converged, taken = -np.inf, False, 0
    for _ in range(rounds):
        gamma, moves, ll = posteriors(x, a, mean, cov)
        if ll - last < tolerance:
            converged = True
            break
        last, taken = ll, taken + 1
        a = moves / moves.sum(1, keepdims=True)
        weight = gamma.sum(0)
        mean = (gamma.T @ x) / weight[:, None]
        far = [x - mean[k] for k in range(2)]
        cov = np.stack([(d * gamma[:, k, None]).T @ d / weight[k] + JITTER * np.eye(x.shape[1]) for k, d in enumerate(far)])
    if not all(np.isfinite(v).all() for v in (a, mean, cov)):
        raise ArithmeticError("a state lost all its rows")
    if cov[0, 0, 0] > cov[1, 0, 0]:
        a, mean, cov = a[::-1, ::-1], mean[::-1], cov[::-1]
    return a, mean, cov, posteriors(x, a, mean, cov)[0].mean(0), taken, converged


def split(x: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the fit begins: both halves' means and covariances."""
    halves = [x[~wide], x[wide]]
    return np.array(STAY), np.stack([h.mean(0) for h in halves]), np.stack([np.atleast_2d(np.cov(h.T, bias=True)) + JITTER * np.eye(x.shape[1]) for h in halves])


def em_two_states(x: np.ndarray, rounds: int = 200, tolerance: float = 1e-6) -> tuple[float, float, float, float, float, float]:
    """p00, p11, means and variances of a two-state chain of one observation, from a median split of its distances."""
    far = np.abs(x - np.median(x))
    a, mean, cov, *_ = em_chain(x[:, None], *split(x[:, None], far > np.median(far)), rounds, tolerance)
    return tuple(float(v) for v in (a[0, 0], a[1, 1], *mean[:, 0], *cov[:, 0, 0]))


def guarded(a: np.ndarray, mean: np.ndarray, cov: np.ndarray, shares: np.ndarray) -> bool:
    """Whether both states last, are apart in log volatility, and hold rows."""
    stays = all(0.90 <= a[k, k] <= 0.999 for k in range(2))
    return bool(stays and mean[1, 1] - mean[0, 1] >= 0.3 and shares.min() >= 0.05 and all(np.linalg.det(c) > 0 for c in cov))


REGIME = ["p00", "p11", "mean_r0", "mean_v0", "mean_r1", "mean_v1", "var_r0", "cov_rv0", "var_v0", "var_r1", "cov_rv1", "var_v1"]


def regimes(df: DataFrame, purge: int = PURGE) -> DataFrame:
    """Parameters of the two-state model of the observations r100 and ln_rv10 by series and refit.

    A refit learns from all rows up to refit_pos - purge - 1 and begins at the parameters before it (the first one at a
    median split of ln_rv10), so one task takes the refits of a series in order. Parameters that fail the guard are
    replaced by those before (kept_prev); a first fit has none before it and stays. Refits of fewer than REGIME_ROWS
    rows, or whose rows can't be split, have no row.
    """
    names = [SERIES, "year", "n", *REGIME, "rounds", "converged", "kept_prev"]

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        pos, x = group["pos"].to_numpy(), group[["r100", "ln_rv10"]].to_numpy(float)
        whole = np.isfinite(x).all(1)
        out, theta = [], None
        for year, first in group.groupby("year")["pos"].min().items():
            rows = x[whole & (pos <= first - purge - 1)]
            wide = rows[:, 1] > np.median(rows[:, 1]) if len(rows) else np.zeros(0, bool)
            if len(rows) < REGIME_ROWS or theta is None and min(wide.sum(), (~wide).sum()) < 2:
                continue
            try:
                a, mean, cov, shares, taken, converged = em_chain(rows, *(theta or split(rows, wide)), FIRST_ROUNDS if theta is None else NEXT_ROUNDS)
                kept = theta is not None and not guarded(a, mean, cov, shares)
            except (ArithmeticError, np.linalg.LinAlgError):
                if theta is None:
                    continue
                kept, taken, converged = True, 0, False
            if not kept:
                theta = a, mean, cov
            a, mean, cov = theta
            upper = [v for c in cov for v in (c[0, 0], c[0, 1], c[1, 1])]
            out.append([group[SERIES].iloc[0], year, len(rows), a[0, 0], a[1, 1], *mean.ravel(), *upper, taken, converged, kept])
        return pd.DataFrame(out, columns=names)

    rows = df.select(SERIES, F.year("date").alias("year"), "pos", "r100", "ln_rv10")
    return rows.groupBy(SERIES).applyInPandas(one, f"{SERIES} string, year int, n long, {', '.join(f'{c} double' for c in REGIME)}, rounds long, converged boolean, kept_prev boolean")
