"""Forecasters as plain functions of arrays, and the grouped jobs over series, folds and configurations that run them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Forecaster = Callable[[np.ndarray, int, dict], np.ndarray]
SEASON = 4


def seasonal_mean(y: np.ndarray, h: int, params: dict) -> np.ndarray:
    """Mean of the last n values of the same season; the overall mean where there are none."""
    n = int(params.get("n", 3))
    out = []
    for k in range(h):
        own = y[(len(y) + k) % SEASON :: SEASON]
        out.append(own[-n:].mean() if len(own) else y.mean())
    return np.array(out)


def seasonal_naive(y: np.ndarray, h: int, params: dict) -> np.ndarray:
    return np.array([y[len(y) - SEASON + k % SEASON] if len(y) >= SEASON else y[-1] for k in range(h)])


def smoothing(y: np.ndarray, h: int, alpha: float, beta: float, gamma: float, damp: float, trend: bool, seasonal: bool) -> tuple[float, np.ndarray]:
    """Additive exponential smoothing: one-step squared error and the forecast."""
    level, slope = float(y[:SEASON].mean()), float((y[SEASON : 2 * SEASON].mean() - y[:SEASON].mean()) / SEASON) if trend and len(y) >= 2 * SEASON else 0.0
    s = list(y[:SEASON] - level) if seasonal and len(y) >= SEASON else [0.0] * SEASON
    sse = 0.0
    for t, v in enumerate(y):
        season = s[t % SEASON] if seasonal else 0.0
        e = v - (level + damp * slope + season)
        sse += e * e
        old = level
        level = level + damp * slope + alpha * e
        if trend:
            slope = damp * slope + beta * (level - old - damp * slope)
        if seasonal:
            s[t % SEASON] += gamma * e
    steps = np.cumsum([damp ** (k + 1) for k in range(h)]) if trend else np.zeros(h)
    return sse, level + steps * slope + np.array([s[(len(y) + k) % SEASON] if seasonal else 0.0 for k in range(h)])


def ets(y: np.ndarray, h: int, params: dict) -> np.ndarray:
    """Exponential smoothing of the given trend (none, add, damped) and season (none, add), weights from a grid by one-step error."""
    trend, seasonal = params.get("trend", "none"), params.get("seasonal", "add") == "add"
    best = None
    for alpha in (0.05, 0.2, 0.4, 0.7, 0.95):
        for beta in (0.02, 0.1, 0.3) if trend != "none" else (0.0,):
            for gamma in (0.05, 0.2, 0.5) if seasonal else (0.0,):
                got = smoothing(y, h, alpha, beta, gamma, 0.9 if trend == "damped" else 1.0, trend != "none", seasonal)
                best = got if best is None or got[0] < best[0] else best
    return best[1]


def loess(y: np.ndarray, span: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Local linear fit at every place over the span nearest rows, tricube weights times the given ones."""
    n, x = len(y), np.arange(len(y), dtype=float)
    w0 = np.ones(n) if weights is None else weights
    out = np.empty(n)
    for i in range(n):
        d = np.abs(x - i)
        width = max(np.sort(d)[min(span, n) - 1], 1.0) * (1 if span <= n else span / n)
        w = np.clip(1 - (d / (width * 1.0001)) ** 3, 0, None) ** 3 * w0
        sw = w.sum()
        mx, my = (w * x).sum() / sw, (w * y).sum() / sw
        sxx = (w * (x - mx) ** 2).sum()
        out[i] = my + ((w * (x - mx) * (y - my)).sum() / sxx * (i - mx) if sxx > 1e-12 else 0.0)
    return out


def stl(y: np.ndarray, season: int = SEASON, rounds: int = 5, robust: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """trend, seasonal, remainder."""
    trend, weights, seasonal = np.zeros(len(y)), np.ones(len(y)), np.zeros(len(y))
    for _ in range(rounds):
        free = y - trend
        for q in range(season):
            own = slice(q, None, season)
            seasonal[own] = np.average(free[own], weights=weights[own] + 1e-12)
        seasonal -= seasonal[: len(y) // season * season].mean()
        trend = loess(y - seasonal, max(7, 2 * season + 1), weights)
        if robust:
            r = np.abs(y - trend - seasonal)
            weights = np.clip(1 - (r / (6 * np.median(r) + 1e-12)) ** 2, 0, None) ** 2
    return trend, seasonal, y - trend - seasonal


def stl_ets(y: np.ndarray, h: int, params: dict) -> np.ndarray:
    """Smoothing of what is left without the season, plus the last cycle of it."""
    _, seasonal, _ = stl(y)
    return ets(y - seasonal, h, {"trend": params.get("trend", "damped"), "seasonal": "none"}) + np.array([seasonal[len(y) - SEASON + k % SEASON] for k in range(h)])


def ridge_fit(y: np.ndarray, window: int, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float] | None:
    """Coefficients of the scaled last `window` values (oldest first), their means and scales, and the mean; None where there are too few values."""
    if len(y) <= window + 2:
        return None
    x = np.lib.stride_tricks.sliding_window_view(y, window)[:-1]
    t, mean, scale = y[window:], x.mean(axis=0), x.std(axis=0) + 1e-12
    z = (x - mean) / scale
    return np.linalg.solve(z.T @ z + alpha * np.eye(window), z.T @ (t - t.mean())), mean, scale, float(t.mean())


def ridge(y: np.ndarray, h: int, params: dict) -> np.ndarray:
    """Scaled ridge on the last `window` values, applied step by step."""
    window = int(params.get("window", 8))
    fit = ridge_fit(y, window, float(params.get("alpha", 1.0)))
    if fit is None:
        return np.full(h, y.mean())
    b, mean, scale, level = fit
    own, out = list(y), []
    for _ in range(h):
        out.append(float(((np.array(own[-window:]) - mean) / scale) @ b + level))
        own.append(out[-1])
    return np.array(out)


def ridge_deseason(y: np.ndarray, h: int, params: dict) -> np.ndarray:
    index = np.array([y[q::SEASON].mean() for q in range(SEASON)]) - y.mean()
    own = index[np.arange(len(y)) % SEASON]
    return ridge(y - own, h, params) + index[(len(y) + np.arange(h)) % SEASON]


FORECASTERS: dict[str, Forecaster] = {"seasonal_mean": seasonal_mean, "seasonal_naive": seasonal_naive, "ets": ets, "stl_ets": stl_ets, "ridge": ridge, "ridge_deseason": ridge_deseason}


def walk_forward(df: DataFrame, configs: list[tuple[str, str, dict]], key: str, time: str, y: str, n_test: int = 20, h: int = 4, inner_share: float = 0.4) -> DataFrame:
    """key, config, origin_date, target_date, horizon, y_true, y_pred, fold_set, error: every configuration (name, forecaster, parameters) refitted at each origin.

    One task holds one series and configuration; a series that fails has its error as text and no forecasts.
    """
    names = {n: (f, p) for n, f, p in configs}
    spark = df.sparkSession
    work = df.select(key, time, y).crossJoin(F.broadcast(spark.createDataFrame([(n,) for n in names], "config string")))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[y]).sort_values(time)
        name, k = pdf["config"].iloc[0] if len(pdf) else None, pdf[key].iloc[0] if len(pdf) else None
        values, dates, out = pdf[y].to_numpy(float), pdf[time].tolist(), []
        # every h rows over the last n_test, as far as there is more than a season before
        origins = [o for o in range(len(values) - n_test, len(values) - h + 1, h) if o > SEASON]
        inner = min(int(np.ceil(inner_share * len(origins))), len(origins) - 1)
        try:
            if not origins:
                raise ValueError("history too short")
            f, params = names[name]
            for i, o in enumerate(origins):
                got = FORECASTERS[f](values[:o], h, params)
                out += [(k, name, dates[o - 1], dates[o + j], j + 1, values[o + j], float(got[j]), "inner" if i < inner else "outer", None) for j in range(h)]
        except (ValueError, np.linalg.LinAlgError) as e:
            out = [(k, name, None, None, None, None, None, None, str(e))]
        return pd.DataFrame(out, columns=columns)

    types = dict(df.dtypes)
    columns = [key, "config", "origin_date", "target_date", "horizon", "y_true", "y_pred", "fold_set", "error"]
    schema = f"{key} {types[key]}, config string, origin_date {types[time]}, target_date {types[time]}, horizon int, y_true double, y_pred double, fold_set string, error string"
    return work.groupBy(key, "config").applyInPandas(fit, schema)


def forward(df: DataFrame, champions: DataFrame, configs: list[tuple[str, str, dict]], key: str, time: str, y: str, h: int = 4) -> DataFrame:
    """key, config, step, y_pred: each series' champion configuration refitted on its whole history."""
    names = {n: (f, p) for n, f, p in configs}

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[y]).sort_values(time)
        name = pdf["config"].iloc[0]
        f, params = names[name]
        got = FORECASTERS[f](pdf[y].to_numpy(float), h, params)
        return pd.DataFrame({key: pdf[key].iloc[0], "config": name, "step": np.arange(1, h + 1, dtype=np.int32), "y_pred": got})

    return df.select(key, time, y).join(champions.select(key, "config"), key).groupBy(key).applyInPandas(fit, f"{key} {dict(df.dtypes)[key]}, config string, step int, y_pred double")


def decompose(df: DataFrame, key: str, time: str, y: str) -> DataFrame:
    """key, time, trend, seasonal, remainder of each series."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[y]).sort_values(time)
        t, s, r = stl(pdf[y].to_numpy(float))
        return pd.DataFrame({key: pdf[key], time: pdf[time], "trend": t, "seasonal": s, "remainder": r})

    types = dict(df.dtypes)
    return df.select(key, time, y).groupBy(key).applyInPandas(fit, f"{key} {types[key]}, {time} {types[time]}, trend double, seasonal double, remainder double")


def sliding_backtest(df: DataFrame, key: str, time: str, y: str, window: int = 48, h: int = 4) -> DataFrame:
    """key, step, n and rmse of seasonal means over a window of fixed length that moves by one row; h is a season at most, so a target's season-mates in the window are the last window / SEASON before it."""
    w = Window.partitionBy(key).orderBy(time)
    d = df.select(key, time, y).withColumn("place", F.row_number().over(w))
    season = Window.partitionBy(key, F.col("place") % SEASON).orderBy(time).rowsBetween(-(window // SEASON), -1)
    d = d.withColumn("error", F.col(y) - F.avg(y).over(season)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(h)))).where(F.col("place") >= window + F.col("step"))
    return d.groupBy(key, "step").agg(F.count("error").alias("n"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"))
