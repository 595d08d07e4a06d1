"""Probability laws by name: quantiles and moments, vectorised with numpy for pandas UDFs."""

from __future__ import annotations

import math

import numpy as np


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """Inverse of the normal distribution function: Newton steps on erf from a logistic start."""
    p = np.clip(np.asarray(p, float), 1e-12, 1 - 1e-12)
    x = np.log(p / (1 - p)) / 1.702
    erf = np.vectorize(math.erf, otypes=[float])
    for _ in range(12):
        density = np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
        x = x - np.clip((0.5 * (1 + erf(x / math.sqrt(2))) - p) / np.maximum(density, 1e-12), -1, 1)
    return x


def quantile(law: str, params: dict[str, float], p: np.ndarray) -> np.ndarray:
    """normal(mean, std), lognormal(mean, std of the variable itself), logistic(mean, scale), uniform(low, high), exponential(mean)."""
    p = np.asarray(p, float)
    if law == "normal":
        return params["mean"] + params["std"] * normal_quantile(p)
    if law == "lognormal":
        s2 = math.log(1 + (params["std"] / params["mean"]) ** 2)
        return np.exp(math.log(params["mean"]) - s2 / 2 + math.sqrt(s2) * normal_quantile(p))
    if law == "logistic":
        return params["mean"] + params["scale"] * np.log(p / (1 - p))
    if law == "uniform":
        return params["low"] + (params["high"] - params["low"]) * p
    if law == "exponential":
        return -params["mean"] * np.log1p(-p)
    raise ValueError(f"no law named {law}")


def cdf(law: str, params: dict[str, float], x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    erf = np.vectorize(math.erf, otypes=[float])
    if law == "normal":
        return 0.5 * (1 + erf((x - params["mean"]) / (params["std"] * math.sqrt(2))))
    if law == "lognormal":
        s2 = math.log(1 + (params["std"] / params["mean"]) ** 2)
        return 0.5 * (1 + erf((np.log(x) - math.log(params["mean"]) + s2 / 2) / math.sqrt(2 * s2)))
    if law == "logistic":
        return 1 / (1 + np.exp(-(x - params["mean"]) / params["scale"]))
    if law == "uniform":
        return np.clip((x - params["low"]) / (params["high"] - params["low"]), 0, 1)
    if law == "exponential":
        return 1 - np.exp(-x / params["mean"])
    raise ValueError(f"no law named {law}")


def truncated(law: str, params: dict[str, float], p: np.ndarray, low: float, high: float) -> np.ndarray:
    """Quantiles of the law cut to [low, high]."""
    a, b = cdf(law, params, np.array([low, high]))
    return quantile(law, params, a + (b - a) * np.asarray(p, float))
