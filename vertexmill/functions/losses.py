"""Robust losses on a squared norm, by name: (rho, weight = rho') as numpy or column functions."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class Loss(NamedTuple):
    """rho and weight of s and the scale, in numpy; the same as columns."""

    rho: Callable
    weight: Callable
    rho_column: Callable[[Column, float], Column]
    weight_column: Callable[[Column, float], Column]


LOSSES = {
    "none": Loss(lambda s, d: s, lambda s, d: np.ones_like(s), lambda s, d: s, lambda s, d: F.lit(1.0)),
    "huber": Loss(
        lambda s, d: np.where(s <= d * d, s, 2 * d * np.sqrt(s) - d * d), lambda s, d: np.where(s <= d * d, 1.0, d / np.sqrt(np.maximum(s, 1e-300))),
        lambda s, d: F.when(s <= d * d, s).otherwise(2 * d * F.sqrt(s) - d * d), lambda s, d: F.when(s <= d * d, 1.0).otherwise(d / F.sqrt(s)),
    ),
    "cauchy": Loss(
        lambda s, d: d * d * np.log1p(s / (d * d)), lambda s, d: 1 / (1 + s / (d * d)),
        lambda s, d: d * d * F.log1p(s / (d * d)), lambda s, d: 1 / (1 + s / (d * d)),
    ),
}


def loss(name: str) -> Loss:
    if name not in LOSSES:
        raise ValueError(f"unknown loss: {name}")
    return LOSSES[name]


def register(name: str, new: Loss) -> None:
    LOSSES[name] = new
