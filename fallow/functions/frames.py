"""Functions of rolling frames that are no built-in aggregate.

Each takes a matrix of frames, one per row, missing values as NaN, and returns one
number per frame, NaN where it is not defined.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

import numpy as np

FrameFunction = Callable[[np.ndarray], np.ndarray]


def median_absolute_deviation(frames: np.ndarray) -> np.ndarray:
    """Median distance of the known values from their median."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)  # a frame without known values is NaN
        middle = np.nanmedian(frames, axis=1)
        return np.nanmedian(np.abs(frames - middle[:, None]), axis=1)


def autocorrelation(lag: int = 1) -> FrameFunction:
    """Sum of products of deviations `lag` apart over the sum of squares; NaN for constant frames and those with gaps."""

    def run(frames: np.ndarray) -> np.ndarray:
        off = frames - frames.mean(axis=1, keepdims=True)
        squares = (off * off).sum(axis=1)
        products = (off[:, :-lag] * off[:, lag:]).sum(axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(squares > 0, products / squares, np.nan)

    return run


def trimmed_mean(share: float) -> FrameFunction:
    """Mean of the known values without the given share of the smallest and of the largest, rounded down."""

    def run(frames: np.ndarray) -> np.ndarray:
        ordered = np.sort(frames, axis=1)  # NaN last
        known = (~np.isnan(frames)).sum(axis=1)
        cut = np.floor(known * share).astype(int)
        place = np.arange(frames.shape[1])[None, :]
        kept = (place >= cut[:, None]) & (place < (known - cut)[:, None])
        n = kept.sum(axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(n > 0, np.where(kept, ordered, 0.0).sum(axis=1) / n, np.nan)

    return run
