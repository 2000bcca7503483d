"""Formulas of ``columns`` on numpy arrays, for kernels whose rows are too many for row by row work."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal, localcontext

import numpy as np

from tessera.functions.columns import UNIT_ROOT


def round_half_up(v: np.ndarray, digits: int) -> np.ndarray:
    """What Spark's ``round`` makes of each double: its shortest decimal, halves away from zero; NaN and infinite stay.

    Where the scaled value lies so near to a half that its own rounding could decide, or has no digits to spare, the
    decimal itself is rounded; these are few.
    """
    scale = 10.0**digits
    with np.errstate(invalid="ignore", over="ignore"):
        y = np.abs(v) * scale
        whole = np.floor(y)
        rest = y - whole
        out = np.where(np.isfinite(v), np.copysign((whole + (rest >= 0.5)) / scale, v) + 0.0, v)
        unsure = np.flatnonzero(np.isfinite(v) & ~(np.abs(rest - 0.5) > y * 2.0**-50))
    with localcontext(prec=400):
        for k in unsure:
            out[k] = float(Decimal(repr(float(v[k]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) + 0.0
    return out


def normal_tail(x: np.ndarray) -> np.ndarray:
    """``columns.normal_tail`` of an array."""
    t = 1 / (1 + 0.2316419 * np.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = 0.3989422804014327 * np.exp(-x * x / 2) * poly
    return np.where(x >= 0, upper, 1 - upper)


def corr_p_value(corr: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """``pairs.corr_p_value`` of an array, NaN where corr is."""
    with np.errstate(invalid="ignore", divide="ignore"):
        t = np.abs(corr) * np.sqrt((n - 2) / (1 - corr * corr))
        return np.where(np.abs(corr) >= 1, 0.0, 2 * normal_tail(t))


def unit_root_p(t: np.ndarray, series: int = 2) -> np.ndarray:
    """``columns.unit_root_p`` of an array, NaN where t is."""
    near, far, border, low, high = UNIT_ROOT[series]
    z = np.where(t <= border, np.polynomial.polynomial.polyval(t, near), np.polynomial.polynomial.polyval(t, far))
    return np.where(np.isnan(t), np.nan, np.where(t <= low, 0.0, np.where(t >= high, 1.0, normal_tail(-z))))
